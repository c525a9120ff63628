import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textilla.functions import text as tx
from textilla.functions.stemmer import stem
from textilla.operators import grouping, label_tree, metrics, models, sampling, split
from textilla.operators.ranking import global_rank
from textilla.sources import store


def _rank(s):
    return [sorted(x) if isinstance(x, set) else [x] for x in s]


def _value(spark, a, b, f):
    df = spark.createDataFrame([([list(map(str, x)) for x in _rank(a)], [list(map(str, x)) for x in _rank(b)])], "a array<array<string>>, b array<array<string>>")
    return df.select(f(F.col("a"), F.col("b")).alias("v")).first()["v"]


@pytest.mark.parametrize("d,v", [(1, 1.0), (3, 0.667), (4, 1.0), (5, 0.8)])
def test_agreement(spark, d, v):
    assert round(_value(spark, "abcde", "abdcf", lambda a, b: metrics.agreement(a, b, F.lit(d))), 3) == v


def test_ties(spark):
    a, b = [{1, 2}, 3], [1, {2, 3}]
    assert round(_value(spark, a, b, lambda x, y: metrics.agreement(x, y, F.lit(1))), 3) == 0.667
    assert _value(spark, a, b, lambda x, y: metrics.agreement(x, y, F.lit(2))) == 1
    t = ["a", {"b", "c"}, "d"]
    assert _value(spark, t, t, lambda x, y: metrics.overlap(x, y, F.lit(3))) == 3
    assert _value(spark, "abcd", "abcd", lambda x, y: metrics.overlap(x, y, F.lit(5))) == 4


def test_rbo_family(spark):
    for d, v in enumerate([0, 0, 0.222, 0.292, 0.313, 0.317, 0.312], 1):
        assert round(_value(spark, "abcdefg", "zcavwxy", lambda a, b, d=d: metrics.average_overlap(a, b, F.lit(d))), 3) == v
    for a, b, f, v in [("abcdefg", "abcdefg", metrics.rbo_min, 0.767), ("abcdefgh", "abcdefg", metrics.rbo_min, 0.767), ("abcdefg", "abcdefg", metrics.rbo_res, 0.233), ("abcdefg", "abcdefghijklmnopqrstuvwxyz", metrics.rbo_res, 0.239), ("abcdefg", "abcdefg", metrics.rbo_ext, 1.0), ("abcdefg", "bacdefg", metrics.rbo_ext, 0.9)]:
        assert round(_value(spark, a, b, lambda x, y, f=f: f(x, y, 0.9)), 3) == v


def test_roc(spark):
    rng = random.Random(3)
    rows = [("c", rng.choice([0.1, 0.2, 0.3, 0.4]), rng.choice([-1, 1])) for _ in range(200)] + [("one", 0.5, 1)]
    got = {r["cat"]: r["auc"] for r in metrics.auc(metrics.roc(spark.createDataFrame(rows, "cat string, score double, y int"))).collect()}
    pos, neg = [s for c, s, y in rows if c == "c" and y > 0], [s for c, s, y in rows if c == "c" and y < 0]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(got["c"] - pairs) < 1e-12 and got["one"] is None


def test_mass_confusion(spark):
    rows = [(1, ["a", "b"], ["a", "c"]), (2, ["a"], ["b"]), (3, [], ["a"]), (4, ["a", "a"], ["a"])]
    got = metrics.mass_confusion(spark.createDataFrame(rows, "doc int, t array<string>, p array<string>"), "doc", "t", "p")
    assert abs(got.agg(F.sum("mass")).first()[0] - 3) < 1e-9


def test_emd(spark):
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(2, 5))
        block = rng.integers(0, 2, n)
        cost = (block[:, None] != block[None, :]).astype(float)
        p, q = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n))
        want = 1 - sum(min(p[block == b].sum(), q[block == b].sum()) for b in (0, 1))
        assert abs(metrics.transport(p, q, cost) - want) < 1e-9
    line = np.abs(np.arange(4)[:, None] - np.arange(4)[None, :]).astype(float)
    p, q = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4))
    assert abs(metrics.transport(p, q, line) - np.abs(np.cumsum(p - q))[:-1].sum()) < 1e-9


def _brute_ratio(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        prev = row
    return 2 * prev[-1] / (len(a) + len(b)) if a or b else 1.0


def test_indel_ratio():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert abs(grouping.indel_ratio(a, b) - _brute_ratio(a, b)) < 1e-12


def test_groups(spark):
    long = "lorem ipsum dolor sit amet consectetur " * 3
    rows = [("TIN2011-24533-C02-01", long), ("TIN2011-24533-C02-02", long), ("TIN2011-24533-C02-03", long[:-4] + "xyz"), ("TIN2011-24533", long), ("TIN2011-99999-C02-01", "short"), ("TIN2011-24533-C02-04", None), ("TIN2011-24533-C02-05", long + "y" * 60)]
    df = spark.createDataFrame(rows, "ref string, text string")
    assert df.select(grouping.shape(F.col("ref"))).first()[0] == "aaa0000-00000-C00-00"
    pairs = grouping.similar_pairs(grouping.candidate_pairs(df, "ref", "text"))
    got = {(r["i"][-2:], r["j"][-2:]) for r in pairs.collect()}
    assert got == {(a, b) for a in ("01", "02", "03") for b in ("01", "02", "03") if a != b}
    reps = grouping.representatives(grouping.consolidate(grouping.lists(pairs)))
    assert {r["group_ref"] for r in reps.collect()} == {"TIN2011-24533-C02-01"}
    assert grouping.assign(df, "ref", grouping.connected_groups(pairs)).filter("group_ref IS NULL AND group_key = ref").count() == 4
    chain = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "c")], "i string, j string")
    assert {r["group_ref"] for r in grouping.connected_groups(chain).collect()} == {"a"}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, x string, y double")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "m")], "k int, x string, z string")
    once = store.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1.0, None), (2, None, 2.0, "n"), (3, "c", None, "m")]
    assert sorted(map(tuple, store.upsert(once, new, "k").collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, store.set_field(old, new, "k").collect())) == [(1, "a", 1.0), (2, None, 2.0)]


def test_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("w1;1\r\nw2;-1\r\nw1;0\r\n")
    assert {(r["wid"], r["label"]) for r in store.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {("w1", "0"), ("w2", "-1")}
    (tmp_path / "u.csv").write_text("http://www.a.es/b\nhttp://a.es/b,x\n")
    assert [tuple(r) for r in store.read_urls(spark, str(tmp_path / "u.csv")).collect()] == [("a_es__b", "http://a.es/b")]
    d = tmp_path / "dir" / "sub"
    d.mkdir(parents=True)
    (d / "a.csv").write_text("x,y\n1,\n")
    (d / "~b.csv").write_text("x,y\n2,3\n")
    assert [tuple(r) for r in store.read_directory(spark, str(tmp_path / "dir"), header="true").collect()] == [("1", "")]
    h = spark.createDataFrame([('{"w": {"t1": {"url": "u", "marker": 1, "relabel": 0, "label": "1", "date": "2017-01-02T03:04:05", "userId": "me"}}}',), ("no json",)], "value string")
    assert [(r["wid"], r["tid"], r["date"].year) for r in store.read_history(h).collect()] == [("w", "t1", 2017)]
    store.export(h, str(tmp_path / "out"))
    assert store.read_saved(spark, str(tmp_path / "out")).count() == 2
    assert store.export_bundle({"h": h}, str(tmp_path / "b")) == [str(tmp_path / "b/h")]


def test_tree(spark):
    tree = spark.createDataFrame([("A_", None), ("a1", "A_"), ("a2", "A_"), ("B_", None), ("b1", "B_")], "cat string, parent string")
    assert label_tree.is_tree(tree)
    assert not label_tree.is_tree(spark.createDataFrame([("x", "y"), ("y", "x")], "cat string, parent string"))
    rows = [(1, "a1", 1), (2, "A_", -1), (3, "a1", 1), (3, "A_", -1), (4, "a1", -99), (4, "b1", 1), (5, "A_", -1), (5, "B_", -1)]
    lab = spark.createDataFrame(rows, "key int, cat string, y int")
    got = {}
    for r in label_tree.infer(lab, tree).collect():
        got.setdefault(r["key"], {})[r["cat"]] = r["y"]
    assert got[1] == {"A_": 1, "a1": 1, "a2": 0, "B_": 0, "b1": 0}
    assert got[2] == {"A_": -1, "a1": -1, "a2": -1, "B_": 0, "b1": 0}
    assert all(set(got[k].values()) == {0} for k in (3, 4, 5))
    single = {r["cat"]: r["y"] for r in label_tree.infer(lab.filter("key = 1"), tree, True).collect()}
    assert single == {"A_": 1, "a1": 1, "a2": -1, "B_": -1, "b1": 0}
    lists = spark.createDataFrame([(1, ["b1", "zz", "a1"])], "key int, labels array<string>")
    assert {(r["cat"], r["y"]) for r in label_tree.rank_labels(lists, tree).collect()} == {("b1", 1), ("a1", 2), ("A_", 1), ("B_", 1), ("a2", -1)}


def test_tourney(spark):
    for n, m in ((409, 10), (50, 1), (30, 30)):
        p = [r["p"] for r in spark.range(1, n + 1).select(sampling.tourney_probability(F.col("id"), n, m).alias("p")).collect()]
        want = [math.comb(n - k, m - 1) / math.comb(n, m) for k in range(1, n + 1)] if m > 1 else [1 / n] * n
        assert abs(sum(p) - 1) < 1e-9 and max(abs(a - b) for a, b in zip(p, want)) < 1e-12


def test_draws():
    n, counts = 40, [0] * 41
    for seed in range(4000):
        for r, _ in sampling.draw_ranks(n, 1, 1.0, 5, seed):
            counts[r] += 1
    p1 = math.comb(n + 4 - 1, 4) / math.comb(n + 4, 5)
    assert abs(counts[1] / 4000 - p1) < 0.03
    picks = sampling.draw_ranks(20, 20, 0.5, 5, 1)
    assert sorted(r for r, _ in picks) == list(range(1, 21))


def test_rank_and_split(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = [(r["v"], r["id"]) for r in global_rank(df, [F.col("v").asc(), F.col("id").desc()]).orderBy("rank").collect()]
    assert got == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (x[0], -x[1]))
    parts = split.group_split(df.withColumn("g", F.col("id") % 50), "g")
    assert parts.filter("is_train").select("g").distinct().count() == 40 and parts.count() == 1000
    assert parts.select("g", "is_train").distinct().count() == 50


def test_text(spark):
    row = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c(F.col("x")).alias("y")).first()["y"]
    assert row(tx.tokens, "C++ I+D 3.14 el niño.") == ["C", "I+D", "3.14", "el", "niño"]
    assert row(lambda c: tx.drop_numbers(F.split(c, " ")), "1e5 nan inf 1_000 a1 12 -3.5") == ["a1"]
    assert row(tx.display_case, "HOLA. que tal") == "Hola. Que tal"
    assert row(lambda c: tx.clean_labels(c, "++"), "a++B_++a++ b") == ["a", "b"]
    assert row(tx.wid, "http://WWW.a.es/x") == "a_es__x"


@pytest.mark.parametrize("word,want", [("canciones", "cancion"), ("rápidamente", "rapid"), ("nacional", "nacional"), ("cantando", "cant"), ("chicos", "chic"), ("torneo", "torne"), ("abarcaban", "abarc"), ("biología", "biolog"), ("habitaciones", "habit")])
def test_stem(word, want):
    assert stem(word) == want


def test_grid():
    sizes = {k: len(models.grid([k])) for k in ("LR", "LSVM", "SVMpoly", "DT", "AB", "RF", "MLP", "KNN", "LASSO", "EN", "MNB", "BNB")}
    assert sizes == {"LR": 15, "LSVM": 15, "SVMpoly": 30, "DT": 1, "AB": 5, "RF": 5, "MLP": 35, "KNN": 5, "LASSO": 7, "EN": 49, "MNB": 8, "BNB": 7}
