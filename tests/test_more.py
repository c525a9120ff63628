import random

import pytest
from pyspark.sql import functions as F

from textilla.functions import stemmer
from textilla.operators import decide, embed, label_tree, models, relational, sampling
from textilla.sources import store


def test_catalog(spark):
    store.reset_table(spark, "tabla_uno", "k int, v string")
    assert "tabla_uno" in store.table_names(spark) and store.column_names(spark, "tabla_uno") == ["k", "v"] and store.column_names(spark, "no_such") == []
    df = spark.table("tabla_uno")
    assert store.table_info(df) == (["k", "v"], 0)
    wide = store.add_column(store.add_column(df, "w", "double"), "w", "int")
    assert wide.columns == ["k", "v", "w"] and store.drop_column(wide, "w").columns == ["k", "v"]
    assert store.show(store.insert(df, spark.createDataFrame([(1,)], "k int"))).collect()[0]["v"] is None
    spark.sql("DROP TABLE tabla_uno")


def test_versions(spark, tmp_path):
    path = store.save_version(spark.range(3).toDF("x"), str(tmp_path), "1")
    assert store.read_saved(spark, path).count() == 3
    with pytest.raises(Exception):
        store.save_version(spark.range(3).toDF("x"), str(tmp_path), "1")


def test_report(spark):
    df = spark.createDataFrame([("d1", ["a"], ["a", "b"], [1.0, 0.123456])], "doc string, t array<string>, p array<string>, w array<double>")
    line = store.prediction_report(df, "doc", "t", "p", "w", 6).first()["line"]
    assert line == "d1    a     a (1.0), b (0.123)"
    got = decide.spread(df, "doc", "p", 3, values="w").first()
    assert (got["Cat_0"], got["Cat_2"], got["Peso_1"], got["Peso_2"]) == ("a", "", "0.12", None)
    assert decide.persist_form(df, "doc", "p", "w").first()["classif"] == "a+b"


def test_decisions(spark):
    """All above, none above, all negative, a maximum of 0, ties."""
    rows = [(1, "a", 0.4), (1, "b", 0.8), (2, "a", -0.4), (2, "b", -0.2), (3, "a", 0.0), (3, "b", -0.5), (4, "b", 0.5), (4, "a", 0.5)]
    s = spark.createDataFrame(rows, "doc int, cat string, p double")
    kept = decide.normalise(decide.keep_or_best(s, "doc"), "doc")
    got = {(r["doc"], r["cat"]): r["q"] for r in kept.collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 1.0, (2, "b"): 1.0, (3, "a"): None, (4, "a"): 1.0, (4, "b"): 1.0}
    order = {r["doc"]: r["labels"] for r in decide.decide(s, "doc").collect()}
    assert order == {1: ["b", "a"], 2: ["b"], 4: ["a", "b"]}


def test_accents(spark):
    t = spark.createDataFrame([("camion",), ("casa",), ("zzz",)], "token string")
    d = spark.createDataFrame([("camión",), ("casa",)], "word string")
    assert {(r["token"], r["lemma"]) for r in stemmer.accented(t, d).collect()} == {("camion", "camión"), ("casa", "casa"), ("zzz", "zzz")}


def test_lemmas(spark):
    df = spark.createDataFrame([(1, "Las canciones. El 3 y rápidamente!"), (2, None), (3, "")], "k int, t string")
    got = {r["k"]: r["lemmas"] for r in stemmer.lemmatise(df, "k", "t", ["las", "el", "y"]).collect()}
    assert got == {1: "cancion\nrapid", 2: "", 3: ""}


def test_knn_and_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], 1 if i > 5 else -1) for i in range(10)], "k int, v array<double>, y int")
    got = {r["k"]: r["score"] for r in models.knn(df, df.filter("k IN (1, 8)"), "k", "v", "y", 3).collect()}
    assert got == {1: -1.0, 8: 1.0}
    assert [r["k"] for r in embed.closest(df, "k", "v", 4, 2).collect()] == [3, 5]
    assert embed.vector(df, "k", 99).count() == 0


def test_models(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.dense([float(i % 2), 1.0]), float(i % 2)) for i in range(40)]
    df = models.balanced(spark.createDataFrame(rows, ["k", "features", "label"]))
    for name, kind, params in [models.grid(["LR"])[10], models.grid(["LSVM"])[8], models.grid(["DT"])[0], models.grid(["RF"])[1], models.grid(["MNB"])[2], models.grid(["AB"])[1]]:
        out = models.predict(models.estimator(kind, params, 40).fit(df), df)
        assert out.filter("abs(score) > 1").count() == 0 and out.filter("(score > 0) = (label = 1)").count() >= 38, name
    with pytest.raises(ValueError):
        models.estimator("SVMpoly", {}, 1)
    labels = df.select("k", F.lit("c").alias("cat"), (2 * F.col("label") - 1).alias("y"))
    out = models.cross_validate(df.select("k", "features"), labels, "k", [models.grid(["KNN"])[1], models.grid(["MLP"])[0]], 3)
    assert out.count() == 80 and out.filter("model_name = 'KNNN5' AND (score > 0) = (y = 1)").count() == 40


def test_updates(spark):
    tree = spark.createDataFrame([("A_", None), ("a1", "A_")], "cat string, parent string")
    old = spark.createDataFrame([(1, "a1", 1), (2, "a1", 1)], "key int, cat string, y int")
    new = spark.createDataFrame([(1, "a1", 0), (2, "a1", -99), (3, "a1", 1)], "key int, cat string, y int")
    got = {(r["key"], r["cat"]): r["y"] for r in label_tree.update(old, new, tree).collect()}
    assert got[1, "a1"] == 1 and got[1, "A_"] == 1 and got[2, "a1"] == -99 and got[3, "A_"] == 1
    info = spark.createDataFrame([(1, "x")], "key int, u string")
    inf, lab = label_tree.transfer_labels(info, spark.createDataFrame([(1, "y"), (3, "z")], "key int, u string"), old, new, tree)
    assert {tuple(r) for r in inf.collect()} == {(1, "y"), (3, "z")} and lab.count() == 6
    m = label_tree.to_map(old)
    assert {tuple(r) for r in label_tree.from_map(m).collect()} == {(1, "a1", 1), (2, "a1", 1)}


def test_estimate(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("v"), F.lit(0.001).alias("p"))
    assert abs(sampling.estimate(df, F.col("v"), F.col("p")).first()[0] - 4.5) < 1e-9


def test_nulls_in_aggregates(spark):
    df = spark.createDataFrame([(1, None, None), (1, "b", 2), (None, "c", 1)], "k int, v string, pos int")
    got = {r["k"]: r["v"] for r in relational.merge_groups(df, "k", [], "v", "pos").collect()}
    assert got == {1: "b", None: "c"}


def test_whole_grid_validated(spark, data):
    """M8 covers every area and model, M9 chooses among them, and the fits agree with Spark ML's."""
    import numpy as np

    from textilla.plans import analytic_queries as aq

    got = aq.add.queries["m8_cross_validation"](spark, data).collect()
    areas = {r[0] for r in spark.read.parquet(f"{data}/taxonomy.parquet").select("reference").collect() if not r[0].endswith("_")}
    names = {m[0] for m in models.grid(["LR"])}
    assert len(got) == 150 and {(r["cat"], r["model_name"]) for r in got} == {(a, m) for a in areas for m in names}
    best = aq.add.queries["m9_validated"](spark, data).collect()
    assert {r["cat"] for r in best} == areas
    for r in best:
        assert r["auc"] == max((x["auc"] for x in got if x["cat"] == r["cat"] and x["auc"] is not None), default=None)

    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(1)
    rows = [(f"k{i}", Vectors.sparse(5, [0, 1, 4], rng.standard_normal(3).tolist())) for i in range(60)]
    vec = spark.createDataFrame(rows, ["key", "features"])
    y = spark.createDataFrame([(k, "a", 1 if v.toArray()[1] + rng.standard_normal() * 0.5 > 0.3 else -1) for k, v in rows], "key string, cat string, y int")
    some = [m for m in models.grid(["LR"]) if m[0] in ("LRC01", "LRC1", "LRC10")]
    one = {(r["key"], r["model_name"]): (r["y"], r["score"]) for r in models.cross_validate(vec, y, "key", some, 3).collect()}
    two = {(r["key"], r["model_name"]): (r["y"], r["score"]) for r in models.cross_validate_logistic(vec, y, "key", some, 3).collect()}
    assert len(two) == 180 and one.keys() == two.keys()
    assert all(two[k][0] == v[0] and abs(two[k][1] - v[1]) < 0.01 for k, v in one.items())


def test_grid_validated_in_blocks(spark, monkeypatch):
    """However many rows there are, no task needs them all: fits over blocks of rows agree with those of one task for each fold."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from textilla.operators import models

    rng = np.random.default_rng(2)
    rows = [(f"k{i}", Vectors.sparse(9, sorted(rng.choice(9, 3, replace=False).tolist()), rng.standard_normal(3).tolist())) for i in range(50)]
    vec = spark.createDataFrame(rows, ["key", "features"]).repartition(3)
    y = [(k, c, 1 if v.toArray()[j] + rng.standard_normal() * 0.3 > 0.1 else -1) for j, c in ((1, "a"), (4, "b")) for k, v in rows]
    y = spark.createDataFrame([r for r in y if r[1] == "a" or r[0] > "k2"] + [(k, "none", -1) for k, _ in rows], "key string, cat string, y int")
    some = [m for m in models.grid(["LR"]) if m[0] in ("LRC001", "LRC1")]
    one = {tuple(r)[:3]: tuple(r)[3:] for r in models.cross_validate_logistic(vec, y, "key", some, 3).collect()}
    for name, value in (("HELD", 10), ("ROWS", 4), ("STATE", 2 * 128 * 10), ("EVALUATED", 30)):
        monkeypatch.setattr(models, name, value)
    held, run = [], models._cross_validate_blocks
    monkeypatch.setattr(models, "_cross_validate_blocks", lambda *a: held.append(1) or run(*a))
    got = models.cross_validate_logistic(vec, y, "key", some, 3)
    two = {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()}
    assert held and got.count() == len(two) and one.keys() == two.keys() and {k[1] for k in two} == {"a", "b"}
    assert all(two[k][0] == v[0] and abs(two[k][1] - v[1]) < 0.005 for k, v in one.items())
    turns = {(r["cat"], r["model_name"]): tuple(r) for r in models.evaluate_models(got, ["a", "b", "none"], some).collect()}
    monkeypatch.undo()
    assert turns == {(r["cat"], r["model_name"]): tuple(r) for r in models.evaluate_models(got, ["a", "b", "none"], some).collect()}
    assert len(turns) == 6 and turns["none", "LRC1"][3:] == (None, None)


def test_sets_scored_whole(spark, data):
    """Scores of whole tables equal those of the operators by pairs; the queries read every document and definition."""
    import random

    from textilla.functions import text as tx
    from textilla.plans import analytic_queries as aq

    rng = random.Random(3)
    words = spark.createDataFrame([(f"w{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)], "word string, vector array<double>")
    pick = lambda n: [f"w{rng.randrange(34)}" for _ in range(n)]
    left = spark.createDataFrame([(i, pick(rng.randrange(1, 9))) for i in range(25)] + [(90, ["no"]), (91, [])], "lid bigint, tokens array<string>")
    right = spark.createDataFrame([(f"r{i}", pick(5)) for i in range(4)] + [("none", ["no", "ni"]), ("empty", [])], "rid string, tokens array<string>")
    got = {(r["lid"], r["rid"]): r for r in embed.score_sets(left, right, words, "word", "vector", 1.0).collect()}
    pairs = embed.kernel(left, right, words, "word", "vector", 1.0)
    score = {(r["lid"], r["rid"]): r["score"] for r in embed.kernel_score(pairs).collect()}
    least = {(r["lid"], r["rid"]): r["d"] for r in embed.row_minima(left, right, words, "word", "vector").collect()}
    assert got.keys() == least.keys() and {k for k, r in got.items() if r["score"] is not None} == score.keys()
    assert all(abs(got[k]["score"] - v) < 1e-9 for k, v in score.items()) and all(abs(got[k]["d"] - v) < 1e-6 for k, v in least.items())
    once = {(r["a"], r["b"]): r["k"] for r in embed.kernel_pairs(left, right, words, "word", "vector", 1.0).collect()}
    assert all(abs(once[r["a"], r["b"]] - r["k"]) < 1e-12 for r in pairs.collect()) and len(once) == pairs.select("a", "b").distinct().count()

    docs = spark.read.parquet(f"{data}/documents.parquet").filter(F.size(tx.words(F.col("text"))) > 0).count()
    defs = spark.read.parquet(f"{data}/taxonomy.parquet").filter("definition IS NOT NULL").count()
    assert docs > 4 and aq.add.queries["w6_documents"](spark, data).count() == docs * defs
    assert aq.add.queries["pr17_documents"](spark, data).select("rid").distinct().count() == defs


def test_no_bounds(spark):
    """Long lists, deep trees, long chains and long words are treated like any others."""
    from textilla.functions import stemmer
    from textilla.operators import grouping, label_tree, metrics

    a, b = [f"x{i}" for i in range(60)], [f"x{i}" for i in range(59, -1, -1)]
    df = spark.createDataFrame([(a, a), (a, b)], "a array<string>, b array<string>")
    same, other = (r[0] for r in df.select(metrics.jrbo_cost("a", "b")).collect())
    small = spark.createDataFrame([(a[:9], a[:9])], "a array<string>, b array<string>").select(metrics.jrbo_cost("a", "b", tabled=3)).first()[0]
    assert abs(same) < 1e-9 and abs(small) < 1e-9 and 0 < other < 0.5
    tree = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)], "cat string, parent string")
    assert label_tree.closure(tree).count() == 40 * 39 // 2
    chain = [(f"k{i:03d}", f"k{i + 1:03d}") for i in range(130)]
    got = grouping.connected_groups(spark.createDataFrame(chain, "i string, j string"))
    assert {r["group_ref"] for r in got.collect()} == {"k000"}
    word = "x" * 30 + "o"
    acc = stemmer.accented(spark.createDataFrame([(word,), ("",)], "token string"), spark.createDataFrame([("x" * 30 + "ó",)], "word string"))
    assert {r["token"]: r["lemma"] for r in acc.collect()} == {word: "x" * 30 + "ó", "": ""}


def test_running_sums(spark):
    from textilla.operators.ranking import running_sums

    rng = random.Random(3)
    rows = [(rng.choice("abc"), i, rng.randrange(9)) for i in range(500)]
    got = {(r["g"], r["i"]): (r["run_v"], r["all_v"]) for r in running_sums(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], [F.col("i").desc()], ["v"]).collect()}
    for g, i, _ in rows:
        own = [v for h, j, v in rows if h == g]
        assert got[g, i] == (sum(v for h, j, v in rows if h == g and j >= i), sum(own))
    assert running_sums(spark.createDataFrame([], "i int, v int"), [], [F.col("i").asc()], ["v"]).count() == 0


def test_near(spark):
    """Blocks, batches and ties give what a full comparison gives; null vectors are nobody's neighbours."""
    from textilla.operators import embed

    rng = random.Random(4)
    vec = {i: [float(rng.randrange(4)), float(rng.randrange(4))] for i in range(300)}
    rows = spark.createDataFrame([(i, v) for i, v in vec.items()] + [(999, None)], "id bigint, v array<double>").repartition(5)
    ask = rows.filter("id % 30 = 0")
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    got = {}
    for r in embed.nearest_of_each(ask, rows, "id", "v", 7).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["id"])
    assert got == {q: [i for _, i in sorted((d(vec[q], v), i) for i, v in vec.items() if i != q)[:7]] for q in vec if q % 30 == 0}
    assert embed.nearest_of_each(ask.limit(0), rows, "id", "v", 7).count() == 0


def test_shapes(spark):
    """Each shape has its own prefix; shapes that are not listed are not compared."""
    from textilla.operators import grouping

    t = "lorem ipsum dolor sit amet " * 3
    rows = [("AAAA2011-00001", t), ("AAAA2011-00002", t), ("AAAA2012-00003", t), ("AAA2011-00001-E", t), ("AAA2011-00002-E", t), ("AAA2011-00001-P", t), ("AAA2011-00002-P", t)]
    got = {(r["i"], r["j"]) for r in grouping.candidate_pairs(spark.createDataFrame(rows, "ref string, text string"), "ref", "text").collect()}
    assert {tuple(sorted(p)) for p in got} == {("AAAA2011-00001", "AAAA2011-00002"), ("AAA2011-00001-E", "AAA2011-00002-E")}


def test_jdbc(spark):
    """S1 on the database that comes with Spark."""
    from textilla.sources import store

    url, driver = "jdbc:derby:memory:textilla;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(5).withColumnRenamed("id", "K").write.jdbc(url, "T1", properties={"driver": driver})
    assert store.open_jdbc(spark, url, "T1", driver).agg(F.sum("K")).first()[0] == 10


def test_cluster_needs_a_folder(monkeypatch):
    from textilla import session

    class Empty:
        isEmpty = staticmethod(lambda: True)

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Empty)}))})
        getConf = staticmethod(lambda: {})

    spark = type("Session", (), {"sparkContext": Context, "conf": {}})
    with pytest.raises(RuntimeError):
        session.shared_dir(spark)


def test_coordinated_whole(spark):
    """Texts compared by cells give what all candidate pairs give, equal texts and large blocks included; band and early end lose nothing."""
    import numpy as np

    from textilla.operators import grouping

    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeé ñ𝒳") for _ in range(rng.randrange(30, 700))) for _ in range(12)]

    def edited(t: str, n: int) -> str:
        x = list(t)
        for _ in range(n):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randrange(2)] = rng.choice(["", "z", "qq"])
        return "".join(x)

    texts = [edited(t, rng.choice([0, 1, 3, 10, 30, 60, 90])) for t in base for _ in range(9)] + ["", "short", "0123456789", "0123456789A"]
    a, b = np.triu_indices(len(texts), 1)
    want = np.array([grouping.indel_ratio(texts[i], texts[j], 0.0) for i, j in zip(a, b)])
    got = grouping.rate(texts, a, b, 0.9)
    assert (want > 0.9).sum() > 50 and np.array_equal(got, np.where(want > 0.9, want, 0.0))

    rows = [(f"QEX2013-{i:05d}-C{i % 2}-1-R", t) for i, t in enumerate([*texts, *texts[:40], None])] + [(f"QEX2014-{i:05d}-C1-1-R", t) for i, t in enumerate(texts[:20])]
    rows += [("QEX2013-00001-C1-1-R", texts[5] + "x"), ("other", texts[0])]
    df = spark.createDataFrame(rows, "ref string, text string")
    old = sorted(tuple(r) for r in grouping.similar_pairs(grouping.candidate_pairs(df, "ref", "text")).collect())
    assert len(old) > 100 and sorted(tuple(r) for r in grouping.coordinated_pairs(df, "ref", "text").collect()) == old
    whole, grouping.CELL = grouping.CELL, 20
    try:
        assert sorted(tuple(r) for r in grouping.coordinated_pairs(df, "ref", "text").collect()) == old
    finally:
        grouping.CELL = whole
    assert grouping.coordinated_pairs(df.limit(0), "ref", "text").count() == 0


def test_word_vectors_in_parts(spark, monkeypatch):
    """A corpus of some size is trained by as many tasks as there are cores, and words of one context are still near each other."""
    rng = random.Random(5)
    rows = [([f"{kind}{rng.randrange(6)}" for _ in range(12)],) for kind in ("a", "b") for _ in range(400)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(4)
    trained, parts = models.Word2Vec, []
    monkeypatch.setattr(models, "Word2Vec", lambda **x: (parts.append(x.get("numPartitions", 1)), trained(**x))[1])
    models.word_vectors(df, dim=8, epochs=1)
    monkeypatch.setattr(models, "TRAINED", 2000)
    got = {r["word"]: r["vector"] for r in models.word_vectors(df, dim=8, epochs=3).collect()}
    assert parts == [1, 4]
    near = [w for w in got if max((y for y in got if y != w), key=lambda y: sum(p * q for p, q in zip(got[w], got[y])))[0] == w[0]]
    assert len(got) == 12 and len(near) >= 10


def test_logistic_by_column():
    """A fit with the matrix ordered by column beforehand, empty rows and columns included, is at its loss's minimum."""
    import numpy as np

    rng = np.random.default_rng(2)
    dense = rng.standard_normal((80, 12)) * (rng.random((80, 12)) < 0.3)
    dense[7], dense[79], dense[:, 4], dense[:, 11] = 0, 0, 0, 0
    row, idx = np.nonzero(dense)
    val, y = dense[row, idx], (dense[:, 1] + 0.5 * rng.standard_normal(80) > 0).astype(np.int8)
    ordered = models.by_column(idx, val, row)
    v = models.fit_logistic(idx, val, row, 12, y, 0.01, columns=ordered)
    assert np.array_equal(v, models.fit_logistic(idx, val, row, 12, y, 0.01)) and v[4] == v[11] == 0
    s, c = np.where(y > 0, 1.0, -1.0), np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
    r = -s * c / (1 + np.exp(s * (dense @ v[:-1] + v[-1])))
    assert np.abs(np.append(dense.T @ r + 0.01 * v[:-1], r.sum())).max() < 2e-4
