"""Queries of scans, sinks, metadata, label transfers and evaluation curves: each does its work on whole tables, files in the shared folder, and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import stemmer
from ..functions import text as tx
from ..operators import grouping, label_tree, metrics, models, sampling, split
from ..session import shared_dir, table
from ..sources import store
from .analytic_queries import _BASE, _J, _NORM, _RBO, _T, _TREE, R6, _marks, _scores, _tree, _truth
from .registry import Registry

add = Registry()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


_WIDE = "SELECT l_orderkey::VARCHAR AS uid, " + ", ".join(f"max(l_discount) FILTER (l_linenumber = {i}) AS c{i}" for i in (1, 2, 3)) + " FROM lineitem GROUP BY 1"


@add("s4_read_directory", "SELECT referencia, coalesce(split_name, '') AS split_name FROM splits")
def s4(spark, d):
    root = _folder(spark)
    store.export(table(spark, d, "splits"), root, "csv", ["referencia", "split_name"], header="true")
    return store.read_directory(spark, root, "csv", "*.csv", header="true").select("referencia", "split_name")


@add("s5_read_predictions", _WIDE)
def s5(spark, d):
    root = _folder(spark)
    wide = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("uid")).agg(*(F.max(F.when(F.col("l_linenumber") == i, F.col("l_discount"))).alias(f"c{i}") for i in (1, 2, 3)))
    store.export(wide, root, "csv", header="true")
    return store.read_predictions(spark, root, ["c1", "c2", "c3"])


@add("s6_read_labels", "SELECT referencia AS wid, marker::VARCHAR AS label FROM labels_info")
def s6(spark, d):
    root = _folder(spark)
    store.label_lines(table(spark, d, "labels_info"), "referencia", F.col("marker")).write.text(root)
    return store.read_labels(spark, root)


_WID = "lower(split_part(url, ',', 1))"
for _a, _b in (("http://", ""), ("//", ""), ("www.", ""), (".", "_"), ("/", "__")):
    _WID = f"replace({_WID}, '{_a}', '{_b}')"


@add("s7_read_urls", f"SELECT DISTINCT {_WID} AS wid FROM labelhistory WHERE url IS NOT NULL AND split_part(url, ',', 1) <> ''")
def s7(spark, d):
    root = _folder(spark)
    table(spark, d, "labelhistory").filter("url IS NOT NULL").select(F.concat("url", F.lit(","), F.coalesce("userid", F.lit(""))).alias("value")).write.text(root)
    return store.read_urls(spark, root).select("wid")


@add("s8_read_saved", "SELECT referencia, split_name FROM splits")
def s8(spark, d):
    """What a version saves is read again."""
    return store.read_saved(spark, store.save_version(table(spark, d, "splits").select("referencia", "split_name"), _folder(spark), "1"))


@add("s9_read_history", "SELECT referencia AS wid, datestr AS tid, url, marker, relabel, label, userid FROM labelhistory WHERE referencia IS NOT NULL AND datestr IS NOT NULL")
def s9(spark, d):
    h = table(spark, d, "labelhistory").filter("referencia IS NOT NULL AND datestr IS NOT NULL")
    record = F.struct("url", "marker", "relabel", "label", F.col("datestr").alias("date"), F.col("userid").alias("userId"))
    text = h.select(F.to_json(F.create_map("referencia", F.create_map("datestr", record))).alias("value"))
    return store.read_history(text).select("wid", "tid", "url", "marker", "relabel", "label", "userid")


@add("s12_save_labels", "SELECT coalesce(n.referencia, o.referencia) AS referencia, CASE WHEN n.referencia IS NOT NULL THEN n.v ELSE o.v END AS v FROM (SELECT referencia, labelstr AS v FROM labels_info) o FULL JOIN (SELECT referencia, split_name AS v FROM splits) n ON o.referencia = n.referencia")
def s12(spark, d):
    old = table(spark, d, "labels_info").select("referencia", F.col("labelstr").alias("v"))
    return store.save_labels({"info": (old, table(spark, d, "splits").select("referencia", F.col("split_name").alias("v")), "referencia")})["info"]


@add("s15_export", "SELECT referencia, marker, weight FROM labels_info")
def s15(spark, d):
    root = _folder(spark)
    store.export(table(spark, d, "labels_info"), root, columns=["referencia", "marker", "weight"])
    return spark.read.parquet(root)


@add("s16_export_bundle", " UNION ALL ".join(f"SELECT '{t}' AS table_name, {n}::BIGINT AS n_columns, count(*) AS n_rows FROM {t}" for t, n in (("labels_info", 7), ("taxonomy", 6))))
def s16(spark, d):
    paths = store.export_bundle({t: table(spark, d, t) for t in ("labels_info", "taxonomy")}, _folder(spark))
    return store.catalog_view({p.rsplit("/", 1)[1]: spark.read.parquet(p) for p in paths})


@add("s19_prediction_files", f"""SELECT 'first' AS file, doc::VARCHAR AS doc, coalesce(labels[1], '') || ';' || coalesce('k' || labels[1], '') AS cells FROM {_T}
UNION ALL SELECT 'categories', doc::VARCHAR, coalesce(labels[1], '') || ';' || coalesce(labels[2], '') || ';' || coalesce(labels[3], '') FROM {_T}
UNION ALL SELECT 'weights', doc::VARCHAR, coalesce(labels[1], '') || ';' || CASE WHEN len(labels) > 0 THEN printf('%4.2f', 1.0 / len(labels)) ELSE '' END FROM {_T}""")
def s19(spark, d):
    tax = spark.range(1, 8).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("reference"), F.concat(F.lit("kc"), F.col("id").cast("string")).alias("code"))
    lists = _truth(spark, d).withColumn("values", F.transform("labels", lambda _: 1.0 / F.size("labels")))
    paths = store.export_predictions(lists, _folder(spark), "doc", "labels", "values", tax, 3)
    cells = {"first": ["cat_0", "code"], "categories": ["Cat_0", "Cat_1", "Cat_2"], "weights": ["Cat_0", "Peso_0"]}
    parts = (spark.read.csv(paths[f], header=True).select(F.lit(f).alias("file"), "doc", F.concat_ws(";", *(F.coalesce(F.col(c), F.lit("")) for c in names)).alias("cells")) for f, names in cells.items())
    return store.union_all(parts)


@add("s20_prediction_report", f"SELECT doc, rpad(doc::VARCHAR, 24, ' ') || rpad(array_to_string(labels, ', '), 24, ' ') || array_to_string(list_transform(labels, lambda c: c || ' (' || substr((1.0::DOUBLE / len(labels))::VARCHAR, 1, 5) || ')'), ', ') AS line FROM {_T}")
def s20(spark, d):
    lists = _truth(spark, d).withColumn("w", F.transform("labels", lambda _: 1.0 / F.size("labels")))
    return store.prediction_report(lists, "doc", "labels", "labels", "w")


# Metadata


@add("r1_table_names", "SELECT unnest(['textilla_r1_splits', 'textilla_r1_taxonomy']) AS name")
def r1(spark, d):
    for t in ("splits", "taxonomy"):
        table(spark, d, t).createOrReplaceTempView(f"textilla_r1_{t}")
    return spark.createDataFrame([(n,) for n in store.table_names(spark) if n.startswith("textilla_r1_")], "name string")


@add("r2_column_names", "SELECT column_name AS name FROM information_schema.columns WHERE table_name = 'proyectos'")
def r2(spark, d):
    table(spark, d, "proyectos").createOrReplaceTempView("textilla_r2")
    return spark.createDataFrame([(n,) for n in store.column_names(spark, "textilla_r2")], "name string")


@add("r3_table_info", "SELECT 8::BIGINT AS n_columns, count(*) AS n_rows FROM proyectos")
def r3(spark, d):
    columns, rows = store.table_info(table(spark, d, "proyectos"))
    return spark.createDataFrame([(len(columns), rows)], "n_columns bigint, n_rows bigint")


@add("r4_reset_table", "SELECT referencia, split_name FROM splits")
def r4(spark, d):
    store.reset_table(spark, "textilla_r4", "referencia string, split_name string", _folder(spark))
    table(spark, d, "splits").select("referencia", "split_name").write.insertInto("textilla_r4")
    return spark.table("textilla_r4")


@add("r5_columns", "SELECT referencia, split_name, NULL::VARCHAR AS note FROM splits")
def r5(spark, d):
    return store.drop_column(store.add_column(table(spark, d, "splits"), "note", "string"), "assigned_ts")


@add("r10_sample_row", "SELECT c_custkey, c_name FROM customer ORDER BY ((c_custkey + 3) * 2654435761) % 4294967296, c_custkey LIMIT 1")
def r10(spark, d):
    """The row that a hash any engine can repeat draws."""
    return store.sample_row(table(spark, d, "customer"), "c_custkey", order=split.arithmetic_hash(F.col("c_custkey"), 3)).select("c_custkey", "c_name")


@add("m5_group_split", """WITH g AS (SELECT DISTINCT c_nationkey AS g, (c_nationkey * 2654435761) % 4294967296 AS h FROM customer), r AS (SELECT g, row_number() OVER (ORDER BY h, g) <= floor(count(*) OVER () * 0.8) AS is_train FROM g)
SELECT is_train, count(DISTINCT c_nationkey) AS groups, count(*) AS n FROM customer JOIN r ON c_nationkey = g GROUP BY 1""")
def m5(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    got = split.group_split(c, "c_nationkey", hashed=lambda g: split.arithmetic_hash(g.cast("bigint")) * (1 << 31))
    return got.groupBy("is_train").agg(F.count_distinct("c_nationkey").alias("groups"), F.count("*").alias("n"))


# Text


@add("t5_accented", """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(titulo), '\\p{L}+')) AS word FROM proyectos), t AS (SELECT DISTINCT translate(word, 'áéíóú', 'aeiou') AS token FROM w),
c AS (SELECT token, 0 AS pos, token AS word FROM t UNION ALL SELECT token, i, substr(token, 1, i - 1) || translate(substr(token, i, 1), 'aeiou', 'áéíóú') || substr(token, i + 1) FROM (SELECT token, unnest(generate_series(1, len(token))) AS i FROM t))
SELECT token, coalesce(arg_min(w.word, pos), token) AS lemma FROM c LEFT JOIN w USING (word) GROUP BY 1""".replace("arg_min(w.word, pos)", "arg_min(CASE WHEN w.word IS NOT NULL THEN c.word END, CASE WHEN w.word IS NOT NULL THEN pos END)"))
def t5(spark, d):
    """Words of all titles without their accents, and the same words as the dictionary."""
    words = table(spark, d, "proyectos").select(F.explode(F.regexp_extract_all(F.lower("titulo"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return stemmer.accented(words.select(F.translate("word", "áéíóú", "aeiou").alias("token")), words)


def _stop(k: str) -> str:
    return f"len(list_filter(w, lambda x: list_contains({tx.STOP[k].split()}, x)))"


@add("t1_detect_language", "SELECT referencia, CASE WHEN resumen IS NOT NULL THEN list_reverse_sort([" + ", ".join(f"{{'n': {_stop(k)}, 'o': {-i}, 'k': '{k}'}}" for i, k in enumerate(tx.STOP)) + r"])[1].k END AS lang FROM (SELECT referencia, resumen, regexp_extract_all(lower(resumen), '\p{L}+') AS w FROM proyectos)")
def t1(spark, d):
    return table(spark, d, "proyectos").select("referencia", tx.detect_language(F.col("resumen")).alias("lang"))


# Groups

_CHAIN = "(SELECT s_suppkey AS i, s_suppkey + k AS j FROM supplier, (SELECT unnest([1, 3]) AS k) WHERE s_suppkey % 5 < 3)"
_LISTS = f"(SELECT DISTINCT list_sort(list_distinct(list_append(list(lpad(j::VARCHAR, 9, '0')), lpad(i::VARCHAR, 9, '0')))) AS m FROM {_CHAIN} GROUP BY i)"


@add("g4_consolidate", f"WITH l AS {_LISTS}, h AS (SELECT m, unnest(m) AS x FROM l), z AS (SELECT x, max(m) AS last FROM h GROUP BY 1), b AS (SELECT m, max(last) AS last FROM h JOIN z USING (x) GROUP BY 1) SELECT DISTINCT array_to_string(list_sort(list_distinct(list_concat(m, last))), '|') AS members FROM b")
def g4(spark, d):
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    pairs = table(spark, d, "supplier").filter("s_suppkey % 5 < 3").select(F.col("s_suppkey").alias("i"), F.explode(F.array(F.col("s_suppkey") + 1, F.col("s_suppkey") + 3)).alias("j"))
    return grouping.consolidate(grouping.lists(pairs.select(name(F.col("i")).alias("i"), name(F.col("j")).alias("j")))).select(F.array_join("members", "|").alias("members"))


_SHAPED = "(SELECT referencia, trim(coalesce(resumen, '')) AS t, len(trim(replace(coalesce(resumen, ''), chr(13) || chr(10), chr(10)), ' ')) AS n, array_to_string(list_transform(generate_series(1, len(referencia)), lambda i: CASE WHEN regexp_matches(referencia[i], '\\p{L}') THEN CASE WHEN i > 1 AND referencia[i - 1] = '-' THEN referencia[i] ELSE 'a' END WHEN regexp_matches(referencia[i], '\\p{N}') THEN '0' WHEN referencia[i] = '-' THEN '-' ELSE '?' END), '') AS shape FROM proyectos)"
_PREFIXES = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in grouping.COMPARED.items()) + ") p(shape, size)"


@add("g2_candidates", f"WITH s AS (SELECT referencia, n, shape, substr(referencia, 1, size) AS pre FROM {_SHAPED} JOIN {_PREFIXES} USING (shape)) SELECT a.referencia AS i, b.referencia AS j FROM s a JOIN s b ON a.shape = b.shape AND a.pre = b.pre AND a.referencia <> b.referencia AND a.n > 10 AND abs(a.n - b.n) < 50")
def g2c(spark, d):
    """The pairs that the theta join lets through, before their ratio."""
    return grouping.candidate_pairs(table(spark, d, "proyectos"), "referencia", "resumen").select("i", "j")


# Models and curves


@add("m3_balanced", "SELECT c_custkey, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY c_acctbal > 0)), 6) AS w FROM customer")
def m3(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).cast("double").alias("label"))
    return models.balanced(c).select("c_custkey", R6("w").alias("w"))


@add("e16_mean_auc", "SELECT avg(auc) AS mean_auc FROM (SELECT n_regionkey, arg_max(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey / 100.0 END::DOUBLE, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey / 100.0 END, 0)) AS auc FROM nation GROUP BY 1)")
def e16(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("cat"), F.col("n_name").alias("model_name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") / 100.0).alias("auc"), F.col("n_nationkey").alias("grid_pos"))
    return models.mean_auc(models.best_models(n))


_TH25 = f"(SELECT unnest({[float(t) for t in metrics.THRESHOLDS]}::DOUBLE[]) AS threshold)"


def _sweep(part: str = "") -> str:
    """Mean cost and gap for each threshold over the documents that ``part`` selects."""
    return f"""(SELECT threshold, avg(cost) AS cost, pow(avg(np) - avg(len(labels)), 2) AS gap FROM (SELECT *, CASE WHEN np = 0 THEN 0.5 ELSE (0.9 * (1 - {_J}) + 0.1 * (1 - {_RBO} / {_BASE})) / 2 END AS cost FROM
(SELECT threshold, labels, pred, coalesce(len(pred), 0) AS np, least(len(labels), coalesce(len(pred), 0)) AS k FROM (SELECT t.doc, threshold, any_value(labels) AS labels, list(n.cat ORDER BY q DESC, n.cat) FILTER (q >= threshold) AS pred FROM {_T} t JOIN {_NORM} n USING (doc), {_TH25} {part} GROUP BY 1, 2))) GROUP BY 1)"""


@add("e13_threshold_costs", f"SELECT threshold, round(cost, 6) AS cost, round(gap, 6) AS gap FROM {_sweep()}")
def e13(spark, d):
    return metrics.threshold_costs(_scores(spark, d), _truth(spark, d), "doc").select("threshold", R6("cost").alias("cost"), R6("gap").alias("gap"))


_CHOSEN = "SELECT round((arg_min(threshold, (round(cost, 6), -threshold)) + arg_min(threshold, (round(gap, 6), -threshold))) / 2, 6) AS threshold"


def _train_threshold(spark: SparkSession, d: str) -> DataFrame:
    costs = metrics.threshold_costs(_scores(spark, d).filter("doc % 2 = 0"), _truth(spark, d), "doc")
    return metrics.choose_threshold(costs.select("threshold", R6("cost").alias("cost"), R6("gap").alias("gap")))


@add("e13_choose_threshold", f"{_CHOSEN} FROM {_sweep('WHERE t.doc % 2 = 0')}")
def e13c(spark, d):
    """The threshold of the even documents, which are the training side."""
    return _train_threshold(spark, d).select(R6("threshold").alias("threshold"))


@add("e14_test_curve", f"WITH c AS ({_CHOSEN} FROM {_sweep('WHERE t.doc % 2 = 0')}), s AS (SELECT * FROM {_sweep('WHERE t.doc % 2 = 1')}) SELECT s.threshold, round(cost, 6) AS cost, round(gap, 6) AS gap, row_number() OVER (ORDER BY round(abs(s.threshold - c.threshold), 9), -s.threshold) = 1 AS nearest FROM s, c")
def e14(spark, d):
    """The sweep on the odd documents, the test side, with the grid point next to the chosen threshold."""
    costs = metrics.threshold_costs(_scores(spark, d).filter("doc % 2 = 1"), _truth(spark, d), "doc")
    return metrics.nearest_point(costs, _train_threshold(spark, d)).select("threshold", R6("cost").alias("cost"), R6("gap").alias("gap"), "nearest")


_LI = "(SELECT weight AS score, CASE WHEN relabel > 0 THEN 1 ELSE -1 END AS y, marker, coalesce(weight, 0) AS wt FROM labels_info WHERE weight IS NOT NULL{})"
_CURVE = "SELECT thr, round(sum(p) OVER w, 6) AS nfn, round(sum(n) OVER w, 6) AS ntn, round(sum(n) OVER () - sum(n) OVER w, 6) AS nfp, round(sum(p) OVER () - sum(p) OVER w, 6) AS ntp FROM (SELECT score AS thr, sum(CASE WHEN y > 0 THEN {w} ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y < 0 THEN {w} ELSE 0 END)::DOUBLE AS n FROM {src} GROUP BY 1) WINDOW w AS (ORDER BY thr)"


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels_info").select(F.col("weight").alias("score"), F.when(F.col("relabel") > 0, 1).otherwise(-1).alias("y"), "marker", F.coalesce("weight", F.lit(0.0)).alias("wt"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("thr", *(R6(c).alias(c) for c in ("nfn", "ntn", "nfp", "ntp")))


@add("e17_marked", _CURVE.format(w="1.0", src=_LI.format(" AND marker = 0")))
def e17m(spark, d):
    return _rounded(metrics.marked_curve(_rated(spark, d), "score", "y"))


@add("e17_by_weight", _CURVE.format(w="wt", src=_LI.format("")))
def e17w(spark, d):
    return _rounded(metrics.weighted_curve(_rated(spark, d), "score", "y", F.col("wt")))


# Label transfers

_M = "(SELECT s_suppkey AS key, n_name AS cat, CASE WHEN s_acctbal > 0 THEN 1 ELSE -1 END * CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_UPDATED = f"SELECT m.key, t.cat, CASE WHEN m.y > 0 AND (t.cat = m.cat OR t.cat = p.parent) THEN 1 WHEN m.y < 0 AND t.cat = m.cat THEN -1 ELSE 0 END::INT AS y FROM {_M} m JOIN {_TREE} t ON true JOIN {_TREE} p ON p.cat = m.cat"


def _changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = _marks(spark, d)
    return old, old.withColumn("y", F.col("y") * F.when(F.col("key") % 2 == 0, -1).otherwise(0))


@add("l3_update", _UPDATED)
def l3(spark, d):
    return label_tree.update(*_changed(spark, d), _tree(spark, d))


@add("l5_transfer_labels", f"SELECT key, cat, y, CASE WHEN key % 2 = 0 THEN 'new' ELSE s_name END AS note FROM ({_UPDATED}) JOIN supplier ON s_suppkey = key")
def l5(spark, d):
    info = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("note"))
    old, new = _changed(spark, d)
    got, labels = label_tree.transfer_labels(info, info.filter("key % 2 = 0").withColumn("note", F.lit("new")), old, new, _tree(spark, d))
    return labels.join(got, "key").select("key", "cat", "y", "note")


_CLEAN = "list_filter(list_transform(string_split(labelstr, '++'), lambda x: trim(x)), lambda x: x <> '' AND NOT suffix(x, '_'))"
_UNIQUE = f"(SELECT referencia, list_transform(list_filter(generate_series(1, len(l)), lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS l FROM (SELECT referencia, {_CLEAN} AS l FROM labels_info WHERE labelstr IS NOT NULL))"


@add("l6_rank_labels", f"""WITH c AS (SELECT referencia AS key, l FROM {_UNIQUE}), p AS (SELECT key, unnest(l) AS cat, generate_subscripts(l, 1) AS pos FROM c),
k AS (SELECT key, cat, pos, row_number() OVER (PARTITION BY key ORDER BY pos) AS r FROM p JOIN taxonomy ON reference = cat),
b AS (SELECT key, cat, r, 0 AS o FROM k UNION ALL SELECT key, parent, 1, 1 FROM k JOIN taxonomy ON reference = cat WHERE parent IS NOT NULL), y AS (SELECT key, cat, arg_min(r, o) AS r FROM b GROUP BY 1, 2)
SELECT c.key, reference AS cat, coalesce(r, -1)::INT AS y, coalesce(s, '') AS labelstr FROM c JOIN taxonomy ON true LEFT JOIN y ON y.key = c.key AND y.cat = reference LEFT JOIN (SELECT key, string_agg(cat, '++' ORDER BY pos) AS s FROM k GROUP BY 1) z ON z.key = c.key""")
def l6(spark, d):
    t = table(spark, d, "taxonomy").select(F.col("reference").alias("cat"), "parent")
    h = table(spark, d, "labels_info").select(F.col("referencia").alias("key"), tx.clean_labels(F.col("labelstr"), "++").alias("labels")).filter("labels IS NOT NULL")
    return label_tree.rank_labels(h, t)


@add("l7_weights", "SELECT referencia, coalesce(CASE WHEN marker = 1 THEN weight * 2 END, weight) AS weight FROM labels_info")
def l7(spark, d):
    i = table(spark, d, "labels_info").select("referencia", "marker", "weight")
    return label_tree.transfer_weights(i, i.filter("marker = 1").withColumn("weight", F.col("weight") * 2), "referencia").select("referencia", "weight")


@add("l7_history", "SELECT referencia, datestr, label FROM labelhistory UNION ALL SELECT referencia, strftime(assigned_ts::TIMESTAMP, '%Y%m%d%H%M%S%f'), split_name FROM splits")
def l7h(spark, d):
    events = table(spark, d, "splits").select("referencia", F.col("split_name").alias("label"), F.col("assigned_ts").alias("at"))
    return label_tree.append_history(table(spark, d, "labelhistory").select("referencia", "datestr", "label"), events, "at")


_YES = "(SELECT l_orderkey AS key, 'c' || l_linenumber AS cat, max(l_discount) >= 0.05 AS yes FROM lineitem GROUP BY 1, 2)"


def _discounted(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("cat"))
    return cells.agg(F.max(F.when(F.col("l_discount") >= 0.05, 1).otherwise(-1)).alias("y"))


@add("l9_conflicts", f"SELECT o.key, o.cat, coalesce(had, '') AS old_yes FROM {_YES} o LEFT JOIN (SELECT key, string_agg(cat, '|' ORDER BY cat) AS had FROM {_YES} WHERE yes GROUP BY 1) y USING (key) WHERE NOT o.yes")
def l9(spark, d):
    old = _discounted(spark, d)
    return label_tree.conflicts(old, old.withColumn("y", F.lit(1))).select("key", "cat", F.array_join("old_yes", "|").alias("old_yes"))


@add("l10_maps", "SELECT l_orderkey AS key, 'c' || l_linenumber AS cat, max(CASE WHEN l_discount >= 0.05 THEN 1 ELSE -1 END)::INT AS y FROM lineitem GROUP BY 1, 2")
def l10(spark, d):
    """To maps and back."""
    return label_tree.from_map(label_tree.to_map(_discounted(spark, d)))


_L4 = "(SELECT referencia, referencia AS url, weight AS p FROM labels_info WHERE marker = 0)", "(SELECT referencia, weight * 2 AS p FROM labels_info WHERE relabel = 0)"


def _transfer(spark: SparkSession, d: str, mode: str) -> DataFrame:
    i = table(spark, d, "labels_info")
    old = i.filter("marker = 0").select("referencia", F.col("referencia").alias("url"), F.col("weight").alias("p"))
    new = i.filter("relabel = 0").select("referencia", F.lit(None).cast("string").alias("url"), (F.col("weight") * 2).alias("p"))
    return label_tree.transfer_predictions(old, new, "referencia", mode)


@add("l4_contract", f"SELECT referencia, o.url, coalesce(n.p, o.p) AS p FROM {_L4[0]} o JOIN {_L4[1]} n USING (referencia)")
def l4c(spark, d):
    return _transfer(spark, d, "contract")


@add("l4_update", f"SELECT referencia, o.url, coalesce(n.p, o.p) AS p FROM {_L4[0]} o LEFT JOIN {_L4[1]} n USING (referencia)")
def l4u(spark, d):
    return _transfer(spark, d, "update")


# Samples


@add("q7_single", "SELECT referencia, marker, 1 AS relabel FROM labels_info WHERE referencia = (SELECT min(referencia) FROM labels_info) AND marker IS NOT NULL")
def q7(spark, d):
    i = table(spark, d, "labels_info")
    return sampling.single(i, "referencia", i.agg(F.min("referencia")).first()[0]).select("referencia", "marker", "relabel")
