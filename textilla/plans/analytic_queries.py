"""Queries of TF-IDF, grouping, decisions, metrics, embeddings, label trees, samples and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import stemmer, tfidf
from ..functions import text as tx
from ..operators import decide, embed, grouping, label_tree, metrics, models, sampling, split
from ..operators.ranking import global_rank
from ..session import cut, kept, sent, table
from .registry import Registry

add = Registry()
R6 = lambda c: F.round(c, 6)

# Scores and true labels that any engine makes alike: (doc, cat, p) and (doc, labels)
_S = "(SELECT l_orderkey AS doc, 'c' || l_linenumber AS cat, round(max(l_discount) * 20 - 1, 6) AS p FROM lineitem GROUP BY 1, 2)"
_T = "(SELECT doc, list(cat ORDER BY q DESC, cat) AS labels FROM (SELECT l_orderkey AS doc, 'c' || l_linenumber AS cat, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) WHERE q >= 25 GROUP BY 1)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("cat")).agg(R6(F.max("l_discount") * 20 - 1).alias("p"))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("cat")).agg(F.max("l_quantity").alias("q")).filter("q >= 25")
    return q.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct((-F.col("q")).alias("q"), "cat"))).alias("x")).select("doc", F.col("x.cat").alias("labels"))


# TF-IDF and category scores

_TF = f"c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{tx.WORD}')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2)"
_IDF = "v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1 HAVING count(*) >= 2)"


@add("t9_tfidf", f"WITH {_TF}, {_IDF}, w AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN v USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT doc_id, count(*) AS n_terms, round(sum(w / norm), 6) AS mass, round(max(w / norm), 6) AS top FROM w JOIN n USING (doc_id) GROUP BY 1")
def t9(spark, d):
    w = tfidf.tfidf(table(spark, d, "documents"), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count("*").alias("n_terms"), R6(F.sum("w")).alias("mass"), R6(F.max("w")).alias("top"))


@add("t9_weights", f"WITH {_TF}, {_IDF}, w AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN v USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT doc_id, term, round(w / norm, 6) AS w FROM w JOIN n USING (doc_id)")
def t9w(spark, d):
    return tfidf.tfidf(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", R6("w").alias("w"))


@add("t9_index", f"WITH {_TF}, {_IDF} SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM v")
def t9i(spark, d):
    docs = table(spark, d, "documents")
    return tfidf.index(tfidf.fit(tfidf.term_counts(docs, "doc_id", "text"), docs.count()))


_DEF = f"dc AS (SELECT reference, term, count(*) AS tf FROM (SELECT reference, unnest(regexp_extract_all(lower(definition), '{tx.WORD}')) AS term FROM taxonomy WHERE definition IS NOT NULL) GROUP BY 1, 2), dv AS (SELECT term, ln((1.0 + (SELECT count(*) FROM taxonomy WHERE definition IS NOT NULL)) / (1 + count(*))) + 1 AS idf FROM dc GROUP BY 1 HAVING count(*) >= 1), dw AS (SELECT reference, term, tf * idf AS w FROM dc JOIN dv USING (term)), dn AS (SELECT reference, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1), wt AS (SELECT reference, term, w / norm AS w FROM dw JOIN dn USING (reference))"


@add("pr15_definitions", f"WITH {_DEF} SELECT reference, term, round(w, 6) AS w FROM wt")
def p15(spark, d):
    return tfidf.definition_weights(table(spark, d, "taxonomy"), "reference", "definition", 1).select("reference", "term", R6("w").alias("w"))


_P16 = f"WITH {_DEF}, tot AS (SELECT reference, sum(w) AS total FROM wt GROUP BY 1), {_TF}, s AS (SELECT doc_id, reference, sum(tf * w) AS s FROM c JOIN wt USING (term) GROUP BY 1, 2) SELECT doc_id, reference, round(s / total, 6) AS p FROM s JOIN tot USING (reference)"


def _category_scores(spark: SparkSession, d: str) -> DataFrame:
    w = tfidf.definition_weights(table(spark, d, "taxonomy"), "reference", "definition", 1)
    return tfidf.category_scores(table(spark, d, "documents"), "doc_id", "text", w, "reference")


@add("pr16_category_scores", _P16)
def p16(spark, d):
    return _category_scores(spark, d).select("doc_id", "reference", R6("p").alias("p"))


_BEST = "SELECT doc_id, string_agg(reference, '+' ORDER BY q DESC, reference) AS labels FROM (SELECT doc_id, reference, CASE WHEN max(p) OVER (PARTITION BY doc_id) > 0 THEN round(p / max(p) OVER (PARTITION BY doc_id), 6) ELSE p END AS q FROM ({})) WHERE q > 0.9 GROUP BY 1"


@add("flagship_labels", _BEST.format(_P16))
def flagship(spark, d):
    """Every document's ordered labels by the words of the category definitions."""
    s = _category_scores(spark, d).select("doc_id", F.col("reference").alias("cat"), R6("p").alias("p"))
    top = F.max("p").over(decide._doc("doc_id"))
    q = s.withColumn("q", F.when(top > 0, R6(F.col("p") / top)).otherwise(F.col("p"))).filter("q > 0.9")
    return decide.ordered(q, "doc_id", "q").select("doc_id", F.array_join("labels", "+").alias("labels"))


@add("pr6_fixed_vocabulary", f"WITH {_TF}, tr AS (SELECT * FROM c WHERE doc_id % 2 = 0), v AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents WHERE doc_id % 2 = 0)) / (1 + count(*))) + 1 AS idf FROM tr GROUP BY 1 HAVING count(*) >= 2), w AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN v USING (term) WHERE doc_id % 2 = 1), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT doc_id, count(*) AS n_terms, round(sum(w / norm), 6) AS mass FROM w JOIN n USING (doc_id) GROUP BY 1")
def p6v(spark, d):
    """The even documents are the training side, the odd ones are new: a split, not a sample."""
    docs = table(spark, d, "documents")
    train, new = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    vocab = tfidf.fit(tfidf.term_counts(train, "doc_id", "text"), train.count())
    w = tfidf.transform(tfidf.term_counts(new, "doc_id", "text"), "doc_id", vocab)
    return w.groupBy("doc_id").agg(F.count("*").alias("n_terms"), R6(F.sum("w")).alias("mass"))


@add("t4_stems")
def t4(spark, d):
    words = table(spark, d, "proyectos").select(F.explode(tx.words(F.col("titulo"))).alias("token"))
    return stemmer.stems(words)


@add("t8b_lemmas")
def t8b(spark, d):
    return stemmer.lemmatise(table(spark, d, "proyectos").filter("resumen IS NOT NULL"), "referencia", "resumen", tx.STOP["es"].split())


@add("m12_sentences", "SELECT array_to_string(list_filter(string_split(line, ' '), lambda x: x <> ''), ' ') AS tokens FROM (SELECT unnest(string_split(lower(concat_ws(chr(10), titulo, resumen)), chr(10))) AS line FROM proyectos) WHERE len(list_filter(string_split(line, ' '), lambda x: x <> '')) > 0")
def m12(spark, d):
    return tfidf.chunk_sentences(table(spark, d, "proyectos"), "titulo", "resumen").select(F.array_join("tokens", " ").alias("tokens"))


# Groups


@add("g1_shape", r"SELECT referencia, array_to_string(list_transform(generate_series(1, len(referencia)), lambda i: CASE WHEN regexp_matches(referencia[i], '\p{L}') THEN CASE WHEN i > 1 AND referencia[i - 1] = '-' THEN referencia[i] ELSE 'a' END WHEN regexp_matches(referencia[i], '\p{N}') THEN '0' WHEN referencia[i] = '-' THEN '-' ELSE '?' END), '') AS shape FROM proyectos")
def g1(spark, d):
    return table(spark, d, "proyectos").select("referencia", grouping.shape(F.col("referencia")).alias("shape"))


def _coordinated(spark: SparkSession, d: str) -> DataFrame:
    return grouping.coordinated_pairs(table(spark, d, "proyectos"), "referencia", "resumen")


@add("g2_similar_pairs")
def g2(spark, d):
    return _coordinated(spark, d)


@add("g6_representatives")
def g6(spark, d):
    return grouping.representatives(grouping.consolidate(grouping.lists(_coordinated(spark, d))))


@add("g7_assign")
def g7(spark, d):
    return grouping.assign(table(spark, d, "proyectos"), "referencia", grouping.connected_groups(_coordinated(spark, d)))


_PRE = "(SELECT nation.n_name AS i, n2.n_name AS j FROM nation JOIN nation n2 ON nation.n_regionkey = n2.n_regionkey AND nation.n_name <> n2.n_name)"


@add("g3_lists", f"SELECT DISTINCT array_to_string(list_sort(list_append(list(j), i)), '|') AS members FROM {_PRE} GROUP BY i")
def g3(spark, d):
    n = table(spark, d, "nation")
    pairs = n.select(F.col("n_name").alias("i"), "n_regionkey").join(n.select(F.col("n_name").alias("j"), "n_regionkey"), "n_regionkey").filter("i != j")
    return grouping.lists(pairs).select(F.array_join("members", "|").alias("members"))


@add("g5_year", r"SELECT referencia, regexp_extract(referencia, '(\d.{3})', 1)::INT AS year FROM proyectos WHERE regexp_matches(referencia, '^[^0-9]*\d{4}')")
def g5(spark, d):
    return table(spark, d, "proyectos").filter(F.col("referencia").rlike(r"^[^0-9]*\d{4}")).select("referencia", grouping.year_of(F.col("referencia")).alias("year"))


# Splits


@add("m6_folds", "SELECT c_nationkey, ((c_custkey * 2654435761) % 4294967296 % 10)::INT AS fold, count(*) FILTER (c_acctbal > 0) AS positives FROM customer GROUP BY 1, 2")
def m6(spark, d):
    c = table(spark, d, "customer").withColumn("fold", F.pmod(split.arithmetic_hash(F.col("c_custkey")), F.lit(10)).cast("int"))
    return split.fold_counts(c, "c_nationkey", "c_acctbal")


@add("m7_sample_weight", f"SELECT doc, round(1.0 / greatest(len(labels), 1), 6) AS w FROM {_T}")
def m7(spark, d):
    return _truth(spark, d).select("doc", R6(split.sample_weight(F.col("labels"))).alias("w"))


# Decisions

_TH = "(SELECT 'c' || r AS cat, r / 10.0 AS threshold FROM generate_series(1, 7) t(r))"


@add("pr1_thresholds", f"SELECT doc, cat, round(p - threshold::DOUBLE, 6) AS diff FROM {_S} JOIN {_TH} USING (cat) WHERE p > threshold")
def p1(spark, d):
    th = spark.range(1, 8).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("cat"), (F.col("id") / 10.0).alias("threshold"))
    return decide.above(_scores(spark, d), th).select("doc", "cat", R6("diff").alias("diff"))


_KEPT = f"(SELECT doc, cat, p FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY p DESC, cat) AS r, max(p) OVER (PARTITION BY doc) AS m FROM {_S}) WHERE p > 0 OR (m <= 0 AND r = 1))"


@add("pr2_keep_or_best", f"SELECT * FROM {_KEPT}")
def p2(spark, d):
    return decide.keep_or_best(_scores(spark, d), "doc")


_NORM = f"(SELECT doc, cat, p / nullif(max(p) OVER (PARTITION BY doc), 0) AS q FROM {_KEPT})"


@add("pr3_normalise", f"SELECT doc, cat, round(q, 6) AS q FROM {_NORM}")
def p3(spark, d):
    return decide.normalise(decide.keep_or_best(_scores(spark, d), "doc"), "doc").select("doc", "cat", R6("q").alias("q"))


@add("pr4_decide", f"SELECT doc, string_agg(cat, '+' ORDER BY q DESC, cat) AS labels FROM {_NORM} WHERE q >= 0.5 GROUP BY 1")
def p4(spark, d):
    return decide.decide(_scores(spark, d), "doc").select("doc", F.array_join("labels", "+").alias("labels"))


@add("pr5_raw", f"SELECT doc, string_agg(cat, '+' ORDER BY p DESC, cat) AS labels FROM {_S} GROUP BY 1")
def p5(spark, d):
    return decide.ordered(_scores(spark, d), "doc", "p").select("doc", F.array_join("labels", "+").alias("labels"))


_P8 = f"(SELECT doc, cat, CASE WHEN m > 0 THEN p / m ELSE p END AS q FROM (SELECT *, max(p) OVER (PARTITION BY doc) AS m FROM {_S}))"


@add("pr8_labels", f"SELECT doc, string_agg(cat, '+' ORDER BY q DESC, cat) AS labels FROM {_P8} WHERE q > 0.3 GROUP BY 1")
def p8(spark, d):
    return decide.labels_from_scores(_scores(spark, d), "doc", 0.3).select("doc", F.array_join("labels", "+").alias("labels"))


@add("pr7_blank", "SELECT referencia, CASE WHEN resumen_lang = 'es' THEN 'x' ELSE '' END AS labels FROM proyectos")
def p7(spark, d):
    p = table(spark, d, "proyectos").select("referencia", "resumen_lang", F.array(F.lit("x")).alias("l"), F.array(F.lit(1.0)).alias("v"))
    return decide.blank_other_language(p, "resumen_lang", "l", "v").select("referencia", F.array_join("l", "").alias("labels"))


@add("pr9_weights", f"SELECT doc, cat, round((p + 1) / 2 * 100 / nullif(sum((p + 1) / 2) OVER (PARTITION BY doc), 0), 6) AS share FROM {_S}")
def p9(spark, d):
    return decide.weight_shares(_scores(spark, d), "doc").select("doc", "cat", R6("share").alias("share"))


@add("pr10_spread", f"SELECT doc, coalesce(labels[1], '') AS \"Cat_0\", coalesce(labels[2], '') AS \"Cat_1\", coalesce(labels[3], '') AS \"Cat_2\" FROM {_T}")
def p10(spark, d):
    return decide.spread(_truth(spark, d), "doc", "labels", 3)


@add("pr11_first_code", f"SELECT doc, coalesce(labels[1], '') AS cat_0, coalesce('k' || labels[1], '') AS code FROM {_T}")
def p11(spark, d):
    tax = spark.range(1, 8).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("reference"), F.concat(F.lit("kc"), F.col("id").cast("string")).alias("code"))
    return decide.first_code(_truth(spark, d), "doc", "labels", tax)


@add("pr12_prediction_weights", f"SELECT doc, string_agg(round(p / s, 6)::VARCHAR, '|' ORDER BY p DESC, cat) AS weights FROM (SELECT doc, cat, p, sum(p) OVER (PARTITION BY doc) AS s FROM {_S} WHERE p > 0) GROUP BY 1")
def p12(spark, d):
    o = decide.ordered(_scores(spark, d).filter("p > 0"), "doc", "p")
    return o.select("doc", F.array_join(F.transform(decide.prediction_weights(o, "values"), lambda x: R6(x).cast("string")), "|").alias("weights"))


@add("pr13_persist", f"SELECT doc, string_agg(cat, '+' ORDER BY p DESC, cat) AS classif, '[' || string_agg(p::VARCHAR, ', ' ORDER BY p DESC, cat) || ']' AS weights FROM {_S} GROUP BY 1")
def p13(spark, d):
    return decide.persist_form(decide.ordered(_scores(spark, d), "doc", "p"), "doc", "labels", "values").select("doc", "classif", "weights")


# Metrics

_Y = f"(SELECT s.doc, s.cat, s.p AS score, CASE WHEN list_contains(t.labels, s.cat) THEN 1 ELSE -1 END AS y FROM {_S} s JOIN {_T} t USING (doc))"
_ROC = f"per AS (SELECT cat, score AS thr, count(*) FILTER (y > 0) AS p, count(*) FILTER (y < 0) AS n FROM {_Y} GROUP BY 1, 2 UNION ALL SELECT cat, max(score) + 1, 0, 0 FROM {_Y} GROUP BY 1), r AS (SELECT cat, thr, sum(p) OVER w / sum(p) OVER (PARTITION BY cat) AS tpr, sum(n) OVER w / sum(n) OVER (PARTITION BY cat) AS fpr FROM per WINDOW w AS (PARTITION BY cat ORDER BY thr DESC))"


def _labelled_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).join(_truth(spark, d), "doc").select("doc", "cat", F.col("p").alias("score"), F.when(F.array_contains("labels", F.col("cat")), 1).otherwise(-1).alias("y"))


@add("e1_roc", f"WITH {_ROC} SELECT cat, round(thr, 6) AS thr, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r")
def e1(spark, d):
    return metrics.roc(_labelled_scores(spark, d)).select("cat", R6("thr").alias("thr"), R6("tpr").alias("tpr"), R6("fpr").alias("fpr"))


@add("e1_auc", f"WITH {_ROC}, l AS (SELECT *, lag(fpr) OVER w AS x0, lag(tpr) OVER w AS y0 FROM r WINDOW w AS (PARTITION BY cat ORDER BY thr DESC)) SELECT cat, round(sum((fpr - x0) * (tpr + y0) / 2), 6) AS auc FROM l GROUP BY 1")
def e1a(spark, d):
    return metrics.auc(metrics.roc(_labelled_scores(spark, d))).select("cat", R6("auc").alias("auc"))


@add("m10_threshold", f"WITH {_ROC} SELECT cat, round(thr, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY round(tpr + 1 - fpr, 12) DESC, thr DESC) AS n FROM r) WHERE n = 1")
def m10(spark, d):
    return metrics.best_threshold(metrics.roc(_labelled_scores(spark, d))).select("cat", R6("threshold").alias("threshold"))


_C7 = [f"c{i}" for i in range(1, 8)]


@add("e2_first_tag", f"SELECT doc, cat, CASE WHEN labels[1] = cat THEN 1 ELSE -1 END AS y FROM {_T}, (SELECT unnest({_C7}) AS cat)")
def e2(spark, d):
    cats = spark.createDataFrame([(c,) for c in _C7], "reference string")
    return metrics.first_tag(_truth(spark, d), "labels", cats).select("doc", "cat", "y")


_L8 = f"(SELECT doc, list(cat ORDER BY q DESC, cat) AS pred FROM {_P8} WHERE q > 0.3 GROUP BY 1)"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    pred = decide.labels_from_scores(_scores(spark, d), "doc", 0.3).select("doc", F.col("labels").alias("pred"))
    return _truth(spark, d).join(pred, "doc")


_CONF = f"(SELECT t, p, count(m.doc) AS n FROM (SELECT unnest({_C7}) AS t) JOIN (SELECT unnest({_C7}) AS p) ON true LEFT JOIN (SELECT doc, labels[1] AS a, pred[1] AS b FROM {_T} JOIN {_L8} USING (doc)) m ON a = t AND b = p GROUP BY 1, 2)"


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_lists(spark, d).select(F.get("labels", F.lit(0)).alias("a"), F.get("pred", F.lit(0)).alias("b")), "a", "b", _C7)


@add("e3_confusion", f"SELECT * FROM {_CONF}")
def e3(spark, d):
    return _confusion(spark, d)


@add("e4_pair_confusion", f"SELECT t, p, count(*) AS n FROM (SELECT unnest(labels) AS t, pred FROM {_T} JOIN {_L8} USING (doc)), unnest(pred) u(p) GROUP BY 1, 2")
def e4(spark, d):
    return metrics.pair_confusion(_lists(spark, d), "labels", "pred")


_MASS = f"""WITH b AS (SELECT doc, labels, pred FROM {_T} JOIN {_L8} USING (doc)),
tw AS (SELECT doc, labels[i] AS c, 0.5 ** (i - 1) / (2 - 0.5 ** (len(labels) - 1)) AS w FROM b, generate_series(1, 7) g(i) WHERE i <= len(labels)),
pw AS (SELECT doc, pred[i] AS c, 0.5 ** (i - 1) / (2 - 0.5 ** (len(pred) - 1)) AS w FROM b, generate_series(1, 7) g(i) WHERE i <= len(pred)),
x AS (SELECT coalesce(tw.doc, pw.doc) AS doc, coalesce(tw.c, pw.c) AS c, coalesce(tw.w, 0) AS wp, coalesce(pw.w, 0) AS wq FROM tw FULL JOIN pw ON tw.doc = pw.doc AND tw.c = pw.c),
y AS (SELECT *, least(wp, wq) AS m, wp - least(wp, wq) AS rp, wq - least(wp, wq) AS rq FROM x), r AS (SELECT doc, 1 - sum(m) AS rest FROM y GROUP BY 1),
cells AS (SELECT c AS t, c AS p, m AS mass FROM y UNION ALL SELECT a.c, b.c, a.rp * b.rq / rest FROM y a JOIN y b USING (doc) JOIN r USING (doc) WHERE a.rp > 1e-12 AND b.rq > 1e-12 AND rest > 1e-12),
e AS (SELECT t, p, sum(mass) AS mass FROM cells GROUP BY 1, 2 HAVING sum(mass) > 0)"""


@add("e5_mass_confusion", f"{_MASS} SELECT t, p, round(mass, 6) AS mass FROM e")
def e5(spark, d):
    return metrics.mass_confusion(_lists(spark, d), "doc", "labels", "pred").select("t", "p", R6("mass").alias("mass"))


@add("e6_ranked_errors", f"SELECT t, p, round(pct, 6) AS pct, round(row_pct, 6) AS row_pct, row_number() OVER (ORDER BY pct DESC, t, p) AS rank_abs FROM (SELECT *, 100.0 * n / sum(n) OVER () AS pct, 100.0 * n / nullif(sum(n) OVER (PARTITION BY t), 0) AS row_pct FROM {_CONF}) WHERE t <> p AND row_pct IS NOT NULL")
def e6(spark, d):
    return metrics.ranked_errors(_confusion(spark, d)).select("t", "p", R6("pct").alias("pct"), R6("row_pct").alias("row_pct"), F.col("rank_abs").cast("bigint").alias("rank_abs"))


@add("e7_error_rate", f"SELECT round(1 - sum(n) FILTER (t = p) / sum(n), 6) AS error FROM {_CONF}")
def e7(spark, d):
    return metrics.error_rate(_confusion(spark, d)).select(R6("error").alias("error"))


_EMD = f"""WITH b AS (SELECT doc, labels, pred FROM {_T} JOIN {_L8} USING (doc)), p AS (SELECT doc, par, sum(1.0 / n) AS w FROM (SELECT doc, len(labels) AS n, substr(unnest(labels), 2)::INT % 3 AS par FROM b) GROUP BY 1, 2),
q AS (SELECT doc, par, sum(1.0 / n) AS w FROM (SELECT doc, len(pred) AS n, substr(unnest(pred), 2)::INT % 3 AS par FROM b) GROUP BY 1, 2)
SELECT doc, round(1 - sum(least(coalesce(p.w, 0), coalesce(q.w, 0))), 6) AS emd FROM p FULL JOIN q USING (doc, par) GROUP BY 1"""


@add("e8_block_emd", _EMD)
def e8(spark, d):
    par = spark.createDataFrame([(c, str(int(c[1:]) % 3)) for c in _C7], "cat string, parent string")
    return metrics.block_emd(_lists(spark, d), "doc", "labels", "pred", par).select("doc", R6("emd").alias("emd"))


@add("e8_general_emd")
def e8g(spark, d):
    import numpy as np

    sim = np.array([[1.0 / (1 + abs(i - j)) for j in range(7)] for i in range(7)])
    return metrics.emd(_lists(spark, d), "doc", "labels", "pred", _C7, sim).select("doc", R6("emd").alias("emd"))


@add("e9_cardinality", f"SELECT round(avg(len(list_distinct(labels))), 6) AS cardinality, round(avg(len(list_distinct(labels))) / (SELECT count(DISTINCT c) FROM (SELECT unnest(labels) AS c FROM {_T})), 6) AS density FROM {_T}")
def e9(spark, d):
    return metrics.cardinality(_truth(spark, d), "labels").select(R6("cardinality").alias("cardinality"), R6("density").alias("density"))


_J = "(len(list_intersect(labels, pred)) / len(list_distinct(list_concat(labels, pred))))"


@add("e10_jaccard", f"SELECT round(avg({_J}), 6) AS jaccard FROM {_T} JOIN {_L8} USING (doc)")
def e10(spark, d):
    return _lists(spark, d).agg(R6(F.avg(metrics.jaccard("labels", "pred"))).alias("jaccard"))


def _ov(k: str) -> str:
    return f"(2.0 * len(list_intersect(labels[1:{k}], pred[1:{k}])) / (len(labels[1:{k}]) + len(pred[1:{k}])) * least({k}, len(labels), len(pred)))"


_RBO = f"(0.1 / 0.9 * (list_sum(list_transform(generate_series(1, k), lambda d: 0.9 ** d / d * ({_ov('d')} - {_ov('k')}))) - {_ov('k')} * ln(0.1)))"
_RB = f"(SELECT doc, labels, pred, least(len(labels), len(pred)) AS k FROM {_T} JOIN {_L8} USING (doc))"


@add("e11_rbo_min", f"SELECT doc, round({_RBO}, 6) AS rbo FROM {_RB}")
def e11(spark, d):
    return _lists(spark, d).select("doc", R6(metrics.rbo_min(metrics.ties("labels"), metrics.ties("pred"), 0.9)).alias("rbo"))


@add("e11_rbo_family", f"SELECT doc, round(list_sum(list_transform(generate_series(1, k), lambda d: 2.0 * len(list_intersect(labels[1:d], pred[1:d])) / (len(labels[1:d]) + len(pred[1:d])))) / k, 6) AS average_overlap FROM {_RB}")
def e11f(spark, d):
    return _lists(spark, d).select("doc", R6(metrics.average_overlap(metrics.ties("labels"), metrics.ties("pred"))).alias("average_overlap"))


_BASE = "(0.1 / 0.9 * (list_sum(list_transform(generate_series(1, k), lambda d: 0.9 ** d / d * (d - k))) - k * ln(0.1)))"
_COST = f"((0.9 * (1 - {_J}) + 0.1 * (1 - {_RBO} / {_BASE})) / 2)"


@add("e12_jrbo_cost", f"SELECT doc, round({_COST}, 6) AS cost FROM {_RB}")
def e12(spark, d):
    return _lists(spark, d).select("doc", R6(metrics.jrbo_cost("labels", "pred")).alias("cost"))


_WC = f"(SELECT score AS thr, sum(CASE WHEN y > 0 THEN 1.0 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN y < 0 THEN 1.0 ELSE 0 END)::DOUBLE AS n FROM {_Y} GROUP BY 1)"


@add("e17_weighted_curve", f"SELECT thr, sum(p) OVER w AS nfn, sum(n) OVER w AS ntn, sum(n) OVER () - sum(n) OVER w AS nfp, sum(p) OVER () - sum(p) OVER w AS ntp FROM {_WC} WINDOW w AS (ORDER BY thr)")
def e17(spark, d):
    return metrics.weighted_curve(_labelled_scores(spark, d), "score", "y")


@add("e18_proportions", "SELECT round(avg((relabel > 0)::INT), 6) AS overall, round(avg((relabel > 0)::INT) FILTER (marker = 0), 6) AS random, round(sum(weight) FILTER (relabel > 0) / sum(weight), 6) AS weighted FROM labels_info")
def e18(spark, d):
    r = metrics.proportions(table(spark, d, "labels_info").withColumn("y", F.col("relabel")))
    return r.select(*(R6(c).alias(c) for c in r.columns))


# Embeddings


@add("w1_vector", "SELECT vec_id, label FROM embeddings WHERE vec_id = 7")
def w1(spark, d):
    return embed.vector(table(spark, d, "embeddings"), "vec_id", 7).select("vec_id", "label")


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@add("w2_most_similar", f"SELECT e.vec_id, round({_COS}, 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.vec_id <> 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def w2(spark, d):
    return embed.most_similar(table(spark, d, "embeddings"), "vec_id", "embedding", [3]).select("vec_id", F.round("score", 5).alias("score"))


@add("w3_cosmul", f"SELECT e.vec_id, round((1 + {_COS}) / 2 / ((1 + {_COS.replace('q.', 'r.')}) / 2 + 1e-6), 5) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q, (SELECT embedding FROM embeddings WHERE vec_id = 5) r WHERE e.vec_id NOT IN (3, 5) ORDER BY (1 + {_COS}) / 2 / ((1 + {_COS.replace('q.', 'r.')}) / 2 + 1e-6) DESC, e.vec_id LIMIT 10")
def w3(spark, d):
    return embed.most_similar_cosmul(table(spark, d, "embeddings"), "vec_id", "embedding", [3], [5]).select("vec_id", F.round("score", 5).alias("score"))


@add("w4_closest", "SELECT e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2, 5) AS d2 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q WHERE e.vec_id <> 11 ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id LIMIT 20")
def w4(spark, d):
    return embed.closest(table(spark, d, "embeddings"), "vec_id", "embedding", 11, 20).select("vec_id", F.round("d2", 5).alias("d2"))


_SETS = [(1, [1, 2, 3]), (2, [4, 5])], [(10, [6, 7]), (11, [1, 8, 9])]


def _sets(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(_SETS[0], "lid int, tokens array<bigint>"), spark.createDataFrame(_SETS[1], "rid int, tokens array<bigint>")


_K = """WITH l AS (SELECT * FROM (VALUES (1, 1), (1, 2), (1, 3), (2, 4), (2, 5)) t(lid, a)), r AS (SELECT * FROM (VALUES (10, 6), (10, 7), (11, 1), (11, 8), (11, 9)) t(rid, b)), m AS (SELECT avg(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS mean2 FROM embeddings),
k AS (SELECT lid, rid, a, b, list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) ** 2 AS d2, exp(-(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) ** 2) / mean2 / 1.0) AS k FROM l JOIN embeddings x ON a = x.vec_id JOIN r ON true JOIN embeddings y ON b = y.vec_id, m)"""


@add("w5_kernel", f"{_K} SELECT lid::INT AS lid, rid::INT AS rid, a::BIGINT AS a, b::BIGINT AS b, round(k, 6) AS k FROM k")
def w5(spark, d):
    return embed.kernel(*_sets(spark), table(spark, d, "embeddings"), "vec_id", "embedding", 1.0).select("lid", "rid", "a", "b", R6("k").alias("k"))


@add("w6_row_minima", f"{_K} SELECT lid::INT AS lid, rid::INT AS rid, round(avg(m), 5) AS d FROM (SELECT lid, rid, a, min(d2) AS m FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2")
def w6(spark, d):
    return embed.row_minima(*_sets(spark), table(spark, d, "embeddings"), "vec_id", "embedding").select("lid", "rid", F.round("d", 5).alias("d"))


@add("pr17_kernel_score", f"{_K}, x AS (SELECT lid, rid, a, max(round_even(k, 3)) AS m FROM k GROUP BY 1, 2, 3), y AS (SELECT lid, rid, b, max(round_even(k, 3)) AS m FROM k GROUP BY 1, 2, 3) SELECT lid::INT AS lid, rid::INT AS rid, round(p + q, 5) AS score FROM (SELECT lid, rid, avg(m) AS p FROM x GROUP BY 1, 2) JOIN (SELECT lid, rid, avg(m) AS q FROM y GROUP BY 1, 2) USING (lid, rid)")
def p17(spark, d):
    return embed.kernel_score(embed.kernel(*_sets(spark), table(spark, d, "embeddings"), "vec_id", "embedding", 1.0)).select("lid", "rid", F.round("score", 5).alias("score"))


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens of all documents and of all definitions, and vectors trained on the words of all projects as in m11_word_vectors."""
    left = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("lid"), tx.words(F.col("text")).alias("tokens"))
    right = table(spark, d, "taxonomy").filter("definition IS NOT NULL").select(F.col("reference").alias("rid"), tx.words(F.col("definition")).alias("tokens"))
    corpus = table(spark, d, "proyectos").select(tx.words(F.concat_ws("\n", "titulo", "resumen")).alias("tokens"))
    return left, right, cut(models.word_vectors(corpus, dim=32, epochs=1))


@add("w5_documents")
def w5d(spark, d):
    """W5 of all documents with all definitions, each pair of tokens once."""
    return embed.kernel_pairs(*_documents(spark, d), "word", "vector", 1.0).select("a", "b", R6("k").alias("k"))


@add("w6_documents")
def w6d(spark, d):
    """W6 of every document with every definition."""
    return embed.score_sets(*_documents(spark, d), "word", "vector", 1.0).select("lid", "rid", F.round("d", 5).alias("d"))


@add("pr17_documents")
def p17d(spark, d):
    """P17 of every document with every definition."""
    return embed.score_sets(*_documents(spark, d), "word", "vector", 1.0).filter("score IS NOT NULL").select("lid", "rid", F.round("score", 5).alias("score"))


@add("a8_nearest_of_each", "SELECT q, vec_id, rank FROM (SELECT q.vec_id AS q, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id)::INT AS rank FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5")
def a8(spark, d):
    """The stated set of queries is every vector whose number is divisible by 100, against all."""
    e = table(spark, d, "embeddings")
    return embed.nearest_of_each(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 5).select("q", "vec_id", "rank")


# Label trees

_TREE = "(SELECT r_name AS cat, NULL AS parent FROM region UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.select(F.col("r_name").alias("cat"), F.lit(None).cast("string").alias("parent")).unionByName(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("cat"), F.col("r_name").alias("parent")))


@add("l1_closure", f"WITH RECURSIVE t AS (SELECT * FROM {_TREE}), c(cat, anc, dist) AS (SELECT cat, parent, 1 FROM t WHERE parent IS NOT NULL UNION ALL SELECT c.cat, t.parent, c.dist + 1 FROM c JOIN t ON c.anc = t.cat WHERE t.parent IS NOT NULL) SELECT * FROM c")
def l1(spark, d):
    return label_tree.closure(_tree(spark, d))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("key"), F.col("n_name").alias("cat"), F.when(F.col("s_acctbal") > 0, 1).otherwise(-1).alias("y"))


@add("l2_infer", f"""WITH m AS (SELECT s_suppkey AS key, n_name AS cat, CASE WHEN s_acctbal > 0 THEN 1 ELSE -1 END AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey), t AS (SELECT * FROM {_TREE})
SELECT k.key, t.cat, CASE WHEN m.y > 0 AND (t.cat = m.cat OR t.cat = p.parent) THEN 1 WHEN m.y < 0 AND t.cat = m.cat THEN -1 ELSE 0 END::INT AS y FROM (SELECT DISTINCT key FROM m) k JOIN t ON true JOIN m ON m.key = k.key JOIN t p ON p.cat = m.cat""")
def l2(spark, d):
    return label_tree.infer(_marks(spark, d), _tree(spark, d))


@add("l4_transfer_predictions", "SELECT coalesce(o.referencia, n.referencia) AS referencia, coalesce(n.url, o.url) AS url, coalesce(n.p, o.p) AS p FROM (SELECT referencia, referencia AS url, weight AS p FROM labels_info WHERE marker = 0) o FULL JOIN (SELECT referencia, referencia AS url, weight * 2 AS p FROM labels_info WHERE relabel = 0) n USING (referencia)")
def l4(spark, d):
    i = table(spark, d, "labels_info")
    old = i.filter("marker = 0").select("referencia", F.col("referencia").alias("url"), F.col("weight").alias("p"))
    new = i.filter("relabel = 0").select("referencia", F.col("referencia").alias("url"), (F.col("weight") * 2).alias("p"))
    return label_tree.transfer_predictions(old, new, "referencia")


@add("l8_dataset", "SELECT l_orderkey AS key, cat, coalesce(p, 0.0) AS p FROM (SELECT l_orderkey, max(l_discount) FILTER (l_linenumber = 1) AS c1, max(l_discount) FILTER (l_linenumber = 2) AS c2 FROM lineitem GROUP BY 1) UNPIVOT INCLUDE NULLS (p FOR cat IN (c1, c2))")
def l8(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(*(F.max(F.when(F.col("l_linenumber") == i, F.col("l_discount"))).alias(f"c{i}") for i in (1, 2)))
    return label_tree.dataset(w, "key", ["c1", "c2"])


# Samples


@add("q1_tourney", "SELECT k, round(list_reduce(list_prepend(10.0 / 500, list_transform(generate_series(0, 8), lambda j: greatest(0.0, 500.0 - k - j) / (499.0 - j))), lambda a, b: a * b), 12) AS p FROM generate_series(1, 491) t(k)")
def q1(spark, d):
    return spark.range(1, 492).select(F.col("id").alias("k"), F.round(sampling.tourney_probability(F.col("id"), 500, 10), 12).alias("p"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("pred"), F.when(F.col("c_nationkey") < 5, 1).when(F.col("c_nationkey") < 10, -1).otherwise(0).alias("y"))


_POOL = "(SELECT c_custkey, c_acctbal / 10000 AS pred, CASE WHEN c_nationkey < 5 THEN 1 WHEN c_nationkey < 10 THEN -1 ELSE 0 END AS y FROM customer)"
_AL = f"(SELECT *, CASE WHEN y = 0 THEN abs(pred) / (SELECT max(abs(pred)) FROM {_POOL} WHERE y = 0) ELSE 1 - abs(pred - y) / 2 END AS al_score FROM {_POOL})"


@add("q2_scores", f"SELECT c_custkey, round(al_score, 9) AS al_score FROM {_AL}")
def q2(spark, d):
    return sampling.al_scores(_pool(spark, d), "pred", "y").select("c_custkey", F.round("al_score", 9).alias("al_score"))


@add("q3_selection", f"SELECT c_custkey, round(0.5 / n + 0.5 * list_reduce(list_prepend(10.0 / (n + 9), list_transform(generate_series(0, 8), lambda j: greatest(0.0, n + 9.0 - r - j) / (n + 8.0 - j))), lambda a, b: a * b), 9) AS p_sel FROM (SELECT c_custkey, row_number() OVER (ORDER BY al_score, c_custkey) AS r, count(*) OVER () AS n FROM {_AL})")
def q3(spark, d):
    return sampling.selection_probability(sampling.al_scores(_pool(spark, d), "pred", "y"), "c_custkey").select("c_custkey", F.round("p_sel", 9).alias("p_sel"))


@add("q4_queries")
def q4(spark, d):
    return sampling.queries(_pool(spark, d), "c_custkey", "pred", "y", 20, 0.3).select("c_custkey", "marker", "relabel")


@add("q5_weights", "SELECT c_custkey, round(CASE WHEN c_custkey = 7 THEN 1.0 / (n * 0.01) WHEN c_nationkey < 10 THEN 1 + 1.0 / (n * 0.5) ELSE 1 END, 6) AS w FROM customer, (SELECT count(*) AS n FROM customer)")
def q5(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit(1.0).alias("w"))
    return sampling.update_weights(c, "w", 0.5, F.col("c_nationkey") < 10, F.col("c_custkey") == 7, F.lit(0.01)).select("c_custkey", R6("w").alias("w"))


@add("q6_batch")
def q6(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("pred"), F.when(F.col("c_nationkey") < 5, "yes").otherwise("unknown").alias("lab"), F.lit(None).cast("double").alias("w"))
    return sampling.batch(c, "c_custkey", "pred", "lab", "w", 15, {"yes": 1, "no": -1, "unknown": 0}).select("c_custkey", "marker", "w")


@add("q9_simulation")
def q9(spark, d):
    def make(sim: int):
        import numpy as np

        rng = np.random.default_rng(sim)
        y = rng.choice([-1, 1], 300)
        return rng.standard_normal((300, 2)) + y[:, None], y

    return sampling.simulate(spark.range(4).withColumnRenamed("id", "sim"), make, 5, 10)


@add("q11_efficiency", "WITH a AS (SELECT o_custkey % 50 AS n, avg(o_totalprice) AS e FROM orders GROUP BY 1), b AS (SELECT o_orderkey % 50 AS n, avg(o_totalprice) AS e FROM orders GROUP BY 1), x AS (SELECT n AS n_a, min(e) OVER (ORDER BY n) AS e FROM a), y AS (SELECT n AS n_b, min(e) OVER (ORDER BY n) AS f FROM b) SELECT n_a, min(n_b) AS n_b FROM x LEFT JOIN y ON f <= e GROUP BY 1")
def q11(spark, d):
    o = table(spark, d, "orders")
    curve = lambda c: o.groupBy((F.col(c) % 50).alias("n")).agg(F.avg("o_totalprice").alias("error"))
    return sampling.sample_efficiency(curve("o_custkey"), curve("o_orderkey"))


@add("rank_global", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def rank(spark, d):
    return global_rank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]).select("o_orderkey", "rank")


# Models


_G = {k: f"unnest({list(v)})" for k, v in (("c", models.RANGE_C), ("n", models.RANGE_N), ("l", models.RANGE_L), ("a", models.RANGE_ALPHA), ("c7", list(models.RANGE_C)[:7]))}
_GRID = f"""SELECT 'LRC' || k AS model_name, 'LR' AS model_type FROM (SELECT {_G['c']} AS k) UNION ALL SELECT 'LSVMC' || k, 'LSVM' FROM (SELECT {_G['c']} AS k)
UNION ALL SELECT 'SVMpoly' || d || 'C' || k, 'SVMpoly' FROM (SELECT {_G['c']} AS k), (SELECT unnest([2, 3]) AS d) UNION ALL SELECT 'DT', 'DT' UNION ALL SELECT 'ABN' || k, 'AB' FROM (SELECT {_G['n']} AS k)
UNION ALL SELECT 'RFN' || k, 'RF' FROM (SELECT {_G['n']} AS k) UNION ALL SELECT 'MLPC' || k || 'N' || j, 'MLP' FROM (SELECT {_G['c7']} AS k), (SELECT {_G['n']} AS j) UNION ALL SELECT 'KNNN' || k, 'KNN' FROM (SELECT {_G['n']} AS k)
UNION ALL SELECT 'LASSOL' || k, 'LASSO' FROM (SELECT {_G['l']} AS k) UNION ALL SELECT 'ENL' || k || 'L' || j, 'EN' FROM (SELECT {_G['l']} AS k), (SELECT {_G['l']} AS j)
UNION ALL SELECT 'MNBA' || k, 'MNB' FROM (SELECT {_G['a']} AS k) UNION ALL SELECT 'BNBL' || k, 'BNB' FROM (SELECT {_G['l']} AS k)"""


@add("m2_grid", _GRID)
def m2(spark, d):
    kinds = ["LR", "LSVM", "SVMpoly", "DT", "AB", "RF", "MLP", "KNN", "LASSO", "EN", "MNB", "BNB"]
    return spark.createDataFrame([(n, t, {k: float(v) for k, v in p.items()}) for n, t, p in models.grid(kinds)], "model_name string, model_type string, params map<string,double>").select("model_name", "model_type")


def _validated(spark: SparkSession, d: str) -> DataFrame:
    """(cat, model_name, grid_pos, auc, threshold): labelled projects under every area of the taxonomy and every LR model, ten folds."""
    from ..operators.packed import explode_packed

    p = table(spark, d, "proyectos").filter("resumen IS NOT NULL")
    lab = explode_packed(table(spark, d, "labels_info"), "referencia", "labelstr").select(F.col("key").alias("referencia"), F.col("val").alias("cat"))
    docs = p.join(lab.select("referencia").distinct(), "referencia", "left_semi")
    vec = models.features(tfidf.tfidf(docs, "referencia", "resumen"), "referencia")
    cats = table(spark, d, "taxonomy").filter("NOT endswith(reference, '_')").select(F.col("reference").alias("cat")).distinct()
    y = vec.select("referencia").join(sent(cats), F.lit(True)).join(lab.distinct().withColumn("hit", F.lit(1)), ["referencia", "cat"], "left").select("referencia", "cat", F.when(F.col("hit") == 1, 1).otherwise(-1).alias("y"))
    grid = models.grid(["LR"])
    scores = kept(models.cross_validate_logistic(vec, y, "referencia", grid))
    return models.evaluate_models(scores, [r["cat"] for r in cats.orderBy("cat").collect()], grid)


@add("m8_cross_validation")
def m8(spark, d):
    return _validated(spark, d).select("cat", "model_name", "auc", "threshold")


@add("m9_validated")
def m9v(spark, d):
    """The best model of each area by the results of M8; m9_best_models has the same choice on columns that SQL can state."""
    return models.best_models(_validated(spark, d))


@add("m9_best_models", "SELECT cat, model_name, auc FROM (SELECT 'c' || n_regionkey AS cat, n_name AS model_name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey / 100.0 END::DOUBLE AS auc, row_number() OVER (PARTITION BY n_regionkey ORDER BY coalesce(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey / 100.0 END, 0) DESC, n_nationkey) AS r FROM nation) WHERE r = 1")
def m9(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("cat"), F.col("n_name").alias("model_name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey") / 100.0).alias("auc"), F.col("n_nationkey").alias("grid_pos"))
    return models.best_models(n)


@add("m11_word_vectors")
def m11(spark, d):
    return models.word_vectors(tfidf.chunk_sentences(table(spark, d, "proyectos"), "titulo", "resumen"), dim=32, epochs=1).select("word", F.size("vector").alias("dim"))


@add("e15_compare_labels", f"{_MASS} SELECT round(1 - sum(mass) FILTER (t = p) / sum(mass), 6) AS error FROM e")
def e15(spark, d):
    par = spark.createDataFrame([(c, str(int(c[1:]) % 3)) for c in _C7], "cat string, parent string")
    pred = decide.labels_from_scores(_scores(spark, d), "doc", 0.3).select("doc", F.col("labels").alias("pred"))
    got = metrics.compare_labels(_truth(spark, d), pred, "doc", "labels", "pred", par)
    return got["error"].select(R6("error").alias("error"))


_TAGS = "list_filter(list_transform(string_split(labelstr, '++'), lambda x: trim(x)), lambda x: x <> '' AND NOT suffix(x, '_'))"


@add("m1_prepare", f"SELECT referencia, array_to_string(list_transform(list_filter(generate_series(1, len(l)), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), '|') AS tags FROM (SELECT referencia, {_TAGS} AS l FROM proyectos JOIN labels_info USING (referencia) WHERE resumen_lang = 'es' AND labelstr IS NOT NULL)")
def m1(spark, d):
    j = table(spark, d, "proyectos").join(table(spark, d, "labels_info").select("referencia", "labelstr"), "referencia")
    tags, _, _ = models.prepare(j, "referencia", "titulo", "resumen", "titulo_lang", "resumen_lang", "labelstr", "++")
    return tags.select("referencia", F.array_join("tags", "|").alias("tags"))


def _compared(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    par = spark.createDataFrame([(c, str(int(c[1:]) % 3)) for c in _C7], "cat string, parent string")
    pred = decide.labels_from_scores(_scores(spark, d), "doc", 0.3).select("doc", F.col("labels").alias("pred"))
    return metrics.compare_labels(_truth(spark, d), pred, "doc", "labels", "pred", par)


@add("e15_cells", f"{_MASS} SELECT t, p, round(mass, 6) AS mass FROM e")
def e15c(spark, d):
    return _compared(spark, d)["cells"].select("t", "p", R6("mass").alias("mass"))


@add("e15_cells_equal", f"{_MASS.replace('0.5 ** (i - 1) / (2 - 0.5 ** (len(labels) - 1))', '1.0 / len(labels)').replace('0.5 ** (i - 1) / (2 - 0.5 ** (len(pred) - 1))', '1.0 / len(pred)')} SELECT t, p, round(mass, 6) AS mass FROM e")
def e15e(spark, d):
    return _compared(spark, d)["cells_equal"].select("t", "p", R6("mass").alias("mass"))


@add("e15_ranked", f"{_MASS}, f AS (SELECT *, 100.0 * mass / sum(mass) OVER () AS pct, 100.0 * mass / sum(mass) OVER (PARTITION BY t) AS row_pct FROM e) SELECT t, p, round(pct, 5) AS pct, round(row_pct, 5) AS row_pct FROM f WHERE t <> p")
def e15r(spark, d):
    return _compared(spark, d)["ranked"].select("t", "p", F.round("pct", 5).alias("pct"), F.round("row_pct", 5).alias("row_pct"))


@add("e15_emd", _EMD)
def e15m(spark, d):
    return _compared(spark, d)["emd"].select("doc", R6("emd").alias("emd"))
