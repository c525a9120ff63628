"""Queries of the store, relational and text operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import relational as rel
from ..sources import store
from ..streaming import history
from ..session import table
from .registry import Registry

add = Registry()
_DL = "list_filter(string_split(label, '++'), lambda x: x <> '')"


def _history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labelhistory").withColumn("labels", F.filter(F.split("label", r"\+\+"), lambda x: x != ""))


@add("s2_read_table", "SELECT referencia, cconv, titulo FROM proyectos WHERE resumen_lang = 'es' ORDER BY referencia LIMIT 50")
def s2(spark, d):
    return store.read_table(table(spark, d, "proyectos"), ["referencia", "cconv", "titulo"], "resumen_lang = 'es'", "referencia", 50)


@add("s10_replace_documents", "SELECT coalesce(n.referencia, o.referencia) AS idna, CASE WHEN n.referencia IS NOT NULL THEN n.split_name ELSE o.label END AS value FROM (SELECT referencia, labelstr AS label FROM labels_info) o FULL JOIN (SELECT referencia, split_name FROM splits) n ON o.referencia = n.referencia")
def s10(spark, d):
    return store.replace_documents(table(spark, d, "labels_info").select(F.col("referencia").alias("idna"), F.col("labelstr").alias("value")), table(spark, d, "splits").select(F.col("referencia").alias("idna"), F.col("split_name").alias("value")))


@add("s11_load_labels", "SELECT i.referencia, i.marker, i.weight, (s.dev IS NOT NULL)::INT AS has_label FROM labels_info i LEFT JOIN (SELECT referencia, 1 AS dev FROM splits WHERE split_name = 'dev') s USING (referencia)")
def s11(spark, d):
    label = table(spark, d, "splits").filter("split_name = 'dev'").select("referencia", F.lit(1).alias("dev"))
    return store.load_labels(table(spark, d, "labels_info"), label).select("referencia", "info.marker", "info.weight", F.size("label").alias("has_label"))


@add("s14_wiki_definitions", "WITH l AS (SELECT reference, unnest(string_split(wikiref, '+')) AS title, generate_subscripts(string_split(wikiref, '+'), 1) AS pos FROM taxonomy) SELECT reference, string_agg(title || ' ' || upper(title) || ' ', '' ORDER BY pos) AS wikidefs FROM l GROUP BY 1")
def s14(spark, d):
    t = table(spark, d, "taxonomy")
    pages = t.select(F.explode(F.split("wikiref", r"\+")).alias("title")).distinct().withColumn("content", F.upper("title"))
    return store.wiki_definitions(t, pages)


@add("s17_label_lines", "SELECT referencia || ';' || marker AS value FROM labels_info")
def s17(spark, d):
    return store.label_lines(table(spark, d, "labels_info"), "referencia", F.col("marker"))


@add("s17_history_lines", "SELECT coalesce('label;' || label || ';', '') || coalesce('marker;' || marker || ';', '') || coalesce('userid;' || userid || ';', '') AS value FROM labelhistory")
def s17h(spark, d):
    return store.history_lines(table(spark, d, "labelhistory"), ["userid", "label", "marker"])


@add("s18_by_marker", "SELECT referencia, labelstr FROM labels_info WHERE marker = 1")
def s18(spark, d):
    return store.by_marker(table(spark, d, "labels_info"), "al").select("referencia", "labelstr")


@add("r3_catalog_view", " UNION ALL ".join(f"SELECT '{t}' AS table_name, {n}::BIGINT AS n_columns, count(*) AS n_rows FROM {t}" for t, n in (("proyectos", 8), ("taxonomy", 6), ("splits", 3))))
def r3(spark, d):
    return store.catalog_view({t: table(spark, d, t) for t in ("proyectos", "taxonomy", "splits")})


@add("r6_insert", "SELECT referencia, split_name, NULL AS labelstr FROM splits UNION ALL SELECT referencia, NULL, labelstr FROM labels_info")
def r6(spark, d):
    return store.insert(table(spark, d, "splits").select("referencia", "split_name"), table(spark, d, "labels_info").select("referencia", "labelstr"))


@add("r7_set_field", "SELECT p.referencia, CASE WHEN l.referencia IS NOT NULL THEN l.labelstr ELSE p.unesco_cd END AS unesco_cd FROM proyectos p LEFT JOIN labels_info l USING (referencia)")
def r7(spark, d):
    return store.set_field(table(spark, d, "proyectos").select("referencia", "unesco_cd"), table(spark, d, "labels_info").select("referencia", F.col("labelstr").alias("unesco_cd")), "referencia")


@add("r8_upsert", "SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal, o.c_name, n.grade FROM (SELECT * FROM customer WHERE c_nationkey < 15) o FULL JOIN (SELECT c_custkey, c_acctbal * 2 AS c_acctbal, c_nationkey AS grade FROM customer WHERE c_nationkey > 10) n ON o.c_custkey = n.c_custkey")
def r8(spark, d):
    c = table(spark, d, "customer")
    return store.upsert(c.filter("c_nationkey < 15").select("c_custkey", "c_name", "c_acctbal"), c.filter("c_nationkey > 10").select("c_custkey", (F.col("c_acctbal") * 2).alias("c_acctbal"), F.col("c_nationkey").alias("grade")), "c_custkey")


@add("j1_language", "SELECT referencia FROM proyectos WHERE resumen_lang = 'es'")
def j1(spark, d):
    return rel.language_filter(table(spark, d, "proyectos"), "resumen_lang").select("referencia")


@add("j2_null_or_nan", "SELECT referencia FROM proyectos WHERE resumen IS NULL OR resumen = 'nan'")
def j2(spark, d):
    return rel.null_or_nan(table(spark, d, "proyectos"), "resumen").select("referencia")


@add("j3_with_labels", "SELECT referencia, labelstr FROM labels_info WHERE labelstr IS NOT NULL")
def j3(spark, d):
    return rel.with_labels(table(spark, d, "labels_info"), "labelstr").select("referencia", "labelstr")


@add("j4_labelled_records", "SELECT l.referencia, l.labelstr, p.titulo FROM labels_info l LEFT JOIN proyectos p USING (referencia)")
def j4(spark, d):
    return rel.labelled_records(table(spark, d, "labels_info").select("referencia", "labelstr"), table(spark, d, "proyectos").select("referencia", "titulo"), "referencia")


@add("j5_semi", "SELECT referencia, cconv FROM proyectos WHERE referencia IN (SELECT referencia FROM labels_info)")
def j5(spark, d):
    return rel.restrict(table(spark, d, "proyectos").select("referencia", "cconv"), table(spark, d, "labels_info"), "referencia")


@add("j6_append_new", "SELECT referencia, labelstr AS v FROM labels_info UNION ALL SELECT referencia, split_name FROM splits WHERE referencia NOT IN (SELECT referencia FROM labels_info)")
def j6(spark, d):
    return rel.append_new(table(spark, d, "labels_info").select("referencia", F.col("labelstr").alias("v")), table(spark, d, "splits").select("referencia", F.col("split_name").alias("v")), "referencia")


@add("j7_overwrite_known", "SELECT l.referencia, coalesce(s.split_name, l.labelstr) AS v FROM labels_info l LEFT JOIN splits s USING (referencia)")
def j7(spark, d):
    return rel.overwrite_known(table(spark, d, "labels_info").select("referencia", F.col("labelstr").alias("v")), table(spark, d, "splits").select("referencia", F.col("split_name").alias("v")), "referencia")


_U = "(SELECT referencia, string_split(unesco_cd, ',') AS c FROM proyectos)"


@add("j9_lookup", f"WITH i AS (SELECT referencia, unnest(c) AS item, generate_subscripts(c, 1) AS pos FROM {_U}), m AS (SELECT unesco_cd::VARCHAR AS item, min(ford_eq) AS name FROM unesco_codes GROUP BY 1) SELECT referencia, string_agg(name, ',' ORDER BY pos) AS names FROM i JOIN m USING (item) WHERE name IS NOT NULL GROUP BY 1")
def j9(spark, d):
    m = table(spark, d, "unesco_codes").groupBy("unesco_cd").agg(F.min("ford_eq").alias("name")).filter("name IS NOT NULL")
    return rel.lookup(table(spark, d, "proyectos"), "referencia", "unesco_cd", m, "unesco_cd", "name")


for _how, _word in (("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):

    def _set(spark, d, how=_how):
        return rel.set_operation(table(spark, d, "labels_info").select("referencia"), table(spark, d, "splits").select("referencia"), how)

    add(f"j10_{_how}", f"SELECT referencia FROM labels_info {_word} SELECT referencia FROM splits")(_set)


@add("j11_without_level_1", f"SELECT referencia, label FROM labelhistory WHERE label IS NOT NULL AND len(list_filter({_DL}, lambda x: x LIKE '%\\_' ESCAPE '\\')) = 0")
def j11(spark, d):
    return rel.without_level_1(_history(spark, d).filter("label IS NOT NULL"), "labels").select("referencia", "label")


@add("j12_single_label", f"SELECT referencia, label FROM labelhistory WHERE label IS NOT NULL AND len({_DL}) = 1")
def j12(spark, d):
    return rel.single_label(_history(spark, d).filter("label IS NOT NULL"), "labels").select("referencia", "label")


@add("j13_label_pairs", f"SELECT l.referencia, array_to_string({_DL}, '|') AS l_left, l_right FROM labelhistory l JOIN (SELECT referencia, split_name AS l_right FROM splits WHERE split_name IS NOT NULL) s USING (referencia) WHERE label IS NOT NULL AND len({_DL}) = 1")
def j13(spark, d):
    s = table(spark, d, "splits").select("referencia", F.when(F.col("split_name").isNotNull(), F.array("split_name")).alias("right"))
    return rel.label_pairs(_history(spark, d), s, "referencia", "labels", "right", True).select("referencia", F.array_join("labels", "|").alias("l_left"), F.array_join("right", "|").alias("l_right"))


@add("j14_show_labels", "SELECT referencia, labelstr, unesco_cd FROM labels_info JOIN proyectos USING (referencia)")
def j14(spark, d):
    p = rel.restrict(table(spark, d, "proyectos").select("referencia", "unesco_cd"), table(spark, d, "labels_info"), "referencia")
    return rel.labelled_records(table(spark, d, "labels_info").select("referencia", "labelstr"), p, "referencia").filter("referencia IS NOT NULL")


@add("a1_merge_groups", "SELECT l_orderkey, (list(l_shipdate ORDER BY l_linenumber, l_partkey, l_shipdate))[1] AS l_shipdate, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def a1(spark, d):
    return rel.merge_groups(table(spark, d, "lineitem"), "l_orderkey", ["l_shipdate"], "l_partkey", "l_linenumber")


@add("a2_distinct", "SELECT DISTINCT unesco_cd, descr FROM unesco_codes")
def a2(spark, d):
    return rel.distinct_rows(table(spark, d, "unesco_codes"), "unesco_cd", "descr")


_CATS = "(SELECT reference FROM taxonomy WHERE reference NOT LIKE '%\\_' ESCAPE '\\')"


@add("a3_distribution", f"WITH n AS (SELECT c, count(*) AS n FROM (SELECT unnest({_DL}) AS c FROM labelhistory) GROUP BY 1) SELECT reference AS category, coalesce(n, 0) AS n FROM {_CATS} LEFT JOIN n ON reference = c")
def a3(spark, d):
    return rel.label_distribution(_history(spark, d), "labels", table(spark, d, "taxonomy"))


@add("a3_first_label", f"WITH n AS (SELECT ({_DL})[1] AS c, count(*) AS n FROM labelhistory GROUP BY 1) SELECT reference AS category, coalesce(n, 0) AS n FROM {_CATS} LEFT JOIN n ON reference = c")
def a3f(spark, d):
    return rel.label_distribution(_history(spark, d), "labels", table(spark, d, "taxonomy"), True)


@add("a4_labels_per_item", f"WITH s AS (SELECT len({_DL})::INT AS size FROM labelhistory WHERE label IS NOT NULL) SELECT size, count(*) AS n, (SELECT avg(size) FROM s) AS mean_size, (SELECT max(size) FROM s) AS max_size FROM s GROUP BY size")
def a4(spark, d):
    return rel.labels_per_item(_history(spark, d).filter("label IS NOT NULL"), "labels")


@add("a5_labels_per_call", f"SELECT tconv, count(*) AS n, count(*) FILTER (len({_DL}) = 1) AS n_single FROM labelhistory JOIN proyectos USING (referencia) WHERE label IS NOT NULL GROUP BY 1")
def a5(spark, d):
    j = _history(spark, d).filter("label IS NOT NULL").join(table(spark, d, "proyectos").select("referencia", "tconv"), "referencia")
    return rel.labels_per_group(j, "tconv", "labels")


@add("a6_sampling_origin", "SELECT count(*) FILTER (marker = 0 AND coalesce(relabel, 0) = 0) AS new_rs, count(*) FILTER (marker = 1 AND coalesce(relabel, 0) = 0) AS new_al, count(*) FILTER (marker = 0 AND relabel > 0) AS recycled_rs, count(*) FILTER (marker = 1 AND relabel > 0) AS recycled_al, count(*) FILTER (marker IS NULL) AS old FROM labelhistory")
def a6(spark, d):
    return rel.sampling_origin(table(spark, d, "labelhistory"))


@add("a7_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 50")
def a7(spark, d):
    return rel.top_k(table(spark, d, "lineitem"), "l_suppkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 50).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@add("a11_distinct_lists", f"SELECT DISTINCT array_to_string(list_sort({_DL}), '|') AS labels FROM labelhistory WHERE label IS NOT NULL")
def a11(spark, d):
    return rel.distinct_lists(_history(spark, d).filter("label IS NOT NULL"), "labels").select(F.array_join("labels", "|").alias("labels"))


@add("a12_latest", "SELECT referencia, label, userid FROM (SELECT *, row_number() OVER (PARTITION BY referencia ORDER BY ingest_ts DESC, coalesce(label, '') DESC, coalesce(userid, '') DESC) AS n FROM labelhistory) WHERE n = 1")
def a12(spark, d):
    h = table(spark, d, "labelhistory").withColumns({"_l": F.coalesce("label", F.lit("")), "_u": F.coalesce("userid", F.lit(""))})
    return rel.latest(h, "referencia", "ingest_ts", ["_l", "_u"]).select("referencia", "label", "userid")


@add("t2_sentences", r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))::INT AS n FROM documents WHERE text IS NOT NULL")
def t2(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n"))


@add("t2_sentence_texts", r"SELECT doc_id, regexp_replace(text, '([.!?])\s+', '\1|', 'g') AS lines FROM documents WHERE text IS NOT NULL")
def t2s(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(tx.sentences(F.col("text")), "|").alias("lines"))


@add("t3_tokens", f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{tx.TOKEN}'), ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def t3(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


_STOP = tx.STOP["es"].split()


@add("t6_drop_stop", f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '{tx.WORD}'), lambda x: NOT list_contains({_STOP}, x)), ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def t6(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(tx.drop_stop(tx.words(F.col("text")), _STOP), " ").alias("tokens"))


@add("t7_ngrams", r"SELECT referencia, regexp_replace(regexp_replace(lower(titulo), 'redes de sensores', 'redes_de_sensores', 'g'), 'modelo a ', 'modelo_a ', 'g') AS t FROM proyectos WHERE titulo IS NOT NULL")
def t7(spark, d):
    return table(spark, d, "proyectos").filter("titulo IS NOT NULL").select("referencia", tx.join_ngrams(F.lower("titulo"), ["redes de sensores", "modelo a"]).alias("t"))


@add("t8_drop_numbers", f"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '{tx.TOKEN}'), lambda x: NOT regexp_full_match(lower(x), '[0-9]+([.][0-9]*)?(e[+-]?[0-9]+)?|nan|inf|infinity')), ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def t8(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(tx.drop_numbers(tx.tokens(F.col("text"))), " ").alias("tokens"))


@add("t10_assemble_v1", "SELECT referencia, replace(replace(lower(CASE WHEN titulo_lang = 'es' THEN repeat(coalesce(titulo, '') || ' ', 2) || chr(10) ELSE '' END || coalesce(resumen, '')), chr(10), ' '), '.', ' ') AS doc FROM proyectos")
def t10(spark, d):
    return table(spark, d, "proyectos").select("referencia", tx.assemble(F.col("titulo"), F.col("resumen"), F.col("titulo_lang"), 2, 1).alias("doc"))


@add("t11_assemble_v2", "SELECT referencia, replace(lower(CASE WHEN titulo_lang = 'es' THEN coalesce(titulo, '') || ' ' ELSE '' END || coalesce(resumen, '')), chr(10), ' ') || ' ' AS doc FROM proyectos")
def t11(spark, d):
    return table(spark, d, "proyectos").select("referencia", tx.assemble(F.col("titulo"), F.col("resumen"), F.col("titulo_lang")).alias("doc"))


@add("t12_display_case", "SELECT referencia, array_to_string(list_transform(list_filter(list_transform(string_split(lower(titulo), '.'), lambda x: trim(x)), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '. ') AS t FROM proyectos WHERE titulo IS NOT NULL")
def t12(spark, d):
    return table(spark, d, "proyectos").filter("titulo IS NOT NULL").select("referencia", tx.display_case(F.col("titulo")).alias("t"))


_CLEAN = "list_filter(list_transform(string_split(label, '++'), lambda x: trim(x)), lambda x: x <> '' AND NOT suffix(x, '_'))"


@add("t13_clean_labels", f"SELECT referencia, ingest_ts, array_to_string(list_transform(list_filter(generate_series(1, len(l)), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), '|') AS labels FROM (SELECT referencia, ingest_ts, {_CLEAN} AS l FROM labelhistory WHERE label IS NOT NULL)")
def t13(spark, d):
    return table(spark, d, "labelhistory").filter("label IS NOT NULL").select("referencia", "ingest_ts", F.array_join(tx.clean_labels(F.col("label"), "++"), "|").alias("labels"))


@add("t13b_code_areas", "SELECT referencia, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(string_split(unesco_cd, ','), lambda x: trim(x, ' ')), lambda x: len(x) >= 2), lambda x: x[1:2]))), ',') AS areas FROM proyectos WHERE unesco_cd IS NOT NULL")
def t13b(spark, d):
    return table(spark, d, "proyectos").filter("unesco_cd IS NOT NULL").select("referencia", F.array_join(tx.code_areas(F.col("unesco_cd")), ",").alias("areas"))


@add("t14_map_codes", r"""WITH o AS (SELECT referencia, list_filter(regexp_split_to_array(regexp_replace(unesco_cd, '\.0*([^0-9]|$)', '\1', 'g'), '[^0-9]+'), lambda x: x <> '') AS c FROM proyectos),
i AS (SELECT referencia, unnest(c) AS code, generate_subscripts(c, 1) AS pos FROM o), m AS (SELECT unesco_cd, min(ford_eq) AS t FROM unesco_codes GROUP BY 1),
j AS (SELECT referencia, pos, coalesce(a.t, b.t) AS t FROM i LEFT JOIN m a ON code::BIGINT = a.unesco_cd LEFT JOIN m b ON code::BIGINT // 100 = b.unesco_cd)
SELECT referencia, string_agg(t, ',' ORDER BY pos) AS mapped FROM (SELECT referencia, t, min(pos) AS pos FROM j WHERE t IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def t14(spark, d):
    m = table(spark, d, "unesco_codes").groupBy("unesco_cd").agg(F.min("ford_eq").alias("ford_eq"))
    return tx.map_codes(table(spark, d, "proyectos"), "referencia", "unesco_cd", m, "unesco_cd", "ford_eq")


_WID = "url"
for _a, _b in (("http://", ""), ("//", ""), ("www.", ""), (".", "_"), ("/", "__")):
    _WID = f"replace({_WID if _WID != 'url' else 'lower(url)'}, '{_a}', '{_b}')"


@add("t15_wid", f"SELECT url, {_WID} AS wid FROM labelhistory WHERE url IS NOT NULL")
def t15(spark, d):
    return table(spark, d, "labelhistory").filter("url IS NOT NULL").select("url", tx.wid(F.col("url")).alias("wid"))


@add("t16_curate_url", "SELECT url, replace(replace(replace(replace(replace(url, '.txt', ''), '_', '.'), 'http://', ''), 'www.', ''), '/', '') AS name FROM labelhistory WHERE url IS NOT NULL")
def t16(spark, d):
    return table(spark, d, "labelhistory").filter("url IS NOT NULL").select("url", tx.curate_url(F.col("url")).alias("name"))


def _any(stems: list[str]) -> str:
    return "(" + " OR ".join(f"contains(b, '{s}')" for s in stems) + ")"


_SEED = "SELECT referencia, (CASE WHEN {n} THEN 'NanoTec|' ELSE '' END) || (CASE WHEN {b} AND {g} THEN 'BioTecAgr|' ELSE '' END) || (CASE WHEN {b} AND {s} THEN 'BioTecSalud|' ELSE '' END) || (CASE WHEN {b} AND {a} THEN 'BioTecAmb|' ELSE '' END) || 'x' AS tags FROM (SELECT referencia, lower(coalesce(titulo, '') || ' ' || coalesce(resumen, '')) AS b FROM proyectos)"


@add("t17_seed_labels", _SEED.format(n=_any(tx.NANOTEC), b=_any(tx.BIOTEC), g=_any(tx.AGRIC), s=_any(tx.SALUD), a=_any(tx.AMBIENTAL)))
def t17(spark, d):
    return table(spark, d, "proyectos").select("referencia", F.array_join(tx.seed_labels(F.array(F.lit("x")), F.col("titulo"), F.col("resumen")), "|").alias("tags"))


@add("t18_display_url", "SELECT url, CASE WHEN starts_with(url, 'http') THEN url WHEN starts_with(url, 'www.') THEN 'http://' || url ELSE 'http://www.' || url END AS shown FROM labelhistory WHERE url IS NOT NULL")
def t18(spark, d):
    return table(spark, d, "labelhistory").filter("url IS NOT NULL").select("url", tx.display_url(F.col("url")).alias("shown"))


@add("stream_window_counts", "SELECT time_bucket(INTERVAL 30 DAY, ingest_ts, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS start, userid, count(*) AS n FROM (SELECT DISTINCT * FROM labelhistory WHERE ingest_ts IS NOT NULL) GROUP BY 1, 2")
def stream(spark, d):
    return history.run_to_table(history.window_counts(history.read_history(spark, f"{d}/labelhistory.parquet")))
