"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.registry import Registry
from ..session import cut, table
from . import language
from .garbled import repair_fields
from .leaks import leaks
from .mixing import mix_sources
from .near_dup import near_duplicates
from .pairs import group_pairs, met
from .split_overlap import across_splits, held_out_keys, overlaps
from .subject import subject_areas
from .terms import term_frequencies
from .unify import unify_text

add = Registry()

_TERMS = r"""
WITH t AS (SELECT referencia, unnest(regexp_extract_all(coalesce(titulo, '') || ' ' || coalesce(resumen, ''), '[\p{L}\p{N}]+')) AS w FROM proyectos),
c AS (SELECT lower(w) AS term, count(*)::BIGINT AS n_total, count(DISTINCT referencia)::BIGINT AS n_records FROM t GROUP BY 1)
SELECT term, n_total, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.2 * (SELECT count(*) FROM proyectos) THEN 'common' END AS mark FROM c"""


@add("p5_found", f"SELECT * FROM ({_TERMS}) WHERE mark IS NOT NULL")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(table(spark, sf_dir, "proyectos"), ["titulo", "resumen"]).filter("mark IS NOT NULL")


@add("p5_terms", _TERMS)
def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_frequencies(table(spark, sf_dir, "proyectos"), ["titulo", "resumen"])


@add("p9_mixture")
def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@add("p9_report")
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a character that is not the usual one, mixed tokens without a known reading included."""
    return unify_text(table(spark, sf_dir, "documents")).filter("odd OR n_repaired + n_unknown > 0").select("doc_id").distinct()


@add("p10_unified")
def p10_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify_text(table(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("text_unified"), F.sha2("text", 256).alias("form"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, u = table(spark, sf_dir, "proyectos"), table(spark, sf_dir, "unesco_codes")
    both = p.select(F.lit("proyectos").alias("tbl"), F.col("referencia").alias("rec_key"), F.explode(F.array(*(F.struct(F.lit(f).alias("fld"), F.col(f).alias("text")) for f in ("titulo", "resumen")))).alias("x"))
    return both.select("tbl", "rec_key", "x.fld", "x.text").unionByName(u.select(F.lit("unesco_codes").alias("tbl"), F.col("unesco_cd").cast("string").alias("rec_key"), F.lit("descr").alias("fld"), F.col("descr").alias("text")))


@add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_fields(_fields(spark, sf_dir)).select("tbl", "rec_key", "fld").distinct()


@add("p2_restored")
def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled fields with their text put right; ``whole`` where nothing was lost for good."""
    return repair_fields(_fields(spark, sf_dir)).select("tbl", "rec_key", "fld", "text", "restored", "whole")


@add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped, _ = near_duplicates(table(spark, sf_dir, "proyectos"), "referencia", "resumen")
    return group_pairs(grouped)


@add("p1_groups")
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per project with an abstract of 20 words: its group and the group's number of projects, its class of equal abstracts and the class's number of links to others."""
    grouped, links = near_duplicates(table(spark, sf_dir, "proyectos"), "referencia", "resumen")
    grouped = cut(grouped)
    sizes = grouped.groupBy("grp").agg(F.min("key").alias("first_ref"), F.count("*").alias("n_members"))
    heads = grouped.groupBy("cls").agg(F.min("key").alias("class_ref"))
    linked = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    rows = met(met(met(grouped, sizes, "grp"), heads, "cls"), linked, "cls", "left")
    return rows.select(F.col("key").alias("referencia"), "first_ref", "n_members", "class_ref", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = table(spark, sf_dir, "splits")
    grouped, _, _ = overlaps(table(spark, sf_dir, "proyectos"), "referencia", "resumen", held_out_keys(splits, "referencia"))
    x = across_splits(grouped, splits, "referencia")
    return x.select(F.least("train_key", "eval_key").alias("ref_a"), F.greatest("train_key", "eval_key").alias("ref_b")).distinct()


@add("p7_report")
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out projects that also stand in train, by split and call: projects, pairs, and the mean part of the abstract that a direct link covers."""
    p, splits = table(spark, sf_dir, "proyectos"), table(spark, sf_dir, "splits")
    grouped, members, links = overlaps(p, "referencia", "resumen", held_out_keys(splits, "referencia"))
    x = across_splits(grouped, splits, "referencia")
    cover = links.select(F.col("a").alias("cls"), F.col("cover_a").alias("c")).unionByName(links.select(F.col("b").alias("cls"), F.col("cover_b").alias("c"))).groupBy("cls").agg(F.max("c").alias("c"))
    held = met(members, cover, "cls", "left").select(F.col("key").alias("eval_key"), F.coalesce("c", F.lit(1.0)).alias("c"))
    call = p.select(F.col("referencia").alias("eval_key"), "cconv")
    per = met(met(x.groupBy("eval_key", "eval_split").agg(F.count("*").alias("n")), held, "eval_key"), call, "eval_key")
    return per.groupBy("eval_split", "cconv").agg(F.count("*").alias("n_projects"), F.sum("n").alias("n_pairs"), F.avg("c").alias("mean_cover"))


@add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).filter("stretch >= 24").select("item_id", "doc_id").distinct()


@add("p8_coverage")
def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the operator with a fifth of the item tiled in any order, passages set in another order included."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).filter("coverage >= 0.2")


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "proyectos")
    both = p.select("referencia", F.explode(F.array(*(F.struct(F.lit(f).alias("fld"), F.col(f).alias("text"), F.col(f"{f}_lang").alias("label"), F.col(f"{o}_lang").alias("other")) for f, o in (("titulo", "resumen"), ("resumen", "titulo"))))).alias("x"))
    both = both.select(F.concat_ws("|", "x.fld", "referencia").alias("key"), "x.text", "x.label", "x.other")
    net = language.trained(*language.sample(both, "text", "label", "other"))
    found = language.identify(both, "key", "text", "label", net, F.startswith("key", F.lit("titulo|")))
    return found.select(F.expr("substring(key, instr(key, '|') + 1)").alias("referencia"), F.substring_index("key", "|", 1).alias("fld"), "seg", "lang", "confidence", "n_segs", "recorded")


@add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of the texts whose label is missing or wrong, or that are in more than one language."""
    return _languages(spark, sf_dir).filter("n_segs > 1 OR recorded IS NULL OR recorded != lang").select("referencia", "fld", "seg", "lang")


@add("p4_languages")
def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "unesco_codes").select(F.col("descr").alias("text"), F.col("ford_eq").alias("area"))
    return subject_areas(table(spark, sf_dir, "proyectos"), table(spark, sf_dir, "labels_info"), table(spark, sf_dir, "taxonomy"), codes)


@add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir).select("referencia", "area").distinct()


@add("p6_composition")
def p6_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make-up of the corpus: projects per area, each project shared among its areas, and the mean posterior."""
    a = _areas(spark, sf_dir)
    per = a.groupBy("referencia").agg(F.count("*").alias("k"))
    return met(a, per, "referencia").groupBy("area").agg(F.count("*").alias("n_projects"), F.sum(1 / F.col("k")).alias("weight"), F.avg("posterior").alias("mean_posterior"))
