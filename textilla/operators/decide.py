"""Multi-label decisions over long scores (doc, cat, p); ties go to the first category in alphabetical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _doc(key: str) -> Window:
    return Window.partitionBy(key)


def above(scores: DataFrame, thresholds: DataFrame, cat: str = "cat", p: str = "p") -> DataFrame:
    """Scores above their category's threshold, with diff; the table of thresholds has a row per category."""
    return scores.join(thresholds, cat).withColumn("diff", F.col(p) - F.col("threshold")).filter("diff > 0")


def keep_or_best(scores: DataFrame, key: str, threshold: float = 0.0, cat: str = "cat", p: str = "p") -> DataFrame:
    """Scores above the threshold; a document without one keeps its best."""
    w = _doc(key)
    best = F.row_number().over(w.orderBy(F.desc(p), cat))
    x = scores.withColumn("_r", best).withColumn("_any", F.max(F.col(p) > threshold).over(w))
    return x.filter((F.col(p) > threshold) | (~F.col("_any") & (F.col("_r") == 1))).drop("_r", "_any")


def normalise(kept: DataFrame, key: str, p: str = "p") -> DataFrame:
    """P over the document's largest p, which turns the sign if that is negative; null if it is 0."""
    return kept.withColumn("q", F.try_divide(F.col(p), F.max(p).over(_doc(key))))


def ordered(df: DataFrame, key: str, value: str, final: float | None = None, cat: str = "cat") -> DataFrame:
    """(key, labels, values): categories by falling value, in order of their name where tied; values below ``final`` left out."""
    x = df.filter(F.col(value) >= final) if final is not None else df
    got = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(cat).alias("c")))).alias("x"))
    return got.select(key, F.col("x.c").alias("labels"), F.transform("x.v", lambda v: -v).alias("values"))


def decide(scores: DataFrame, key: str, threshold: float = 0.0, final: float = 0.5) -> DataFrame:
    """P2, P3, P4 in a row."""
    return ordered(normalise(keep_or_best(scores, key, threshold), key), key, "q", final)


def labels_from_scores(scores: DataFrame, key: str, threshold: float, p: str = "p") -> DataFrame:
    """Scores over the row's maximum, if that is positive, above ``threshold``, by falling value."""
    top = F.max(p).over(_doc(key))
    return ordered(scores.withColumn("q", F.when(top > 0, F.col(p) / top).otherwise(F.col(p))).filter(F.col("q") > threshold), key, "q")


def blank_other_language(df: DataFrame, lang: str, labels: str, values: str, keep: str = "es") -> DataFrame:
    """Documents in another language, or none, lose their labels."""
    ok = F.coalesce(F.col(lang) == keep, F.lit(False))
    return df.withColumn(labels, F.when(ok, F.col(labels)).otherwise(F.array(F.lit("")))).withColumn(values, F.when(ok, F.col(values)).otherwise(F.array(F.lit(0.0))))


def weight_shares(scores: DataFrame, key: str, p: str = "p") -> DataFrame:
    """(p + 1) / 2 as per cent of the document's sum."""
    half = (F.col(p) + 1) / 2
    return scores.withColumn("share", F.try_divide(half * 100, F.sum(half).over(_doc(key))))


def spread(df: DataFrame, key: str, labels: str, n: int, prefix: str = "Cat_", values: str | None = None, value_prefix: str = "Peso_") -> DataFrame:
    """Lists spread over n columns each, '' and null beyond their end; weights are shown with two decimals."""
    cols = [F.coalesce(F.get(labels, F.lit(i)), F.lit("")).alias(f"{prefix}{i}") for i in range(n)]
    if values:
        cols += [F.when(F.get(values, F.lit(i)).isNotNull(), F.format_string("%4.2f", F.get(values, F.lit(i)))).alias(f"{value_prefix}{i}") for i in range(n)]
    return df.select(key, *cols)


def first_code(df: DataFrame, key: str, labels: str, taxonomy: DataFrame, cat: str = "reference", code: str = "code") -> DataFrame:
    """(key, cat_0, code) of the first label; '' where there is none."""
    one = df.select(key, F.coalesce(F.get(labels, F.lit(0)), F.lit("")).alias("cat_0"))
    return one.join(taxonomy.select(F.col(cat).alias("cat_0"), F.col(code).alias("code")), "cat_0", "left").select(key, "cat_0", F.coalesce("code", F.lit("")).alias("code"))


def prediction_weights(df: DataFrame, values: str) -> Column:
    """Values over their sum."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: F.try_divide(x, total))


def persist_form(df: DataFrame, key: str, labels: str, values: str) -> DataFrame:
    """Labels joined by +, weights as text."""
    return df.select(key, F.array_join(labels, "+").alias("classif"), F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit("]")).alias("weights"))
