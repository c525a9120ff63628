"""Exact evaluation metrics as window functions and array expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import sent
from .ranking import running_sums


# Curves


def roc(scores: DataFrame, cat: str = "cat", score: str = "score", positive: str = "y") -> DataFrame:
    """(cat, thr, tpr, fpr, tp, fp, p, n) at every distinct score, ties in one point, and a first point (0, 0) at max + 1.

    Rows are summed up per score map-side, then over ranges of scores: a category's distinct scores need not fit
    into one task. p and n are a point's own rows. A class without rows gives null rates.
    """
    per = scores.filter(F.col(score).isNotNull() & F.col(cat).isNotNull()).groupBy(cat, F.col(score).alias("thr")).agg(F.count_if(F.col(positive) > 0).alias("p"), F.count_if(F.col(positive) <= 0).alias("n"))
    first = per.groupBy(cat).agg((F.max("thr") + 1).alias("thr"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("n"))
    run = running_sums(per.unionByName(first), [cat], [F.desc("thr")], ["p", "n"])
    return run.select(cat, "thr", F.try_divide("run_p", "all_p").alias("tpr"), F.try_divide("run_n", "all_n").alias("fpr"), F.col("run_p").alias("tp"), F.col("run_n").alias("fp"), "p", "n")


def auc(curve: DataFrame, cat: str = "cat") -> DataFrame:
    """(cat, auc) by trapezoids; null where a class is empty. Each point of ``roc`` knows the step that leads to it."""
    area = F.col("n").cast("double") * (2 * F.col("tp") - F.col("p")) / 2
    return curve.groupBy(cat).agg(F.try_divide(F.sum(area), F.max("tp") * F.max("fp").cast("double")).alias("auc"))


def best_threshold(curve: DataFrame, cat: str = "cat") -> DataFrame:
    """(cat, threshold): the first, highest one with the largest tpr + 1 - fpr."""
    return curve.groupBy(cat).agg(F.max_by("thr", F.struct(F.col("tpr") + 1 - F.col("fpr"), "thr")).alias("threshold"))


def first_tag(df: DataFrame, labels: str, categories: DataFrame, cat: str = "reference") -> DataFrame:
    """A row per category with y = 1 if the first label is it, else -1; categories are a small fixed table."""
    return df.crossJoin(sent(categories.select(F.col(cat).alias("cat")))).withColumn("y", F.when(F.coalesce(F.get(labels, F.lit(0)) == F.col("cat"), F.lit(False)), 1).otherwise(-1))


def weighted_curve(df: DataFrame, pred: str, label: str, weight: Column | None = None) -> DataFrame:
    """(thr, nfn, ntn, nfp, ntp): weights of positives and negatives below or at each prediction, and above it.

    Predictions are summed up over their ranges, not in one task.
    """
    wt = weight if weight is not None else F.lit(1.0)
    per = df.filter(F.col(pred).isNotNull()).groupBy(F.col(pred).alias("thr")).agg(F.sum(F.when(F.col(label) > 0, wt).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) < 0, wt).otherwise(0.0)).alias("n"))
    run = running_sums(per, [], [F.asc("thr")], ["p", "n"])
    return run.select("thr", F.col("run_p").alias("nfn"), F.col("run_n").alias("ntn"), (F.col("all_n") - F.col("run_n")).alias("nfp"), (F.col("all_p") - F.col("run_p")).alias("ntp"))


def marked_curve(df: DataFrame, pred: str, label: str, marker: str = "marker") -> DataFrame:
    """E17 over the rows drawn at random alone."""
    return weighted_curve(df.filter(F.col(marker) == 0), pred, label)


def balanced_threshold(curve: DataFrame) -> DataFrame:
    """The first threshold where false positives and false negatives are nearest."""
    return curve.agg(F.min_by("thr", F.struct(F.abs(F.col("nfp") - F.col("nfn")), "thr")).alias("threshold"))


def proportions(df: DataFrame, label: str = "y", marker: str = "marker", weight: str = "weight") -> DataFrame:
    """Share of positives overall, of rows drawn at random, and by weight."""
    pos = F.col(label) > 0
    return df.agg(F.avg(pos.cast("double")).alias("overall"), F.avg(F.when(F.col(marker) == 0, pos.cast("double"))).alias("random"), F.try_divide(F.sum(F.when(pos, F.col(weight)).otherwise(0.0)), F.sum(weight)).alias("weighted"))


# Confusion


def confusion(df: DataFrame, truth: str, pred: str, categories: Sequence[str]) -> DataFrame:
    """(t, p, n) over all pairs of the given categories, empty cells too; other rows are left out."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in categories for b in categories], "t string, p string")
    n = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(n, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def pair_confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(t, p, n): a document counts once for each pair of a true and a predicted label."""
    return df.select(F.explode(truth).alias("t"), pred).select("t", F.explode(pred).alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))


def _weights(labels: str, by_order: bool) -> Column:
    """Label to weight: 1, 1/2, 1/4.. or equal, summing to 1; of a repeated label the weights add up."""
    raw = F.transform(F.col(labels), lambda x, i: F.struct(x.alias("c"), (F.pow(F.lit(0.5), i) if by_order else F.lit(1.0)).alias("w")))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x["w"])
    return F.transform(raw, lambda x: F.struct(x["c"].alias("c"), (x["w"] / total).alias("w")))


def mass_confusion(df: DataFrame, key: str, truth: str, pred: str, by_order: bool = True) -> DataFrame:
    """E5: (t, p, mass): what both lists give a label lies on the diagonal, the rest is shared out over the residuals.

    Every document with both lists has a mass of 1; others have none.
    """
    use = df.filter((F.size(truth) > 0) & (F.size(pred) > 0))
    side = lambda c, n: use.select(key, F.explode(_weights(c, by_order)).alias("x")).groupBy(key, F.col("x.c").alias("c")).agg(F.sum("x.w").alias(n))
    both = side(truth, "wp").join(side(pred, "wq"), [key, "c"], "full_outer").na.fill(0.0, ["wp", "wq"])
    same = both.withColumn("m", F.least("wp", "wq")).withColumn("rp", F.col("wp") - F.col("m")).withColumn("rq", F.col("wq") - F.col("m"))
    rest = same.groupBy(key).agg((1 - F.sum("m")).alias("rest"))
    diagonal = same.select(F.col("c").alias("t"), F.col("c").alias("p"), F.col("m").alias("mass"))
    t, p = same.filter("rp > 1e-12").select(key, F.col("c").alias("t"), "rp"), same.filter("rq > 1e-12").select(key, F.col("c").alias("p"), "rq")
    off = t.join(p, key).join(rest.filter("rest > 1e-12"), key).select("t", "p", (F.col("rp") * F.col("rq") / F.col("rest")).alias("mass"))
    return diagonal.unionByName(off).groupBy("t", "p").agg(F.sum("mass").alias("mass")).filter("mass > 0")


def ranked_errors(cells: DataFrame, value: str = "n") -> DataFrame:
    """Off-diagonal cells with their share of the total and of their row, in per cent, and both ranks; empty rows are left out."""
    whole, row = Window.partitionBy(F.lit(0)), Window.partitionBy("t")
    x = cells.withColumn("pct", F.try_divide(100.0 * F.col(value), F.sum(value).over(whole))).withColumn("row_pct", F.try_divide(100.0 * F.col(value), F.sum(value).over(row))).filter("t != p AND row_pct IS NOT NULL")
    return x.withColumn("rank_abs", F.row_number().over(whole.orderBy(F.desc("pct"), "t", "p"))).withColumn("rank_rel", F.row_number().over(whole.orderBy(F.desc("row_pct"), "t", "p")))


def error_rate(cells: DataFrame, value: str = "n") -> DataFrame:
    """1 - trace / sum."""
    return cells.agg((1 - F.try_divide(F.sum(F.when(F.col("t") == F.col("p"), F.col(value)).otherwise(0)), F.sum(value))).alias("error"))


# Lists


def cardinality(df: DataFrame, labels: str) -> DataFrame:
    """Mean number of distinct labels, and that over the number of labels in use."""
    distinct = df.select(F.explode(labels).alias("c")).agg(F.count_distinct("c").alias("nl"))
    mean = df.agg(F.avg(F.size(F.array_distinct(labels))).alias("cardinality"))
    return mean.crossJoin(distinct).select("cardinality", F.try_divide("cardinality", "nl").alias("density"))  # one row by one row


def jaccard(a: str, b: str) -> Column:
    """Null for two empty lists."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def _prefix(ranks: Column, d: Column) -> Column:
    """Items of the first d ranks; ties are arrays."""
    return F.array_distinct(F.flatten(F.slice(ranks, F.lit(1), d)))


def agreement(a: Column, b: Column, d: Column) -> Column:
    """2 |A and B| / (|A| + |B|) of the first d ranks, for arrays of tie groups."""
    x, y = _prefix(a, d), _prefix(b, d)
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def overlap(a: Column, b: Column, d: Column) -> Column:
    return agreement(a, b, d) * F.least(d, F.size(a), F.size(b))


def _series(last: Column, term) -> Column:
    """Sum of term(d) for d = 1 to last."""
    return F.when(last >= 1, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), term), F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)


def ties(labels: str) -> Column:
    """A plain ranking as tie groups of one."""
    return F.transform(labels, lambda x: F.array(x))


def average_overlap(a: Column, b: Column, depth: Column | None = None) -> Column:
    k = depth if depth is not None else F.least(F.size(a), F.size(b))
    return F.try_divide(_series(k, lambda d: agreement(a, b, d)), k)


def rbo_at_k(a: Column, b: Column, p: float) -> Column:
    return (1 - p) * _series(F.least(F.size(a), F.size(b)), lambda d: F.pow(F.lit(p), d - 1) * agreement(a, b, d))


def rbo_min(a: Column, b: Column, p: float) -> Column:
    """The lower bound of rank-biased overlap (Webber et al. 2010, equation 11)."""
    k = F.least(F.size(a), F.size(b))
    x = overlap(a, b, k)
    return (1 - p) / p * (_series(k, lambda d: F.pow(F.lit(p), d) / d * (overlap(a, b, d) - x)) - x * math.log(1 - p))


def rbo_res(a: Column, b: Column, p: float) -> Column:
    """The residual beyond what was seen (equation 30)."""
    s, n = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    x = overlap(a, b, n)
    f = F.ceil(n + s - x).cast("int")
    part = lambda k: _series(f, lambda d: F.when(d > k, F.pow(F.lit(p), d) / d).otherwise(0.0))
    t3 = x * (math.log(1 / (1 - p)) - part(F.lit(0)))
    return F.pow(F.lit(p), s) + F.pow(F.lit(p), n) - F.pow(F.lit(p), f) - (1 - p) / p * (s * part(s) + n * part(n) + t3)


def rbo_ext(a: Column, b: Column, p: float) -> Column:
    """The point estimate by extrapolation (equation 32)."""
    s, n = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    xl, xs = overlap(a, b, n), overlap(a, b, s)
    one = _series(n, lambda d: F.pow(F.lit(p), d) * agreement(a, b, d))
    two = _series(n, lambda d: F.when(d > s, F.pow(F.lit(p), d) * xs * (d - s) / s / d).otherwise(0.0))
    return (1 - p) / p * (one + two) + F.pow(F.lit(p), n) * ((xl - xs) / n + xs / s)


def ranks_from_scores(df: DataFrame, key: str, item: str, score: str) -> DataFrame:
    """(key, ranks): items by falling score, equal scores in one tie group."""
    group = df.groupBy(key, score).agg(F.array_sort(F.collect_list(item)).alias("g"))
    return group.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "g"))).alias("x")).select(key, F.col("x.g").alias("ranks"))


def identity_rbo(n: int, p: float) -> float:
    """The lower bound of a list of n compared with itself."""
    return (1 - p) / p * (sum(p**d / d * (d - n) for d in range(1, n + 1)) - n * math.log(1 - p)) if n else 0.0


def jrbo_cost(a: str, b: str, alpha: float = 0.9, p: float = 0.9, tabled: int = 48) -> Column:
    """Jaccard and rank-biased cost, weighed by alpha, halved; two empty lists cost 0, one empty list counts as 1 in both parts.

    What a list has with itself is looked up for ``tabled`` lengths and summed up for longer ones.
    """
    table = F.array(*(F.lit(identity_rbo(n, p)) for n in range(1, tabled + 1)))
    n = F.least(F.size(a), F.size(b))
    longer = (1 - p) / p * (_series(n, lambda d: F.pow(F.lit(p), d) / d * (d - n)) - n * math.log(1 - p))
    r = 1 - rbo_min(ties(a), ties(b), p) / F.when(n <= tabled, F.get(table, n - 1)).otherwise(longer)
    j = 1 - jaccard(a, b)
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a & empty_b, 0.0).when(empty_a | empty_b, 0.5).otherwise((alpha * j + (1 - alpha) * r) / 2)


#: The thresholds that are tried.
THRESHOLDS = [0.999, 0.99, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0, -0.05, -0.1, -0.15]


def threshold_costs(scores: DataFrame, truth: DataFrame, key: str, thresholds: Sequence[float] = THRESHOLDS, alpha: float = 0.9, p: float = 0.9) -> DataFrame:
    """(threshold, cost, gap) per threshold: mean E12 and the squared difference of mean label numbers.

    The ordered, normalised list of a document is made once; each threshold cuts it. truth (key, labels).
    """
    from .decide import keep_or_best, normalise, ordered

    full = ordered(normalise(keep_or_best(scores, key, 0.0), key), key, "q")
    both = full.withColumnsRenamed({"labels": "pred", "values": "v"}).join(truth.select(key, "labels"), key)
    cutoff = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    tried = both.withColumn("threshold", cutoff).withColumn("cut", F.transform(F.filter(F.arrays_zip("pred", "v"), lambda x: x["v"] >= F.col("threshold")), lambda x: x["pred"]))
    # documents with the same two lists cost the same: the array work is done once per pair of lists
    alike = tried.groupBy("threshold", "labels", "cut").agg(F.count("*").alias("n"))
    mean = lambda c: F.sum(c * F.col("n")) / F.sum("n")
    cost = alike.groupBy("threshold").agg(mean(jrbo_cost("labels", "cut", alpha, p)).alias("cost"), mean(F.size("cut")).alias("np"), mean(F.size("labels")).alias("nt"))
    return cost.select("threshold", "cost", F.pow(F.col("np") - F.col("nt"), 2).alias("gap"))


def choose_threshold(costs: DataFrame) -> DataFrame:
    """The mean of the first thresholds with the least cost and the least gap."""
    first = lambda c: F.min_by("threshold", F.struct(c, -F.col("threshold")))
    return costs.agg(((first("cost") + first("gap")) / 2).alias("threshold"))


def nearest_point(costs: DataFrame, chosen: DataFrame) -> DataFrame:
    """A column nearest, true for the grid point next to the chosen threshold, the higher one of two; the grid is a small fixed table."""
    at = chosen.select(F.col("threshold").alias("_t"))
    gap = F.round(F.abs(F.col("threshold") - F.col("_t")), 9)
    w = Window.partitionBy(F.lit(0)).orderBy(gap, -F.col("threshold"))
    return costs.crossJoin(F.broadcast(at)).withColumn("nearest", F.row_number().over(w) == 1).drop("_t")  # one row


def block_emd(df: DataFrame, key: str, truth: str, pred: str, parents: DataFrame) -> DataFrame:
    """(key, emd) under a cost of 0 within a parent category and 1 across: 1 - sum of min(P, Q) over parents."""
    side = lambda c, n: df.filter((F.size(truth) > 0) & (F.size(pred) > 0)).select(key, F.explode(_weights(c, False)).alias("x")).join(parents, F.col("x.c") == F.col("cat")).groupBy(key, "parent").agg(F.sum("x.w").alias(n))
    both = side(truth, "p").join(side(pred, "q"), [key, "parent"], "full_outer").na.fill(0.0, ["p", "q"])
    return both.groupBy(key).agg((1 - F.sum(F.least("p", "q"))).alias("emd"))


def transport(p: np.ndarray, q: np.ndarray, cost: np.ndarray) -> float:
    """The least cost of moving p to q, by successive shortest paths in the residual network."""
    p, q = p.astype(float).copy(), q.astype(float).copy()
    n, m = len(p), len(q)
    flow, total = np.zeros((n, m)), 0.0
    while p.sum() > 1e-12 and q.sum() > 1e-12:
        dist = np.full(n + m, np.inf)
        prev = np.full(n + m, -1)
        dist[:n][p > 1e-12] = 0
        for _ in range(n + m):
            old = dist.copy()
            via = dist[:n, None] + cost
            best = via.argmin(0)
            for j in range(m):
                if via[best[j], j] < dist[n + j] - 1e-12:
                    dist[n + j], prev[n + j] = via[best[j], j], best[j]
            for i, j in zip(*np.nonzero(flow > 1e-12)):
                if dist[n + j] - cost[i, j] < dist[i] - 1e-12:
                    dist[i], prev[i] = dist[n + j] - cost[i, j], n + j
            if np.array_equal(old, dist):
                break
        open_q = np.flatnonzero(q > 1e-12)
        end = n + open_q[dist[n:][open_q].argmin()]
        path, at = [end], int(end)
        while prev[at] >= 0:
            at = int(prev[at])
            path.append(at)
        path.reverse()
        amount = min(p[path[0]], q[end - n])
        for a, b in zip(path, path[1:]):
            if a >= n:
                amount = min(amount, flow[b, a - n])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a, b - n] += amount
                total += amount * cost[a, b - n]
            else:
                flow[b, a - n] -= amount
                total -= amount * cost[b, a - n]
        p[path[0]] -= amount
        q[end - n] -= amount
    return total


def emd(df: DataFrame, key: str, truth: str, pred: str, categories: Sequence[str], similarity: np.ndarray | Sequence[np.ndarray]) -> DataFrame:
    """(key, emd) under cost 1 - similarity; of several matrices the least cost of each cell. Documents are independent: no shuffle."""
    mats = [similarity] if isinstance(similarity, np.ndarray) and similarity.ndim == 2 else list(similarity)
    cost = 1 - np.maximum.reduce(mats)
    slot = {c: i for i, c in enumerate(categories)}
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, q in zip(b["t"], b["q"]):
                x, y = [slot[c] for c in t if c in slot], [slot[c] for c in q if c in slot]
                out.append(transport(np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y)), cost[np.ix_(x, y)]) if x and y else None)
            yield pd.DataFrame({key: b[key], "emd": pd.array(out, dtype="Float64")})

    return df.select(key, F.col(truth).alias("t"), F.col(pred).alias("q")).filter((F.size("t") > 0) & (F.size("q") > 0)).mapInPandas(run, f"`{key}` {kind}, emd double")


def compare_labels(labels: DataFrame, records: DataFrame, key: str, left: str, right: str, parents: DataFrame, single: bool = False) -> dict[str, DataFrame]:
    """Two codings of the same records compared: cells (E5, by order and equal), ranked errors, error rate, earth-mover distance.

    Records without one of the lists, or with an item of level 1 in either, are left out.
    """
    from .relational import label_pairs, without_level_1

    both = without_level_1(label_pairs(labels, records, key, left, right, single), left, right)
    cells = mass_confusion(both, key, left, right)
    return {
        "cells": cells,
        "cells_equal": mass_confusion(both, key, left, right, False),
        "ranked": ranked_errors(cells, "mass"),
        "error": error_rate(cells, "mass"),
        "emd": block_emd(both, key, left, right, parents),
    }
