"""Active-learning samples with their probabilities and importance weights."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import sent
from .ranking import global_rank


def tourney_probability(k: Column, n: Column | int, m: int) -> Column:
    """Q1: chance that the row of rank k wins among m players drawn from n: C(n - k, m - 1) / C(n, m), as a product."""
    n = F.lit(n).cast("double") if isinstance(n, int) else n.cast("double")
    if m < 2:
        return F.lit(1.0) / n
    return F.aggregate(F.sequence(F.lit(0), F.lit(m - 2)), F.lit(float(m)) / n, lambda p, j: p * F.greatest(F.lit(0.0), n - k - j) / (n - 1 - j))


def al_scores(df: DataFrame, pred: str, label: str, threshold: float = 0.0) -> DataFrame:
    """Q2: a column al_score, small for what is worth asking: distance to the threshold, for labelled rows agreement with the label."""
    d = F.abs(F.col(pred) - threshold)
    top = df.agg(F.max(F.when(F.col(label) == 0, d)).alias("_top"))  # one row
    joined = df.crossJoin(F.broadcast(top))
    return joined.withColumn("al_score", F.when(F.col(label) == 0, F.coalesce(F.try_divide(d, "_top"), F.lit(0.0))).otherwise(1 - F.abs(F.col(pred) - F.col(label)) / 2)).drop("_top")


def selection_probability(df: DataFrame, key: str, score: str = "al_score", method: str = "tourney", p_al: float = 0.5, players: int = 10) -> DataFrame:
    """Q3: a column p_sel: 1 / n at random, or mixed with the tournament's by rank; ``greedy`` has none."""
    if method == "greedy":
        raise ValueError("a greedy choice has no probabilities")
    n = df.count()
    if method == "random":
        return df.withColumn("p_sel", F.lit(1.0 / max(1, n)))
    ranked = global_rank(df, [F.col(score).asc(), F.col(key).asc()])
    return ranked.withColumn("p_sel", F.lit((1 - p_al) / max(1, n)) + p_al * tourney_probability(F.col("rank"), n + players - 1, players))


def draw_ranks(n: int, count: int, p_al: float = 0.5, players: int = 10, seed: int = 0) -> list[tuple[int, int]]:
    """Q4: (rank, marker) of ``count`` draws without replacement: marker 0 uniform, 1 the best of the players. Driver work on ranks only."""
    rng, gone, out = random.Random(seed), [], []
    for _ in range(min(count, n)):
        left = n - len(gone)
        marker = int(rng.random() < p_al)
        place = min(rng.sample(range(left + players - 1), min(players, left + players - 1))) if marker else rng.randrange(left)
        place = min(place, left - 1)
        for g in sorted(gone):  # place among those left to place among all
            if g <= place:
                place += 1
        gone.append(place)
        out.append((place + 1, marker))
    return out


def queries(df: DataFrame, key: str, pred: str, label: str, count: int, relabel: float = 0.0, p_al: float = 0.5, players: int = 10, seed: int = 0, threshold: float = 0.0) -> DataFrame:
    """Q4: ``count`` rows with rank, marker and relabel; labelled rows are asked again with chance ``relabel``."""
    rng = random.Random(seed)
    again = sum(rng.random() < relabel for _ in range(count))
    scored = al_scores(df, pred, label, threshold)
    parts = []
    for pool, number, flag in ((scored.filter(F.col(label) == 0), count - again, 0), (scored.filter(F.col(label) != 0), again, 1)):
        if number:
            ranked = global_rank(pool, [F.col("al_score").asc(), F.col(key).asc()])
            picks = df.sparkSession.createDataFrame(draw_ranks(pool.count(), number, p_al, players, seed + flag) or [(-1, 0)], "rank bigint, marker int")
            parts.append(ranked.drop("marker", "relabel").join(sent(picks), "rank").withColumn("relabel", F.lit(flag)))  # as many rows as are asked for
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def update_weights(df: DataFrame, weight: str, p_unlabelled: float, labelled: Column, new: Column, p_sel: Column) -> DataFrame:
    """Q5: one new label: labelled rows gain 1 / (n P_unl), the new one gets 1 / (n p_sel)."""
    n = df.count()
    return df.withColumn(weight, F.when(new, 1.0 / (n * p_sel)).when(labelled, F.col(weight) + 1.0 / (n * p_unlabelled)).otherwise(F.col(weight)))


def batch(df: DataFrame, key: str, pred: str, label: str, weight: str, count: int, alphabet: dict[str, int], **options: object) -> DataFrame:
    """Q6: null predictions are 0, labels numbers, null weights of labelled rows 1 / n; then Q4."""
    n = df.count()
    codes = F.create_map(*(x for k, v in alphabet.items() for x in (F.lit(k), F.lit(v))))
    y = F.coalesce(F.try_element_at(codes, F.col(label).cast("string")), F.signum(F.expr(f"try_cast(`{label}` AS int)")).cast("int"), F.lit(0))
    ready = df.withColumn(pred, F.coalesce(pred, F.lit(0.0))).withColumn("_y", y).withColumn(weight, F.when((F.col("_y") != 0) & F.col(weight).isNull(), 1.0 / max(1, n)).otherwise(F.col(weight)))
    return queries(ready, key, pred, "_y", count, **options).drop("_y")


def single(df: DataFrame, key: str, value: object) -> DataFrame:
    """Q7: one item to label again; it must have a marker."""
    return df.filter((F.col(key) == F.lit(value)) & F.col("marker").isNotNull()).withColumn("relabel", F.lit(1))


def simulate(sims: DataFrame, make: Callable[[int], tuple[np.ndarray, np.ndarray]], pools: int, pool: int, p_al: float = 0.5, players: int = 10) -> DataFrame:
    """Q9: (sim, labelled, error, weighted_error) of learning curves, a simulation per task; ``make(sim)`` gives points and labels ±1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for sim in pdf["sim"]:
            x, y = make(int(sim))
            x1, rng = np.c_[x, np.ones(len(x))], np.random.default_rng(int(sim))
            have: list[int] = list(rng.choice(len(x), min(pool, len(x)), replace=False))
            weight = np.full(len(x), 1.0 / len(x))
            for _ in range(pools):
                w = np.zeros(x1.shape[1])
                for _ in range(60):
                    g = x1[have].T @ (y[have] / (1 + np.exp(y[have] * (x1[have] @ w)))) / len(have) - 0.01 * w
                    w += g
                s = x1 @ w
                wrong = np.sign(s) != y
                wt = weight[have]
                out.append((int(sim), len(have), float(wrong.mean()), float((wt * wrong[have]).sum() / wt.sum())))
                rest = sorted(set(range(len(x))) - set(have), key=lambda i: abs(s[i]))
                n = len(rest)
                for r, _ in draw_ranks(n, min(pool, n), p_al, players, int(rng.integers(1 << 30))):
                    have.append(rest[r - 1])
        return pd.DataFrame(out, columns=["sim", "labelled", "error", "weighted_error"])

    return sims.select(F.col("sim").cast("bigint")).groupBy("sim").applyInPandas(run, "sim bigint, labelled bigint, error double, weighted_error double")


def sample_efficiency(a: DataFrame, b: DataFrame, at: str = "n", error: str = "error") -> DataFrame:
    """Q11: (n_a, n_b): for each size of curve a the first size of b with no more than a's running least error. Curves are short."""
    w = Window.partitionBy(F.lit(0)).orderBy(at)
    x = a.select(F.col(at).alias("n_a"), F.min(error).over(w).alias("e"))
    y = b.select(F.col(at).alias("n_b"), F.min(error).over(w).alias("f"))
    return x.join(y, F.col("f") <= F.col("e"), "left").groupBy("n_a").agg(F.min("n_b").alias("n_b"))


def estimate(df: DataFrame, value: Column, p_sel: Column, keys: Sequence[str] = ()) -> DataFrame:
    """The importance-weighted mean that the weights are for."""
    return df.groupBy(*keys).agg((F.sum(value / p_sel) / F.sum(1 / p_sel)).alias("estimate"))
