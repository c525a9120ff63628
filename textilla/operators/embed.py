"""Queries on word vectors: look-ups, analogies, nearest words, kernels between token sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def vector(words: DataFrame, key: str, word: object) -> DataFrame:
    """No row for an unknown word."""
    return words.filter(F.col(key) == F.lit(word))


def _unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v.cast("array<double>"), lambda x: F.try_divide(x, n))


def _asked(words: DataFrame, key: str, vec: str, items: Sequence[object]) -> list[list[float]]:
    rows = {r[0]: r[1] for r in words.filter(F.col(key).isin(list(items))).select(key, _unit(F.col(vec))).collect()}  # the words of one question
    return [rows[i] for i in items if i in rows]


def _array(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def most_similar(words: DataFrame, key: str, vec: str, positive: Sequence[object], negative: Sequence[object] = (), n: int = 10) -> DataFrame:
    """(key, score): cosine with the mean of the unit vectors, signed; the words asked for are left out."""
    pos, neg = _asked(words, key, vec, positive), _asked(words, key, vec, negative)
    mean = [sum(v) / max(1, len(pos) + len(neg)) for v in zip(*(pos + [[-x for x in v] for v in neg]))]
    rest = words.filter(~F.col(key).isin([*positive, *negative]))
    return rest.select(key, dot(_unit(F.col(vec)), _unit(_array(mean))).alias("score")).orderBy(F.desc("score"), key).limit(n)


def most_similar_cosmul(words: DataFrame, key: str, vec: str, positive: Sequence[object], negative: Sequence[object] = (), n: int = 10) -> DataFrame:
    """The product of (1 + cosine) / 2 with positives over that with negatives plus 1e-6."""
    unit = _unit(F.col(vec))
    prod = F.lit(1.0)
    for v in _asked(words, key, vec, positive):
        prod = prod * (1 + dot(unit, _array(v))) / 2
    den = F.lit(1.0)
    for v in _asked(words, key, vec, negative):
        den = den * (1 + dot(unit, _array(v))) / 2
    rest = words.filter(~F.col(key).isin([*positive, *negative]))
    return rest.select(key, (prod / (den + 1e-6)).alias("score")).orderBy(F.desc("score"), key).limit(n)


def closest(words: DataFrame, key: str, vec: str, word: object, m: int) -> DataFrame:
    """(key, d2) of the m nearest words but the word itself; one scan, no sort of all."""
    own = words.filter(F.col(key) == F.lit(word)).select(F.col(vec).alias("_v")).limit(1)
    return words.filter(F.col(key) != F.lit(word)).crossJoin(F.broadcast(own)).select(key, distance2(F.col(vec), F.col("_v")).alias("d2")).orderBy("d2", key).limit(m)  # one row


#: Vectors of a stated set that go to every task at once; numbers of a distance block.
SENT, CELLS = 4096, 1 << 22


def _blocks(df: DataFrame, most: int = SENT) -> Iterator[list]:
    """The rows of a stated set, ``most`` at a time: the driver holds one block, whatever the set's size."""
    rows = []
    for r in df.toLocalIterator():
        rows.append(r)
        if len(rows) == most:
            yield rows
            rows = []
    if rows:
        yield rows


def _distances(x: np.ndarray, q: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of all of x to some of q, block by block."""
    step = max(1, CELLS // max(1, x.size))
    for lo in range(0, len(q), step):
        yield slice(lo, lo + step), ((x[:, None, :] - q[None, lo : lo + step, :]) ** 2).sum(2)


def _union(frames: Iterable[DataFrame], empty: DataFrame) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return empty if out is None else out


def near(queries: DataFrame, rows: DataFrame, key: str, vec: str, m: int, carry: Sequence[str] = (), other: bool = True) -> DataFrame:
    """(q, key, d2, *carry, rank) of the m nearest rows to each of a stated set of queries; ``other`` leaves out the row of the query's own key.

    The queries go to every task in blocks; each batch of rows gives its m nearest to each query (and what ties with
    the last), so that what is ranked in the end is m rows of each batch. Null vectors are far from all.
    """
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *carry)]
    schema = ", ".join([f"q {queries.schema[key].dataType.simpleString()}", *kinds, "d2 double"])
    src = rows.select(key, vec, *carry).filter(F.col(vec).isNotNull())
    sc = rows.sparkSession.sparkContext

    def scan(batches: Iterator[pd.DataFrame], sent) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        for b in (whole.iloc[lo : lo + most] for whole in batches for lo in range(0, len(whole), most)):
            keys = b[key].to_numpy()
            for at, d in _distances(np.stack(b[vec].to_numpy()).astype(np.float64), q):
                if other:
                    d[keys[:, None] == ids[None, at]] = np.inf
                last = np.partition(d, m - 1, 0)[m - 1] if len(d) > m else np.full(d.shape[1], np.finfo(float).max)
                i, j = np.nonzero(np.isfinite(d) & (d <= last))
                yield pd.DataFrame({"q": ids[at][j]} | {c: b[c].to_numpy()[i] for c in (key, *carry)} | {"d2": d[i, j]})

    parts = []
    most = max(1, min(SENT, 4 * CELLS // max(1, queries.agg(F.max(F.size(vec))).first()[0] or 1)))
    for block in _blocks(queries.select(key, vec).filter(F.col(vec).isNotNull()), most):
        sent = sc.broadcast((np.array([r[0] for r in block]), np.array([r[1] for r in block], dtype=np.float64)))
        parts.append(src.mapInPandas(lambda batches, sent=sent: scan(batches, sent), schema))
    found = _union(parts, rows.sparkSession.createDataFrame([], schema))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d2", key))).filter(F.col("rank") <= m)


def nearest_of_each(queries: DataFrame, words: DataFrame, key: str, vec: str, m: int) -> DataFrame:
    """A8 for a stated set of queries against all words, in blocks: (q, key, d2, rank)."""
    return near(queries, words, key, vec, m).select("q", key, "d2", "rank")


def _tokens(df: DataFrame, i: str, t: str, words: DataFrame, key: str, vec: str, how: str) -> DataFrame:
    return df.select(i, F.explode(F.array_distinct("tokens")).alias(t)).join(words.select(F.col(key).alias(t), F.col(vec).cast("array<double>").alias(f"v{t}")), t, how)


def _against(left: DataFrame, right: DataFrame, words: DataFrame, key: str, vec: str, least: bool) -> DataFrame:
    """(lid, rid, a, b, d) of every left token with every token of the right sets, a stated set that goes out in blocks.

    With ``least`` the smallest d of a block alone, without b. d is null where a token is unknown.
    """
    l = _tokens(left, "lid", "a", words, key, vec, "left" if least else "inner")  # noqa: E741
    r = _tokens(right, "rid", "b", words, key, vec, "left" if least else "inner")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    names = ["lid", "rid", "a", *(() if least else ("b",)), "d"]
    schema = ", ".join([f"lid {kind(l, 'lid')}", f"rid {kind(r, 'rid')}", f"a {kind(l, 'a')}", *(() if least else (f"b {kind(r, 'b')}",)), "d double"])
    sc = left.sparkSession.sparkContext

    def scan(batches: Iterator[pd.DataFrame], sent) -> Iterator[pd.DataFrame]:
        rids, tokens, q, start, owners = sent.value
        for whole in batches:
            for lo in range(0, len(whole), 256):
                b = whole.iloc[lo : lo + 256]
                x = np.stack([np.full(q.shape[1], np.nan) if v is None else np.asarray(v, float) for v in b["va"]]) if len(b) else np.zeros((0, q.shape[1]))
                d = np.concatenate([part for _, part in _distances(x, q)], 1)
                if least:
                    d = np.fmin.reduceat(d, start, 1)
                i, j = np.divmod(np.arange(d.size), d.shape[1])
                out = {"lid": b["lid"].to_numpy()[i], "rid": (owners if least else rids)[j], "a": b["a"].to_numpy()[i]}
                yield pd.DataFrame(out | ({} if least else {"b": tokens[j]}) | {"d": pd.array(d.ravel(), dtype="Float64")})[names]

    parts = []
    width = words.select(F.max(F.size(vec))).first()[0] or 1
    for block in _blocks(r.select("rid", "b", "vb").orderBy("rid")):
        rids, tokens = np.array([x[0] for x in block]), np.array([x[1] for x in block])
        q = np.array([[np.nan] * width if x[2] is None else x[2] for x in block], dtype=np.float64)
        start = np.flatnonzero(np.r_[True, rids[1:] != rids[:-1]])
        sent = sc.broadcast((rids, tokens, q, start, rids[start]))
        parts.append(l.select("lid", "a", "va").mapInPandas(lambda batches, sent=sent: scan(batches, sent), schema))
    return _union(parts, left.sparkSession.createDataFrame([], schema))


def kernel(left: DataFrame, right: DataFrame, words: DataFrame, key: str, vec: str, sigma: float) -> DataFrame:
    """(lid, rid, a, b, k) of every known token of a left set and of a right set: exp(-D / sigma), D relative to the mean squared norm.

    left (lid, tokens), right (rid, tokens): right is a stated set, such as categories.
    """
    norm = words.agg(F.avg(dot(F.col(vec), F.col(vec)))).first()[0]
    d = _against(left, right, words, key, vec, False)
    return d.select("lid", "rid", "a", "b", F.exp(-F.abs(F.col("d")) / F.lit(norm).cast("double") / sigma).alias("k"))


def kernel_score(pairs: DataFrame, digits: int = 3) -> DataFrame:
    """(lid, rid, score): the means of both sides' best rounded kernels, added; sets without a known word have no row."""
    k = pairs.withColumn("k", F.bround("k", digits))
    a = k.groupBy("lid", "rid", "a").agg(F.max("k").alias("m")).groupBy("lid", "rid").agg(F.avg("m").alias("x"))
    b = k.groupBy("lid", "rid", "b").agg(F.max("k").alias("m")).groupBy("lid", "rid").agg(F.avg("m").alias("y"))
    return a.join(b, ["lid", "rid"]).select("lid", "rid", (F.col("x") + F.col("y")).alias("score"))


def row_minima(left: DataFrame, right: DataFrame, words: DataFrame, key: str, vec: str) -> DataFrame:
    """(lid, rid, d): the mean over left tokens of the least squared distance to a right one; 9999 for an unknown token."""
    d = _against(left, right, words, key, vec, True)
    per = d.groupBy("lid", "rid", "a").agg(F.min(F.coalesce("d", F.lit(9999.0))).alias("d"))
    return per.groupBy("lid", "rid").agg(F.avg("d").alias("d"))


def kernel_pairs(left: DataFrame, right: DataFrame, words: DataFrame, key: str, vec: str, sigma: float) -> DataFrame:
    """W5 for whole tables: (a, b, k) of every known token of any left set with every one of any right set, each pair once.

    The kernel depends on the tokens alone: the matrix of a left and a right set is the rows of their tokens.
    """
    one = lambda df, i: df.select(F.explode("tokens").alias(i)).distinct().select(i, F.array(i).alias("tokens"))
    return kernel(one(left, "lid"), one(right, "rid"), words, key, vec, sigma).select("a", "b", "k")


def score_sets(left: DataFrame, right: DataFrame, words: DataFrame, key: str, vec: str, sigma: float, digits: int = 3) -> DataFrame:
    """P17 and W6 for whole tables: (lid, rid, score, d) of every left set with every right one, as ``kernel_score`` and ``row_minima``.

    score is null where a set has no known word; sets without tokens have no row. Left sets are read in one pass without a
    shuffle; within a batch each distinct token meets the right tokens once. The right sets, a stated set such as
    categories, and the vectors, a vocabulary that training holds on the driver anyway, go to every task.
    """
    vectors = words.select(F.col(key), F.col(vec).cast("array<double>").alias("v")).collect()
    known = {r[0]: i for i, r in enumerate(vectors)}
    table = np.array([r[1] for r in vectors], dtype=np.float64)
    mean2 = float((table * table).sum(1).mean()) if len(table) else 1.0
    sets = [(r["rid"], len(set(r["tokens"])), sorted({known[t] for t in r["tokens"] if t in known})) for r in right.select("rid", "tokens").filter("size(tokens) > 0").collect()]
    shared = left.sparkSession.sparkContext.broadcast((known, table))
    full = [k for k, x in enumerate(sets) if x[2]]
    columns = np.array([c for k in full for c in sets[k][2]], dtype=np.int64)
    sizes = np.array([len(sets[k][2]) for k in full], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if full else sizes
    partly = np.array([sets[k][1] > len(sets[k][2]) for k in full], dtype=bool)
    rids = [x[0] for x in sets]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, table = shared.value
        rounded = lambda d: np.round(np.exp(-d / mean2 / sigma), digits)
        for batch in batches:
            of = [np.array([known[t] for t in x if t in known], dtype=np.int64) for x in batch["tokens"]]
            used = np.unique(np.concatenate([*of, np.zeros(0, np.int64)]))
            if full and len(used):
                d2 = np.stack([((table[used] - table[c]) ** 2).sum(1) for c in columns], axis=1)
                least = np.minimum.reduceat(d2, starts, axis=1)
                near, far = rounded(least), np.where(partly, np.minimum(least, 9999.0), least)
            score, d = np.full((len(batch), len(sets)), np.nan), np.full((len(batch), len(sets)), 9999.0)
            for i, (own, tokens) in enumerate(zip(of, batch["tokens"])):
                if full and len(own):
                    at = np.searchsorted(used, own)
                    score[i, full] = near[at].mean(0) + np.add.reduceat(rounded(d2[at].min(0)), starts) / sizes
                    d[i, full] = (far[at].sum(0) + 9999.0 * (len(tokens) - len(own))) / len(tokens)
            out = pd.DataFrame({"lid": np.repeat(batch["lid"].to_numpy(), len(sets)), "rid": rids * len(batch), "score": score.ravel(), "d": d.ravel()})
            yield out.astype({"score": object}).where(out.notna(), None)

    kinds = [f"{i} {df.schema[i].dataType.simpleString()}" for df, i in ((left, "lid"), (right, "rid"))]
    return left.select("lid", F.array_distinct("tokens").alias("tokens")).filter("size(tokens) > 0").mapInPandas(run, ", ".join([*kinds, "score double", "d double"]))
