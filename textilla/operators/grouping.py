"""Fuzzy groups of coordinated records: shape, block, ratio, lists, consolidation, representative."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut


def shape(ref: Column) -> Column:
    """G1: letters as ``a`` but for one right behind a hyphen, digits as ``0``, hyphens kept, anything else as ``?``."""
    out = F.regexp_replace(ref, r"[^\p{L}\p{N}\-]", "?")
    return F.regexp_replace(F.regexp_replace(out, r"(?<!-)\p{L}", "a"), r"\p{N}", "0")


def indel_ratio(a: str, b: str, least: float = 0.0) -> float:
    """G2': (L - d) / L for insertions and deletions only, by a bit-parallel longest common subsequence."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    if a == b:
        return 1.0
    if 2 * min(len(a), len(b)) < least * total:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    common = len(a) - v.bit_count()
    return 2 * common / total


#: Pairs that are rated at a time, columns between two looks at what can still be reached, bytes of a batch's masks.
PAIRS, LOOK, MASKS = 8192, 64, 1 << 27


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes of all characters one after the other, starts, lengths, number of codes)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    every, code = np.unique(flat, return_inverse=True)
    return code, np.cumsum(size) - size, size, len(every)


def _common(texts: list[str], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common subsequences of the texts a[k] and b[k]; -1 where more than ``most[k]`` insertions and deletions are needed.

    Bit-parallel over all pairs at once, within the band of diagonals that ``most`` leaves: a match beyond it is on no
    path of so few steps. A pair ends as soon as each place that it may have reached needs more.
    """
    own, back = np.unique(np.r_[a, b], return_inverse=True)
    code, start, size, kinds = _codes([texts[x] for x in own])
    a, b = back[: len(a)], back[len(a) :]
    la, lb = size[a], size[b]
    band = int(((most + np.abs(la - lb)) // 2).max()) + 1
    wide, rows = -(-(2 * band + 1) // 64) + 1, np.unique(a)
    words = int(la.max()) // 64 + int(lb.max()) // 64 + wide + 2
    masks = np.zeros((len(rows), kinds + 1, words), np.uint64)
    for k, x in enumerate(rows):
        i = np.arange(size[x])
        np.bitwise_or.at(masks[k], (code[start[x] : start[x] + size[x]], i >> 6), np.uint64(1) << (i & 63).astype(np.uint64))
    masks = masks.ravel()
    line = np.searchsorted(rows, a) * (kinds + 1)
    live, out = np.arange(len(a)), np.full(len(a), -1, np.int64)
    v, done, lo = np.full((wide, len(a)), ~np.uint64(0)), np.zeros(len(a), np.int64), 0
    for c in range(int(lb.max())):
        if (c - band) // 64 > lo:
            done += 64 - np.bitwise_count(v[0]).astype(np.int64)
            v = np.concatenate([v[1:], np.full((1, len(live)), ~np.uint64(0))])
            lo += 1
        kind = np.where(c < lb[live], code[np.minimum(start[b[live]] + c, len(code) - 1)], kinds)
        at = (line[live] + kind) * words + lo
        carry = np.zeros(len(live), np.uint64)
        for w in range(wide):
            u = v[w] & masks.take(at + w)
            x = v[w] + u
            y = x + carry
            carry = ((x < u) | (y < carry)).astype(np.uint64)
            v[w] = y | (v[w] - u)
        if c % LOOK == LOOK - 1:
            zeros = 1 - np.unpackbits(np.ascontiguousarray(v.T).view(np.uint8), axis=1, bitorder="little")
            reached = done[:, None] + np.concatenate([np.zeros((len(live), 1), np.int32), np.cumsum(zeros, 1, dtype=np.int32)], 1)
            x, y = la[live][:, None], lb[live][:, None]
            i, j = np.minimum(lo * 64 + np.arange(wide * 64 + 1), x), np.minimum(c + 1, y)
            least = (i + j - 2 * reached + np.abs((x - i) - (y - j))).min(1)
            stay = np.flatnonzero(least <= most[live])
            if len(stay) < len(live):
                live, v, done = live[stay], v[:, stay], done[stay]
            if not len(live):
                return out
    common = done + (64 - np.bitwise_count(v).astype(np.int64)).sum(0)
    fits = la[live] + lb[live] - 2 * common <= most[live]
    out[live[fits]] = common[fits]
    return out


def rate(texts: list[str], a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """``indel_ratio`` of the texts a[k] and b[k] where it is above ``ratio``, else 0."""
    size = np.array([len(t) for t in texts], np.int64)
    total = size[a] + size[b]
    out = np.zeros(len(a))
    most = np.floor((1 - ratio) * total + 1e-6).astype(np.int64)
    code, start, length, kinds = _codes(texts)
    bags = np.zeros((len(texts), 64), np.int32)
    np.add.at(bags, (np.repeat(np.arange(len(texts)), length), code % 64), 1)
    use = np.concatenate([x[np.abs(bags[a[x]] - bags[b[x]]).sum(1) <= most[x]] for x in np.array_split(np.arange(len(a)), len(a) // 65_536 + 1)])
    use = use[np.lexsort((a[use], size[a[use]]))]  # pairs of one text stand together: their masks stay near
    per = (kinds + 1) * (int(size.max(initial=0)) // 32 + 8) * 8  # bytes of a text's masks, at most
    if per > MASKS:  # a long text of many signs
        out[use] = [indel_ratio(texts[i], texts[j], ratio) for i, j in zip(a[use], b[use])]
        return np.where(out > ratio, out, 0.0)
    place = np.cumsum(np.r_[True, a[use][1:] != a[use][:-1]]) if len(use) else use
    lo = 0
    while lo < len(use):
        hi = min(lo + PAIRS, int(np.searchsorted(place, place[lo] + MASKS // per)))
        x = use[lo:hi]
        common = _common(texts, a[x], b[x], most[x])
        out[x] = np.where(common >= 0, 2 * common / np.maximum(total[x], 1), 0.0)
        lo = hi
    return np.where(out > ratio, out, 0.0)


#: The shapes of references that are compared, and the length of the prefix that two of a shape must share.
COMPARED = {
    "aaaa0000-00000": 8,
    "aaaa0000-000-C00-00": 8,
    "aaaa-0000-000-C00-00": 9,
    "aaaa-0000-000": 9,
    "aaa0000-00000-Caa": 7,
    "aaa0000-00000-Eaa": 7,
    "aaa0000-00000-C0-0-P": 7,
    "aaa0000-00000-C0-0-R": 7,
    "aaa0000-00000-E": 7,
    "aaa0000-00000-C00-00": 7,
}


def _compared(df: DataFrame, ref: str, text: str, prefixes: dict[str, int] | None) -> DataFrame:
    """(ref, shape, t, n, size, pre) of the records of the compared shapes: stripped text and its length as it is compared."""
    lengths = F.create_map(*(x for k, v in (prefixes or COMPARED).items() for x in (F.lit(k), F.lit(v))))
    body = F.trim(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")))
    base = df.select(F.col(ref).alias("ref"), shape(F.col(ref)).alias("shape"), F.trim(F.coalesce(text, F.lit(""))).alias("t"), F.length(body).alias("n"))
    return base.withColumn("size", F.try_element_at(lengths, "shape")).filter("size IS NOT NULL").withColumn("pre", F.substring("ref", F.lit(1), F.col("size")))


def candidate_pairs(df: DataFrame, ref: str, text: str, prefixes: dict[str, int] | None = None, gap: int = 50, shortest: int = 10) -> DataFrame:
    """(i, j, a, b) of records of one of the compared shapes that share its prefix and whose lengths differ by under ``gap``.

    ``prefixes`` has the prefix length of each shape (``COMPARED``); other shapes are not compared. The first text
    must be longer than ``shortest``. A length bucket of the width of the gap joins the block key, so that a large
    block falls into many tasks; neighbours of a bucket are reached by a second row.
    """
    base = _compared(df, ref, text, prefixes)
    base = base.withColumn("bucket", F.floor(F.col("n") / gap))
    i = base.filter(F.col("n") > shortest).select(F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), "shape", "pre", F.col("ref").alias("i"), F.col("t").alias("a"), F.col("n").alias("ni"))
    j = base.select("bucket", "shape", "pre", F.col("ref").alias("j"), F.col("t").alias("b"), F.col("n").alias("nj"))
    return i.join(j, ["shape", "pre", "bucket"]).filter((F.col("i") != F.col("j")) & (F.abs(F.col("ni") - F.col("nj")) < gap)).select("i", "j", "a", "b")


def similar_pairs(pairs: DataFrame, ratio: float = 0.9) -> DataFrame:
    """(i, j, ratio) above ``ratio``; equal texts and lengths that can't reach it are decided before Python."""
    total = F.length("a") + F.length("b")
    near = pairs.filter(2 * F.least(F.length("a"), F.length("b")) > F.lit(ratio) * total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"i": x["i"], "j": x["j"], "ratio": [indel_ratio(a, b, ratio) for a, b in zip(x["a"], x["b"])]})

    rated = near.filter("a != b").mapInPandas(run, "i string, j string, ratio double").filter(F.col("ratio") > ratio)
    return near.filter("a = b").select("i", "j", F.lit(1.0).alias("ratio")).unionByName(rated)


#: Texts of a block or cell that are compared in one task.
CELL = 1024


def coordinated_pairs(df: DataFrame, ref: str, text: str, ratio: float = 0.9, prefixes: dict[str, int] | None = None, gap: int = 50, shortest: int = 10) -> DataFrame:
    """``similar_pairs`` of ``candidate_pairs``, with equal texts of a block compared once and each two texts in one direction.

    Texts, not pairs of them, travel. A block of more than ``CELL`` texts is cut by length, as wide as the gap, and what is
    then still larger into cells of two hashed parts; a task holds one cell.
    """
    base = _compared(df, ref, text, prefixes)
    base = cut(base.select("ref", "shape", "pre", "n", "t", F.xxhash64("shape", "pre", "t").alias("id")))
    texts = base.select("id", "shape", "pre", "n", "t").dropDuplicates(["id"])
    light = base.select("id", "shape", "pre", "n").distinct()
    block = light.groupBy("shape", "pre").agg((F.count("*") > CELL).alias("large"))
    bucket = F.when(F.col("large"), F.floor(F.col("n") / gap)).otherwise(F.lit(0)).cast("bigint")
    part = ["shape", "pre", "bucket"]
    spread = light.join(block, ["shape", "pre"]).withColumn("bucket", bucket)
    both = spread.select("id", *part, F.lit(True).alias("own")).unionByName(spread.filter("large").select("id", "shape", "pre", (F.col("bucket") + 1).alias("bucket"), F.lit(False).alias("own")))
    k = both.groupBy(*part).agg(F.max("own").alias("any"), F.ceil(F.count("*") / CELL).cast("int").alias("k")).filter("any").drop("any")
    placed = both.join(k, part)
    turn = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    h = F.pmod(F.col("id"), F.col("k")).cast("int")
    sides = placed.filter("own").select("id", *part, h.alias("x"), turn.alias("y"), F.lit(0).alias("side")).unionByName(placed.select("id", *part, turn.alias("x"), h.alias("y"), F.when(F.col("own"), 1).otherwise(2).alias("side")))
    cells = sides.groupBy("id", *part, "x", "y").agg(F.sum(F.expr("CASE side WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END")).alias("side"))
    sent = cells.select("id", "side", F.xxhash64(*part, "x", "y").alias("cell")).join(texts.select("id", F.col("n").cast("bigint").alias("n"), F.length("t").cast("bigint").alias("size"), "t"), "id")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), base.count() // CELL + 1)  # stated: a cell's work grows faster than its bytes
    sent = sent.repartition(parts, "cell").sortWithinPartitions("cell", "n")

    def met(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of a cell whose lengths are near enough, about a million looked at at a time."""
        ids, n, side, size = (rows[c].to_numpy() for c in ("id", "n", "side", "size"))
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 6)
        first, last = np.searchsorted(n[right], n[left] - gap, "right"), np.searchsorted(n[right], n[left] + gap, "left")
        total = np.r_[0, np.cumsum(last - first)]
        at = 0
        while at < len(left):
            end = max(at + 1, int(np.searchsorted(total, total[at] + 1_000_000, "right")) - 1)
            span = (last - first)[at:end]
            i = np.repeat(left[at:end], span)
            j = right[np.repeat(first[at:end], span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)]
            low = (side[j] & 4) > 0  # of the bucket before: the pair is met here alone; two of one bucket are met twice
            use = (low | (ids[i] < ids[j])) & (np.maximum(n[i], n[j]) > shortest) & (2 * np.minimum(size[i], size[j]) > ratio * (size[i] + size[j]))
            yield i[use], j[use]
            at = end

    def rated(cells: list[tuple[pa.Table, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        start = np.cumsum([0, *(len(rows) for rows, _, _ in cells)])
        rows = pa.concat_tables([rows for rows, _, _ in cells])
        ids, i, j = rows["id"].to_numpy(), *(np.concatenate([x[k] + lo for x, lo in zip(cells, start)]) for k in (1, 2))
        r = rate(rows["t"].to_pylist(), i, j, ratio)
        hit = r > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[i[hit]]), pa.array(ids[j[hit]]), pa.array(r[hit])], ["p", "q", "ratio"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        ready: list[tuple[pa.Table, np.ndarray, np.ndarray]] = []

        def compare() -> Iterator[pa.RecordBatch]:
            """Small cells are rated together."""
            for i, j in met(rows := pa.concat_tables(held)):
                if ready and (sum(len(x[1]) for x in ready) + len(i) > 100_000 or sum(len(x[0]) for x in ready) + len(rows) > 4 * CELL):
                    yield rated(ready)
                    ready.clear()
                if len(i):
                    ready.append((rows, i, j))
            held.clear()

        for b in batches:
            cell = b["cell"].to_numpy()
            edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
            for lo, hi in zip(edge, [*edge[1:], len(cell)]):
                if held and held[0]["cell"][0].as_py() != cell[lo]:
                    yield from compare()
                held.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
        if held:
            yield from compare()
        if ready:
            yield rated(ready)

    found = cut(sent.mapInArrow(run, "p bigint, q bigint, ratio double"))
    known = base.select("id", "ref", "n")
    pairs = found.unionByName(found.select(F.col("q").alias("p"), F.col("p").alias("q"), "ratio"))
    pairs = pairs.unionByName(light.filter((F.col("n") > shortest)).select(F.col("id").alias("p"), F.col("id").alias("q"), F.lit(1.0).alias("ratio")))
    i = known.filter(F.col("n") > shortest).select(F.col("id").alias("p"), F.col("ref").alias("i"))
    return pairs.join(i, "p").join(known.select(F.col("id").alias("q"), F.col("ref").alias("j")), "q").filter("i != j").select("i", "j", "ratio")


def lists(pairs: DataFrame) -> DataFrame:
    """(members): each record with its matches, sorted, every list once."""
    both = pairs.groupBy("i").agg(F.collect_set("j").alias("js"))
    return both.select(F.array_sort(F.array_union(F.array("i"), "js")).alias("members")).distinct()


def consolidate(groups: DataFrame) -> DataFrame:
    """Each list united with the last list, in their order, that shares a member, itself included; then distinct.

    Lists meet by their members, not pairwise. Its closure is ``connected_groups``.
    """
    held = groups.select("members", F.explode("members").alias("m"))
    last = held.groupBy("m").agg(F.max("members").alias("last"))
    best = held.join(last, "m").groupBy("members").agg(F.max("last").alias("last"))
    return best.select(F.array_sort(F.array_union("members", "last")).alias("members")).distinct()


def year_of(ref: Column) -> Column:
    """Four characters from the first digit on, as a number."""
    return F.try_to_number(F.regexp_extract(ref, r"(\d.{3})", 1), F.lit("9999")).cast("int")


def representatives(groups: DataFrame) -> DataFrame:
    """(ref, group_ref): the first member stands for a list; of several lists of a record the last one wins."""
    return groups.select(F.explode("members").alias("ref"), F.col("members")[0].alias("rep"), "members").groupBy("ref").agg(F.max_by("rep", "members").alias("group_ref"))


def assign(df: DataFrame, key: str, reps: DataFrame) -> DataFrame:
    """(key, group_ref nullable, group_key): a record without a list is its own group."""
    out = df.select(key).join(reps.select(F.col("ref").alias("_r"), "group_ref"), F.col(key) == F.col("_r"), "left")
    return out.select(key, "group_ref", F.coalesce("group_ref", key).alias("group_key"))


def connected_groups(pairs: DataFrame) -> DataFrame:
    """The closure that G4 is meant to be: (ref, group_ref) by minima that travel along links, and jump along roots, until nothing changes."""
    edges = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()
    state = cut(edges.select(F.col("i").alias("ref")).distinct().withColumn("group_ref", F.col("ref")))
    while True:
        low = edges.join(state, edges["j"] == state["ref"]).groupBy("i").agg(F.min("group_ref").alias("low"))
        step = state.join(low, state["ref"] == low["i"], "left").select("ref", F.least("group_ref", F.coalesce("low", "group_ref")).alias("group_ref"), F.col("group_ref").alias("old"))
        jump = step.select(F.col("ref").alias("g"), F.col("group_ref").alias("gg"))
        new = cut(step.join(jump, step["group_ref"] == jump["g"], "left").select("ref", F.least("group_ref", F.coalesce("gg", "group_ref")).alias("group_ref"), "old"))
        state = new.select("ref", "group_ref")
        if new.filter("group_ref != old").isEmpty():
            return state
