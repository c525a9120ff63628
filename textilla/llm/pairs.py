"""What the operators on pairs of similar texts share: shingles, rarity, sketches for lossless filters, components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import cut, uncut
from .textnorm import rolling, take, word_numbers

#: Bits of the sketch in 64-bit numbers: for two texts of n and m shingles, of which h bits of their sketches
#: differ, no more than (n + m - h) / 2 shingles can be shared.
LANES = 16
#: Shingles that a task counts, on average; frequencies from which all count as equally common; members of a block;
#: numbers that are sent to every task at most, of which 16 MB make a table.
PER_TASK, COMMON, BLOCK, SENT = 2_000_000, 4096, 1024, 500_000
#: Bytes a row, and at least in all, that travel in a turn.
TURN, LEAST_TURN = 900, 256_000_000
#: Pairs that a task makes at a time; blocks of the rows of a common token.
PAIRS, CELLS = 1_000_000, 8


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A merge join: no side that grows with the corpus is broadcast, whatever an estimate says of arrays and exploded rows."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def sketches(shingles: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, LANES): each shingle flips one bit of its owner's sketch."""
    bits = np.bincount(owner * (LANES * 64) + ((shingles.view(np.uint64) >> np.uint64(20)) % np.uint64(LANES * 64)).astype(np.int64), minlength=n * LANES * 64)
    return np.packbits((bits & 1).astype(np.uint8).reshape(n, LANES * 64), axis=1).view(np.int64)


def source(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, key, text) of the rows with key and text; rid tells rows of one key with different texts apart."""
    src = df.select(df[key].cast("string").alias("key"), df[text].cast("string").alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")
    return src.select(F.xxhash64("key", "text").alias("rid"), "key", "text")


def read(batches: Iterator[pd.DataFrame], k: int, min_words: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray], list[np.ndarray]]]:
    """(rows, word numbers, hashes of k words in a row) of the texts that take part: those of ``min_words`` words."""
    for whole in batches:
        for lo in range(0, len(whole), 1000):
            b = whole.iloc[lo : lo + 1000]
            w, offs = word_numbers(b["text"].tolist())
            r = rolling(w, k)
            use = np.flatnonzero(np.diff(offs) >= max(min_words, k))
            if len(use):
                yield b.iloc[use], [w[offs[i] : offs[i + 1]].view(np.int64) for i in use], [r[offs[i] : offs[i + 1] - k + 1] for i in use]


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]]


def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all numbers, list of each, length of each list)."""
    size = np.array([len(x) for x in lists], np.int64)
    return np.concatenate(lists), np.repeat(np.arange(len(lists)), size), size


def collapse(src: DataFrame, k: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members, heads): texts with the same shingles are one class, of which one text, the head, goes on; members: (rid, key, cls).

    Only numbers are written: who needs a text's shingles reads the text again, which takes less than to keep them.
    However many copies a text has, they meet in a minimum that is taken map-side first. heads: (rid, text).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, _, r in read(batches, k, min_words):
            sets = [distinct(x) for x in r]
            copies = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
            yield pd.DataFrame({"rid": b["rid"].to_numpy(np.int64), "key": b["key"].to_numpy(object), "cls_hash": np.array(copies, np.int64), "n": np.array([len(x) for x in sets], np.int32)})

    light = cut(src.mapInPandas(run, "rid bigint, key string, cls_hash bigint, n int").distinct())
    first = light.groupBy("cls_hash", "n").agg(F.min("rid").alias("cls"))
    members = cut(met(light, first, ["cls_hash", "n"]).select("rid", "key", "cls"))
    uncut(light)
    others = members.filter("rid != cls").select("rid")
    if others.count() <= SENT:
        heads = src.join(F.broadcast(others), "rid", "left_anti")
    else:
        heads = only(src, members.filter("rid = cls").select("rid"), "rid")
    repeated = cut(src.groupBy("rid").agg(F.count("*").alias("n")).filter("n > 1").select("rid"))
    if not repeated.isEmpty():
        again = only(src, repeated, "rid")
        few = repeated.count() <= SENT
        heads = (heads.join(F.broadcast(repeated), "rid", "left_anti") if few else met(heads, repeated, "rid", "left_anti")).unionByName(met(again.dropDuplicates(["rid"]), members.filter("rid = cls").select("rid"), "rid", "left_semi"))
    return members, heads.select("rid", "text")


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.uint32)


def counted(heads: DataFrame, k: int, min_words: int, places: bool = False) -> tuple[int, Broadcast]:
    """(bits, table): for every bucket of ``bits`` bits the number of texts that hold a shingle of it, ``COMMON`` at most.

    It takes part in an order of the shingles that is the same for all texts, and tells which ones no other text
    holds: a count is never too low, so 1 is exact, and shingles that share a bucket only look more common. The
    table grows with the corpus up to 64 MB. With ``places`` shingles that repeat in a text count again.
    """
    spark = heads.sparkSession
    bits = int(np.clip(np.ceil(np.log2(max(1, heads.count()) * 64)), 16, 25))
    own = min(bits, max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(held: list[np.ndarray]) -> pd.DataFrame:
            ids = np.sort(np.concatenate(held))
            start, times = _runs(ids)
            ids, times = ids[start], np.minimum(times, COMMON).astype(np.uint16)
            edge = np.searchsorted(ids, np.arange((1 << own) + 1, dtype=np.int64) << (bits - own))
            return pd.DataFrame([(i, ids[a:z].tobytes(), times[a:z].tobytes()) for i, (a, z) in enumerate(zip(edge[:-1], edge[1:])) if z > a], columns=["part", "ids", "times"])

        held, n = [], 0
        for _, _, r in read(batches, k, min_words):
            held.append(bucket(np.concatenate(r if places else [distinct(x) for x in r]), bits))
            n += len(held[-1])
            if n > 2 * PER_TASK:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, ids, times in zip(b["part"], b["ids"], b["times"]):
                x = sums.setdefault(i, np.zeros(1 << (bits - own), np.int32))
                at = np.frombuffer(ids, np.uint32) - np.uint32(i << (bits - own))
                x[at] = np.minimum(x[at] + np.frombuffer(times, np.uint16), COMMON)
        yield pd.DataFrame([(i, x.astype(np.uint16).tobytes()) for i, x in sums.items()], columns=["part", "times"])

    table = np.zeros(1 << bits, np.uint16)
    sums = cut(heads.mapInPandas(part, "part int, ids binary, times binary").repartition(1 << own, "part").mapInPandas(total, "part int, times binary"))
    for x in sums.toLocalIterator():
        table[x["part"] << (bits - own) : (x["part"] + 1) << (bits - own)] = np.frombuffer(x["times"], np.uint16)
    uncut(sums)
    return bits, spark.sparkContext.broadcast(table)


def _slots(df: DataFrame, parts: int) -> np.ndarray:
    """For each of ``parts`` partitions a number that hash partitioning sends there."""
    spark = df.sparkSession
    got = spark.range(parts * 40, numPartitions=1).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(parts)).alias("p")).agg(F.min("v").alias("v")).collect()
    out = np.arange(parts, dtype=np.int32)
    for r in got:
        out[r["p"]] = r["v"]
    return out


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal numbers."""
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(owner)])


_TOKENS = "slot int, id binary, n binary, flag binary, sig binary, size binary, h binary"


def _within(h: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which numbers are among ``some``, which are sorted."""
    return some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h if len(some) else np.zeros(len(h), bool)


def meet(tokens: DataFrame, share: float, among: np.ndarray | None = None) -> DataFrame:
    """(a, b), a < b: every two rows that share a token, unless sizes or sketches prove that they can't match; one of them asks.

    tokens (id, n, tokens binary of 32-bit numbers, hot, asks boolean, sig binary or null): the last ``hot`` of a
    row's tokens are common. Rows travel in arrays by token, with their sketch once for each partition. In a
    partition the rows of a token stand by size, so that those that can match are a range; pairs are made range by
    range, ``PAIRS`` at a time, and filtered before the next ones are made: no task holds all pairs of a token. The
    rows of a common token are cut into ``CELLS`` blocks, and each two blocks meet in a cell of their own, which
    spreads its work over tasks. ``among`` are the tokens of the rows that ask, sorted, where they are few: no
    others travel. Tokens take turns, so that what is on disk at a time stays near ``TURN`` bytes a row.
    """
    spark = tokens.sparkSession
    sent = spark.sparkContext.broadcast(among)

    def travelling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = np.frombuffer(b"".join(b["tokens"]), np.uint32)
            n = int(_within(h, sent.value).sum()) if sent.value is not None else len(h)
            yield pd.DataFrame({"n": [n + (CELLS - 1) * int(b["hot"].sum())], "rows": [len(b)]})

    total, rows = tokens.select("tokens", "hot").mapInPandas(travelling, "n bigint, rows bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    turns = max(1, -(-total * (LANES * 8 + 32) // max(LEAST_TURN, rows * TURN)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (turns * PER_TASK)))
    slots = _slots(tokens, parts)

    def mixed(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(31))

    def spread(batches: Iterator[pd.DataFrame], turn: int) -> Iterator[pd.DataFrame]:
        few = None if sent.value is None else sent.value.astype(np.int64)
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                b = whole.iloc[lo : lo + 2000]
                size = np.array([len(x) // 4 for x in b["tokens"]])
                if not size.sum():
                    continue
                h, owner = np.frombuffer(b"".join(b["tokens"]), np.uint32).astype(np.int64), np.repeat(np.arange(len(b)), size)
                common = np.concatenate([np.arange(k, 0, -1) for k in size]) <= b["hot"].to_numpy()[owner]
                if few is not None:
                    use = _within(h, few)
                    h, owner, common = h[use], owner[use], common[use]
                ids = b["id"].to_numpy(np.int64)
                if common.any():
                    block = (mixed(ids.view(np.uint64)) % np.uint64(CELLS)).astype(np.int64)[owner[common]].repeat(CELLS)
                    other = np.tile(np.arange(CELLS), common.sum())
                    cell = (np.minimum(block, other) * CELLS + np.maximum(block, other) + 1).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        split = mixed(h[common].view(np.uint64).repeat(CELLS) + cell * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    h, owner = np.r_[h[~common], split], np.r_[owner[~common], owner[common].repeat(CELLS)]
                at = mixed(h.view(np.uint64))
                if turns > 1:
                    use = at % np.uint64(turns) == turn
                    h, owner, at = h[use], owner[use], at[use]
                at = (at // np.uint64(turns) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(at.astype(np.uint16) if parts < 65_536 else at, kind="stable")  # owners rise already, but for those of common tokens
                if common.any():
                    order = np.lexsort((owner, at))
                at, owner, h = at[order], owner[order], h[order]
                start, length = _runs(at * len(b) + owner)
                own, where = owner[start], at[start]
                sig = np.frombuffer(b"".join(x or bytes(LANES * 8) for x in b["sig"]), np.int64).reshape(-1, LANES)
                n, flag = b["n"].to_numpy(np.int32), b["asks"].to_numpy(bool).astype(np.int8) | b["sig"].notna().to_numpy(bool).astype(np.int8) << 1
                edge = np.r_[np.flatnonzero(np.r_[True, where[1:] != where[:-1]]), len(where)] if len(where) else np.zeros(1, np.int64)
                ends, length = np.r_[0, np.cumsum(length)], length.astype(np.int32)
                rows = [(int(slots[where[a]]), ids[own[a:z]].tobytes(), n[own[a:z]].tobytes(), flag[own[a:z]].tobytes(), sig[own[a:z]].tobytes(), length[a:z].tobytes(), h[ends[a] : ends[z]].tobytes()) for a, z in zip(edge[:-1], edge[1:])]
                yield pd.DataFrame(rows, columns=["slot", "id", "n", "flag", "sig", "size", "h"])

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [[np.frombuffer(b"".join(b[c]), t) for c, t in (("id", np.int64), ("n", np.int32), ("flag", np.int8), ("sig", np.uint64), ("size", np.int32), ("h", np.int64))] for b in batches]
        if not got:
            return
        ids, n, flag, sig, size, h = (np.concatenate(x) for x in zip(*got))
        n, sig, asks, known = n.astype(np.int64), sig.reshape(-1, LANES), (flag & 1) > 0, (flag & 2) > 0
        owner = np.repeat(np.arange(len(ids)), size)
        order = np.lexsort((n[owner], h))
        h, owner = h[order], owner[order]
        start, length = _runs(h)
        use = np.repeat((length > 1) & np.logical_or.reduceat(asks[owner], start), length) if len(h) else np.zeros(0, bool)
        h, owner = h[use], owner[use]
        start, length = _runs(h)
        group = np.repeat(np.arange(len(start)), length)
        wide = int(n.max()) + 1
        key = group * wide + n[owner]
        most = np.minimum(np.floor((n[owner] + 1e-9) / share), wide - 1).astype(np.int64)
        ends = np.searchsorted(key, group * wide + most, "right")
        rest = n - 2 * np.ceil(n * share - 1e-9).astype(np.int64)
        done = np.zeros(0, np.int64)
        lanes = [np.ascontiguousarray(sig[:, x : x + 4]) for x in range(0, LANES, 4)]
        every = bool(asks.all())
        # with few that ask, those alone look for others, smaller ones too
        seek = np.arange(len(owner)) if every else np.flatnonzero(asks[owner])
        low = seek + 1 if every else np.searchsorted(key, (group * wide)[seek] + np.ceil(n[owner[seek]] * share - 1e-9).astype(np.int64))
        for i, j in _ranges(low, ends[seek] - low):
            i = seek[i]
            if not every:
                new = (j > i) | ~asks[owner[j]]
                i, j = i[new], j[new]
            a, b = owner[np.minimum(i, j)], owner[np.maximum(i, j)]
            room = n[a] + rest[b]  # b is the larger one
            if not known.all():
                room = np.where(known[a] & known[b], room, 2 * LANES * 64)
            for lane in lanes:  # most pairs differ by too much within the first ones
                bits = np.bitwise_count(lane.take(a, 0) ^ lane.take(b, 0)).view(np.uint32).ravel()
                room -= (bits * np.uint32(0x01010101)) >> np.uint32(24)  # the sum of four counts; 256 reads as 0, which drops nothing
                stay = np.flatnonzero(room >= 0)
                a, b, room = a[stay], b[stay], room[stay]
            key = np.setdiff1d((np.minimum(a, b) * len(ids) + np.maximum(a, b))[ids[a] != ids[b]], done)
            if len(key):
                done = np.union1d(done, key)
                x, y = ids[key // len(ids)], ids[key % len(ids)]
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    found = []
    for turn in range(turns):
        sent_rows = tokens.select("id", "n", "tokens", "hot", "asks", "sig").mapInPandas(partial(spread, turn=turn), _TOKENS).repartition(parts, "slot")
        found.append(cut(sent_rows.mapInPandas(pairs, "a bigint, b bigint").distinct()))
    return reduce(DataFrame.unionByName, found).distinct()


def _ranges(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for the places i and the ``count[i]`` places j from ``first[i]`` on, about ``PAIRS`` of them at a time."""
    total = np.cumsum(count)
    at = 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        i = np.arange(at, end)
        if end == at + 1 and count[at] > PAIRS:
            for lo in range(0, int(count[at]), PAIRS):
                j = np.arange(first[at] + lo, first[at] + min(int(count[at]), lo + PAIRS))
                yield np.full(len(j), at), j
        else:
            yield np.repeat(i, count[i]), take(first[i], count[i])
        at = end


def only(table: DataFrame, ids: DataFrame, on: str = "cls") -> DataFrame:
    """The rows of ``table`` whose number is among ``ids``: sent to the table if they are few, else met by a merge join."""
    if ids.count() <= SENT:
        return table.join(F.broadcast(ids), on, "left_semi")
    return met(table, ids, on, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of ``edges`` (a, b): root is a component's smallest node.

    Alternating large-star and small-star steps, in a number of rounds that grows with the logarithm of the
    longest chain. A node's neighbours are never collected: a minimum goes out and is joined back.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = met(both.filter("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = large.filter("u != v").distinct()
        low = kept.groupBy("u").agg(F.min("v").alias("m"))
        joined = met(kept, low, "u")
        e = cut(joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))).filter("u != v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def groups(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, grp, cls): members of one component, or of one class with several members, share a group."""
    root = components(edges).select(F.col("node").alias("cls"), "root")
    return met(members, root, "cls", "left").select("key", F.coalesce("root", "cls").alias("grp"), "cls")


def blocked(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` x ``right`` within each grp, columns named apart: block by block, so that no task has all pairs of a large group.

    A group's block numbers follow from its size; members fall into blocks by the hash of their key.
    """
    both = left.select("grp", "key").unionByName(right.select("grp", "key")) if left is not right else left
    sizes = both.groupBy("grp").agg((F.floor((F.count("*") - 1) / BLOCK) + 1).cast("int").alias("blocks")).filter("blocks > 1")

    def cells(side: DataFrame, own: str, other: str, salt: int) -> DataFrame:
        x = met(side, sizes, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return x.withColumn(own, F.pmod(F.xxhash64("key", F.lit(salt)), F.col("blocks"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1))).drop("blocks")

    return met(cells(left, "bi", "bj", 1).withColumnRenamed("key", "key_a"), cells(right, "bj", "bi", 2).withColumnRenamed("key", "key_b"), ["grp", "bi", "bj"]).drop("bi", "bj")


def group_pairs(grouped: DataFrame) -> DataFrame:
    """(ref_a, ref_b) of every two keys of one group, the smaller first by code point."""
    many = cut(grouped.select("grp", "key").distinct())
    return blocked(many, many).filter("key_a < key_b").select(F.col("key_a").alias("ref_a"), F.col("key_b").alias("ref_b")).distinct()
