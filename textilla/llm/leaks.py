"""Evaluation texts leaking into training text: greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .textnorm import latin_looks, plain_characters, rolling, take, word_hashes, words

#: Words of a block of items, which goes to every task; places of an item where shared seeds begin, at least.
MAX_SENT, SHARED = 400_000, 4
SEED, TILE = 5, 3
_broken = re.compile(r"(?<=[^\W\d_])[-­‐‑][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_end = re.compile("[\r\n]")


def read(text: str | None) -> list[str]:
    """Words without regard to case, accents, spacing, line ends within a word, and characters that look alike or are unseen."""
    if not text:
        return []
    if _end.search(text):
        text = _broken.sub("", text)
    plain = plain_characters(text)
    if plain is not text and _end.search(plain):
        plain = _broken.sub("", plain)
    return words(latin_looks(plain))


def tiles(a: np.ndarray, b: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the tiles of two lists of word hashes: greedy string tiling, longest first.

    Running Karp-Rabin: the hashes of ``least`` words rolled over both texts meet; equal ones in a row on a diagonal
    are a longest match. The longest match whose words are all free is marked, again and again; what a marked tile
    leaves of a match goes back among the others. Of equal lengths the first in a, then in b, is marked.
    """
    ha, hb = rolling(a, least), rolling(b, least)
    at = np.argsort(hb, kind="stable")
    low, high = np.searchsorted(hb[at], ha), np.searchsorted(hb[at], ha, "right")
    i, j = np.repeat(np.arange(len(ha)), high - low), at[take(low, high - low)]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    edge = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1), True]) if len(i) else np.zeros(1, np.int64)
    heap = [(-n - least + 1, x, y) for n, x, y in zip(np.diff(edge).tolist(), i[edge[:-1]].tolist(), j[edge[:-1]].tolist())]
    heapq.heapify(heap)
    marked_a, marked_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out: list[tuple[int, int, int]] = []
    while heap:
        n, x, y = heapq.heappop(heap)
        taken = marked_a[x : x - n] | marked_b[y : y - n]
        if not taken.any():
            marked_a[x : x - n] = marked_b[y : y - n] = True
            out.append((x, y, -n))
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True]))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= least:
                heapq.heappush(heap, (s - e, x + s, y + s))
    return out


def longest_part(same: np.ndarray, span: int, unchanged: float) -> int:
    """Length of the longest part of at least ``span`` places of which ``unchanged`` are set, or 0; in linear memory."""
    run = np.r_[0, np.cumsum(same)] - unchanged * np.arange(len(same) + 1)
    reach = np.maximum.accumulate(run[::-1])[::-1]  # the highest from here on: the last place that is no lower
    last = np.searchsorted(-reach, -(run - 1e-9), "right") - 1
    longest = int((last - np.arange(len(run))).max())
    return longest if longest >= span else 0


def _common(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b (short lists)."""
    if not a or not b:
        return []
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def held_stretch(item: list[int], doc: list[int], found: list[tuple[int, int, int]], span: int = 24, unchanged: float = 0.9) -> int:
    """Words of the longest stretch of at least ``span`` item words that the document holds in order, or 0.

    Tiles that follow each other closely in both texts are chained (an item gap of 12 words, a document gap of
    24); between two of them, and at the ends, the longest common subsequence is unchanged, too.
    """
    if len(item) < span:
        return 0
    found = sorted(found)
    score, back = [t[2] for t in found], [-1] * len(found)
    for x, (i, j, n) in enumerate(found):
        for y in range(x - 1, -1, -1):
            p, q, m = found[y]
            if 0 <= i - (p + m) <= 12 and 0 <= j - (q + m) <= 24 and score[y] + n > score[x]:
                score[x], back[x] = score[y] + n, y
    longest = 0
    inner = set(back)
    for x in range(len(found)):
        if x in inner or score[x] * 2 < span:
            continue
        path, at = [], x
        while at >= 0:
            path.append(found[at])
            at = back[at]
        path.reverse()
        same = np.zeros(len(item), np.int64)
        for i, _, n in path:
            same[i : i + n] = 1
        for (i, j, n), (p, q, _) in zip(path, path[1:]):
            same[[i + n + u for u in _common(item[i + n : p], doc[j + n : q])]] = 1
        i, j, _ = path[0]
        for u in _common(item[max(0, i - 6) : i], doc[max(0, j - 6) : j]):
            same[max(0, i - 6) + u] = 1
        i, j, n = path[-1]
        for u in _common(item[i + n : i + n + 6], doc[j + n : j + n + 6]):
            same[i + n + u] = 1
        longest = max(longest, longest_part(same, span, unchanged))
    return longest


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, word hashes) of the items, in blocks of about ``most`` words."""
    rows: list = []
    size = 0
    for r in items.toLocalIterator():
        w = read(r["text"])
        if len(w) >= SEED:
            rows.append((r["item_id"], w))
            size += len(w)
        if size >= most:
            yield _hashed(rows)
            rows, size = [], 0
    if rows:
        yield _hashed(rows)


def _hashed(rows: list) -> tuple[list, list[np.ndarray]]:
    hashes, offs = word_hashes([w for _, w in rows])
    return [r[0] for r in rows], [hashes[offs[x] : offs[x + 1]] for x in range(len(rows))]


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text", most: int = MAX_SENT) -> DataFrame:
    """(item_id, doc_id, stretch, coverage, n_tiles) of the pairs of item and document that share ``SHARED`` places of the item where a seed of 5 words begins, and 12 tiled words.

    coverage is the part of the item that tiles cover in any order, which shows reordered passages. stretch is the
    number of words of the longest stretch of at least 24 item words of which tiles that follow each other, and
    what is unchanged between them, cover nine in ten, else 0. 24 words with two changed ones have 8 unchanged in a
    row, where four seeds begin, so that no such stretch is missed. Null and empty texts have no pairs; a repeated
    key gives a row per text; other columns are not read; empty tables give no rows.

    The items are a stated set: they go to every task in blocks of ``most`` words, and each block is held against
    all documents in one pass without a shuffle, however many items there are.
    """
    d = docs.select(docs[doc_key].alias("doc_id"), docs[text].cast("string").alias("text")).filter("text IS NOT NULL")
    i = items.select(items[item_key].alias("item_id"), items[item_text].cast("string").alias("text")).filter("text IS NOT NULL")
    dt, it = d.schema["doc_id"].dataType.simpleString(), i.schema["item_id"].dataType.simpleString()
    schema = f"item_id {it}, doc_id {dt}, stretch int, coverage double, n_tiles int"
    columns = ["item_id", "doc_id", "stretch", "coverage", "n_tiles"]

    def scan(batches: Iterator[pd.DataFrame], sent) -> Iterator[pd.DataFrame]:
        ids, own = sent.value
        rolled = [rolling(w, SEED) for w in own]
        seeds, owner = np.concatenate(rolled), np.repeat(np.arange(len(own)), [len(r) for r in rolled])
        place = np.concatenate([np.arange(len(r)) for r in rolled])
        order = np.argsort(seeds, kind="stable")
        seeds, owner, place = seeds[order], owner[order], place[order]
        slot = lambda h: (h.view(np.uint64) >> np.uint64(44)).astype(np.int64)
        some = np.zeros(1 << 20, bool)
        some[slot(seeds)] = True
        widest = max(len(w) for w in own)
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                b = whole.iloc[lo : lo + 1000]
                hs, at = word_hashes([read(t) for t in b["text"]])
                keys, rows = b["doc_id"].tolist(), []
                h = rolling(hs, SEED)
                hit = np.flatnonzero(some[slot(h)])
                low = np.searchsorted(seeds, h[hit])
                hit = hit[seeds[np.minimum(low, len(seeds) - 1)] == h[hit]]
                doc = np.searchsorted(at, hit, "right") - 1
                hit, doc = hit[hit + SEED <= at[doc + 1]], doc[hit + SEED <= at[doc + 1]]
                low, high = np.searchsorted(seeds, h[hit]), np.searchsorted(seeds, h[hit], "right")
                pick = take(low, high - low)
                pair = np.repeat(doc, high - low) * len(own) + owner[pick]
                pair, n = np.unique(np.unique(pair * widest + place[pick]) // widest, return_counts=True)
                for x, y in zip(*divmod(pair[n >= SHARED], len(own))):
                    item, w = own[y], hs[at[x] : at[x + 1]]
                    got = tiles(item, w)
                    covered = sum(t[2] for t in got)
                    if covered * 2 >= 24:
                        rows.append((ids[y], keys[x], held_stretch(item.tolist(), w.tolist(), got), covered / len(item), len(got)))
                yield pd.DataFrame(rows, columns=columns)

    sc, out = docs.sparkSession.sparkContext, None
    for block in _blocks(i, most):
        sent = sc.broadcast(block)
        got = d.mapInPandas(lambda batches, sent=sent: scan(batches, sent), schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
