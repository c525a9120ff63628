"""Several values packed in one field: split into one row per value, its position kept.

The splitter works on the Arrow string buffers: quote parity and delimiter masks are computed over the
whole batch's bytes at once, child offsets follow from them, a list array is built and flattened with the
ordinals of its parents. No Python loop runs over rows or values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BLANKS = b" \t\r\n\x0b\x0c"


@dataclass(frozen=True)
class Dialect:
    """delimiters: bytes that end a value outside quotes. dash: a hyphen between blanks ends a value, too."""

    delimiters: bytes = b",;|/+\n\r\t"
    dash: bool = True
    quotes: bytes = b"\"'"
    brackets: bytes = b"[]{}"


#: Codes hold no blanks, so that a blank parts them; names of categories do.
CODES = Dialect(delimiters=b",;|/+\n\r\t ")
LABELS = Dialect()


def _in(data: np.ndarray, chars: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars)] = True
    return lut[data]


def split_packed(col: pa.Array, dialect: Dialect = LABELS) -> pa.ListArray:
    """The values of each string, in order; null and blank strings give an empty list."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    size = len(data)
    if not size:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    row = np.repeat(np.arange(n), np.diff(offs))
    first, last = offs[row], offs[row + 1] - 1
    at = np.arange(size)
    blank = _in(data, BLANKS)
    # a bracket pair round the whole field, of the kind that may also belong to a name
    seen = np.flatnonzero(~blank)
    if len(seen):
        heads = seen[np.r_[True, row[seen[1:]] != row[seen[:-1]]]]
        tails = seen[np.r_[row[seen[1:]] != row[seen[:-1]], True]]
        pair = (data[heads] == ord("(")) & (data[tails] == ord(")")) & (heads < tails)
        if pair.any():
            data = data.copy()
            data[heads[pair]] = data[tails[pair]] = ord(" ")
            blank = _in(data, BLANKS)
    cut = _in(data, dialect.delimiters)
    if dialect.dash:
        before, after = np.r_[True, blank[:-1]] | (at == first), np.r_[blank[1:], True] | (at == last)
        cut |= (data == ord("-")) & before & after
    edge = cut | blank | _in(data, dialect.brackets)
    open_ok = np.r_[True, edge[:-1]] | (at == first)
    close_ok = np.r_[edge[1:], True] | (at == last)

    def parity(mask: np.ndarray) -> np.ndarray:
        """Odd after an opening quote; a row with an odd number of quotes has none."""
        total = np.add.reduceat(np.r_[mask, False].astype(np.int64), np.minimum(offs[:-1], size)) if n else np.zeros(0, np.int64)
        total[np.diff(offs) == 0] = 0
        mask = mask & (total[row] % 2 == 0)
        run = np.cumsum(mask)
        return (run - np.where(first > 0, run[first - 1], 0)) % 2 == 1

    inside = np.zeros(size, bool)
    for q in dialect.quotes:
        mark = (data == q) & ~inside
        if q != ord('"'):  # an apostrophe within a word is no quote
            mark &= open_ok | close_ok
        inside |= parity(mark)
    cut &= ~inside
    ends_at = np.flatnonzero(cut)
    filled = np.flatnonzero(np.diff(offs) > 0)
    start = np.sort(np.r_[offs[filled], ends_at + 1])
    end = np.sort(np.r_[offs[filled + 1], ends_at])
    keep = start < end
    start, end = start[keep], end[keep]
    owner = row[start] if len(start) else np.zeros(0, np.int64)
    quoted = np.zeros(len(start), np.uint8)
    loose, blank = _in(data, BLANKS + dialect.brackets), _in(data, BLANKS)
    active = np.arange(len(start))
    while len(active):  # blanks, brackets and quotes alternate a few times at most
        s, e = start[active], end[active]
        bare = quoted[active] == 0  # within quotes brackets belong to the value
        at_s, at_e = np.minimum(s, size - 1), np.maximum(e - 1, 0)
        head = (s < e) & np.where(bare, loose[at_s], blank[at_s])
        s = s + head
        tail = (s < e) & np.where(bare, loose[at_e], blank[at_e])
        e = e - tail
        qs, qe = data[np.minimum(s, size - 1)], data[np.maximum(e - 1, 0)]
        wrapped = (e - s >= 2) & (qs == qe) & _in(qs, dialect.quotes) & (quoted[active] == 0) & ~head & ~tail
        quoted[active[wrapped]] = qs[wrapped]
        start[active], end[active] = s + wrapped, e - wrapped
        active = active[head | tail | wrapped]
    keep = start < end
    start, end, owner, quoted = start[keep], end[keep], owner[keep], quoted[keep]
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, end, -1)
    stay = np.cumsum(edges[:-1]) > 0
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, start, quoted)
    np.add.at(mark, end, -quoted.astype(np.int64))
    within = np.cumsum(mark[:-1])
    same = (within > 0) & (data == within)  # the quote that encloses the value
    if same.any():  # of each two in a row the second goes
        new = same & ~np.r_[False, same[:-1]]
        head = np.maximum.accumulate(np.where(new, at, -1))
        stay &= ~(same & ((at - head) % 2 == 1))
    kept = np.r_[0, np.cumsum(stay)]
    child = np.r_[kept[start], kept[end[-1:]]] if len(start) else np.zeros(1, np.int64)
    values = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(child.astype(np.int64).tobytes()), pa.py_buffer(data[stay].tobytes())]).cast(pa.string())
    lists = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), values)


def explode_packed(df: DataFrame, key: str, field: str, dialect: Dialect = LABELS) -> DataFrame:
    """(key string, pos int, val string): every value of ``field``; pos counts from 1 in the order of the field.

    Enclosing quotes, brackets and blanks are taken off, a quoted value stays whole, a doubled quote in it
    stands for one; empty values are left out and not counted, repeated ones are kept. Null, empty and blank
    fields give no row; a quote that is never closed is an ordinary character; rows with a null or repeated key
    are split like any other; other columns are not read; an empty table gives no rows. Narrow: no shuffle, one
    pass over two columns, whatever the length of a field.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = split_packed(b.column(1), dialect)
            parent = pc.list_parent_indices(lists)
            first = np.asarray(lists.offsets)[:-1]
            pos = np.arange(len(parent)) - first[np.asarray(parent)] + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(parent), pa.array(pos.astype(np.int32)), lists.flatten()], ["key", "pos", "val"])

    src = df.select(df[key].cast("string").alias("key"), df[field].cast("string").alias("field")).filter(F.col("field").isNotNull())
    return src.mapInArrow(split, "key string, pos int, val string")
