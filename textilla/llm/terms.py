"""Frequency of every distinct value or term: occurrences, records, and a mark for the too rare and too common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .columns import recoded, split

_RUN = "term string, n_total bigint, n_records bigint"


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the external sort: the (term, record) pairs of a part of a batch are sorted and scanned, one row per run of a term.

    A record lies in one part, so that the runs of a term add up. The row without a term holds the number of records.
    """
    names = ["term", "n_total", "n_records"]
    for whole in batches:
        for lo in range(0, whole.num_rows, 5000):
            b = whole.slice(lo, 5000)
            values, codes, record = split(b.column(0), r"[^\p{L}\p{N}]+")
            terms, codes = recoded([v.lower() for v in values.to_pylist()], codes)
            pairs = np.sort(codes * b.num_rows + record)
            term = pairs // b.num_rows
            new = np.flatnonzero(np.diff(term, prepend=-1))
            fresh = np.r_[0, np.cumsum(np.diff(pairs, prepend=-1) != 0)]
            ends = np.r_[new, len(pairs)]
            yield pa.RecordBatch.from_arrays([pa.array([None, *terms[term[new]]], pa.string()), pa.array(np.r_[b.num_rows, np.diff(ends)]), pa.array(np.r_[0, np.diff(fresh[ends])])], names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of the sorted runs of a range: one row per term. A term that reaches the end of a batch is carried on."""
    names, last = ["term", "n_total", "n_records"], None
    for b in batches:
        if not b.num_rows:
            continue
        term = np.array(b.column(0).to_pylist(), dtype=object)
        start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        names_, total, records = term[start].tolist(), np.add.reduceat(np.asarray(b.column(1)), start), np.add.reduceat(np.asarray(b.column(2)), start)
        if last is not None:
            if last[0] == names_[0]:
                total[0], records[0] = total[0] + last[1], records[0] + last[2]
            else:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last], names)
        last = (names_[-1], int(total[-1]), int(records[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(names_[:-1], pa.string()), pa.array(total[:-1]), pa.array(records[:-1])], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last], names)


def term_frequencies(df: DataFrame, fields: list[str], rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """(term, n_total, n_records, mark) over all rows; mark is ``rare``, ``common`` or null.

    Terms are maximal runs of letters or digits, lower-cased; every row is a record. An external sort of (term,
    record) pairs: each part of the table is split, sorted and run-length scanned once where it lies; its runs, with
    their occurrences and distinct records, are partitioned by ranges of terms, sorted and scanned again. A term
    that a third of all records hold is one row of each part, not of each record. Null fields count as empty;
    other columns, keys included, are not read, so that repeated rows count each; an empty table gives no rows.
    ``common`` needs more than ``common_share`` of all rows.
    """
    text = F.concat_ws(" ", *(F.coalesce(df[f].cast("string"), F.lit("")) for f in fields))
    runs = cut(df.select(text.alias("text")).mapInArrow(_sorted_runs, _RUN))
    rows = runs.filter("term IS NULL").agg(F.coalesce(F.sum("n_total"), F.lit(0))).first()[0]
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_share * rows, "common")
    merged = runs.filter("term IS NOT NULL").repartitionByRange("term").sortWithinPartitions("term").mapInArrow(_merge, _RUN)
    return merged.withColumn("mark", mark)
