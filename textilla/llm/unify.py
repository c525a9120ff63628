"""Visually identical text with different characters: script-aware repair to one consistent form."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .columns import split
from .pairs import met
from .textnorm import mixed_tokens, plain_characters, repair

#: A Java regular expression for the scan, with few ranges so that it is fast: texts without a match hold no suspect character.
_RARE = r"[^\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u00ff\u2013\u2014\u2018-\u201f\u2026]"
_latin = re.compile("[a-zªºÀ-ÖØ-öø-ɏḀ-ỿ]+", re.IGNORECASE)


def _plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        plain = [plain_characters(t) for t in b["text"]]
        mixed = [sorted(set(mixed_tokens(t))) for t in plain]
        yield pd.DataFrame({"rid": b["rid"], "doc_id": b["doc_id"], "plain": plain, "odd": [p != t for p, t in zip(plain, b["text"])], "tokens": [[x[0] for x in m] for m in mixed], "reads": [[x[1] for x in m] for m in mixed]})


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of a part of a batch that are written in Latin letters alone."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 5000):
            values, _, _ = split(whole.column(0).slice(lo, 5000), r"[^\p{L}\p{M}]+")
            yield pa.RecordBatch.from_arrays([pa.array(sorted({v.lower() for v in values.to_pylist() if _latin.fullmatch(v)}), pa.string())], ["w"])


def _mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        known = [dict(zip(t, r)) if t is not None else {} for t, r in zip(b["known"], b["known_reads"])]
        yield pd.DataFrame({"doc_id": b["doc_id"], "text": [repair(p, k) for p, k in zip(b["plain"], known)], "n_repaired": [len(k) for k in known], "n_unknown": [len(t) - len(k) for t, k in zip(b["tokens"], known)], "odd": b["odd"]})


def unify_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, odd, n_repaired, n_unknown), one row for every input row.

    ``text`` is the consistent form: width variants, ligatures, apart accents, blanks, hyphens and invisible
    characters are replaced by the usual ones (``odd``), and in tokens whose dominant script is Latin the letters
    of another alphabet by the Latin ones they look like, but only if the result is a word that the corpus itself
    writes in Latin letters (``n_repaired``); other such tokens stay as they are (``n_unknown``). Words in another
    alphabet are left alone. A null text stays null with nothing counted; repeated keys are kept as rows; other
    columns are not read; an empty table gives no rows.

    Only texts with a suspect character reach Python. The vocabulary is looked up for the readings that occur,
    by a shuffle join on the word after map-side distinct; nothing that grows with the corpus is broadcast.
    """
    src = df.select(df[key].alias("doc_id"), df[text].cast("string").alias("text"))
    suspect = F.coalesce(F.col("text").rlike(_RARE), F.lit(False))
    rows = src.filter(suspect).withColumn("rid", F.monotonically_increasing_id())
    kind = src.schema["doc_id"].dataType.simpleString()
    plain = cut(rows.mapInPandas(_plain, f"rid bigint, doc_id {kind}, plain string, odd boolean, tokens array<string>, reads array<string>"))
    asked = plain.select("rid", F.explode(F.arrays_zip("tokens", "reads")).alias("x")).select("rid", "x.tokens", "x.reads", F.lower("x.reads").alias("w"))
    corpus = src.select("text").mapInArrow(_vocabulary, "w string").distinct()
    known = met(asked.select("w").distinct(), corpus, "w")
    accepted = met(asked, known, "w").groupBy("rid").agg(F.collect_list(F.struct("tokens", "reads")).alias("k"))
    mended = met(plain, accepted, "rid", "left").select("doc_id", "plain", "odd", "tokens", F.col("k.tokens").alias("known"), F.col("k.reads").alias("known_reads"))
    out = mended.mapInPandas(_mend, f"doc_id {kind}, text string, n_repaired int, n_unknown int, odd boolean")
    rest = src.filter(~suspect).select("doc_id", "text", F.lit(0).alias("n_repaired"), F.lit(0).alias("n_unknown"), F.lit(False).alias("odd"))
    return out.unionByName(rest).select("doc_id", "text", "odd", "n_repaired", "n_unknown")
