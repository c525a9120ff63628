"""Mixing sources to target weights in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Default of the parameter ``ranks``: the ranks of a public byte-level BPE for many languages, which every executor
#: must find at this path. The file is not copied.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources of which the plan is sent to every task at most.
FEW_SOURCES = 50_000


@functools.lru_cache(2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, columns: list[str], text: str, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``columns`` and n_tokens of the whole ``text`` under a rank file and its splitting pattern; null and empty texts have none. Texts are encoded batch by batch."""
    src = df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(ranks, pattern)
        for b in batches:
            # lone surrogates can't occur in Spark strings, so that every text can be encoded
            b["n_tokens"] = [len(x) for x in enc.encode_ordinary_batch(b.pop("_text").tolist(), num_threads=1)]
            yield b

    kept = src.drop("_text").schema
    return src.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint")


def plan_mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per source: docs, tokens, target_share, max_repeat, rate.

    ``total_tokens`` is the size of the mixture; by default the largest at which every source that has tokens
    reaches its target within its cap, so that no cap binds and the shares come out right. A source's rate is
    what its target asks for, never more than its cap; without a target it is 0. A null max_repeat is no cap and 0
    leaves the source out; neither has a say in the size, which is that of all text with a target where no other
    source has one. Sources without documents and
    documents without a target keep their row. The table has one row per source: all of it is small work.
    """
    have = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    want = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeat").alias("max_repeat"))
    rows = have.join(want, "source", "full_outer").na.fill(0, ["n_docs", "tokens", "target_share"])
    open_ = (F.col("target_share") > 0) & (F.col("tokens") > 0) & (F.col("max_repeat").isNull() | (F.col("max_repeat") > 0))
    cap = F.when(open_, F.col("max_repeat") * F.col("tokens") / F.col("target_share"))
    size = F.lit(float(total_tokens)) if total_tokens is not None else F.col("size")
    if total_tokens is None:
        # one row per source, so that a window over all of them is bounded by the table of targets and spellings
        rows = rows.withColumn("size", F.coalesce(F.min(cap).over(_all()), F.sum(F.when(open_, F.col("tokens"))).over(_all()).cast("double"), F.lit(0.0)))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("max_repeat").cast("double"), F.col("target_share") * size / F.col("tokens"))).otherwise(0.0)
    return rows.withColumn("rate", rate).drop("size")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, total_tokens: int | None = None, ranks: str = RANKS, pattern: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: (doc_id, source, copy_no, n_tokens), each document floor(rate) times and once more where a draw
    hashed from its key and the seed falls under the rate's fraction; copies never exceed the cap, since the rate
    doesn't. report: per source what it has, its target, its rate, and the documents, tokens, largest copy count
    and share reached; ``met`` says whether the share is within a twentieth of the target or two documents of it.
    Spellings of a source that differ in case or outer blanks are one; null sources are ''. Null and empty texts
    have no tokens and go along at their source's rate; repeated keys draw alike; other columns are not read.
    Tokens are aggregated before they are shuffled, a source with a third of all rows costs no task more.
    """
    src = docs.select(docs[key].alias("doc_id"), F.lower(F.trim(F.coalesce(docs["source"], F.lit("")))).alias("source"), docs[text].alias("text"))
    sized = cut(count_tokens(src, ["doc_id", "source"], "text", ranks, pattern))
    plan = cut(plan_mix(sized, targets, total_tokens))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # one row per source name: sent to the documents where that is small, so that a source with a third of them is no hot key
    rates = plan.select("source", "rate")
    drawn = sized.join(F.broadcast(rates) if rates.count() <= FEW_SOURCES else rates, "source").withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
    mixture = drawn.filter("copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "n_tokens")
    got = drawn.groupBy("source").agg(F.sum("copies").alias("docs_out"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_out"), F.max("copies").alias("most_copies"))
    share = F.try_divide(F.col("tokens_out").cast("double"), F.sum("tokens_out").over(_all()))
    near = F.greatest(F.lit(0.05) * F.col("target_share"), F.try_divide(2.0 * F.col("tokens"), F.col("n_docs") * F.sum("tokens_out").over(_all())))
    report = plan.join(got, "source", "left").na.fill(0, ["docs_out", "tokens_out", "most_copies"]).withColumn("actual_share", F.coalesce(share, F.lit(0.0)))
    return mixture, report.withColumn("met", F.abs(F.col("actual_share") - F.col("target_share")) <= F.coalesce(near, F.lit(0.0)))
