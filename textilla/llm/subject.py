"""Subject areas of documents: complement naive Bayes over sentences, refined by expectation-maximization, calibrated per subject."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.packed import explode_packed
from ..session import cut
from .pairs import met
from .textnorm import folded, word_hashes, words

#: Hashed vocabulary: what bounds the model, whatever the corpus. Smoothing, rounds, and the score from which a
#: sentence speaks of a subject rather than of none, before it is calibrated.
BUCKETS, ALPHA, ROUNDS, NONE, LABEL = 1 << 18, 2.0, 4, 3.0, 1.0
_end = re.compile(r"(?<=[.!?…])[\"”»)\]]*\s+|(?<=[.!?…:])[\"”»)\]]*(?:\r?\n|_x000d_)+|(?:\r?\n|_x000d_){2,}|\s+(?://|\|)\s+")
_word = re.compile(r"[^\W_]+")
#: Buckets of a chunk of sums, and how many tasks a core may have in a pass that sums up.
CHUNK, PER_CORE = 8192, 1


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has any."""
    parts = (_word.findall(s.replace("_x000d_", " ")) for s in _end.split(folded(text)))
    return [p for p in parts if p]


def _features(own: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their parts in order) of words, and of pairs of words one or two apart within one part."""
    with np.errstate(over="ignore"):
        near, far = part[1:] == part[:-1], part[2:] == part[:-2]
        both = np.concatenate([own, (own[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ own[1:])[near], (own[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) ^ own[2:])[far]])
        both ^= both >> np.uint64(33)
        both *= np.uint64(0xFF51AFD7ED558CCD)
    where = np.concatenate([part, part[1:][near], part[2:][far]])
    order = np.argsort(where, kind="stable")
    return ((both >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)[order], where[order]


#: Bits of a label mask, a signed 64-bit number.
AREAS = 63


def units(df: DataFrame, min_words: int) -> DataFrame:
    """(key, feats, cuts, n_abstract, n_words, mask) of rows (key, title, text, mask): features of all sentences in a row, the text's first, and where each ends, as 32-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                b = whole.iloc[lo : lo + 1000]
                body = [sentences(t or "") for t in b["text"]]
                heads = [words(t) for t in b["title"]]
                parts = [p for own, head in zip(body, heads) for p in [*own, *([head] if head else [])]]
                n_parts = np.array([len(own) + bool(head) for own, head in zip(body, heads)], np.int64)
                hashes, offs = word_hashes(parts)
                feats, where = _features(hashes, np.repeat(np.arange(len(parts)), np.diff(offs)))
                ends = np.cumsum(np.bincount(where, minlength=len(parts)))
                last = np.r_[0, np.cumsum(n_parts)]
                begin = np.r_[0, ends][last]
                rows = [(feats[s:e].tobytes(), (ends[i:j] - s).astype(np.int32).tobytes()) for s, e, i, j in zip(begin[:-1], begin[1:], last[:-1], last[1:])]
                yield pd.DataFrame({"key": b["key"].to_numpy(), "feats": [r[0] for r in rows], "cuts": [r[1] for r in rows], "n_abstract": np.array([len(x) for x in body], np.int32), "n_words": np.array([sum(map(len, x)) for x in body], np.int32), "mask": b["mask"].to_numpy()})

    out = df.mapInPandas(run, "key string, feats binary, cuts binary, n_abstract int, n_words int, mask bigint")
    return out.filter((F.col("n_words") >= min_words) | (F.col("mask") > 0))


def weights(counts: np.ndarray) -> np.ndarray:
    """(buckets, subjects) of log(expected / actual count outside the subject) from (buckets, subjects + 1) counts, the last column of no subject.

    The complement's estimate is smoothed towards what the whole corpus makes one expect there, so that a word
    without a preference weighs nothing, whatever the size of a subject, of the vocabulary or of the corpus.
    """
    total = counts.sum(1, keepdims=True)
    comp = total - counts[:, :-1]
    expected = total * (comp.sum(0) / max(1.0, total.sum()))
    return np.log((expected + ALPHA) / (comp + ALPHA)).astype(np.float32)


def _scores(feats: np.ndarray, cuts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(sentences, subjects): weights summed over each sentence's features."""
    return np.add.reduceat(w[feats], np.r_[0, cuts[:-1]], 0)


def _flat(batches: Iterator[pd.DataFrame], docs: int = 500) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of documents: their rows, all features in a row, where each sentence ends, and each sentence's document."""
    for whole in batches:
        for lo in range(0, len(whole), docs):
            b = whole.iloc[lo : lo + docs]
            feats = np.frombuffer(b"".join(b["feats"]), np.int32)
            if not len(feats):
                continue
            size = np.array([len(f) // 4 for f in b["feats"]])
            n = np.array([len(c) // 4 for c in b["cuts"]])
            cuts = np.frombuffer(b"".join(b["cuts"]), np.int32).astype(np.int64) + np.repeat(np.cumsum(size) - size, n)
            yield b, feats, cuts, np.repeat(np.arange(len(b)), n)


def _labels(mask: pd.Series, n: int) -> np.ndarray:
    return (mask.to_numpy(np.int64)[:, None] >> np.arange(n)) & 1


def _sum(rows: DataFrame, columns: list[str], run: Callable[[Iterator[pd.DataFrame]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all tasks of what ``run`` makes of their rows, an array of ``shape``.

    Tasks are as many as the cluster has cores for, not as the table has parts; their arrays go out in chunks that
    are added up as they arrive, so that no task holds more than its chunks.
    """
    sc = rows.sparkSession.sparkContext
    step = min(CHUNK, shape[1])
    chunks = -(-shape[1] // step)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = run(batches).astype(np.float32)
        if acc.any():
            yield pd.DataFrame([(i, acc[:, i * step : (i + 1) * step].tobytes()) for i in range(chunks)], columns=["chunk", "sums"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b["chunk"].tolist(), b["sums"]):
                own[i] = own.get(i, 0) + np.frombuffer(x, np.float32).astype(np.float64)
        yield pd.DataFrame([(i, x.tobytes()) for i, x in own.items()], columns=["chunk", "sums"])

    kind = "chunk int, sums binary"
    out = np.zeros(shape)
    for r in rows.select(*columns).coalesce(PER_CORE * sc.defaultParallelism).mapInPandas(part, kind).repartition("chunk").mapInPandas(add, kind).collect():
        own = np.frombuffer(r["sums"], np.float64).reshape(shape[0], -1)
        out[:, r["chunk"] * step : r["chunk"] * step + own.shape[1]] = own
    return out


def count(rows: DataFrame, n: int, w: np.ndarray | None) -> np.ndarray:
    """One pass over ``rows``: (buckets, n + 1) expected counts, from the labels alone if there are no weights yet."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        acc, w = np.zeros((n + 1, BUCKETS)), sent.value
        for b, feats, cuts, doc in _flat(batches):
            label = _labels(b["mask"], n)[doc]
            if w is None:
                r = np.c_[label / np.maximum(1, label.sum(1, keepdims=True)), np.zeros(len(label))]
            else:
                s = np.c_[_scores(feats, cuts, w) + LABEL * label, np.full(len(doc), NONE)]
                s = np.exp(s - s.max(1, keepdims=True))
                r = s / s.sum(1, keepdims=True)
            size = np.diff(np.r_[0, cuts])
            for c in range(n + 1):
                if r[:, c].any():
                    acc[c] += np.bincount(feats, np.repeat(r[:, c], size), BUCKETS)
        return acc

    return _sum(rows, ["feats", "cuts", "mask"], run, (n + 1, BUCKETS)).T


def calibrate(rows: DataFrame, n: int, w: np.ndarray, width: float = 0.5, bins: int = 40) -> np.ndarray:
    """Posterior that a sentence speaks of a subject, by (subject, bin of its score).

    Of the sentences of labelled documents in a bin, a share bears the label. Labels are not always right, and a
    labelled document has sentences on nothing, so that the share runs from a floor to a ceiling: the posterior is
    where in between it lies, made monotone over the bins (pool adjacent violators). Subjects with few labelled
    sentences borrow from all.
    """

    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        acc, w = np.zeros((n, bins, 2)), sent.value
        for b, feats, cuts, doc in _flat(batches):
            first = np.r_[True, doc[1:] != doc[:-1]]
            nth = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
            use = (nth < b["n_abstract"].to_numpy()[doc]) & (b["mask"].to_numpy()[doc] > 0)
            at = np.clip((_scores(feats, cuts, w)[use] / width).astype(int), 0, bins - 1)
            label = _labels(b["mask"], n)[doc][use]
            for c in range(n):
                acc[c, :, 0] += np.bincount(at[:, c], label[:, c], bins)
                acc[c, :, 1] += np.bincount(at[:, c], minlength=bins)
        return acc.reshape(1, -1)

    got = _sum(rows, ["feats", "cuts", "mask", "n_abstract"], run, (1, n * bins * 2)).reshape(n, bins, 2)
    pooled = got.sum(0)
    out = np.zeros((n, bins))
    for c in range(n):
        own = got[c] + pooled * (200 / max(200.0, pooled[:, 1].sum()))
        rate = own[:, 0] / np.maximum(own[:, 1], 1e-9)
        blocks: list[list[float]] = []
        for r, k in zip(rate, own[:, 1]):
            blocks.append([r, max(k, 1e-6), 1])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
        fit = np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])
        high = own[bins // 2 :, 0].sum() / max(1e-9, own[bins // 2 :, 1].sum()) if own[bins // 2 :, 1].sum() else fit.max()
        out[c] = np.clip((fit - fit[0]) / max(1e-9, max(high, fit[0] + 1e-6) - fit[0]), 0, 1)
    return out


def subject_areas(docs: DataFrame, labels: DataFrame, taxonomy: DataFrame, extra: DataFrame | None = None, key: str = "referencia", title: str = "titulo", text: str = "resumen", label: str = "labelstr", min_words: int = 20, share: float = 0.3) -> DataFrame:
    """(referencia, area, n_sentences, n_any, share, posterior) of every document whose text has ``min_words`` words.

    Subjects are the taxonomy's references that don't end in ``_``; a label names one by reference or name, several
    labels are split, those of level 1 or unknown are none. Complement naive Bayes is trained on the labelled
    documents, the taxonomy's definitions and ``extra`` (text, area), then refined by expectation-maximization
    over the sentences of all documents, where a sentence may speak of no subject. Scores are calibrated for each
    subject by itself, so that a sentence may speak of several. A subject counts if at least ``share`` of the
    sentences that speak of any speak of it.

    Null, blank and short texts get no row; a null title is empty; repeated keys are documents of their own only if
    texts differ; other columns are not read; empty tables give no rows. The model has ``BUCKETS`` x subjects
    numbers at any corpus size: that, and nothing that grows, is gathered and sent.
    """
    areas = [(r["reference"], r["name"], r["definition"]) for r in taxonomy.select("reference", "name", "definition").filter("reference IS NOT NULL AND NOT endswith(reference, '_')").orderBy("reference").limit(AREAS + 1).collect()]
    n = len(areas)
    if n > AREAS:
        raise ValueError(f"more than {AREAS} subjects: a label mask has no bit for each")
    if not n:
        return docs.sparkSession.createDataFrame([], "referencia string, area string, n_sentences int, n_any int, share double, posterior double")
    names = {x.lower(): 1 << i for i, a in enumerate(areas) for x in a[:2] if x}
    bit = F.try_element_at(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v).cast("bigint")))), F.lower("val"))
    masks = explode_packed(labels, key, label).select("key", bit.alias("bit")).filter("bit IS NOT NULL").groupBy("key").agg(F.bit_or("bit").alias("mask"))
    src = docs.select(docs[key].cast("string").alias("key"), docs[title].cast("string").alias("title"), docs[text].cast("string").alias("text")).filter("key IS NOT NULL AND text IS NOT NULL")
    body = met(src, masks, "key", "left").select("key", "title", "text", F.coalesce("mask", F.lit(0)).cast("bigint").alias("mask"))
    # a labelled text of a few words, such as a placeholder, teaches nothing
    rows = cut(units(body, min_words).filter("n_words > 4"))
    spark = docs.sparkSession
    seeds = spark.createDataFrame([(None, None, d, 1 << i) for i, (_, _, d) in enumerate(areas) if d] + [(None, None, a[1], 1 << i) for i, a in enumerate(areas) if a[1]], "key string, title string, text string, mask bigint")
    if extra is not None:
        own = F.try_element_at(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v).cast("bigint")))), F.lower("area"))
        seeds = seeds.unionByName(extra.select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("title"), F.col("text").cast("string").alias("text"), own.alias("mask")).filter("mask IS NOT NULL AND text IS NOT NULL"))
    first = cut(units(seeds, 1))
    learn = rows.unionByName(first)
    base = count(learn.filter("mask > 0"), n, None)
    fixed = count(first, n, None)
    counts = base
    for _ in range(ROUNDS):
        counts = count(rows, n, weights(counts)) + fixed
    w = weights(counts)
    table = calibrate(rows.filter("mask > 0"), n, w)
    codes = [a[0] for a in areas]
    width, bins = 0.5, table.shape[1]
    sent = spark.sparkContext.broadcast(w)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = sent.value
        for b, feats, cuts, doc in _flat(batches):
            first = np.r_[True, doc[1:] != doc[:-1]]
            nth = np.arange(len(doc)) - np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
            s = _scores(feats, cuts, w)
            p = table[np.arange(n), np.clip((s / width).astype(int), 0, bins - 1)]
            # of two subjects in a sentence the weaker one needs two fifths of the stronger one's score
            speak = (p >= 0.5) & (s >= 0.4 * s.max(1, keepdims=True)) & (nth < b["n_abstract"].to_numpy()[doc])[:, None]
            own = np.stack([np.bincount(doc, speak[:, c], len(b)) for c in range(n)], 1)
            mass = np.stack([np.bincount(doc, speak[:, c] * p[:, c], len(b)) for c in range(n)], 1)
            every = np.bincount(doc, speak.any(1), len(b))
            d, c = np.nonzero(own)
            yield pd.DataFrame({"referencia": b["key"].to_numpy()[d], "area": np.array(codes, object)[c], "n_sentences": own[d, c].astype(np.int32), "n_any": every[d].astype(np.int32), "share": own[d, c] / every[d], "posterior": mass[d, c] / own[d, c]})

    whole = rows.filter(F.col("n_words") >= min_words).select("key", "feats", "cuts", "n_abstract")
    return whole.mapInPandas(decide, "referencia string, area string, n_sentences int, n_any int, share double, posterior double").filter(F.col("share") >= share - 1e-9)
