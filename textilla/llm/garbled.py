"""Garbled text from a wrong character encoding: found, and restored where nothing was lost.

Noisy-channel decoding. Each distinct suspicious token becomes, for every channel (a right encoding and the wrong
one that it was read in), a lattice over its bytes: an edge reads one character of the right encoding from the
bytes that the wrong one shows, or keeps a character as it stands, or reads a lost byte as a wildcard. A Viterbi
search finds the best path under the channel's costs and a letter model that the corpus word frequencies make up;
wildcards are then filled by the most frequent word that fits, and the frequencies of the words themselves decide
between the channels' readings and the token as it stands.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .columns import split
from .pairs import met, only

#: (right encoding, wrong encoding, cost of the channel). UTF-8 read in another encoding leaves sequences that no
#: language has, one 8-bit encoding read in another leaves single odd letters that need the words as witnesses.
CHANNELS = [("utf-8", w, 2.0) for w in ("cp1252", "cp1251", "cp850", "cp437", "mac_roman")] + [("cp1252", w, 5.0) for w in ("cp850", "cp437", "mac_roman", "cp1251", "cp1250", "koi8_r")]
KEEP, LOST, UNWRITTEN, BARE = 4.0, 1.0, 8.0, 2.0
#: Share of all words from which a word counts as known at all, whatever the size of the corpus.
FLOOR = 3e-8
#: Letters of the corpus languages beyond ASCII, and signs that texts rightly hold. Fixed values.
USUAL = "áéíóúüñçàèòïâêôãõëûùîœæÁÉÍÓÚÜÑÇÀÈÒÏÂÊÔÃÕËÛÙÎŒÆ¿¡«»·ºª°²³–—‘’“”…€§©®™±×µ½¼¾  "
LETTERS = "áéíóúüñçàèòïâêôãõëûùîœæ"
#: Letters of the model: a word's edge, ASCII, LETTERS, any other one.
MODEL = "^abcdefghijklmnopqrstuvwxyz" + LETTERS + "#"
_AT = {c: i for i, c in enumerate(MODEL)}
_LOST, WILD = "\ufffd", "\ue000"
_word = re.compile(r"[^\W\d_]+")
_reading_word = re.compile(f"[^\\W\\d_{WILD}]*(?:{WILD}[^\\W\\d_{WILD}]*)*")
_wild_word = re.compile(r"[^\W\d_?�]*(?:[?�]+[^\W\d_]*)+")
_behind = re.compile(r"(?<=[^\W\d_])[·±×½¼¾§¿¡]")
_opening = re.compile(r"[^\w?�]*[?�](?=[^\W\d_a-zà-ÿ](?:[a-zà-ÿ]|[?�][a-zà-ÿ]))")


@functools.lru_cache(None)
def _table(wrong: str) -> dict[str, int]:
    """Character to byte, as a lenient reader of the wrong encoding would have shown it."""
    table: dict[str, int] = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(wrong)] = b
        except UnicodeDecodeError:
            pass
        table.setdefault(chr(b), b) if wrong == "cp1252" and b < 160 else None
    if wrong == "cp1252":  # a text lower-cased after it was garbled
        for c in "ÂÃÄÅÆÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŠŽŒ":
            table.setdefault(c.lower() + "\0", table[c])
    return table


def _utf8(b: list[int]) -> str | None:
    try:
        return bytes(b).decode("utf-8")
    except UnicodeDecodeError:
        return None


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of a letter after two, from (m, m, m) counts, smoothed towards the letter's own frequency."""
    m = len(MODEL)
    own = (counts.sum((0, 1)) + 1) / (counts.sum() + m)
    return np.log((counts + 5 * own) / (counts.sum(2, keepdims=True) + 5))


def _edges(token: str, i: int, right: str, bytes_of: list[list[int]], lost: dict[int, bool]) -> list[tuple[int, str, float]]:
    """(end, character, cost) of the lattice's edges from place ``i``."""
    n, c = len(token), token[i]
    if i in lost:
        if lost[i]:
            return [(i + 1, "¿", LOST)]
        # a question mark at a word's end only asks, unless the channel knows nothing but losses
        asks = c != _LOST and not token[i + 1 : i + 2].isalpha() and right != "lost"
        return [(i + 1, c, 0.0)] if asks else [(i + 1, WILD, LOST)] + ([(i + 1, c, KEEP)] if c != _LOST else [])
    if ord(c) < 128 or right == "lost":
        return [(i + 1, c, 0.0)]
    edges = [(i + 1, c, KEEP if bytes_of[i] else 0.5)]
    if right == "utf-8":
        for h in (b for b in bytes_of[i] if b >= 0xC2):
            size = 2 if h < 0xE0 else 3 if h < 0xF0 else 4
            tails = [[b for b in bytes_of[k] if 0x80 <= b < 0xC0] for k in range(i + 1, min(n, i + size))]
            if len(tails) == size - 1 and all(tails):
                got = _utf8([h, *(t[0] for t in tails)])
                if got:
                    edges.append((i + size, got, 0.0))
            elif size == 2 and (i + 1 in lost or token[i + 1 : i + 2] == _LOST):
                edges.append((i + 2, WILD, LOST))  # its second byte is lost: any letter
            elif h == 0xC3 and (i + 1 == n or not tails[0]):  # the second byte was a blank that is gone
                edges.append((i + 1, "à", LOST))
    else:
        beside = (i > 0 and token[i - 1].isalpha()) or (i + 1 < n and token[i + 1].isalpha())
        for b in bytes_of[i]:
            try:
                got = bytes([b]).decode(right)
            except UnicodeDecodeError:
                continue
            if got.isalpha() and c in USUAL and not c.isalpha() and not beside:
                continue  # a usual sign apart from letters is no letter
            edges.append((i + 1, got, 0.0 if got in USUAL else UNWRITTEN))
    return edges


def decode(token: str, right: str, wrong: str, model: np.ndarray | None = None) -> tuple[float, str] | None:
    """(channel cost, reading) of the best path through a token's byte lattice in one channel, or None if that is the token.

    Viterbi over (place, last two letters): a path costs what its edges cost in the channel and what its letters
    cost under the model. The channel "lost" knows wildcards alone.
    """
    table, n = _table(wrong) if wrong else {}, len(token)
    lost = dict.fromkeys([i for s, e in wild(token) for i in range(s, e) if token[i] in "?�"] + [i for i, c in enumerate(token) if c == _LOST], False)
    if m := _opening.match(token):  # an opening mark was lost
        lost[m.end() - 1] = True
    bytes_of = [[x for x in (table.get(c), table.get(c + "\0")) if x is not None] for c in token]
    if not lost and not any(bytes_of[i] for i in range(n) if ord(token[i]) > 127):
        return None
    best: list[dict[tuple[int, int], tuple[float, float, str]]] = [{} for _ in range(n + 1)]
    best[0][0, 0] = (0.0, 0.0, "")
    for i in range(n):
        if not best[i]:
            continue
        for at, c, cost in _edges(token, i, right, bytes_of, lost):
            low = c.lower()
            z = _AT.get(low, _AT["#"] if low.isalpha() else 0) if c != WILD else _AT["#"]
            for (x, y), (total, channel, out) in best[i].items():
                step = 0.0 if model is None or c == WILD or not (y or z) else -float(model[x, y, z])
                if not z:
                    state = (0, 0)
                else:
                    state = (y, z)
                new = (total + cost + step, channel + cost, out + c)
                if state not in best[at] or new < best[at][state]:
                    best[at][state] = new
    ends = [(total - (float(model[x, y, 0]) if model is not None and y else 0.0), channel, out) for (x, y), (total, channel, out) in best[n].items()]
    if not ends:
        return None
    _, channel, out = min(ends)
    return (channel, out) if out != token else None


def _cased(word: str) -> bool:
    return word.islower() or word.isupper() or (word[:1].isupper() and (word[1:].islower() or len(word) == 1))


def oddness(token: str) -> float:
    """How unlikely a token is to be meant as it stands, by its characters alone."""
    odd = sum(6.0 if not c.isalpha() else 2.0 for c in token if ord(c) > 127 and c not in USUAL)
    # signs that don't follow a letter, but for the one between two l's
    odd += 2.0 * sum(1 for m in _behind.finditer(token) if token[m.start() - 1 : m.end() + 1].lower() != "l·l")
    for w in _word.findall(token):
        if any(ord(c) > 127 for c in w) and not _cased(w):
            odd += 6.0
        other = sum(1 for c in w if "Ͱ" <= c <= "ԯ")
        if 0 < other < len(w):
            odd += 10.0
    return odd


def _case_like(text: str, token: str) -> str:
    """A text that was lower-cased after it was garbled stays lower-cased."""
    plain = [c for c in token if c.isascii() and c.isalpha()]
    return text.lower() if plain and token == token.lower() else text


def candidates(token: str, model: np.ndarray | None = None) -> list[tuple[str, str, float]]:
    """(channel, reading, cost) of a token, itself as channel '' first: the best path of every channel, and of channels in a row.

    Text can have been garbled several times: what a step has read goes on until no channel reads anything new.
    """
    seen: dict[str, tuple[str, str, float]] = {}
    front = [("", token, 0.0)]
    while front:
        new: dict[str, tuple[str, str, float]] = {}
        for name, text, cost in front:
            for right, wrong, price in [("lost", "", BARE), *CHANNELS]:
                if name and right != "utf-8" or len(text) < 2 and right == "utf-8":
                    continue
                got = decode(text, right, wrong, model)
                if got is None:
                    continue
                reading = _case_like(got[1], token)
                spent = cost + price + got[0]
                total = spent + oddness(reading.replace(WILD, "e")) + sum(4.0 for x in reading if ord(x) > 127 and x not in USUAL and x != WILD)
                if reading != token and (reading not in seen or total < seen[reading][2]):
                    seen[reading] = (f"{name}{right}>{wrong} ", reading, total)
                    new[reading] = (f"{name}{right}>{wrong} ", reading, spent)
        front = [x for x in new.values() if WILD not in x[1] and not x[1].isascii()]
    return [("", token, oddness(token)), *sorted(seen.values(), key=lambda x: (x[2], x[1]))]


def wild(token: str) -> list[tuple[int, int]]:
    """Spans of words with lost characters: U+FFFD anywhere, a question mark before a letter; one at a word's end only asks."""
    if ("://" in token or "=" in token) and _LOST not in token:
        return []
    m = _opening.match(token)  # an opening question or exclamation mark was lost, too
    return [x.span() for x in _wild_word.finditer(token, m.end() if m else 0)]


def mask(word: str) -> str:
    """Every character that may have been lost, or is written beyond ASCII, as a wildcard."""
    return "".join("*" if ord(c) > 127 else c for c in word.lower())


def _words(reading: str) -> list[tuple[int, int]]:
    return [m.span() for m in _reading_word.finditer(reading) if m.end() > m.start()]


def _readings(batches: Iterator[pd.DataFrame], model: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """(token, cand, channel, reading, cost, sure, pos, word) for every word of every reading; a reading without one has the word ''."""
    cols = ["token", "cand", "channel", "reading", "cost", "sure", "pos", "word"]
    for b in batches:
        rows = []
        for token in b["token"]:
            # U+FFFD, or a question mark that a letter follows, never stands in a sound text
            sure = _LOST in token or bool(wild(token) and re.search(r"\?[^\W\d_]", token))
            for k, (channel, reading, cost) in enumerate(candidates(token, model)):
                found = [reading[s:e].lower() for s, e in _words(reading)] or [""]
                if channel and found == [""] and not _word.search(token):
                    continue  # one sign for another is no reading
                rows += [(token, k, channel, reading, cost, sure and (WILD in reading or bool(channel)), i, mask(w) if WILD in w else w) for i, w in enumerate(found)]
            if _LOST in token and not any(r[0] == token and r[2] for r in rows[-200:]):
                rows.append((token, 99, "lost> ", token.replace(_LOST, WILD), BARE, True, 0, ""))
        yield pd.DataFrame(rows, columns=cols)


def _rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wildcards filled by the best word, in the token's case; a token keeps its damage where a word is unknown."""
    for b in batches:
        out, whole = [], []
        for token, channel, reading, words in zip(b["token"], b["channel"], b["reading"], b["words"]):
            text, ok = reading, channel != ""
            for (s, e), w in reversed(list(zip(_words(reading), words))):
                old = reading[s:e]
                if WILD not in old:
                    continue
                if w is None or len(w) != e - s:
                    ok = False
                    continue
                letters = [c for c in old if c.isalpha()]
                w = w.upper() if letters and all(c.isupper() for c in letters) and len(letters) > 1 else w[:1].upper() + w[1:] if old[:1].isupper() else w
                text = text[:s] + w + text[e:]
            ok = ok and WILD not in text
            if WILD in text:  # as it stood, where the places still agree
                text = "".join(t if c == WILD else c for c, t in zip(text, token)) if len(text) == len(token) else text.replace(WILD, _LOST)
            out.append(text)
            whole.append(ok)
        yield pd.DataFrame({"token": b["token"], "restored": out, "whole": whole, "channel": b["channel"]})


#: Tokens worth a look: anything beyond ASCII, or a question mark beside or before a letter.
_GAP = r"[ \t\r\n]+"
_suspect = re.compile(r"[^\x00-\x7F]|\?[^\W\d_]|[^\W\d_]\?")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n, rids): occurrences of each token in a part of a batch and, if it is suspect, the rows that hold it."""
    names = ["token", "n", "rids"]
    for whole in batches:
        for lo in range(0, whole.num_rows, 4000):
            b = whole.slice(lo, 4000)
            values, codes, parent = split(b.column(1), _GAP)
            if not len(codes):
                continue
            rid = np.asarray(b.column(0))
            n = np.bincount(codes, minlength=len(values))
            strings = values.to_pylist()
            odd = np.array([bool(_suspect.search(v)) for v in strings])
            use = odd[codes]
            pair = np.unique(codes[use] * len(rid) + parent[use])
            size = np.bincount(pair // len(rid), minlength=len(values))
            seen = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[seen])].astype(np.int32)), pa.array(rid[pair % len(rid)]))
            yield pa.RecordBatch.from_arrays([pa.array([strings[i] for i in seen], pa.string()), pa.array(n[seen]), lists], names)


def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(at, n): how often letters follow two others, over words weighted by their frequency."""
    m = len(MODEL)
    acc: defaultdict[int, float] = defaultdict(float)
    for b in batches:
        for w, f in zip(b["word"], b["f"]):
            x = y = 0
            for c in [*w, "^"]:
                z = _AT.get(c, m - 1)
                acc[(x * m + y) * m + z] += f
                x, y = y, z
    yield pd.DataFrame({"at": list(acc), "n": list(acc.values())}, columns=["at", "n"]).astype({"at": "int64", "n": "float64"})


def damaged_tokens(tokens: DataFrame) -> DataFrame:
    """(token, restored, whole, channel) of every damaged one of ``tokens`` (token, n), each once.

    ``whole`` tells whether the token could be restored. Tokens and words are counted where they lie before they
    are shuffled, so that a frequent one costs no task more than a rare one; readings are made once per token. The
    letter model has as many numbers as ``MODEL`` has triples, whatever the corpus. A word's part of all words,
    not its number, decides: the same words give the same result at any size.
    """
    words = cut(tokens.select(F.explode(F.regexp_extract_all(F.lower("token"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("f")))
    masked = words.filter(F.col("word").rlike(r"[^\x00-\x7F]") & F.col("word").rlike(f"^[a-z{LETTERS}]+$")).withColumn("mask", F.regexp_replace("word", r"[^\x00-\x7F]", "*"))
    masked = masked.groupBy("mask").agg(F.max("f").alias("f"), F.max_by("word", F.struct("f", "word")).alias("best"))
    known = words.select("word", "f", F.col("word").alias("best")).unionByName(masked.select(F.col("mask").alias("word"), "f", "best"))
    total = float(words.agg(F.coalesce(F.sum("f"), F.lit(1))).first()[0])
    size = len(MODEL)
    counts = np.zeros(size**3)
    for r in words.mapInPandas(_trigrams, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["at"]] = r["n"]
    model = tokens.sparkSession.sparkContext.broadcast(letter_model(counts.reshape(size, size, size)).astype(np.float32))
    suspects = tokens.filter(F.col("token").rlike(r"[^\x00-\x7F]|\?\p{L}|\p{L}\?")).select("token")
    kinds = "token string, cand int, channel string, reading string, cost double, sure boolean, pos int, word string"
    spread = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as a number, so that few bytes but long work are not put into one task
    rated = met(suspects.repartition(spread, "token").mapInPandas(lambda b: _readings(b, model.value), kinds), known, "word", "left")
    often = F.coalesce("f", F.lit(0))
    rated = rated.groupBy("token", "cand", "channel", "reading", "cost", "sure").agg(
        # usual signs without a letter are as good as a known word, as they stand or as a sequence of UTF-8 that shows nothing else
        F.sum(F.when((F.col("word") == "") & (((F.col("cand") == 0) & (F.col("cost") == 0)) | (F.startswith("channel", F.lit("utf-8")) & (F.col("cost") < 4))), 0.0).otherwise(F.log(often / total + FLOOR))).alias("ll"),
        F.min(often).alias("least"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "best"))), lambda x: x["best"]).alias("words"),
    )
    score = F.col("ll") - F.col("cost")
    one = F.struct("channel", "reading", "words", "sure", "least", "cost")
    best = rated.groupBy("token").agg(F.max_by(one, F.struct(score, -F.col("cand"))).alias("b"), F.max_by(F.when(F.col("sure"), one), F.when(F.col("sure"), F.struct(score, -F.col("cand")))).alias("o"), F.max(F.when(F.col("cand") == 0, F.col("cost"))).alias("odd"))
    # a sure loss is damage even if no word fits; an ordinary token only if a known word wins over it
    pick = F.when(F.col("o.sure"), F.col("o")).otherwise(F.col("b"))
    damaged = best.select("token", pick.alias("x"), "odd").filter("x.channel != '' AND (x.sure OR x.least > 0 OR odd >= 6 OR x.cost < 4)")
    return damaged.select("token", "x.channel", "x.reading", "x.words").mapInPandas(_rebuild, "token string, restored string, whole boolean, channel string")


def _carried(tokens: list[str], fix: dict[str, tuple[str, str]]) -> dict[str, str]:
    """What stands for each damaged token of a field, and for the tokens between them that its channel reads, too.

    Where a stretch was garbled as a whole, a token that might be a word as it stands comes through the same channel:
    if nearly all tokens beyond ASCII from the first damaged one to the last are restored by one channel, so are the rest.
    """
    out = {k: v[0] for k, v in fix.items()}
    at = [i for i, t in enumerate(tokens) if t in fix]
    channels = {fix[tokens[i]][1] for i in at}
    if len(channels) != 1 or len(at) < 3:
        return out
    right, _, wrong = next(iter(channels)).strip().partition(">")
    others = {t for t in tokens[at[0] : at[-1] + 1] if t not in fix and not t.isascii()}
    if not wrong or " " in wrong or 3 * len(others) > len(at):
        return out
    for t in others:
        got = decode(t, right, wrong)
        if got and got[0] == 0 and _word.search(got[1]) and oddness(got[1]) == 0:
            out[t] = _case_like(got[1], t)
    return out


def repair_fields(texts: DataFrame) -> DataFrame:
    """(tbl, rec_key, fld, text, restored, whole) of every damaged field of ``texts`` (tbl, rec_key, fld, text).

    A field counts if any of its rows holds a damaged token. Null and empty texts are sound; a repeated key gives
    a row per text; an empty table gives no rows. ``whole`` says whether every damaged token could be restored.
    Texts are split once: occurrences are counted, and the rows of suspect tokens noted, where they lie.
    """
    src = texts.filter("text IS NOT NULL").withColumn("rid", F.xxhash64("tbl", "rec_key", "fld", "text"))
    noted = cut(src.select("rid", "text").mapInArrow(_tokens, "token string, n bigint, rids array<bigint>"))
    tokens = cut(noted.groupBy("token").agg(F.sum("n").alias("n")))
    damaged = cut(damaged_tokens(tokens))
    hits = met(noted.filter(F.size("rids") > 0).select("token", F.explode("rids").alias("rid")).distinct(), damaged, "token")
    fixes = cut(hits.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("restored", "channel")))).alias("fix"), F.min("whole").alias("whole")))

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = re.compile(r"[^ \t\r\n]+")
        for b in batches:
            fixed = [_carried(cell.findall(t), {k: tuple(v.values()) if isinstance(v, dict) else tuple(v) for k, v in dict(f).items()}) for t, f in zip(b["text"], b.pop("fix"))]
            b["restored"] = [cell.sub(lambda m, f=f: f.get(m.group(), m.group()), t) for t, f in zip(b["text"], fixed)]
            yield b[["tbl", "rec_key", "fld", "text", "restored", "whole"]]

    rows = met(only(src, fixes.select("rid"), "rid").dropDuplicates(["rid"]), fixes, "rid")
    return rows.select("tbl", "rec_key", "fld", "text", "whole", "fix").mapInPandas(mend, "tbl string, rec_key string, fld string, text string, restored string, whole boolean")
