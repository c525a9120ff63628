"""Characters that look alike or cannot be seen, brought to one form; words as the pair operators read them."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

#: Letters of other alphabets and the Latin letter that each one looks like.
LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "ї": "ï", "ґ": "r", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ё": "Ë", "Ї": "Ï", "З": "3",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ε": "e", "η": "n", "ω": "w", "σ": "o", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "ά": "á", "έ": "é", "ί": "í", "ό": "ó", "ύ": "ú", "Ά": "Á", "Έ": "É", "Ί": "Í", "Ό": "Ó", "Ύ": "Ý", "ϊ": "ï", "ϋ": "ü", "ΐ": "ï",
}
_LOOKS = str.maketrans(LOOKS)
#: Seen as nothing: format characters, fillers, variation selectors, control characters other than blanks.
INVISIBLE = "\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0\\u0000-\\u0008\\u000e-\\u001f\\u007f"
BLANK = "\\u0009\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
HYPHEN = "\\u2010\\u2011\\u2012\\u2043\\u2212\\ufe58\\ufe63\\uff0d"
LIGATURE = "\\ufb00-\\ufb06\\u0132\\u0133\\u01c7-\\u01cc\\u01f1-\\u01f3"
WIDTH = "\\uff01-\\uff5e\\uff5f-\\uffee\\u3000"
ACCENT = "\\u0300-\\u036f\\u1ab0-\\u1aff\\u1dc0-\\u1dff\\u20d0-\\u20ff\\ufe20-\\ufe2f"
OTHER = "\\u0370-\\u03ff\\u1f00-\\u1fff\\u0400-\\u052f"

_wide = re.compile(f"[{LIGATURE}{WIDTH}]+")
_invisible, _blank, _hyphen = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{BLANK}]"), re.compile(f"[{HYPHEN}]")
_accent = re.compile(f"[{ACCENT}]")
_joined = re.compile(f"(?<=[^\\W\\d_{OTHER}])[‌‍]|[‌‍](?![؀-෿\U0001f000-\U0001ffff])")
_letters = re.compile(r"[^\W\d_]+")
_other = re.compile(f"[{OTHER}]")
_unusual = re.compile(f"[{INVISIBLE}{BLANK}{HYPHEN}{LIGATURE}{WIDTH}{ACCENT}]")
_latin = re.compile("[a-zA-ZÀ-ɏ]")


def plain_characters(text: str) -> str:
    """Width variants, ligatures, apart accents, blanks, hyphens and invisible characters in their usual form."""
    if text.isascii() and text.isprintable() or not _unusual.search(text):
        return text
    if _wide.search(text):
        text = _wide.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if _invisible.search(text):
        # joiners belong to some scripts and to emoji; between Latin letters they are invisible filling
        kept = [m.start() for m in re.finditer("[‌‍️]", text) if not _joined.match(text, m.start()) and m.start() and ord(text[m.start() - 1]) > 0x05FF]
        parts, at = [], 0
        for k in kept:
            parts += [_invisible.sub("", text[at:k]), text[k]]
            at = k + 1
        text = "".join(parts) + _invisible.sub("", text[at:])
    text = _hyphen.sub("-", _blank.sub(" ", text))
    return unicodedata.normalize("NFC", text) if _accent.search(text) else text


def mixed_tokens(text: str) -> list[tuple[str, str]]:
    """Tokens of ``plain_characters`` text whose dominant script is Latin but that hold letters of another one, each with its Latin reading.

    The dominant script is that of most letters, Latin in a tie. A token with a letter that looks like no Latin
    one is rightly written in two scripts and left out.
    """
    out = []
    if not _other.search(text):
        return out
    for m in _letters.finditer(text):
        t = m.group()
        if 0 < len(_other.findall(t)) <= len(_latin.findall(t)):
            read = t.translate(_LOOKS)
            if not _other.search(read):
                out.append((t, read))
    return out


def repair(text: str, accepted: dict[str, str]) -> str:
    """The accepted readings put in place of their mixed tokens."""
    if not accepted or not _other.search(text):
        return text
    return _letters.sub(lambda m: accepted.get(m.group(), m.group()), text)


def read_alike(text: str) -> str:
    """For comparison only: plain characters, and every look-alike of a mixed token read as Latin, known word or not."""
    text = plain_characters(text)
    return repair(text, dict(mixed_tokens(text)))


def latin_looks(text: str) -> str:
    """For comparison only: every look-alike letter as the Latin one, in whatever word."""
    return text.translate(_LOOKS) if _other.search(text) else text


_word = re.compile(r"[^\W_]+")
_marks = re.compile("[\u0300-\u036f]+")


def folded(text: str) -> str:
    """Without case and accents."""
    text = text.lower()
    return text if text.isascii() else _marks.sub("", unicodedata.normalize("NFKD", text))


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, without case and accents; ``_x000D_`` leftovers are none."""
    return _word.findall(folded(text.replace("_x000D_", " "))) if text else []


def word_hashes(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and the offsets of each list: what is equal over batches and machines."""
    import pandas as pd

    flat = [w for x in lists for w in x]
    offs = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
    if not flat:
        return np.zeros(0, np.uint64), offs
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    return pd.util.hash_array(np.array(uniques, dtype=object), categorize=False)[codes], offs


_BASE = 0x9E6C63D0876A9A47
_SLOW, _GONE = 0x110001, 0x110000


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its ``folded`` form if that is one character whatever stands beside it, and whether it belongs to words; powers of the base and of its inverse."""
    fold = np.arange(0x110002, dtype=np.uint32)
    fold[0x10000:0x110000] = _SLOW
    for c in range(0x10000):
        x = chr(c)
        got = "" if 0xD800 <= c < 0xE000 else folded(x)
        if c == 0x3A3 or 0xD800 <= c < 0xE000 or len(got) > 1 or any(unicodedata.combining(y) for y in got):
            fold[c] = _SLOW
        else:
            fold[c] = ord(got) if got else _GONE
    part = np.zeros(0x110002, bool)
    part[:0x110000] = [chr(c).isalnum() for c in range(0x110000)]
    n = 1 << 16
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = (np.r_[np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))] for b in (_BASE, inverse))
    return fold, part, up, down


def word_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What ``word_hashes`` of the ``words`` of texts tells, other numbers for the same words: no Python object is made per word.

    Characters are folded by a table; a text with one that folds to several, or by its neighbours, is folded by
    itself. A word's number is the polynomial of its characters, a difference of running sums modulo 2^64.
    """
    fold, part, up, down = _tables()
    plain = [t.replace("_x000D_", " ") for t in texts]
    codes = []
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in plain]
    for i, x in enumerate(raw):
        y = fold[x]
        if len(y) and y.max() == _SLOW:
            y = np.frombuffer(folded(plain[i]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes.append(y)
        codes.append(_BREAK)
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    size = np.array([len(x) for x in codes[::2]], np.int64) + 1
    c = np.concatenate(codes)
    owner = np.repeat(np.arange(len(texts)), size)
    if (gone := c == _GONE).any():
        c, owner = c[~gone], owner[~gone]
    inside = part[c]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    step = len(up) - 1
    with np.errstate(over="ignore"):
        at = np.arange(len(c)) % step
        total = np.r_[np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[at])]
        # a word that passes a multiple of the step would mix two scales: those few are summed by themselves
        out = (total[end] - total[start]) * down[start % step]
        for i in np.flatnonzero(start // step != (end - 1) // step):
            x = c[start[i] : end[i]].astype(np.uint64) + np.uint64(1)
            out[i] = sum(int(v) * pow(_BASE, j, 1 << 64) for j, v in enumerate(x)) & 0xFFFFFFFFFFFFFFFF
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out, np.r_[0, np.cumsum(np.bincount(owner[start], minlength=len(texts)))]


_BREAK = np.array([32], np.uint32)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of k words from every position on, modulo 2^64, then mixed so that minima fall evenly."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x100000001B3) + hashes[j : j + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def take(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of several ranges in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
