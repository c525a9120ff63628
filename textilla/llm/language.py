"""Language of documents and of stretches in another language: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled texts. It reads two
bytes in a step and labels both; the bytes of a sentence, and the sentences of a text, are pooled.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LANGS = ("es", "en", "ca", "pt", "fr")
#: Forms of a language's label, before any region.
FORMS = {
    "es": "es spa español espanol castellano spanish",
    "en": "en eng inglés ingles english",
    "ca": "ca cat català catala catalán catalan",
    "pt": "pt por português portugues portugués portuguese",
    "fr": "fr fra fre français francais francés frances french",
}
_FORM = {w: k for k, v in FORMS.items() for w in v.split()}
#: Texts of the labelled sample, at most; training steps; bytes of a training window.
SAMPLE, STEPS, SPAN, BATCH, HIDDEN, EMBED = 6000, 640, 56, 64, 24, 12
#: A change of language costs as much as a sentence that speaks clearly against it; a label counts as weak evidence.
SWITCH, LABEL = 4.0, 1.0

# what any of the alternatives can begin with is looked at first, since at most places none does
_sentence = re.compile(r"(?=[\s\"”»)\]_])(?:(?<=[.!?…])[\"”»)\]]*\s+|\s*(?:\r?\n|_x000D_)+\s*|\s+(?://|\|)\s+)")
_title = re.compile(r"(?=[\s\"”»)\]_])(?:(?<=[.!?…;])[\"”»)\]]*\s+|\s*(?:\r?\n|_x000D_)+\s*|\s+(?:/{1,2}|\||[-–—])\s+)")
_word = re.compile(r"[^\W_]+")


def label_of(label: str | None) -> str | None:
    """The language that a label names, in any case, with or without a region, or None."""
    return _FORM.get(re.split(r"[-_ (]", label.strip().lower())[0]) if label else None


def _has_words(text: str, n: int) -> bool:
    return next(itertools.islice(_word.finditer(text), n - 1, None), None) is not None


def pieces(text: str, joined: bool = False) -> list[str]:
    """Sentences, or with ``joined`` the titles that one field joins by a stroke, bar, dash, semicolon or stop.

    A sentence of under four words goes with the one before: a note or a borrowed phrase is no stretch.
    """
    if joined:
        return [p for p in _title.split(text) if p and not p.isspace()]
    out: list[str] = []
    for p in _sentence.split(text):
        if p and not p.isspace():
            if out and not _has_words(p, 4):
                out[-1] += " " + p
            else:
                out.append(p)
    return out


_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def encode(text: str) -> np.ndarray:
    """Bytes without case and with all digits alike."""
    return np.frombuffer(text.lower().encode().translate(_DIGITS), np.uint8)


@dataclass
class Net:
    """A gated recurrent layer in either direction; w holds the arrays."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, rng: np.random.Generator, hidden: int = HIDDEN, embed: int = EMBED) -> Net:
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        w = {"E": g(256, embed) * 4, "V": g(2 * hidden, len(LANGS)), "c": np.zeros(len(LANGS), np.float32)}
        for d in "fb":
            w |= {f"X{d}": g(embed, 3 * hidden), f"Y{d}": g(embed, 3 * hidden), f"B{d}": np.zeros(3 * hidden, np.float32), f"H{d}": g(hidden, 3 * hidden)}
        return cls(w)

    def run(self, ids: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Log-probabilities (B, T, languages) of ids (B, T, 2); with ``keep`` what the backward pass needs."""
        w, (size, span) = self.w, ids.shape[:2]
        hidden = w["Hf"].shape[0]
        outs, saved = [], []
        for d in "fb":
            first, second = w["E"] @ w[f"X{d}"] + w[f"B{d}"], w["E"] @ w[f"Y{d}"]
            rec, h = w[f"H{d}"], np.zeros((size, hidden), np.float32)
            states, steps = np.empty((span, size, hidden), np.float32), []
            for t in range(span) if d == "f" else range(span - 1, -1, -1):
                x, u = first[ids[:, t, 0]] + second[ids[:, t, 1]], h @ rec
                rz = 0.5 * np.tanh(0.5 * (x[:, : 2 * hidden] + u[:, : 2 * hidden])) + 0.5
                r, z = rz[:, :hidden], rz[:, hidden:]
                n = np.tanh(x[:, 2 * hidden :] + r * u[:, 2 * hidden :])
                new = n + z * (h - n)
                if keep:
                    steps.append((t, h, r, z, n, u[:, 2 * hidden :]))
                h = np.where(mask[:, t, None], new, h)
                states[t] = h
            outs.append(states)
            saved.append(steps)
        both = np.concatenate(outs, 2)
        logits = both @ w["V"] + w["c"]
        logits -= logits.max(2, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(2, keepdims=True))
        return logp.transpose(1, 0, 2), [both, saved]

    def gradients(self, ids: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all steps, and its gradients by backpropagation through time."""
        w, (size, span) = self.w, ids.shape[:2]
        logp, (both, saved) = self.run(ids, mask, True)
        hidden, total = w["Hf"].shape[0], max(1, mask.sum())
        loss = -(logp[np.arange(size), :, labels] * mask).sum() / total
        d = np.exp(logp)
        d[np.arange(size), :, labels] -= 1
        d = (d * mask[:, :, None] / total).transpose(1, 0, 2).astype(np.float32)
        g = {"V": np.tensordot(both, d, ([0, 1], [0, 1])), "c": d.sum((0, 1)), "E": np.zeros_like(w["E"])}
        back = d @ w["V"].T
        for k, side in enumerate("fb"):
            gh = np.zeros_like(w[f"H{side}"])
            carry = np.zeros((size, hidden), np.float32)
            rec = w[f"H{side}"]
            grads = np.empty((span, size, 3 * hidden), np.float32)
            for t, h, r, z, n, un in reversed(saved[k]):
                dh = back[t][:, k * hidden : (k + 1) * hidden] + carry
                live = mask[:, t, None]
                dn = dh * (1 - z) * (1 - n * n) * live
                dz = dh * (h - n) * z * (1 - z) * live
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dr, dz, dn * r], 1)
                gh += h.T @ du
                carry = np.where(live, dh * z, dh) + du @ rec.T
                grads[t] = np.concatenate([dr, dz, dn], 1)
            flat = grads.reshape(-1, 3 * hidden)
            g |= {f"H{side}": gh, f"B{side}": flat.sum(0)}
            for slot, name in enumerate((f"X{side}", f"Y{side}")):
                code = ids[:, :, slot].T.reshape(-1)
                hot = np.zeros((256, len(code)), np.float32)
                hot[code, np.arange(len(code))] = 1
                gx = hot @ flat
                g[name] = w["E"].T @ gx
                g["E"] += gx @ w[name].T
        return float(loss), g

    def pool(self, seqs: list[np.ndarray], batch: int = 512) -> np.ndarray:
        """(len, languages): summed log-probabilities of all steps of each sequence, as ``run`` gives them.

        Sequences of a batch stand by falling length, so that at each step those that still run are the first
        ones; the gates' tables hold only the pairs of bytes that the batch has, and halves are multiplied in.
        """
        w, hidden = self.w, self.w["Hf"].shape[0]
        out = np.zeros((len(seqs), len(LANGS)), np.float32)
        half = np.r_[np.full(2 * hidden, 0.5, np.float32), np.ones(hidden, np.float32)]
        cells = []
        for d in "fb":
            rec = w[f"H{d}"] * np.float32(0.5)
            cells.append(((w["E"] @ w[f"X{d}"] + w[f"B{d}"]) * half, (w["E"] @ w[f"Y{d}"]) * half, *(np.ascontiguousarray(rec[:, i * hidden : (i + 1) * hidden]) for i in range(3))))
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            ids, mask = pad([seqs[i] for i in own])
            live = mask.sum(0)
            start = np.r_[0, np.cumsum(live)]
            codes = (ids[:, :, 0].astype(np.int64) << 8 | ids[:, :, 1]).T
            used = np.zeros(1 << 16, bool)
            used[codes] = True
            pairs = np.flatnonzero(used)
            codes = (np.cumsum(used) - 1)[codes]
            states = np.empty((start[-1], 2 * hidden), np.float32)
            gate = [np.empty((len(own), hidden), np.float32) for _ in range(4)]
            for side, (first, second, *rec) in enumerate(cells):
                every = first[pairs >> 8] + second[pairs & 255]
                tables = [np.ascontiguousarray(every[:, i * hidden : (i + 1) * hidden]) for i in range(3)]
                state = np.zeros((len(own), hidden), np.float32)
                for t in range(len(live)) if side == 0 else range(len(live) - 1, -1, -1):
                    k, h = live[t], state[: live[t]]
                    r, z, n, u = (g[:k] for g in gate)
                    for g, table in zip((r, z, n), tables):
                        np.take(table, codes[t, :k], 0, out=g, mode="clip")
                    for g, m in zip((r, z), rec):
                        np.matmul(h, m, out=u)
                        g += u
                        np.tanh(g, out=g)
                        g += 1
                    np.matmul(h, rec[2], out=u)
                    u *= r
                    n += u
                    np.tanh(n, out=n)
                    h -= n
                    h *= z
                    h *= np.float32(0.5)
                    h += n
                    states[start[t] : start[t + 1], side * hidden : (side + 1) * hidden] = h
            logits = states @ w["V"] + w["c"]
            logits -= logits.max(1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(1, keepdims=True))
            acc = np.zeros((len(own), len(LANGS)), np.float32)
            for t in range(len(live)):
                acc[: live[t]] += logits[start[t] : start[t + 1]]
            out[own] = acc
        return out


def pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids (B, T, 2), mask (B, T)): two bytes in a step; a last byte alone has 0 beside it."""
    span = max(1, max(((len(s) + 1) // 2 for s in seqs), default=1))
    ids, mask = np.zeros((len(seqs), span * 2), np.uint8), np.zeros((len(seqs), span), bool)
    for i, s in enumerate(seqs):
        ids[i, : len(s)], mask[i, : (len(s) + 1) // 2] = s, True
    return ids.reshape(len(seqs), span, 2), mask


@functools.lru_cache(4)
def trained(texts: tuple[str, ...], labels: tuple[int, ...]) -> Net:
    """``train``, once in a session for each sample."""
    return train(list(texts), list(labels))


def train(texts: list[str], labels: list[int], seed: int = 7, steps: int = STEPS) -> Net:
    """Adam over random windows of sentences whose labels may be wrong or hold for a part of the text only.

    Half-way and at three quarters of the steps the network reads all sentences of the sample, and goes on with
    those whose label it confirms, balanced over the languages.
    """
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng)
    pool = [(e, y) for t, y in zip(texts, labels) for p in pieces(t, len(t) < 250) if len(e := encode(p)) > 12]
    if not pool:
        return net
    y = np.array([p[1] for p in pool])
    draw = [np.arange(len(pool))]
    m, v = ({k: np.zeros_like(a) for k, a in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        if step in (steps // 2, steps * 3 // 4):
            said = net.pool([e[:400] for e, _ in pool]).argmax(1)
            draw = [own for k in range(len(LANGS)) if len(own := np.flatnonzero((said == k) & (y == k)))] or draw
        rows, ys = [], []
        for _ in range(BATCH):
            own = draw[rng.integers(len(draw))]
            e, label = pool[own[rng.integers(len(own))]]
            at = rng.integers(0, max(1, len(e) - SPAN + 1))
            rows.append(e[at : at + SPAN])
            ys.append(label)
        ids, mask = pad(rows)
        _, g = net.gradients(ids, mask, np.array(ys))
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.015 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, a in g.items():
            a = a * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.98 * v[k] + 0.02 * a * a
            net.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return net


def sample(df: DataFrame, text: str, label: str, witness: str | None = None, size: int = SAMPLE) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """About ``size`` labelled texts, twice as many at most, drawn by a hash of the text; labels with the root of their number.

    The root lets rare languages in. A ``witness`` is a second label, of a text that belongs to the same record:
    only texts whose two labels name one language are drawn, since two wrong labels seldom agree.
    """
    named = F.create_map(*(x for k, v in _FORM.items() for x in (F.lit(k), F.lit(v))))
    names = lambda c: F.try_element_at(named, F.regexp_extract(F.lower(F.trim(df[c])), r"^([^\-_ (]+)", 1))
    base = df.filter(names(label) == names(witness)) if witness else df
    base = base.select(df[text].cast("string").alias("text"), names(label).alias("lang")).filter("lang IS NOT NULL AND length(text) > 20")
    counts = {r["lang"]: r["count"] for r in base.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return (), ()
    roots = sum(n**0.5 for n in counts.values())
    odds = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, size * n**0.5 / roots / n)))))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    got = base.filter(draw < odds[F.col("lang")]).limit(2 * size).collect()
    rows = sorted((r["text"], LANGS.index(r["lang"])) for r in got)  # the order of rows tells nothing
    return tuple(r[0] for r in rows), tuple(r[1] for r in rows)


def said(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What pieces say for each language: their mean log-probability, at most as loud as 30 steps."""
    return scores / np.maximum(1, sizes)[:, None] * (np.minimum(sizes, 30) / 3.0)[:, None]


def stretches(say: np.ndarray) -> list[tuple[int, float]]:
    """(language, confidence) of the stretches of a text from what its pieces say.

    A path over the pieces that pays for each change of language is found by dynamic programming.
    """
    best, back = say[0].copy(), []
    for s in say[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back.append(np.where(stay, np.arange(len(LANGS)), top))
        best = np.where(stay, best, best[top] - SWITCH) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    out: list[tuple[int, float]] = []
    at = 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[at]:
            pooled = np.exp(say[at:i].sum(0) - say[at:i].sum(0).max())
            out.append((path[at], float(pooled[path[at]] / pooled.sum())))
            at = i
    return out


def identify(df: DataFrame, key: str, text: str, label: str, net: Net, joined: Column | None = None, min_words: int = 5) -> DataFrame:
    """(key, seg, lang, confidence, n_segs, recorded) of every text of at least ``min_words`` words, one row per stretch.

    recorded is the language that the label names, or null. ``joined`` is true for fields that join titles. Null, blank and shorter texts give no row; repeated
    keys give the rows of each; other columns are not read; an empty table gives no rows. Whole texts are read:
    a sentence beyond 400 bytes goes through the network in parts that are pooled. Narrow: no shuffle.
    """
    schema = "key string, seg int, lang string, confidence double, n_segs int, recorded string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), 5000):  # what recurs within a part is read once
                b = whole.iloc[lo : lo + 5000]
                slot: dict[str, int] = {}
                seqs: list[np.ndarray] = []
                parts: list[list[int]] = []
                texts = []
                for t, many in zip(b["text"], b["joined"]):
                    if not _has_words(t, min_words):
                        texts.append([])
                        continue
                    own = []
                    for p in pieces(t, many):
                        if p not in slot:
                            slot[p] = len(parts)
                            e = encode(p)
                            parts.append(list(range(len(seqs), len(seqs) + (len(e) + 399) // 400)))
                            seqs += [e[x : x + 400] for x in range(0, len(e), 400)]
                        own.append(slot[p])
                    texts.append(own)
                rows = []
                use = [i for i, own in enumerate(texts) if own]
                if use:
                    n = np.array([len(p) for p in parts])
                    first = np.cumsum(n) - n
                    score = np.add.reduceat(net.pool(seqs), first, 0)
                    size = np.add.reduceat(np.array([(len(x) + 1) // 2 for x in seqs]), first)
                    many = np.array([len(texts[i]) for i in use])
                    begin = np.cumsum(many) - many
                    labels = b["label"].tolist()
                    recs = [label_of(labels[i]) for i in use]
                    say = said(score, size)[np.concatenate([texts[i] for i in use])]
                    told = np.repeat([LANGS.index(r) if r else -1 for r in recs], many)
                    at = np.flatnonzero(told >= 0)
                    say[at, told[at]] += LABEL
                    top = say.argmax(1)
                    alike = np.minimum.reduceat(top, begin) == np.maximum.reduceat(top, begin)  # then no change pays
                    pooled = np.add.reduceat(say, begin, 0)
                    sure = 1 / np.exp(np.minimum(pooled - pooled[np.arange(len(use)), top[begin]][:, None], 50.0)).sum(1)
                    keys = b["key"].tolist()
                    for k, i in enumerate(use):
                        got = [(int(top[begin[k]]), float(sure[k]))] if alike[k] else stretches(say[begin[k] : begin[k] + many[k]])
                        rows += [(keys[i], j, LANGS[g], c, len(got), recs[k]) for j, (g, c) in enumerate(got, 1)]
                yield pd.DataFrame(rows, columns=["key", "seg", "lang", "confidence", "n_segs", "recorded"])

    src = df.select(df[key].cast("string").alias("key"), df[text].cast("string").alias("text"), df[label].cast("string").alias("label"), (F.lit(False) if joined is None else F.coalesce(joined, F.lit(False))).alias("joined")).filter("text IS NOT NULL")
    return src.mapInPandas(run, schema)
