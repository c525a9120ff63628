"""Spanish stems over the distinct vocabulary, and the chain from text to lemmas.

The stemmer follows the published description of the Snowball Spanish algorithm: regions RV, R1 and R2, attached
pronouns, standard suffixes, verb suffixes, residual vowels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import text as tx

VOWELS = "aeiouáéíóúü"
#: Fixed values of the published algorithm.
PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
STEP1 = {
    "": "amientos imientos amiento imiento aciones uciones adoras adores ancias logías encias amente idades anzas ismos ables ibles istas adora ación antes ancia logía ución encia mente anza icos icas ismo able ible ista osos osas ador ante idad ivas ivos ico ica oso osa iva ivo".split(),
}
VERB_Y = "yeron yendo yamos yais yan yen yas yes ya ye yo yó".split()
VERB = "aríamos eríamos iríamos iéramos iésemos aríais aremos eríais eremos iríais iremos ierais ieseis asteis isteis ábamos áramos ásemos arían arías aréis erían erías eréis irían irías iréis ieran iesen ieron iendo ieras ieses abais arais aseis íamos arán arás aría erán erás ería irán irás iría iera iese aste iste aban aran asen aron ando abas adas idas aras ases íais ados idos amos imos ará aré erá eré irá iré aba ada ida ara ase ían ado ido ías áis ía ad ed id an ió ar er ir as ís en es éis emos".split()
_plain = str.maketrans("áéíóú", "aeiou")


def _regions(w: str) -> tuple[int, int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    r1 = after(0)
    r2 = after(r1)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in VOWELS), len(w))
        elif w[0] in VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in VOWELS), len(w))
        else:
            rv = 3
    return rv, r1, r2


def _ends(w: str, suffixes: Sequence[str]) -> str:
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    w = word.lower()
    rv, r1, r2 = _regions(w)
    p = _ends(w, PRONOUNS)
    if p and len(w) - len(p) >= rv:
        head = w[: -len(p)]
        v = _ends(head, ["iéndo", "ándo", "ár", "ér", "ír", "iendo", "ando", "ar", "er", "ir", "yendo"])
        if v and len(head) - len(v) >= rv and (v != "yendo" or head[: -len(v)].endswith("u")):
            w = head[: -len(v)] + v.translate(_plain)
    before = w
    s = _ends(w, STEP1[""])
    at = len(w) - len(s)
    if s:
        if s == "amente" and at >= r1:
            w = w[:at]
            t = _ends(w, ["iv", "os", "ic", "ad"])
            if t and len(w) - len(t) >= r2:
                w = w[: -len(t)]
                if t == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                    w = w[:-2]
        elif at >= r2:
            w = w[:at]
            if s in ("logía", "logías"):
                w += "log"
            elif s in ("ución", "uciones"):
                w += "u"
            elif s in ("encia", "encias"):
                w += "ente"
            elif s in ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias"):
                w = w[:-2] if w.endswith("ic") and len(w) - 2 >= r2 else w
            elif s == "mente":
                t = _ends(w, ["ante", "able", "ible"])
                w = w[: -len(t)] if t and len(w) - len(t) >= r2 else w
            elif s in ("idad", "idades"):
                t = _ends(w, ["abil", "ic", "iv"])
                w = w[: -len(t)] if t and len(w) - len(t) >= r2 else w
            elif s in ("iva", "ivo", "ivas", "ivos"):
                w = w[:-2] if w.endswith("at") and len(w) - 2 >= r2 else w
    if w == before:
        t = _ends(w[rv:], VERB_Y)
        if t and w[: -len(t)].endswith("u"):
            w = w[: -len(t)]
        else:
            t = _ends(w[rv:], VERB)
            if t:
                w = w[: -len(t)]
                if t in ("en", "es", "éis", "emos") and w.endswith("gu"):
                    w = w[:-1]
    t = _ends(w[rv:], ["os", "a", "o", "á", "í", "ó", "e", "é"])
    if t:
        w = w[: -len(t)]
        if t in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_plain)


def stems(vocabulary: DataFrame, column: str = "token") -> DataFrame:
    """(token, stem) of distinct tokens: the stemmer runs once per token of the corpus, not per occurrence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"token": b["token"], "stem": [stem(t) for t in b["token"]]})

    return vocabulary.select(F.col(column).alias("token")).distinct().mapInPandas(run, "token string, stem string")


def accented(tokens: DataFrame, dictionary: DataFrame, column: str = "token") -> DataFrame:
    """T5: (token, lemma): the dictionary form reached by accenting each vowel in turn, the first hit, else the token.

    dictionary (word) stands for the spelling resource, which has to be supplied.
    """
    base = F.lower("w0")
    one = F.struct(F.lit(0).alias("at"), base.alias("word"))
    change = lambda i: F.struct(i.alias("at"), F.concat(F.substring(base, F.lit(1), i - 1), F.translate(F.substring(base, i, F.lit(1)), "aeiou", "áéíóú"), F.substring(base, i + 1, F.length(base))).alias("word"))
    cand = tokens.select(F.col(column).alias("token")).distinct().select(F.col("token").alias("w0")).filter("length(w0) > 0")
    cand = cand.select(F.col("w0").alias("token"), F.explode(F.concat(F.array(one), F.transform(F.sequence(F.lit(1), F.length(base)), change))).alias("x"))
    hit = cand.select("token", "x.at", "x.word").join(dictionary.select("word").distinct(), "word").groupBy("token").agg(F.min_by("word", "at").alias("lemma"))
    return tokens.select(F.col(column).alias("token")).distinct().join(hit, "token", "left").withColumn("lemma", F.coalesce("lemma", F.lower("token")))


def lemmatise(df: DataFrame, key: str, text: str, stop: Sequence[str] = (), keep_sentences: bool = True) -> DataFrame:
    """(key, lemmas): sentences, tokens, stems, stop-words (stemmed too), numbers out; blanks join tokens, line ends sentences."""
    cut = tx.sentences(F.col(text)) if keep_sentences else F.array(F.col(text))
    cells = df.select(F.col(key).alias("key"), F.posexplode(cut).alias("s", "sentence")).select("key", "s", F.posexplode(tx.tokens(F.col("sentence"))).alias("t", "token"))
    ready = cells.join(stems(cells), "token")
    out = sorted({stem(w) for w in stop})
    kept = ready.filter(~F.col("stem").isin(out)) if out else ready
    kept = kept.filter(F.size(tx.drop_numbers(F.array("stem"))) == 1)
    lines = kept.groupBy("key", "s").agg(F.array_sort(F.collect_list(F.struct("t", "stem"))).alias("x")).select("key", "s", F.array_join("x.stem", " ").alias("line"))
    joined = lines.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "line"))).alias("x")).select("key", F.array_join("x.line", "\n").alias("lemmas"))
    return df.select(F.col(key).alias("key")).distinct().join(joined, "key", "left").select(F.col("key").alias(key), F.coalesce("lemmas", F.lit("")).alias("lemmas"))
