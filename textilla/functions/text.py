"""Text functions as column expressions: all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: The characters of a token, and its shape (runs joined by a plus or a point).
_V = "a-zA-Z0-9áéíóúÁÉÍÓÚñÑüàèìòùâêîôûçÇ"
TOKEN = f"[{_V}]{{1,}}(?:[+]?[{_V}]{{1,}})?(?:[.]?[{_V}]{{2,}})?"
#: Words of the vectoriser: two word characters or more.
WORD = r"[\p{L}\p{N}_]{2,}"
#: Frequent words that tell a language (a subset of public stop-word lists).
STOP = {
    "es": "de la que el en y a los del se las por un para con no una su al lo como más",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this",
    "ca": "i el la de que els les a en per amb un una és del dels al no es més ha com aquest això també",
    "pt": "o a de que e do da em um para com não uma os no se na por mais as dos como ao pelo foi",
    "fr": "le la de et les des en un une du dans est que pour qui par sur au plus ne pas ce avec il sont",
}
#: Stems that seed four labels.
BIOTEC = ["biotecnol", "biofabric", "biolixiv", "bionanotec", "biorremed", "mutagenesis", "viroterapia", "bioproduc", "bioplastico", "bioprocesamiento", "biocatalisis", "bioferment", "biomaterial", "transgenico"]
NANOTEC = ["nanotecnol", "nanomaterial", "nanotubo", "nanosistema", "nanoescala", "nanoparticula", "nanorobot", "nanorrobot", "bionanotecnol", "nanoestructura"]
AMBIENTAL = ["ambiental", "medio ambiente", "biorremediacion"]
SALUD = ["salud", "farmaco", "medicina", "viroterapia", "enfermedad", "terapia", "biomedicina"]
AGRIC = ["agricola", "agricultura", "transgenic", "planta", "semilla"]


def _list(items: Sequence[str]) -> Column:
    return F.array(*(F.lit(x) for x in items)).cast("array<string>")


def detect_language(text: Column, stop: dict[str, str] = STOP) -> Column:
    """The configured language whose frequent words make up most of the text; the first wins a tie, null for no text."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))

    def known(words: str) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(words.split())))

    score = [F.struct(known(v).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, v) in enumerate(stop.items())]
    return F.when(text.isNotNull(), F.array_max(F.array(*score))["k"])


def sentences(text: Column) -> Column:
    """Cut behind a full stop, question or exclamation mark and blanks."""
    return F.split(text, r"(?<=[.!?])\s+")


def tokens(text: Column) -> Column:
    """Tokens in their case."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words of two characters or more, as the vectoriser counts them."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def drop_stop(array: Column, stop: Sequence[str]) -> Column:
    """Tokens that are no stop-words, order and repetitions kept."""
    return F.filter(array, lambda t: ~F.array_contains(_list(stop), t)) if stop else array


def join_ngrams(text: Column, ngrams: Sequence[str], equivalences: dict[str, str] | None = None) -> Column:
    """N-grams joined by ``_`` in the list's order, then whole-word replacements."""
    for g in ngrams:
        text = F.regexp_replace(text, rf"\b{g}\b", g.replace(" ", "_"))
    for old, new in (equivalences or {}).items():
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_]){old}(?![\p{{L}}\p{{N}}_])", new)
    return text


def drop_numbers(array: Column) -> Column:
    """Tokens that read as a number are left out, exponents, nan, infinity and grouped digits included."""
    return F.filter(array, lambda t: ~F.lower(t).rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)$"))


def assemble(title: Column, text: Column, title_lang: Column, times: int = 1, version: int = 2) -> Column:
    """The lower-cased text, after the title ``times`` times if that is Spanish; version 1 drops points."""
    head = F.when(title_lang == "es", F.concat(F.repeat(F.concat(F.coalesce(title, F.lit("")), F.lit(" ")), times), F.lit("\n" if version == 1 else ""))).otherwise("")
    out = F.translate(F.lower(F.concat(head, F.coalesce(text, F.lit("")))), "\n", " ")
    return F.translate(out, ".", " ") if version == 1 else F.concat(out, F.lit(" "))


def display_case(text: Column) -> Column:
    """Sentences with a capital and lower-cased otherwise, parted by a point and a blank."""
    part = F.filter(F.transform(F.split(F.lower(text), r"\."), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(part, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), ". ")


def clean_labels(text: Column, sep: str = ",") -> Column:
    """The labels of a list without empty ones, those of level 1 (``_`` at the end) and repetitions, in order."""
    parts = F.transform(F.split(text, "\\Q" + sep + "\\E"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & ~F.endswith(x, F.lit("_"))))


def code_areas(text: Column, sep: str = ",") -> Column:
    """The first two characters of each code of two or more, distinct and sorted."""
    parts = F.filter(F.transform(F.split(text, "\\Q" + sep + "\\E"), lambda x: F.trim(x)), lambda x: F.length(x) >= 2)
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.substring(x, 1, 2))))


def map_codes(df: DataFrame, key: str, codes: str, mapping: DataFrame, source: str, target: str, sep: str = r"[^0-9]+") -> DataFrame:
    """(key, mapped): a list of codes taken to another scheme, in order and without repetitions.

    A code without an entry of its own is looked up by its first digits (code div 100). Codes that map to nothing,
    and null lists, give no entry. The mapping has each code once.
    """
    one = df.select(F.col(key), F.posexplode(F.array_distinct(F.filter(F.split(F.regexp_replace(codes, r"\.0*(?![0-9])", ""), sep), lambda x: x != ""))).alias("pos", "code")).select(key, "pos", F.try_to_number("code", F.lit("999999999999")).cast("bigint").alias("code"))
    m = mapping.select(F.col(source).cast("bigint").alias("c"), F.col(target).alias("t")).filter("t IS NOT NULL")
    near, far = m.select(F.col("c").alias("c1"), F.col("t").alias("t1")), m.select(F.col("c").alias("c2"), F.col("t").alias("t2"))
    both = one.join(near, F.col("code") == F.col("c1"), "left").join(far, F.expr("code div 100") == F.col("c2"), "left").withColumn("t", F.coalesce("t1", "t2")).filter("t IS NOT NULL")
    first = both.groupBy(key, "t").agg(F.min("pos").alias("pos"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("x")).select(key, F.array_join("x.t", ",").alias("mapped"))


def wid(url: Column, mode: str = "yes") -> Column:
    """An identifier made of a url; ``www`` only strips a leading www., anything else leaves it."""
    if mode == "yes":
        out = F.lower(url)
        for a, b in (("http://", ""), ("//", ""), ("www.", ""), (".", "_"), ("/", "__")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out
    return F.regexp_replace(url, r"^www\.", "") if mode == "www" else url


def curate_url(name: Column) -> Column:
    """A url made of a file name."""
    out = F.regexp_replace(name, "[\r\n]", "")
    for a, b in ((".txt", ""), ("_", "."), ("http://", ""), ("www.", ""), ("/", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def seed_labels(tags: Column, title: Column, text: Column, multiclass: bool = False) -> Column:
    """Labels put before the others if stems of their field occur; with ``multiclass`` they replace a single one."""
    body = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    has = lambda stems: F.exists(_list(stems), lambda s: F.contains(body, s))
    bio, out = has(BIOTEC), tags
    for hit, name in ((bio & has(AMBIENTAL), "BioTecAmb"), (bio & has(SALUD), "BioTecSalud"), (bio & has(AGRIC), "BioTecAgr"), (has(NANOTEC), "NanoTec")):
        more = F.concat(F.array(F.lit(name)), out)
        out = F.when(hit, F.when(F.size(out) == 1, F.array(F.lit(name))).otherwise(more) if multiclass else more).otherwise(out)
    return out


def display_url(url: Column) -> Column:
    """A url that a browser opens."""
    return F.when(F.startswith(url, F.lit("http")), url).when(F.startswith(url, F.lit("www.")), F.concat(F.lit("http://"), url)).otherwise(F.concat(F.lit("http://www."), url))
