"""Query of packed fields."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.packed import CODES, LABELS, explode_packed
from ..session import table
from .registry import Registry

add = Registry()


_QUOTED = r"""[ \t\n\r\[\]{}]*"(?:[^"]|"")*"|[ \t\n\r\[\]{}]*'(?:[^']|'')*'|""".replace("'", "''")
_BARE = "trim(x, chr(9) || chr(10) || chr(13) || ' []{}')"


def _unpacked(tbl: str, field: str, delimiters: str, dash: bool) -> str:
    """The values by regular expressions: brackets round the whole field go, a quoted or an unquoted run is a value, its quotes go."""
    text = rf"regexp_replace({field}, '^\s*\((.*)\)\s*$', '\1', 's')"
    text = rf"regexp_replace({text}, '\s-\s', ';', 'g')" if dash else text
    inner = f"substr({_BARE}, 2, len({_BARE}) - 2)"
    unquoted = f"""WHEN regexp_full_match({_BARE}, '(?s)".*"') THEN trim(replace({inner}, '""', '"')) WHEN regexp_full_match({_BARE}, '(?s)''.*''') THEN trim(replace({inner}, chr(39) || chr(39), chr(39)))"""
    values = f"list_filter(list_transform(regexp_extract_all({text}, '{_QUOTED}[^{delimiters}]+'), lambda x: CASE {unquoted} ELSE {_BARE} END), lambda x: x <> '' AND x <> '-')"
    return f"SELECT '{tbl}' AS tbl, referencia, generate_subscripts(v, 1)::INT AS pos, unnest(v) AS val FROM (SELECT referencia, {values} AS v FROM {tbl})"


_CODES, _LABELS = _unpacked("proyectos", "unesco_cd", r",;|/+\n\r\t ", False), _unpacked("labels_info", "labelstr", r",;|/+\n\r\t", True)


@add("p3_found", f"{_CODES} UNION ALL {_LABELS}")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of proyectos.unesco_cd and labels_info.labelstr; both keys are unique, so rows are distinct."""
    parts = [("proyectos", "unesco_cd", CODES), ("labels_info", "labelstr", LABELS)]
    found = [explode_packed(table(spark, sf_dir, t), "referencia", f, d).select(F.lit(t).alias("tbl"), F.col("key").alias("referencia"), "pos", "val") for t, f, d in parts]
    return found[0].unionByName(found[1])
