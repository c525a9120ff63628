"""The warehouse: scans, sinks, DDL and set-based DML over Parquet directories or catalog tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


# Scans


def open_jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None, **options: str) -> DataFrame:
    """A relational table through JDBC, where its driver is on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return (reader.option("driver", driver) if driver else reader).load()


def read_table(df: DataFrame, select: str | Sequence[str] | None = None, where: str | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
    """SELECT select FROM df WHERE where ORDER BY order LIMIT limit, each part optional SQL text."""
    columns = ", ".join(select) if isinstance(select, (list, tuple)) else select or "*"
    text = f"SELECT {columns} FROM {{src}}" + (f" WHERE {where}" if where else "") + (f" ORDER BY {order}" if order else "") + (f" LIMIT {int(limit)}" if limit is not None else "")
    return df.sparkSession.sql(text, src=df)


def read_excel(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """S3: one sheet, where pandas finds an Excel reader; blank cells become null."""
    import pandas as pd

    frame = pd.read_excel(path, dtype=str, **options)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None))


def read_directory(spark: SparkSession, path: str, fmt: str = "csv", glob: str = "*", **options: str) -> DataFrame:
    """All files below ``path`` whose name matches and doesn't begin with ``~``, text columns without nulls."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", True).option("pathGlobFilter", glob).options(**options)
    return reader.load(path).filter(~F.startswith(F.col("_metadata.file_name"), F.lit("~"))).na.fill("")


def read_predictions(spark: SparkSession, path: str, categories: Sequence[str]) -> DataFrame:
    """Predictions keyed by uid, from a CSV file with a header."""
    return spark.read.csv(path, header=True, schema="uid string, " + ", ".join(f"`{c}` double" for c in categories))


def _last(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``wid;label`` without a header; of lines with the same wid the later one wins."""
    lines = spark.read.text(path).select(F.rtrim(F.translate("value", "\r", "")).alias("v"), F.monotonically_increasing_id().alias("at"))
    parts = F.split("v", ";")
    return _last(lines.select(parts[0].alias("wid"), F.get(parts, F.lit(1)).alias("label"), "at").filter("wid != ''"), "wid", [F.desc("at")]).drop("at")


def read_urls(spark: SparkSession, path: str, mode: str = "yes") -> DataFrame:
    """Urls in the first column of a CSV without a header, keyed by their wid (T15); the later one wins."""
    from ..functions.text import wid

    lines = spark.read.text(path).select(F.regexp_replace(F.split("value", ",")[0], "[\r\n]", "").alias("url"), F.monotonically_increasing_id().alias("at"))
    return _last(lines.select(wid(F.col("url"), mode).alias("wid"), "url", "at").filter("url != ''"), "wid", [F.desc("at")]).drop("at")


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """What an earlier run saved, as Parquet."""
    return spark.read.parquet(path)


HISTORY = "map<string,map<string,struct<url:string,marker:int,relabel:int,label:string,date:string,userId:string>>>"


def read_history(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON text {wid: {tid: record}}, one row per record; a row that is no JSON gives none."""
    outer = df.select(F.explode(F.from_json(column, HISTORY)).alias("wid", "events"))
    return outer.select("wid", F.explode("events").alias("tid", "e")).select("wid", "tid", "e.url", "e.marker", "e.relabel", "e.label", F.try_to_timestamp("e.date").alias("date"), F.col("e.userId").alias("userid"))


def replace_documents(store: DataFrame, new: DataFrame, key: str = "idna") -> DataFrame:
    """Documents (key, value struct) replaced or inserted by key, the nested value as a whole."""
    return upsert(store, new, key)


def load_labels(info: DataFrame, label: DataFrame, key: str = "referencia") -> DataFrame:
    """Info left join label, as (key, info struct, label map of the known categories)."""
    cats = [c for c in label.columns if c != key]
    pack = F.create_map(*(x for c in cats for x in (F.lit(c), F.col(f"l.{c}").cast("int"))))
    joined = info.alias("i").join(label.alias("l"), F.col(f"i.{key}") == F.col(f"l.{key}"), "left")
    return joined.select(F.col(f"i.{key}").alias(key), F.struct(*(F.col(f"i.{c}") for c in info.columns if c != key)).alias("info"), F.map_filter(pack, lambda _, v: v.isNotNull()).alias("label"))


def save_labels(tables: dict[str, tuple[DataFrame, DataFrame, str]]) -> dict[str, DataFrame]:
    """The upsert of every table, {name: (stored, new, key)}."""
    return {name: upsert(old, new, key) for name, (old, new, key) in tables.items()}


def save_version(df: DataFrame, root: str, version: str) -> str:
    """A save that keeps what was there: each version has its own folder."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def wiki_definitions(taxonomy: DataFrame, pages: DataFrame, ref: str = "reference", links: str = "wikiref") -> DataFrame:
    """S14: 'title content ' of the ``+``-separated titles in their order; pages (title, content) stand for the network."""
    asked = taxonomy.select(ref, F.posexplode(F.split(links, r"\+")).alias("pos", "title"))
    found = asked.join(pages, "title").groupBy(ref).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("title", F.lit(" "), "content", F.lit(" ")).alias("t")))).alias("x"))
    return found.select(ref, F.array_join("x.t", "").alias("wikidefs"))


# Sinks


def export(df: DataFrame, path: str, fmt: str = "parquet", columns: Sequence[str] | None = None, **options: str) -> None:
    """The columns of a table to files."""
    (df.select(*columns) if columns else df).write.mode("overwrite").format(fmt).options(**options).save(path)


def export_bundle(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> list[str]:
    """A bundle of tables, a folder each."""
    for name, df in tables.items():
        export(df, f"{root}/{name}", fmt)
    return [f"{root}/{name}" for name in tables]


def export_predictions(df: DataFrame, root: str, key: str, labels: str, values: str, taxonomy: DataFrame, n: int, encoding: str = "UTF-8") -> dict[str, str]:
    """Three CSV folders, of the first category with its code (``first``), of n categories, and of n categories with weights; their paths."""
    from ..operators import decide

    tables = {"first": decide.first_code(df, key, labels, taxonomy), "categories": decide.spread(df, key, labels, n), "weights": decide.spread(df, key, labels, n, values=values)}
    for name, part in tables.items():
        export(part, f"{root}/{name}", "csv", header="true", encoding=encoding)
    return {name: f"{root}/{name}" for name in tables}


def label_lines(df: DataFrame, key: str, label: Column) -> DataFrame:
    """Lines ``wid;value``."""
    return df.select(F.concat_ws(";", F.col(key), label.cast("string")).alias("value"))


def history_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A line of sorted ``key;value;`` pairs per event; null values are left out."""
    cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c};"), F.col(c).cast("string"), F.lit(";"))) for c in sorted(columns)]
    return df.select(F.concat_ws("", *cells).alias("value"))


def by_marker(df: DataFrame, which: str) -> DataFrame:
    """Labels of all items, of those sampled at random (``rs``, marker 0) or actively (``al``, marker 1)."""
    return {"all": df, "rs": df.filter("marker = 0"), "al": df.filter("marker = 1")}[which]


def prediction_report(df: DataFrame, key: str, truth: str, preds: str, weights: str, width: int = 24) -> DataFrame:
    """Aligned lines of the true labels and the predicted ones with their normalised weight, cut to 5 characters."""
    cell = F.transform(F.arrays_zip(F.col(preds).alias("p"), F.col(weights).alias("w")), lambda x: F.concat(x["p"], F.lit(" ("), F.substring(x["w"].cast("string"), 1, 5), F.lit(")")))
    return df.select(key, F.concat(F.rpad(F.col(key).cast("string"), width, " "), F.rpad(F.array_join(truth, ", "), width, " "), F.array_join(cell, ", ")).alias("line"))


# DDL and metadata


def table_names(spark: SparkSession) -> list[str]:
    """R1."""
    return sorted(t.name for t in spark.catalog.listTables())


def column_names(spark: SparkSession, table: str) -> list[str]:
    """R2: none for a table that doesn't exist."""
    return spark.table(table).columns if spark.catalog.tableExists(table) else []


def table_info(df: DataFrame) -> tuple[list[str], int]:
    """R3."""
    return df.columns, df.count()


def create_table(spark: SparkSession, name: str, schema: str, path: str | None = None) -> None:
    """In the warehouse, or with its files under ``path``."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet" + (f" LOCATION '{path}'" if path else ""))


def reset_table(spark: SparkSession, name: str, schema: str, path: str | None = None) -> None:
    """Dropped and made anew."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    create_table(spark, name, schema, path)


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """A null column; one of that name stays as it is."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """R5."""
    return df.drop(name)


# DML


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows appended, columns by name; a column that one side lacks is null there."""
    return df.unionByName(rows, allowMissingColumns=True)


def set_field(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The columns of ``new`` overwrite those of rows with its key, by nulls, too; keys not in ``df`` do nothing.

    ``new`` has each key once; columns that ``df`` lacks are not added.
    """
    cols = [c for c in new.columns if c != key and c in df.columns]
    other = new.select(F.col(key).alias("_k"), F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in cols))
    joined = df.join(other, df[key] == F.col("_k"), "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(df[c]).alias(c) if c in cols else df[c] for c in df.columns))


def upsert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace the fields of rows with their key, the others are added; new columns widen the table.

    One full outer join; ``new`` has each key once. Doing it twice gives the same as once. Null keys match nothing.
    """
    both = list(dict.fromkeys([*df.columns, *new.columns]))
    old = df.select(*(F.col(c).alias(f"o_{c}") for c in df.columns), F.lit(True).alias("_o"))
    add = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns), F.lit(True).alias("_n"))
    joined = old.join(add, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(f"n_{c}", f"o_{c}")
        if c not in new.columns:
            return F.col(f"o_{c}")
        if c not in df.columns:
            return F.col(f"n_{c}")
        return F.when(F.col("_n"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))

    return joined.select(*(pick(c).alias(c) for c in both))


def catalog_view(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_columns, n_rows) of several tables, counted by one job."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(n).alias("table_name"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"), F.count("*").alias("n_rows")) for n, df in tables.items()))


def show(df: DataFrame, rows: int = 500) -> DataFrame:
    """R9."""
    return df.limit(rows)


def sample_row(df: DataFrame, key: str, seed: int = 0, order: Column | None = None) -> DataFrame:
    """A row drawn by a hash of its key and the seed, or by ``order``: the first of the hashes, found without a sort."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)) if order is None else order, key).limit(1)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
