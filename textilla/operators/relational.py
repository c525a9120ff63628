"""Joins, set operations and aggregates over records and label lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def language_filter(df: DataFrame, column: str, lang: str = "es") -> DataFrame:
    """Rows of a language; a null is none."""
    return df.filter(F.col(column) == lang)


def null_or_nan(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value, or with the text nan."""
    return df.filter(F.col(column).isNull() | (F.col(column) == "nan"))


def with_labels(df: DataFrame, column: str) -> DataFrame:
    """J3."""
    return df.filter(F.col(column).isNotNull())


def labelled_records(labels: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Labels left join records; those without a record keep nulls."""
    return labels.join(records, key, "left")


def restrict(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """J5."""
    return df.join(keys.select(key), key, "left_semi")


def append_new(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not there, appended."""
    return df.unionByName(new.join(df.select(key), key, "left_anti"))


def overwrite_known(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Values of ``new`` that aren't null win, on keys of ``df``; ``new`` has each key once."""
    cols = [c for c in df.columns if c != key and c in new.columns]
    other = new.select(key, *(F.col(c).alias(f"_{c}") for c in cols))
    return df.join(other, key, "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in cols else c for c in df.columns))


def lookup(df: DataFrame, key: str, codes: str, mapping: DataFrame, source: str, target: str, sep: str = ",") -> DataFrame:
    """(key, names): each item of a list replaced through a map, order kept, unknown items left out."""
    items = df.select(key, F.posexplode(F.split(codes, sep)).alias("pos", "item"))
    found = items.join(mapping.select(F.col(source).cast("string").alias("item"), F.col(target).alias("name")), "item")
    return found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("x")).select(key, F.array_join("x.name", sep).alias("names"))


def set_operation(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Union, intersect or except of distinct rows."""
    return {"union": lambda: a.union(b).distinct(), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[how]()


def without_level_1(df: DataFrame, *lists: str) -> DataFrame:
    """Rows none of whose lists has an item of level 1."""
    for c in lists:
        df = df.filter(F.forall(c, lambda x: ~F.endswith(x, F.lit("_"))))
    return df


def single_label(df: DataFrame, column: str) -> DataFrame:
    """J12."""
    return df.filter(F.size(column) == 1)


def label_pairs(labels: DataFrame, records: DataFrame, key: str, left: str, right: str, single: bool = False) -> DataFrame:
    """(key, left list, right list) of labelled records with both lists, by ``single`` only of one item each."""
    joined = labels.filter(F.col(left).isNotNull()).join(records.filter(F.col(right).isNotNull()), key).select(key, left, right)
    return single_label(single_label(joined, left), right) if single else joined


def merge_groups(df: DataFrame, key: str, first: Sequence[str], many: str, order: str, sep: str = ",") -> DataFrame:
    """A1: one row per key: the first value of each column and all of ``many`` joined, in the order of ``order``.

    Rows of one place are ordered by their values. Repeated values are kept, nulls are left out.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, many))), lambda x: x[many].cast("string")), sep)
    return df.groupBy(key).agg(*(F.min_by(c, F.struct(order, many, c)).alias(c) for c in first), joined.alias(many))


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """A2."""
    return df.select(*columns).distinct()


def label_distribution(df: DataFrame, labels: str, categories: DataFrame, first: bool = False, category: str = "reference") -> DataFrame:
    """A3: (category, n) of every category that isn't of level 1, those without a label included; of the first label only, or of all."""
    items = df.select(F.get(labels, F.lit(0)).alias("c")) if first else df.select(F.explode(labels).alias("c"))
    n = items.groupBy("c").agg(F.count("*").alias("n"))
    cats = categories.filter(~F.endswith(category, F.lit("_"))).select(F.col(category).alias("c"))
    return cats.join(n, "c", "left").select(F.col("c").alias("category"), F.coalesce("n", F.lit(0)).alias("n"))


def labels_per_item(df: DataFrame, labels: str) -> DataFrame:
    """A4: (size, n, mean_size, max_size): the histogram, and mean and maximum beside it."""
    sizes = df.select(F.size(labels).alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    return sizes.select("size", "n", (F.sum(F.col("size") * F.col("n")).over(w) / F.sum("n").over(w)).alias("mean_size"), F.max("size").over(w).alias("max_size"))


def labels_per_group(df: DataFrame, group: str, labels: str) -> DataFrame:
    """A5: (group, n, n_single)."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.size(labels) == 1).alias("n_single"))


def sampling_origin(df: DataFrame) -> DataFrame:
    """Counts by origin: new or recycled (relabel), at random or active (marker), and old labels without a marker."""
    c = lambda cond: F.count_if(cond)
    m, r = F.col("marker"), F.coalesce("relabel", F.lit(0))
    return df.agg(c((m == 0) & (r == 0)).alias("new_rs"), c((m == 1) & (r == 0)).alias("new_al"), c((m == 0) & (r > 0)).alias("recycled_rs"), c((m == 1) & (r > 0)).alias("recycled_al"), c(m.isNull()).alias("old"))


def top_k(df: DataFrame, group: str, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k rows of a group per task before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(rank) <= k)


def distinct_lists(df: DataFrame, column: str) -> DataFrame:
    """Sorted lists, each once."""
    return df.select(F.array_sort(column).alias(column)).distinct()


def latest(df: DataFrame, key: str, at: str, tie: Sequence[str] = ()) -> DataFrame:
    """The latest event of each key, found map-side by a maximum; ties by the other columns given."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *tie)).alias("x")).select(key, "x.*")
