"""Labels on a two-level, or deeper, category tree: closure, inference, transfer.

Labels are long: (key, cat, y) with y = 1 yes (or a rank from 1), -1 no, 0 unknown, -99 error. The tree (cat, parent)
is a small fixed table, as are the closures made of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import sent

YES, NO, UNKNOWN, ERROR = 1, -1, 0, -99


def is_tree(tree: DataFrame, most: int = 10_000) -> bool:
    """L1: false if parents lead round in a circle, or a category has two parents."""
    rows = tree.select("cat", "parent").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a category tree has few nodes")
    parent = {r["cat"]: r["parent"] for r in rows}
    if len(parent) != len(rows):
        return False
    for start in parent:
        seen, at = {start}, parent[start]
        while at is not None:
            if at in seen:
                return False
            seen.add(at)
            at = parent.get(at)
    return True


def closure(tree: DataFrame) -> DataFrame:
    """L1: (cat, anc, dist) of every ancestor. No line of parents is longer than the tree has nodes; beyond the engine's own limit of levels it raises."""
    depth = tree.count()
    return tree.sparkSession.sql(
        f"WITH RECURSIVE c(cat, anc, dist) AS (SELECT cat, parent, 1 FROM {{tree}} WHERE parent IS NOT NULL UNION ALL SELECT c.cat, t.parent, c.dist + 1 FROM c JOIN {{tree}} t ON c.anc = t.cat WHERE t.parent IS NOT NULL AND c.dist < {depth}) SELECT * FROM c", tree=tree
    )


def _grid(keys: DataFrame, tree: DataFrame) -> DataFrame:
    """Every key with every category: explode of a literal list as long as the tree."""
    cats = sorted(r["cat"] for r in tree.select("cat").collect())
    return keys.select("key", F.explode(F.array(*(F.lit(c) for c in cats))).alias("cat"))


def infer(labels: DataFrame, tree: DataFrame, single: bool = False) -> DataFrame:
    """L2: (key, cat, y) for all categories: yes goes up, no goes down, with ``single`` siblings of a yes are no.

    An error, a category both yes and no, or nothing but no, makes all of a key's labels unknown.
    """
    up = sent(closure(tree))
    yes, no = labels.filter("y > 0"), labels.filter(F.col("y") == NO)
    told = labels.filter("y != 0").unionByName(yes.join(up, "cat").select("key", F.col("anc").alias("cat"), F.lit(YES).alias("y"))).unionByName(no.join(up.select(F.col("cat").alias("sub"), F.col("anc").alias("cat")), "cat").select("key", F.col("sub").alias("cat"), F.lit(NO).alias("y")))
    if single:
        t = tree.select("cat", "parent")
        sib = t.alias("a").join(t.alias("b"), F.col("a.parent").eqNullSafe(F.col("b.parent")) & (F.col("a.cat") != F.col("b.cat"))).select(F.col("a.cat").alias("cat"), F.col("b.cat").alias("sib"))
        every = yes.unionByName(told.filter("y > 0")).select("key", "cat").distinct()
        told = told.unionByName(every.join(sent(sib), "cat").select("key", F.col("sib").alias("cat"), F.lit(NO).alias("y")))
    cell = told.groupBy("key", "cat").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    full = _grid(labels.select("key").distinct(), tree).join(cell, ["key", "cat"], "left")
    w = Window.partitionBy("key")
    bad = F.max(F.when(F.col("lo") == ERROR, 1).when((F.col("lo") < 0) & (F.col("hi") > 0), 1).otherwise(0)).over(w) == 1
    all_no = F.min(F.when(F.col("hi") < 0, 1).otherwise(0)).over(w) == 1
    return full.withColumn("_z", bad | all_no).select("key", "cat", F.when(F.col("_z") | F.col("hi").isNull(), UNKNOWN).otherwise(F.col("hi")).cast("int").alias("y"))


def update(old: DataFrame, new: DataFrame, tree: DataFrame, single: bool = False) -> DataFrame:
    """L3: new labels win unless they are unknown; then L2; keys of which nothing is left keep the new labels."""
    o, n = old.select("key", "cat", F.col("y").alias("o")), new.select("key", "cat", F.col("y").alias("n"))
    both = o.join(n, ["key", "cat"], "full_outer").select("key", "cat", F.coalesce(F.nullif("n", F.lit(UNKNOWN)), "o", F.lit(UNKNOWN)).alias("y"))
    got = infer(both, tree, single)
    empty = got.withColumn("_e", F.max(F.abs("y")).over(Window.partitionBy("key")) == 0)
    back = empty.join(n, ["key", "cat"], "left")
    return back.select("key", "cat", F.when(F.col("_e"), F.coalesce("n", F.lit(UNKNOWN))).otherwise(F.col("y")).cast("int").alias("y"))


def transfer_predictions(stored: DataFrame, new: DataFrame, key: str, mode: str = "expand") -> DataFrame:
    """L4: new predictions with the stored url where they have none; rows without a url go. ``contract`` keeps stored keys only, ``expand`` adds new ones, ``update`` does neither and keeps all stored rows; values that aren't null win."""
    from .relational import overwrite_known

    urls = stored.select(F.col(key).alias("_k"), F.col("url").alias("_u"))
    fresh = new.join(urls, F.col(key) == F.col("_k"), "left").withColumn("url", F.coalesce("url", "_u")).drop("_k", "_u").filter("url IS NOT NULL")
    base = stored.join(fresh.select(key), key, "left_semi") if mode == "contract" else stored
    out = overwrite_known(base, fresh, key)
    return out.unionByName(fresh.join(stored.select(key), key, "left_anti"), allowMissingColumns=True) if mode == "expand" else out


def transfer_labels(info: DataFrame, new_info: DataFrame, old: DataFrame, new: DataFrame, tree: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(info, labels): labels as L3, the info of a known key overwritten, that of a new one inserted."""
    from ..sources.store import upsert

    return upsert(info, new_info, key), update(old, new, tree)


def rank_labels(lists: DataFrame, tree: DataFrame) -> DataFrame:
    """(key, cat, y, labelstr) of ordered lists (key, labels): the listed categories' places, yes for ancestors, no for the rest; unknown names are left out."""
    known = lists.select("key", F.posexplode(F.array_distinct("labels")).alias("pos", "cat")).join(sent(tree.select("cat")), "cat")
    w = Window.partitionBy("key").orderBy("pos")
    placed = known.withColumn("r", F.row_number().over(w))
    up = placed.join(sent(closure(tree)), "cat").select("key", F.col("anc").alias("cat"), F.lit(YES).alias("r"))
    best = placed.select("key", "cat", "r", F.lit(0).alias("o")).unionByName(up.select("key", "cat", "r", F.lit(1).alias("o"))).groupBy("key", "cat").agg(F.min_by("r", "o").alias("r"))
    text = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "cat"))).alias("x")).select("key", F.array_join("x.cat", "++").alias("labelstr"))
    return _grid(lists.select("key").distinct(), tree).join(best, ["key", "cat"], "left").join(text, "key", "left").select("key", "cat", F.coalesce("r", F.lit(NO)).cast("int").alias("y"), F.coalesce("labelstr", F.lit("")).alias("labelstr"))


def transfer_weights(info: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Weights of known keys overwritten."""
    from .relational import overwrite_known

    return overwrite_known(info, weights.select(key, "weight"), key)


def append_history(history: DataFrame, events: DataFrame, at: str) -> DataFrame:
    """Events added, their time as the text key of the log."""
    return history.unionByName(events.withColumn("datestr", F.date_format(at, "yyyyMMddHHmmssSSSSSS")).drop(at), allowMissingColumns=True)


def dataset(preds: DataFrame, key: str, categories: Sequence[str], unknown: float = 0.0) -> DataFrame:
    """(key, cat, p) of a wide table; null predictions get the unknown one."""
    return preds.unpivot([key], list(categories), "cat", "p").select(key, "cat", F.coalesce("p", F.lit(unknown)).alias("p"))


def conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, cat, old_yes): new yes labels whose stored value is no, with the categories that were yes."""
    had = old.groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("y") > 0, F.col("cat")))).alias("old_yes"))
    hit = new.filter("y > 0").select("key", "cat").join(old.filter(F.col("y") == NO).select("key", "cat"), ["key", "cat"])
    return hit.join(had, "key")


def to_map(labels: DataFrame) -> DataFrame:
    """(key, label map)."""
    return labels.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cat", "y")))).alias("label"))


def from_map(df: DataFrame, column: Column | str = "label") -> DataFrame:
    """L10."""
    return df.select("key", F.explode(column).alias("cat", "y"))
