"""Relational operators with total orders and explicit null placement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def or_equi_join(left: DataFrame, right: DataFrame, first: Column, second: Column) -> DataFrame:
    """Inner join on ``first OR second``, both equi-conditions, as two disjoint hash joins."""
    by_first = left.join(right, first)
    by_second = left.join(right, second & ~F.coalesce(first, F.lit(False)))
    return by_first.unionAll(by_second)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group (DISTINCT ON, LATERAL ... LIMIT k)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def first_by(value: Column, *order: Column) -> Column:
    """Aggregate: the value of the first row in a total order of non-null keys."""
    return F.min_by(value, F.struct(*order))


def false_null_true(flag: Column) -> Column:
    """0, 1, 2 for false, true, null: an ascending boolean with nulls last as a struct key."""
    return F.coalesce(flag.cast("int"), F.lit(2))


def ordered_set(value: Column) -> Column:
    """Aggregate: the distinct non-null values, sorted."""
    return F.sort_array(F.collect_set(value))


def ordered_text(value: Column, separator: str) -> Column:
    """Aggregate: the distinct non-null values, sorted by bytes and joined; null if there are none."""
    values = ordered_set(value)
    return F.when(F.size(values) > 0, F.array_join(values, separator))


def ordered_objects(order: Column, **fields: Column) -> Column:
    """Aggregate: a JSON list of objects in the given order."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("__order"), F.struct(*[c.alias(k) for k, c in fields.items()]).alias("o"))))
    return F.to_json(F.transform(rows, lambda r: r["o"]))


def keyset_page(df: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """Rows after a key, ``limit`` + 1 of them, so that the last one tells whether more follow."""
    rows = df if after is None else df.filter(F.col(key) > after)
    return rows.orderBy(F.col(key).asc_nulls_last()).limit(limit + 1)


#: Ids of a list that are broadcast; longer lists are joined by a shuffle.
MOST_IDS = 500_000


def optional(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that agree with the given columns: a value, or one of a list; None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def by_list(df: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """Rows of the listed ids in list order; the first mention of an id counts."""
    spark = df.sparkSession
    places = spark.createDataFrame([(v, k) for k, v in enumerate(dict.fromkeys(ids))], f"{key} long, __place int")
    places = F.broadcast(places) if len(ids) <= MOST_IDS else places
    return df.join(places, key).orderBy("__place").drop("__place")


def pairs_within(df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, low, high) of distinct item pairs in each group; a self equi-join with an inequality."""
    a, b = df.select(key, F.col(item).alias("low")), df.select(key, F.col(item).alias("high"))
    return a.join(b, key).filter("low < high")


def shared_keys(df: DataFrame, owner: str, key: str, a: int, b: int) -> DataFrame:
    """Keys that two owners share (INTERSECT)."""
    return df.filter(F.col(owner) == a).select(key).intersect(df.filter(F.col(owner) == b).select(key))


#: Column policies of :func:`upsert`, given the old and the new value.
POLICIES = {
    "new": lambda old, new: new,
    "old": lambda old, new: old,
    "coalesce_new": lambda old, new: F.coalesce(new, old),
    "coalesce_old": lambda old, new: F.coalesce(old, new),
    "or": lambda old, new: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
    "greatest": lambda old, new: F.greatest(old, new),
    "least": lambda old, new: F.least(old, new),
    "incr": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
    "union": lambda old, new: F.array_sort(F.array_union(F.coalesce(old, F.array()), F.coalesce(new, F.array()))),
}


def upsert(target: DataFrame, delta: DataFrame, keys: list[str], policy: dict[str, str], update: bool = True) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO UPDATE by column policy, or DO NOTHING: a full outer join on null-safe keys.

    ``delta`` has one row for each key. Columns without a policy take ``coalesce_new``.
    """
    old, new = target.alias("old"), delta.alias("new")
    condition = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
    old, new = old.withColumn("__in_old", F.lit(True)).alias("old"), new.withColumn("__in_new", F.lit(True)).alias("new")
    both = old.join(new, condition, "full_outer")
    in_old, in_new = F.col("old.__in_old").isNotNull(), F.col("new.__in_new").isNotNull()
    out = []
    for c in target.columns:
        a, b = F.col(f"old.{c}"), F.col(f"new.{c}") if c in delta.columns else F.lit(None).cast(target.schema[c].dataType)
        value = F.coalesce(a, b) if c in keys else F.when(in_old & in_new, POLICIES[policy.get(c, "coalesce_new")](a, b) if update else a).when(in_old, a).otherwise(b)
        out.append(value.alias(c))
    return both.select(*out)


def changed(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row: for each column, the number of keys whose value differs (IS DISTINCT FROM)."""
    both = old.alias("o").join(new.alias("n"), keys)
    return both.agg(*[F.count_if(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).alias(c) for c in columns])
