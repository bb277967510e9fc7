"""Comparisons of two versions of a table, and merges of maps and fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Most columns of a pivoted table.
MOST_KEYS = 10_000


def changes(old: DataFrame, new: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key..., change): added, removed or modified rows; equal rows are left out, and nulls equal nulls."""
    key = list(key)
    a = old.select(*key, F.struct(*fields).alias("_o"))
    b = new.select(*key, F.struct(*fields).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "modified")
    return a.join(b, key, "full_outer").select(*key, kind.alias("change")).where("change is not null")


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, before, after): the fields that differ of rows in both tables."""
    def long(df: DataFrame, name: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
        return df.select(key, F.explode(each).alias("x")).select(key, "x.*")

    both = long(old, "before").join(long(new, "after"), [key, "field"])
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def attribute_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(item, key) pairs of (item, key, value) whose value differs or that stand on one side only."""
    met = a.select("item", "key", F.col("value").alias("va"), F.lit(1).alias("ia")).join(b.select("item", "key", F.col("value").alias("vb"), F.lit(1).alias("ib")), ["item", "key"], "full_outer")
    return met.where(F.col("ia").isNull() | F.col("ib").isNull() | ~F.col("va").eqNullSafe(F.col("vb"))).select("item", "key")


def inherit(parent: Column, child: Column) -> Column:
    """Map of both; the child's values win."""
    return F.map_zip_with(F.coalesce(parent, F.create_map().cast("map<string,string>")), F.coalesce(child, F.create_map().cast("map<string,string>")), lambda k, p, c: F.coalesce(c, p))


def crosswalk(rows: DataFrame, mapping: Mapping[str, str], fields: str) -> DataFrame:
    """rows with the keys of a map column renamed by a table; other keys stay."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return rows.withColumn(fields, F.transform_keys(fields, lambda k, v: F.coalesce(F.try_element_at(table, k), k)))


def pivot_attributes(attributes: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """(item, key, value) as one row an item; the columns are the sorted union of the keys, missing ones null.

    The keys form a header: more than MOST_KEYS raise a ValueError. Give them to save a pass.
    """
    if keys is None:
        found = attributes.select("key").distinct().limit(MOST_KEYS + 1).collect()
        if len(found) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} keys")
        keys = sorted(r["key"] for r in found)
    return attributes.groupBy("item").pivot("key", list(keys)).agg(F.first("value"))
