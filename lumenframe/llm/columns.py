"""Columns of callers: carried through an operator in one struct, so that no name of theirs can clash with one of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "rest"


def packed(rows: DataFrame, *used: str, but: tuple[str, ...] = ()) -> DataFrame:
    """The used columns of rows and rest, a struct of all of its columns but those named."""
    every = [F.col(f"`{c}`").alias(c) for c in rows.columns if c not in but] or [F.lit(None).alias("none")]
    return rows.select(*[F.col(f"`{c}`").alias(c) for c in used], F.struct(*every).alias(REST))


def unpacked(rows: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The caller's columns names again, those called like a new one replaced by it, then the other new ones."""
    back = [(new.get(c, F.col(REST).getField(c))).alias(c) for c in names]
    return rows.select(*back, *[v.alias(k) for k, v in new.items() if k not in names])
