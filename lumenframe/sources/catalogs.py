"""Schemas of the tables that media systems keep, as Spark types, and empty views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Table to columns. Times are timestamps, flags booleans, JSON stays text.
SCHEMAS = {
    "users": "id string, username string, email string, role string, created_at timestamp, updated_at timestamp",
    "api_keys": "id string, user_id string, key_hash string, name string, created_at timestamp, expires_at timestamp",
    "media": "id string, user_id string, filename string, original_filename string, mime_type string, file_size long, duration double, width int, height int, status string, created_at timestamp",
    "media_metadata": "media_id string, key string, value string",
    "transcode_jobs": "id string, media_id string, user_id string, status string, progress double, created_at timestamp, completed_at timestamp",
    "collections": "id string, user_id string, name string, description string, created_at timestamp",
    "collection_items": "collection_id string, media_id string, position int",
    "clips": "id string, name string, description string, path string, rating int, favourite boolean, rejected boolean, keywords array<string>, rate struct<num:int,den:int>, duration long, created_at timestamp",
    "bins": "id string, name string, parent_id string",
    "clip_bins": "clip_id string, bin_id string",
    "grants": "id string, asset_id string, owner_id string, usages array<string>, territories array<string>, starts timestamp, ends timestamp, active boolean",
    "agreements": "id string, asset_id string, status string, signed_at timestamp",
    "usage_logs": "id string, asset_id string, usage string, territory string, platform string, plays long, revenue long, at timestamp",
    "royalty_payments": "id string, owner_id string, kind string, gross_cents long, basis_points long, paid_at timestamp",
    "jobs": "id string, name string, state string, priority int, inputs string, outputs string, dependencies array<string>, created_at timestamp",
    "job_logs": "job_id string, at timestamp, level string, message string",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalogue without rows."""
    return spark.createDataFrame([], SCHEMAS[name])


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Temporary views of the tables given, cast to the catalogue, and empty ones of the rest."""
    for name, schema in SCHEMAS.items():
        frame = tables.get(name)
        if frame is not None:
            fields = spark.createDataFrame([], schema).schema
            frame = frame.select(*[frame[f.name].cast(f.dataType).alias(f.name) for f in fields])
        (frame if frame is not None else empty(spark, name)).createOrReplaceTempView(name)
