"""Codecs and the containers that hold them, as a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Containers that a codec is usually put in (fixed values).
CONTAINERS = {
    "vp8": "webm mkv", "vp9": "webm mkv", "av1": "webm mkv mp4", "theora": "ogg ogv mkv", "h263": "3gp mkv", "ffv1": "mkv nut", "rawvideo": "y4m mkv", "mjpeg": "mov mkv avi mp4", "apv": "mp4 isobmff mkv",
    "opus": "webm mkv ogg opus", "vorbis": "webm mkv ogg", "flac": "flac mkv ogg", "mp3": "mp3 mkv", "pcm": "wav mkv aiff", "webvtt": "webm mkv", "ass": "mkv mp4", "ssa": "mkv mp4", "srt": "mkv mp4",
}
#: Further pairs that work (fixed values).
ALSO = {
    "av1": "isobmff", "rawvideo": "avi", "flac": "mp4 isobmff", "mp3": "mp4", "jpegxl": "mkv", "dng": "mkv", "webp": "mkv", "gif": "mkv", "png": "mkv", "tiff": "mkv", "openexr": "mkv",
}


def codec_table(spark: SparkSession) -> DataFrame:
    """(codec, container, usual): every pair that works."""
    rows = [(c, x, True) for c, names in CONTAINERS.items() for x in names.split()] + [(c, x, False) for c, names in ALSO.items() for x in names.split()]
    return spark.createDataFrame(rows, "codec string, container string, usual boolean")


def with_containers(df: DataFrame, codec: str) -> DataFrame:
    """df with containers, the usual ones of its codec; none for unknown codecs."""
    usual = codec_table(df.sparkSession).where("usual").groupBy(F.col("codec").alias("_c")).agg(F.sort_array(F.collect_list("container")).alias("containers"))
    joined = df.join(F.broadcast(usual), F.lower(F.col(codec)) == F.col("_c"), "left").drop("_c")
    return joined.withColumn("containers", F.coalesce("containers", F.array().cast("array<string>")))


def compatible(codec: Column, container: Column) -> Column:
    """Whether a container holds a codec; case does not matter."""
    pairs = sorted({f"{c}/{x}" for table in (CONTAINERS, ALSO) for c, names in table.items() for x in names.split()})
    return F.concat_ws("/", F.lower(codec), F.lower(container)).isin(pairs)
