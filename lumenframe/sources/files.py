"""Files as tables: recursive scans, checksums, manifests, timecode lists, and text sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.text import magic_format
from lumenframe.functions.timecode import parse_smpte


def scan(spark: SparkSession, path: str, extensions: Sequence[str] = ()) -> DataFrame:
    """(path, bytes, modified, content) of the files under a path; the content is read only if it is used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if extensions:
        rows = rows.where(F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def checksums(files: DataFrame) -> DataFrame:
    """(path, bytes, md5, sha256, sha512, crc32, format) of scan()."""
    c = F.col("content")
    return files.select("path", "bytes", F.md5(c).alias("md5"), F.sha2(c, 256).alias("sha256"), F.sha2(c, 512).alias("sha512"), F.crc32(c).alias("crc32"), magic_format(c).alias("format"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(checksum, path) of the lines of a manifest, split at the first white space; blank and # lines go."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    parts = F.split(F.trim("value"), "\\s+", 2)
    return lines.select(parts[0].alias("checksum"), F.regexp_replace(parts[1], "^\\*", "").alias("path")).where("path is not null")


def verify(expected: DataFrame, actual: DataFrame, algorithm: str) -> DataFrame:
    """(path, status) of expected(checksum, path) against checksums(): missing, mismatch or match."""
    found = actual.select(F.col("path").alias("_p"), F.col(algorithm).alias("_c"))
    joined = expected.join(found, F.col("path") == F.col("_p"), "left")
    return joined.select("path", F.when(F.col("_p").isNull(), "missing").when(F.lower("checksum") == F.lower("_c"), "match").otherwise("mismatch").alias("status"))


def timecode_list(spark: SparkSession, path: str, fps: int) -> DataFrame:
    """(t_in, t_out) frames of the lines of a list; a tab separates if there is one, else a comma; malformed lines go."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    parts = F.when(F.col("value").contains("\t"), F.split("value", "\t", 2)).otherwise(F.split("value", ",", 2))
    cut = lines.select(F.trim(parts[0]).alias("a"), F.trim(F.get(parts, 1)).alias("b"))
    return cut.select(parse_smpte(F.col("a"), fps).alias("t_in"), parse_smpte(F.col("b"), fps).alias("t_out")).where("t_in is not null and t_out is not null")


def write(df: DataFrame, path: str, kind: str, row_tag: str = "row") -> None:
    """Write a table as csv, tsv, json (a line a row), xml or parquet."""
    out = df.write.mode("overwrite")
    if kind == "csv":
        out.option("header", True).csv(path)
    elif kind == "tsv":
        out.option("header", True).option("sep", "\t").csv(path)
    elif kind == "json":
        out.json(path)
    elif kind == "xml":
        out.format("xml").option("rowTag", row_tag).option("rootTag", f"{row_tag}s").save(path)
    elif kind == "parquet":
        out.parquet(path)
    else:
        raise ValueError(kind)


def playlist(entries: DataFrame, by: str, kind: str) -> DataFrame:
    """(by, content): entries(by, place, seconds, title, uri) of each list as m3u, pls or xspf."""
    rows = entries.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "seconds", "title", "uri"))).alias("e"))
    join = lambda f, sep="\n": F.array_join(F.transform("e", f), sep)
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    if kind == "m3u":
        text = F.concat(F.lit("#EXTM3U\n"), join(lambda x: F.concat(F.lit("#EXTINF:"), x["seconds"].cast("string"), F.lit(","), x["title"], F.lit("\n"), x["uri"])), F.lit("\n"))
    elif kind == "pls":
        one = lambda x, i: F.concat(*[y for name, c in (("File", x["uri"]), ("Title", x["title"]), ("Length", x["seconds"].cast("string"))) for y in (F.lit(name), (i + 1).cast("string"), F.lit("="), c, F.lit("\n"))])
        text = F.concat(F.lit("[playlist]\n"), join(one, ""), F.lit("NumberOfEntries="), F.size("e").cast("string"), F.lit("\nVersion=2\n"))
    elif kind == "xspf":
        track = lambda x: F.concat(F.lit("<track><location>"), safe(x["uri"]), F.lit("</location><title>"), safe(x["title"]), F.lit("</title><duration>"), (x["seconds"] * 1000).cast("string"), F.lit("</duration></track>"))
        text = F.concat(F.lit('<?xml version="1.0"?><playlist version="1" xmlns="http://xspf.org/ns/0/"><trackList>'), join(track, ""), F.lit("</trackList></playlist>"))
    else:
        raise ValueError(kind)
    return rows.select(by, text.alias("content"))


def exposition(metrics: DataFrame) -> DataFrame:
    """(value): metrics(name, help, kind, value) as lines of a metrics page, in order of the names."""
    name = F.col("name")
    text = F.concat(F.lit("# HELP "), name, F.lit(" "), F.col("help"), F.lit("\n# TYPE "), name, F.lit(" "), F.col("kind"), F.lit("\n"), name, F.lit(" "), F.col("value").cast("string"))
    return metrics.orderBy("name").select(text.alias("value"))


def interleave_packets(packets: DataFrame) -> DataFrame:
    """packets(file, stream, dts, pts) with place: decode order of each file, dts first, else pts, then stream."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy(F.coalesce("dts", "pts"), "stream")
    return packets.withColumn("place", F.row_number().over(order))


def as_json(df: DataFrame) -> Column:
    """A row as JSON text."""
    return F.to_json(F.struct(*df.columns))
