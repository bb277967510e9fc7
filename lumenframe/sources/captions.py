"""Subtitle and caption files as cue rows, and cue rows as files."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUE = "n int, start_ms long, end_ms long, text string"
_STAMP = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})")


def dialect(content: Column) -> Column:
    """webvtt, ass, ttml, srt, sbv, scc or unknown, by the look of a file."""
    head = F.substring(content, 1, 4096)
    return (
        F.when(head.rlike("^\\ufeff?WEBVTT"), "webvtt").when(head.rlike("(?m)^\\[Script Info\\]"), "ass").when(head.rlike("<tt[\\s>]"), "ttml").when(head.rlike("^Scenarist_SCC"), "scc")
        .when(head.rlike("(?m)^\\d+\\s*$\\s*^\\d+:\\d+:\\d+,\\d+\\s*-->"), "srt").when(head.rlike("(?m)^\\d+:\\d+:\\d+\\.\\d+,\\d+:\\d+:\\d+\\.\\d+"), "sbv").otherwise("unknown")
    )


def _ms(stamp: str) -> int | None:
    m = _STAMP.fullmatch(stamp.strip())
    if not m:
        return None
    h, mi, s, f = m.groups()
    return ((int(h or 0) * 60 + int(mi)) * 60 + int(s)) * 1000 + int(f.ljust(3, "0"))


def parse(content: str | None) -> list[tuple[int, int, int, str]]:
    """(n, start, end, text) of the cues of an srt, vtt, sbv, ass or ttml file; what fits no cue is left out."""
    out: list[tuple[int, int, int, str]] = []
    content = (content or "").lstrip("\ufeff").replace("\r\n", "\n")
    if "[Script Info]" in content:
        for line in content.split("\n"):
            if line.startswith("Dialogue:"):
                parts = line[9:].split(",", 9)
                if len(parts) == 10 and (a := _ms(parts[1])) is not None and (b := _ms(parts[2])) is not None:
                    out.append((len(out) + 1, a, b, re.sub(r"\{[^}]*\}", "", parts[9]).replace("\\N", "\n")))
        return out
    if re.search(r"<tt[\s>]", content):
        for attrs, body in re.findall(r"<p\b([^>]*)>(.*?)</p>", content, re.S):
            ends = [_ms(m[1] if "." in m[1] or "," in m[1] else f"{m[1]}.000") for m in (re.search(rf'\b{name}="([^"]*)"', attrs) for name in ("begin", "end")) if m]
            if len(ends) == 2 and None not in ends:
                text = re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", "\n", body))
                out.append((len(out) + 1, ends[0], ends[1], html.unescape(text).strip()))
        return out
    for block in re.split(r"\n\s*\n", content):
        lines = block.strip("\n").split("\n")
        for i, line in enumerate(lines):
            ends = re.split(r"\s*-->\s*", line) if "-->" in line else line.split(",") if re.fullmatch(r"[\d:.]+,[\d:.]+", line.strip()) else []
            if len(ends) == 2 and (a := _ms(ends[0])) is not None and (b := _ms(ends[1].split(" ")[0])) is not None:
                out.append((len(out) + 1, a, b, "\n".join(lines[i + 1 :])))
                break
    return out


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, start_ms, end_ms, text) of all caption files under a path; one file is one row until it is parsed."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), "value")
    return explode_cues(files, "value")


def explode_cues(files: DataFrame, content: str) -> DataFrame:
    """Rows of files with their cues, one a row."""

    @F.pandas_udf(f"array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in CUE.split(', ')))}>>")
    def cues(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield series.map(lambda t: [dict(zip(("n", "start_ms", "end_ms", "text"), c, strict=True)) for c in parse(t)], na_action=None)

    kept = [c for c in files.columns if c != content]
    return files.select(*kept, F.explode(cues(content)).alias("c")).select(*kept, "c.*")


def _stamp(ms: Column, mark: str) -> Column:
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.pmod(F.floor(ms / 60000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def render(cues: DataFrame, by: str, kind: str) -> DataFrame:
    """(by, content): the cues(by, start_ms, end_ms, text) of each track as an srt or webvtt file."""
    mark = "," if kind == "srt" else "."
    rows = cues.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("c"))

    def line(c: Column, i: Column) -> Column:
        times = F.concat(_stamp(c["start_ms"], mark), F.lit(" --> "), _stamp(c["end_ms"], mark), F.lit("\n"), c["text"], F.lit("\n"))
        return F.concat((i + 1).cast("string"), F.lit("\n"), times) if kind == "srt" else times

    body = F.array_join(F.transform("c", line), "\n")
    return rows.select(by, F.concat(F.lit("" if kind == "srt" else "WEBVTT\n\n"), body).alias("content"))
