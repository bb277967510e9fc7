"""Binary metadata blocks as maps: APEv2 tags, IPTC records and QuickTime user data."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

#: Names of the IPTC application records that are read (fixed values).
IPTC = {5: "title", 15: "category", 25: "keywords", 40: "instructions", 55: "date", 80: "byline", 90: "city", 101: "country", 105: "headline", 110: "credit", 115: "source", 116: "copyright", 120: "caption"}
#: Names of QuickTime user-data atoms (fixed values).
QUICKTIME = {"nam": "title", "ART": "artist", "alb": "album", "day": "date", "cmt": "comment", "gen": "genre", "cpy": "copyright", "des": "description", "too": "encoder"}


def ape(data: bytes) -> dict[str, str]:
    """Items of the last APEv2 tag of a file; binary items and a truncated tail are left out."""
    at = data.rfind(b"APETAGEX")
    if at < 0 or at + 32 > len(data):
        return {}
    _, size, count, flags = struct.unpack_from("<IIII", data, at + 8)
    header = bool(flags & 0x20000000)
    pos = at + 32 if header else max(0, at + 32 - size)
    out: dict[str, str] = {}
    for _ in range(min(count, 10_000)):
        if pos + 8 > len(data):
            break
        length, kind = struct.unpack_from("<II", data, pos)
        end = data.find(b"\0", pos + 8)
        if end < 0 or end + 1 + length > len(data):
            break
        if kind >> 1 & 3 != 1:
            out[data[pos + 8 : end].decode("ascii", "replace")] = data[end + 1 : end + 1 + length].decode("utf-8", "replace").replace("\0", "; ")
        pos = end + 1 + length
    return out


def iptc(data: bytes) -> dict[str, str]:
    """Application records of an IPTC block; repeated ones are joined."""
    out: dict[str, str] = {}
    pos = 0
    while pos + 5 <= len(data):
        if data[pos] != 0x1C:
            pos += 1
            continue
        record, number, length = data[pos + 1], data[pos + 2], struct.unpack_from(">H", data, pos + 3)[0]
        value = data[pos + 5 : pos + 5 + length]
        if record == 2 and number in IPTC and len(value) == length:
            name, text = IPTC[number], value.decode("utf-8", "replace")
            out[name] = f"{out[name]}; {text}" if name in out else text
        pos += 5 + length
    return out


def quicktime(data: bytes) -> dict[str, str]:
    """Text atoms of a QuickTime user-data block."""
    out: dict[str, str] = {}
    pos = 0
    while pos + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, pos)
        if size < 8 or pos + size > len(data):
            break
        if kind[:1] == b"\xa9" and size >= 12:
            name = kind[1:].decode("latin-1")
            length = struct.unpack_from(">H", data, pos + 8)[0]
            out[QUICKTIME.get(name, name)] = data[pos + 12 : pos + 12 + length].decode("utf-8", "replace")
        pos += size
    return out


PARSERS = {"ape": ape, "iptc": iptc, "quicktime": quicktime}


def read_tags(content: Column, kind: str) -> Column:
    """Tags of a binary column as a map; null stays null."""
    parse = PARSERS[kind]

    @F.pandas_udf(MapType(StringType(), StringType()))
    def tags(data: pd.Series) -> pd.Series:
        return data.map(lambda b: parse(bytes(b)), na_action="ignore")

    return tags(content)


def exploded(files: DataFrame, kind: str) -> DataFrame:
    """(path, key, value) of files(path, content)."""
    return files.select("path", F.explode(read_tags(F.col("content"), kind)).alias("key", "value"))
