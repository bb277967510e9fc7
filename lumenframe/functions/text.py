"""Column expressions on text: cleaning, captions, converters and validators."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Endings that the stemmer takes off, one after the other (fixed values).
SUFFIXES = ("ing", "ed", "ly", "s", "es", "ies")
#: Signs of text decoded with the wrong charset (fixed values).
MOJIBAKE = ("\ufffd", "Ã©", "Ã¨", "Ã¼", "Ã¶", "Ã¤", "Â")
#: Frame rates that clips are rounded to (fixed values).
STANDARD_RATES = (23.976, 24.0, 25.0, 29.97, 30.0, 50.0, 59.94, 60.0)


def stem(word: Column) -> Column:
    """The lower-cased word without each of the suffixes that it ends with in turn; three bytes of UTF-8 at least stay."""
    # Three code points, or fewer that take three bytes.
    least = "(?:.{3,}|.*[\\x{800}-\\x{10FFFF}].*|.*[\\x{80}-\\x{7FF}].+|.+[\\x{80}-\\x{7FF}].*)"
    word = F.lower(word)
    for s in SUFFIXES:
        word = F.regexp_replace(word, f"(?s)^({least}){s}$(?!\\n)", "$1")
    return word


def strip_tags(text: Column) -> Column:
    """Text without <...>; an unclosed < takes the rest."""
    return F.regexp_replace(text, "<[^>]*(>|$)", "")


def strip_overrides(text: Column) -> Column:
    """Text without subtitle override blocks {\\...}."""
    return F.regexp_replace(text, "\\{\\\\[^}]*(\\}|$)", "")


def normalize_blanks(text: Column) -> Column:
    """Runs of blanks and tabs as one blank; line ends and outer blanks stay."""
    return F.regexp_replace(text, "[ \\t]+", " ")


def has_mojibake(text: Column) -> Column:
    """Whether a text shows signs of a wrong charset."""
    return text.rlike("|".join(re.escape(x) for x in MOJIBAKE))


def decode_entities(text: Column) -> Column:
    """lt, gt, amp, quot, apos, nbsp in this order, one after the other (so &amp;quot; becomes a quote)."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("amp", "&"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return text


def mask_words(text: Column, words: Sequence[str]) -> Column:
    """Words, whatever their case, as stars of equal length."""
    for w in words:
        text = F.regexp_replace(text, f"(?i)\\b{re.escape(w)}\\b", "*" * len(w))
    return text


def has_word(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words stands in the text, whatever its case; false without words."""
    if not words:
        return F.when(text.isNotNull(), F.lit(False))
    return text.rlike("(?i)\\b(" + "|".join(re.escape(w) for w in words) + ")\\b")


def word_count(text: Column) -> Column:
    """Words between white space."""
    trimmed = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def words_per_second(text: Column, ms: Column) -> Column:
    """Reading speed; null for an empty text or no duration."""
    n = word_count(text)
    return F.when((n > 0) & (ms > 0), n / (ms / 1000.0))


def chars_per_second(text: Column, ms: Column) -> Column:
    """Characters by seconds; 0 without duration."""
    return F.when(ms > 0, F.char_length(text) / (ms / 1000.0)).otherwise(0.0)


def parse_bitrate(text: Column) -> Column:
    """5M, 128k or 900 in bits a second; null if malformed."""
    number = F.regexp_extract(text, "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([kKmMgG]?)\\s*$", 1)
    unit = F.lower(F.regexp_extract(text, "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([kKmMgG]?)\\s*$", 2))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.when(number != "", (number.cast("double") * scale).cast("long"))


def parse_resolution(text: Column) -> Column:
    """1920x1080 as struct(width, height); null if malformed."""
    w, h = (F.regexp_extract(text, "^\\s*([0-9]+)\\s*[xX]\\s*([0-9]+)\\s*$", i) for i in (1, 2))
    return F.when(w != "", F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))


def valid_email(text: Column) -> Column:
    """Exactly one @ with something on either side."""
    return text.rlike("^[^@]+@[^@]+$")


def valid_url(text: Column) -> Column:
    """http, https or ftp with a host."""
    return text.rlike("^(?:https?|ftp)://[^\\s/]+(?:/\\S*)?$")


def standard_rate(fps: Column) -> Column:
    """The nearest standard frame rate, or the rate itself if it is off by more than a half."""
    best = F.array_min(F.array(*[F.struct(F.abs(fps - r).alias("d"), F.lit(r).alias("r")) for r in STANDARD_RATES]))
    return F.when(best["d"] > 0.5, fps).otherwise(best["r"])


def file_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB by 1024, with two digits."""
    out = None
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        text = F.format_string(f"%.2f {unit}", F.round(n / float(1024**power), 2))
        out = F.when(n >= 1024**power, text) if out is None else out.when(n >= 1024**power, text)
    return out.otherwise(F.format_string("%d B", n))


def cache_key(url: Column) -> Column:
    """Canonical URL: no fragment, lower case, no slash at the end of the path (but for the root), query parameters sorted."""
    plain = F.lower(F.substring_index(url, "#", 1))
    path, query = F.substring_index(plain, "?", 1), F.regexp_extract(plain, "\\?(.*)$", 1)
    root = path.rlike("^[a-z]+://[^/]+/$") | (path == "/")
    short = F.when(root, path).otherwise(F.regexp_replace(path, "/$", ""))
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.when(params == "", short).otherwise(F.concat(short, F.lit("?"), params))


def route_params(pattern: str, path: Column) -> Column:
    """The named parts of a path that fits a pattern like /media/{id}/tags/{tag}, as a map; null if it does not fit."""
    names = re.findall(r"\{(\w+)\}", pattern)
    regex = "^" + re.sub(r"\\\{\w+\\\}", "([^/]+)", re.escape(pattern)) + "$"
    pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(path, regex, i + 1))]
    return F.when(path.rlike(regex), F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))


def magic_format(content: Column) -> Column:
    """Container of a file by its first bytes."""
    hexed = F.hex(F.substring(content, 1, 12))
    at = lambda p: hexed.startswith(p)
    return (
        F.when(at("1A45DFA3"), "matroska").when(at("4F676753"), "ogg").when(at("664C6143"), "flac").when(at("52494646") & (F.substring(hexed, 17, 8) == "57415645"), "wav")
        .when(F.substring(hexed, 9, 8) == "66747970", "mp4").when(at("494433"), "mp3").when(at("FFD8FF"), "jpeg").when(at("89504E47"), "png").when(at("47"), "mpegts").otherwise("unknown")
    )


@F.pandas_udf(StringType())
def remove_descriptions(text: pd.Series) -> pd.Series:
    """Text without [...] and (...), nested ones too; a bracket that is not closed takes the rest."""

    def cut(s: str | None) -> str | None:
        if s is None:
            return None
        depth, out = 0, []
        for ch in s:
            if ch in "[(":
                depth += 1
            elif ch in "])":
                depth = max(0, depth - 1)
            elif not depth:
                out.append(ch)
        return "".join(out)

    return text.map(cut, na_action=None)


def wrap(width: int, hyphenate: bool = True):
    """A pandas UDF: greedy word wrap at width characters; longer words are cut with a hyphen, or stand alone."""

    @F.pandas_udf("array<string>")
    def wrapped(text: pd.Series) -> pd.Series:
        def lines(s: str | None) -> list[str]:
            out, line = [], ""
            for word in (s or "").split():
                while hyphenate and len(word) > width:
                    if line:
                        out.append(line)
                        line = ""
                    out.append(word[: width - 1] + "-")
                    word = word[width - 1 :]
                if line and len(line) + 1 + len(word) > width:
                    out.append(line)
                    line = word
                else:
                    line = f"{line} {word}" if line else word
            return out + [line] if line else out

        return text.map(lines, na_action=None)

    return wrapped


@F.pandas_udf(StringType())
def punctuate(text: pd.Series) -> pd.Series:
    """Text with sentence case after . ! ? and a final full stop."""

    def fix(s: str | None) -> str | None:
        if not s or not s.strip():
            return s
        s = re.sub(r"(^\s*|[.!?]\s+)([^\W\d_])", lambda m: m[1] + m[2].upper(), s)
        return s if s.rstrip()[-1] in ".!?" else s.rstrip() + "."

    return text.map(fix, na_action=None)


@F.pandas_udf(StringType())
def run_lengths(text: pd.Series) -> pd.Series:
    """Run-length form: each sign with the number of its repeats."""
    return text.map(lambda s: None if s is None else "".join(f"{len(m[0])}{m[1]}" for m in re.finditer(r"(.)\1*", s, re.S)), na_action=None)


#: The 64-bit FNV-1a prime and start (fixed values); a content id starts its second lane elsewhere.
FNV_PRIME, FNV_START, FNV_ODD = 0x100000001B3, 0xCBF29CE484222325, 0xAF63DC4C8601EC8C
#: Texts that are still going at a byte, from which on numpy beats a plain loop.
FEW = 12


def _fnv(parts: list[bytes], start: int) -> np.ndarray:
    """64-bit FNV-1a of each part: all parts step byte by byte together, the few longest go on alone."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    size, data = size[order], np.frombuffer(b"".join(parts[i] for i in order), dtype=np.uint8)
    at, h, i = np.cumsum(size) - size, np.full(len(parts), start, dtype=np.uint64), 0
    while (live := int(np.searchsorted(-size, -i))) >= FEW:
        h[:live] = (h[:live] ^ data[at[:live] + i]) * np.uint64(FNV_PRIME)
        i += 1
    for j in range(live):
        one = int(h[j])
        for b in parts[order[j]][i:]:
            one = ((one ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
        h[j] = one
    out = np.empty_like(h)
    out[order] = h
    return out


@F.pandas_udf(StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes, as 16 hex digits; null for null."""
    h = _fnv([(s or "").encode() for s in text], FNV_START)
    return pd.Series([None if s is None else f"{x:016x}" for s, x in zip(text, h.tolist(), strict=True)], dtype=object)


@F.pandas_udf(StringType())
def content_id(data: pd.Series) -> pd.Series:
    """128-bit content id of binary data as 32 hex digits: FNV-1a of the bytes at even and at odd places, low byte first; null for null."""
    even, odd = (_fnv([bytes(b or b"")[lane::2] for b in data], start).astype("<u8") for lane, start in enumerate((FNV_START, FNV_ODD)))
    return pd.Series([None if b is None else (x.tobytes() + y.tobytes()).hex() for b, x, y in zip(data, even, odd, strict=True)], dtype=object)
