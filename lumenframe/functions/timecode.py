"""Column expressions on timecodes, frame rates and time ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smpte(frames: Column, fps: int, drop: bool = False) -> Column:
    """HH:MM:SS:FF of a frame number; drop only changes the last separator."""
    s = F.floor(frames / fps)
    mark = ";" if drop else ":"
    return F.format_string(f"%02d:%02d:%02d{mark}%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)), F.pmod(frames, F.lit(fps)))


def feet_frames(frames: Column) -> Column:
    """Feet and frames of film, 16 frames a foot."""
    return F.format_string("%d+%02d", F.floor(frames / 16), F.pmod(frames, F.lit(16)))


def parse_smpte(text: Column, fps: int) -> Column:
    """Frame number of HH:MM:SS:FF or HH:MM:SS;FF; null if malformed."""
    pattern = "^(\\d+):(\\d+):(\\d+)[:;](\\d+)$"
    h, m, s, f = (F.regexp_extract(text, pattern, i) for i in range(1, 5))
    part = lambda x: F.when(x == "", None).otherwise(x).cast("long")
    return ((part(h) * 60 + part(m)) * 60 + part(s)) * fps + part(f)


def frame_parts(frames: Column, fps: int) -> Column:
    """struct(h, m, s, f); hours wrap at 24."""
    s = F.floor(frames / fps)
    return F.struct(
        F.pmod(F.floor(s / 3600), F.lit(24)).alias("h"), F.pmod(F.floor(s / 60), F.lit(60)).alias("m"), F.pmod(s, F.lit(60)).alias("s"), F.pmod(frames, F.lit(fps)).alias("f")
    )


def drop_frame_ms(h: Column, m: Column, s: Column, f: Column) -> Column:
    """Milliseconds of a 29.97 drop-frame timecode: two numbers are left out each minute but every tenth."""
    minutes = h * 60 + m
    frames = (minutes * 60 + s) * 30 + f - 2 * (minutes - F.floor(minutes / 10))
    return F.floor(frames * 1001000 / 30000)


def ms_drop_frame(ms: Column) -> Column:
    """29.97 drop-frame timecode of milliseconds."""
    frames = F.floor(ms * 30000 / 1001000)
    tens, rest = F.floor(frames / 17982), F.pmod(frames, F.lit(17982))
    number = frames + 18 * tens + F.when(rest >= 2, 2 * F.floor((rest - 2) / 1798)).otherwise(0)
    return smpte(number, 30, drop=True)


def retime(ms: Column, source: float, target: float) -> Column:
    """Milliseconds re-timed from one frame rate to another, rounded."""
    return F.round(ms * source / target).cast("long")


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """struct(s, e) of two half-open ranges; null where they do not meet."""
    s, e = F.greatest(s1, s2), F.least(e1, e2)
    return F.when(s < e, F.struct(s.alias("s"), e.alias("e")))


def distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Frames between two ranges; 0 where they meet."""
    return F.greatest(s2 - e1, s1 - e2, F.lit(0))


def stretch(at: Column, anchor: int, factor: float) -> Column:
    """anchor + (at - anchor) * factor, rounded; an error if that is negative."""
    out = F.round(anchor + (at - anchor) * factor).cast("long")
    return F.when(out < 0, F.raise_error(F.lit("a stretched frame is negative")).cast("long")).otherwise(out)
