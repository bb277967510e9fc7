"""Column expressions that score items: decay, freshness, exploration, health and caption quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ratings that implicit signals stand for (fixed values).
SIGNALS = {"view": 2.0, "completion": 4.0, "repeat_view": 4.5, "skip": 1.0, "fast_forward": 1.5, "rewind": 3.0, "pause": 2.5, "share": 5.0, "bookmark": 4.5}


def half_life_weight(age: Column, half_life: float) -> Column:
    """0.5 ** (age / half_life); 1 without a half-life."""
    return F.pow(F.lit(0.5), age / half_life) if half_life > 0 else F.lit(1.0)


def log_rate_decay(age: Column, half_life: float) -> Column:
    """exp(-ln(h) / h * age), the rate that hourly trends use."""
    return F.exp(-F.log(F.lit(half_life)) / half_life * age)


def linear_decay(age: Column, most: float) -> Column:
    """1 - age / most, 0 at least."""
    return F.greatest(1 - age / most, F.lit(0.0))


def step_decay(age: Column, steps: Sequence[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """The weight of the first bound over the age."""
    out = None
    for bound, weight in steps:
        out = (F.when if out is None else out.when)(age < bound, weight)
    return out.otherwise(otherwise)


def gravity_score(points: Column, hours: Column, gravity: float = 1.8) -> Column:
    """points / (hours + 2) ** gravity."""
    return points / F.pow(hours + 2.0, F.lit(gravity))


def hot_score(ups: Column, downs: Column, epoch: Column) -> Column:
    """Sign of the votes times the larger of log10 of their size and 1, plus seconds since 1114293600 by 45000."""
    s = (ups - downs).cast("double")
    return F.signum(s) * F.greatest(F.log10(F.greatest(F.abs(s), F.lit(1.0))), F.lit(1.0)) + (epoch - 1114293600) / 45000.0


def freshness(age: Column, half_life: float, kind: str) -> Column:
    """exponential, linear (to two half-lives), step (one half-life included), or logarithmic freshness of an age; 0 for negative ages and without a half-life."""
    if half_life <= 0:
        return F.when(age.isNotNull(), 0.0)
    r = age / half_life
    curves = {
        "exponential": F.exp(-F.log(F.lit(2.0)) * r),
        "linear": F.greatest(1 - r / 2.0, F.lit(0.0)),
        "step": F.when(age <= half_life, 1.0).otherwise(0.0),
        "logarithmic": 1.0 / (1.0 + F.log2(1.0 + r)),
    }
    return F.when(age < 0, 0.0).otherwise(curves[kind])


def upper_confidence(mean: Column, n: Column, total: Column, c: float = 1.4142135623730951) -> Column:
    """mean + c sqrt(ln(total) / n); infinite if the item was never shown."""
    return F.when(n == 0, float("inf")).otherwise(mean + c * F.sqrt(F.log(total) / n))


def beta_mean(hits: Column, misses: Column) -> Column:
    """Expected value of a Beta counter that starts at (1, 1)."""
    return (hits + 1.0) / (hits + misses + 2.0)


def implicit_rating(signal: Column, strength: Column) -> Column:
    """The base of the signal times its strength between 0 and 1, 5 at most; null for an unknown signal."""
    table = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])
    base = F.try_element_at(table, signal)
    rating = base * F.least(F.greatest(strength, F.lit(0.0)), F.lit(1.0))
    return F.when(base.isNotNull() & strength.isNotNull(), F.least(rating, F.lit(5.0)))


def trend_multiplier(views: Column, least: int, weight: float, cap: float, base: float = 10.0) -> Column:
    """1 under a least number of views, then 1 + weight log_base(views) / base, cap at most; the weight is cut to 0 to 1."""
    boost = 1.0 + min(max(weight, 0.0), 1.0) * F.log(base, views.cast("double")) / base
    return F.when(views < least, 1.0).otherwise(F.least(boost, F.lit(cap)))


def health(successes: Column, calls: Column, latency: Column, threshold: float) -> Column:
    """0.7 success rate + 0.3 (1 - r² / (1 + r²)), r the latency by its threshold; 1 without calls."""
    r = latency / threshold
    return F.when(calls == 0, 1.0).otherwise(0.7 * successes / calls + 0.3 * (1 - r * r / (1 + r * r)))


#: Mixing of the number of an attempt into its jitter (fixed values): multipliers, and shifts before them and at the end.
JITTER_MIX, JITTER_SHIFTS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (30, 27, 31)


def jitter(attempt: int) -> float:
    """The fixed share, from 0 to 1, of the jitter of an attempt."""
    mask = (1 << 64) - 1
    value = attempt + 1
    for k, (factor, shift) in enumerate(zip(JITTER_MIX, JITTER_SHIFTS, strict=True)):
        value = value * factor & mask
        value ^= value >> shift
    return value / 2.0**64


def retry_delay(attempt: Column, base_ms: int, most_ms: int, attempts: int, share: float = 0.0) -> Column:
    """base * 2 ** attempt (31 at most), capped, with a share of it as fixed jitter under the same cap; 0 from the last of the attempts on."""
    share = min(max(share, 0.0), 1.0)
    waits = []
    for n in range(attempts):
        wait = min(base_ms << min(n, 31), most_ms)
        waits.append(min(wait + int(wait * share * jitter(n)), most_ms))
    return F.when(attempt >= 0, F.coalesce(F.get(F.lit(waits) if waits else F.array().cast("array<int>"), attempt.cast("int")), F.lit(0)).cast("long"))


def royalty_cents(gross: Column, points: Column) -> Column:
    """gross cents * basis points / 10000, cut to whole cents; exact, as all are longs."""
    product = gross * points
    return ((product - F.pmod(product, F.lit(10000))) / 10000).cast("long")
