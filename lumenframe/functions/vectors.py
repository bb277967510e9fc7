"""Column expressions on vectors, sets, bit strings and histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.session import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    """The vector in double precision."""
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if a length differs."""
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; 0 for a vector of no length."""
    size = norm(a) * norm(b)
    return F.when(size < 1e-12, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite if the lengths differ."""
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def l2_likeness(a: Column, b: Column) -> Column:
    """1 / (1 + Euclidean distance)."""
    return 1 / (1 + l2(a, b))


def l1(a: Column, b: Column) -> Column:
    """Manhattan distance; infinite if the lengths differ."""
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(_sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def weighted_l2(a: Column, b: Column, w: Column) -> Column:
    """Euclidean distance with a weight for each component."""
    return F.sqrt(_sum(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), w, lambda d, k: d * k)))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of the components; 0 where one has no variance."""
    centred = lambda v: let(_sum(v) / F.size(a), lambda m: F.transform(v, lambda x: x - m))
    ca, cb = centred(a), centred(b)
    size = norm(ca) * norm(cb)
    return F.when(size < 1e-12, 0.0).otherwise(dot(ca, cb) / size)


def jaccard(a: Column, b: Column) -> Column:
    """Shared by united; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice(a: Column, b: Column) -> Column:
    """Twice the shared by the sum of the sizes; 0 if both are empty."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / both)


def overlap(a: Column, b: Column) -> Column:
    """Shared by the smaller size; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def cosine_sets(a: Column, b: Column) -> Column:
    """Shared by the root of the product of the sizes; 0 if one is empty."""
    product = F.size(F.array_distinct(a)) * F.size(F.array_distinct(b))
    return F.when(product == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(product.cast("double")))


def unexpectedness(a: Column, b: Column) -> Column:
    """1 less Jaccard; 1 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(1 - jaccard(a, b))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(v: Column, n: int) -> Column:
    """The signs of the first n components as a long: bit i is set where component i is positive."""
    bits = F.transform(F.slice(v, 1, n), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def histogram_intersection(a: Column, b: Column) -> Column:
    """Sum of the smaller of each pair of bins."""
    return _sum(F.zip_with(a, b, lambda x, y: F.least(x, y)))


def chi_squared(a: Column, b: Column) -> Column:
    """Sum of squared differences by sums; empty bins count 0."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two rectangles; 0 where they do not meet."""
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    inter = w * h
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    r = F.radians
    h = F.pow(F.sin((r(lat2) - r(lat1)) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))
