"""Predicates: filter builders, a search query language, rule evaluation and access checks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.session import broadcast_if_small


def all_of(conditions: Sequence[Column]) -> Column:
    """Conjunction; true if there are none."""
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    """Disjunction; false if there are none."""
    return reduce(or_, conditions, F.lit(False))


def build_query(df: DataFrame, like: Mapping[str, str] = {}, equal: Mapping[str, object] = {}, at_least: Mapping[str, object] = {}, newest: str | None = None) -> DataFrame:
    """Rows that meet every LIKE, equality and lower bound given, newest first."""
    conditions = [F.col(c).like(v) for c, v in like.items()] + [F.col(c) == v for c, v in equal.items()] + [F.col(c) >= v for c, v in at_least.items()]
    out = df.where(all_of(conditions))
    return out.orderBy(F.desc(newest)) if newest else out


def between_optional(column: str, low: object = None, high: object = None) -> Column:
    """Inclusive optional bounds; a null value fails as soon as a bound is given."""
    found = ([F.col(column) >= low] if low is not None else []) + ([F.col(column) <= high] if high is not None else [])
    return F.coalesce(all_of(found), F.lit(False))


def has_all(column: str, wanted: Sequence[str]) -> Column:
    """Whether an array column holds every wanted element."""
    return F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), F.col(column))) == 0


def contains_any_field(fields: Sequence[str], term: str) -> Column:
    """Case-insensitive substring in any of the fields; null fields never match."""
    return any_of([F.coalesce(F.lower(F.col(f)).contains(term.lower()), F.lit(False)) for f in fields])


def contains_all_terms(fields: Sequence[str], terms: Sequence[str]) -> Column:
    """Every term in some field."""
    return all_of([contains_any_field(fields, t) for t in terms])


_TOKEN = re.compile(r'\s*(\(|\)|"[^"]*"|[^\s()"]+)')


def parse_search(text: str, fields: Sequence[str]) -> Column:
    """A search string as one Column.

    Grammar: terms and "phrases" (substring of any field), field:value, field:low..high (either end
    may be missing), term~d (a word within edit distance d), NOT or a leading minus, AND (also
    between neighbours), OR, and parentheses. An empty string matches every row.
    """
    tokens = _TOKEN.findall(text)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either() -> Column:
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return any_of(parts) if len(parts) > 1 else parts[0]

    def both() -> Column:
        parts = [factor()]
        while peek() is not None and peek() not in (")", "OR"):
            if peek() == "AND":
                take()
            parts.append(factor())
        return all_of(parts) if len(parts) > 1 else parts[0]

    def factor() -> Column:
        if peek() is None:
            raise ValueError("a term is missing")
        token = take()
        if token == "NOT":
            return ~factor()
        if token == "(":
            inner = either()
            if peek() != ")":
                raise ValueError("a parenthesis is not closed")
            take()
            return inner
        if token.startswith("-") and len(token) > 1:
            return ~leaf(token[1:])
        return leaf(token)

    def leaf(token: str) -> Column:
        if token.startswith('"'):
            return contains_any_field(fields, token.strip('"'))
        field, colon, value = token.partition(":")
        if colon and value:
            low, dots, high = value.partition("..")
            if dots:
                cast = lambda x: float(x) if re.fullmatch(r"-?\d+(\.\d+)?", x) else x
                return between_optional(field, cast(low) if low else None, cast(high) if high else None)
            return F.coalesce(F.lower(F.col(field).cast("string")) == value.lower(), F.lit(False))
        if m := re.fullmatch(r"(.+)~(\d?)", token):
            near = int(m[2] or 2)
            words = lambda f: F.split(F.lower(F.coalesce(F.col(f), F.lit(""))), r"\s+")
            return any_of([F.exists(words(f), lambda w: F.levenshtein(w, F.lit(m[1].lower())) <= near) for f in fields])
        return contains_any_field(fields, token)

    if not tokens:
        return F.lit(True)
    found = either()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()}")
    return found


def evaluate_rules(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Samples(metric, value, ...) that fire rules(rule, metric, kind, low, high): above, below, outside (strict), inside (inclusive), always.

    rules is a table that people write; it is broadcast once a count has shown that it is small.
    """
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    fires = (
        F.when(F.col("kind") == "above", v > low).when(F.col("kind") == "below", v < low).when(F.col("kind") == "outside", (v < low) | (v > high))
        .when(F.col("kind") == "inside", (v >= low) & (v <= high)).otherwise(F.col("kind") == "always")
    )
    return samples.join(broadcast_if_small(rules), "metric").where(fires)


def geo_allowed(country: Column, allow: Sequence[str] = (), block: Sequence[str] = ()) -> Column:
    """The block list first, then the allow list unless it is empty; case does not matter."""
    upper = F.upper(country)
    open_ = upper.isin([x.upper() for x in allow]) if allow else F.lit(True)
    return F.when(upper.isin([x.upper() for x in block]) if block else F.lit(False), False).otherwise(open_)


def embargoed(rows: DataFrame, embargoes: DataFrame, now: Column) -> DataFrame:
    """Rows(asset, territory, ...) that no embargo(asset, territory, lift_at) holds back at now."""
    live = embargoes.where(F.col("lift_at") > now).select("asset", "territory")
    return rows.join(live, ["asset", "territory"], "left_anti")


def license_status(requests: DataFrame, grants: DataFrame, agreements: DataFrame) -> DataFrame:
    """requests(asset, usage, territory) with reason: the first check that fails (no_grant, usage, territory, no_agreement) or ok.

    grants(asset, active, usages array, territories array); agreements(asset, status).
    """
    live = agreements.where("status = 'Active'").select("asset", F.lit(True).alias("_agreed")).distinct()
    joined = requests.join(grants.where("active"), "asset", "left").join(live, "asset", "left")
    reason = (
        F.when(F.col("active").isNull(), "no_grant").when(~F.array_contains("usages", F.col("usage")), "usage")
        .when(~F.array_contains("territories", F.col("territory")), "territory").when(F.col("_agreed").isNull(), "no_agreement").otherwise("ok")
    )
    return joined.select(*requests.columns, reason.alias("reason"))


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step whose bound value reaches (steps from high to low)."""
    out = None
    for bound, label in steps:
        out = (F.when if out is None else out.when)(value >= bound, label)
    return out.otherwise(otherwise)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page number (from 1) of size rows at least 1."""
    size = max(1, size)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
