"""The surface for users' own code: named functions and operators, script predicates, a table function and a data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_OPERATORS: dict[str, tuple[str, Callable[..., DataFrame]]] = {}


def register_operator(name: str, kind: str, run: Callable[..., DataFrame]) -> None:
    """Put an operator in the catalogue; a name is taken once."""
    if name in _OPERATORS:
        raise ValueError(f"{name} is taken")
    _OPERATORS[name] = (kind, run)


def operators(kind: str | None = None) -> list[str]:
    """Names in the catalogue, of one kind or all."""
    return sorted(n for n, (k, _) in _OPERATORS.items() if kind in (None, k))


def apply_operator(name: str, df: DataFrame, **parameters: object) -> DataFrame:
    """Run an operator by name."""
    return _OPERATORS[name][1](df, **parameters)


def script_filter(df: DataFrame, predicate: str) -> DataFrame:
    """Rows that a SQL predicate of the user holds for; nulls count as no."""
    return df.where(F.coalesce(F.expr(predicate).cast("boolean"), F.lit(False)))


def template(name: str, value: Column, *args: str) -> Column:
    """Template functions by name: uppercase, lowercase, trim, replace, substr, pad, format_number, date."""
    table: dict[str, Callable[..., Column]] = {
        "uppercase": lambda v: F.upper(v),
        "lowercase": lambda v: F.lower(v),
        "trim": lambda v: F.trim(v),
        "replace": lambda v, a, b: F.replace(v, F.lit(a), F.lit(b)),
        "substr": lambda v, a, n: F.substr(v, F.lit(int(a) + 1), F.lit(int(n))),
        "pad": lambda v, n, c="0": F.lpad(v, int(n), c),
        "format_number": lambda v, d="2": F.format_number(v.cast("double"), int(d)),
        "date": lambda v, f="yyyy-MM-dd": F.date_format(v, f),
    }
    return table[name](value, *args)


def word_windows(size: int):
    """A table function: (place, words) of every run of size words of a text."""

    @F.udtf(returnType="place: int, words: string")
    class Windows:
        def eval(self, text: str) -> Iterator[tuple[int, str]]:
            found = (text or "").split()
            for i in range(len(found) - size + 1):
                yield i, " ".join(found[i : i + size])

    return Windows


class _Slice(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class FrameSource(DataSource):
    """A source of synthetic frames: (frame, ms, luma), options frames, fps and partitions. It shows the reader contract: plan slices, read each."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "frame long, ms long, luma double"

    def reader(self, schema) -> DataSourceReader:
        options = self.options

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                n, parts = int(options.get("frames", "100")), int(options.get("partitions", "4"))
                return [_Slice(n * i // parts, n * (i + 1) // parts) for i in range(parts)]

            def read(self, partition):
                fps = float(options.get("fps", "25"))
                for i in range(partition.start, partition.stop):
                    yield i, round(i * 1000 / fps), (i * 37 % 256) / 255.0

        return Reader()


def register_source(spark: SparkSession) -> None:
    """Make format("frames") known to a session."""
    spark.dataSource.register(FrameSource)
