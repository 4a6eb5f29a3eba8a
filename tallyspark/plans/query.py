"""Table and Query: an immutable builder whose terminal calls give a Result over one Catalyst plan."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import numeric_key, shown_key
from ..operators import summary
from ..operators.aggregates import Agg, reduce_all, reduce_by
from ..operators.dictionary import codes, first_seen
from ..operators.predicates import operator_of, passing_rows, pushable
from ..schema import DICT, default_of, kind_of
from ..sources.delimited import ROW
from .result import Result


#: Column of a category's code while groups are formed.
CODE = "__code"


@dataclass(frozen=True)
class IngestReport:
    rows: int
    source_mb: float
    seconds: float
    resident_mb: float = 0.0

    def __str__(self) -> str:
        s = max(self.seconds, 1e-9)
        # The figures and units of the report.
        return f"{self.rows} rows in {self.seconds:.2f} s ({self.rows / s / 1e6:.2f} Mrows/s, {self.source_mb / s:.1f} MB/s), {self.resident_mb:.1f} MB resident"


class Table:
    """A frame of int64, float64 and dict columns. row: the column that gives the rows' order, which only the order of
    first appearance, head() and max_rows look at; by default the frame's own order. Nulls are read as 0, 0.0 and "":
    `df` has them so, `raw` as they came, which is what filters can be pushed down to."""

    def __init__(self, df: DataFrame, row: str | None = None) -> None:
        self.row = row or ROW
        if self.row not in df.columns:
            df = df.withColumn(self.row, F.monotonically_increasing_id())
        kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields if f.name != ROW}
        self.kinds: dict[str, str] = {name: kind for name, kind in kinds.items() if kind}
        self.raw = df

    def without_nulls(self, df: DataFrame) -> DataFrame:
        """Rows of this table, with defaults for nulls; other columns stay."""
        whole = {f.name for f in df.schema.fields if not f.nullable}
        typed = {name: F.coalesce(F.col(f"`{name}`"), default_of(kind)) for name, kind in self.kinds.items() if name not in whole}
        return df.withColumns(typed) if typed else df

    @property
    def df(self) -> DataFrame:
        return self.without_nulls(self.raw)

    @property
    def columns(self) -> list[str]:
        return list(self.kinds)

    @property
    def schema(self) -> dict[str, str]:
        return dict(self.kinds)

    @property
    def num_cols(self) -> int:
        return len(self.kinds)

    @cached_property
    def num_rows(self) -> int:
        return self.raw.count()

    @cached_property
    def resident_mb(self) -> float:
        return summary.text_bytes(self.df, self.kinds) / 1e6

    def persist(self) -> Table:
        self.raw = self.raw.persist()
        return self

    def kind(self, column: str | int) -> str:
        """KeyError or IndexError where there is no such column."""
        if isinstance(column, int):
            return self.kinds[self.columns[column]]
        if column not in self.kinds:
            raise KeyError(f"no such column: {column}")
        return self.kinds[column]

    def column(self, column: str | int) -> DataFrame:
        self.kind(column)
        return self.df.select(f"`{self.columns[column] if isinstance(column, int) else column}`")

    def describe(self) -> str:
        return summary.describe(self.df, self.kinds, self.num_rows, self.resident_mb)

    def head(self, n: int = 5) -> str:
        return summary.head(self.df, self.kinds, self.row, n)

    def query(self) -> Query:
        return Query(self)

    def filter(self, **equal: object) -> Query:
        return self.query().filter(**equal)

    def where(self, column: str, op: str, value: float | str) -> Query:
        return self.query().where(column, op, value)

    def group_by(self, column: str, bucket: int = 0) -> Query:
        return self.query().group_by(column, bucket)

    def threads(self, n: int) -> Query:
        return self.query().threads(n)

    def count(self) -> Result:
        return self.query().count()

    def sum(self, column: str) -> Result:
        return self.query().sum(column)

    def avg(self, column: str) -> Result:
        return self.query().avg(column)

    def min(self, column: str) -> Result:
        return self.query().min(column)

    def max(self, column: str) -> Result:
        return self.query().max(column)

    def __repr__(self) -> str:
        return f"<Table {self.num_rows} rows x {self.num_cols} cols>"


@dataclass(frozen=True)
class Query:
    table: Table
    tests: tuple[tuple[str, str, float | str], ...] = field(default=())
    key: str = ""
    bucket: int = 0
    parallel: int = 0

    def where(self, column: str, op: str, value: float | str) -> Query:
        """Rows must pass all tests. op: == != < <= > >= or eq ne lt le gt ge. For a category the value is taken as
        text, unless it is a number given to a range operator: that is a code of first appearance."""
        kind, op = self.table.kind(column), operator_of(op)
        if kind == DICT and (op in ("==", "!=") or not isinstance(value, (int, float))):
            value = str(value)
        elif kind != DICT and isinstance(value, str):
            raise TypeError(f"column {column} holds numbers; it can't be compared with {value!r}")
        return replace(self, tests=(*self.tests, (column, op, value)))

    def where_code(self, column: str, op: str, code: float) -> Query:
        """A category's code of first appearance against a number."""
        if self.table.kind(column) != DICT:
            raise TypeError(f"column {column} has no codes")
        return replace(self, tests=(*self.tests, (column, operator_of(op), float(code))))

    def filter(self, *test: object, **equal: object) -> Query:
        """filter(column, op, value), or filter(column=value, ...) for equality."""
        out = self.where(*test) if test else self
        for column, value in equal.items():
            out = out.where(column, "==", value)
        return out

    def filter_eq(self, column: str, value: float | str) -> Query:
        return self.where(column, "==", value)

    def group_by(self, column: str, bucket: int = 0) -> Query:
        """The last call counts. bucket > 0 groups numbers (of a category: its codes) by multiples toward zero."""
        self.table.kind(column)
        if bucket < 0:
            raise ValueError("a bucket can't be negative")
        return replace(self, key=column, bucket=int(bucket))

    def threads(self, n: int) -> Query:
        """A hint: at most n tasks read the table. 0: Spark decides. Results don't depend on it."""
        return replace(self, parallel=max(0, int(n)))

    def rows(self) -> DataFrame:
        """Tests that a scan can use come first; those of a category's place look it up in the whole table."""
        df = self.table.raw.coalesce(self.parallel) if self.parallel else self.table.raw
        places = []
        for column, op, value in self.tests:
            test = pushable(column, self.table.kind(column), op, value)
            if test is None:
                places.append((column, op, value))
            else:
                df = df.where(test)
        df = self.table.without_nulls(df)
        for column, op, value in places:
            df = passing_rows(df, self.table.df, column, op, value, self.table.row)
        return df

    def agg(self, agg: Agg, metric: str = "", ordered: bool = False) -> Result:
        """ordered: categories in the order of their first appearance in the whole table, numbers of their first row that
        passes."""
        kind = None
        if agg is Agg.COUNT:
            metric = ""
        else:
            if not metric:
                raise ValueError(f"{agg.value} needs a column")
            kind = self.table.kind(metric)
            if kind == DICT:
                raise ValueError(f"{agg.value} needs a column of numbers; {metric} is a category")
        if self.key == "count" and self.key:
            raise ValueError("a group column named count would clash with the result's count")
        began, df = time.perf_counter(), self.rows()
        if not self.key:
            frame = reduce_all(df, agg, metric, kind)
        else:
            key_kind = self.table.kind(self.key)
            if key_kind == DICT and self.bucket:
                coded = codes(self.table.df, self.key, self.table.row).select(F.col("key").alias(self.key), F.col("code").alias(CODE))
                df = df.join(coded, self.key)
                key = F.call_function("div", F.col(CODE), F.lit(self.bucket).cast("bigint")) * self.bucket
            else:
                key = F.col(f"`{self.key}`") if key_kind == DICT else numeric_key(self.key, key_kind, self.bucket)
            by_category = key_kind == DICT and not self.bucket
            frame = reduce_by(df, key, agg, metric, kind, self.table.row if ordered and not by_category else None)
            if ordered and by_category:
                frame = frame.join(first_seen(self.table.df, self.key, self.table.row), "key")
            frame = frame.orderBy("first").drop("first") if ordered else frame
            frame = frame.select(shown_key(F.col("key")).alias("key"), "count", "value")
        return Result(frame, agg, metric, self.key, self, began)

    def count(self) -> Result:
        return self.agg(Agg.COUNT)

    def sum(self, column: str) -> Result:
        return self.agg(Agg.SUM, column)

    def avg(self, column: str) -> Result:
        return self.agg(Agg.AVG, column)

    def min(self, column: str) -> Result:
        return self.agg(Agg.MIN, column)

    def max(self, column: str) -> Result:
        return self.agg(Agg.MAX, column)

    def bytes_scanned(self) -> int:
        """Of the in-memory column model: 8 bytes a row for the metric, each test and a numeric key, 4 for a category
        as key, and one for the mask that tests make."""
        width = 8 * len(self.tests) + bool(self.tests)
        if self.key:
            width += 4 if self.table.kind(self.key) == DICT and not self.bucket else 8
        return width * self.table.num_rows
