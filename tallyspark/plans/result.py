"""Results: a small lazy frame, with exports."""

from __future__ import annotations

import time
from functools import cached_property
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import Agg

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from .query import Query


class Result:
    """frame: key string (if grouped), count bigint, value double. Nothing runs until an export asks for rows."""

    def __init__(self, frame: DataFrame, agg: Agg, metric: str, group_col: str, query: Query, began: float) -> None:
        self.frame, self.agg, self.metric, self.group_col, self._query, self._began = frame, agg, metric, group_col, query, began

    @property
    def grouped(self) -> bool:
        return bool(self.group_col)

    @property
    def value_name(self) -> str:
        return "count" if self.agg is Agg.COUNT else f"{self.agg.value.lower()}_{self.metric}"

    @property
    def named(self) -> DataFrame:
        """The frame under the names of the exports."""
        columns = [F.col("key").alias(self.group_col)] if self.grouped else []
        columns.append(F.col("count"))
        if self.agg is not Agg.COUNT:
            columns.append(F.col("value").alias(self.value_name))
        return self.frame.select(*columns)

    @cached_property
    def _rows(self) -> tuple[pa.Table, float]:
        return self.frame.toArrow(), time.perf_counter() - self._began

    @property
    def seconds(self) -> float:
        return self._rows[1]

    @cached_property
    def rows_scanned(self) -> int:
        return self._query.table.num_rows

    @property
    def rows_per_sec(self) -> float:
        return self.rows_scanned / self.seconds if self.seconds else 0.0

    @property
    def gb_per_sec(self) -> float:
        metric = 0 if self.agg is Agg.COUNT else 8 * self.rows_scanned
        return (self._query.bytes_scanned() + metric) / self.seconds / 1e9 if self.seconds else 0.0

    @property
    def keys(self) -> list[str]:
        return self._rows[0]["key"].to_pylist() if self.grouped else []

    @property
    def counts(self) -> np.ndarray:
        return self._rows[0]["count"].to_numpy()

    @property
    def values(self) -> np.ndarray:
        return self._rows[0]["value"].to_numpy()

    def _with(self, frame: DataFrame) -> Result:
        return Result(frame, self.agg, self.metric, self.group_col, self._query, self._began)

    def sort_by_value_desc(self) -> Result:
        """Largest first, NaN last, ties by key."""
        ties = [F.col("key").asc()] if self.grouped else []
        return self._with(self.frame.orderBy(F.isnan("value").asc(), F.col("value").desc(), *ties))

    def top(self, n: int) -> Result:
        """The n largest: sort and limit in one distributed top-k."""
        return self._with(self.sort_by_value_desc().frame.limit(n))

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {self.group_col: self.keys} if self.grouped else {}
        out["count"] = self.counts
        if self.agg is not Agg.COUNT:
            out[self.value_name] = self.values
        return out

    def to_pandas(self) -> pd.DataFrame:
        import pandas as pd

        return pd.DataFrame(self.to_dict())

    def to_arrow(self) -> pa.Table:
        import pyarrow as pa

        return pa.table(self.to_dict())

    def to_string(self, max_rows: int = 20) -> str:
        # The report's wording, widths and digits.
        label = f"{self.agg.value}({self.metric or '*'})"
        if not self.grouped:
            out = [f"{label} = {self.values[0]:.6g}   [{self.counts[0]} rows matched]"]
        else:
            keys, counts, values = self.keys, self.counts, self.values
            out = [f"{self.group_col:<24} {'count':>12} {label:>14}"]
            out += [f"{k:<24} {c:>12} {v:>14.6g}" for k, c, v in zip(keys[:max_rows], counts, values, strict=False)]
            if len(keys) > max_rows:
                out.append(f"... ({len(keys) - max_rows} more groups)")
        out.append(
            f"scanned {self.rows_scanned} rows in {self.seconds * 1e3:.3f} ms "
            f"({self.rows_per_sec / 1e9:.2f} Grows/s, {self.gb_per_sec:.2f} GB/s)"
        )
        return "\n".join(out) + "\n"

    __repr__ = to_string
