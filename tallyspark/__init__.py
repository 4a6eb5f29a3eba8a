"""Analytics over event logs on Spark: load delimited text, filter, group by one column, aggregate, export; the same
queries over a table that a stream still fills."""

from .loader import load, report
from .operators.aggregates import Agg
from .plans.query import Query, Table
from .plans.result import Result
from .streaming.table import StreamingTable

__all__ = ["Agg", "Query", "Result", "StreamingTable", "Table", "load", "report"]
