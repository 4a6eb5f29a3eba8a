"""python -m tallyspark.cli describe|head|query|page|stream|figures FILE ...

describe FILE; head FILE [N]; query FILE [--threads N] [--where COL OP VAL]... [--group COL [--bucket W]]
[--count | --sum COL | --avg COL | --min COL | --max COL] [--limit N]; page, like query with --group, and --out PAGE.html;
figures FILE [--check], with pandas; stream FILE [--threshold N] [--limit N].
Files have the attribution log's columns, or end in .parquet. Exit: 2 for bad flags and operators, 1 for errors.
"""

from __future__ import annotations

import argparse
import re
import sys
import time

from pyspark.sql import SparkSession

from . import reports
from .loader import load
from .operators.aggregates import Agg
from .operators.predicates import OPERATORS
from .plans.result import Result
from .schema import DICT
from .streaming.table import StreamingTable


class _Metric(argparse.Action):
    """The last of --count, --sum, ... counts."""

    def __call__(self, parser: argparse.ArgumentParser, space: argparse.Namespace, values: object, flag: str | None = None) -> None:
        space.agg, space.metric = Agg[self.dest.upper()], values or ""


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command")
    commands.add_parser("describe").add_argument("file")
    head = commands.add_parser("head")
    head.add_argument("file")
    head.add_argument("n", nargs="?", type=int, default=5)
    for command in ("query", "page"):
        query = commands.add_parser(command)
        query.add_argument("file")
        query.add_argument("--threads", type=int, default=0)
        query.add_argument("--where", nargs=3, action="append", default=[], metavar=("COL", "OP", "VAL"))
        query.add_argument("--group", default="", required=command == "page")
        query.add_argument("--bucket", type=int, default=0)
        query.add_argument("--count", nargs=0, action=_Metric)
        for name in ("sum", "avg", "min", "max"):
            query.add_argument(f"--{name}", action=_Metric)
        query.add_argument("--limit", type=int, default=20)
        query.set_defaults(agg=Agg.COUNT, metric="")
    query.add_argument("--out", required=True)
    figures = commands.add_parser("figures")
    figures.add_argument("file")
    figures.add_argument("--check", action="store_true")
    stream = commands.add_parser("stream")
    stream.add_argument("file")
    stream.add_argument("--threshold", type=int, default=10_000)
    stream.add_argument("--limit", type=int, default=0)
    return top


# What the C library's strtod takes as a number's beginning.
NUMBER = re.compile(r"\s*([-+]?)(?:(0x(?:[0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)(?:p[-+]?[0-9]+)?)|((?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[-+]?[0-9]+)?)|(inf(?:inity)?)|(nan))", re.I)


def number(text: str) -> float:
    """The number a text begins with, as strtod reads it; 0.0 if it has none."""
    found = NUMBER.match(text)
    if not found:
        return 0.0
    sign, hexa, plain, _, nan = found.groups()
    size = float.fromhex(hexa) if hexa else float(plain) if plain else float("nan") if nan else float("inf")
    return -size if sign == "-" else size


def asked(spark: SparkSession, o: argparse.Namespace) -> Result:
    table = load(o.file, verbose=True, spark=spark)
    query = table.threads(o.threads)
    for column, op, value in o.where:
        query = query.where(column, op, value if table.kind(column) == DICT else number(value))
    if o.group:
        query = query.group_by(o.group, o.bucket)
    return query.agg(o.agg, o.metric)


def run_query(spark: SparkSession, o: argparse.Namespace) -> str:
    result = asked(spark, o)
    return (result.sort_by_value_desc() if o.group else result).to_string(o.limit)


def run_page(spark: SparkSession, o: argparse.Namespace) -> str:
    with open(o.out, "w", encoding="utf-8") as f:
        f.write(reports.page(asked(spark, o), o.limit))
    return f"{o.out}\n"


def run_figures(spark: SparkSession, o: argparse.Namespace) -> str:
    """With --check, what pandas finds otherwise is an error."""
    found = reports.figures(load(o.file, spark=spark))
    if o.check and (wrong := reports.differences(o.file, found)):
        raise ValueError("; ".join(wrong))
    return reports.shown(found) + ("pandas agrees\n" if o.check else "")


def run_stream(spark: SparkSession, o: argparse.Namespace) -> str:
    """Lines of the file are inserted one by one; clicks are counted after each batch."""
    began, shown = time.perf_counter(), 0
    lines = (r["value"] for r in spark.read.option("lineSep", "\n").text(o.file).toLocalIterator())
    next(lines, None)  # the header
    clicks = lambda t: int(t.filter(click=1).count().values[0])
    with StreamingTable(None, o.threshold, spark=spark) as table:
        for n, line in enumerate(lines, 1):
            table.insert(line)
            if table.batches_flushed > shown:
                shown = table.batches_flushed
                print(f"batch {shown}: {table.visible_rows} rows, {table.pending_rows} waiting, {table.query(clicks)} clicks")
            if o.limit and n >= o.limit:
                break
        table.flush_sync()
        s = time.perf_counter() - began
        top = table.query(lambda t: t.group_by("campaign").count().sort_by_value_desc().to_string(5))
        return (
            f"{table.visible_rows} rows in {table.batches_flushed} batches, {s:.2f} s ({table.visible_rows / s / 1e6:.2f} million rows a second)\n{top}"
        )


def main(argv: list[str] | None = None) -> int:
    top = parser()
    o = top.parse_args(argv)  # exits with 2 by itself
    if o.command is None:
        top.print_usage(sys.stderr)
        return 1
    for _, op, _ in getattr(o, "where", []):
        if op not in OPERATORS:
            print(f"{op}: no such operator; use one of {' '.join(OPERATORS)}", file=sys.stderr)
            return 2
    try:
        spark = SparkSession.builder.appName("tallyspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        runs = {"query": run_query, "page": run_page, "stream": run_stream, "figures": run_figures}
        if o.command in runs:
            out = runs[o.command](spark, o)
        else:
            table = load(o.file, spark=spark)
            out = table.describe() if o.command == "describe" else table.head(o.n)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(out, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
