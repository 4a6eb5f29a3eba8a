"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Median of five runs after a warm-up.

With BENCH_LOG_ROWS=10000000, also a log of so many rows and 22 columns, made by the generator: text ingest, and the
filtered count, the filtered sum and the filtered sum by campaign over its Parquet table and over memory, on 1, 4 and 8
threads, each in a session of its own; the first run of each is given beside the median."""

import json
import os
import statistics
import subprocess
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from tallyspark import catalog, load
from tallyspark.plans.query import Table
from tallyspark.sources.delimited import read_delimited
from tallyspark.sources.generator import attribution_log, write_log

HEADLINES = (
    "flagship", "count_and", "count_eq_num", "count_global_filtered", "sum_global_filtered", "group_dict_sum", "group_int_sum",
    "group_bucket_day", "group_bucket_negative", "topk_group_sum", "count_lt_dict_code", "describe_cardinality",
)
THREADS = (1, 4, 8)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def ingest(spark: SparkSession, path: str, schema: dict[str, str] | None) -> float:
    """Text parsed whole."""
    return seconds(lambda: read_delimited(spark, path, "\t", schema).write.format("noop").mode("overwrite").save())


def log_queries(cpus: str, folder: str) -> dict:
    """In a session of its own: first run and median."""
    spark = session(cpus)
    queries = {
        "count_clicks": lambda t: t.filter(click=1).count(),
        "sum_cost_of_clicks": lambda t: t.filter(click=1).sum("cost"),
        "sum_cost_of_clicks_by_campaign": lambda t: t.filter(click=1).group_by("campaign").sum("cost"),
    }
    out = {"ingest_first_s": round(ingest(spark, f"{folder}/log.tsv", None), 2), "ingest_s": round(ingest(spark, f"{folder}/log.tsv", None), 2)}
    held = Table(spark.read.parquet(f"{folder}/log.parquet").select("click", "cost", "campaign").persist())
    for kind, table in (("parquet", load(f"{folder}/log.parquet", spark=spark)), ("memory", held)):
        for name, run in queries.items():
            took = [seconds(lambda run=run, table=table: run(table).frame.collect()) for _ in range(6)]
            out[f"{name}_{kind}"] = {"first_s": round(took[0], 3), "s": round(statistics.median(took[1:]), 3)}
    return out


def log_bench(rows: int) -> dict:
    with tempfile.TemporaryDirectory() as folder:
        spark = session("8")
        attribution_log(spark, rows, partitions=8).write.parquet(f"{folder}/log.parquet")
        write_log(spark.read.parquet(f"{folder}/log.parquet").coalesce(1), f"{folder}/text")
        size = sum(os.path.getsize(f"{folder}/text/{f}") for f in os.listdir(f"{folder}/text"))
        (part,) = (f for f in os.listdir(f"{folder}/text") if f.startswith("part-"))
        os.rename(f"{folder}/text/{part}", f"{folder}/log.tsv")
        spark.stop()
        out = {"rows": rows, "text_mb": round(size / 1e6)}
        for n in THREADS:
            done = subprocess.run([sys.executable, __file__, "--log", str(n), folder], capture_output=True, text=True, check=True)
            out[f"threads_{n}"] = json.loads(done.stdout.splitlines()[-1])
            out[f"threads_{n}"]["ingest_rows_per_sec"] = round(rows / out[f"threads_{n}"]["ingest_s"])
        return out


def main() -> None:
    if sys.argv[1:2] == ["--log"]:
        print(json.dumps(log_queries(*sys.argv[2:])))
        return
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(cpus)
    took = {}
    for name in HEADLINES:
        run = lambda name=name: catalog.QUERIES[name](spark, sf_dir).collect()
        run()
        took[name] = round(statistics.median(seconds(run) for _ in range(5)), 4)
    path = catalog.events_as_text(spark, sf_dir)
    ingest(spark, path, catalog.EVENT_TEXT)
    took["text_ingest"] = round(statistics.median(ingest(spark, path, catalog.EVENT_TEXT) for _ in range(3)), 4)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    out = {"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}
    out["ingest_rows_per_sec"] = round(rows / took["text_ingest"])
    if large := int(os.environ.get("BENCH_LOG_ROWS", "0")):
        spark.stop()
        out["log"] = log_bench(large)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
