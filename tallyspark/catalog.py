"""Queries over the driver's tables, one per operator, with the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import shared_folder
from .loader import load, report
from .operators import summary
from .operators.aggregates import Agg, reduce_by
from .operators.dictionary import encode
from .plans.query import Query, Table
from .plans.result import Result
from .schema import ATTRIBUTION, DICT, FLOAT64, INT64
from .sources.delimited import ROW, read_delimited
from .streaming.table import StreamingTable

if TYPE_CHECKING:
    import pyarrow as pa

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

OPS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
DAY_SQL = "(epoch_us(ts) // 1000000) // 86400 * 86400"
CODES_SQL = "(select event_type, row_number() over (order by min(event_id)) - 1 as code from events group by 1)"


def table_of(spark: SparkSession, sf_dir: str, name: str) -> Table:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "events":  # the row order that first appearance looks at
        seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
        return Table(df.withColumn("ts_s", seconds), row="event_id")
    return Table(df)


def shown(result: Result, digits: int | None = 2) -> DataFrame:
    """Under the names key, n and value. digits: sums of doubles depend on the order of addition in their last places."""
    value = F.round("value", digits) if digits is not None else F.col("value")
    value = value + F.lit(0.0)
    keys = [F.col("key")] if result.grouped else []
    return result.frame.select(*keys, F.col("count").alias("n"), value.alias("value"))


def add(name: str, run: Run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


def simple(name: str, table: str, build: Callable[[Query], Query], agg: Agg, metric: str, sql: str, digits: int | None = 2) -> None:
    add(name, lambda spark, d: shown(build(table_of(spark, d, table).query()).agg(agg, metric), digits), sql)


def sql_value(agg: Agg, metric: str, digits: int = 2) -> str:
    if agg is Agg.COUNT:
        return "count(*)::double"
    return f"round(coalesce({agg.value.lower()}({metric}::double), 0), {digits}) + 0.0"


def sql_select(source: str, agg: Agg, metric: str, key: str = "", digits: int = 2) -> str:
    keys = f"({key})::varchar as key, " if key else ""
    return f"select {keys}count(*) as n, {sql_value(agg, metric, digits)} as value from {source}" + (" group by 1" if key else "")


def _fill() -> None:
    same = lambda q: q
    simple("count_all", "events", same, Agg.COUNT, "", sql_select("events", Agg.COUNT, ""))
    for op, sign in OPS.items():
        test = lambda q, op=op: q.where("l_quantity", op, 25)
        simple(f"count_{op}_num", "lineitem", test, Agg.COUNT, "", sql_select(f"lineitem where l_quantity {sign} 25", Agg.COUNT, ""))
        test = lambda q, op=op: q.where("event_type", op, "view")
        if op in ("eq", "ne"):
            simple(f"count_{op}_dict", "events", test, Agg.COUNT, "", sql_select(f"events where event_type {sign} 'view'", Agg.COUNT, ""))
        else:
            source = f"events join {CODES_SQL} using (event_type) where code {sign} (select code from {CODES_SQL} where event_type = 'view')"
            simple(f"count_{op}_dict_code", "events", test, Agg.COUNT, "", sql_select(source, Agg.COUNT, ""))
            code = lambda q, op=op: q.where_code("event_type", op, 2)
            source = f"events join {CODES_SQL} using (event_type) where code {sign} 2"
            simple(f"count_{op}_dict_number", "events", code, Agg.COUNT, "", sql_select(source, Agg.COUNT, ""))
        unseen = lambda q, op=op: q.where("event_type", op, "nowhere")
        keeps = "true" if op in ("ne", "gt", "ge") else "false"
        simple(f"count_{op}_dict_unseen", "events", unseen, Agg.COUNT, "", sql_select(f"events where {keeps}", Agg.COUNT, ""))
    three = lambda q: q.where("l_returnflag", "==", "R").where("l_quantity", ">=", 10).where("l_discount", "<", 0.05)
    source = "lineitem where l_returnflag = 'R' and l_quantity >= 10 and l_discount < 0.05"
    simple("count_and", "lineitem", three, Agg.COUNT, "", sql_select(source, Agg.COUNT, ""))
    simple("filter_eq_kwargs", "lineitem", lambda q: q.filter(l_linenumber=1, l_returnflag="A"), Agg.COUNT, "", sql_select("lineitem where l_linenumber = 1 and l_returnflag = 'A'", Agg.COUNT, ""))

    clicks, nobody = (lambda q: q.filter(event_type="click")), (lambda q: q.where("value", "<", -1e9))
    for agg in Agg:
        name, metric = agg.value.lower(), "" if agg is Agg.COUNT else "value"
        digits = 6 if agg is Agg.AVG else 2
        rest = (agg, metric)
        simple(f"{name}_global", "events", same, *rest, sql_select("events", *rest, digits=digits), digits)
        simple(f"{name}_global_filtered", "events", clicks, *rest, sql_select("events where event_type = 'click'", *rest, digits=digits), digits)
        simple(f"{name}_empty", "events", nobody, *rest, sql_select("events where value < -1e9", *rest, digits=digits), digits)
        by_type = lambda q: q.group_by("event_type")
        simple(f"group_dict_{name}", "events", by_type, *rest, sql_select("events", *rest, "event_type", digits), digits)

    vanish = lambda q: q.where("o_totalprice", ">", 300_000).group_by("o_orderpriority")
    simple("group_dict_filtered_vanish", "orders", vanish, Agg.SUM, "o_totalprice", sql_select("orders where o_totalprice > 300000", Agg.SUM, "o_totalprice", "o_orderpriority"))
    simple("group_dict_empty", "events", lambda q: nobody(q).group_by("event_type"), Agg.SUM, "value", sql_select("events where value < -1e9", Agg.SUM, "value", "event_type"))
    simple("group_int_sum", "lineitem", lambda q: q.group_by("l_linenumber"), Agg.SUM, "l_extendedprice", sql_select("lineitem", Agg.SUM, "l_extendedprice", "l_linenumber"))
    simple("group_float_trunc", "events", lambda q: q.group_by("value"), Agg.COUNT, "", sql_select("events", Agg.COUNT, "", "trunc(value)::bigint"))
    simple("group_last_wins", "events", lambda q: q.group_by("user_id").group_by("event_type"), Agg.COUNT, "", sql_select("events", Agg.COUNT, "", "event_type"))
    simple("group_bucket_day", "events", lambda q: q.group_by("ts_s", 86_400), Agg.SUM, "value", sql_select("events", Agg.SUM, "value", DAY_SQL))
    simple("group_bucket_negative", "customer", lambda q: q.group_by("c_acctbal", 100), Agg.COUNT, "", sql_select("customer", Agg.COUNT, "", "trunc(c_acctbal)::bigint // 100 * 100"))
    simple("group_bucket_dict_code", "events", lambda q: q.group_by("event_type", 2), Agg.SUM, "value", sql_select(f"events join {CODES_SQL} using (event_type)", Agg.SUM, "value", "code // 2 * 2"))

    add(
        "topk_group_sum",
        lambda spark, d: shown(table_of(spark, d, "lineitem").group_by("l_suppkey").sum("l_extendedprice").top(10)),
        f"select * from ({sql_select('lineitem', Agg.SUM, 'l_extendedprice', 'l_suppkey')}) order by value desc, key limit 10",
    )
    add("flagship", flagship, sql_select("lineitem where l_linenumber = 1", Agg.SUM, "l_extendedprice", "l_returnflag"))
    add(
        "ctr",
        lambda spark, d: table_of(spark, d, "events").df.agg(
            F.count_if(F.col("event_type") == "click").alias("clicks"), F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("event_type") == "click") / F.count(F.lit(1)), 9).alias("ctr")
        ),
        "select count(*) filter (event_type = 'click') as clicks, count(*) as n, round(count(*) filter (event_type = 'click') / count(*), 9) as ctr from events",
    )
    add("describe_cardinality", describe_cardinality, "select 'event_type' as column_name, count(distinct event_type) as distinct_values from events union all select 'props', count(distinct props) from events")
    add("dictionary_codes", dictionary_codes, f"select event_id, event_type, code from events join {CODES_SQL} using (event_type)")
    add("head_rows", head_rows, "select event_id, user_id, event_type, value from events order by event_id limit 5")
    add("text_roundtrip_group", text_roundtrip, sql_select("events where user_id > 10", Agg.SUM, "value", "event_type"))
    add("text_max_rows", text_max_rows, sql_select("(select * from events order by event_id limit 777)", Agg.SUM, "value", "event_type"))
    add("stream_equals_batch", stream_rows, sql_select("events", Agg.SUM, "value", "event_type"))
    add("ordered_groups", ordered_groups, "select event_type as key, count(*) as n, min(event_id) as first from events group by 1")

    below = f"events join {CODES_SQL} using (event_type) where value > 50 and code < (select code from {CODES_SQL} where event_type = 'view')"
    simple("filter_then_dict_range", "events", lambda q: q.where("value", ">", 50).where("event_type", "<", "view"), Agg.COUNT, "", sql_select(below, Agg.COUNT, ""))
    simple("dict_range_then_filter", "events", lambda q: q.where("event_type", "<", "view").where("value", ">", 50), Agg.COUNT, "", sql_select(below, Agg.COUNT, ""))
    coded = f"events join {CODES_SQL} using (event_type) where user_id = 7 and code <= 1"
    simple("filter_then_dict_code", "events", lambda q: q.where("user_id", "==", 7).where_code("event_type", "<=", 1), Agg.COUNT, "", sql_select(coded, Agg.COUNT, ""))
    simple("threads_hint", "events", lambda q: q.threads(2).group_by("event_type"), Agg.SUM, "value", sql_select("events", Agg.SUM, "value", "event_type"))
    of_user = f"(select event_type, min(code) as code, count(*) as n from events join {CODES_SQL} using (event_type) where user_id = 3 group by 1)"
    add("ordered_groups_filtered", ordered_groups_filtered, f"select row_number() over (order by code) - 1 as place, event_type as key, n from {of_user}")
    grouped = "select event_type, count(*) as count, round(sum(value), 2) + 0.0 as sum_value from events group by 1"
    for name, export in EXPORTS.items():
        add(f"export_{name}", lambda spark, d, export=export: exported(spark, d, export), grouped)
    add("export_string", export_string, "select printf('%-24s %12d %14.6g', l_returnflag, count(*), sum(l_quantity)) as line from lineitem group by l_returnflag")
    add("head_text", head_text, "select printf('%d%s%d%s%s%s%.6f%s', event_id, chr(9), user_id, chr(9), event_type, chr(9), value, chr(9)) as line from (select * from events order by event_id limit 5)")
    add("column_access", lambda spark, d: table_of(spark, d, "events").column("value"), "select value from events")
    add("resident_bytes", resident_bytes, "select (count(*) * (5 * 8 + 2 * 4))::bigint + (select sum(octet_length(encode(v)) + 32) from (select distinct event_type as v from events union all select distinct props from events))::bigint as bytes from events")
    add("load_parquet", lambda spark, d: shown(load(f"{d}/events.parquet", spark=spark).filter(event_type="click").group_by("user_id").sum("value")), sql_select("events where event_type = 'click'", Agg.SUM, "value", "user_id"))
    add("load_log", load_log, sql_select("events where event_type = 'click'", Agg.SUM, "value", "event_type"))
    add("ingest_report", ingest_report, "select count(*) as n, count(*) * (2 * 8 + 8 + 4)::bigint + (select sum(octet_length(encode(event_type)) + 32) from (select distinct event_type from events))::bigint as bytes from events")
    odd = "select event_id, user_id, case when event_id % 5 = 1 then '' else event_type end as event_type, case when event_id % 5 = 1 then 0.0 else value end as value from events where event_id % 5 <> 0"
    add("text_odd_lines", text_odd_lines, odd)
    add("text_repeated_header", text_repeated_header, "select sum(n)::bigint as n, sum(zeros)::bigint as zeros from (select count(*) as n, 0 as zeros from events union all select 2, 2)")
    whole = "case event_id % 6 when 0 then user_id when 3 then -user_id when 5 then user_id else 0 end"
    real = "case event_id % 6 when 0 then '1000' when 1 then '0.5' when 2 then '5' when 3 then 'nan' when 4 then 'inf' else '1' end"
    add("text_number_prefixes", text_number_prefixes, f"select event_id, {whole} as whole, {real} as real from events")
    folded = "(select coalesce(nullif(event_type, 'view'), '') as event_type, case when user_id < 20 then 0 else user_id end as user_id, case when value < 10 then 0.0 else value end as value from events)"
    for op in ("==", "!="):
        sign = "<>" if op == "!=" else "="
        add(f"nulls_{'ne' if op == '!=' else 'eq'}", lambda spark, d, op=op: shown(with_nulls(spark, d).where("event_type", op, "click").where("user_id", "<", 100).group_by("event_type").sum("value")), sql_select(f"{folded} where event_type {sign} 'click' and user_id < 100", Agg.SUM, "value", "event_type"))
    add("nulls_min", lambda spark, d: shown(with_nulls(spark, d).group_by("user_id").min("value")), sql_select(folded, Agg.MIN, "value", "user_id"))
    add("stream_insert", lambda spark, d: inserted(spark, d, 2500, 256), "select count(*) as visible, 0::bigint as pending, ceil(count(*) / 2500)::bigint as batches, count(*) filter (event_type = 'click') as clicks from events")
    add("stream_backpressure", lambda spark, d: inserted(spark, d, 1000, 1), "select count(*) as visible, 0::bigint as pending, ceil(count(*) / 1000)::bigint as batches, count(*) filter (event_type = 'click') as clicks from events")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(table_of(spark, sf_dir, "lineitem").filter(l_linenumber=1).group_by("l_returnflag").sum("l_extendedprice").sort_by_value_desc())


def describe_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = table_of(spark, sf_dir, "events")
    return summary.cardinalities(table.df, table.kinds)


def dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = table_of(spark, sf_dir, "events")
    return encode(table.df, "event_type", table.row).select("event_id", "event_type", F.col("event_type_code").alias("code"))


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = table_of(spark, sf_dir, "events")
    return table.df.orderBy(table.row).limit(5).select("event_id", "user_id", "event_type", "value")


def ordered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the order of their first rows."""
    table = table_of(spark, sf_dir, "events")
    frame = reduce_by(table.df, F.col("event_type"), Agg.COUNT, row=table.row).orderBy("first")
    return frame.select("key", F.col("count").alias("n"), "first")


EVENT_TEXT = {"event_id": "int64", "user_id": "int64", "event_type": "dict", "value": "float64"}


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def events_as_text(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENT_TEXT)
    events.write.option("sep", "\t").option("header", True).csv(path)
    return path


def text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Table(read_delimited(spark, events_as_text(spark, sf_dir), "\t", EVENT_TEXT))
    return shown(table.where("user_id", ">", 10).group_by("event_type").sum("value"))


def text_max_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENT_TEXT)
    events.orderBy("event_id").coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
    return shown(Table(read_delimited(spark, path, "\t", EVENT_TEXT, max_rows=777)).group_by("event_type").sum("value"))


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, as text files, through the streaming parser in micro-batches; then a batch query on the table."""
    table = StreamingTable(EVENT_TEXT, spark=spark)
    columns = F.concat_ws("\t", *(F.col(c).cast("string") for c in EVENT_TEXT))
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(columns.alias("value"))
    lines.repartition(3).write.text(f"{table.root}/source")
    table._start()
    table._query.processAllAvailable()
    table.stop()
    return shown(table.snapshot().group_by("event_type").sum("value"))


def ordered_groups_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one user's events, in the order in which their categories first appear in the whole table."""
    rows = table_of(spark, sf_dir, "events").filter(user_id=3).group_by("event_type").agg(Agg.COUNT, ordered=True)
    pairs = enumerate(zip(rows.keys, rows.counts.tolist(), strict=True))
    return spark.createDataFrame([(i, key, n) for i, (key, n) in pairs], "place bigint, key string, n bigint")


EXPORTS: dict[str, Callable[[SparkSession, Result], DataFrame]] = {
    "dict": lambda spark, r: spark.createDataFrame(list(zip(*(list(map(lambda v: getattr(v, "item", lambda: v)(), c)) for c in r.to_dict().values()), strict=True)), list(r.to_dict())),
    "pandas": lambda spark, r: spark.createDataFrame(r.to_pandas()),
    "arrow": lambda spark, r: spark.createDataFrame(r.to_arrow()),
    "views": lambda spark, r: r.named,
}


def exported(spark: SparkSession, sf_dir: str, export: Callable[[SparkSession, Result], DataFrame]) -> DataFrame:
    frame = export(spark, table_of(spark, sf_dir, "events").group_by("event_type").sum("value"))
    return frame.withColumn("sum_value", F.round("sum_value", 2) + F.lit(0.0))


def export_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's groups, without its first line and the last one, which has times."""
    lines = table_of(spark, sf_dir, "lineitem").group_by("l_returnflag").sum("l_quantity").to_string().splitlines()
    return spark.createDataFrame([(line,) for line in lines[1:-1]], "line string")


def head_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = table_of(spark, sf_dir, "events")
    lines = Table(table.df.select("event_id", "user_id", "event_type", "value"), row="event_id").head(5).splitlines()
    return spark.createDataFrame([(line,) for line in lines[1:]], "line string")


def resident_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = table_of(spark, sf_dir, "events").raw.withColumn("ts_us", F.col("ts_s"))
    return spark.createDataFrame([(round(Table(table, row="event_id").resident_mb * 1e6),)], "bytes bigint")


def load_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log with the 22 columns that load() assumes."""
    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    given = {"timestamp": F.unix_seconds(F.col("ts").cast("timestamp")), "uid": F.col("user_id"), "campaign": F.col("event_type"), "click": (F.col("event_type") == "click").cast("int"), "cost": F.col("value")}
    rest = {INT64: F.lit(-1), FLOAT64: F.lit(-1.0), DICT: F.lit("0")}
    log = events.select(*(given.get(name, rest[kind]).alias(name) for name, kind in ATTRIBUTION.items()))
    log.write.option("sep", "\t").option("header", True).csv(path)
    return shown(load(path, spark=spark).filter(click=1).group_by("campaign").sum("cost"))


def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = events_as_text(spark, sf_dir)
    found = report(Table(read_delimited(spark, path, "\t", EVENT_TEXT)), path)
    return spark.createDataFrame([(found.rows, round(found.resident_mb * 1e6))], "n bigint, bytes bigint")


def text_of(spark: SparkSession, lines: DataFrame) -> str:
    path = scratch(spark)
    lines.write.text(path)
    return path


def text_odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No header; every fifth line is blank, one is short, one has fields too many and one ends with a carriage return."""
    events, kind = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 5
    fields = [F.col(c).cast("string") for c in EVENT_TEXT]
    whole = F.concat_ws("\t", *fields)
    line = F.when(kind == 0, "").when(kind == 1, F.concat_ws("\t", *fields[:2])).when(kind == 2, F.concat(whole, F.lit("\t1\t2"))).when(kind == 3, F.concat(whole, F.lit("\r"))).otherwise(whole)
    return read_delimited(spark, text_of(spark, events.select(line.alias("value"))), "\t", EVENT_TEXT, has_header=False).drop(ROW)


def text_repeated_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file whose header stands three times: once as the header, and twice as rows of defaults."""
    path = scratch(spark)
    header = spark.createDataFrame([("\t".join(EVENT_TEXT),)] * 3, "value string").coalesce(1)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws("\t", *(F.col(c).cast("string") for c in EVENT_TEXT)).alias("value"))
    header.unionByName(events).coalesce(1).write.text(path)
    rows = read_delimited(spark, path, "\t", EVENT_TEXT)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("event_type") == "event_type") & (F.col("value") == 0)).alias("zeros"))


def text_number_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are read from a field's longest valid beginning."""
    events, kind, user = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 6, F.col("user_id").cast("string")
    whole = F.when(kind == 0, F.concat(user, F.lit("abc"))).when(kind == 1, F.concat(F.lit("+"), user)).when(kind == 2, F.concat(F.lit(" "), user))
    whole = whole.when(kind == 3, F.concat(F.lit("-"), user)).when(kind == 4, F.lit("x1")).otherwise(F.concat(user, F.lit(".9")))
    real = F.when(kind == 0, "1e3").when(kind == 1, ".5z").when(kind == 2, "5.").when(kind == 3, "nan").when(kind == 4, "Inf").otherwise("1e")
    path = text_of(spark, events.select(F.concat_ws("\t", F.col("event_id").cast("string"), whole, real).alias("value")))
    rows = read_delimited(spark, path, "\t", {"event_id": "int", "whole": "int", "real": "float"}, has_header=False)
    text = F.when(F.isnan("real"), "nan").when(F.col("real") == float("inf"), "inf").when(F.col("real") == F.floor("real"), F.col("real").cast("bigint").cast("string")).otherwise(F.col("real").cast("string"))
    return rows.select("event_id", "whole", text.alias("real"))


def with_nulls(spark: SparkSession, sf_dir: str) -> Table:
    """Events without some of their values; a missing one is 0, 0.0 or "" to every operator."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Table(events.select(F.nullif("event_type", F.lit("view")).alias("event_type"), F.when(F.col("user_id") >= 20, F.col("user_id")).alias("user_id"), F.when(F.col("value") >= 10, F.col("value")).alias("value")))


def on_the_driver(lines: DataFrame) -> Iterator[str]:
    """The values of a column of texts in their order, one partition at a time. They come in blocks: a row of its own for each
    took most of the time of a stream."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as to:
                to.write_batch(batch)
            yield pa.record_batch([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block"])

    import pyarrow as pa

    for row in lines.mapInArrow(blocks, "block binary").toLocalIterator():
        for batch in pa.ipc.open_stream(row["block"]):
            yield from batch.column(0).to_numpy(zero_copy_only=False).tolist()


def inserted(spark: SparkSession, sf_dir: str, threshold: int, capacity: int) -> DataFrame:
    """All events, inserted line by line; what is visible once all are flushed."""
    columns = F.concat_ws("\t", *(F.col(c).cast("string") for c in EVENT_TEXT))
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(columns.alias("value"))
    with StreamingTable(EVENT_TEXT, threshold, queue_capacity=capacity, spark=spark) as table:
        table.insert_all(on_the_driver(lines))
        table.flush_sync()
        clicks = table.query(lambda t: int(t.filter(event_type="click").count().values[0]))
        found = (table.visible_rows, table.pending_rows, table.batches_flushed, clicks)
    return spark.createDataFrame([found], "visible bigint, pending bigint, batches bigint, clicks bigint")


_fill()
__all__ = ["QUERIES", "ROW", "SQL"]
