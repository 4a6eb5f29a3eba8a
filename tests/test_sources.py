"""Delimited text, Parquet, streams, the generator and the command line."""

import math

import pytest

from tallyspark import Agg, StreamingTable, load
from tallyspark.cli import main
from tallyspark.loader import report
from tallyspark.sources.delimited import read_delimited
from tallyspark.sources.generator import attribution_log, write_log

# The six-row log and its columns.
SCHEMA = {"timestamp": "int", "campaign": "str", "click": "i64", "conversion": "int64", "cost": "double"}
LINES = ["10\tA\t1\t0\t1.0", "20\tA\t0\t0\t2.0", "30\tB\t1\t1\t3.0", "40\tB\t1\t0\t4.0", "50\tC\t0\t0\t5.0", "60\tA\t1\t1\t6.0"]
HEADER = "timestamp\tcampaign\tclick\tconversion\tcost"


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def rows(table, *columns):
    return [tuple(r) for r in table.df.orderBy(table.row).select(*columns).collect()]


def test_golden_file(spark, tmp_path):
    path = write(tmp_path / "a.tsv", "\n".join([HEADER, *LINES]))
    table = load(path, schema=SCHEMA, spark=spark)
    assert table.num_rows == 6 and table.columns == list(SCHEMA)
    assert load(path, schema={"cost": "float", "campaign": "dict"}, spark=spark).columns == ["campaign", "cost"]
    assert load(path, schema=SCHEMA, max_rows=2, spark=spark).num_rows == 2
    assert report(table, path).rows == 6


def test_odd_lines(spark, tmp_path):
    text = f"{HEADER}\r\n1\t\"q\t1\t0\t2\r\n\r\n\t\t\t\t\r\n2\tx\n3\ty\t1\t0\t4\tmore\tfields\n\n7\tlast\t1\t1\t1"
    table = load(write(tmp_path / "b.tsv", text), schema=SCHEMA, spark=spark)
    assert rows(table, *SCHEMA) == [(1, '"q', 1, 0, 2.0), (0, "", 0, 0, 0.0), (2, "x", 0, 0, 0.0), (3, "y", 1, 0, 4.0), (7, "last", 1, 1, 1.0)]


@pytest.mark.parametrize(
    ("text", "whole", "real"),
    [
        ("12abc", 12, 12.0), ("+5", 0, 0.0), (" 5", 0, 0.0), ("-7", -7, -7.0), ("3.7", 3, 3.7), ("99999999999999999999", 0, 1e20),
        ("1e3", 1, 1000.0), ("1e", 1, 1.0), (".5", 0, 0.5), ("5.", 5, 5.0), ("inf", 0, float("inf")), ("-Infinity", 0, float("-inf")), ("1e400", 1, 0.0), ("", 0, 0.0),
    ],
)
def test_number_prefixes(spark, tmp_path, text, whole, real):
    table = load(write(tmp_path / "n.tsv", f"i\tf\n{text}\t{text}\n1\t1"), schema={"i": "int", "f": "float"}, spark=spark)
    assert rows(table, "i", "f")[0] == (whole, real)


def test_headers(spark, tmp_path):
    table = load(write(tmp_path / "h.tsv", "b\tother\ta\tb\n1\t2\t3\t4\n"), schema={"a": "int", "b": "int", "c": "int"}, spark=spark)
    assert table.columns == ["a", "b"] and rows(table, "a", "b") == [(3, 4)]
    plain = load(write(tmp_path / "p.csv", "1,x\n2,y"), sep=",;", schema={"a": "int", "b": "str"}, has_header=False, spark=spark)
    assert rows(plain, "a", "b") == [(1, "x"), (2, "y")]
    for text in ("", "a\tb\n"):
        assert load(write(tmp_path / "e.tsv", text), schema={"a": "int"}, spark=spark).num_rows == 0


def test_streaming(spark, tmp_path):
    with StreamingTable(SCHEMA, flush_threshold=2, spark=spark, path=str(tmp_path)) as table:
        assert table.snapshot().num_rows == 0
        table.insert_all([*LINES[:5]])
        table.insert(LINES[5])
        table.flush_sync()
        assert (table.visible_rows, table.pending_rows, table.batches_flushed) == (6, 0, 3)
        assert table.query(lambda t: t.filter(click=1).count().values[0]) == 4
        assert table.query(lambda t: t.sum("cost").values[0]) == 21.0
        table.insert("")
        assert table.pending_rows == 1
        table.flush_sync()
        assert table.query(lambda t: t.where("campaign", "==", "").count().values[0]) == 1


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "log")
    write_log(attribution_log(spark, 2000, campaigns=20, partitions=2), path)
    assert main(["describe", path]) == 0 and "2000 rows x 22 cols" in capsys.readouterr().out
    assert main(["head", path, "2"]) == 0 and len(capsys.readouterr().out.splitlines()) == 3
    assert main(["query", path, "--where", "click", "eq", "1", "--group", "campaign", "--sum", "cost", "--limit", "3"]) == 0
    assert capsys.readouterr().out.startswith("campaign")
    assert main(["query", path, "--where", "click", "~", "1"]) == 2
    assert main(["query", path, "--sum", "campaign"]) == 1
    assert main([]) == 1
    one = str(tmp_path / "one.tsv")
    lines = spark.read.text(path).collect()
    write(tmp_path / "one.tsv", "\n".join(r[0] for r in lines[:200]))
    assert main(["figures", one, "--check"]) == 0 and "pandas agrees" in capsys.readouterr().out
    shown = tmp_path / "page.html"
    assert main(["page", one, "--group", "campaign", "--sum", "cost", "--limit", "3", "--out", str(shown)]) == 0
    assert shown.read_text().count("<rect") == 3 and "sum_cost by campaign" in shown.read_text()
    assert main(["stream", one, "--threshold", "100"]) == 0 and "199 rows in 2 batches" in capsys.readouterr().out


def test_generator(spark, tmp_path):
    from tallyspark.sources import generator

    generator.main([str(tmp_path / "log"), "--rows", "3_000", "--chunk", "1_000", "--campaigns", "5"])
    table = load(str(tmp_path / "log"))
    assert table.num_rows == 3000 and table.num_cols == 22 and len(table.group_by("campaign").count().keys) <= 5
    times = [r["timestamp"] for r in attribution_log(spark, 2500, chunk=1000, partitions=1).select("timestamp").collect()]
    assert all(times[i : i + 1000] == sorted(times[i : i + 1000]) for i in (0, 1000, 2000)) and times[1000] < times[999] and times[2000] < times[1999]
    assert 0 <= min(times) and max(times) < generator.SPAN_S


def test_only_the_header_is_dropped(spark, tmp_path):
    (tmp_path / "one.tsv").write_text("k\tn\nk\tn\na\t1\nk\tn\n")
    (tmp_path / "two").mkdir()
    for name in ("a", "b"):
        (tmp_path / "two" / name).write_text("k\tn\nk\tn\na\t1\n")
    kinds = {"k": "dict", "n": "int"}
    for path, want in ((tmp_path / "one.tsv", ["a", "k", "k"]), (tmp_path / "two", ["a", "a", "k", "k"])):
        assert sorted(r["k"] for r in read_delimited(spark, str(path), "\t", kinds).collect()) == want
    assert [r["k"] for r in read_delimited(spark, str(tmp_path / "two"), "\t", kinds, max_rows=3).collect()] == ["k", "a", "k"]


@pytest.mark.parametrize("sep", ["|", ".", "^", "a", " ", "\\", "$"])
def test_separators(spark, tmp_path, sep):
    (tmp_path / "t").write_text(f"k{sep}n\nx{sep}{sep}\ny{sep}7\r\n")
    rows = read_delimited(spark, str(tmp_path / "t"), sep, {"k": "dict", "n": "int"}).collect()
    assert [(r["k"], r["n"]) for r in rows] == [("x", 0), ("y", 7)]


def test_constants_of_the_command_line():
    from tallyspark.cli import number

    given = {"+5": 5, " 7x": 7, "-inf": -math.inf, "Infinity": math.inf, "0x1p3": 8, "1e3z": 1000, ".5": 0.5, "5.": 5, "": 0, "x": 0, "-": 0, "1e": 1, "0x": 0}
    assert {k: number(k) for k in given} == given and math.isnan(number("nan"))


def test_folders_of_a_stream_are_merged(spark, tmp_path):
    from tallyspark.streaming import table as streaming

    with streaming.StreamingTable({"k": "dict", "n": "int"}, 1, spark=spark, path=str(tmp_path)) as table:
        table.insert_all(f"k{i % 3}\t{i}" for i in range(streaming.MERGE + 2))
        table.flush_sync()
        assert len(table._folders) == 3 and table.visible_rows == streaming.MERGE + 2
        assert table.query(lambda t: int(t.sum("n").values[0])) == sum(range(streaming.MERGE + 2))
        assert table.query(lambda t: t.group_by("k").agg(Agg.COUNT, ordered=True).keys) == ["k0", "k1", "k2"]


def test_no_temporary_folder_on_a_cluster():
    from tallyspark.folders import shared_folder

    class Session:
        def __init__(self, **held):
            self.conf = held

    with pytest.raises(RuntimeError):
        shared_folder(Session(**{"spark.master": "spark://host:7077"}))
    assert shared_folder(Session(**{"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
    assert shared_folder(Session(**{"spark.master": "local[2]"}))
