"""Queries, predicates, keys and results on the six-row log and on edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from tallyspark import Agg, Table
from tallyspark.operators import dictionary
from tallyspark.schema import attribution_schema, resolve

# The six-row log; the answers below follow from it.
ROWS = [(10, "A", 1, 0, 1.0), (20, "A", 0, 0, 2.0), (30, "B", 1, 1, 3.0), (40, "B", 1, 0, 4.0), (50, "C", 0, 0, 5.0), (60, "A", 1, 1, 6.0)]


@pytest.fixture(scope="module")
def log(spark):
    df = spark.createDataFrame(ROWS, "timestamp long, campaign string, click long, conversion long, cost double")
    return Table(df.coalesce(1))


@pytest.fixture(scope="module")
def odd(spark):
    nan = float("nan")
    rows = [(0, "x", 1.2, -1), (1, "y", 1.9, 1), (2, "", -0.5, 99), (3, "x", nan, -100), (4, "z", 5.0, 100)]
    return Table(spark.createDataFrame(rows, "id long, k string, v double, n long"), row="id")


def groups(result):
    return dict(zip(result.keys, result.values.tolist(), strict=True))


def test_totals(log):
    assert (log.num_rows, log.num_cols) == (6, 5)
    assert log.count().values[0] == 6
    assert log.filter(click=1).count().counts[0] == 4
    assert log.filter(conversion=1).count().counts[0] == 2
    assert log.sum("cost").values[0] == 21.0
    assert log.filter(click=1).sum("cost").values[0] == 14.0
    assert [getattr(log, f)("cost").values[0] for f in ("avg", "min", "max")] == [3.5, 1.0, 6.0]
    assert log.where("campaign", "==", "A").count().values[0] == 3


def test_groups(log):
    assert groups(log.group_by("campaign").sum("cost")) == {"A": 9.0, "B": 7.0, "C": 5.0}
    assert groups(log.filter(click=1).group_by("campaign").sum("cost")) == {"A": 7.0, "B": 7.0}
    assert groups(log.group_by("click").count()) == {"0": 2.0, "1": 4.0}
    assert groups(log.group_by("click").group_by("campaign").count()) == {"A": 3.0, "B": 2.0, "C": 1.0}
    top = log.group_by("campaign").sum("cost").sort_by_value_desc()
    assert top.keys == ["A", "B", "C"] and log.group_by("campaign").sum("cost").top(1).keys == ["A"]
    assert log.group_by("campaign").agg(Agg.COUNT, ordered=True).keys == ["A", "B", "C"]


@pytest.mark.parametrize(("op", "want"), [("==", 1), ("!=", 5), ("<", 2), ("<=", 3), (">", 3), (">=", 4)])
def test_number_operators(log, op, want):
    assert log.where("cost", op, 3).count().counts[0] == want
    assert log.where("timestamp", op, 30).count().counts[0] == want


@pytest.mark.parametrize(("op", "want"), [("==", 2), ("!=", 4), ("<", 3), ("<=", 5), (">", 1), (">=", 3)])
def test_category_operators(log, op, want):
    assert log.where("campaign", op, "B").count().counts[0] == want
    assert log.query().where_code("campaign", op, 1.9).count().counts[0] == want


@pytest.mark.parametrize(("op", "want"), [("eq", 0), ("ne", 6), ("lt", 0), ("le", 0), ("gt", 6), ("ge", 6)])
def test_unseen_category(log, op, want):
    assert log.where("campaign", op, "Z").count().counts[0] == want


def test_empty_results(log):
    nobody = log.where("cost", ">", 100)
    for f in ("sum", "avg", "min", "max"):
        r = getattr(nobody, f)("cost")
        assert (r.counts[0], r.values[0]) == (0, 0.0)
        assert getattr(nobody.group_by("campaign"), f)("cost").keys == []


def test_nan(odd):
    for op, want in (("==", 0), ("<", 2), ("<=", 2), (">", 2), (">=", 2), ("!=", 5)):
        assert odd.where("v", op, 1.5).count().counts[0] == want, op
        assert odd.where("v", op, float("nan")).count().counts[0] == (5 if op == "!=" else 0)
    assert (odd.min("v").values[0], odd.max("v").values[0]) == (-0.5, 5.0)
    assert math.isnan(odd.sum("v").values[0])
    only = odd.where("id", "==", 3)
    assert (only.min("v").values[0], only.max("v").values[0]) == (float("inf"), float("-inf"))
    assert odd.group_by("k").sum("v").sort_by_value_desc().keys[-1] == "x"


def test_keys(odd):
    assert groups(odd.group_by("v").count()) == {"1": 2.0, "0": 1.0, "nan": 1.0, "5": 1.0}
    assert groups(odd.group_by("n", 100).count()) == {"0": 3.0, "-100": 1.0, "100": 1.0}
    assert groups(odd.group_by("k", 2).count()) == {"0": 3.0, "2": 2.0}
    assert groups(odd.group_by("k").count())[""] == 1.0


def test_dictionary(odd):
    assert [dictionary.lookup(odd.df, "k", v, "id") for v in ("x", "y", "", "z", "w")] == [0, 1, 2, 3, -1]
    assert dictionary.decode(odd.df, "k", 2, "id") == ""
    with pytest.raises(IndexError):
        dictionary.decode(odd.df, "k", 9, "id")


def test_errors(log):
    with pytest.raises(KeyError):
        log.filter(nothing=1)
    with pytest.raises(ValueError):
        log.where("cost", "~", 1)
    with pytest.raises(TypeError):
        log.where("cost", "==", "A")
    with pytest.raises(ValueError):
        log.sum("campaign")
    with pytest.raises(ValueError):
        log.query().agg(Agg.SUM)
    with pytest.raises(KeyError):
        log.sum("nothing")
    with pytest.raises(ValueError):
        log.group_by("cost", -1)
    with pytest.raises(ValueError):
        resolve({"a": "decimal"})
    with pytest.raises(IndexError):
        log.kind(17)


def test_builder_is_immutable(log):
    base = log.filter(click=1)
    base.where("cost", ">", 3)
    assert base.count().counts[0] == 4


@pytest.mark.parametrize("n", [1, 2, 8])
def test_partitions_do_not_matter(spark, n):
    df = spark.range(0, 20_000, 1, n).selectExpr("id", "concat('g', id % 37) as g", "id % 100 as x")
    table = Table(df, row="id")
    assert table.threads(n).sum("x").values[0] == 200 * 4950.0
    sums = groups(table.threads(n).group_by("g").sum("x"))
    assert len(sums) == 37 and sums["g5"] == float(sum(i % 100 for i in range(5, 20_000, 37)))


def test_exports(log):
    r = log.group_by("campaign").sum("cost").sort_by_value_desc()
    assert list(r.to_dict()) == ["campaign", "count", "sum_cost"]
    assert r.to_pandas()["sum_cost"].tolist() == [9.0, 7.0, 5.0]
    assert r.to_arrow().column_names == ["campaign", "count", "sum_cost"]
    assert list(log.count().to_dict()) == ["count"]
    assert "SUM(cost) = 21   [6 rows matched]" in repr(log.sum("cost"))
    assert "... (1 more groups)" in r.to_string(2) and r.to_string(2).startswith("campaign ")
    assert r.rows_scanned == 6 and r.seconds > 0


def test_describe_and_head(log):
    assert "campaign               dict      (3 distinct)" in log.describe()
    assert log.describe().startswith("Table: 6 rows x 5 cols")
    lines = log.head(2).splitlines()
    assert lines == ["timestamp\tcampaign\tclick\tconversion\tcost\t", "10\tA\t1\t0\t1.000000\t", "20\tA\t0\t0\t2.000000\t"]


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as k", "cast(id as double) as v").write.parquet(str(tmp_path / "t.parquet"))
    table = Table(spark.read.parquet(str(tmp_path / "t.parquet")), row="id")
    plan = table.where("k", "==", 3).sum("v").frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan


def test_schema():
    kinds = attribution_schema()
    assert len(kinds) == 22 and list(kinds.values()).count("int64") == 10 and kinds["cpo"] == "float64"
    assert F is not None


def test_ranges_look_at_the_whole_table(log):
    """Of clicks alone, B would appear before A's second row; the dictionary doesn't change with other tests."""
    assert log.filter(click=0).where("campaign", "<", "B").count().counts[0] == 1
    assert log.where("campaign", "<", "B").filter(click=0).count().counts[0] == 1
    assert log.where("timestamp", ">", 20).where_code("campaign", "<=", 0).count().counts[0] == 1
    assert log.query().where_code("campaign", "<=", 0).where("timestamp", ">", 20).count().counts[0] == 1
    assert log.where("timestamp", ">", 20).group_by("campaign").agg(Agg.COUNT, ordered=True).keys == ["A", "B", "C"]


def test_a_column_may_be_called_code(spark):
    table = Table(spark.createDataFrame([(0, "x", 5), (1, "y", 6), (2, "z", 7)], "id long, k string, code long"), row="id")
    assert groups(table.group_by("k", 2).sum("code")) == {"0": 11.0, "2": 7.0}


def test_nulls_are_defaults(spark):
    rows = [(0, None, None, 1.5), (1, "a", 3, None), (2, "a", None, float("nan"))]
    table = Table(spark.createDataFrame(rows, "id long, k string, n long, v double"), row="id")
    assert table.where("k", "!=", "a").count().counts[0] == 1 and table.where("k", "==", "").count().counts[0] == 1
    assert table.where("n", "<", 2).count().counts[0] == 2 and table.where("n", ">", 2).count().counts[0] == 1
    assert table.where("v", "==", 0).count().counts[0] == 1 and table.where("v", "!=", 0).count().counts[0] == 2
    assert table.min("v").values[0] == 0.0 and table.where("k", "<", "a").count().counts[0] == 1
    assert groups(table.group_by("k").count()) == {"": 1.0, "a": 2.0} and groups(table.group_by("v").count()) == {"1": 1.0, "0": 1.0, "nan": 1.0}
    assert table.group_by("k").agg(Agg.COUNT, ordered=True).keys == ["", "a"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id as n", "cast(id as string) as k").write.parquet(str(tmp_path / "t.parquet"))
    table = Table(spark.read.parquet(str(tmp_path / "t.parquet")))
    plan = table.where("n", ">", 5).where("k", "==", "7").count().frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,5)" in plan and "EqualTo(k,7)" in plan


def test_no_job_before_an_export(spark, log):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "none")
    log.where("campaign", "<", "B").where_code("campaign", ">=", 0).group_by("campaign", 2).sum("cost").top(1)
    jobs = tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


def test_codes_over_several_stretches(spark):
    df = spark.range(0, 4 << 20, 1, 3).selectExpr("id", "cast(greatest(id div 300000, id % 3) as string) as k")
    found = {r["key"]: r["code"] for r in dictionary.codes(df, "k", "id").collect()}
    first = {r["k"]: r["f"] for r in df.groupBy("k").agg(F.min("id").alias("f")).collect()}
    assert found == {k: i for i, k in enumerate(sorted(first, key=first.get))}
