"""Attribution logs for tests and benchmarks, made by Spark expressions: any number of rows, in parallel, the same for
the same seed and number of partitions.

python -m tallyspark.sources.generator FOLDER [--rows N] [--seed N] [--campaigns N] [--chunk N]
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ATTRIBUTION

# Rates, span and cardinalities of the log that is imitated.
CONVERSION_RATE, CLICK_RATE, ATTRIBUTED_RATE = 0.0027, 0.05, 0.55
SPAN_S, DAY_S = 30 * 86400, 86400
CATEGORY_CARDINALITIES = (12, 45, 120, 8, 300, 1500, 60, 25, 5000)


def attribution_log(spark: SparkSession, rows: int, seed: int = 7, campaigns: int = 700, partitions: int | None = None, chunk: int = 1_000_000) -> DataFrame:
    """Times span the whole period and ascend within each chunk of rows, as in logs that are put together from several."""
    draws = iter(range(seed * 1000, seed * 1000 + 999))

    def uniform(low: int, high: int) -> Column:
        return F.floor(F.rand(next(draws)) * (high - low) + low).cast("bigint")

    def skewed(n: int, power: float = 1.3) -> Column:
        """Pareto tail by inversion, folded into [0, n)."""
        return F.pmod(F.floor(F.pow(1 - F.rand(next(draws)), F.lit(-1 / (power - 1)))).try_cast("bigint") - 1, F.lit(n))

    def chance(p: float) -> Column:
        return (F.rand(next(draws)) < p).cast("bigint")

    def lognormal(mean: float, sigma: float, digits: int) -> Column:
        return F.round(F.exp(F.randn(next(draws)) * sigma + mean), digits)

    one = lambda flag, then, other: F.when(F.col(flag) == 1, then).otherwise(F.lit(other))
    log = spark.range(0, rows, 1, partitions or spark.sparkContext.defaultParallelism).select(
        "id",
        F.floor((F.col("id") % chunk + F.rand(next(draws))) * SPAN_S / F.least(F.lit(chunk), rows - F.col("id") + F.col("id") % chunk)).cast("bigint").alias("timestamp"),
        uniform(0, 5_000_000).alias("uid"),
        F.concat(F.lit("camp_"), F.coalesce(skewed(campaigns), F.lit(0)).cast("string")).alias("campaign"),
        chance(CONVERSION_RATE).alias("conversion"),
        chance(CLICK_RATE).alias("click"),
        chance(ATTRIBUTED_RATE).alias("attributed"),
        lognormal(-2.0, 0.6, 6).alias("cost"),
        *(F.coalesce(skewed(n), F.lit(0)).cast("string").alias(f"cat{i}") for i, n in enumerate(CATEGORY_CARDINALITIES, 1)),
    )
    log = log.withColumns(
        {
            "attribution": F.col("conversion") * F.col("attributed"),
            "conversion_timestamp": one("conversion", F.col("timestamp") + uniform(60, 14 * DAY_S), -1),
            "conversion_id": one("conversion", F.col("id"), -1),
            "cpo": one("conversion", lognormal(2.5, 0.7, 4), -1.0),
            "click_nb": one("click", uniform(1, 6), 0),
            "time_since_last_click": one("click", uniform(0, 7 * DAY_S), -1),
        }
    )
    log = log.withColumn("click_pos", one("click", F.floor(F.rand(next(draws)) * F.col("click_nb")).cast("bigint"), -1))
    return log.select(*ATTRIBUTION)


def write_log(log: DataFrame, path: str, sep: str = "\t") -> None:
    """One text file per partition, each with a header."""
    log.write.mode("overwrite").option("header", True).option("sep", sep).option("emptyValue", "").csv(path)


def main(argv: list[str] | None = None) -> None:
    number = lambda text: int(text.replace("_", ""))
    options = argparse.ArgumentParser(prog="python -m tallyspark.sources.generator", description="Writes a synthetic log as text.")
    options.add_argument("out", help="folder; it is overwritten")
    for name, default in (("rows", 2_000_000), ("seed", 7), ("campaigns", 700), ("chunk", 1_000_000)):
        options.add_argument(f"--{name}", type=number, default=default)
    o = options.parse_args(argv)
    spark = SparkSession.builder.appName("tallyspark").getOrCreate()
    write_log(attribution_log(spark, o.rows, o.seed, o.campaigns, chunk=o.chunk), o.out)
    print(f"{o.rows} rows in {o.out}")


if __name__ == "__main__":
    main()
