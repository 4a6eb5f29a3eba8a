"""Mixing sources to target weights.

A source's weight is its share of tokens to the power of an exponent between 0 (all alike) and 1 (as they come). Bisection
finds the exponent at which the weights have a target entropy, and raises it where the most repeated source would exceed a
limit of repetitions. The budget is by default the least at which every source is used whole once, so no document is lost.

Weights become whole passes over a source, and one partial pass that stops when its tokens are spent. A source is cut by
hash into blocks of about `block_tokens`; each pass takes them in a permutation of its own, and the documents of a block in
an order of the pass's own too. The partial pass takes the first blocks of its permutation. Only the block in which it ends
is looked at document by document, so no source is gathered in one task. `mix_key`, from 0 to 1, interleaves all sources
evenly: any stretch of the rows ordered by it has about the target weights.

Tokens are words between white space; null and empty texts have none, and stay in all whole passes. A null source is a
source of its own. Repeated rows count each, and rows that tie with the last one that the partial pass takes, by id and
source, are taken with it. Without tokens, every document is taken once; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

OUT = ("mix_tokens", "mix_weight", "mix_pass", "mix_block", "mix_key")
#: Blocks whose sums are taken together at first.
STRETCH = 4096


@dataclass(frozen=True)
class Rule:
    """entropy: target, as a part of the largest possible. repetition: most passes over any source, for which the exponent
    is raised. budget: tokens to give out; None for one pass at least of every source. sources: more distinct ones than
    this raise ValueError, as their shares are summed up on the driver."""

    entropy: float = 0.9
    repetition: float = 4.0
    budget: float | None = None
    block_tokens: int = 200_000
    sources: int = 1_000_000
    seed: int = 6


@dataclass(frozen=True)
class Plan:
    exponent: float
    weights: list[float]
    passes: list[float]


def tempered(shares: list[float], exponent: float) -> list[float]:
    powers = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(powers)
    return [p / total for p in powers]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _passes(shares: list[float], weights: list[float], budget_share: float | None) -> list[float]:
    """How often each source is used, for a budget as a multiple of all tokens."""
    rates = [w / s if s > 0 else 0.0 for s, w in zip(shares, weights, strict=True)]
    scale = budget_share if budget_share is not None else 1 / min((r for r in rates if r > 0), default=1.0)
    return [scale * r for r in rates]


def solve(tokens: list[float], rule: Rule = Rule()) -> Plan:  # noqa: B008
    """The exponent by bisection, to 50 binary digits. Entropy falls and repetition falls as it rises."""
    total = sum(tokens)
    if not total:
        return Plan(1.0, [0.0] * len(tokens), [1.0] * len(tokens))
    shares = [t / total for t in tokens]
    budget = None if rule.budget is None else rule.budget / total
    most = math.log(max(sum(t > 0 for t in tokens), 1))

    def bisect(fits) -> float:
        """The largest exponent that fits, where smaller ones do."""
        if fits(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if fits(middle) else (low, middle)
        return low

    exponent = bisect(lambda a: entropy(tempered(shares, a)) >= rule.entropy * most)
    repeats = lambda a: max(_passes(shares, tempered(shares, a), budget))
    if repeats(exponent) > rule.repetition:
        # the least exponent within the limit: the largest that exceeds it, and a little more
        exponent = min(1.0, bisect(lambda a: a <= exponent or repeats(a) > rule.repetition) + 2.0**-49)
    weights = tempered(shares, exponent)
    return Plan(exponent, weights, _passes(shares, weights, budget))


def tokens_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permuted(block: Column, factor: Column, shift: Column, blocks: Column) -> Column:
    """Where a pass has this block: a bijection of the source's blocks, as the factor has no divisor in common with their
    number."""
    return F.pmod(block * factor + shift, blocks)


def orders(source: str, passes: int, blocks: int, seed: int) -> list[tuple[int, int]]:
    """A factor and a shift for each pass over a source."""
    draw = random.Random(f"{seed}/{source}")
    out = []
    for _ in range(passes):
        factor = draw.randrange(1, max(blocks, 2))
        while math.gcd(factor, blocks) != 1:
            factor = draw.randrange(1, max(blocks, 2))
        out.append((factor, draw.randrange(blocks)))
    return out


SOURCES = "source string, weight double, whole int, part double, blocks long, spend double, orders array<struct<factor:long,shift:long>>"


def _cuts(narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, last, cut): the place of the block in which each source's partial pass ends, and the hash of the last
    document that it takes there; null if it takes none of that block. Sums are taken over stretches of places first, then
    over the blocks of one stretch, then over the documents of one block, so no task sees more than that of a source."""
    rows = narrow.join(F.broadcast(sources), "source").where("spend > 0")
    order = F.element_at("orders", F.col("whole") + 1)
    rows = rows.withColumn("place", permuted(F.col("block"), order["factor"], order["shift"], F.col("blocks")))
    blocks = written(rows.groupBy("source", "place", "spend").agg(F.sum("tokens").alias("t")), "blocks")

    def ends(parts: DataFrame, at: str, before: Column) -> DataFrame:
        """Of each source the last part that begins within the budget, and the tokens before it."""
        so_far = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        begun = parts.withColumn("before", before + F.coalesce(F.sum("t").over(so_far), F.lit(0))).where("before < spend")
        found = begun.groupBy("source").agg(F.max_by(F.struct(F.col(at).alias("at"), "before"), at).alias("e"))
        return found.select("source", F.col("e.at").alias("at"), F.col("e.before").alias("start"))

    stretches = blocks.groupBy("source", F.floor(F.col("place") / STRETCH).alias("stretch"), "spend").agg(F.sum("t").alias("t"))
    first = written(ends(stretches, "stretch", F.lit(0)), "stretch").withColumnRenamed("at", "chosen")
    inner = blocks.join(F.broadcast(first), "source").where(F.floor(F.col("place") / STRETCH) == F.col("chosen"))
    last = written(ends(inner, "place", F.col("start")), "last").withColumnRenamed("at", "last")
    within = Window.partitionBy("source").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.join(F.broadcast(last), "source").where(F.col("place") == F.col("last"))
    edge = edge.withColumn("before", F.col("start") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).where("before < spend")
    cut = written(edge.groupBy("source").agg(F.max("hash").alias("cut")), "cut")
    return last.join(cut, "source", "left").select("source", "last", "cut")


def mix(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """docs: doc_id, text, source and other columns. All their columns, with mix_tokens, mix_weight, mix_pass (from 0),
    mix_block and mix_key; a document is there once for every pass that takes it. Columns of the input with those names
    are replaced; no other name is taken."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in OUT]
    name = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), name.alias("source"), "doc_id", F.xxhash64("doc_id", F.lit(rule.seed), name).alias("hash"), tokens_of("text").alias("tokens"))
    narrow = written(rows.select("source", "doc_id", "hash", "tokens"), "narrow")  # tokens are counted here, and once for the result
    sums = narrow.groupBy("source").agg(F.sum("tokens").alias("t")).orderBy("source").limit(rule.sources + 1).collect()
    if len(sums) > rule.sources:
        raise ValueError(f"more than {rule.sources} sources")
    plan = solve([float(r["t"]) for r in sums], rule)
    table = []
    for r, w, p in zip(sums, plan.weights, [max(p, 1.0) if rule.budget is None else p for p in plan.passes], strict=True):
        blocks = max(1, -(-int(r["t"]) // rule.block_tokens))
        table.append((r["source"], w, int(p), p - int(p), blocks, (p - int(p)) * r["t"], orders(r["source"], int(p) + 1, blocks, rule.seed)))
    # one row per source, of which the driver has just counted fewer than the limit
    sources = spark.createDataFrame(table, SOURCES)
    block = F.pmod("hash", F.col("blocks")).alias("block")
    placed = narrow.join(F.broadcast(sources.select("source", "blocks")), "source").select("source", "doc_id", "hash", "tokens", block)
    cuts = _cuts(placed, sources)
    rows = rows.join(F.broadcast(sources), "source").join(F.broadcast(cuts), "source", "left").select("*", block)
    order = F.element_at("orders", F.col("whole") + 1)
    place = permuted(F.col("block"), order["factor"], order["shift"], F.col("blocks"))
    more = (place < F.col("last")) | ((place == F.col("last")) & (F.col("hash") <= F.col("cut")))
    times = F.col("whole") + F.coalesce(more.cast("int"), F.lit(0))
    rows = rows.where(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), times - 1)))
    order = F.element_at("orders", F.col("pass") + 1)
    place = permuted(F.col("block"), order["factor"], order["shift"], F.col("blocks"))
    inside = F.pmod(F.xxhash64("hash", "pass"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    key = (F.col("pass") + (place + inside) / F.col("blocks")) / F.greatest(F.col("whole") + F.col("part"), F.lit(1e-9))
    return rows.select("row.*", F.col("tokens").alias("mix_tokens"), F.col("weight").alias("mix_weight"), F.col("pass").alias("mix_pass"), F.col("block").alias("mix_block"), key.alias("mix_key"))
