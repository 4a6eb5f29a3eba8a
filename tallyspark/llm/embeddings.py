"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, connected components.

In each table a vector's code is the signs of its products with fixed random directions. Vectors of one label that share a
code in any table meet; they are compared once, in the first table in which they share it. Codes are as long as makes a
code rare among the largest label's vectors, and there are as many tables as let a pair at the threshold share no code
with a chance of `miss`; nearer pairs have less. So work grows little faster than the vectors.

Vectors do not move to all tables: what moves is their signs in all tables, a few dozen bytes. Signs of a pair at the
threshold differ in few places, so a first meeting by signs drops rows without a near partner (a pair at the threshold
fails it with a chance below 1e-12), and only rows that have one are joined with their vectors and compared exactly, in
double precision. A code that very many vectors share is dealt out in blocks that meet pairwise, and each meeting returns
a row per vector, not one per pair.

Vectors that are null, all zero, or hold null or non-finite components, and those with a null label, link with nothing.
Only vectors of equal length are compared. Rows are told apart by their place, not by vec_id: rows that share an id are so
many vectors, each counting the others. A null vec_id has links as others have; it is no component's name, and a component
without any other id has a null one. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import forget, parts, small_batches, tidied, written


@dataclass(frozen=True)
class Rule:
    """threshold: least cosine. miss: with what chance a pair at the threshold may share no code. bits: of a code; None
    for as many as halve the largest label's vectors to one. block: vectors of one code that meet in one go."""

    threshold: float = 0.98
    miss: float = 1e-3
    bits: int | None = None
    block: int = 400
    seed: int = 4

    @property
    def apart(self) -> float:
        """With what chance a sign differs at the threshold."""
        return math.acos(self.threshold) / math.pi

    def plan(self, largest: int) -> tuple[int, int]:
        """(bits, tables) for a label of so many vectors."""
        bits = self.bits or min(48, max(8, math.ceil(math.log2(max(largest, 1)))))
        return bits, math.ceil(math.log(self.miss) / math.log1p(-((1 - self.apart) ** bits)))

    def differing(self, signs: int) -> int:
        """In how many of so many signs a pair may differ: eight standard deviations above what it does at the threshold."""
        return math.ceil(signs * self.apart + 8 * math.sqrt(signs * self.apart * (1 - self.apart)))


def directions(seed: int, width: int, n: int) -> np.ndarray:
    """The same for the same width everywhere."""
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((n, width)).T


def unit_rows(column: pa.Array) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """By length: places and unit vectors in double precision, of those that can link; and which those are."""
    lists = column.cast(pa.large_list(pa.float64()))
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    ok = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    sizes = np.where(ok, np.diff(ends), 0)
    ok &= sizes > 0
    out = {}
    for width in np.unique(sizes[ok]).tolist():
        on = np.flatnonzero(ok & (sizes == width))
        rows = flat[ends[on][:, None] + np.arange(width)]  # a null component is a NaN
        top = np.abs(rows).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        ok[on[~good]] = False
        rows = rows[good] / top[good][:, None]
        out[width] = on[good], rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    return out, ok


def coded(df: DataFrame, rule: Rule, bits: int, tables: int) -> DataFrame:
    """(uid, vec_id, label, width, signs, unit) of all rows; signs, packed, and unit, packed doubles, are null for those
    that link with nothing."""
    kind = df.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known: dict[int, np.ndarray] = {}
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            signs, units, widths = [None] * n, [None] * n, np.zeros(n, np.int32)
            for width, (on, rows) in unit_rows(batch.column("embedding"))[0].items():
                if width not in known:
                    known[width] = directions(rule.seed, width, bits * tables)
                packed = np.packbits(rows @ known[width] > 0, axis=1, bitorder="little")
                packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
                widths[on] = width
                for i, s, u in zip(on.tolist(), packed, rows, strict=True):
                    signs[i], units[i] = s.tobytes(), u.tobytes()
            arrays = [pa.array(np.arange(uid, uid + n)), batch.column("vec_id"), batch.column("label"), pa.array(widths), pa.array(signs, pa.binary()), pa.array(units, pa.binary())]
            uid += n
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "vec_id", "label", "width", "signs", "unit"])

    return df.mapInArrow(tidied(run), f"uid long, vec_id long, label {kind}, width int, signs binary, unit binary")


def _cells(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """(uid, cell, tbl, code, signs): a row for each table; a cell is a label, a length, a table and a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            packed = np.frombuffer(b"".join(batch.column("signs").to_pylist()), np.uint8).reshape(n, -1)
            codes = np.unpackbits(packed, axis=1, bitorder="little")[:, : bits * tables].reshape(n, tables, bits) @ powers
            take = pa.array(np.repeat(np.arange(n), tables))
            own = [batch.column(c).take(take) for c in ("uid", "group", "signs")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(codes.reshape(-1))], ["uid", "group", "signs", "tbl", "code"])

    grouped = rows.where("signs is not null and label is not null").select("uid", F.xxhash64("label", "width").alias("group"), "signs")
    cells = grouped.mapInArrow(tidied(run), "uid long, group long, signs binary, tbl int, code long")
    return cells.withColumn("cell", F.xxhash64("group", "tbl", "code"))


def _met(cells: DataFrame, rule: Rule) -> DataFrame:
    """cells with the block meeting (`meet`) that each row takes part in, and its side. Only cells above a block's size
    are looked up; others are one meeting."""
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > rule.block)
    large = written(large.select("cell", F.ceil(F.col("c") / rule.block).cast("int").alias("blocks")), "large")
    cells = cells.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("side", F.pmod(F.xxhash64("uid", "tbl"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("side", "other"), F.greatest("side", "other")))
    return cells.withColumns({"meet": meet, "between": F.col("side") != F.col("other")}).drop("blocks", "other")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by key as tables in which no key's rows are cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(keys, keys[-1]))  # where the last key begins
        if cut and not (held and keys[0] == keys[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _pairs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within runs of one key, by their distance."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    stop = np.repeat(cuts[1:], np.diff(cuts))
    a, k = np.arange(len(keys)), 1
    while len(a := a[a + k < stop[a]]):
        yield a, a + k
        k += 1


def _comparable(table: pa.Table, a: np.ndarray, b: np.ndarray, columns: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of one cell, between two blocks if the meeting is one of two."""
    c = columns
    on = (c["group"][a] == c["group"][b]) & (c["tbl"][a] == c["tbl"][b]) & (c["code"][a] == c["code"][b])
    # a row of two blocks that meets with its own block alone stands there with `between` false
    return on & (~c["between"][a] | (c["side"][a] != c["side"][b]))


def _first_meeting(a: np.ndarray, b: np.ndarray, tbl: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which pairs share no code in an earlier table."""
    earlier = np.arange(codes.shape[1]) < tbl[a][:, None]
    return ~((codes[a] == codes[b]) & earlier).any(axis=1)


def _columns(table: pa.Table, bits: int, tables: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    c = {name: table[name].to_numpy() for name in ("meet", "uid", "group", "tbl", "code", "side", "between")}
    packed = np.frombuffer(b"".join(table["signs"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    powers = np.int64(1) << np.arange(bits, dtype=np.int64)
    codes = np.unpackbits(packed, axis=1, bitorder="little")[:, : bits * tables].reshape(table.num_rows, tables, bits) @ powers
    return c, packed.view(np.uint64), codes


PAIRS = 1 << 18


def _in_chunks(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(a), PAIRS):
        yield a[i : i + PAIRS], b[i : i + PAIRS]


MEETING = "meet long, uid long, group long, tbl int, code long, side int, between boolean, signs binary"


def _near_rows(rule: Rule, bits: int, tables: int):
    """Rows with a partner whose signs differ in few places."""
    limit = rule.differing(bits * tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "meet"):
            c, signs, codes = _columns(table, bits, tables)
            keep = np.zeros(table.num_rows, bool)
            for x, y in _pairs(c["meet"]):
                for a, b in _in_chunks(x, y):
                    near = np.bitwise_count(signs[a] ^ signs[b]).sum(axis=1, dtype=np.int64) <= limit
                    a, b = a[near], b[near]
                    on = _comparable(table, a, b, c)
                    a, b = a[on], b[on]
                    on = _first_meeting(a, b, c["tbl"], codes)
                    keep[a[on]] = keep[b[on]] = True
            if keep.any():
                yield from table.filter(pa.array(keep)).combine_chunks().to_batches(max_chunksize=20_000)

    return run


def _linked_rows(rule: Rule, bits: int, tables: int):
    """(uid, n, tie): how many rows of the meeting each row links with, and the least of those it can reach there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "meet"):
            c, signs, codes = _columns(table, bits, tables)
            raw = table["unit"].to_pylist()
            n, found = np.zeros(table.num_rows, np.int64), []
            widths = np.array([len(u) for u in raw])
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                units = np.frombuffer(b"".join(raw[i] for i in own), np.float64).reshape(len(own), -1)
                for x, y in _pairs(c["meet"][own]):
                    for p, q in _in_chunks(x, y):
                        on = _comparable(table, own[p], own[q], c)
                        p, q = p[on], q[on]
                        on = _first_meeting(own[p], own[q], c["tbl"], codes)
                        p, q = p[on], q[on]
                        on = np.einsum("ij,ij->i", units[p], units[q]) >= rule.threshold
                        a, b = own[p[on]], own[q[on]]
                        np.add.at(n, a, 1)
                        np.add.at(n, b, 1)
                        found.append((a, b))
            on = np.flatnonzero(n)
            if len(on):
                a, b = (np.concatenate(side) for side in zip(*found, strict=True))
                least = c["uid"].copy()
                while True:
                    low = np.minimum(least[a], least[b])
                    if (low == least[a]).all() and (low == least[b]).all():
                        break
                    np.minimum.at(least, a, low)
                    np.minimum.at(least, b, low)
                yield pa.RecordBatch.from_arrays([pa.array(c["uid"][on]), pa.array(n[on]), pa.array(least[on])], ["uid", "n", "tie"])

    return run


def near_duplicates(df: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """df: vec_id long, label, embedding. A row for each of its rows: (vec_id, n_links, component_id, kept): the other rows
    linked directly, the smallest id that can be reached, and whether that is the row's own."""
    spark = df.sparkSession
    small_batches(spark)
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    largest = df.where("label is not null").groupBy("label").count().agg(F.max("count")).head()[0]  # one number
    bits, tables = rule.plan(largest or 0)
    n = parts(spark)
    rows = written(coded(df, rule, bits, tables), "coded")
    met = _met(_cells(rows, bits, tables), rule)
    dealt = met.select(*(c.split()[0] for c in MEETING.split(", "))).repartition(n, "meet").sortWithinPartitions("meet")
    near = written(dealt.mapInArrow(tidied(_near_rows(rule, bits, tables)), MEETING), "near")
    exact = near.join(rows.select("uid", "unit"), "uid").repartition(n, "meet").sortWithinPartitions("meet")
    links = written(exact.mapInArrow(tidied(_linked_rows(rule, bits, tables)), "uid long, n long, tie long"), "met")
    counts = links.groupBy("uid").agg(F.sum("n").alias("n_links"))
    comps = written(components(links.where("uid <> tie"), "uid", "tie"), "comps").select(F.col("node").alias("uid"), "component")
    named = comps.join(rows.select("uid", "vec_id"), "uid").groupBy("component").agg(F.min("vec_id").alias("least"))
    comps = comps.join(named, "component").select("uid", "component", "least")
    forget(spark, near)
    out = rows.select("uid", "vec_id").join(counts, "uid", "left").join(comps, "uid", "left")
    least = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), F.coalesce(F.col("vec_id") == least, F.lit(False)).alias("kept"))


__all__ = ["Rule", "near_duplicates"]
