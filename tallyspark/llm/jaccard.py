"""N-gram Jaccard join: documents whose sets of word n-grams have a similarity of at least a threshold, and the components
they form.

1. One pass gives each text its n-gram set's size and 64-bit name, and a sketch of n-gram frequencies over all texts, which
   grows with the input up to a bound. Equal sets are one class from here on, however many copies there are.
2. A second pass orders each set rare first (by sketch, then hash) and emits its prefix: a pair above the threshold shares
   an n-gram of both prefixes. N-grams that only one class has in its prefix are dropped where they meet; what is left, a
   few per cent, are the active postings. The whole sets of their classes are written once.
3. Candidates pass length and positional filters on the shared n-gram, are made distinct, and are verified once. Suffix
   filters come first: bitmaps of the sets' parities, a few per cent of the sets' size, bound from below what only one of
   two sets has, so most candidates go before sets are moved; counts over hash ranges bound the overlap.
4. Components do not need all links within a group. In a first round each shared n-gram pairs one class, its leader, with
   the others; the components so found are contracted. Leader is the class whose prefix is the most frequent: among near
   copies that is the one with the fewest n-grams of its own, to which most others are linked.
5. What is left are n-grams that several components share. Each component joins the group of the best leader that it meets,
   so near copies that did not link stand in one group, not in one each. A class is held against the groups that it shares
   an n-gram with, in blocks of bounded size: rows are classes in groups, never pairs. Pairs of one component are not
   looked at again. A block returns the links that join components, at most one fewer than it has classes. No link between
   different components is lost, and no bound is set on partners.

N-grams and sets are compared by 64-bit hashes: among c different sets, two share a name with a chance of c * c / 2**65.
Overlaps of pairs are counted on 48 bits of them: sets of a and b n-grams share one falsely with a chance of
a * b / 2**48. Null and empty texts, and texts without words, have no n-grams and link with nothing; a text with fewer
words than n has one n-gram, all its words. Letters A-Z are lower-cased. A null id is no document and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .flattext import Hasher, find_words, mix, slices, spread, text_bytes
from .shared import forget, parts, small_batches, tidied, written

U = np.uint64
CHUNK_BITS = 18
RANGES = 16


@dataclass(frozen=True)
class Rule:
    """Links: percent * union <= 100 * intersection. hot_share: an n-gram that holds more than this part of a task's equal
    share of all n-grams has its postings dealt out by class too. broadcast_rows: up to how many classes, or rows that ask
    for classes (at most 60 bytes each), are broadcast; beyond, both sides are dealt out. block_grams, block_rows: the size
    of the blocks in which classes are held against groups."""

    n: int = 5
    percent: int = 75
    hot_share: float = 0.01
    broadcast_rows: int = 200_000
    block_grams: int = 150_000
    block_rows: int = 500

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return size - -(-self.percent * size // 100) + 1

    def overlap(self, a: Column, b: Column) -> Column:
        """What two sets of these sizes must share at least."""
        return F.ceil(F.lit(self.percent) * (a + b) / F.lit(100.0 + self.percent) - 1e-9)


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of all texts, ascending within each, and the n + 1 places of the texts."""
    buf, places = text_bytes(column)
    starts, ends = find_words(buf, places)
    words = Hasher()(buf, starts, ends)
    bounds = np.searchsorted(starts, places)
    counts = np.diff(bounds)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    h = np.zeros(max(len(words) - n + 1, 0), U)
    for k in range(n):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[k : k + len(h)] + U(k + 1))
    out, at = [], np.zeros(len(counts) + 1, np.int64)
    for i in range(len(counts)):
        if counts[i] >= n:
            own = np.unique(h[bounds[i] : bounds[i] + grams[i]])
        else:
            own = np.full(grams[i], int(counts[i]), U)
            for w in words[bounds[i] : bounds[i + 1]]:
                own = mix(own * U(0xD1342543DE82EF95) + w)
        out.append(own)
        at[i + 1] = at[i] + len(own)
    return np.concatenate(out) if out else np.zeros(0, U), at


def set_names(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: a mixed sum over it, and its size."""
    sums = np.r_[U(0), np.cumsum(mix(flat * U(0xA0761D6478BD642F) + U(1)))]
    return mix((sums[at[1:]] - sums[at[:-1]]) * U(0xE7037ED1A0B428DB) + np.diff(at).astype(U))


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def sketch_bits(n_parts: int) -> int:
    """Counters grow with the tasks, and so with the input, from 4 to 16 million."""
    return min(24, max(22, (n_parts << 15).bit_length() - 1))


def slot(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> U(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Sketch:
    """levels: 8 * log2(1 + count) of every counter, a byte each, packed: at most 16 MB. hot: the level from which on an
    n-gram is dealt out by class. A counter holds all n-grams of its slot, so no hot one is missed."""

    levels: bytes
    bits: int
    hot: int

    def read(self) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.levels), np.uint8)


def level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(8 * np.log2(1.0 + counts), 255).astype(np.uint8)


def _survey(docs: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """A row per document (chunk null), and the sketch's chunks of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        names = ["doc_id", "n", "set", "chunk", "counts"]
        for batch in batches:
            for own in slices(batch, "text"):
                flat, at = shingles(own.column("text"), rule.n)
                places = slot(flat, bits)
                places.sort()
                cuts = np.flatnonzero(np.r_[True, places[1:] != places[:-1], True]) if len(places) else np.zeros(1, np.int64)
                sketch[places[cuts[:-1]]] += np.diff(cuts).astype(np.uint32)
                none = [pa.nulls(own.num_rows, pa.int32()), pa.nulls(own.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(np.diff(at)), longs(set_names(flat, at)), *none], names)
        packer = zstandard.ZstdCompressor()
        rows = [(c, part) for c, part in enumerate(sketch.reshape(-1, 1 << CHUNK_BITS)) if part.any()]
        empty = [pa.nulls(len(rows), pa.int64()) for _ in range(3)]
        columns = [pa.array([c for c, _ in rows], pa.int32()), pa.array([packer.compress(p.tobytes()) for _, p in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, *columns], names)

    return docs.mapInArrow(tidied(run), "doc_id long, n long, set long, chunk int, counts binary")


def _sketch(survey: DataFrame, bits: int, rule: Rule, n_parts: int) -> Sketch:
    """The sum over all partitions: at most 2**24 counters, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for c, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(unpacker.decompress(data), np.uint32)
                sums[c] = sums.get(c, U(0)) + part.astype(U)
        rows = [(c, int(s.sum()), zstandard.ZstdCompressor().compress(level(s).tobytes())) for c, s in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["chunk", "total", "levels"])

    chunks = survey.where("chunk is not null").select("chunk", "counts")
    rows = chunks.repartition(1 << (bits - CHUNK_BITS), "chunk").mapInArrow(tidied(run), "chunk int, total long, levels binary").collect()
    levels = np.zeros((1 << (bits - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    for r in rows:
        levels[r["chunk"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["levels"])), np.uint8)
    total = sum(r["total"] for r in rows)
    hot = max(8 * total / (1 << bits), rule.hot_share * total / n_parts, 16)
    return Sketch(zstandard.ZstdCompressor().compress(levels.tobytes()), bits, int(level(np.array([hot]))[0]))


# rank: how rare the prefix is; the least rare class of an n-gram leads
ENTRY = np.dtype([("token", "<u8"), ("set", "<u8"), ("n", "<i4"), ("pos", "<i4"), ("rank", "<u1")])


def _prefixes(docs: DataFrame, sketch: Sketch, rule: Rule, n_parts: int) -> DataFrame:
    """(part, entries): prefix postings packed by part. All postings of an n-gram meet in one part, unless it is hot: then
    they are dealt out by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sketch.read()
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for own in slices(batch, "text"):
                flat, at = shingles(own.column("text"), rule.n)
                size = np.diff(at)
                names = set_names(flat, at)
                _, first = np.unique(names, return_index=True)  # equal sets of this slice once
                first = first[size[first] > 0]
                seen = levels[slot(flat, sketch.bits)]
                keys = (seen.astype(U) << U(56)) | (flat >> U(8))
                lengths = rule.prefix(size[first])
                order = [at[i] + np.argsort(keys[at[i] : at[i + 1]])[:k] for i, k in zip(first.tolist(), lengths.tolist(), strict=True)]
                chosen = np.concatenate(order) if order else np.zeros(0, np.int64)
                owner = np.repeat(first, lengths)
                token = flat[chosen]
                entries = np.zeros(len(token), ENTRY)
                entries["token"], entries["n"], entries["set"] = token, size[owner], names[owner]
                heads = np.cumsum(lengths) - lengths
                entries["pos"] = np.arange(len(token)) - np.repeat(heads, lengths)
                if len(token):
                    usual = np.add.reduceat(seen[chosen].astype(np.int64), heads) // lengths
                    entries["rank"] = np.repeat(255 - usual, lengths)
                salt = np.where(seen[chosen] >= sketch.hot, names[owner], U(0))
                part = (mix(token ^ salt) % U(n_parts)).astype(np.int32)
                order = np.lexsort((token, part))
                part, entries = part[order], entries[order]
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
                data = [packer.compress(columnar(entries[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int32()), pa.array(data, pa.binary())], ["part", "entries"])

    return docs.mapInArrow(tidied(run), "part int, entries binary")


def columnar(entries: np.ndarray) -> bytes:
    """Column by column; of the ascending n-grams the differences. Bytes of like weight stand together."""
    token = np.diff(entries["token"], prepend=U(0))
    columns = [token, *(np.ascontiguousarray(entries[name]) for name in ENTRY.names[1:])]
    return b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)


def rows_of(data: bytes) -> np.ndarray:
    n = len(data) // ENTRY.itemsize
    out, at = np.zeros(n, ENTRY), 0
    for name in ENTRY.names:
        kind = ENTRY[name]
        planes = np.frombuffer(data, np.uint8, kind.itemsize * n, at).reshape(kind.itemsize, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
        at += kind.itemsize * n
    out["token"] = np.cumsum(out["token"], dtype=U)
    return out


def partnered(e: np.ndarray, rule: Rule, reach: int = 16) -> np.ndarray:
    """Which postings, in order of n-gram, pass the length and positional filters with another one of their n-gram. Those
    of n-grams with more postings than can be compared within reach all count as passing."""
    cuts = np.flatnonzero(np.r_[True, e["token"][1:] != e["token"][:-1], True]) if len(e) else np.zeros(1, np.int64)
    size = np.diff(cuts)
    keep = np.repeat(size > reach, size)
    n, rest = e["n"].astype(np.int64), (e["n"] - e["pos"]).astype(np.int64)
    for k in range(1, min(reach, len(e))):
        a, b = n[:-k], n[k:]
        fits = (100 * np.minimum(a, b) >= rule.percent * np.maximum(a, b)) & (np.minimum(rest[:-k], rest[k:]) * (100 + rule.percent) >= rule.percent * (a + b))
        fits &= e["token"][:-k] == e["token"][k:]
        keep[:-k] |= fits
        keep[k:] |= fits
    return keep


def _active(packed: DataFrame, sketch: Sketch, rule: Rule, n_parts: int) -> DataFrame:
    """Postings of n-grams that two classes share, and all of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sketch.read()
        held, part = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            e = np.concatenate(held)
            e = e[np.lexsort((e["set"], e["token"]))]
            same = (e["token"][1:] == e["token"][:-1]) & (e["set"][1:] == e["set"][:-1])
            e = e[np.r_[True, ~same]]
            twin = e["token"][1:] == e["token"][:-1]
            hot = levels[slot(e["token"], sketch.bits)] >= sketch.hot
            on = np.r_[twin, False] | np.r_[False, twin] | hot
            e, hot = e[on], hot[on]
            e = e[partnered(e, rule) | hot]
            for i in range(0, len(e), 50_000):
                own = e[i : i + 50_000]
                arrays = [longs(own["token"].copy()), longs(own["set"].copy()), *(pa.array(own[c].astype(np.int32)) for c in ("n", "pos", "rank"))]
                yield pa.RecordBatch.from_arrays(arrays, ["token", "set", "n", "pos", "rank"])

        for batch in batches:
            for k, data in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                if k != part:
                    yield from flush()
                    held, part = [], k
                held.append(rows_of(zstandard.ZstdDecompressor().decompress(data)))
        yield from flush()

    dealt = packed.repartition(n_parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(tidied(run), "token long, set long, n int, pos int, rank int")


def pack_set(tokens: np.ndarray) -> bytes:
    """48 bits of ascending hashes as differences, bytes of like weight together."""
    steps = np.diff(tokens >> U(16), prepend=U(0))
    return steps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    steps = np.zeros((len(data) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return np.cumsum(steps.view(U).reshape(-1), dtype=U)


def parities(tokens: np.ndarray) -> bytes:
    """Which of a power of two of slots, two to four for an n-gram, hold an odd number of the set's n-grams."""
    width = max(64, 2 << int(len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((tokens & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Parities for fewer slots, width bytes of them."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)


def may_link(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """False where parities of sets of n and m n-grams differ in more slots than linked sets have n-grams that are in one of
    them alone."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    need = -(-percent * (n + m) // (100 + percent))
    return int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(dtype=np.int64)) <= n + m - 2 * need


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(set, size, bits, tokens): whole sets, packed, and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, "text"):
                flat, at = shingles(own.column("text"), rule.n)
                own_sets = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                bits, data = (pa.array([f(t) for t in own_sets], pa.binary()) for f in (parities, pack_set))
                yield pa.RecordBatch.from_arrays([longs(set_names(flat, at)), pa.array(np.diff(at)), bits, data], ["set", "size", "bits", "tokens"])

    return docs.mapInArrow(tidied(run), "set long, size long, bits binary, tokens binary")


def linked(a: bytes, b: bytes, percent: int) -> bool:
    """Whether two sets reach the threshold. The suffix filter comes first: they share no more than the smaller count in
    each range of hashes."""
    x, y = unpack_set(a), unpack_set(b)
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    edges = np.arange(1, RANGES, dtype=U) << U(44)
    by_range = [np.diff(np.r_[0, np.searchsorted(s, edges), len(s)]) for s in (x, y)]
    if int(np.minimum(*by_range).sum()) < need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _checked(pairs: DataFrame, sets: DataFrame, rule: Rule, columns: list[str], holds) -> DataFrame:
    """The pairs (u, v) for which holds, given these columns of both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(side + c).to_pylist() for c in columns for side in ("x_", "y_")]
            on = [holds(*v) for v in zip(*values, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(on, pa.bool_()))

    left, right = (sets.select(F.col("set").alias(k), *(F.col(c).alias(side + c) for c in columns)) for k, side in (("u", "x_"), ("v", "y_")))
    return _small(pairs, rule).join(right, "v").join(left, "u").select("u", "v", *(side + c for c in columns for side in ("x_", "y_"))).mapInArrow(tidied(run), "u long, v long")


def _small(table: DataFrame, rule: Rule) -> DataFrame:
    """A written table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= rule.broadcast_rows else table


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) that reach the threshold: bitmaps decide about most others before whole sets are moved."""
    percent = rule.percent
    near = written(_checked(pairs, sets, rule, ["bits", "size"], lambda a, b, n, m: may_link(a, b, n, m, percent)), "near")
    return _checked(near, sets, rule, ["tokens"], lambda a, b: linked(a, b, percent))


def _possible(rule: Rule) -> Column:
    """Length and positional filter on a shared n-gram."""
    n, m = F.col("n"), F.col("m")
    short = F.lit(100) * F.least(n, m) >= F.lit(rule.percent) * F.greatest(n, m)
    return short & (F.least(n - F.col("pos"), m - F.col("at")) >= rule.overlap(n, m))


def _needed_sets(docs: DataFrame, classes: DataFrame, active: DataFrame, rule: Rule) -> DataFrame:
    """A written table (set, size, bits, tokens) of the classes with active postings. classes: (set, rep); one document of
    each class is read again. The ids of those documents are broadcast if they are few."""
    needed = written(active.select("set").distinct(), "needed")
    reps = written(classes.join(needed, "set", "left_semi").select(F.col("rep").alias("doc_id")), "reps")
    sets = written(_sets(docs.join(_small(reps, rule), "doc_id", "left_semi"), rule), "sets")
    forget(docs.sparkSession, needed, reps)
    return sets


def leader(*more: str) -> Column:
    """To be ordered by: the class with the least rare prefix comes first."""
    return F.struct("rank", F.xxhash64("set").alias("h"), "set", *more)


def _star_links(active: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between each n-gram's leader and the other classes that have it: no more candidates than postings."""
    leaders = active.groupBy("token").agg(F.min(leader("n", "pos")).alias("s"))
    leaders = written(leaders.select("token", F.col("s.set").alias("other"), F.col("s.n").alias("m"), F.col("s.pos").alias("at")), "leaders")
    both = active.join(leaders, "token").where((F.col("set") != F.col("other")) & _possible(rule))
    pairs = both.select(F.least("set", "other").alias("u"), F.greatest("set", "other").alias("v")).distinct()
    pairs = written(pairs, "pairs")
    links = written(_verified(pairs, sets, rule), "verified")
    forget(active.sparkSession, pairs, leaders)
    return links


def _grouped(active: DataFrame, members: DataFrame) -> DataFrame:
    """Postings of n-grams that several components share, with comp and grp: the component of the best leader that any of
    the component's n-grams has. members: (set, comp)."""
    postings = active.join(members, "set")
    found = postings.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(leader("comp")).alias("lead"))
    mixed = written(found.where("lo <> hi").select("token", "lead"), "mixed")
    postings = written(postings.join(mixed, "token"), "postings")
    groups = written(postings.groupBy("comp").agg(F.min("lead").alias("l")).select("comp", F.col("l.comp").alias("grp")), "groups")
    return written(postings.select("token", "set", "n", "pos", "comp").join(groups, "comp"), "grouped")


def _touching(postings: DataFrame, weights: DataFrame, rule: Rule) -> DataFrame:
    """Distinct (set, comp, n, grp): classes, and groups that may hold a class they link with. Of two groups the lighter
    one's classes are held against the heavier one; within a group, all but those of its heaviest component against all.
    What the members of a group know of an n-gram is put together first, so a large group is one row. weights: (grp, w,
    main)."""
    bounds = [F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("comp").alias("lo"), F.max("comp").alias("hi")]
    theirs = postings.groupBy("token", "grp").agg(*bounds).join(weights, "grp")
    theirs = written(theirs.withColumnsRenamed({"grp": "theirs", "w": "their_w", "main": "their_main"}), "theirs")
    n, least_m = F.col("n"), F.greatest(F.col("low"), F.ceil(F.col("n") * rule.percent / F.lit(100.0) - 1e-9))
    need = rule.overlap(n, least_m)
    other = (F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))
    within = (F.col("theirs") == F.col("grp")) & (F.col("comp") != F.col("their_main"))
    larger = F.struct("their_w", "theirs") > F.struct("w", "grp")
    fits = (least_m <= F.col("high")) & (least_m * rule.percent <= n * F.lit(10_000.0 / rule.percent)) & (F.least(n - F.col("pos"), F.col("rest")) >= need)
    mine = postings.join(weights.select("grp", "w"), "grp")
    return mine.join(theirs, "token").where(other & (within | larger) & fits).select("set", "comp", "n", F.col("theirs").alias("grp")).distinct()


def _overlaps(rule: Rule):
    def run(_: tuple, table: pa.Table) -> pa.Table:
        """side 0: classes of a group; side 1: classes to be held against them. The links that join components: each one
        that joins what the block's earlier links have not."""
        side, names = table["side"].to_numpy(), table["set"].to_pylist()
        comps, comp = np.unique(table["comp"].to_numpy(), return_inverse=True)
        tokens = [unpack_set(t) for t in table["tokens"].to_pylist()]
        mine, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: list[tuple[int, int]] = []
        if len(mine) and len(others):
            sizes, root = np.array([len(tokens[i]) for i in mine]), np.arange(len(comps))
            flat, owner = np.concatenate([tokens[i] for i in mine]), np.repeat(np.arange(len(mine)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i in others:
                a, b = np.searchsorted(flat, tokens[i]), np.searchsorted(flat, tokens[i], side="right")
                shared = np.bincount(owner[spread(a, b - a)], minlength=len(mine))
                on = np.flatnonzero(100 * shared >= rule.percent * (sizes + len(tokens[i]) - shared))
                theirs, first = np.unique(root[comp[mine[on]]], return_index=True)
                for r, k in zip(theirs, on[first], strict=True):
                    if r != root[comp[i]]:
                        found.append((names[i], names[mine[k]]))
                        root[root == r] = root[comp[i]]
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return run


def _near_rows(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        """Rows of either side whose parities let them link with a row of the other side and of another component."""
        side, size, comp = table["side"].to_numpy(), table["size"].to_numpy(), table["comp"].to_numpy()
        bits = [np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()]
        widths = np.array([len(b) for b in bits], np.int64)
        keep = np.zeros(len(side), bool)
        need = lambda total: -(-rule.percent * total // (100 + rule.percent))
        groups = {}  # of side 0, by width
        for w in np.unique(widths[side == 0]).tolist():
            own = np.flatnonzero((side == 0) & (widths == w))
            groups[w] = own, np.stack([bits[i] for i in own])
        for i in np.flatnonzero(side == 1):
            for w, (own, theirs) in groups.items():
                width = min(w, int(widths[i]))
                narrow = np.bitwise_xor.reduce(theirs.reshape(len(own), -1, width), axis=1) if w > width else theirs
                differ = np.bitwise_count(narrow ^ folded(bits[i], width)).sum(axis=1, dtype=np.int64)
                total = size[own] + size[i]
                on = (differ <= total - 2 * need(total)) & (comp[own] != comp[i])
                keep[own[on]] = True
                keep[i] |= bool(on.any())
        return table.filter(pa.array(keep)).select(["set", "comp", "grp", "xb", "yb", "side"])

    return run


def _block_links(touching: DataFrame, held: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Holds each class against all classes of the groups that it touches, in blocks of bounded size on both sides.
    Classes and groups are moved, pairs are not. held: (set, comp, n, grp)."""
    count = lambda w, c: F.greatest(F.ceil(F.col(w) / rule.block_grams), F.ceil(F.col(c) / rule.block_rows)).cast("int")
    wanted = touching.groupBy("grp").agg(F.count(F.lit(1)).alias("yc"), F.sum("n").alias("yw"))
    theirs = held.groupBy("grp").agg(F.sum("n").alias("xw"))
    blocks = written(wanted.join(theirs, "grp").select("grp", F.ceil(F.col("xw") / rule.block_grams).cast("int").alias("xs"), count("yw", "yc").alias("ys")), "blocks")
    along = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("set"), F.col(n)).cast("int")
    mine = held.join(blocks, "grp").select("set", "comp", "grp", place("xs").alias("xb"), along("ys").alias("yb"), F.lit(0).alias("side"))
    others = touching.join(blocks, "grp").select("set", "comp", "grp", place("ys").alias("yb"), along("xs").alias("xb"), F.lit(1).alias("side"))
    rows = written(mine.unionByName(others), "held")
    key = ["grp", "xb", "yb"]
    bitmaps = _small(rows, rule).join(sets.select("set", "size", "bits"), "set")
    near = written(bitmaps.groupBy(*key).applyInArrow(_near_rows(rule), "set long, comp long, grp long, xb int, yb int, side int"), "near")
    links = written(_small(near, rule).join(sets.select("set", "tokens"), "set").groupBy(*key).applyInArrow(_overlaps(rule), "u long, v long"), "verified")
    forget(held.sparkSession, rows, near)
    return links


def class_components(active: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(set, comp) of the classes that have links, comp being one of the component's classes."""
    spark = active.sparkSession
    links = _star_links(active, sets, rule)
    found = written(components(links), "found").select(F.col("node").alias("set"), F.col("component").alias("comp"))
    members = active.select("set").distinct().join(found, "set", "left").select("set", F.coalesce("comp", "set").alias("comp"))
    postings = _grouped(active, written(members, "members"))
    held = written(postings.select("set", "comp", "n", "grp").distinct(), "classes")
    parts_of = held.groupBy("grp", "comp").agg(F.sum("n").alias("w"))
    weights = written(parts_of.groupBy("grp").agg(F.sum("w").alias("w"), F.max_by("comp", F.struct("w", "comp")).alias("main")), "weights")
    touching = written(_touching(postings, weights, rule), "touching")
    forget(spark, postings)
    more = _block_links(touching, held, sets, rule)
    if not more.head(1):
        return found
    found = written(components(links.unionByName(more)), "found")
    return found.select(F.col("node").alias("set"), F.col("component").alias("comp"))


def similarity_classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """docs: doc_id long, text. (doc_id, n_shingles, component_id): the set's size, and the smallest id that can be reached
    by links, the document's own included. Repeated ids are so many documents with that id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    small_batches(spark)
    n_parts = parts(spark)
    bits = sketch_bits(n_parts)
    survey = written(_survey(docs, rule, bits), "survey")
    sketch = _sketch(survey, bits, rule, n_parts)
    members = survey.where("chunk is null").select("doc_id", "n", "set")
    classes = written(members.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep")), "classes")
    active = written(_active(_prefixes(docs, sketch, rule, 4 * n_parts), sketch, rule, n_parts), "active")
    sets = _needed_sets(docs, classes, active, rule)
    comps = written(class_components(active, sets, rule), "comps")
    named = comps.join(classes, "set").groupBy("comp").agg(F.min("rep").alias("least"))
    merged = comps.join(written(named, "named"), "comp").select("set", "least")
    final = written(classes.join(merged, "set", "left").select("set", F.coalesce("least", "rep").alias("component_id")), "final")
    forget(spark, active, sets)
    full = members.where("n > 0").join(final, "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
