"""Katz backoff language model over words, of order two, and the scores of all texts by it.

P(w | v) is the Good-Turing discounted count of (v, w) over the count of v plus one, where the pair was seen; elsewhere it
is backoff(v) * P(w). The one that is added leaves every context some mass. backoff(v) divides the mass that v's pairs
leave by what single words leave beside v's followers, so that each context's probabilities sum to one exactly. P(w) is the
discounted count of w, and what is left goes to the one symbol that stands for all unknown words. Evaluation recurs from
pair to word for each token; a text's first context is its beginning, its last token the end.

Words are 64-bit hashes. All counting is done on packed, sorted arrays: a block of texts gives each part of the hash range
one row with its distinct words or pairs and their counts, and gets back one row with their totals. A word or pair that is
very frequent is one entry per block, so no part is hot. The model's tables (words, pairs, backoffs) are written by part of
the hash range, in `model.path`.

Null and empty texts have one token, the end. A null id stays null. Without training texts every token is unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flattext import Hasher, find_words, mix, slices, text_bytes
from .shared import forget, parts, small_batches, tidied, written

U = np.uint64
END, BEGIN = U(0x51ED270B5AFE1E5D), U(0x3C6EF372FE94F82B)
HIGH = 5  # counts above this aren't discounted
BLOCK_TOKENS = 1 << 20


def pack(values: np.ndarray) -> bytes:
    """Bytes of like weight together, then compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).reshape(-1)


def pack_sorted(hashes: np.ndarray) -> bytes:
    return pack(np.diff(hashes, prepend=U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U), dtype=U)


def part_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Parts are ranges of the hash."""
    return (((hashes >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def discounts(histogram: np.ndarray) -> np.ndarray:
    """Factors for counts 0 to HIGH; histogram[r]: how many events have count r, to HIGH + 1. Where Good-Turing's estimate
    is no factor between 0 and 1, the absolute discount n1 / (n1 + 2 n2) takes its place."""
    n = np.asarray(histogram, np.float64)
    out = np.ones(HIGH + 1)
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    tail = (HIGH + 1) * n[HIGH + 1] / n[1] if n[1] else 1.0
    for r in range(1, HIGH + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - flat) / r
    return out


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= HIGH, factors[np.minimum(counts, HIGH)], 1.0)


# --- blocks of texts

BLOCK = "block long, docs binary, held binary, sizes binary, words binary, codes binary"


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, number = Hasher(), TaskContext.get().partitionId() << 24
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            ids, out, sizes, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            words, codes = np.unique(tokens, return_inverse=True)
            row = (number, pack(ids), pack(out), pack(sizes), pack_sorted(words), pack(codes.astype(np.int32)))
            held.clear()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], [c.split()[0] for c in BLOCK.split(", ")])

        total = 0
        for batch in batches:
            for own in slices(batch, "text"):
                buf, places = text_bytes(own.column("text"))
                starts, ends = find_words(buf, places)
                counts = np.diff(np.searchsorted(starts, places))
                tokens = np.full(len(starts) + len(counts), END)
                tokens[np.arange(len(starts)) + np.repeat(np.arange(len(counts)), counts)] = hasher(buf, starts, ends)
                ids = own.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                out = own.column("held_out").fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)
                out |= 2 * own.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                held.append((ids, out, (counts + 1).astype(np.int64), tokens))
                total += len(tokens)
                if total >= BLOCK_TOKENS:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return docs.mapInArrow(tidied(run), BLOCK)


@dataclass
class Block:
    ids: np.ndarray
    held: np.ndarray  # 1: held out; 2: the id is null
    sizes: np.ndarray
    words: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, row: dict[str, bytes]) -> Block:
        return cls(unpack(row["docs"], np.int64), unpack(row["held"], np.uint8), unpack(row["sizes"], np.int64), unpack_sorted(row["words"]), unpack(row["codes"], np.int32))

    @property
    def training(self) -> np.ndarray:
        """Of each token."""
        return np.repeat(self.held & 1 == 0, self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes ascending, context code, word code, place of each token's pair). Context code -1 is the beginning."""
        heads = np.cumsum(self.sizes) - self.sizes
        before = np.r_[np.int32(-1), self.codes[:-1]]
        before[heads] = -1
        n = len(self.words) + 1
        own, at = np.unique((before.astype(np.int64) + 1) * n + self.codes, return_inverse=True)
        context, word = own // n - 1, own % n
        left = np.where(context < 0, BEGIN, self.words[context])
        hashes = mix(left * U(0x9E3779B97F4A7C15) + self.words[word])
        order = np.argsort(hashes)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return hashes[order], context[order], word[order], back[at]


def _records(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
    for i in range(batch.num_rows):
        yield {name: values[i] for name, values in columns.items()}


def _by_part(hashes: np.ndarray, n_parts: int) -> Iterator[tuple[int, slice]]:
    part = part_of(hashes, n_parts)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[a]), slice(int(a), int(b))


SENT = "part int, block long, hashes binary, counts binary"


def _sent(blocks: DataFrame, pairs: bool, n_parts: int) -> DataFrame:
    """Distinct words or pairs of each block with their counts in training texts, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _records(batch):
                block = Block.of(row)
                hashes, at = block.words, block.codes
                if pairs:
                    hashes, _, _, at = block.pairs()
                counts = np.bincount(at[block.training], minlength=len(hashes)).astype(np.int32)
                out = [(p, row["block"], pack_sorted(hashes[s]), pack(counts[s])) for p, s in _by_part(hashes, n_parts)]
                yield _batch(out, SENT)

    return blocks.mapInArrow(tidied(run), SENT)


ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _grouped(df: DataFrame, key: str, n: int, schema: str, work: Callable[[int, list[dict]], Iterator[tuple]]) -> DataFrame:
    """work on all rows of each key; a task holds the rows of one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in _records(batch):
                if row[key] != now and rows:
                    yield _batch(list(work(now, rows)), schema)
                    rows = []
                now = row[key]
                rows.append(row)
        if rows:
            yield _batch(list(work(now, rows)), schema)

    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(tidied(run), schema)


TOTALS = "kind string, part int, block long, hashes binary, counts binary, owned binary, histogram array<long>, total long"


def _totals(sent: DataFrame, n: int) -> DataFrame:
    """Per part a row `model` with totals, histogram of counts and sum; per part and block a row `back` with the totals in
    the block's order, and which entries the block owns: each one that was seen in training has one owner."""

    def work(part: int, rows: list[dict]) -> Iterator[tuple]:
        rows.sort(key=lambda r: r["block"])
        hashes = [unpack_sorted(r["hashes"]) for r in rows]
        counts = np.concatenate([unpack(r["counts"], np.int32) for r in rows]).astype(np.int64)
        own, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, at, counts)
        seen = np.flatnonzero(counts > 0)
        owner = np.zeros(len(at), np.uint8)
        _, first = np.unique(at[seen], return_index=True)
        owner[seen[first]] = 1
        known = total > 0
        histogram = np.bincount(np.minimum(total[known], HIGH + 2), minlength=HIGH + 3)
        yield ("model", part, None, pack_sorted(own[known]), pack(total[known]), None, histogram.tolist(), int(total.sum()))
        start = 0
        for r, h in zip(rows, hashes, strict=True):
            s = slice(start, start + len(h))
            yield ("back", part, r["block"], None, pack(total[at[s]]), pack(owner[s]), None, None)
            start += len(h)

    return _grouped(sent, "part", n, TOTALS, work)


@dataclass(frozen=True)
class Statistics:
    """tokens: N; types: V; factors of words and pairs; texts: how many training texts; unknown: P of unknown words."""

    tokens: int
    types: int
    word_factors: np.ndarray
    pair_factors: np.ndarray
    unknown: float


def _statistics(words: DataFrame, pairs: DataFrame) -> Statistics:
    def summed(table: DataFrame) -> tuple[np.ndarray, int]:
        bins = [F.sum(F.get("histogram", F.lit(r))).alias(f"h{r}") for r in range(HIGH + 3)]
        row = table.where("kind = 'model'").agg(*bins, F.sum("total").alias("t")).head()
        return np.array([row[f"h{r}"] or 0 for r in range(HIGH + 3)]), int(row["t"] or 0)

    (by_words, n), (by_pairs, _) = summed(words), summed(pairs)
    factors = discounts(by_words)
    # mass that discounting takes from words; a corpus without rare words leaves one in N + 1
    taken = sum(by_words[r] * r * (1 - factors[r]) for r in range(1, HIGH + 1))
    return Statistics(n, int(by_words.sum()), factors, discounts(by_pairs), float(max(taken, 1e-9 * n) / n) if n else 1.0)


def word_probability(counts: np.ndarray, s: Statistics) -> np.ndarray:
    """Of words with these training counts. With the unknown symbol they sum to one: what words lose is what it has."""
    if not s.tokens:
        return np.full(len(counts), s.unknown)
    taken = 1 - sum_lost(s)
    return np.where(counts > 0, discounted(counts, s.word_factors) / s.tokens * ((1 - s.unknown) / taken), s.unknown)


def sum_lost(s: Statistics) -> float:
    """The part of the mass that discounting takes from words, before a floor is set under it."""
    return s.unknown if s.unknown > 1.5e-9 else 0.0


SCORED = "kind string, part int, block long, place int, doc_id long, held_out int, n_tokens long, n_known long, base double, score double, hashes binary, counts binary, mass binary, followers binary"


def _scored(blocks: DataFrame, words: DataFrame, pairs: DataFrame, s: Statistics, n_parts: int, n: int) -> DataFrame:
    """`doc`: a row per text, its score still without backoffs; `context`: what a block's own pairs add to their contexts'
    sums; `need`: contexts whose backoffs a block's texts need, with the texts' places."""
    nothing = "cast(null as {}) as {}".format
    fields = [c.split() for c in BLOCK.split(", ")]
    back = [f"{name} as {to}" for name, to in (("kind", "kind"), ("part", "part"), ("counts", "counts"), ("owned", "owned"))]
    empty = [nothing(kind, name) for name, kind in fields if name != "block"]
    rows = (
        blocks.selectExpr("'text' as kind", "cast(null as int) as part", "cast(null as binary) as counts", "cast(null as binary) as owned", *(f[0] for f in fields))
        .unionByName(words.where("kind = 'back'").selectExpr("'word' as kind", *back[1:], "block", *empty))
        .unionByName(pairs.where("kind = 'back'").selectExpr("'pair' as kind", *back[1:], "block", *empty))
    )

    def work(_: int, own: list[dict]) -> Iterator[tuple]:
        text = next(r for r in own if r["kind"] == "text")
        block = Block.of(text)
        back_of = lambda kind: sorted((r for r in own if r["kind"] == kind), key=lambda r: r["part"])
        count = np.concatenate([unpack(r["counts"], np.int64) for r in back_of("word")])
        both = np.concatenate([unpack(r["counts"], np.int64) for r in back_of("pair")])
        owned = np.concatenate([unpack(r["owned"], np.uint8) for r in back_of("pair")]).astype(bool)
        _, context, word, at = block.pairs()
        p = word_probability(count, s)
        end = int(np.searchsorted(block.words, END))
        seen = both > 0
        of_context = np.where(context < 0, count[end], count[context])
        # log10 of each pair's probability, a backoff left out
        with np.errstate(divide="ignore"):
            logs = np.where(seen, np.log10(discounted(both, s.pair_factors)) - np.log10(of_context + 1.0), np.log10(p)[word])
        base = np.log10((count + 1.0) / (s.tokens + s.types + 1.0))
        ends = np.cumsum(block.sizes)
        cuts = ends - block.sizes
        scores, bases = np.add.reduceat(logs[at], cuts), np.add.reduceat(base[block.codes], cuts)
        known = np.add.reduceat((count[block.codes] > 0).astype(np.int64), cuts)
        for i in range(len(cuts)):
            doc = None if block.held[i] & 2 else int(block.ids[i])
            yield ("doc", None, text["block"], i, doc, int(block.held[i] & 1), int(block.sizes[i]), int(known[i]), float(bases[i]), float(scores[i]), None, None, None, None)
        names = np.r_[BEGIN, block.words]
        mass = np.bincount(context[owned] + 1, discounted(both[owned], s.pair_factors), len(names))
        followers = np.bincount(context[owned] + 1, p[word[owned]], len(names))
        counts = np.r_[count[end], count]
        on = np.flatnonzero(mass > 0)
        on = on[np.argsort(names[on])]
        for part, cut in _by_part(names[on], n_parts):
            k = on[cut]
            yield ("context", part, text["block"], None, None, None, None, None, None, None, pack_sorted(names[k]), pack(counts[k]), pack(mass[k]), pack(followers[k]))
        unseen = np.flatnonzero(~seen[at] & (of_context[at] > 0))
        who = np.searchsorted(ends, unseen, side="right")
        left = names[context[at[unseen]] + 1]
        order = np.argsort(left, kind="stable")
        left, who = left[order], who[order]
        for part, cut in _by_part(left, n_parts):
            yield ("need", part, text["block"], None, None, None, None, None, None, None, pack_sorted(left[cut]), pack(who[cut].astype(np.int64)), None, None)

    # hashing deals blocks out unevenly, less so over more tasks
    return _grouped(rows, "block", 2 * n, SCORED, work)


BACKOFF = "kind string, block long, part int, hashes binary, places binary, backoffs binary"


def backoff(mass: np.ndarray, counts: np.ndarray, followers: np.ndarray) -> np.ndarray:
    """mass: sum of discounted counts of a context's pairs; followers: sum of their words' P."""
    rest = 1 - followers
    return np.where(rest > 1e-15, (1 - mass / (counts + 1.0)) / np.maximum(rest, 1e-15), 1.0)


def _backoffs(scored: DataFrame, n: int) -> DataFrame:
    """`model`: backoffs of a part's contexts; `sum`: what they add to a text's score."""

    def work(part: int, rows: list[dict]) -> Iterator[tuple]:
        own = [r for r in rows if r["kind"] == "context"]
        if not own:
            return
        names, at = np.unique(np.concatenate([unpack_sorted(r["hashes"]) for r in own]), return_inverse=True)
        mass, followers = (np.bincount(at, np.concatenate([unpack(r[k], np.float64) for r in own])) for k in ("mass", "followers"))
        counts = np.zeros(len(names), np.int64)
        counts[at] = np.concatenate([unpack(r["counts"], np.int64) for r in own])
        value = backoff(mass, counts, followers)
        yield ("model", None, part, pack_sorted(names), None, pack(value))
        for r in rows:
            if r["kind"] == "need":
                found = np.log10(value[np.searchsorted(names, unpack_sorted(r["hashes"]))])
                who, where = np.unique(unpack(r["counts"], np.int64), return_inverse=True)
                yield ("sum", r["block"], part, None, pack(who), pack(np.bincount(where, found)))

    rows = scored.where("kind <> 'doc'").select("kind", "part", "block", "hashes", "counts", "mass", "followers")
    return _grouped(rows, "part", n, BACKOFF, work)


def _sums(backoffs: DataFrame, n: int) -> DataFrame:
    """(block, place, more): all that backoffs add to a text's score."""

    def work(block: int, rows: list[dict]) -> Iterator[tuple]:
        places, at = np.unique(np.concatenate([unpack(r["places"], np.int64) for r in rows]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([unpack(r["backoffs"], np.float64) for r in rows]))
        for place, total in zip(places.tolist(), sums.tolist(), strict=True):
            yield block, place, total

    rows = backoffs.where("kind = 'sum'").select("block", "places", "backoffs")
    return _grouped(rows, "block", n, "block long, place int, more double", work)


@dataclass
class Model:
    """The tables, each by part of the hash range, and what is needed to read them."""

    words: DataFrame
    pairs: DataFrame
    backoffs: DataFrame
    statistics: Statistics
    scores: DataFrame


def fit(docs: DataFrame) -> Model:
    """docs: doc_id long, text, held_out boolean. Learns from the texts that are not held out; scores has every text:
    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), in log10."""
    spark = docs.sparkSession
    small_batches(spark)
    n = parts(spark)
    n_parts = 2 * n
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    blocks = written(_blocks(docs), "blocks")
    words = written(_totals(_sent(blocks, False, n_parts), n), "words")
    pairs = written(_totals(_sent(blocks, True, n_parts), n), "pairs")
    s = _statistics(words, pairs)
    scored = written(_scored(blocks, words, pairs, s, n_parts, n), "scored")
    forget(spark, blocks)
    backoffs = written(_backoffs(scored, n), "backoffs")
    sums = _sums(backoffs, n)
    rows = scored.where("kind = 'doc'").join(sums, ["block", "place"], "left")
    scores = rows.select(
        "doc_id",
        (F.col("held_out") == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(s.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
    keep = lambda t: t.where("kind = 'model'")
    return Model(keep(words), keep(pairs), keep(backoffs), s, scores)
