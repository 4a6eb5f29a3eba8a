"""Token ids in binary shards under a Re-Pair grammar.

Texts are encoded with a byte-level BPE file of the tokenizers library, whose pattern parts a text where letters end and
before a blank that stands before a character that is no white space. Texts are cut there and equal stretches are encoded
once, by the library: those that are letters after a blank at most are one word of the pattern and skip its expression,
others go through all of it. Each document's ids end with an end id. Documents are dealt out by ranges of doc_id; each
task writes its ids in ascending order as shards.

In a shard, the most frequent neighbouring pairs of ids are replaced by new symbols, again and again, until none is
frequent. The file holds the rules, the length that each rule expands to, the symbols, the ids before every 4096th symbol,
and the documents with their numbers of ids; any stretch of ids can be decoded from those without the rest.

Null is the empty text. Repeated doc_ids keep all their rows, in the order in which the input is read; rows with a null
doc_id come first. No document is split between shards. An empty table gives no shards.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .flattext import mix, slices, spread, take_stretches, text_bytes
from .sentencepieces import Known
from .shared import in_worker, parts, small_batches, tidied, written
from .stores import read_file, write_file

MAGIC, EVERY, BLOCK = b"RPIDS\x01\0\0", 4096, 4096
# Bytes after a blank at which the text is not cut, as they are or begin white space.
UNSURE = np.zeros(256, bool)
UNSURE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
# Second bytes of the letters of Latin-1 after 0xC3; the signs for times and divided by are none.
LATIN = np.zeros(256, bool)
LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
# What surely ends a run of letters: printable ASCII that is no letter, and line ends.
SURE_END = np.zeros(256, bool)
SURE_END[[b for b in range(33, 127) if not LETTER[b]] + [10]] = True
# How a byte-level vocabulary shows a byte as a character: printable ones as they are, others from 256 on.
SHOWN = np.arange(256, dtype="<u2")
_hidden = [*range(33), *range(127, 161), 173]
SHOWN[_hidden] = 256 + np.arange(len(_hidden))


@dataclass(frozen=True)
class Rule:
    """shard_ids: about how many ids a shard holds. A pair is frequent if a shard has it least times, and once in
    `share` symbols. rounds, rules: at most so many rounds, and rules a round."""

    shard_ids: int = 1 << 20
    least: int = 32
    share: int = 4096
    rounds: int = 8
    rules: int = 1024
    end_id: int = 0


class TextCoder:
    def __init__(self, path: str) -> None:
        """Files without the byte-level pattern, or with a normalizer or added tokens of letters, raise ValueError."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        form = data.get("pre_tokenizer") or {}
        plain = form.get("type") == "ByteLevel" and not form.get("add_prefix_space", True) and form.get("use_regex", True) and not data.get("normalizer")
        self.added = [t["content"].encode() for t in data.get("added_tokens", [])]
        if not plain or any(t["content"].isalpha() for t in data.get("added_tokens", [])):
            raise ValueError("only byte-level vocabularies without a normalizer are supported")
        self.library, self.words = Tokenizer.from_file(path), Tokenizer.from_str(json.dumps(data | {"pre_tokenizer": None, "post_processor": None}))
        self.known = Known(self.encode)
        # a byte is a character of a token
        self.widths = np.array([len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())], np.int64)

    def encode(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of stretches by the library, and their numbers of ids."""
        ends = np.cumsum(sizes)
        heads = ends - sizes
        others = np.r_[0, np.cumsum(~letters(raw))]
        word = (others[ends] - others[heads] == (raw[heads] == 32)) & (raw[ends - 1] != 32)
        some, rest = np.flatnonzero(word), np.flatnonzero(~word)
        found = self.joined(raw, heads[some], ends[some]) if len(some) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if found is None:
            some, rest, found = some[:0], np.arange(len(sizes)), (np.zeros(0, np.int32), np.zeros(0, np.int64))
        coded = self.library.encode_batch_fast([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(heads[rest], ends[rest], strict=True)], add_special_tokens=False)
        own = [np.array(c.ids, np.int32) for c in coded]
        counts = np.zeros(len(sizes), np.int64)
        counts[some], counts[rest] = found[1], [len(x) for x in own]
        out, at = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        out[spread(at[some], counts[some])] = found[0]
        if own:
            out[spread(at[rest], counts[rest])] = np.concatenate(own)
        return out, counts

    def joined(self, raw: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for stretches that are one word of the pattern, given to the library as words and told apart by the
        bytes of each id. None if those do not add up to the stretches."""
        shown = SHOWN[raw].tobytes().decode("utf-16-le")
        words = [shown[a:b] for a, b in zip(heads.tolist(), ends.tolist(), strict=True)]
        coded = self.words.encode_batch_fast([words[i : i + BLOCK] for i in range(0, len(words), BLOCK)], is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(c.ids, np.int32) for c in coded])
        reached, until = np.cumsum(self.widths[ids]), np.cumsum(ends - heads)
        last = np.searchsorted(reached, until)
        if last[-1] != len(ids) - 1 or not np.array_equal(reached[last], until):
            return None
        return ids, np.diff(np.r_[-1, last])

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and the n + 1 places of the texts in them."""
        buf, places = text_bytes(column)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(places), np.int64)
        first = np.zeros(len(buf), bool)
        first[:-1] = (buf[:-1] == 32) & ~UNSURE[buf[1:]]
        first[1:] |= letters(buf)[:-1] & SURE_END[buf[1:]]
        first[places[1:-1][places[1:-1] > 0] - 1] &= buf[places[1:-1][places[1:-1] > 0] - 1] != 32  # a text's last blank
        raw = buf.tobytes() if self.added else b""
        for token in self.added:  # they are found before the pattern is applied
            at = raw.find(token)
            while at >= 0:
                first[at + 1 : at + len(token)] = False
                at = raw.find(token, at + len(token))
        first[places[:-1][np.diff(places) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.r_[starts[1:], len(buf)]
        ids, counts = self.known.ids(buf, starts, ends)
        return ids, np.r_[0, np.cumsum(counts)][np.searchsorted(starts, places)]


def letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes are, or end or begin, a letter of ASCII or Latin-1; other letters are not looked for."""
    out = LETTER[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[LATIN[buf[lead + 1]]]
    out[lead] = out[lead + 1] = True
    return out


def _frequent(seq: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Pairs to be replaced together, most frequent first: no symbol is both the end of one and the beginning of another,
    so that their occurrences can't overlap. Both symbols of a frequent pair are frequent, so others needn't be counted."""
    least = max(rule.least, len(seq) // rule.share)
    often = np.flatnonzero(np.bincount(seq) >= least)
    rank = np.full(int(seq.max()) + 1, -1, np.int32 if len(often) < 1 << 15 else np.int64)
    rank[often] = np.arange(len(often))
    own = rank[seq]
    codes = own[:-1] * rank.dtype.type(len(often)) + own[1:]
    codes = codes[(own[:-1] >= 0) & (own[1:] >= 0)]
    codes.sort()
    cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True]) if len(codes) else np.zeros(1, np.int64)
    pairs, counts = codes[cuts[:-1]].astype(np.int64), np.diff(cuts)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] >= least][: 4 * rule.rules]
    begins: set[int] = set()
    ends: set[int] = set()
    chosen = []
    for a, b in zip(often[pairs[order] // max(len(often), 1)].tolist(), often[pairs[order] % max(len(often), 1)].tolist(), strict=True):
        if len(chosen) < rule.rules and a not in ends and b not in begins and (a != b or a not in begins):
            chosen.append((a, b))
            begins.add(a)
            ends.add(b)
    return chosen


def compress(ids: np.ndarray, first_symbol: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k is the pair that symbol first_symbol + k stands for."""
    seq, rules = ids.astype(np.int32), []
    for _ in range(rule.rounds):
        chosen = _frequent(seq, rule) if len(seq) > 1 else []
        if not chosen:
            break
        heads, tails = (list(dict.fromkeys(side)) for side in zip(*chosen, strict=True))
        row, column = np.full(first_symbol + len(rules), -1, np.int16), np.full(first_symbol + len(rules), -1, np.int16)
        row[heads], column[tails] = np.arange(len(heads)), np.arange(len(tails))
        table = np.full((len(heads), len(tails)), -1, np.int32)
        pairs = np.array(chosen)
        table[row[pairs[:, 0]], column[pairs[:, 1]]] = np.arange(len(chosen))
        left, right = row[seq[:-1]], column[seq[1:]]
        at = np.flatnonzero((left >= 0) & (right >= 0))
        found = table[left[at], right[at]]
        at, found = at[found >= 0], found[found >= 0]
        # occurrences overlap only in runs of one symbol: every second goes
        run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
        even = ((at - np.repeat(at[run], np.diff(np.r_[run, len(at)]))) & 1) == 0
        at, found = at[even], found[even]
        seq[at] = first_symbol + len(rules) + found
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules += chosen
    return seq.astype(np.uint32), np.array(rules, np.uint32).reshape(-1, 2)


def lengths_of(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    sizes = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        sizes[k] = sum(sizes[s - first_symbol] if s >= first_symbol else 1 for s in (a, b))
    return sizes


@dataclass
class Shard:
    docs: np.ndarray
    nulls: np.ndarray  # which documents have no id
    counts: np.ndarray
    symbols: np.ndarray = field(repr=False)
    rules: np.ndarray = field(repr=False)
    expands: np.ndarray = field(repr=False)
    marks: np.ndarray = field(repr=False)
    first_symbol: int = 0

    @classmethod
    def build(cls, docs: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, first_symbol: int, rule: Rule) -> Shard:
        symbols, rules = compress(ids, first_symbol, rule)
        expands = lengths_of(rules, first_symbol)
        out = cls(docs, nulls, counts, symbols, rules, expands, np.zeros(0, np.int64), first_symbol)
        out.marks = np.r_[0, np.cumsum(out.widths(symbols))][:-1][::EVERY] if len(symbols) else out.marks
        return out

    def widths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        on = symbols >= self.first_symbol
        out[on] = self.expands[symbols[on] - self.first_symbol]
        return out

    def dumps(self) -> bytes:
        wide = "<u2" if self.first_symbol + len(self.rules) <= 1 << 16 else "<u4"
        head = struct.pack("<8sIIQQQQ", MAGIC, self.first_symbol, int(wide[-1]), len(self.docs), len(self.rules), len(self.symbols), len(self.marks))
        arrays = (self.docs.astype("<i8"), self.nulls.astype("<u1"), self.counts.astype("<i8"), self.marks.astype("<i8"), self.rules.astype("<u4"), self.expands.astype("<u4"), self.symbols.astype(wide))
        return b"".join((head, *(a.tobytes() for a in arrays)))

    @classmethod
    def loads(cls, data: bytes) -> Shard:
        magic, first, width, docs, rules, symbols, marks = struct.unpack_from("<8sIIQQQQ", data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize("<8sIIQQQQ")
        out = []
        for kind, n in (("<i8", docs), ("<u1", docs), ("<i8", docs), ("<i8", marks), ("<u4", 2 * rules), ("<u4", rules), (f"<u{width}", symbols)):
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
        d, z, c, m, r, e, s = out
        return cls(d, z.astype(bool), c, s, r.reshape(-1, 2), e.astype(np.int64), m, first)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Rules are undone from the last to the first used, all places of a generation at once."""
        seq = symbols.astype(np.int64)
        while len(on := np.flatnonzero(seq >= self.first_symbol)):
            width = np.ones(len(seq), np.int64)
            width[on] = 2
            heads = np.cumsum(width) - width
            pair = self.rules[seq[on] - self.first_symbol]
            seq = np.repeat(seq, width)
            seq[heads[on]], seq[heads[on] + 1] = pair[:, 0], pair[:, 1]
        return seq.astype(np.uint32)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids start to stop of the shard; only the symbols around them are expanded."""
        total = int(self.counts.sum())
        stop = total if stop is None else min(stop, total)
        if stop <= start:
            return np.zeros(0, np.uint32)
        k = int(np.searchsorted(self.marks, start, side="right")) - 1
        last = int(np.searchsorted(self.marks, stop)) * EVERY
        own = self.symbols[k * EVERY : last]
        return self.expand(own)[start - self.marks[k] : stop - self.marks[k]]


def write(docs: DataFrame, tokenizer: str, path: str, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """docs: doc_id long, text. Writes shards below path, and returns their list as a written table: (part, seq, file,
    n_docs, n_ids, start), start being the ids of all shards before. Only files that the list names count; a task that ran
    twice leaves a file that nothing names."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = in_worker(("ids", tokenizer), lambda: TextCoder(tokenizer))
        part, seq = TaskContext.get().partitionId(), 0
        first = coder.library.get_vocab_size()
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            own = [np.concatenate(x) for x in zip(*held, strict=True)]
            shard = Shard.build(*own, first, rule)
            file = f"{path}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids"
            write_file(file, shard.dumps())
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [file], "n_docs": [len(own[0])], "n_ids": [len(own[3])]})
            held.clear()
            seq += 1
            return out

        for batch in batches:
            for own in slices(batch, "text"):
                ids, places = coder.texts(own.column("text"))
                n = np.arange(own.num_rows)
                full = np.full(len(ids) + own.num_rows, rule.end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(n, np.diff(places))] = ids
                docs_of, nulls = own.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), own.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                held.append((docs_of, nulls, np.diff(places) + 1, full))
                if sum(len(h[3]) for h in held) >= rule.shard_ids:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows of one id are told apart by their place, so that many of them are several tasks
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(parts(spark), "doc_id", "place").sortWithinPartitions("doc_id", "place")
    listed = written(ranged.select("doc_id", "text").mapInArrow(tidied(run), "part int, seq int, file string, n_docs long, n_ids long"), "shards")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    before = listed.groupBy("part").agg(F.sum("n_ids").alias("t")).select("part", F.coalesce(F.sum("t").over(across), F.lit(0)).alias("before"))
    start = (F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start")
    return listed.join(F.broadcast(before), "part").select("part", "seq", "file", "n_docs", "n_ids", start)


def read(shards: DataFrame) -> DataFrame:
    """shards: file, start. (doc_id, start, n_tokens, ids): ids as packed little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard.loads(read_file(file))
                raw = shard.ids().astype("<u4").tobytes()
                ends = np.cumsum(shard.counts)
                data = [raw[4 * a : 4 * b] for a, b in zip(ends - shard.counts, ends, strict=True)]
                names = pa.array(shard.docs, mask=shard.nulls)
                yield pa.RecordBatch.from_arrays([names, pa.array(ends - shard.counts + start), pa.array(shard.counts), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    spread = shards.select("file", "start").repartition(parts(shards.sparkSession))
    return spread.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids binary")


def encode_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    return read(write(docs, tokenizer, path, rule))
