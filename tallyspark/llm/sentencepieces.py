"""SentencePiece BPE models: encoding and decoding by vectorised merge rounds.

Encoding works on the flat array of all symbols of a batch. No piece has a blank after another character, so merging
never crosses the beginning of a run of blanks, and the text falls apart into units that are encoded on their own; equal
units, as their bytes tell, are encoded once as long as they are remembered. In each round the best-ranked pair of each unit is found by a segmented minimum, all its occurrences from the
left are merged at once, and the arrays are compacted; units without a pair left drop out. Where merging could give rise
to a pair that ranks as high or higher, only the leftmost occurrence is merged in that round, as one after the other
would do. Characters that no piece covers become byte pieces.

Nulls and empty texts have no ids. Invalid UTF-8 is read as U+FFFD. A text is never cut: units are as long as they are.
Repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flattext import Numbers, Stretches, slices, spread, take_stretches, text_bytes, windows
from .shared import in_worker, small_batches, tidied

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protobuf message; fixed32 values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What the rounds need of a model file."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    dummy_prefix: bool

    @classmethod
    def read(cls, path: str) -> Model:
        """Only BPE models with the identity normaliser that keep blanks; others raise ValueError."""
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, bpe, prefix, plain = [], [], [], False, True, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(np.frombuffer(own.get(2, bytes(4)), "<f4")[0])
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                own = dict(_fields(value))
                prefix = bool(own.get(3, 1))
                plain = not own.get(2) and not own.get(4, 1) and bool(own.get(5, 1))
        if not bpe or not plain or UNUSED in kinds or USER in kinds:
            raise ValueError("only plain BPE models are supported")
        return cls(pieces, np.array(scores, np.float64), np.array(kinds), prefix)


class Encoder:
    def __init__(self, model: Model) -> None:
        self.model = model
        names = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        if any(BLANK in p.lstrip(BLANK) for p in names):
            raise ValueError("a piece has a blank after another character")
        self.unknown = int(np.flatnonzero(model.kinds == UNKNOWN)[0])
        self.bytes = np.full(256, self.unknown, np.int32)
        for i in np.flatnonzero(model.kinds == BYTE):
            self.bytes[int(model.pieces[i][3:5], 16)] = i
        # equal scores share a rank: the leftmost pair goes first
        ranks = np.unique(-model.scores, return_inverse=True)[1].astype(np.int32)
        keys, merged = [], []
        for piece, i in names.items():
            for cut in range(1, len(piece)):
                a, b = names.get(piece[:cut], -1), names.get(piece[cut:], -1)
                if a >= 0 and b >= 0:
                    keys.append((a << 32) | b)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        self.ranks = ranks[self.merged]
        # a rank is alone if no pair with one of its pieces ranks as high
        left, right = (self.keys >> 32).astype(np.int64), (self.keys & 0xFFFFFFFF).astype(np.int64)
        best = np.full(len(model.pieces), NONE, np.int32)
        np.minimum.at(best, left, self.ranks)
        np.minimum.at(best, right, self.ranks)
        crossed = best[self.merged] <= self.ranks
        self.alone = np.ones(int(ranks.max()) + 1, bool)
        self.alone[self.ranks[crossed]] = False
        single = [(ord(p), i) for p, i in names.items() if len(p) == 1]
        self.chars = np.full(0x110000, -1, np.int32)
        self.chars[[c for c, _ in single]] = [i for _, i in single]
        self.known = Known(self.units)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; NONE where they don't merge."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def merge(self, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of units one after another, each of one at least, to their pieces and numbers of pieces. Negative
        symbols never merge."""
        unit = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        names = np.arange(len(lengths))
        done_sym: list[np.ndarray] = []
        done_unit: list[np.ndarray] = []
        rank, merged = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        rank[:-1], merged[:-1] = self.pair(sym[:-1], sym[1:])
        rank[:-1][unit[1:] != unit[:-1]] = NONE
        while len(sym):
            begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            size = np.diff(np.r_[begin, len(sym)])
            low = np.minimum.reduceat(rank, begin)
            ended = low == NONE
            if ended.any():
                out = np.repeat(ended, size)
                done_sym.append(sym[out])
                done_unit.append(np.repeat(names[ended], size[ended]))
                keep = ~out
                sym, rank, merged, names, low, size = sym[keep], rank[keep], merged[keep], names[~ended], low[~ended], size[~ended]
                unit = np.repeat(np.arange(len(names), dtype=np.int32), size)
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            # of overlapping occurrences every second goes, from the left; of those that must go singly, the first
            fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (unit[at[1:]] != unit[at[:-1]])]
            run = np.flatnonzero(fresh)
            odd = (at - np.repeat(at[run], np.diff(np.r_[run, len(at)]))) & 1
            owner = unit[at]
            first = np.r_[True, owner[1:] != owner[:-1]]
            at = at[np.where(self.alone[low[owner]], odd == 0, first)]
            sym[at] = merged[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, rank, merged, unit = sym[keep], rank[keep], merged[keep], unit[keep]
            at = moved[at]
            changed = np.zeros(len(sym) + 1, bool)
            changed[at] = changed[at - 1] = True  # -1 falls on the spare place at the end
            touched = np.flatnonzero(changed[:-1])
            inner = touched[touched < len(sym) - 1]
            r, m = self.pair(sym[inner], sym[inner + 1])
            rank[touched] = NONE
            rank[inner], merged[inner] = np.where(unit[inner] == unit[inner + 1], r, NONE), m
        if not done_sym:
            return sym, np.zeros(len(lengths), np.int64)
        units, syms = np.concatenate(done_unit), np.concatenate(done_sym)
        order = np.argsort(units, kind="stable")
        return syms[order], np.bincount(units, minlength=len(lengths))

    def units(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of units of valid UTF-8 in which blanks are 0x20, and their numbers of ids."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        leads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        ends = np.cumsum(lengths)
        sizes = leads[ends] - leads[ends - lengths]
        points[points == 32] = ord(BLANK)
        sym = self.chars[points]
        odd = sym < 0
        sym[odd] = -1 - points[odd].astype(np.int32)
        sym, counts = self.merge(sym, sizes)
        if not odd.any():
            return sym, counts
        # byte pieces for what is left of characters without a piece
        where = np.flatnonzero(sym < 0)
        coded = "".join(map(chr, -1 - sym[where])).encode()
        raw = np.frombuffer(coded, np.uint8)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        widths = np.ones(len(sym), np.int64)
        widths[where] = np.diff(np.r_[heads, len(raw)])
        out = np.repeat(sym, widths)
        out[out < 0] = self.bytes[raw]
        bounds = np.r_[0, np.cumsum(counts)]
        total = np.r_[0, np.cumsum(widths)]
        return out, np.diff(total[bounds])

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and the n + 1 places of the texts in them."""
        buf, places = prepared(column, self.model.dummy_prefix)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(places), np.int64)
        blank = buf == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[places[:-1][np.diff(places) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.r_[starts[1:], len(buf)]
        out, counts = self.known.ids(buf, starts, ends)
        return out, np.r_[0, np.cumsum(counts)][np.searchsorted(starts, places)]


class Known:
    """Ids of stretches that were encoded before. encode: ids of stretches one after another, from their bytes and sizes,
    and their numbers of ids. What is held is bounded; when it is full, it begins anew, which costs time only."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode, self.units = encode, Stretches()
        self._clear()

    def _clear(self) -> None:
        self.units.clear()
        self.starts, self.counts, self.flat = Numbers(np.int64), Numbers(np.int64), Numbers(np.int32)

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the stretches one after another, and their numbers of ids; a window at a time. starts and ends ascend."""
        counts, out = np.zeros(len(starts), np.int64), Numbers(np.int32)
        for w in windows(starts, ends):
            if self.units.full or self.flat.n > 4 * self.units.limit:
                self._clear()
            a, b = starts[w], ends[w]
            numbers, fresh = self.units.numbers(buf, a, b)
            if len(fresh):
                sizes = b[fresh] - a[fresh]
                ids, own = self.encode(take_stretches(buf, a[fresh], sizes), sizes)
                self.starts.add(self.flat.n + np.cumsum(own) - own)
                self.counts.add(own)
                self.flat.add(ids)
            counts[w] = self.counts.all[numbers]
            out.add(take_stretches(self.flat.all, self.starts.all[numbers], counts[w]))
        return out.all, counts


def prepared(column: pa.Array, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of valid UTF-8 with the blank symbol as 0x20, and one blank before each text that isn't empty."""
    buf, places = text_bytes(column)
    raw = buf.tobytes()
    symbol = BLANK.encode()
    try:
        raw.decode()
        clean = symbol not in raw
    except UnicodeDecodeError:
        clean = False
    if not clean:
        texts = [raw[a:b].decode("utf-8", "replace").encode().replace(symbol, b" ") for a, b in zip(places[:-1], places[1:], strict=True)]
        buf, places = text_bytes(pa.array(texts, pa.large_binary()))
    if prefix:
        full = np.diff(places) > 0
        buf = np.insert(buf, places[:-1][full], 32)
        places = places + np.r_[0, np.cumsum(full)]
    return buf, places


class Decoder:
    def __init__(self, model: Model) -> None:
        surfaces = []
        for piece, kind in zip(model.pieces, model.kinds, strict=True):
            if kind == CONTROL:
                surfaces.append(b"")
            elif kind == BYTE:
                surfaces.append(bytes([int(piece[3:5], 16)]))
            else:
                surfaces.append(" ⁇ ".encode() if kind == UNKNOWN else piece.replace(BLANK, " ").encode())
        self.lengths = np.array([len(s) for s in surfaces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(surfaces), np.uint8)
        self.control = model.kinds == CONTROL
        self.leads = np.array([p.startswith(BLANK) for p in model.pieces]) if model.dummy_prefix else np.zeros(len(surfaces), bool)

    def texts(self, ids: np.ndarray, places: np.ndarray) -> pa.Array:
        """The texts, as strings. Byte pieces that are no UTF-8 give U+FFFD for each byte."""
        lengths = self.lengths[ids]
        seen = np.r_[0, np.cumsum(~self.control[ids])]
        # the first piece that isn't a control one loses its blank
        n = len(ids)
        first = np.searchsorted(seen, seen[places[:-1]] + 1) - 1
        has = (first < places[1:]) & (first < n) & (np.diff(places) > 0)
        drop = first[has][self.leads[ids[first[has]]]]
        starts = self.starts[ids]
        lengths[drop] -= 1
        starts[drop] += 1
        out = take_stretches(self.data, starts, lengths)
        ends = np.r_[0, np.cumsum(lengths)][places]
        raw = out.tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            import codecs

            codecs.register_error("each_byte", lambda e: ("�", e.start + 1))
            return pa.array([raw[a:b].decode("utf-8", "each_byte") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.large_string()).cast(pa.string())


def coders(path: str) -> tuple[Encoder, Decoder]:
    model = Model.read(path)
    return Encoder(model), Decoder(model)


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """df with an array<int> column ids, without begin or end ids, and, if a name is given, the text that the ids decode
    to. model_path: a file that all executors have. keep: the columns of df to return, all by default; one that has an
    output's name is replaced. A row in gives a row out, in one pass without a shuffle."""
    new = [ids] + ([decoded] if decoded else [])
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    small_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = in_worker(("pieces", model_path), lambda: coders(model_path))
        for batch in batches:
            for own in slices(batch, 0):
                flat, places = encoder.texts(own.column(0))
                columns = [*own.columns[1:], pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:
                    columns.append(decoder.texts(flat, places))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(F.col(f"`{text}`"), *(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(kept))).mapInArrow(tidied(run), schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of its ids; null ids give null. An id outside the model fails. A column of df that has the output's
    name is replaced."""
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = in_worker(("pieces", model_path), lambda: coders(model_path))
        for batch in batches:
            column = batch.column(0)
            sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
            texts = decoder.texts(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(sizes)])
            if column.null_count:
                texts = pa.compute.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], schema.names)

    return df.select(F.col(f"`{ids}`"), *(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(kept))).mapInArrow(tidied(run), schema)


__all__ = ["Decoder", "Encoder", "Model", "decode", "encode", "spread"]
