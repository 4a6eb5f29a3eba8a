"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece; a word's probability
is the sum over all ways to cut it into pieces, found by a forward pass over its characters. Piece probabilities come from
expectation-maximisation on a bounded sample of labelled texts. A text's score of a language is the mean log-probability of
its words, and the posterior over languages gives prediction and score.

A text that is null or has no letter is "und" with score 0. Words are lower-cased and split at white space, and scored whole:
long ones by a forward pass that keeps the last few characters' probabilities and their scale, however long they are. Equal
words, as their bytes tell, are scored once as long as they are remembered. Where nothing was learned, every prediction is
"und"; of languages that tie, the first by name is predicted. Repeated rows each have their prediction, an empty table none.
Columns of the input that have an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flattext import Numbers, Stretches, find_words, mix, slices, take_stretches, text_bytes, windows
from .sentencepieces import BLANK, NORMAL, Model
from .shared import small_batches, tidied

U = np.uint64
UNDETERMINED = "und"
SHORT, LONGEST, LIFT, UNSEEN, SEGMENT = 63, 16, 10.0, 1e-6, 4096
POINT = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Limits:
    """The bounded sample that the classifier is fitted on: different texts, as many per language as are expected from a
    rate by a hash of the text, and never more than `total` together, with which many languages have fewer each. Of a
    longer text, one stretch of so many characters, from a place that the hash gives. stretch: into how long parts the
    sample's words are cut at most."""

    texts: int = 300
    total: int = 60_000
    text_chars: int = 32 << 10
    stretch: int = 63
    rounds: int = 2


class Lattice:
    """All pieces in a set of words, as edges between their characters. From each character the walk goes on as long as
    some piece begins with what it has read."""

    SLOTS = 1 << 21

    def __init__(self, vocabulary: Sequence[str]) -> None:
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(vocabulary):
            if len(piece) <= LONGEST:
                by_length.setdefault(len(piece), []).append(i)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.begins: dict[int, np.ndarray] = {n: np.zeros(self.SLOTS, bool) for n in range(1, max(by_length) + 1)}
        for n, own in by_length.items():
            points = np.array([[ord(c) for c in vocabulary[i]] for i in own], U)
            h = np.zeros(len(own), U)
            for k in range(n):
                h = self._step(h, points[:, k], k)
                self.begins[k + 1][self._slot(h)] = True
            order = np.argsort(h)
            self.tables[n] = h[order], np.array(own, np.int64)[order]

    @staticmethod
    def _step(h: np.ndarray, point: np.ndarray, k: int) -> np.ndarray:
        return mix(h * U(POINT) + point + U(k + 1))

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h & U(self.SLOTS - 1)).astype(np.int64)

    def edges(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in words of the given lengths, ordered by end within the word. A
        character that is no piece has one edge with piece -1."""
        stops = np.repeat(np.cumsum(lengths), lengths)
        place = np.arange(len(points))
        single = np.full(len(points), -1)
        starts, sizes, pieces = [place], [np.ones(len(points), np.int64)], [single]
        at, h = place, np.zeros(len(points), U)
        for n, begins in self.begins.items():
            inside = at + n <= stops[at]
            at, h = at[inside], h[inside]
            h = self._step(h, points[at + n - 1], n - 1)
            on = begins[self._slot(h)]
            at, h = at[on], h[on]
            if n not in self.tables or not len(at):
                continue
            table, numbers = self.tables[n]
            found = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[found] == h
            if n == 1:
                single[at[hit]] = numbers[found[hit]]
                continue
            starts.append(at[hit])
            sizes.append(np.full(int(hit.sum()), n))
            pieces.append(numbers[found[hit]])
        at, size, piece = np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)
        heads = np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort((at - heads[at] + size).astype(np.uint16), kind="stable")
        return at[order], size[order], piece[order]


def word_points(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [BLANK + w for w in words]
    return np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(U), np.array([len(w) for w in marked], np.int64)


@dataclass
class Languages:
    names: list[str]
    pieces: list[str] = field(repr=False)
    probabilities: np.ndarray = field(repr=False)  # one more row than pieces: characters outside the vocabulary
    sharpness: float = 1.0

    def forward(self, lattice: Lattice, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Lifted probabilities of all prefixes: a row before each character, by language; and the edges."""
        starts, sizes, pieces = lattice.edges(points, lengths)
        weights = self.probabilities[pieces] * (LIFT ** sizes)[:, None]
        # node i stands before character i; a word's last node comes after its last character, so words are shifted
        heads = np.cumsum(lengths) - lengths
        shift = np.repeat(np.arange(len(lengths)), lengths)
        before = starts + shift[starts]
        after = before + sizes
        depth = starts - np.repeat(heads, lengths)[starts] + sizes
        alpha = np.zeros((len(points) + len(lengths), len(self.names)))
        alpha[heads + np.arange(len(lengths))] = 1
        cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            to, own = after[a:b], alpha[before[a:b]] * weights[a:b]
            order = np.argsort(to, kind="stable")
            to = to[order]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            alpha[to[first]] = np.add.reduceat(own[order], first, axis=0)
        return alpha, (before, after, sizes, pieces, weights, depth)

    def words(self, lattice: Lattice, words: Sequence[str]) -> np.ndarray:
        """Log-probabilities by language; words of at most SHORT characters, which need no scale."""
        if not words:
            return np.zeros((0, len(self.names)))
        points, lengths = word_points(words)
        alpha, _ = self.forward(lattice, points, lengths)
        ends = np.cumsum(lengths + 1) - 1
        return np.log(np.maximum(alpha[ends], 1e-300)) - lengths[:, None] * np.log(LIFT)

    def long_word(self, lattice: Lattice, word: str) -> np.ndarray:
        """The same of one word of any length, a segment at a time. From segment to segment go the probabilities of the
        last LONGEST prefixes, brought to a scale, and the scale's logarithm."""
        points, lengths = word_points([word])
        n, scale = int(lengths[0]), np.zeros(len(self.names))
        carried = np.ones((1, len(self.names)))  # of prefixes that end at most LONGEST before `done`, the last one at `done`
        done = 0
        while done < n:
            base, stop = done - len(carried) + 1, min(n, done + SEGMENT)
            starts, sizes, pieces = lattice.edges(points[base:stop], np.array([stop - base]))
            on = starts + sizes > done - base
            starts, sizes, pieces = starts[on], sizes[on], pieces[on]
            weights = self.probabilities[pieces] * (LIFT ** sizes)[:, None]
            alpha = np.zeros((stop - base + 1, len(self.names)))
            alpha[: len(carried)] = carried
            ends = starts + sizes
            cuts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1], True])
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                end = int(ends[a])
                alpha[end] = (alpha[starts[a:b]] * weights[a:b]).sum(axis=0)
                if k % LONGEST == LONGEST - 1:
                    low = max(0, end - LONGEST)
                    top = np.maximum(alpha[low : end + 1].max(axis=0), 1e-300)
                    alpha[low : end + 1] /= top
                    scale += np.log(top)
            carried, done = alpha[max(0, len(alpha) - LONGEST - 1) :], stop
        return np.log(np.maximum(carried[-1], 1e-300)) + scale - n * np.log(LIFT)

    def expected(self, lattice: Lattice, words: Sequence[str], counts: np.ndarray) -> np.ndarray:
        """Expected numbers of uses of each piece, by language, over all segmentations. counts: words by languages."""
        points, lengths = word_points(words)
        alpha, (before, after, _, pieces, weights, depth) = self.forward(lattice, points, lengths)
        ends = np.cumsum(lengths + 1) - 1
        beta = np.zeros_like(alpha)
        beta[ends] = counts / np.maximum(alpha[ends], 1e-300)
        remaining = ends[np.searchsorted(ends, after)] - before  # characters from the edge's start to the word's end
        order = np.argsort(remaining.astype(np.uint8), kind="stable")
        keys = remaining[order]
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            at = at[np.argsort(before[at], kind="stable")]
            first = np.flatnonzero(np.r_[True, before[at[1:]] != before[at[:-1]]])
            beta[before[at[first]]] += np.add.reduceat(beta[after[at]] * weights[at], first, axis=0)
        use = alpha[before] * weights * beta[after]
        n = len(self.probabilities)
        return np.stack([np.bincount(pieces % n, use[:, k], n) for k in range(use.shape[1])], axis=1)


def split_words(texts: Sequence[str], stretch: int) -> list[str]:
    """Lower-cased words of a sample, long ones in parts."""
    out: list[str] = []
    for text in texts:
        for word in text.lower().split():
            out += [word[i : i + stretch] for i in range(0, len(word), stretch)]
    return out


def fit(samples: dict[str, Sequence[str]], vocabulary: Sequence[str], limits: Limits = Limits()) -> Languages:  # noqa: B008
    """samples: texts by language. Starts from equal piece probabilities."""
    names = sorted(samples)
    rows: dict[str, int] = {}
    tallies = []
    for k, name in enumerate(names):
        for word in split_words(samples[name], limits.stretch):
            tallies.append((rows.setdefault(word, len(rows)), k))
    n = len(vocabulary)
    model = Languages(names, list(vocabulary), np.full((n + 1, len(names)), 1 / (n + 1)))
    if not rows:
        return model
    counts = np.zeros((len(rows), len(names)))
    at = np.array(tallies)
    np.add.at(counts, (at[:, 0], at[:, 1]), 1.0)
    lattice, words = Lattice(vocabulary), list(rows)
    for _ in range(limits.rounds):
        use = np.zeros_like(model.probabilities)
        for i in range(0, len(words), 8000):
            use += model.expected(lattice, words[i : i + 8000], counts[i : i + 8000])
        use /= np.maximum(use.sum(axis=0), 1e-300)
        model.probabilities = (use + UNSEEN) / (use + UNSEEN).sum(axis=0)
    return model


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file, lower-cased where that keeps their length."""
    model = Model.read(path)
    return list(dict.fromkeys(low for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL and len(low := p.lower()) == len(p)))


def stretch(text: str, draw: Column, limit: int) -> Column:
    """The text, or of a longer one a stretch of so many characters from a place that draw gives."""
    at = F.pmod(draw, F.greatest(F.length(text) - limit + 1, F.lit(1))).cast("int") + 1
    return F.substring(F.col(text), at, F.lit(limit))


def train(docs: DataFrame, path: str, limits: Limits = Limits()) -> Languages:  # noqa: B008
    """docs: text and lang of the training rows only. path: the vocabulary. The sample goes to the driver: limits bound its
    size, not the input; copies of a text are one text. Rows with null lang or text teach nothing."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(limits.total).collect()
    if not sizes:
        return fit({}, vocabulary(path), limits)
    each = min(limits.texts, max(1, limits.total // len(sizes)))
    hashed = F.xxhash64("text", F.lit(8))
    draw = F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = docs.sparkSession.createDataFrame([(r["lang"], each / r["n"]) for r in sizes], "lang string, rate double")
    chosen = docs.join(F.broadcast(rates), "lang").where(draw < F.col("rate"))  # at most `total` rows, as collected above
    chosen = chosen.select("lang", hashed.alias("h"), stretch("text", hashed, limits.text_chars).alias("text")).distinct()
    rows = chosen.orderBy("h", "lang").limit(2 * limits.total).toArrow()
    samples: dict[str, list[str]] = {r["lang"]: [] for r in sizes}
    for lang, text in zip(rows["lang"].to_pylist(), rows["text"].to_pylist(), strict=True):
        samples[lang].append(text)
    return fit(samples, vocabulary(path), limits)


class Scorer:
    """Mean log-probabilities of texts; remembers words until there are too many."""

    def __init__(self, model: Languages) -> None:
        self.model, self.lattice, self.units = model, Lattice(model.pieces), Stretches(20, 1 << 18)
        self._clear()

    def _clear(self) -> None:
        self.units.clear()
        self.known = Numbers(np.float32, len(self.model.names))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(mean log-probability by language, number of words) of lower-cased texts."""
        buf, places = text_bytes(column)
        starts, ends = find_words(buf, places)
        counts = np.diff(np.searchsorted(starts, places))
        sums = np.zeros((len(counts), len(self.model.names)))
        owner = np.repeat(np.arange(len(counts)), counts)
        for w in windows(starts, ends):
            if self.units.full:
                self._clear()
            numbers, fresh = self.units.numbers(buf, starts[w], ends[w])
            if len(fresh):
                self.known.add(self._scores(buf, starts[w][fresh], ends[w][fresh]))
            of, own = owner[w], self.known.all[numbers].astype(np.float64)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            sums[of[first]] += np.add.reduceat(own, first, axis=0)
        return sums / np.maximum(counts, 1)[:, None], counts

    def _scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw, sizes = take_stretches(buf, starts, ends - starts).tobytes(), np.r_[0, np.cumsum(ends - starts)]
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]
        values = np.zeros((len(words), len(self.model.names)))
        short = np.array([i for i, w in enumerate(words) if len(w) <= SHORT], np.int64)
        for i in range(0, len(short), 4000):
            values[short[i : i + 4000]] = self.model.words(self.lattice, [words[j] for j in short[i : i + 4000].tolist()])
        for i, word in enumerate(words):
            if len(word) > SHORT:
                values[i] = self.model.long_word(self.lattice, word)
        return values


def posterior(means: np.ndarray, counts: np.ndarray, sharpness: float) -> np.ndarray:
    """Languages are equally likely before; neighbouring words are not independent, so evidence grows with the root of
    their number."""
    z = means * (sharpness * np.sqrt(counts))[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def predict(df: DataFrame, model: Languages, text: str = "text", keep: Sequence[str] | None = None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and its posterior. One pass, no shuffle."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in (lang, score)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    small_batches(df.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(0).alias("none"))
    df = df.select(row.alias("row"), F.lower(text).alias("low"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model.names else None
        for batch in batches:
            for own in slices(batch, "low"):
                sure = own.column("letters").to_numpy(zero_copy_only=False)
                if scorer is None:
                    names, best = [UNDETERMINED] * own.num_rows, np.zeros(own.num_rows)
                else:
                    p = posterior(*scorer.texts(own.column("low")), model.sharpness)
                    at = p.argmax(axis=1)
                    names = [model.names[k] if ok else UNDETERMINED for k, ok in zip(at, sure, strict=True)]
                    best = np.where(sure, p[np.arange(len(at)), at], 0.0)
                held = own.column("row").flatten()[: len(kept)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(names, pa.string()), pa.array(best)], schema.names)

    return df.mapInArrow(tidied(run), schema)
