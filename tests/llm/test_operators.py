"""Operators of tallyspark.llm against libraries, brute force and exact round trips, on small inputs with odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyspark.llm import compression, embeddings, jaccard, katz, langid, media, mixing, sentencepieces, tokenids, warc
from tallyspark.llm.components import components
from tallyspark.llm.shared import new_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "   a  b\nc\t d ", "a▁b ▁▁ c", "日本語🙂 ok", "\x00a<s></s><0x0A>", "a" * 3000, " " * 77 + "x" + " " * 33, "\n\n\n", "don't  stop ", "x 　 y z", "é " * 50]
WORDS = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("etaoinshr", k=r.randint(1, 6))) for _ in range(n))


def docs(spark, texts, **extra):
    rows = [(i, t, *(v[i] for v in extra.values())) for i, t in enumerate(texts)]
    names = ", ".join(["doc_id long", "text string", *(f"{k} string" for k in extra)])
    return spark.createDataFrame(rows, names)


def test_sentencepiece(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(1)
    texts = ODD + ["".join(r.choices("  aabcde.,\n\t!é日🙂▁01<>/", k=r.randrange(80))) for _ in range(300)]
    rows = sentencepieces.encode(docs(spark, texts), PIECES, decoded="back", keep=["doc_id"]).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = library.encode(texts[row["doc_id"]] or "")
        assert row["ids"] == want and row["back"] == library.decode(want)
    ids = spark.createDataFrame([(1, [3, 200, 250, 29871, 1, 0]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {x["doc_id"]: x["decoded"] for x in sentencepieces.decode(ids, PIECES).collect()}
    assert got == {1: library.decode([3, 200, 250, 29871, 1, 0]), 2: "", 3: None}
    replaced = sentencepieces.encode(docs(spark, ["a"], ids=["x"], kept0=["y"]), PIECES).head()
    assert replaced.asDict() == {"doc_id": 0, "text": "a", "kept0": "y", "ids": library.encode("a")}
    assert sentencepieces.encode(docs(spark, ["a"]).limit(0), PIECES).count() == 0


def test_token_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    texts = ODD + [prose(i, 200) for i in range(20)] + ["ab " * 500] * 3
    rule = tokenids.Rule(shard_ids=2000, least=4)
    rows = tokenids.encode_and_read(spark, docs(spark, texts), BYTE_BPE, new_path(spark, "ids"), rule).orderBy("doc_id").collect()
    start = 0
    for row, text in zip(rows, texts, strict=True):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row["start"], row["n_tokens"]) == (start, len(want)) and bytes(row["ids"]) == np.array(want, "<u4").tobytes()
        start += len(want)


@pytest.mark.parametrize("seed", range(4))
def test_grammar(seed):
    r = np.random.default_rng(seed)
    ids = np.concatenate([r.zipf(1.4, 5000) % 50, np.full(101, 7), np.tile([1, 2, 3], 300)]).astype(np.uint32)
    shard = tokenids.Shard.build(np.arange(2), np.array([False, True]), np.array([100, len(ids) - 100]), ids, 50, tokenids.Rule(least=4))
    back = tokenids.Shard.loads(shard.dumps())
    assert len(shard.symbols) < len(ids) and (back.ids() == ids).all()
    for a, b in ((0, 1), (5, 5), (99, 4242), (len(ids) - 3, len(ids) + 9)):
        assert (back.ids(a, b) == ids[a:b]).all()
    assert len(tokenids.Shard.build(np.zeros(0, int), np.zeros(0, bool), np.zeros(0, int), ids[:0], 50, tokenids.Rule()).ids()) == 0


def test_joined_stretches():
    """Stretches encoded joined give the library's ids, also beside white space, special tokens and over block ends."""
    coder, rng = tokenids.TextCoder(BYTE_BPE), random.Random(5)
    some = [*"ab  \t\n\r'sl129.,<|>é中\u3000\xa0\u2003\x85\x1f😀", " the", " <|endoftext|>", "<|endoftext|>", "  "]
    texts = ["", " ", " a", " ".join(f"w{i}" for i in range(20000))] + ["".join(rng.choices(some, k=rng.randrange(60))) for _ in range(3000)]
    ids, places = coder.texts(pa.array(texts))
    own = [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:], strict=True)]
    assert own == [coder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_media(spark):
    for n in (0, 1, 64, 65, 64 * 256, 64 * 257, 64 * 700 + 3):
        payload = media.padded(bytes(i % 251 for i in range(n)))
        data = media.pack(payload)
        (track,) = media.read(data)
        assert media.samples(data, track) == payload and track.codec == "raw " and track.seconds == len(payload) / 64 / 25
        assert [data[o : o + w] for o, w in track.key_ranges.tolist()] == [payload[k * 64 : k * 64 + 64] for k in track.keyframes]
    rows = media.store(docs(spark, ODD)).collect()
    for row in rows:
        assert bytes(row["payload"]) == media.padded((ODD[row["doc_id"]] or "").encode())
    broken = spark.createDataFrame([(1, None), (2, b"junk"), (3, bytes(rows[3]["media"])[:-70])], "id int, media binary")
    assert [r["codec"] for r in media.index(broken).orderBy("id").collect()] == [None, None, "raw "]
    with pytest.raises(media.BrokenMedia):
        media.read(bytes(rows[3]["media"])[:100])


def test_warc(spark):
    page = "<p>" + "x" * 2000
    payloads = [None, "", "small", "small", page, page, page, "é" * 400, page + "y", "a\r\n\r\nb"]
    rows = spark.createDataFrame([(f"urn:page:{i}", i, f"http://h/{i}", p) for i, p in enumerate(payloads)], "record_id string, order long, target_uri string, payload string")
    path = new_path(spark, "warc")
    warc.write(warc.with_revisits(rows.withColumn("payload", rows["payload"].cast("binary"))), path)
    back = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    assert len(back) == len(payloads)
    for i, p in enumerate(payloads):
        row, raw = back[f"urn:page:{i}"], (p or "").encode()
        revisit = i in (4, 5)
        assert row["record_type"] == ("revisit" if revisit else "response") and row["refers_to"] == ("urn:page:6" if revisit else None)
        assert row["payload_digest"] == hashlib.sha1(raw).hexdigest() and row["payload_bytes"] == len(raw)
        assert row["payload"] is None if revisit else bytes(row["payload"]) == raw
    assert warc.read(spark, path).where("record_type = 'revisit'").count() == 2
    assert warc.read(spark, path, payload=False).where("payload is not null").count() == 0
    assert warc.read(spark, path).where("target_uri in ('http://h/1', 'http://h/9')").count() == 2


def test_jaccard_bitmaps():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 400, 3000):
        pool = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
        for share in (0.5, 0.8, 0.95, 1.0):
            one, other = (np.sort(rng.choice(pool[: max(1, int(n / share))], min(n, len(pool)), replace=False)) if n > 1 else pool[:1] for _ in range(2))
            if share == 0.95:
                other = other[: max(1, int(len(other) * 0.8))]
            packed = [jaccard.pack_set(x) for x in (one, other)]
            assert (jaccard.unpack_set(packed[0]) == one >> np.uint64(16)).all()
            shared = len(np.intersect1d(one, other))
            really = 100 * shared >= 75 * (len(one) + len(other) - shared)
            assert jaccard.linked(*packed, 75) == really
            near = jaccard.may_link(jaccard.parities(one), jaccard.parities(other), len(one), len(other), 75)
            assert near or not really
    apart = [np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64)) for _ in range(2)]
    assert not jaccard.may_link(*map(jaccard.parities, apart), 500, 500, 75)


def test_jaccard(spark):
    base = prose(1, 400)
    texts = [None, "", "One two three", "one TWO three", "one two", base, base, base.upper()]
    for i in range(60):
        w = base.split()
        for k in random.Random(i).sample(range(len(w)), i % 12):
            w[k] = f"w{i}x{k}"
        texts.append(" ".join(w))
    texts += [prose(100 + i, 80) + " " + base[:300] for i in range(20)]
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    rows = jaccard.similarity_classes(docs(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == {i: (len(sets[i]), root(i)) for i in range(len(texts))}
    assert jaccard.similarity_classes(docs(spark, ["a"]).limit(0)).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(0)
    near = r.normal(size=16)
    v = [r.normal(size=16).tolist() for _ in range(150)] + [(near + r.normal(size=16) * 0.06).tolist() for _ in range(60)]
    v += [v[0], [2 * x for x in v[0]], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, []]
    label = [i % 2 for i in range(150)] + [1] * 60 + [0, 0, 0, 0, 0, 0, 0]
    label[3] = None
    df = spark.createDataFrame(list(zip(range(len(v)), label, v, strict=True)), "vec_id long, label int, embedding array<double>")
    ok = [bool(x) and None not in x and all(map(math.isfinite, x)) and any(x) and label[i] is not None for i, x in enumerate(v)]
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in enumerate(v) if ok[i]}
    links = defaultdict(set)
    for a in unit:
        for b in unit:
            if a != b and label[a] == label[b] and unit[a] @ unit[b] >= 0.98:
                links[a].add(b)
    for block in (1000, 25):
        rows = {x["vec_id"]: x for x in embeddings.near_duplicates(df, embeddings.Rule(block=block)).collect()}
        assert len(rows) == len(v)
        found = sum(x["n_links"] for x in rows.values())
        assert all(rows[i]["n_links"] <= len(links[i]) for i in range(len(v)))
        assert found >= 0.99 * sum(map(len, links.values())) and rows[0]["n_links"] == 2 and rows[150 + 61]["component_id"] == 0


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(30)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 1)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert sorted((x["node"], x["component"]) for x in rows) == sorted((n, root(n)) for n in parent)


def test_language():
    vocabulary = langid.vocabulary(PIECES)
    texts = {"en": ["the cat and the other thing went there"] * 3, "de": ["der hund und die andere sache gingen dahin"] * 3}
    model = langid.fit(texts, vocabulary)
    assert np.allclose(model.probabilities.sum(axis=0), 1)
    lattice, index = langid.Lattice(model.pieces), {p: i for i, p in enumerate(model.pieces)}
    words = ["the", "sachen", "été", "日x", "a" * 60]
    for k in range(2):
        for word, got in zip(words, model.words(lattice, words)[:, k], strict=True):
            s = "▁" + word
            alpha = [1.0] + [0.0] * len(s)
            for j in range(1, len(s) + 1):
                for i in range(max(0, j - 16), j):
                    p = index.get(s[i:j], -1 if j - i == 1 else None)
                    alpha[j] += 0 if p is None else alpha[i] * model.probabilities[p, k]
            assert math.isclose(got, math.log(alpha[-1]), rel_tol=1e-9)


def test_language_predictions(spark):
    model = langid.fit({"en": ["the cat and the other thing"], "de": ["der hund und die andere sache"]}, langid.vocabulary(PIECES))
    texts = ["the other cat", "die andere", None, "", "12 34", "x" * 500]
    rows = {r["doc_id"]: r for r in langid.predict(docs(spark, texts), model).collect()}
    assert [rows[i]["lang_pred"] for i in range(5)] == ["en", "de", "und", "und", "und"] and rows[5]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    nothing = langid.train(docs(spark, ["a"], lang=[None]), PIECES)
    assert langid.predict(docs(spark, ["abc"]), nothing).head()["lang_pred"] == "und"


def test_quality(spark):
    good = [prose(i, 150) for i in range(120)]
    bad = ["BUY NOW!!! " * 40 + str(i) for i in range(120)]
    frame = docs(spark, [*good, *bad, None, "", "x" * 100_000])
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)], "doc_id long, quality int")
    model = compression.train(frame, labels.where("doc_id % 3 <> 1"))
    rows = {r["doc_id"]: r["score"] for r in compression.score(frame, model).collect()}
    held = [i for i in range(240) if i % 3 == 1]
    assert sum((rows[i] >= 0.5) == (i < 120) for i in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in rows.values()) and len(rows) == 243
    blank = compression.train(frame, labels.limit(0))
    assert {r["score"] for r in compression.score(frame, blank).collect()} == {0.5}


def test_mixing(spark):
    plan = mixing.solve([1000.0, 10.0, 10.0, 0.0], mixing.Rule(entropy=0.8, repetition=1e9))
    assert math.isclose(mixing.entropy(plan.weights), 0.8 * math.log(3), rel_tol=1e-9) and math.isclose(sum(plan.weights), 1)
    limited = mixing.solve([1000.0, 10.0, 10.0], mixing.Rule(entropy=1.0, repetition=3.0))
    assert 2.99 < max(limited.passes) <= 3.0 and math.isclose(min(limited.passes), 1.0)
    texts = [prose(i, 20) for i in range(400)] + [None, ""]
    sources = ["big"] * 350 + ["a"] * 30 + [None] * 20 + ["a", "a"]
    rule = mixing.Rule(entropy=0.9, repetition=5.0, block_tokens=300)
    rows = mixing.mix(docs(spark, texts, source=sources), rule).collect()
    assert {r["doc_id"] for r in rows} == set(range(402))
    tokens = Counter()
    for r in rows:
        tokens[r["source"]] += r["mix_tokens"]
    weights = {r["source"]: r["mix_weight"] for r in rows}
    for s, w in weights.items():
        assert abs(tokens[s] / sum(tokens.values()) - w) < 0.01
    assert mixing.mix(docs(spark, ["a"], source=["b"]).limit(0)).count() == 0


def test_katz(spark):
    texts = [prose(i % 40, 60) for i in range(60)] + [None, "", "Unseen words here", "x" * 5000]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))]
    frame = spark.createDataFrame(list(zip(range(len(texts)), texts, held, strict=True)), "doc_id long, text string, held_out boolean")
    rows = {r["doc_id"]: r for r in katz.fit(frame).scores.collect()}
    tokens = [[*WORDS.findall((t or "").translate(LOW)), "</e>"] for t in texts]
    one, two = Counter(), Counter()
    for t, out in zip(tokens, held, strict=True):
        if not out:
            one.update(t)
            two.update(zip(["<b>", *t], t, strict=False))
    n, v = sum(one.values()), len(one)
    bins = [np.bincount([min(c, 7) for c in x.values()], minlength=8) for x in (one, two)]
    f1, f2 = map(katz.discounts, bins)
    cut = lambda c, f: c * (f[c] if c <= 5 else 1)
    unknown = 1 - sum(cut(c, f1) for c in one.values()) / n
    p = lambda w: cut(one[w], f1) / n if one[w] else unknown
    mass, follow = defaultdict(float), defaultdict(float)
    for (a, b), c in two.items():
        mass[a] += cut(c, f2)
        follow[a] += p(b)
    context = dict(one) | {"<b>": one["</e>"]}

    def probability(a, b):
        if two[a, b]:
            return cut(two[a, b], f2) / (context[a] + 1)
        return p(b) * ((1 - mass[a] / (context[a] + 1)) / (1 - follow[a]) if a in context else 1)

    for a in ("<b>", tokens[0][0]):
        assert math.isclose(sum(probability(a, w) for w in [*one, "never"]), 1, rel_tol=1e-9)
    for i, t in enumerate(tokens):
        row = rows[i]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(t), sum(one[w] > 0 for w in t), n)
        assert math.isclose(row["base_score"], sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(row["score"], sum(math.log10(probability(a, b)) for a, b in zip(["<b>", *t], t, strict=False)), rel_tol=1e-8)


def test_packed_arrays():
    r = np.random.default_rng(2)
    h = np.unique(r.integers(0, 2**63, 1000).astype(np.uint64))
    assert (katz.unpack_sorted(katz.pack_sorted(h)) == h).all() and len(katz.unpack(katz.pack(h[:0]), np.uint64)) == 0
