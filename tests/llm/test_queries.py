"""The registered queries and the pipeline on small tables: against libraries and plain versions, with odd rows, and empty."""

import hashlib
import importlib
import math
import random
import zlib

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyspark.llm import compression, langid, mixing, queries, registry

SMALL = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op2_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_mixing": "doc_id bigint, source string, mix_tokens bigint, mix_weight double, mix_pass int, mix_block bigint, mix_key double",
    "op7_token_ids": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_katz_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def inverse(word):
    return word.translate(str.maketrans("ab", "ba"))


SAME_HASH = [w for n in (1024, 2048, 4096) for w in (thue_morse(n), inverse(thue_morse(n)))]
BASE = " ".join(f"word{i % 37} number{i}" for i in range(60))
TEXTS = [
    None, "", " ", "\n\t ", "a", "One two THREE", "one two three", "12 34 !!", *SAME_HASH, f"{SAME_HASH[2]} b c d e f", f"{SAME_HASH[3]} b c d e f",
    BASE, BASE, BASE.upper(), BASE + " and", BASE[: len(BASE) // 2], "日本語のテキスト 🙂 <|endoftext|> don't we'll", "the cat\r\n  and the dog ▁▁ x\x00y", "x" * 30_000, "é, ß. " * 400,
    *(" ".join(random.Random(i).choices(["der", "hund", "und", "die", "katze", "sind", "groß"] if i % 2 else ["the", "dog", "and", "cat", "are", "large"], k=60)) for i in range(40)),
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Tables with odd rows, repeated ids, repeated rows, and columns that have an output's name."""
    folder = tmp_path_factory.mktemp("odd")
    n = len(TEXTS)
    ids = [None, *range(1, n - 2), 1, -(2**63)]
    source = [None if i % 9 == 0 else "big" if i % 3 else f"s{i % 4}" for i in range(n)]
    lang = [None if i % 11 == 0 else "de" if i % 2 else "en" for i in range(n)]
    clash = {name: pa.array(["x"] * n) for name in ("score", "ids", "mix_pass", "row", "media", "component_id")}
    docs = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(TEXTS), "lang": pa.array(lang), "source": pa.array(source), "n_chars": pa.array([len(t or "") for t in TEXTS])}
    pq.write_table(pa.table(docs | clash), folder / "documents.parquet", row_group_size=20)
    own = [i for i in range(1, n - 2)]
    pq.write_table(pa.table({"doc_id": pa.array([*own, 5, None], pa.int64()), "quality": pa.array([*(i % 2 for i in own), 0, 1], pa.int32()), "toxic": pa.array([0] * (len(own) + 2), pa.int32())}), folder / "labels.parquet")
    r = np.random.default_rng(1)
    v = [r.normal(size=8).tolist() for _ in range(60)]
    v += [v[0], v[0], [x * 3 for x in v[1]], None, [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [None] * 8, [], v[2], v[2][:7], v[3]]
    names = [*range(60), 0, 100, 101, 102, 103, 104, 105, 106, 107, None, 108, None]
    label = [i % 3 for i in range(60)] + [0, 0, 1, 0, 0, 0, 0, 0, 0, 2, 2, None]
    pq.write_table(pa.table({"vec_id": pa.array(names, pa.int64()), "embedding": pa.array(v, pa.list_(pa.float32())), "label": pa.array(label, pa.int32()), "n_links": pa.array([7] * len(v))}), folder / "embeddings.parquet")
    page = "<p>" + "x" * 1500
    html = [None, "", "small", page, page, page, page + "é", "a\r\n\r\nb", page + "é", "y" * 999, "y" * 999, "z" * 200_000]
    urls = ["http://h/1", None, "", "http://h/a b", "http://h/\r\nWARC-Type: revisit\r\n\r\n", "http://h/%0D%0A", " http://h/ ", "http://h/é", "x", "y", "z", "http://h/9"]
    page_id = [None, 1, 2, 3, 9, 5, 6, 7, 8, 10, 11, -4]
    pq.write_table(pa.table({"page_id": pa.array(page_id, pa.int64()), "url": pa.array(urls), "html": pa.array(html), "payload_digest": pa.array(["x"] * 12)}), folder / "pages.parquet")
    return str(folder)


def rows_of(folder, table, *columns):
    return list(zip(*(pq.read_table(f"{folder}/{table}.parquet")[c].to_pylist() for c in columns), strict=True))


def collected(spark, name, folder):
    """The contract's columns of all rows, in an order of their own."""
    df = registry.queries()[name](spark, folder)
    columns = [c.split() for c in CONTRACT[name].split(", ")]
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c, _ in columns} == dict(columns), name
    return sorted(map(tuple, df.select(*(c for c, _ in columns)).collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


def test_all_queries_have_a_contract():
    assert set(CONTRACT) == set(registry.queries())


@pytest.mark.parametrize("name", CONTRACT)
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "labels", "embeddings", "pages"):
        pq.write_table(pq.read_table(f"{SMALL}/{table}.parquet").slice(0, 0), tmp_path / f"{table}.parquet")
    assert collected(spark, name, str(tmp_path)) == []


def test_warc(spark, odd):
    pages = rows_of(odd, "pages", "page_id", "url", "html")
    keeper = {}
    for i, _, h in pages:
        if h and len(h.encode()) >= 1000:
            keeper[h] = max(keeper.get(h, -(2**63)), i)
    want = []
    for i, _, h in pages:
        raw, first = (h or "").encode(), keeper.get(h, i)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    assert collected(spark, "op1_warc", odd) == ordered(want)
    assert ordered(r["target_uri"] for r in queries.op1_warc(spark, odd).collect()) == ordered(u for _, u, _ in pages)


def test_sentencepiece(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    want = []
    for i, t in rows_of(odd, "documents", "doc_id", "text"):
        ids = library.encode(t or "")
        want.append((i, len(ids), brute.sha256(",".join(map(str, ids)).encode()), brute.sha256(library.decode(ids).encode())))
    assert collected(spark, "op2_sentencepiece", odd) == ordered(want)


@pytest.mark.parametrize("broadcast", [True, False])
def test_jaccard(spark, odd, broadcast):
    from tallyspark.llm import jaccard

    want = ordered(brute.similar(rows_of(odd, "documents", "doc_id", "text")))
    if broadcast:
        assert collected(spark, "op3_ngram_jaccard", odd) == want
    else:  # both sides are dealt out, and blocks are small
        docs = spark.read.parquet(f"{odd}/documents.parquet")
        rule = jaccard.Rule(broadcast_rows=0, block_grams=50, block_rows=2)
        assert ordered(map(tuple, jaccard.similarity_classes(docs, rule).collect())) == want


def test_jaccard_of_a_group_that_does_not_link(spark):
    """Copies of one text with so many edits each that some link with the text and few with each other."""
    from tallyspark.llm import jaccard

    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(120):
        w, r = list(base), random.Random(i)
        for k in r.sample(range(150), 2 + i % 14):
            w[k] = f"e{i}x{k}"
        texts.append(" ".join(w))
    for own in (texts, [*texts, " ".join(base)]):
        docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
        want = ordered(brute.similar(list(enumerate(own))))
        for rule in (jaccard.Rule(), jaccard.Rule(block_grams=2000, block_rows=7, hot_share=1e-9)):
            assert ordered(map(tuple, jaccard.similarity_classes(docs, rule).collect())) == want


def test_embeddings(spark, odd):
    assert collected(spark, "op4_embedding_near_dedup", odd) == ordered(brute.near_vectors(rows_of(odd, "embeddings", "vec_id", "label", "embedding")))


def test_media(spark, odd):
    got = collected(spark, "op5_media_columns", odd)
    want, by_payload = [], {}
    for i, t in rows_of(odd, "documents", "doc_id", "text"):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((i, len(raw), len(payload), brute.sha256(payload), zlib.crc32(payload[-64:])))
    assert ordered(r[:5] for r in got) == ordered(want)
    for r in got:
        assert r[5] > r[2] and by_payload.setdefault(r[3], r[5:]) == r[5:]
        assert f"{r[2] // 64 / 25:.2f} s, {r[2] // 64} frames, {-(-(r[2] // 64) // 25)} keyframes" in r[7]
    assert len({r[6] for r in got}) == len(by_payload)


def test_mixing(spark, odd):
    for folder, rule in ((odd, mixing.Rule(block_tokens=100, repetition=3.5)), (SMALL, mixing.Rule(block_tokens=500))):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        hashed = docs.selectExpr("doc_id", "source", f"xxhash64(doc_id, {rule.seed}, coalesce('s' || source, '')) as h", "text", "coalesce('s' || source, '') as name").collect()
        rows = [(r["doc_id"], r["source"], r["h"], len(brute.WORDS.findall(r["text"] or "")), r["name"]) for r in hashed]
        want = brute.mixed(rows, lambda tokens, rule=rule: mixing.solve(tokens, rule), mixing.orders, rule)
        found = mixing.mix(docs, rule)
        assert found.columns == [c for c in docs.columns if c not in mixing.OUT] + list(mixing.OUT)
        got = [(r["doc_id"], r["source"], r["mix_tokens"], round(r["mix_weight"], 9), r["mix_pass"], r["mix_block"]) for r in found.collect()]
        assert ordered(got) == ordered(want)
    keys = found.where("mix_pass = 0").select("source", "mix_block", "mix_key").collect()
    largest = max({r["source"] for r in keys}, key=lambda s: sum(r["source"] == s for r in keys))
    firsts = {}
    for r in sorted((r for r in keys if r["source"] == largest), key=lambda r: r["mix_key"]):
        firsts.setdefault(r["mix_block"], None)
    assert list(firsts) != sorted(firsts) and len(firsts) > 3
    collected(spark, "op6_mixing", SMALL)


def test_token_ids(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.BYTE_BPE)
    for folder in (odd, SMALL):
        start, want, seen = 0, [], {}
        docs = rows_of(folder, "documents", "doc_id", "text")
        for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0])):  # the sort keeps the rows of one id in their order
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
            seen.setdefault(i, []).append(len(ids))
        assert collected(spark, "op7_token_ids", folder) == ordered(want)


def test_language(spark, odd):
    docs = queries.read(spark, odd, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.where(queries.fold(5) != 0), queries.PIECES)
    got = queries.op8_language_id(spark, odd).join(queries.read(spark, odd, "documents", "doc_id", "text"), "doc_id").collect()
    assert len(got) >= len(TEXTS) - 3
    once = [r for r in got if r["doc_id"] != 1]
    assert model.names == ["de", "en"]
    for r in once:
        name, score = brute.language(model, r["text"] if len(r["text"] or "") < 5000 else "a")
        if len(r["text"] or "") < 5000:
            assert math.isclose(r["score"], score, abs_tol=1e-5) and (r["lang_pred"] == name or abs(score - 0.5) < 1e-4), r["text"]
        assert r["held_out"] == (brute.fold(r["doc_id"], 5) == 0)
    assert len(collected(spark, "op8_language_id", odd)) == len(TEXTS)


def test_long_words():
    vocabulary = langid.vocabulary(queries.PIECES)
    model = langid.fit({"en": ["the cat and the other thing"] * 3, "de": ["der hund und die andere sache"] * 3}, vocabulary)
    lattice = langid.Lattice(model.pieces)
    for word in ("the" * 30, "x" * 64, "andere" * 900 + "日", "thecat" * 683 + "ab", "y" * 4096, "z" * 4095, "q" * 8300):
        logs, index = np.log(model.probabilities), {p: i for i, p in enumerate(model.pieces)}
        s, alpha = "▁" + word, [np.zeros(2)]
        for j in range(1, len(s) + 1):
            ways = [alpha[i] + logs[p] for i in range(max(0, j - 16), j) if (p := index.get(s[i:j], -1 if j - i == 1 else None)) is not None]
            alpha.append(np.logaddexp.reduce(ways, axis=0))
        assert np.allclose(model.long_word(lattice, word), alpha[-1], rtol=1e-9), word[:9]
    assert np.allclose(model.long_word(lattice, "thecat"), model.words(lattice, ["thecat"])[0])


def test_quality(spark, odd):
    docs, labels = queries.read(spark, odd, "documents", "doc_id", "text"), queries.read(spark, odd, "labels", "doc_id", "quality")
    model = compression.train(docs, labels.where(queries.fold(3) != 1))
    want = []
    for i, t in rows_of(odd, "documents", "doc_id", "text"):
        score = brute.quality(model, t)
        want.append((i, brute.fold(i, 3) == 1, round(score, 9), int(score >= 0.5)))
    assert ordered((i, h, round(s, 9), p) for i, h, s, p in collected(spark, "op9_quality_classifier", odd)) == ordered(want)


def test_katz_of_odd_rows(spark, odd):
    rows = collected(spark, "op10_katz_lm", odd)
    assert len(rows) == len(TEXTS) and all(math.isfinite(r[6]) and r[6] < 0 for r in rows)
    texts = rows_of(odd, "documents", "doc_id", "text")
    assert ordered((r[0], r[1], r[2]) for r in rows) == ordered((i, brute.fold(i, 7) == 2, len(brute.WORDS.findall(t or "")) + 1) for i, t in texts)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    want = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SMALL)
    assert set(df.columns) == set(want.columns)
    assert ordered(map(tuple, df.select(*want.columns).collect())) == ordered(want.fetchall())


def test_pipeline(spark):
    """Each stage of the pipeline against a plain version, over what the stage before it kept."""
    import sentencepiece

    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    model = langid.train(docs.where(queries.fold(5) != 0), queries.PIECES)
    kept = []
    for r in rows:
        name, score = brute.language(model, r[1])
        assert name == "und" or abs(score - pipeline.LEAST_LANGUAGE) > 1e-4
        if name != "und" and score >= pipeline.LEAST_LANGUAGE:
            kept.append(r)
    df = pipeline.language(spark, docs, SMALL)
    assert df.columns == columns and ordered(map(tuple, df.collect())) == ordered(kept)

    docs, rows = spark.createDataFrame(kept, docs.schema), kept
    labels = queries.read(spark, SMALL, "labels", "doc_id", "quality")
    model = compression.train(docs, labels.where(queries.fold(3) != 1))
    kept = [r for r in rows if brute.quality(model, r[1]) >= pipeline.LEAST_QUALITY]
    df = pipeline.quality(spark, docs, SMALL)
    assert df.columns == columns and ordered(map(tuple, df.collect())) == ordered(kept) and len(kept) < len(rows)

    docs, rows = spark.createDataFrame(kept, docs.schema), kept
    stays = {i for i, _, c in brute.similar([(r[0], r[1]) for r in rows]) if i == c}
    kept = [r for r in rows if r[0] in stays]
    df = pipeline.near_duplicates(spark, docs, SMALL)
    assert df.columns == columns and ordered(map(tuple, df.collect())) == ordered(kept) and len(kept) < len(rows)

    docs, rows = spark.createDataFrame(kept, docs.schema), kept
    name = f"xxhash64(doc_id, {pipeline.MIX.seed}, coalesce('s' || source, '')) as h"
    hashed = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", name).collect()}
    given = [(r[0], r[3], hashed[r[0]], len(brute.WORDS.findall(r[1] or "")), f"s{r[3]}") for r in rows]
    want = brute.mixed(given, lambda tokens: mixing.solve(tokens, pipeline.MIX), mixing.orders, pipeline.MIX)
    df = pipeline.mixed(spark, docs, SMALL)
    assert df.columns == columns and ordered(r["doc_id"] for r in df.collect()) == ordered(w[0] for w in want)

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    df = pipeline.sentencepiece(spark, docs, SMALL)
    want = [(r[0], r[2], r[3], len(ids), ids) for r in rows for ids in [library.encode(r[1] or "")]]
    assert ordered(map(tuple, df.collect())) == ordered(want)


def test_pipeline_of_odd_and_empty_tables(spark, odd, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    found = pipeline.run(spark, odd)
    assert found.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and found.count() > 0
    for table in ("documents", "labels"):
        pq.write_table(pq.read_table(f"{odd}/{table}.parquet").slice(0, 0), tmp_path / f"{table}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
