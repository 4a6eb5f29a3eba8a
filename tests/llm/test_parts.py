"""Parts of the operators that the queries do not reach: skipped records, odd containers, memory, shared hashes."""

import os
import random
import struct
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyspark.llm import embeddings, flattext, media, sentencepieces, tokenids, warc
from tallyspark.llm.shared import clear, forget, new_path, written

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def flat(words):
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends


def test_words_of_one_form_have_their_own_hashes():
    tm = ["".join("ab"[(bin(i).count("1") + k) & 1] for i in range(n)) for n in (64, 1024, 2048, 4096) for k in (0, 1)]
    words = [*tm, "", "a", "a\0", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "\0", "\0\0", *(f"{i}" for i in range(5000)), *(f"long word number {i} of many" for i in range(5000))]
    hashes = flattext.Hasher()(*flat(words))
    assert len(np.unique(hashes)) == len(words)
    assert (flattext.Hasher()(*flat([w.upper() for w in words])) == hashes).all()


def test_stretches_that_share_a_hash_have_their_own_numbers(monkeypatch):
    """Bytes decide: here all words share one of four hashes."""
    monkeypatch.setattr(flattext.Hasher, "of", lambda self, values, counts, sizes: sizes.astype(np.uint64) % np.uint64(4) << np.uint64(62))
    r = random.Random(2)
    units, seen = flattext.Stretches(2), {}
    for _ in range(20):
        words = ["".join(r.choices("abc", k=r.randrange(1, 30))) for _ in range(50)]
        numbers, fresh = units.numbers(*flat(words))
        for i in fresh:
            seen[int(numbers[i])] = words[i]
        assert [seen[int(n)] for n in numbers] == words


def test_long_text_needs_little_memory():
    """4 MB of different words: windows of 1 MB are held at once, not all of it."""
    import sentencepiece

    r = random.Random(1)
    text = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=r.randint(3, 9))) for _ in range(600_000))
    encoder, _ = sentencepieces.coders(PIECES)
    column = pa.array([text])
    tracemalloc.start()
    ids, places = encoder.texts(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 4_000_000 and peak < 260e6, peak
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text) and places.tolist() == [0, len(ids)]


def test_unsupported_vocabularies():
    with pytest.raises(ValueError):
        tokenids.TextCoder(public_tokenizers.path("word_bpe_49k.json"))


def archive(spark, records, name="a.warc.gz", pack=warc.member):
    path = new_path(spark, "archive")
    os.makedirs(path.removeprefix("file://"))
    with open(f"{path.removeprefix('file://')}/{name}", "wb") as f:
        f.write(b"".join(map(pack, records)))
    return path


def test_blocks_that_are_not_asked_for_are_not_read(spark):
    payload = np.random.default_rng(1).bytes(400_000)
    first, second = ({"record_id": f"urn:{k}", "record_type": kind, "target_uri": f"http://{k}", "payload": data} for k, kind, data in (("a", "response", payload), ("b", "revisit", b"")))
    broken = bytearray(warc.member(warc.record(first)))
    broken[300_000:300_050] = bytes(50)
    path = archive(spark, [bytes(broken), warc.member(warc.record(second))], pack=bytes)
    assert [r["record_id"] for r in warc.read(spark, path).where("record_type = 'revisit'").collect()] == ["urn:b"]
    assert [r["record_id"] for r in warc.read(spark, path).where("target_uri = 'http://b'").collect()] == ["urn:b"]
    assert warc.read(spark, path, payload=False).count() == 2
    with pytest.raises(Exception, match="a.warc.gz"):
        warc.read(spark, path).collect()


def test_archives_of_others(spark):
    """Without compression, with members that do not state their length, and with digests of another kind."""
    rows = [{"record_id": f"urn:{i}", "record_type": "response", "target_uri": f"u{i}", "payload": np.random.default_rng(i).bytes(150_000 * (i % 3))} for i in range(7)]
    records = [warc.record(r) for r in rows]
    records[0] = records[0].replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: other:!")
    plain = lambda data: warc.member(data)[:10].replace(b"\x04", b"\0") + warc.member(data)[24:]
    for name, pack in (("a.warc", bytes), ("a.warc.gz", plain), ("a.warc.gz", warc.member)):
        path = archive(spark, records, name, pack)
        back = {r["record_id"]: bytes(r["payload"]) for r in warc.read(spark, path).collect()}
        assert back == {r["record_id"]: r["payload"] for r in rows}
        assert [r["record_id"] for r in warc.read(spark, path).where("record_id = 'urn:5'").collect()] == ["urn:5"]


def container(*traks):
    return media.FTYP + media.box(b"moov", *traks) + media.box(b"mdat", bytes(400))


def trak(handler, codec, sizes, first, times, keys=None, same=0):
    n = len(sizes)
    stbl = media.box(
        b"stbl",
        media.full(b"stsd", 0, struct.pack(">I", 1), media.box(codec, bytes(24), struct.pack(">HH", 16, 9), bytes(50))),
        media.full(b"stts", 0, struct.pack(">I", len(times)), *(struct.pack(">II", *t) for t in times)),
        media.full(b"stsc", 0, struct.pack(">I", 1), struct.pack(">III", 1, n, 1)),
        media.full(b"stsz", 0, struct.pack(">II", same, n), b"" if same else media.words(np.array(sizes))),
        media.full(b"stco", 0, struct.pack(">II", 1, first)),
        media.full(b"stss", 0, struct.pack(">I", len(keys)), media.words(np.array(keys))) if keys is not None else b"",
    )
    mdhd = media.full(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 10, 999, 0, 0))
    return media.box(b"trak", media.box(b"mdia", mdhd, media.full(b"hdlr", 0, bytes(4), handler, bytes(13)), media.box(b"minf", stbl)))


def test_all_tracks_are_indexed(spark):
    audio, video = trak(b"soun", b"mp4a", [10, 20], 40, [(2, 5)]), trak(b"vide", b"avc1", [7, 8, 9], 100, [(1, 10), (2, 20)], [1, 3])
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    lies = [trak(b"vide", b"avc1", [1], 9, [(2**31, 1)]), trak(b"vide", b"avc1", [1], 9, [(1, 1)], [0]), trak(b"vide", b"avc1", [1], 9, [(1, 1)], [2])]
    huge = trak(b"soun", b"mp4a", [], 9, [(0xFFFFFFFF, 1)], same=1).replace(struct.pack(">II", 1, 0), struct.pack(">II", 1, 0xFFFFFFFF))
    data = [container(audio, video), container(audio), deep, *(container(x) for x in lies), container(huge), b"", None]
    rows = media.index(spark.createDataFrame(list(enumerate(data)), "id int, media binary")).orderBy("id").collect()
    first = rows[0]
    assert (first["codec"], first["width"], first["height"], first["duration"], first["n_samples"]) == ("avc1", 16, 9, 5.0, 3)
    assert [tuple(k) for k in first["keyframes"]] == [(100, 7), (115, 9)]
    assert [(t["handler"], t["codec"], t["duration"], t["n_samples"]) for t in first["tracks"]] == [("soun", "mp4a", 1.0, 2), ("vide", "avc1", 5.0, 3)]
    assert [tuple(k) for k in first["tracks"][0]["keyframes"]] == [(40, 10), (50, 20)]
    assert rows[1]["codec"] == "mp4a" and all(r["codec"] is None and r["tracks"] is None and r["keyframes"] is None for r in rows[2:])


def test_recall_of_codes(spark):
    """Pairs near the threshold are found, also where codes are long because a label is large."""
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 32))
    noise = r.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) / (base * base).sum(1, keepdims=True) * base
    angle = np.arccos(0.9805)
    near = base / np.linalg.norm(base, axis=1, keepdims=True) * np.cos(angle) + noise / np.linalg.norm(noise, axis=1, keepdims=True) * np.sin(angle)
    rows = [(i, 1, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for bits in (None, 20):
        found = embeddings.near_duplicates(df, embeddings.Rule(bits=bits)).where("n_links > 0").count()
        assert found >= 0.99 * 800
    assert embeddings.Rule().plan(10**9)[0] == 30 and embeddings.Rule().plan(10**9)[1] < 60


def test_folders_can_be_cleared(spark):
    one, other = (written(spark.range(5), "t") for _ in range(2))
    assert one.count() == 5
    forget(spark, one)
    kept = other._folder.removeprefix("file://")
    assert not os.path.exists(one._folder.removeprefix("file://")) and os.path.exists(kept)
    clear(spark)
    assert not os.path.exists(kept)
