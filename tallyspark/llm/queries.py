"""One query per operator, each over its whole table.

Paths of the public vocabulary files come from their own package; the operators take them as parameters.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, embeddings, jaccard, katz, langid, media, mixing, sentencepieces, tokenids, warc
from .shared import new_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded. Null texts are empty; a row in gives a row out, null and repeated ids included."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    coded = sentencepieces.encode(docs, PIECES, decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a container and read back. Null texts are empty; a row in gives a row out."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    stored = media.store(docs, "text", keep=["doc_id", "n_bytes"])
    ranges = F.concat_ws(";", F.transform("keyframes", lambda r: F.concat_ws("+", r["offset"].cast("string"), r["length"].cast("string"))))
    keyed = F.concat_ws(" ", F.size("keyframes").cast("string"), F.lit("keyframes, crc32"), F.crc32(ranges.cast("binary")).cast("string"))
    form = F.concat(F.col("codec"), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(", ", form, F.format_string("%.2f s", "duration"), F.format_string("%d frames", "n_samples"), keyed).alias("feature"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language. A null id is in fold 0; without a labelled text in the other folds all are "und"."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.where(fold(5) != 0), PIECES)
    rows = docs.select("doc_id", "text", (fold(5) == 0).alias("held_out"))
    return langid.predict(rows, model, keep=["doc_id", "held_out"])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality. A null id is in fold 0; without both labels in the training folds every score is 0.5."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality")
    model = compression.train(docs, labels.where(fold(3) != 1))
    rows = docs.withColumn("held_out", fold(3) == 1)
    scored = compression.score(rows, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies. Rows without an id are left out; rows that share one are so many documents."""
    return jaccard.similarity_classes(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near vectors: a row for each row, also for those that link with nothing or have no id."""
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as records and read back. A null page_id comes back null, and is the least; of pages that share the
    largest one all are responses."""
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    rows = pages.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.col("page_id").alias("order"),
        F.col("url").alias("target_uri"),
        F.col("html").cast("binary").alias("payload"),
    )
    path = new_path(spark, "archives")
    warc.write(warc.with_revisits(rows), path)
    back = warc.read(spark, path).where(F.col("record_type").isin("response", "revisit"))
    page = lambda name: F.substring_index(name, ":", -1).try_cast("long")
    whole = F.col("record_type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
        "target_uri",
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight takes them. Null sources are a source; null texts have no tokens."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix_tokens", "mix_weight", "mix_pass", "mix_block", "mix_key")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts, from the shards. A null id comes first; rows that share an id stand in the order they are read."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    back = tokenids.encode_and_read(spark, docs, BYTE_BPE, new_path(spark, "ids"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log-probability, to six digits, in which sums in another order agree. A null id is in fold 0."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scores = katz.fit(docs.withColumn("held_out", fold(7) == 2)).scores
    return scores.withColumns({name: F.round(name, 6) for name in ("base_score", "score")})


_FIRST = "(select sha1(coalesce(html, '')) as d, max(page_id) as keeper from pages where octet_length(encode(coalesce(html, ''))) >= 1000 group by 1)"
ORACLE_SQL = {
    "op1_warc": f"""
        select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
            case when keeper <> page_id then 'revisit' else 'response' end as record_type,
            case when keeper <> page_id then keeper end as refers_to, url as target_uri
        from pages left join {_FIRST} f on f.d = sha1(coalesce(html, '')) and octet_length(encode(coalesce(html, ''))) >= 1000""",
    "op3_ngram_jaccard": """
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        placed as (select doc_id, len(w) as k, unnest(w) as x, generate_subscripts(w, 1) as i from words),
        five as (
            select doc_id, k, i, concat_ws(' ', x, lead(x, 1) over p, lead(x, 2) over p, lead(x, 3) over p, lead(x, 4) over p) as s
            from placed window p as (partition by doc_id order by i)),
        flat as (select distinct doc_id, s from five where i <= greatest(k - 4, 1)),
        sized as (select d.doc_id, count(s) as n from documents d left join flat f on d.doc_id = f.doc_id group by 1),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from flat a join flat b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
        linked as (select a, b from shared join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
        both_ways as (select a, b from linked union select b, a from linked),
        reach as (select doc_id as a, doc_id as b from sized union select r.a, l.b from reach r join both_ways l on l.a = r.b)
        select doc_id, n as n_shingles, least as component_id from sized join (select a, min(b) as least from reach group by 1) on a = doc_id""",
    "op4_embedding_near_dedup": """
        with recursive rows as (
            select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
        usable as (
            select vec_id, label, v from rows where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(v, v) > 0),
        links as (
            select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
            where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.98),
        reach as (select vec_id as a, vec_id as b from rows union select r.a, l.b from reach r join links l on l.a = r.b),
        least as (select a, min(b) as component_id from reach group by 1)
        select vec_id, (select count(*) from links where a = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept from rows join least on a = vec_id""",
    "op10_katz_lm": """
        with base as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w,
                xor(list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
                    lambda crc, byte: list_reduce(range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(crc, byte)), 4294967295), 4294967295) % 7 = 2 as held
            from documents),
        tokens as (
            select doc_id, held, unnest(w) as x, generate_subscripts(w, 1) as i from base
            union all select doc_id, held, ' ', len(w) + 1 from base),
        pairs as (select doc_id, held, x, lag(x, 1, '') over (partition by doc_id order by i) as p from tokens),
        one as (select x, count(*) as c from tokens where not held group by 1),
        two as (select p, x, count(*) as c from pairs where not held group by 1, 2),
        total as (select sum(c)::bigint as n, count(*) as v from one),
        bins as (
            select kind, r, count(c) as n from (select 1 as kind union all select 2) cross join (select unnest(range(1, 8)) as r)
                left join (select 1 as k, c from one union all select 2, c from two) on k = kind and c = r group by 1, 2),
        tails as (
            select kind, max(n) filter (r = 1) as n1, max(n) filter (r = 2) as n2, max(n) filter (r = 6) as n6 from bins group by 1),
        ways as (
            select kind, case when n1 > 0 and n2 > 0 then n1 / (n1 + 2.0::double * n2) else 0.5 end as flat, case when n1 > 0 then 6.0::double * n6 / n1 else 1.0 end as tail from tails),
        good as (
            select a.kind, a.r, flat, case when a.n > 0 and tail < 1 then ((a.r + 1)::double * b.n / a.n / a.r - tail) / (1 - tail) else 0.0 end as d
            from bins a join bins b on b.kind = a.kind and b.r = a.r + 1 join ways on ways.kind = a.kind where a.r <= 5),
        factors as (select kind, r, case when d > 0 and d < 1 then d else (r - flat) / r end as f from good),
        cut_one as (select x, c, c * coalesce(f, 1.0) as d from one left join factors on kind = 1 and r = c),
        cut_two as (select p, x, c * coalesce(f, 1.0) as d from two left join factors on kind = 2 and r = c),
        lost as (select greatest(sum(c - d), 1e-9 * sum(c)) / sum(c) as unknown from cut_one),
        word as (select x, c, d / n as prob from cut_one cross join total),
        context as (select x as p, c from one union all select '', c from one where x = ' '),
        backoff as (
            select p, (1 - sum(cut_two.d) / (max(context.c) + 1.0)) / greatest(1 - sum(word.prob), 1e-15) as b
            from cut_two join word using (x) join context using (p) group by p),
        scored as (
            select doc_id, held, coalesce(word.c, 0) as c,
                case when cut_two.d is not null then log10(cut_two.d) - log10(context.c + 1.0) else log10(coalesce(word.prob, unknown)) + coalesce(log10(b), 0) end as lp
            from pairs left join cut_two using (p, x) left join word using (x) left join context using (p) left join backoff using (p) cross join lost)
        select doc_id, held as held_out, count(*) as n_tokens, count(*) filter (c > 0) as n_known, any_value(n) as train_tokens,
            round(sum(log10((c + 1.0) / (n + v + 1.0))), 6) as base_score, round(sum(lp), 6) as score
        from scored cross join total group by 1, 2""",
}
