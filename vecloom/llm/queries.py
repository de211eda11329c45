"""The operators over the data tables, with production parameters, and their SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import functions as F

from vecloom.llm import jaccard, media, neardup, pack, pieces, quality, shard, substring, suffix, toxicity

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark, sf_dir, *columns):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def held_out(column):
    """Whether crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@query
def op3_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    lexicon = toxicity.learn_lexicon(docs, labels.where(~held_out("doc_id")))
    scored = toxicity.score_documents(docs, lexicon, score="score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_quality(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = quality.fit(docs)
    return quality.score_quality(docs, model, score="score").select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


@query
def op5_shards(spark, sf_dir):
    out = shard.interleaved_shards(_documents(spark, sf_dir, "doc_id", "text", "source"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) FROM range(256) r(i))"
ORACLE["op5_shards"] = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(encode(text), ''::blob) AS body, coalesce('s' || source, 'n') AS key, md5('0-' || coalesce(doc_id::varchar, 'null')) AS h,
         octet_length(coalesce(encode(text), ''::blob)) + 1 AS size
  FROM documents
), crc AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(body), '..'), lambda x: ('0x' || x)::bigint)),
         lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])))::bigint AS text_crc32
  FROM base, (SELECT {_CRC_TABLE} AS t)
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY key ORDER BY h, text_crc32, size) - 0.5::double) / count(*) OVER (PARTITION BY key) AS frac, count(*) OVER () AS n FROM crc
), placed AS (SELECT *, row_number() OVER (ORDER BY frac, key) - 1 AS g FROM ranked)
SELECT doc_id, size::bigint AS size, text_crc32, 'rows' AS law, (g * 16 // n)::int AS shard, (g - (g * 16 // n * n + 15) // 16)::bigint AS slot, NULL::int AS grown_shard, source FROM placed
"""


@query
def op6_packing(spark, sf_dir):
    where = public_tokenizers.path
    return pack.pack_documents(_documents(spark, sf_dir, "doc_id", "text"), where("byte_bpe_50k.json"), where("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_media(spark, sf_dir):
    return media.media_features(_documents(spark, sf_dir, "doc_id", "text"))


@query
def op10_pieces(spark, sf_dir):
    return pieces.encode_documents(_documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_substrings(spark, sf_dir):
    return substring.deduplicate(_documents(spark, sf_dir, "doc_id", "text"))


@query
def op2_suffixes(spark, sf_dir):
    return suffix.deduplicate(_documents(spark, sf_dir, "doc_id", "text"))


@query
def op7_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(_documents(spark, sf_dir, "doc_id", "text"), shingle=3, num=90, den=100)


@query
def op1_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE["op1_near_duplicates"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x
), root AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE x = e.vec_id) AS n_links, r.y AS component_id, e.vec_id = r.y AS kept FROM embeddings e JOIN root r ON r.x = e.vec_id
"""
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ORACLE["op7_jaccard"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), word AS (
  SELECT doc_id, len(ws) AS n, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM w
), gram AS (
  SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM word
), shingle AS (
  SELECT DISTINCT doc_id, s FROM gram WHERE pos <= n - 2 OR (n < 3 AND pos = 1)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
pair AS (SELECT x, y FROM shared JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * n_both >= 90 * (a.n + b.n - n_both)),
link AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(size.n), 0)::bigint AS n_shingles, min(reach.y) AS component_id
FROM documents d JOIN reach ON reach.x = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id GROUP BY d.doc_id
"""
ORACLE["op8_substrings"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
word AS (SELECT doc_id, len(ws) AS n, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM w),
win AS (
  SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s FROM word
), ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM win WHERE pos <= n - 19),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM ranked, range(20) r(d) WHERE k > 1),
kept AS (
  SELECT word.doc_id, count(gone.pos) AS removed, string_agg(word.word, ' ' ORDER BY word.pos) FILTER (gone.pos IS NULL) AS text
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.pos = word.pos GROUP BY word.doc_id
)
SELECT w.doc_id, len(ws)::bigint AS n_words, coalesce(removed, 0)::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
