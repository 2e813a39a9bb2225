"""One query for each operator of this subpackage, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import align, bpe, convtrie, hmm, jaccard, media, mixing, mtree, quality, secrets, tokencount, toxicity, warc
from siftwell.llm.common import table, written


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    archives = written(warc.write_archives(warc.deduplicated(table(spark, sf_dir, "pages"))), "warc", "uncompressed")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT page_id, payload, hex, max(page_id) OVER (PARTITION BY payload) AS last FROM p
), v AS (
  SELECT *, list_transform(range(8), lambda i: cast('0x' || substr(hex, cast(1 + 5 * i AS INT), 5) AS INT)) AS parts FROM g
)
SELECT page_id, octet_length(payload) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((parts[cast(i // 4 + 1 AS INT)] >> cast(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to,
  CAST(NULL AS VARCHAR) AS error
FROM v
"""


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in a JPEG and read back: checksums of the payload, of the stored form, and thumbnail hashes."""
    stored = written(media.store_payloads(table(spark, sf_dir, "documents")), "media")
    out = media.media_features(stored)
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash", "average_hash").alias("feature"),
    )


def op3_metric_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector with all others."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0
), t AS (
  SELECT *, cast(row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 of their sources by pivotal rounding."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text under unigram scores of a public vocabulary."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: base patterns, and formats inferred from what they find."""
    scanned = written(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "secrets")
    out = secrets.add_formats(scanned, secrets.fit(scanned))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by byte-level BPE and decoded again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by unigram counts and by a hidden Markov model of the texts that aren't held out."""
    out = hmm.score_corpus(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles agree to 85 percent."""
    return jaccard.classes(table(spark, sf_dir, "documents"), words=4, percent=85)


OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
  ) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.k >= 85 * (na.n + nb.n - p.k)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a model of the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"), "toxic_windows")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut by two public tokenizers, aligned by bytes, and scored by corpus counts of the pairs that end together."""
    return align.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations after their exchange of first turns."""
    return convtrie.trie(table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY i) AS own, conv_id - conv_id % 5 AS base,
    cast(xor(4294967295, list_reduce(
      list_prepend(4294967295, flatten(list_transform(string_split(cast(conv_id AS VARCHAR), ''), lambda x: [cast(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 9 AS INT) AS h
  FROM t GROUP BY conv_id
), r AS (
  SELECT o.conv_id, CASE WHEN o.conv_id = o.base THEN o.own ELSE list_concat(coalesce(b.own[:o.h], []), o.own[o.h + 1:]) END AS path
  FROM o LEFT JOIN o b ON b.conv_id = o.base
), m AS (
  SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM r
), n AS (
  SELECT path[:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = d), '')) AS ends
  FROM m GROUP BY path[:d], d
), k AS (
  SELECT p[:d - 1] AS p, count(*) AS n FROM n WHERE d > 0 GROUP BY p[:d - 1]
), v AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * octet_length(encode(n.p[d].t)) ELSE 0 END AS saved FROM n LEFT JOIN k ON k.p = n.p
), below AS (
  SELECT p[:j] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM v) GROUP BY p[:j]
)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, cast(below.leaves AS BIGINT) AS n_leaves, cast(below.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN below ON below.p = v.p LEFT JOIN n u ON v.d > 0 AND u.d = v.d - 1 AND u.p = v.p[:v.d - 1]
"""


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored for quality by a model of the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"), "bad_windows")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_media_columns": op2_media_columns,
        "op3_metric_top_k": op3_metric_top_k,
        "op4_source_mix": op4_source_mix,
        "op5_token_counts": op5_token_counts,
        "op6_secret_scan": op6_secret_scan,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_hidden_markov_scores": op8_hidden_markov_scores,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_toxicity": op10_toxicity,
        "op11_token_alignment": op11_token_alignment,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_metric_top_k": OP3_SQL, "op9_ngram_jaccard": OP9_SQL, "op12_conversation_trie": OP12_SQL}
