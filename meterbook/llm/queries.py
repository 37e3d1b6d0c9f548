"""Registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.llm import ann, bottom_k, cascade, fim, fixity, mixing, ngram_join, packing, pii, prefix_trie, substring, token_counts, toxicity
from meterbook.llm.workspace import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix of 150% of all words takes; weights 3, 1, 2 repeat over the sources."""
    documents = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.taken_words(mixing.mix_sources(documents, mixing.repeating_weights(documents)))


@_query
def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of each document and the cascade's verdict."""
    judged = cascade.judged(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL["op3_quality_cascade"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS BIGINT) AS n_dup_lines, count(*) AS n_lines
  FROM lines GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
win AS (SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS g, lead(word, 2) OVER o AS last FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE last IS NOT NULL),
hit AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, (SELECT unnest([0, 1, 2]) AS k) ks WHERE n > 1),
hits AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_repeat_words FROM hit GROUP BY doc_id),
m AS (
  SELECT t.doc_id, t.text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 1) AS n_lines, length(regexp_replace(t.text, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(t.text, '[^\p{Lu}]+', '', 'g')) AS capitals
  FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN hits USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines OR 2 * letters < word_chars OR 2 * capitals > letters) AS kept
FROM b
"""


@_query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: counts of the plain kinds, a digest of their spans, and all spans."""
    found = pii.found_data(_read(spark, sf_dir, "documents"))
    plain = [k.name for k in pii.BASE_KINDS]
    counts = [F.size(c).cast("long").alias(f"n_{c}") for c in plain]
    return found.select("doc_id", *counts, F.sha2(pii.listed(*plain), 256).alias("base_sha256"), pii.listed(*[k.name for k in pii.KINDS]).alias("spans"))


@_query
def op4_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learnt from labelled rows outside the held-out fifth."""
    fold = lambda: F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    documents = _read(spark, sf_dir, "documents")
    model = toxicity.train(documents, _read(spark, sf_dir, "labels"), ~fold())
    return toxicity.scored(documents, model).select("doc_id", F.coalesce(fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    index = ann.build_index(_read(spark, sf_dir, "embeddings"))
    return ann.nearest(index, F.col("vec_id") % 50 == 0)


@_query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens that hold all documents."""
    return packing.pack(packing.document_pieces(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of each document."""
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), token_counts.rank_scores(public_tokenizers.path("piece_bpe_32k.model")))


@_query
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each document without passages of 13 words that an earlier document holds."""
    return substring.without_duplicates(_read(spark, sf_dir, "documents"), with_text=False)


ORACLE_SQL["op7_repeated_passages"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
win AS (
  SELECT doc_id, i, lead(word, 12) OVER o AS last,
    concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o,
      lead(word, 7) OVER o, lead(word, 8) OVER o, lead(word, 9) OVER o, lead(word, 10) OVER o, lead(word, 11) OVER o, lead(word, 12) OVER o) AS g
  FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
least AS (SELECT g, min(doc_id) AS first_id FROM win WHERE last IS NOT NULL GROUP BY g),
held AS (SELECT win.doc_id, win.i FROM win JOIN least ON win.g = least.g WHERE win.last IS NOT NULL AND least.first_id < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM held, (SELECT unnest(range(13)) AS k) ks),
left_over AS (SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.i) AS kept, count(*) AS n_kept FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(len(t.w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN left_over ON t.doc_id = left_over.doc_id
"""


@_query
def op5_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-shingle sets have a Jaccard similarity of at least 0.9."""
    return ngram_join.ngram_components(_read(spark, sf_dir, "documents"), ngram_join.Similarity(3, 90, 100)).select("doc_id", "n_shingles", "component_id")


@_query
def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record, and whether a replica in which about one record in a hundred has decayed still holds it.

    The decay is part of the case, not of the operator: in pages whose URL has
    a digest below 03, the first letter of the text is overwritten.
    """
    pages = _read(spark, sf_dir, "pages")
    decayed = F.when((F.md5("url") < "03") & (F.octet_length("html") > 0), F.concat(F.lit("~"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    records = stored(fixity.laid_out(pages), "records")
    replica = stored(fixity.laid_out(pages.withColumn("html", decayed)), "replica")
    return fixity.audit(records, replica).select("page_id", "file", "number", "offset", "length", "digest", "intact")


ORACLE_SQL["op2_warc_fixity"] = r"""
WITH r AS (
  SELECT page_id, coalesce(CAST(floor(page_id / 1000) AS BIGINT), -1 - CAST('0x' || md5(coalesce(url, ''))[1:3] AS BIGINT)) AS file, coalesce(md5(url) < '03' AND length(html) > 0 AND html[1] <> '~', false) AS decayed,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR)
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS whole
  FROM pages),
d AS (SELECT page_id, file, decayed, CAST(strlen(whole) AS BIGINT) AS length, sha256(whole) AS digest FROM r)
SELECT page_id, file, CAST(row_number() OVER o - 1 AS BIGINT) AS number, CAST(sum(length) OVER o - length AS BIGINT) AS "offset", length, digest, NOT decayed AS intact
FROM d WINDOW o AS (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


@_query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix by code points, and digests of the output and of the text restored from it."""
    made = fim.transformed(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("fim.output"), F.col("fim.form")
    digests = F.sha2(output, 256).alias("output_sha256"), F.sha2(fim.restored(output, form), 256).alias("restored_sha256")
    return made.select("doc_id", "fim.n", "fim.form", F.col("fim.prefix_units").alias("prefix_chars"), F.col("fim.middle_units").alias("middle_chars"), *digests)


ORACLE_SQL["op12_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS c4 FROM t),
f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


@_query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations, each rebuilt on the first turns of the conversation that opens its block of twenty."""
    turns = prefix_trie.turns(_read(spark, sf_dir, "conversations"))
    nodes = prefix_trie.trie(prefix_trie.branched(turns, stride=20, most=4))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# The first list is CRC-32 by its polynomial: each byte, then eight shifts.
ORACLE_SQL["op13_conversation_trie"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, turn, role, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS d, len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, d) AS i FROM s),
bytes AS (SELECT DISTINCT conv_id, list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS b FROM t),
c AS (SELECT conv_id, xor(list_reduce(b, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 4 AS h FROM bytes),
r AS (
  SELECT c.conv_id, 0 AS own, o.i, o.d, o.words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.i <= c.h
  UNION ALL SELECT o.conv_id, 1, o.i, o.d, o.words FROM o JOIN c ON o.conv_id = c.conv_id WHERE o.i > c.h),
g AS (SELECT c.conv_id, coalesce(list(r.d ORDER BY r.own, r.i) FILTER (WHERE r.d IS NOT NULL), []) AS ds, list(r.words ORDER BY r.own, r.i) FILTER (WHERE r.d IS NOT NULL) AS ws FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, ds, ws, unnest(range(len(ds) + 1)) AS depth FROM g),
q AS (SELECT conv_id, depth, array_to_string(ds[1:depth], '') AS k, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS words, depth = len(ds) AS ends FROM p),
n AS (
  SELECT depth, k, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM q GROUP BY depth, k),
ch AS (SELECT depth - 1 AS depth, left(k, 64 * (depth - 1)) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch ON n.depth = ch.depth AND n.k = ch.k),
a AS (SELECT unnest(range(depth + 1)) AS top, k, n_children = 0 AS leaf, (n_convs - 1) * words AS saved FROM v),
u AS (SELECT top, left(k, 64 * top) AS k, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved FROM a GROUP BY ALL)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, w.conv_id AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN u ON u.top = v.depth AND u.k = v.k LEFT JOIN n AS w ON w.depth = v.depth - 1 AND w.k = left(v.k, 64 * (v.depth - 1))
"""


@_query
def op11_sketch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-shingle sets have a Jaccard similarity of at least 0.85, found by sketches of 64 values."""
    found = bottom_k.near_duplicates(_read(spark, sf_dir, "documents"), ngram_join.Similarity(3, 85, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
