"""The numbered operators as queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.shared import scratch, stored, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.warc import read_warc, write_warc

    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.urlrank import judge

    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    return judge(table(spark, sf_dir, "pages"), rules)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.chat import collapse

    return collapse(table(spark, sf_dir, "conversations"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioflow.llm.sentencepieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioflow.llm.tokenbin import token_ids

    return token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 49_408, 2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.langid import fit, identify

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(documents.filter(~held_out).select("text", "lang"))
    return identify(documents.select("doc_id", held_out.alias("held_out"), "text"), model, drop_text=True)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.substrings import digests

    return digests(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.media import media_features, store_text_media

    return media_features(store_text_media(table(spark, sf_dir, "documents"))).drop("hash")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other rows of embeddings for each row whose vec_id is divisible by 20."""
    from folioflow.llm.bitslices import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of the one whose conv_id is the next lower multiple of five."""
    from folioflow.llm.trie import numbered, prefix_trie, rebuilt, sequences

    turns = stored(numbered(table(spark, sf_dir, "conversations")), "turns")
    id_ = F.col("conv_id")
    n_first = F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(9)).cast("int")
    return prefix_trie(sequences(rebuilt(turns, id_ - id_ % 5, n_first, 8)))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of embeddings whose vec_id is divisible by 100; every seventh vec_id has its label moved on by one."""
    from folioflow.llm.vantage import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_substrings": op3_substrings,
    "op4_media": op4_media,
    "op5_url_filters": op5_url_filters,
    "op6_decontamination": op6_decontamination,
    "op7_chat": op7_chat,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_token_ids": op9_token_ids,
    "op10_simhash": op10_simhash,
    "op11_top_k": op11_top_k,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT)
  + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT), 1)), '')"""

#: CRC-32 of a decimal number, a bit at a time.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: xor(x // 2, (x % 2) * 3988292384))), 4294967295)"""
_VALID = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE: dict[str, str] = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, url FROM pages),
d AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS keeper,
  array_to_string(list_transform(string_split(sha1(html), ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to, url AS target_uri FROM d""",
    "op6_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM bw WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS phrase FROM bs),
lengths AS (SELECT DISTINCT n FROM b),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, lengths WHERE len(w) >= n),
hits AS (SELECT ds.doc_id, ds.k, b.n, b.item_id FROM ds JOIN b ON b.n = ds.n AND array_to_string(list_slice(ds.w, ds.k, ds.k + ds.n - 1), ' ') = b.phrase),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
freq AS (SELECT t, count(*) AS f FROM (SELECT unnest(w) AS t FROM dw) GROUP BY t),
terms AS (SELECT DISTINCT phrase, item_id, string_split(phrase, ' ') AS pw, unnest(string_split(phrase, ' ')) AS t FROM b),
seeds AS (SELECT phrase, item_id, any_value(pw) AS pw, arg_min(t, coalesce(f, 0)) AS t FROM terms LEFT JOIN freq USING (t) GROUP BY phrase, item_id),
tokens AS (SELECT doc_id, w, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM dw),
near AS (SELECT DISTINCT doc_id, item_id FROM tokens JOIN seeds USING (t) WHERE list_has_all(list_slice(w, greatest(p - 12, 1), p + 12), pw)
  AND len(list_filter(range(greatest(p - 12, 1), p + 1), lambda s: list_has_all(list_slice(w, s, s + 12), pw))) > 0),
nears AS (SELECT doc_id, count(*) AS n_near_items FROM near GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)""",
    "op7_chat": """
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id, CASE WHEN conv_id IS NULL THEN turn END, CASE WHEN conv_id IS NULL THEN role END, CASE WHEN conv_id IS NULL THEN text END) AS n_turns,
  string_agg(concat(role, chr(1), text), chr(2)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS key,
  string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS text
  FROM r WINDOW w AS (PARTITION BY conv_id, CASE WHEN conv_id IS NULL THEN turn END, CASE WHEN conv_id IS NULL THEN role END, CASE WHEN conv_id IS NULL THEN text END ORDER BY turn NULLS FIRST, role, text)),
whole AS (SELECT key, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n_turns) AS n_turns, any_value(text) AS text FROM t WHERE place = n_turns GROUP BY key)
SELECT conv_id, n_turns, n_copies, text FROM whole WHERE key NOT IN (SELECT key FROM t WHERE place < n_turns)""",
    "op11_top_k": f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_VALID}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_prefix_trie": f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS place, concat(strlen(role), ':', strlen(text), ':', role, text) AS turn, strlen(text) AS bytes FROM r),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h FROM r),
b AS (SELECT c.conv_id, t.place, t.turn, t.bytes FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h UNION ALL SELECT t.conv_id, t.place, t.turn, t.bytes FROM t JOIN c USING (conv_id) WHERE t.place > c.h),
n AS (SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(turn, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS name, bytes FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
m AS (SELECT conv_id, depth, name, bytes, lag(name, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM n
  UNION ALL SELECT conv_id, 0, '', 0, NULL, conv_id NOT IN (SELECT conv_id FROM n) FROM c),
v AS (SELECT name, any_value(parent) AS parent, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends_sha256 FROM m GROUP BY name),
k AS (SELECT parent AS name, count(*) AS n_children FROM v GROUP BY parent),
up AS (SELECT DISTINCT a.name AS top, d.name FROM m a JOIN m d ON a.conv_id = d.conv_id AND a.depth <= d.depth),
s AS (SELECT top AS name, count(*) FILTER (k.name IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM up JOIN v ON v.name = up.name LEFT JOIN k ON k.name = up.name GROUP BY top)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s USING (name) LEFT JOIN k USING (name) LEFT JOIN v p ON p.name = v.parent""",
    "op13_hard_negatives": f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_VALID} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
