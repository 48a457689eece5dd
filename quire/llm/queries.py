"""The queries of this subpackage, by the names they are registered under."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import fingerprint, lm, media, mixing, ngram_join, packing, quality, sharding, toxicity, warc
from quire.llm.common import id_text_crc, table


# CRC-32 in SQL: its table by the rule, and the sum over a list of bytes.
_CRC_TABLE = """bits AS (SELECT n, 0 AS k, n::BIGINT AS c FROM range(256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS crcs FROM bits WHERE k = 8)"""
_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT)"
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], {0}), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])))"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (id_text_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes by virtual slots."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


OP2_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, {_CRC.format(_BYTES.format("coalesce(text, '')"))} AS text_crc32,
    ({_CRC.format(_BYTES.format("coalesce(doc_id::VARCHAR, text, '')"))} % 4096)::INT AS virtual_slot
  FROM documents, crc
),
l AS (SELECT r.v, coalesce(sum(size), 0) AS load FROM range(4096) r(v) LEFT JOIN d ON d.virtual_slot = r.v GROUP BY r.v),
o AS (SELECT v, load, row_number() OVER (ORDER BY load DESC, v) AS i FROM l),
m AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS v, NULL::BIGINT AS shard, list_transform(range(24), lambda x: 0::HUGEINT) AS held
  UNION ALL
  SELECT o.i, o.v, list_position(held, list_min(held)) - 1, list_transform(held, lambda h, x: CASE WHEN x = list_position(held, list_min(held)) THEN h + load ELSE h END)
  FROM m JOIN o ON o.i = m.i + 1
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, m.shard::INT AS shard, row_number() OVER (PARTITION BY m.shard ORDER BY virtual_slot, doc_id, text_crc32, size) - 1 AS slot,
  NULL::INT AS grown_shard, virtual_slot, 1 AS map_version
FROM d JOIN m ON m.v = d.virtual_slot
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a WARC archive of all pages says about each, once read back."""
    captures = warc.archive_pages(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, 10 * (k // 8) + 1, 10))::BIGINT) >> (35 - 5 * (k % 8))) & 31)::INT + 1, 1)), '') AS payload_digest
  FROM p
),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as stored samples, and features of what is read back."""
    return media.document_media(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
t AS (SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT *, greatest(192, (n + 191) // 192 * 192) AS m, {_BYTES.format("body")} AS own FROM t),
w AS (SELECT *, body || repeat(' ', (m - n)::INT) AS payload, list_concat(own, list_transform(range(m - n), lambda x: 32::BIGINT)) AS every FROM p),
s AS (SELECT *, 'P5' || chr(10) || '192 ' || m // 192 || chr(10) || '255' || chr(10) || payload AS media FROM w)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256, {_CRC.format("every[-16:]")} AS tail_crc32, strlen(media)::BIGINT AS media_bytes, sha256(media) AS media_sha256,
  'gray8 192x' || m // 192 || ' sum ' || list_sum(every)::BIGINT || ' kinds ' || len(list_distinct(every)) || ' spaces ' || len(list_filter(every, lambda b: b = 32))
  || ' digits ' || len(list_filter(every, lambda b: b BETWEEN 48 AND 57)) || ' high ' || len(list_filter(every, lambda b: b >= 128)) AS feature
FROM s, crc
"""


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


OP5_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS tokens FROM w
),
c AS (SELECT md5(array_to_string(tokens, chr(10))) AS class, min(doc_id) AS rep, any_value(tokens) AS tokens FROM s WHERE len(tokens) > 0 GROUP BY 1),
t AS (SELECT rep, len(tokens) AS n, unnest(tokens) AS token FROM c),
p AS (
  SELECT a.rep AS x, b.rep AS y FROM t a JOIN t b ON a.token = b.token AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS rep, min(y) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, len(s.tokens)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(c.rep, s.doc_id) AS class_id
FROM s LEFT JOIN c ON c.class = md5(array_to_string(s.tokens, chr(10))) AND len(s.tokens) > 0 LEFT JOIN m ON m.rep = c.rep
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raked weight, sampling probability and fate of every document."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.production(docs), mixing.SHARE)
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "selected")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, and whether it is selected."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (id_text_crc() % 5 == 0).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).cast("int").alias("selected"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's log probability of every document, beside that of smoothed counts."""
    scored = lm.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of its edited text."""
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document, by bands of the fingerprint's walk and verified edit similarity."""
    return fingerprint.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_warc, op4_media, op5_ngram_join, op6_mixing, op7_packing, op8_quality, op9_lm_scoring, op10_fingerprint, op10_near_duplicates)}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2_SQL, "op3_warc": OP3_SQL, "op4_media": OP4_SQL, "op5_ngram_join": OP5_SQL}
