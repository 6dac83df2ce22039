"""The queries of this subpackage's operators over the whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontam, htmltext, ngramjoin, pii, quality, secrets, tokenbin, toxicity
from .common import held_out, shared_folder, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by :func:`quality.score`; a null or empty text is one empty line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards that :func:`tokenbin.write_tokens` wrote; a null text has the end id alone."""
    folder = shared_folder(spark, "tokens")
    tokenbin.write_tokens(table(spark, sf_dir, "documents"), folder, _vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenbin.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("payload").alias("ids_crc32"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base counts and digest, and all spans of every document, by :func:`pii.find`; a null text has none."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select(
        "doc_id",
        *[pii.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by :func:`toxicity.score`; a null or empty text has no matches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base counts and digest, and all spans of every document, by :func:`secrets.scan` over a new ledger; a null text has none."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark, "ledger"))
    names = [r.name for r in secrets.BASE_RULES]
    base = F.filter("findings", lambda x: x["rule"].isin(names))
    return found.select(
        "doc_id",
        *[secrets.count(F.col("findings"), n).alias(f"n_{n}") for n in names],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("findings")).alias("spans"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and n_links of every document, by :func:`ngramjoin.join`; a text without words is a class of its own."""
    return ngramjoin.join(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page, by :func:`htmltext.extract`; null or empty html gives an empty text."""
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, items and verdict of every document, by :func:`decontam.find`; a null text has no words."""
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontam.n_hit(F.col("hits"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated(F.col("n_words"), hit).alias("contaminated"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every document, by :func:`bpe.encode_decode`; a null text has no ids."""
    import public_tokenizers

    out = bpe.encode_decode(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every row whose vec_id 50 divides, by :func:`ann.search`; unusable vectors take no part."""
    return ann.search(table(spark, sf_dir, "embeddings"), query_every=50, k=5)


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item, least(len(w), 13) AS m, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (
  SELECT r, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS k
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT g.r, g.i, g.m, p.item FROM g JOIN p USING (m, k)),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT r, i, m FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


#: Exact pairs and components; the texts of the same words are one class here too.
OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS k
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 10 * p.c >= 8 * (x.n + y.n - p.c)),
c AS (
  SELECT r AS a, r AS b FROM d
  UNION
  SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT d.doc_id, m.class_id, CAST(coalesce(t.n_links, 0) AS BIGINT) AS n_links
FROM d
JOIN (SELECT c.a, min(e.doc_id) AS class_id FROM c JOIN d e ON e.r = c.b GROUP BY c.a) m ON m.a = d.r
LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) t ON t.a = d.r
"""


#: Each reads its whole tables. Repeated rows stay, empty tables give empty results, texts of any length are taken whole, and
#: other columns aren't read; more on these cases stands with the operators.
def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_token_binary, op3_pii, op4_toxicity, op5_secrets, op6_ngram_join, op7_html_text, op8_decontamination, op9_byte_bpe, op10_nearest)}


def oracle_sql() -> dict[str, str]:
    return {"op6_ngram_join": OP6_SQL, "op8_decontamination": OP8_SQL}
