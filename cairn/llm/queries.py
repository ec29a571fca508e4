"""The thin contract queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import scratch, spread, table

N_SHARDS = 40
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents"), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.decontam import matches

    return matches(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.toxicity import score_tables

    return score_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.pieces import encode

    return encode(spread(table(spark, sf_dir, "documents")), PIECE_MODEL)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.simhash import near_groups

    out = near_groups(spread(table(spark, sf_dir, "documents")), words=4, k=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.html_text import extract

    return extract(spread(table(spark, sf_dir, "pages")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm import warc

    manifest = warc.write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    read = warc.read_archives(spark, manifest).filter("reason is null")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm import secret_scan

    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.fit_forest(secret_scan.builtin_findings(spark)))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.neighbours import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.langid import identify

    return identify(spread(table(spark, sf_dir, "documents")), folds=3, held=1)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_shard": op1_shard, "op2_decontaminate": op2_decontaminate, "op3_toxicity": op3_toxicity,
        "op4_pieces": op4_pieces, "op5_simhash": op5_simhash, "op6_main_text": op6_main_text, "op7_warc": op7_warc, "op8_secrets": op8_secrets, "op9_neighbours": op9_neighbours,
        "op10_language": op10_language,
    }


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: CRC-32 of a text's UTF-8 bytes, byte by byte over the usual table.
CRC_SQL = f"""xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({{text}})), '..'), lambda b: cast('0x' || b AS bigint))),
  lambda c, b: xor(c >> 8, ([{", ".join(map(str, _crc_table()))}]::bigint[])[xor(c & 255, b) + 1])))"""

OP1_SQL = f"""WITH s AS (SELECT doc_id, cast(strlen(coalesce(text, '')) + 16 AS bigint) AS size, {CRC_SQL.format(text="coalesce(text, '')")} AS text_crc32 FROM documents),
  r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM s),
  p AS (SELECT *, cast(least({N_SHARDS - 1}, before * {N_SHARDS} // total) AS integer) AS shard FROM r)
  SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::integer AS grown_shard FROM p"""

OP7_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages), g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
  SELECT page_id, cast(n AS bigint) AS payload_bytes, d AS payload_digest, CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p LEFT JOIN g USING (d)"""

OP9_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings),
  ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
  reach AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM reach r JOIN l ON l.u = r.w),
  c AS (SELECT u, min(w) AS low FROM reach GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
  SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept FROM v LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are held against brute force or held-out rows in tests/llm."""
    return {"op1_shard": OP1_SQL, "op7_warc": OP7_SQL, "op9_neighbours": OP9_SQL}
