"""Domain tables as deterministic views over the star-schema and text tables.

Each view prunes to the columns it needs, so filters and column choices reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = 1709251200  # 2024-03-01 UTC, the fixed "now" of every checked query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer: for heavy work on rows of a table of few splits."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def epoch(col: str) -> F.Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.unix_timestamp(F.col(col).cast("timestamp"))


def memories(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    t = F.col("turn")
    uses = F.when(t % 13 == 5, F.array(F.lit("evaluation"))).when(t % 13 == 6, F.array(F.lit("evaluation"), F.lit("retrieval"))).otherwise(F.expr("cast(array() as array<string>)"))
    created = F.lit(1704067200) + F.col("conv_id") * 3600 + t * 60
    return c.select(
        F.concat(F.lit("memory-"), "conv_id", F.lit("-"), "turn").alias("id"), F.concat(F.lit("t"), F.col("conv_id") % 4).alias("tenant"),
        F.col("conv_id").cast("string").alias("session"), F.when(F.col("role") == "user", "observation").when(F.col("role") == "assistant", "fact").otherwise("preference").alias("kind"),
        "text", F.when(t % 11 == 7, "archived").when(t % 11 == 8, "redacted").when(t % 11 == 9, "forgotten").otherwise("active").alias("status"),
        uses.alias("allowed_uses"), F.when(t % 5 != 4, (t % 5 + 6) / F.lit(10.0)).alias("confidence"),
        created.alias("created_s"), F.when(t % 6 == 5, created + 2592000).alias("expires_s"), F.when(t % 7 == 3, "legal_hold").otherwise("durable").alias("retention"),
    )


def memory_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("kind"), "value", F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("occurred_at"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("part-"), "p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, order_id: consecutive parts of an order."""
    li = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    nxt = li.select("l_orderkey", "l_partkey", F.lead("l_partkey").over(w).alias("nxt"))
    return nxt.filter("nxt is not null").select(F.col("l_partkey").alias("src"), F.col("nxt").alias("dst"), F.col("l_orderkey").alias("order_id"))


def assertions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.concat(F.lit("order-"), "o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("subject_key"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object"),
        F.when(first.isin("1", "2"), "primary").when(first == "3", "secondary").otherwise("inferred").alias("authority_level"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 10) / F.lit(10.0)).alias("confidence"), epoch("o_orderdate").alias("from_s"), (epoch("o_orderdate") + 31536000).alias("until_s"), epoch("o_orderdate").alias("asserted_s"),
    )


def hierarchy_nodes(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(0).alias("layer"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit(1).alias("layer"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit(2).alias("layer"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit(2).alias("layer"), F.concat(F.lit("n"), "s_nationkey").alias("parent_id"), F.col("s_name").alias("name"))
    return r.unionByName(n).unionByName(c).unionByName(s)


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("c"), "p_partkey").alias("id"), F.col("p_brand").alias("scheme_id"), F.col("p_name").alias("pref_label"), F.col("p_partkey").alias("position"), F.when(F.col("p_size") % 9 == 0, "rejected").otherwise("active").alias("status"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk per text line."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id"), F.col("source"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("position", "text")).filter(F.trim("text") != "")


#: The same views for the SQL oracle (DuckDB).
VIEWS = {
    "memories": """memories AS (SELECT 'memory-' || conv_id || '-' || turn AS id, 't' || (conv_id % 4) AS tenant, cast(conv_id AS varchar) AS session,
      CASE role WHEN 'user' THEN 'observation' WHEN 'assistant' THEN 'fact' ELSE 'preference' END AS kind, text,
      CASE turn % 11 WHEN 7 THEN 'archived' WHEN 8 THEN 'redacted' WHEN 9 THEN 'forgotten' ELSE 'active' END AS status,
      CASE turn % 13 WHEN 5 THEN ['evaluation'] WHEN 6 THEN ['evaluation', 'retrieval'] ELSE cast([] AS varchar[]) END AS allowed_uses,
      CASE WHEN turn % 5 <> 4 THEN (turn % 5 + 6) / 10.0::double END AS confidence, 1704067200 + conv_id * 3600 + turn * 60 AS created_s,
      CASE WHEN turn % 6 = 5 THEN 1704067200 + conv_id * 3600 + turn * 60 + 2592000 END AS expires_s,
      CASE WHEN turn % 7 = 3 THEN 'legal_hold' ELSE 'durable' END AS retention FROM conversations)""",
    "entities": "entities AS (SELECT 'part-' || p_partkey AS id, p_brand AS kind, p_name AS name, p_type AS type FROM part)",
    "edges": """edges AS (SELECT src, dst, order_id FROM (SELECT l_partkey AS src, l_orderkey AS order_id, lead(l_partkey) OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS dst FROM lineitem) WHERE dst IS NOT NULL)""",
    "assertions": """assertions AS (SELECT 'order-' || o_orderkey AS id, cast(o_custkey AS varchar) AS subject_key, 'status' AS predicate, o_orderstatus AS object,
      CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'primary' WHEN o_orderpriority[1] = '3' THEN 'secondary' ELSE 'inferred' END AS authority_level,
      CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 10) / 10.0::double END AS confidence, cast(epoch(o_orderdate) AS bigint) AS from_s,
      cast(epoch(o_orderdate) AS bigint) + 31536000 AS until_s, cast(epoch(o_orderdate) AS bigint) AS asserted_s FROM orders)""",
    "nodes": """nodes AS (SELECT 'r' || r_regionkey AS id, 0 AS layer, NULL::varchar AS parent_id, r_name AS name FROM region
      UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 2, 'n' || c_nationkey, c_name FROM customer
      UNION ALL SELECT 's' || s_suppkey, 2, 'n' || s_nationkey, s_name FROM supplier)""",
    "concepts": "concepts AS (SELECT 'c' || p_partkey AS id, p_brand AS scheme_id, p_name AS pref_label, p_partkey AS position, CASE WHEN p_size % 9 = 0 THEN 'rejected' ELSE 'active' END AS status FROM part)",
    "chunks": """chunks AS (SELECT doc_id, source, cast(i - 1 AS bigint) AS position, lines[i] AS text FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)) WHERE trim(lines[i], ' ') <> '')""",
}


def views(*names: str) -> str:
    return "WITH " + ", ".join(VIEWS[n] for n in names)
