"""A name graph projected from the relational tables, so that every operator runs on them.

Parts, suppliers, nations and regions are definitions, brands' files hold them, lineitems are
references by name in all the shapes that the binding rules know. The text is plain SQL over the
tables' names, run by Spark here and by any SQL engine that checks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("part", "supplier", "nation", "region", "lineitem")


def _language(k: str) -> str:
    return f"CASE {k} % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'c' ELSE 'cpp' END"


_BRAND = "CAST(substr(p_brand, 7) AS INT)"
_PARTS = f"SELECT p_partkey, replace(p_name, ' ', '_') AS name, lower(p_type) AS kind, {_BRAND} AS b FROM part"

NODES = f"""
SELECT 'P' || CAST(p_partkey AS STRING) AS node_id, name, 'function' AS node_type, {_language("b")} AS language,
       'src/' || kind || '/b' || CAST(b AS STRING) || '.x' AS file_path, CAST(p_partkey AS INT) AS start_line,
       kind || '::b' || CAST(b AS STRING) || '::' || name AS qualified_name
FROM ({_PARTS}) p
UNION ALL
SELECT 'S' || CAST(s_suppkey AS STRING), replace(s_name, '#', '_'), 'function', {_language("s_nationkey")},
       'src/supplier/n' || CAST(s_nationkey AS STRING) || '.x', CAST(s_suppkey AS INT),
       'supplier::n' || CAST(s_nationkey AS STRING) || '::' || replace(s_name, '#', '_')
FROM supplier
UNION ALL
SELECT 'N' || CAST(n_nationkey AS STRING), n_name, 'struct', {_language("n_nationkey")},
       'src/nation/r' || CAST(n_regionkey AS STRING) || '.x', CAST(n_nationkey AS INT),
       'nation::r' || CAST(n_regionkey AS STRING) || '::' || n_name
FROM nation
UNION ALL
SELECT 'T' || CAST(r_regionkey AS STRING), r_name, 'trait', {_language("r_regionkey")}, 'src/region/t.x', CAST(r_regionkey AS INT), 'region::t::' || r_name
FROM region
UNION ALL
SELECT DISTINCT 'I_' || kind || '_' || CAST(b AS STRING), 'use crate::' || kind || '::b' || CAST((b + 4) % 25 + 1 AS STRING) || '::*;', 'import', 'rust',
       'src/' || kind || '/b' || CAST(b AS STRING) || '.x', 0, kind || '::b' || CAST(b AS STRING) || '::use'
FROM ({_PARTS}) p WHERE b % 5 = 0
UNION ALL
SELECT DISTINCT 'M_' || kind || '_' || CAST(b AS STRING), 'b' || CAST(b AS STRING), 'module', {_language("b")},
       'src/' || kind || '/b' || CAST(b AS STRING) || '.x', 0, kind || '::b' || CAST(b AS STRING)
FROM ({_PARTS}) p
"""

#: References by name, still unbound, each once.
REFERENCES = f"""
SELECT DISTINCT 'P' || CAST(l.l_partkey AS STRING) AS from_id,
       CASE l.l_linenumber WHEN 1 THEN t.name WHEN 2 THEN t.kind || '::b' || CAST(t.b AS STRING) || '::' || t.name
            WHEN 3 THEN 'b' || CAST(t.b AS STRING) || '.' || t.name WHEN 4 THEN 'crate::' || t.kind || '::b' || CAST(t.b AS STRING) || '::' || t.name
            WHEN 5 THEN 'ghost_' || t.name WHEN 6 THEN 'std::' || t.name ELSE replace(s.s_name, '#', '_') END AS to_name,
       'function' AS to_type, 'calls' AS edge_type
FROM lineitem l CROSS JOIN (SELECT count(*) AS n FROM part) c
JOIN ({_PARTS}) t ON t.p_partkey = (l.l_orderkey * 13 + l.l_suppkey) % c.n
JOIN supplier s ON s.s_suppkey = l.l_suppkey
UNION ALL
SELECT 'S' || CAST(s_suppkey AS STRING), n_name, 'struct', 'member_of' FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL
SELECT 'N' || CAST(n_nationkey AS STRING), r_name, 'trait', 'implements' FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL
SELECT 'X0', 'nowhere', 'function', 'calls' FROM region WHERE r_regionkey = 0
"""

#: What extraction binds by itself: a file's module contains its functions.
CONTAINS = f"""
SELECT 'M_' || kind || '_' || CAST(b AS STRING) AS from_id, 'P' || CAST(p_partkey AS STRING) AS to_id FROM ({_PARTS}) p
"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    import re

    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(re.sub(rf"(?<=FROM |JOIN )({'|'.join(TABLES)})\b", r"{\1}", text), **frames)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without their identity."""
    return _sql(spark, sf_dir, REFERENCES)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = edges(spark, sf_dir)
    return refs.select(edge_key(F.col("from_id"), F.col("to_name"), F.col("to_type"), F.col("edge_type")).alias("edge_id"), "*")


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CONTAINS).withColumn("edge_type", F.lit("contains"))


def edge_key(*parts):
    """Identity of a reference: what it comes from, what it names, how."""
    return F.md5(F.concat_ws("|", *parts))
