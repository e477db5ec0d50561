"""Stand-ins: the operators' generic inputs derived from the driver's tables by integer arithmetic.

No slide tables exist, so each adapter has a DataFrame and the same rows as DuckDB SQL (`*_SQL`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts that a task makes levels of, whatever the size of the table; of a part some 300 rows of requests are made.
PARTS_A_TASK = 5_000


def spread(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows dealt by the key over partitions of about `most` rows. A narrow table is a file of few splits, and what is made of its rows is large."""
    return rows.repartition(max(1, -(-rows.count() // most)), key)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, scene, series, level, cols, rows, kind, tile_w, tile_h, n_z, n_c, n_t): three levels a part."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("s")), "p_partkey", PARTS_A_TASK)
    each = parts.select("p_partkey", "s", F.explode(F.array(*map(F.lit, range(3)))).alias("level"))
    return each.select(
        F.col("p_partkey").alias("source"), F.lit(0).alias("scene"), F.expr("cast(s % 2 as int)").alias("series"), "level",
        F.expr("(1000 + (p_partkey * 7919) % 9000) div shiftleft(1L, level)").alias("cols"),
        F.expr("(1000 + (p_partkey * 6007) % 7000) div shiftleft(1L, level)").alias("rows"),
        F.expr("case s % 3 when 0 then 'regular' when 1 then 'whole' else 'irregular' end").alias("kind"),
        F.expr("256 * (1 + s % 3)").alias("tile_w"), F.expr("256 * (1 + s % 2)").alias("tile_h"),
        F.expr("1 + s % 2").alias("n_z"), F.expr("s % 4").alias("n_c"), F.lit(1).cast("bigint").alias("n_t"),
    )


LEVELS_SQL = """levels AS (
  SELECT p_partkey AS source, 0 AS scene, CAST(s % 2 AS INTEGER) AS series, level,
         (1000 + (p_partkey * 7919) % 9000) // (1 << level) AS cols, (1000 + (p_partkey * 6007) % 7000) // (1 << level) AS rows,
         CASE s % 3 WHEN 0 THEN 'regular' WHEN 1 THEN 'whole' ELSE 'irregular' END AS kind,
         256 * (1 + s % 3) AS tile_w, 256 * (1 + s % 2) AS tile_h, 1 + s % 2 AS n_z, s % 4 AS n_c, CAST(1 AS BIGINT) AS n_t
  FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS s, unnest([0, 1, 2]) AS level FROM part))"""


def frame_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, level, instance, frame, compression, photometric, components, bits, fits, edge, bytes, micros, error, rgb_grid, synthetic): one row per line item."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    rows = table(spark, sf_dir, "lineitem").withColumns({"frame": F.row_number().over(w).cast("bigint") - 1, "q": F.col("l_quantity").cast("bigint")})
    return rows.select(
        F.expr("l_orderkey % 50").alias("source"), F.expr("l_orderkey div 50 % 3").alias("level"), F.col("l_orderkey").alias("instance"), "frame",
        F.expr("case l_returnflag when 'A' then 'jpeg' when 'N' then 'jp2k' else 'none' end").alias("compression"),
        F.expr("case when q % 5 = 0 then 'MONOCHROME2' when l_linestatus = 'O' then 'YBR_FULL_422' else 'RGB' end").alias("photometric"),
        F.expr("case when q % 5 = 0 then 1 else 3 end").alias("components"), F.expr("case when q % 7 = 0 then 16 else 8 end").alias("bits"),
        F.expr("q % 3 <> 0").alias("fits"), F.expr("q % 11 = 0").alias("edge"), F.expr("cast(floor(l_extendedprice) as bigint)").alias("bytes"),
        F.expr("l_suppkey * 13 + q").alias("micros"),
        F.expr("case when q % 13 = 0 then 'bad restart marker' when q % 17 = 0 then 'codec not supported' when q % 19 = 0 then 'empty TIFF tiles' end").alias("error"),
        F.expr("l_orderkey % 3 = 0").alias("rgb_grid"), F.expr("(l_orderkey % 50 + l_orderkey div 50 % 3) % 7 = 6").alias("synthetic"),
    )


PROBES_SQL = """probes AS (
  SELECT l_orderkey % 50 AS source, l_orderkey // 50 % 3 AS level, l_orderkey AS instance, frame,
         CASE l_returnflag WHEN 'A' THEN 'jpeg' WHEN 'N' THEN 'jp2k' ELSE 'none' END AS compression,
         CASE WHEN q % 5 = 0 THEN 'MONOCHROME2' WHEN l_linestatus = 'O' THEN 'YBR_FULL_422' ELSE 'RGB' END AS photometric,
         CASE WHEN q % 5 = 0 THEN 1 ELSE 3 END AS components, CASE WHEN q % 7 = 0 THEN 16 ELSE 8 END AS bits,
         q % 3 <> 0 AS fits, q % 11 = 0 AS edge, CAST(floor(l_extendedprice) AS BIGINT) AS bytes, l_suppkey * 13 + q AS micros,
         CASE WHEN q % 13 = 0 THEN 'bad restart marker' WHEN q % 17 = 0 THEN 'codec not supported' WHEN q % 19 = 0 THEN 'empty TIFF tiles' END AS error,
         l_orderkey % 3 = 0 AS rgb_grid, (l_orderkey % 50 + l_orderkey // 50 % 3) % 7 = 6 AS synthetic
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS frame FROM lineitem))"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide, tool, label, profile, scope, run_index, status, seconds, seq, system_label, output_dir, stdout_path, source_path): one row per order."""
    return table(spark, sf_dir, "orders").select(
        F.expr("concat('slide-', o_custkey % 50)").alias("slide"),
        F.expr("case o_orderkey % 3 when 0 then 'cpu' when 1 then 'device' else 'baseline' end").alias("tool"),
        F.expr("case when o_orderkey % 10 = 0 then 'given label' end").alias("label"),
        F.col("o_orderpriority").alias("profile"), F.expr("if(o_custkey % 2 = 0, 'base', 'full')").alias("scope"), F.expr("1 + o_custkey % 3").alias("run_index"),
        F.expr("case o_orderstatus when 'F' then 'passed' when 'O' then 'failed' else 'timeout' end").alias("status"),
        F.col("o_totalprice").alias("seconds"), F.col("o_orderkey").alias("seq"),
        F.expr("case o_custkey % 4 when 0 then 'Linux' when 1 then 'Darwin' end").alias("system_label"),
        F.expr("concat('/out/', case o_custkey % 5 when 0 then 'CUDA' when 1 then 'metal' else 'plain' end)").alias("output_dir"),
        F.expr("case o_custkey % 7 when 0 then '/logs/NVIDIA.txt' when 1 then '/logs/x.txt' end").alias("stdout_path"), F.expr("case o_custkey % 11 when 0 then '/darwin/a.svs' end").alias("source_path"),
    )


TRIALS_SQL = """trials AS (
  SELECT 'slide-' || (o_custkey % 50) AS slide, CASE o_orderkey % 3 WHEN 0 THEN 'cpu' WHEN 1 THEN 'device' ELSE 'baseline' END AS tool,
         CASE WHEN o_orderkey % 10 = 0 THEN 'given label' END AS label, o_orderpriority AS profile,
         CASE WHEN o_custkey % 2 = 0 THEN 'base' ELSE 'full' END AS scope, 1 + o_custkey % 3 AS run_index,
         CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'timeout' END AS status,
         o_totalprice AS seconds, o_orderkey AS seq, CASE o_custkey % 4 WHEN 0 THEN 'Linux' WHEN 1 THEN 'Darwin' END AS system_label,
         '/out/' || CASE o_custkey % 5 WHEN 0 THEN 'CUDA' WHEN 1 THEN 'metal' ELSE 'plain' END AS output_dir,
         CASE o_custkey % 7 WHEN 0 THEN '/logs/NVIDIA.txt' WHEN 1 THEN '/logs/x.txt' END AS stdout_path, CASE o_custkey % 11 WHEN 0 THEN '/darwin/a.svs' END AS source_path
  FROM orders)"""


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle, type, id, body): a report, a patient, specimens and requests by order, as JSON resources."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    report = o.select(F.col("o_orderkey").alias("bundle"), F.lit("DiagnosticReport").alias("type"), F.concat(F.lit("r"), "o_orderkey").alias("id"), F.expr(
        """concat('{"subject":{"reference":"Patient/p', o_custkey, '"},"specimen":[{"reference":"Specimen/k', o_orderkey % 2, '"}],"basedOn":[{"reference":"ServiceRequest/s', o_orderkey % 7, '"}],"code":{"text":"report ', o_orderkey % 5, '"}}')""").alias("body"))  # fmt: skip
    patient = o.select(F.col("o_orderkey").alias("bundle"), F.lit("Patient").alias("type"), F.concat(F.lit("p"), "o_custkey").alias("id"), F.expr(
        """concat('{"identifier":[{"value":"', o_custkey, '"}],"birthDate":"19', 50 + o_custkey % 50, '-01-02","gender":"', case o_custkey % 4 when 0 then 'male' when 1 then 'female' when 2 then 'other' else '' end, '","name":[{"family":"F', o_custkey % 9, '","given":["A","B"]}]}')""").alias("body"))  # fmt: skip
    # ids and bodies follow from the remainders, so distinct rows are found by two numbers
    kinds = lambda n: li.select(F.col("l_orderkey").alias("bundle"), F.expr(f"l_suppkey % {n}").alias("k")).distinct()
    request = kinds(7).select("bundle", F.lit("ServiceRequest").alias("type"), F.expr("concat('s', k)").alias("id"), F.lit('{"requisition":{"value":"q"}}').alias("body"))
    specimen = kinds(2).select("bundle", F.lit("Specimen").alias("type"), F.expr("concat('k', k)").alias("id"), F.expr("""concat('{"accessionIdentifier":{"value":"', if(bundle % 3 = 0, '', concat('A', bundle)), '"},"type":{"text":"tissue ', k, '"}}')""").alias("body"))
    return report.union(patient).union(request).union(specimen)


#: What the resources have, a table for each type, without JSON.
RESOURCES_SQL = """report AS MATERIALIZED (
  SELECT o_orderkey AS bundle, 'r' || o_orderkey AS id, 'p' || o_custkey AS subject, 'k' || (o_orderkey % 2) AS specimen, 's' || (o_orderkey % 7) AS request, 'report ' || (o_orderkey % 5) AS code FROM orders),
patient AS MATERIALIZED (
  SELECT o_orderkey AS bundle, 'p' || o_custkey AS id, CAST(o_custkey AS VARCHAR) AS patient_id, 'F' || (o_custkey % 9) || '^A B' AS patient_name, '19' || (50 + o_custkey % 50) || '0102' AS birth_date,
         CASE o_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'O' END AS sex FROM orders),
request AS MATERIALIZED (SELECT DISTINCT l_orderkey AS bundle, 's' || (l_suppkey % 7) AS id FROM lineitem),
specimen AS MATERIALIZED (
  SELECT DISTINCT l_orderkey AS bundle, 'k' || (l_suppkey % 2) AS id, CASE WHEN l_orderkey % 3 = 0 THEN 'k' || (l_suppkey % 2) ELSE 'A' || l_orderkey END AS specimen_id, 'tissue ' || (l_suppkey % 2) AS kind FROM lineitem)"""
