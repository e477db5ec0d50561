"""Queries of whole plans, binary headers and streams, with DuckDB SQL for the same rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import binary
from lodestrata.operators import metrics
from lodestrata.plans import adapters
from lodestrata.plans.export import Export, route_coverage
from lodestrata.streaming.iterations import windowed_rates


def codestream_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progression order of generated codestreams, one a part."""
    order = F.lpad(F.hex(F.col("p_size") % 5), 2, "0")
    raw = F.unhex(F.concat(F.lit("FF4FFF510004AAAAFF52000400"), order, F.lit("FF90")))
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("progression"), raw.alias("raw"))
    return rows.select("p_partkey", "progression", binary.is_rpcl(F.col("raw")).alias("rpcl"), binary.be_u16(F.col("raw"), 0).alias("soc"))


def export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of all sources with transfer syntax, path and UIDs."""
    plan = Export(adapters.levels(spark, sf_dir), adapters.frame_probes(spark, sf_dir)).to_directory("out").with_placeholder_metadata().plan("seed")
    return plan.select("source", "level", "z", "c", "t", "instance_number", "frames", "syntax", "path", "sop_uid", "series_uid", "frame_of_reference_uid")


def bounded_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the first 64 frames of each level, and whether these are all."""
    return route_coverage(adapters.frame_probes(spark, sf_dir))


def _shared_folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        where = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return where.rstrip("/")


def streaming_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of events by window through a stream that reads the table once. Each batch replaces the whole result, written by executors."""
    path, out = f"{sf_dir}/events.parquet", f"{_shared_folder(spark)}/rates-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # a stream reads folders
    rates = windowed_rates(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    write = lambda rows, _: rows.write.mode("overwrite").parquet(f"{out}/rates")
    query = rates.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(rates.schema).parquet(f"{out}/rates")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "frames", F.round("total", 6).alias("total"))


def _uid_sql(role: str, *keys: str) -> str:
    text = " || ':' || ".join(["'seed'", "source", f"'{role}'", *keys])
    return f"'2.25.' || CAST(CAST('0x' || substr(sha256({text}), 1, 32) AS UHUGEINT) AS VARCHAR)"


def sql(jobs: str, routed: str, default: str, sums: str) -> dict[str, str]:
    """SQL by query, from parts that the catalogue shares: WITH lists of jobs and of routed frames, the default syntaxes, and sums of routed frames."""
    totals = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in metrics.SUMS)
    return {
        "codestream_markers": "SELECT p_partkey, p_size % 5 AS progression, p_size % 5 = 2 AS rpcl, 65359 AS soc FROM part",
        "export_plan": f"""WITH {jobs}, syntaxes AS ({default})
SELECT j.source, level, z, c, t, ordinal + 1 AS instance_number, (cols + 511) // 512 * ((rows + 511) // 512) AS frames, coalesce(s.syntax, 'Htj2kLosslessRpcl') AS syntax,
 'scene-' || scene || '-series-' || series || '-level-' || level || '-z' || z || '-c' || c || '-t' || t || '.dcm' AS path, {_uid_sql("instance", "scene", "series", "level", "z", "c", "t").replace("source", "j.source")} AS sop_uid,
 {_uid_sql("series", "scene", "series", "z", "c", "t").replace("source", "j.source")} AS series_uid, {_uid_sql("frame", "scene", "series").replace("source", "j.source")} AS frame_of_reference_uid
FROM jobs j LEFT JOIN syntaxes s ON s.source = j.source""",
        "bounded_coverage": f"""WITH {routed}, n AS (SELECT source, level, count(*) AS available FROM routed GROUP BY source, level),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, level ORDER BY instance, frame) AS nth FROM routed) WHERE nth <= 64),
m AS (SELECT source, level, {sums} FROM b GROUP BY source, level)
SELECT source, level, CAST(grouping(source, level) AS BIGINT) AS grain, CAST(sum(available) AS BIGINT) AS available, {totals}, sum(total_frames) >= sum(available) AS complete FROM m JOIN n USING (source, level) GROUP BY ROLLUP (source, level)""",
        "streaming_iterations": """SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS frames, round(sum(value), 6) AS total FROM events GROUP BY ALL""",
    }


QUERIES = {f.__name__: f for f in (codestream_markers, export_plan, bounded_coverage, streaming_iterations)}
