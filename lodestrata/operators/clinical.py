"""Clinical metadata from JSON: bundles unnested, resources mapped to fields, one row of fields a bundle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import dims
from lodestrata.functions.scalars import json_text
from lodestrata.operators.lookups import REFERENCED, patient_columns, reference, referred

MAX_JSON_BYTES = 16 << 20


def is_clinical(body: Column) -> Column:
    return F.coalesce(json_text(body, "$.resourceType").isin(*dims.RESOURCE_TYPES), F.lit(False))


def too_large(body: Column) -> Column:
    return F.octet_length(body) > MAX_JSON_BYTES


def bundle_resources(documents: DataFrame, key: str = "bundle", body: str = "body") -> DataFrame:
    """(bundle, pos, type, id, body): resources of `entry`, those without one left out; another resource stands for itself."""
    b = F.col(body)
    entries = F.from_json(F.get_json_object(b, "$.entry"), "array<struct<resource:string>>")
    found = F.when(json_text(b, "$.resourceType") == "Bundle", F.transform(entries, lambda e: e["resource"])).otherwise(F.array(b))
    rows = documents.select(F.col(key).alias("bundle"), F.posexplode(found).alias("pos", "body")).where("body is not null")
    return rows.select("bundle", "pos", json_text(F.col("body"), "$.resourceType").alias("type"), json_text(F.col("body"), "$.id").alias("id"), "body")


def specimen_columns(id: str = "id", body: str = "body") -> tuple[Column, ...]:
    """specimen_id, container_id, specimen_description; the container has the specimen's name."""
    name = F.coalesce(reference("$.accessionIdentifier.value", body), reference("$.identifier[0].value", body), id)
    return name.alias("specimen_id"), name.alias("container_id"), reference("$.type.text", body).alias("specimen_description")


def request_columns(id: str = "id", body: str = "body") -> tuple[Column, ...]:
    return F.coalesce(reference("$.identifier[0].value", body), reference("$.requisition.value", body), id).alias("accession_number"), reference("$.code.text", body).alias("request_text")


def report_columns(id: str = "id", body: str = "body") -> tuple[Column, ...]:
    return F.coalesce(reference("$.identifier[0].value", body), id).alias("study_id"), reference("$.code.text", body).alias("report_text")


def _once(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """Adds columns that are worked out once a row: filters on them stay behind the generator, so they do not repeat the parsing."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def metadata(resources: DataFrame) -> DataFrame:
    """One row per bundle without a broken reference and with a patient's id and name: patient, specimen, accession, study; the report's text wins over the request's.

    By the rules of `resolve_references` such a bundle has one report, patient, specimen and request each, so all meet in one grouping by bundle, and JSON is parsed of those
    bundles alone. A row without one of these types may still have the name of one, and then counts as a hit.
    """
    kinds = {"report": "DiagnosticReport"} | {word: type_ for type_, _, word in REFERENCED}
    name = F.concat_ws("/", "type", "id")
    is_other = ~F.coalesce(F.col("type").isin(*kinds.values()), F.lit(False)) & name.rlike(f"^({'|'.join(t for t, _, _ in REFERENCED)})/")
    of = lambda type_, c: F.min(F.when(F.col("type") == type_, c))
    bundles = resources.where("bundle is not null").repartition("bundle").groupBy("bundle").agg(
        *(F.count_if(F.col("type") == t).alias(f"{k}s") for k, t in kinds.items()), *(of(t, F.struct("id", "body")).alias(k) for k, t in kinds.items()), F.collect_list(F.when(is_other, name)).alias("others"),
    )
    one_each = bundles.where(" and ".join(f"{k}s = 1" for k in kinds))
    named = _once(one_each, [c.alias(f"{n}_name") for (_, n, _), c in zip(REFERENCED, referred("report.body"))])
    hits = lambda type_, ref, k: (F.concat_ws("/", F.lit(type_), f"{k}.id") == ref).cast("int") + F.size("others") - F.size(F.array_remove("others", ref))
    good = reduce(lambda rows, r: rows.where(F.startswith(f"{r[1]}_name", F.lit(f"{r[0]}/")) & (hits(r[0], F.col(f"{r[1]}_name"), r[2]) == 1)), REFERENCED, named)
    columns = (("patient", patient_columns), ("specimen", specimen_columns), ("request", request_columns), ("report", report_columns))
    found = _once(good, [c for k, of_kind in columns for c in of_kind(f"{k}.id", f"{k}.body")])
    strict = (F.coalesce("patient_id", F.lit("")) != "") & (F.coalesce("patient_name", F.lit("")) != "")
    return found.where(strict).select(
        "bundle", "patient_id", "patient_name", "birth_date", "sex", "specimen_id", "container_id", "specimen_description", "accession_number", "study_id",
        F.coalesce("report_text", "request_text").alias("study_description"),
    )


def placeholder(spark: SparkSession) -> DataFrame:
    from lodestrata.plans.export import PLACEHOLDER

    return spark.createDataFrame([tuple(PLACEHOLDER.values())], ", ".join(f"{k} string" for k in PLACEHOLDER))


def colour_profile(own: Column, sampled: Column, distinct_samples: Column, policy: Column) -> Column:
    """struct(source, error): the dataset's profile, else one that all samples share, else what the policy says."""
    by_policy = F.when(policy == "srgb", "synthesized_srgb").when(policy == "p3", "synthesized_display_p3").when(policy == "omit", "omitted")
    source = F.when(F.octet_length(own) > 0, "source").when(sampled.isNotNull() & (distinct_samples <= 1), "source_jpeg").when(sampled.isNull(), by_policy)
    error = F.when((F.octet_length(own) > 0) | ((sampled.isNotNull()) & (distinct_samples <= 1)), F.lit(None).cast("string")).when(sampled.isNotNull(), "samples differ").when(policy == "error", "profile is missing")
    return F.struct(source.alias("source"), error.alias("error"))
