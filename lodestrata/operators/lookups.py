"""Lookups and references: manifests, clinical resources, resumed trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_match(slides: DataFrame, manifest: DataFrame) -> DataFrame:
    """Left lookup of slides (slide, path) in a manifest (position, file_id, filename): same path, else folder is the file id, else same base name.

    Three equi-joins instead of one OR; the lowest tier, then the first manifest row, wins. The manifest is reduced to the first row of each
    key before a join, so a slide meets one row a tier, however many share a name.
    """
    s = slides.withColumns({"folder": F.element_at(F.split("path", "/"), -2), "base": F.lower(F.element_at(F.split("path", "/"), -1))})
    m = manifest.withColumn("base", F.lower(F.element_at(F.split("filename", "/"), -1)))
    for tier, (own, other) in enumerate((("path", "filename"), ("folder", "file_id"), ("base", "base")), 1):
        first = m.groupBy(F.col(other).alias(own)).agg(F.min(F.struct(F.lit(tier).alias("tier"), "position", "file_id")).alias(f"m{tier}"))
        s = s.join(first, own, "left")
    return s.withColumn("m", F.coalesce("m1", "m2", "m3")).select("slide", "m.tier", "m.file_id")


def reference(path: str, body: str = "body") -> Column:
    return F.nullif(F.get_json_object(body, path), F.lit(""))


#: What a report refers to: the type, the name of the reference, and what an unreferenced one is called; in the order in which rules are checked.
REFERENCED = (("Patient", "subject", "patient"), ("Specimen", "specimen", "specimen"), ("ServiceRequest", "request", "request"))


def report_references(resources: DataFrame) -> DataFrame:
    """(bundle, subject, specimen, request) of reports; of specimens and requests a report must name exactly one, else the name is null."""
    return resources.where("type = 'DiagnosticReport'").select("bundle", *(c.alias(name) for (_, name, _), c in zip(REFERENCED, referred())))


def referred(body: str = "body") -> tuple[Column, Column, Column]:
    """The names of the patient, the specimen and the request that a report refers to."""
    several = lambda field: F.from_json(F.get_json_object(body, f"$.{field}"), "array<struct<reference:string>>")
    only = lambda field: F.when(F.size(several(field)) == 1, F.nullif(several(field)[0]["reference"], F.lit("")))
    return reference("$.subject.reference", body), only("specimen"), only("basedOn")


def resolve_references(resources: DataFrame) -> DataFrame:
    """One row per bundle: the patients, specimens and requests it has and its references hit, and `error`, the first broken rule or null.

    Rules: one report; then for each reference: it is there and names the right type; no resource of that type is left unreferenced; it hits one.
    """
    names = [name for _, name, _ in REFERENCED]
    reports = report_references(resources).groupBy("bundle").agg(F.count("*").alias("reports"), *(F.min(n).alias(n) for n in names))
    keyed = resources.select("bundle", "type", F.concat_ws("/", "type", "id").alias("name"))
    named = keyed.join(reports, "bundle", "left")
    counts = [c for type_, name, word in REFERENCED for c in (F.count_if(F.col("name") == F.col(name)).alias(f"{word}s_hit"), F.count_if(F.col("type") == type_).alias(f"{word}s"))]
    hits = named.groupBy("bundle").agg(F.coalesce(F.max("reports"), F.lit(0)).alias("reports"), *(F.max(n).alias(n) for n in names), *counts)
    error = F.when(F.col("reports") != 1, "needs one report")
    for type_, name, word in REFERENCED:
        error = error.when(F.col(name).isNull() | ~F.startswith(name, F.lit(f"{type_}/")), f"bad {name}")
        error = error.when(F.col(f"{word}s") > F.col(f"{word}s_hit"), f"unreferenced {word}").when(F.col(f"{word}s_hit") != 1, f"{name} not found once")
    return hits.select("bundle", *(c for _, _, word in REFERENCED for c in (f"{word}s_hit", f"{word}s")), error.alias("error"))


def unreferenced(resources: DataFrame) -> DataFrame:
    """(bundle, type, id) of patients, specimens and requests that no report of the bundle refers to."""
    refs = report_references(resources).select("bundle", F.explode(F.array(*(name for _, name, _ in REFERENCED))).alias("name"))
    keyed = resources.where("type <> 'DiagnosticReport'").withColumn("name", F.concat_ws("/", "type", "id"))
    return keyed.join(refs, ["bundle", "name"], "left_anti").select("bundle", "type", "id")


def patient_fields(resources: DataFrame) -> DataFrame:
    """(bundle, patient_id, patient_name, birth_date, sex) of patients."""
    return resources.where("type = 'Patient'").select("bundle", *patient_columns())


def patient_columns(id: str = "id", body: str = "body") -> tuple[Column, ...]:
    family = reference("$.name[0].family", body)
    given = F.array_join(F.from_json(F.get_json_object(body, "$.name[0].given"), "array<string>"), " ")
    sex = F.create_map(*(F.lit(x) for x in ("male", "M", "female", "F", "other", "O", "unknown", "U")))[F.get_json_object(body, "$.gender")]
    return (
        F.coalesce(reference("$.identifier[0].value", body), id).alias("patient_id"), F.when(family.isNotNull(), F.concat_ws("^", family, F.nullif(given, F.lit("")))).alias("patient_name"),
        F.replace(F.get_json_object(body, "$.birthDate"), F.lit("-"), F.lit("")).alias("birth_date"), sex.alias("sex"),
    )


CELL = ["slide", "tool", "profile", "scope", "run_index"]


def resume_plan(planned: DataFrame, recorded: DataFrame) -> DataFrame:
    """Planned trials without any recorded row; failed ones count as done."""
    keys = recorded.where(F.col("slide").isNotNull() & F.col("tool").isNotNull()).select("slide", "tool", F.coalesce("profile", F.lit("")).alias("profile"), F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce("run_index", F.lit(1)).alias("run_index"))
    return planned.join(keys.distinct(), CELL, "left_anti")


def upsert_latest(decisions: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last decision of each key, by partial maxima; undecided ones do not replace others."""
    rest = [c for c in decisions.columns if c not in key]
    last = decisions.where("decision <> 'undecided'").groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*key, "_last.*").select(*decisions.columns)


def trials_of_cells(trials: DataFrame, cells: DataFrame) -> DataFrame:
    """The trials of the cells (slide, profile, scope) that have any row in `cells`."""
    keys = ["slide", "profile", "scope"]
    return trials.join(cells.select(*keys).distinct(), keys, "left_semi")


def select_slides(slides: DataFrame, filters: list[str], columns: list[str], *, order: str, most: int | None = None) -> DataFrame:
    """The slides of which, for every filter, some column has it as a part, whatever the case; in order, the first `most` of them."""
    chosen = slides
    for f in filters:
        has = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(f.lower())), F.lit(False)) for c in columns]
        chosen = chosen.where(reduce(lambda a, b: a | b, has))
    return chosen if most is None else chosen.orderBy(order).limit(most)
