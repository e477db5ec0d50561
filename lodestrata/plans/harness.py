"""The benchmark harness: planned trials, runs with a time limit, resumed and merged results, summaries on disk."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import reports
from lodestrata.operators.lookups import resume_plan
from lodestrata.operators.validation import Runner


def planned(slides: DataFrame, *, tools: dict[str, list[str]], profiles: list[str], scopes: list[str], runs: int = 1) -> DataFrame:
    """Trials of slides (slide, path): every tool, profile, scope and run, with the command; {path}, {profile}, {scope} and {output} are replaced."""
    settings = [(t, json.dumps(c), p, s, r) for t, c in tools.items() for p in profiles for s in scopes for r in range(1, runs + 1)]
    kinds = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(c).alias("command"), F.lit(p).alias("profile"), F.lit(s).alias("scope"), F.lit(r).alias("run_index")) for t, c, p, s, r in settings))
    rows = slides.withColumn("k", F.explode(kinds)).select("slide", "path", "k.*")
    output = F.concat_ws("/", "slide", "tool", "profile", "scope", F.col("run_index").cast("string"))
    command = F.col("command")
    for name in ("path", "profile", "scope"):
        command = F.replace(command, F.lit("{" + name + "}"), F.col(name))
    return rows.withColumn("output_dir", output).withColumn("command", F.replace(command, F.lit("{output}"), F.col("output_dir")))


def run_trials(trials: DataFrame, *, timeout: float = 7200, runner: Runner | None = None) -> DataFrame:
    """Runs the commands where their rows are: status (passed, failed, timeout), return code, seconds and the first line of what was said."""
    runner = runner or Runner()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for command in rows["command"]:
                began = time.monotonic()
                code, said = runner.run(json.loads(command), timeout)
                line = next((x.strip() for x in said.split("\n") if x.strip()), None)
                found.append(("timeout" if code is None else "passed" if code == 0 else "failed", code, time.monotonic() - began, None if code == 0 else line))
            out = pd.DataFrame(found, columns=["status", "returncode", "seconds", "error"])
            yield pd.concat([rows[["slide", "tool", "profile", "scope", "run_index", "output_dir"]].reset_index(drop=True), out], axis=1)

    return trials.mapInPandas(run, "slide string, tool string, profile string, scope string, run_index int, output_dir string, status string, returncode int, seconds double, error string")


def resumed(trials: DataFrame, recorded: DataFrame) -> DataFrame:
    """Trials that have no recorded row."""
    return resume_plan(trials, recorded)


def _ratio(a: float | None, b: float | None) -> str:
    return "" if a is None or b is None or b <= 0 else f"{a / b:.2f}x"


def markdown_lines(trials: DataFrame, title: str = "Trials") -> Iterator[str]:
    """Lines of a table with a row a cell: status and seconds of every label, and how often faster each device is than CPU and baseline.

    A label without a row of a cell is `missing`. Rows come one partition at a time, so a long report needs no long list.
    """
    labels = [r["result_label"] for r in reports.summary(trials).select("rank", "result_label").distinct().orderBy("rank", "result_label").collect()]
    devices = {r["result_label"] for r in trials.where("tool = 'device'").select("result_label").distinct().collect()}
    against = [(d, x) for d in labels if d in devices for x in ("CPU", "Baseline") if x in labels]
    head = ["Slide", "Profile", "Scope", *(f"{x} {w}" for x in labels for w in ("status", "seconds")), *(f"{d} vs {x}" for d, x in against)]
    rule = ["---"] * 3 + ["---", "---:"] * len(labels) + ["---:"] * len(against)
    yield from (f"# {title}", "", "| " + " | ".join(head) + " |", "| " + " | ".join(rule) + " |")
    for r in reports.by_label(trials).orderBy(*reports.CELL).toLocalIterator():
        seconds = {x: v["seconds"] for x, v in r["labels"].items()}
        cells = [r[c] or "" for c in reports.CELL]
        for x in labels:
            v = r["labels"].get(x)
            cells += ["missing", ""] if v is None else [v["status"] or "failed", "" if v["seconds"] is None else f"{v['seconds']:.3f}"]
        yield "| " + " | ".join([*cells, *(_ratio(seconds.get(x), seconds.get(d)) for d, x in against)]) + " |"


def write_summary(trials: DataFrame, out: str, title: str = "Trials") -> None:
    """Appends to results (JSON lines), and makes results.csv (the fixed columns) and summary.md of all that is there; below a folder of the driver or a mounted one."""
    named = reports.with_label(trials)
    named.write.mode("append").json(f"{out}/results")
    named = trials.sparkSession.read.schema(named.schema).json(f"{out}/results")
    reports.to_csv_columns(named).write.mode("overwrite").option("header", True).csv(f"{out}/results.csv")
    target = os.path.join(out.removeprefix("file://"), "summary.md")
    with open(f"{target}.new", "w") as f:
        f.writelines(line + "\n" for line in markdown_lines(named, title))
    os.replace(f"{target}.new", target)


def report_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, report, error): one row per JSON report; empty or damaged ones have an error text."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("report"))
    bad = F.when(F.trim("report") == "", "empty").when(F.try_parse_json("report").isNull(), "no JSON")
    return raw.select("path", F.when(bad.isNull(), F.col("report")).alias("report"), bad.alias("error"))
