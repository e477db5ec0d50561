"""Bounded listing of files, and tables of text files."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Folder(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class BoundedListing(DataSource):
    """`spark.read.format("bounded_listing")`: path and length of files below a local or mounted root, in order of path.

    Options: path, suffixes (comma-separated, case does not matter), max_depth (64), max_files (100000), strict_empty.
    Symbolic links, too deep folders and too many files are errors; nothing is cut short.
    """

    @classmethod
    def name(cls) -> str:
        return "bounded_listing"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> DataSourceReader:
        return _Listing(self.options)


class _Listing(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://")
        self.suffixes = tuple("." + s.strip().lower().lstrip(".") for s in options.get("suffixes", "").split(",") if s.strip())
        self.depth, self.most = int(options.get("max_depth", 64)), int(options.get("max_files", 100_000))
        self.strict = options.get("strict_empty", "false") == "true"

    def _wanted(self, path: str) -> bool:
        stem, end = os.path.splitext(os.path.basename(path))
        return not self.suffixes or bool(stem) and end.lower() in self.suffixes

    def found(self) -> list[str]:
        if os.path.islink(self.root):
            raise ValueError(f"{self.root} is a symbolic link")
        if os.path.isfile(self.root):
            return [self.root] if self._wanted(self.root) else []
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is neither file nor folder")
        out, stack = [], [(self.root, 0)]
        while stack:
            folder, depth = stack.pop()
            for e in os.scandir(folder):
                if e.is_symlink():
                    raise ValueError(f"{e.path} is a symbolic link")
                if e.is_dir():
                    if depth + 1 > self.depth:
                        raise ValueError(f"{e.path} is deeper than {self.depth}")
                    stack.append((e.path, depth + 1))
                elif e.is_file() and self._wanted(e.path):
                    out.append(e.path)
                    if len(out) > self.most:
                        raise ValueError(f"more than {self.most} files")
        return sorted(out)

    def partitions(self) -> list[InputPartition]:
        paths = self.found()
        if self.strict and not paths:
            raise ValueError(f"no file in {self.root}")
        return [_Folder(paths[i : i + 1000]) for i in range(0, len(paths), 1000)] or [_Folder([])]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        for p in partition.paths:
            yield p, os.path.getsize(p)


MANIFEST = ("id", "filename", "md5", "size", "state")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated manifest with a header: missing columns are empty, sizes that are no number null, blank lines dropped; quotes mean nothing."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    rows = rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in MANIFEST))
    return rows.withColumn("size", F.col("size").try_cast("bigint"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a fixed schema; what is no JSON is an all-null row with the text in `_damaged`."""
    return spark.read.schema(f"{schema}, _damaged string").option("columnNameOfCorruptRecord", "_damaged").json(path)


def read_result_sets(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Result lines of several folders, each with the folder's name as its set."""
    from lodestrata.operators.reports import merge_results

    return merge_results([(os.path.basename(p.rstrip("/")), read_json_lines(spark, f"{p}/results.jsonl", schema)) for p in paths])


def file_totals(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def first_line(text):
    """First line that is not blank, trimmed."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
