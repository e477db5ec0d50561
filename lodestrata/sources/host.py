"""One-row tables of the driver's host: versions, memory, commands."""

from __future__ import annotations

import os
import platform
import resource
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession


def command_output(command: list[str], timeout: float = 5) -> str | None:
    """Trimmed output of a command; None if it fails, is missing or takes too long."""
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() or None


def resident_bytes() -> int:
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError):
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


def environment(spark: SparkSession) -> DataFrame:
    row = (platform.system(), platform.machine(), sys.version.split()[0], spark.version, os.cpu_count() or 1, resident_bytes(), command_output(["git", "--version"]))
    return spark.createDataFrame([row], "system string, machine string, python string, spark string, cpus int, resident_bytes long, git string")
