"""Which sessions are running on this machine: operating-system state, taken once and passed on as a table."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession


def _started(pid: int) -> int | None:
    """Start time of a process in clock ticks since boot, or None if it does not run."""
    try:
        with open(f"/proc/{pid}/stat") as f:
            return int(f.read().rpartition(")")[2].split()[19])
    except (OSError, ValueError, IndexError):
        return None


def snapshot(spark: SparkSession, registrations: dict[str, str]) -> DataFrame:
    """(agent, session_id, protection) from registration files {pid, sessionId, startTicks?} in each producer's directory.

    A process id that now belongs to a later process does not count; files that cannot be read protect nothing.
    """
    rows = []
    for agent, directory in registrations.items():
        for path in sorted(glob.glob(os.path.join(directory, "*.json"))):
            try:
                with open(path) as f:
                    r = json.load(f)
                pid, session = int(r["pid"]), str(r["sessionId"])
            except (OSError, ValueError, KeyError, TypeError):
                continue
            ticks = _started(pid)
            if ticks is not None and r.get("startTicks") in (None, ticks):
                rows.append((agent, session, f"running as process {pid}"))
    return spark.createDataFrame(rows, "agent string, session_id string, protection string")
