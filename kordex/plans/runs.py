"""Runs: a table of states on the driver, and jobs that can be cancelled."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

STATES = ("queued", "running", "completed", "failed", "interrupted")
_NEXT = {"queued": {"running", "failed", "interrupted"}, "running": {"completed", "failed", "interrupted"}}


class Runs:
    """One JSON file a run in a folder; each change replaces the file whole."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, run: str) -> Path:
        return self.folder / f"{run}.json"

    def _write(self, record: dict) -> dict:
        record["updated_at"] = dt.datetime.now(dt.UTC).isoformat()
        part = self._path(record["run_id"]).with_suffix(".part")
        part.write_text(json.dumps(record, ensure_ascii=False), encoding="utf-8")
        part.replace(self._path(record["run_id"]))
        return record

    def create(self, **settings) -> dict:
        now = dt.datetime.now(dt.UTC).isoformat()
        return self._write({"run_id": uuid.uuid4().hex, "state": "queued", "created_at": now, "settings": settings})

    def get(self, run: str) -> dict:
        return json.loads(self._path(run).read_text(encoding="utf-8"))

    def move(self, run: str, state: str, **more) -> dict:
        record = self.get(run)
        if state not in _NEXT.get(record["state"], set()):
            raise ValueError(f"a run cannot go from {record['state']} to {state}")
        return self._write(record | more | {"state": state})

    def progress(self, run: str, **values) -> dict:
        return self._write(self.get(run) | {"progress": values})

    def newest(self, limit: int = 20) -> list[dict]:
        found = [json.loads(p.read_text(encoding="utf-8")) for p in self.folder.glob("*.json")]
        return sorted(found, key=lambda r: r["created_at"], reverse=True)[:limit]

    def interrupt_stale(self, older_than: dt.timedelta) -> list[str]:
        """Runs that say they are running but have not been touched for long are interrupted."""
        edge = dt.datetime.now(dt.UTC) - older_than
        stale = [r["run_id"] for r in self.newest(10**9) if r["state"] == "running" and dt.datetime.fromisoformat(r["updated_at"]) < edge]
        for run in stale:
            self.move(run, "interrupted", reason="stale")
        return stale


def run_job(spark: SparkSession, runs: Runs, run: str, work: Callable[[], dict]) -> dict:
    """work() as a job group named after the run, so that cancel() stops its tasks; the run's state follows."""
    runs.move(run, "running")
    spark.sparkContext.setJobGroup(run, f"run {run}", interruptOnCancel=True)
    try:
        return runs.move(run, "completed", result=work())
    except Exception as e:
        stopped = "cancelled" in str(e).lower()
        runs.move(run, "interrupted" if stopped else "failed", reason=str(e)[:500])
        raise
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, run: str) -> None:
    spark.sparkContext.cancelJobGroup(run)
