"""Recording the steps of a job: status, times, rows in and out, error."""

from __future__ import annotations

import json
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..scratch import observed

STEP_COLUMNS = (
    "run_id string, pipeline string, name string, status string, started_at timestamp_ntz, "
    "finished_at timestamp_ntz, duration_ms bigint, rows_in bigint, rows_out bigint, error string"
)


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass
class Step:
    """One step. Rows are counted while the data flows by, without a job of their own."""

    name: str
    status: str = "running"
    started_at: datetime = field(default_factory=_now)
    finished_at: datetime | None = None
    error: str | None = None
    _in: Observation | None = None
    _out: Observation | None = None

    def reading(self, df: DataFrame) -> DataFrame:
        self._in = Observation()
        return df.observe(self._in, F.count(F.lit(1)).alias("rows"))

    def writing(self, df: DataFrame) -> DataFrame:
        self._out = Observation()
        return df.observe(self._out, F.count(F.lit(1)).alias("rows"))

    def rows(self, observation: Observation | None) -> int | None:
        # A failed step may never have run its query; asking would wait for ever.
        return observed(observation, "rows") if observation and self.status == "success" else None


class StepLog:
    """The steps of one run; an exception marks its step failed and passes on."""

    def __init__(self, pipeline: str, run_id: str):
        self.pipeline = pipeline
        self.run_id = run_id
        self.steps: list[Step] = []

    @contextmanager
    def step(self, name: str):
        step = Step(name)
        self.steps.append(step)
        try:
            yield step
            step.status = "success"
        except Exception as e:
            step.status = "failed"
            step.error = f"{type(e).__name__}: {e}"
            raise
        finally:
            step.finished_at = _now()

    def rows(self) -> list[tuple]:
        return [
            (
                self.run_id,
                self.pipeline,
                s.name,
                s.status,
                s.started_at,
                s.finished_at,
                int((s.finished_at - s.started_at).total_seconds() * 1000) if s.finished_at else None,
                s.rows(s._in),
                s.rows(s._out),
                s.error,
            )
            for s in self.steps
        ]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), STEP_COLUMNS)

    def trace(self) -> str:
        """The same as JSON text, the shape ``explode_steps`` reads back."""
        names = [c.split()[0] for c in STEP_COLUMNS.split(", ")][2:]
        steps = [dict(zip(names, row[2:])) for row in self.rows()]
        for step in steps:
            if step["error"]:
                kind, _, message = step["error"].partition(": ")
                step["error"] = {"type": kind, "message": message}
        return json.dumps({"run_id": self.run_id, "pipeline": self.pipeline, "steps": steps}, default=str)
