"""Steps as jobs of their own: one that fails or takes too long leaves a flag instead of ending the query."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from passagework.plans.shared import shared_folder


@dataclass(frozen=True)
class Status:
    """How a step ended: ``ok``, ``failed`` or ``timed out``; what it said, and its seconds."""

    step: str
    status: str
    error: str | None
    seconds: float


@dataclass
class Watch:
    """Runs steps and keeps their statuses. ``seconds``: how long a step may take."""

    seconds: float = 600.0
    statuses: list[Status] = field(default_factory=list)

    @property
    def degraded(self) -> list[str]:
        """The steps that gave nothing, each once."""
        return sorted({s.step for s in self.statuses if s.status != "ok"})

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, status, error, seconds), a row for each step that was run."""
        return spark.createDataFrame([(s.step, s.status, s.error, s.seconds) for s in self.statuses], "step string, status string, error string, seconds double")

    def run(self, spark: SparkSession, steps: dict[str, Callable[[], DataFrame]], fallback: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
        """Each step's rows, written to the shared folder and read again; ``fallback(name)`` for a step without any.

        All steps run at once, each in a thread with a job tag of its own. A step that is late has its jobs cancelled; what
        it writes after that is never read, as its rows count only once its thread has ended in time.
        """
        folder, done, schemas = shared_folder(spark, "watched"), {}, {}
        tags = {name: f"{name}-{uuid.uuid4().hex}" for name in steps}

        def work(name: str) -> None:
            began = time.monotonic()
            spark.sparkContext.addJobTag(tags[name])
            spark.sparkContext.setInterruptOnCancel(True)
            try:
                rows = steps[name]()
                rows.write.parquet(f"{folder}/{name}")
                schemas[name] = rows.schema
                done.setdefault(name, Status(name, "ok", None, time.monotonic() - began))
            except Exception as error:
                done.setdefault(name, Status(name, "failed", f"{type(error).__name__}: {error}"[:500], time.monotonic() - began))

        threads = {name: InheritableThread(target=work, args=(name,), daemon=True, session=spark) for name in steps}
        began = time.monotonic()
        for thread in threads.values():
            thread.start()
        out = {}
        for name, thread in threads.items():
            thread.join(max(0.0, began + self.seconds - time.monotonic()))
            if name not in done:
                done.setdefault(name, Status(name, "timed out", f"more than {self.seconds} s", time.monotonic() - began))
                spark.sparkContext.cancelJobsWithTag(tags[name])
            self.statuses.append(done[name])
            out[name] = spark.read.schema(schemas[name]).parquet(f"{folder}/{name}") if done[name].status == "ok" else fallback(name)
        return out
