"""What the stages of a run took: seconds, reads, bases, rows, jobs and tasks, in one table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_GROUP = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


@dataclass
class Stage:
    """One stage; ``reads`` and ``bases`` that went in and ``rows`` that came out, where it has them; jobs of its own thread and their tasks."""

    name: str
    seconds: float = 0.0
    reads: int | None = None
    bases: int | None = None
    rows: int | None = None
    jobs: int = 0
    tasks: int = 0


class Stages:
    """Measures stages one after another.

    Seconds are of the driver's clock, jobs and tasks come from Spark's status tracker
    (which forgets old ones, as its settings say), and reads and bases are observed
    while a stage reads them, without a pass of their own.
    """

    def __init__(self, spark: SparkSession):
        self.context, self.done = spark.sparkContext, []

    @contextmanager
    def stage(self, name: str) -> Iterator[Stage]:
        """Measure what runs within; a stage that fails is listed too."""
        before = {p: self.context.getLocalProperty(p) for p in _GROUP}
        group, this = f"{name}-{uuid.uuid4().hex}", Stage(name)
        self.context.setJobGroup(group, name)
        began = time.perf_counter()
        try:
            yield this
        finally:
            this.seconds = time.perf_counter() - began
            for p, value in before.items():
                self.context.setLocalProperty(p, value)
            self._count(this, group)
            self.done.append(this)

    def _count(self, this: Stage, group: str) -> None:
        tracker = self.context.statusTracker()
        jobs = tracker.getJobIdsForGroup(group)
        this.jobs = len(jobs)
        for job in jobs:
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                found = tracker.getStageInfo(stage)
                this.tasks += found.numCompletedTasks if found else 0

    def table(self) -> str:
        """All stages as lines of columns that tabs part; what a stage doesn't have is empty."""
        names = [f.name for f in fields(Stage)]
        cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
        return "\n".join(["\t".join(["stage", *names[1:]]), *["\t".join(cell(getattr(s, n)) for n in names) for s in self.done]])


def observed(reads: DataFrame) -> tuple[DataFrame, Observation]:
    """Prepared reads, and their number and bases once an action has read them all."""
    seen = Observation(f"reads-{uuid.uuid4().hex}")
    return reads.observe(seen, F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("bases")), seen
