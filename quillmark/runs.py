"""A review run in two phases: the core findings are scored and written at once; slower branches follow side by side, and the scores are written anew.

Branches are functions that give findings. Each runs in a thread and a job group of its own; one that fails or is cancelled adds nothing and leaves a
note. Progress is a weighted share of finished branches and never falls. Each phase's scores have a folder of their own, so that readers of the one before
aren't disturbed; a repeated run overwrites phase by phase and gives the same tables.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE_MOST = 240


class Progress:
    """Shares of named branches, weighted; the total only rises."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.done, self.shown, self.lock = weights, dict.fromkeys(weights, 0.0), 0.0, threading.Lock()

    def update(self, name: str, share: float) -> float:
        with self.lock:
            self.done[name] = max(self.done[name], min(1.0, max(0.0, share)))
            total = sum(self.weights.values())
            self.shown = max(self.shown, sum(self.weights[n] * x for n, x in self.done.items()) / total if total else 1.0)
            return self.shown


class Run:
    """Findings under ``path/findings/branch=...``, scores under ``path/assessments/phase=...``, states of the branches in ``states``."""

    def __init__(self, spark: SparkSession, path: str, score: Callable[[DataFrame], DataFrame], report: Callable[[float, str], None] | None = None):
        self.spark, self.path, self.score, self.report = spark, path.rstrip("/"), score, report
        self.states: dict[str, tuple[str, str | None]] = {}
        self.phase = 0
        self.group, self.cancelled, self.lock = f"review-{uuid.uuid4().hex}", threading.Event(), threading.Lock()

    def _folder(self, branch: str) -> str:
        return f"{self.path}/findings/branch={branch}"

    def findings(self) -> DataFrame:
        """The findings of all branches that were completed."""
        folders = [self._folder(b) for b, (state, _) in self.states.items() if state == "completed"]
        return self.spark.read.option("basePath", f"{self.path}/findings").parquet(*folders)

    def assess(self) -> DataFrame:
        """Score what is there; the scores of the latest phase count."""
        folder, self.phase = f"{self.path}/assessments/phase={self.phase}", self.phase + 1
        self.score(self.findings()).write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder)

    def _branch(self, name: str, work: Callable[[], DataFrame], progress: Progress) -> None:
        sc = self.spark.sparkContext
        sc.setJobGroup(self.group, f"review: {name}", interruptOnCancel=True)
        try:
            if self.cancelled.is_set():
                raise InterruptedError("cancelled before it began")
            work().write.mode("overwrite").parquet(self._folder(name))
            state = ("completed", None)
        except Exception as e:  # whatever a branch raises is its own failure
            state = ("cancelled" if self.cancelled.is_set() else "partial", f"{type(e).__name__}: {str(e)[:NOTE_MOST]}")
        with self.lock:
            self.states[name] = state
        share = progress.update(name, 1.0)
        if self.report is not None:
            self.report(share, name)

    def core(self, findings: DataFrame) -> DataFrame:
        """The first phase: the core findings alone."""
        findings.write.mode("overwrite").parquet(self._folder("core"))
        self.states["core"] = ("completed", None)
        return self.assess()

    def extend(self, branches: dict[str, Callable[[], DataFrame]], weights: dict[str, float] | None = None, side_by_side: int = 2) -> DataFrame:
        """The second phase: the branches, then the scores of all findings together."""
        progress = Progress({n: (weights or {}).get(n, 1.0) for n in branches})
        with ThreadPoolExecutor(max_workers=side_by_side) as pool:
            for done in [pool.submit(self._branch, n, f, progress) for n, f in branches.items()]:
                done.result()
        return self.assess()

    def cancel(self) -> None:
        """Stop the branches that run and leave out those that wait; what was scored before stays."""
        self.cancelled.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def branch_states(self) -> DataFrame:
        """(branch, state, note)."""
        return self.spark.createDataFrame([(n, s, note) for n, (s, note) in self.states.items()], "branch string, state string, note string")


def points_by_document(findings: DataFrame) -> DataFrame:
    """(doc_id, points, findings): the plainest score, for runs without another."""
    return findings.groupBy("doc_id").agg(F.sum("risk_points").alias("points"), F.count("*").alias("findings"))
