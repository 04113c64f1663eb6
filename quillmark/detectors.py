"""Detectors of an analysis: a registry of named functions of the run's tables, each run by itself.

A detector takes the run's tables by name and returns findings (doc_id, code, category, risk_points, confidence, ...). One that fails doesn't stop the
others: its state is ``partial`` with the kind of failure, and it adds no finding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
Detector = Callable[[Tables], DataFrame]
COLUMNS = ("doc_id", "code", "category", "risk_points", "confidence")
NOTE_MOST = 240


class Registry:
    """Detectors in the order of their registration."""

    def __init__(self):
        self.detectors: dict[str, tuple[Detector, tuple[str, ...]]] = {}

    def register(self, name: str, *needs: str):
        """Register a function under a name, with the tables that it needs."""

        def add(f: Detector) -> Detector:
            if name in self.detectors:
                raise ValueError(f"detector already known: {name}")
            self.detectors[name] = (f, needs)
            return f

        return add

    def run(self, spark: SparkSession, tables: Tables) -> tuple[DataFrame, DataFrame]:
        """(findings with their detector, states): every detector is carried out once, its findings kept in memory and on disk (and computed anew
        if they are lost)."""
        found, states = [], []
        for name, (detector, needs) in self.detectors.items():
            if missing := [n for n in needs if n not in tables]:
                states.append((name, "not_applicable", f"no table: {', '.join(missing)}", 0))
                continue
            try:
                rows = detector(tables).select(*COLUMNS, F.lit(name).alias("detector")).persist(StorageLevel.MEMORY_AND_DISK)
                n = rows.count()
            except Exception as e:  # whatever a detector raises is its own failure
                states.append((name, "partial", f"interrupted: {type(e).__name__}: {str(e)[:NOTE_MOST]}", 0))
                continue
            found.append(rows)
            states.append((name, "completed", None, n))
        out = spark.createDataFrame([], "doc_id string, code string, category string, risk_points double, confidence double, detector string") if not found else found[0]
        for rows in found[1:]:
            out = out.unionByName(rows)
        return out, spark.createDataFrame(states, "detector string, status string, note string, findings bigint")


def default_registry() -> Registry:
    """Detectors over the tables ``files`` (of ``software.structure_findings``), ``metadata`` (doc_id, key, value) and ``observations`` (of the content
    checks: doc_id, code, state, strength)."""
    from quillmark.operators import software

    registry = Registry()

    @registry.register("pdf_structure", "files")
    def structure(tables: Tables) -> DataFrame:
        return software.structure_findings(tables["files"])

    @registry.register("software", "metadata")
    def tools(tables: Tables) -> DataFrame:
        rows = software.software_finding(tables["metadata"])
        return rows.select("doc_id", F.lit("PDF_SOFTWARE_PROVENANCE").alias("code"), F.lit("metadata").alias("category"), F.col("points").alias("risk_points"), F.lit(0.8).alias("confidence"))

    @registry.register("content", "observations")
    def content(tables: Tables) -> DataFrame:
        rows = tables["observations"].where("state = 'attention'")
        points = F.when(F.col("strength") == "strong", 20.0).when(F.col("strength") == "moderate", 10.0).otherwise(0.0)
        return rows.select("doc_id", "code", F.lit("content_consistency").alias("category"), points.alias("risk_points"), F.lit(0.8).alias("confidence"))

    return registry
