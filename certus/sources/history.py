"""An append-only table of runs: what a run wrote becomes visible by one file that says so."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certus.sources.sinks import path_exists

_MANIFEST = "run_id string, attempt string, tables array<string>, note string"


class RunHistory:
    """Tables of runs in a shared folder.

    ``append`` writes each table of a run in a folder of the attempt's own and then creates the run's manifest, which is
    one file that can be created once only. Attempts without a manifest (failed ones, and later ones of a run that is
    there already) are never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, run_id: str, tables: dict[str, DataFrame], note: str = "") -> bool:
        """Add a run; False, and nothing changed, if one of this id is there already."""
        if not run_id or "/" in run_id or run_id.startswith(("_", ".")):
            raise ValueError(f"not a name for a run: {run_id!r}")
        attempt = uuid.uuid4().hex
        for name, table in tables.items():
            table.write.parquet(f"{self.path}/tables/{name}/attempt={attempt}")
        return self._commit(run_id, json.dumps({"run_id": run_id, "attempt": attempt, "tables": sorted(tables), "note": note}))

    def _commit(self, run_id: str, manifest: str) -> bool:
        """Write the manifest aside and rename it to its place, which fails where one is."""
        jvm = self.spark._jvm
        place, aside = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs/{n}") for n in (f"{run_id}.json", f"_{uuid.uuid4().hex}"))
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(place.getParent())
        if fs.exists(place):
            return False
        out = fs.create(aside, False)
        try:
            out.write(bytearray(manifest.encode()))
        finally:
            out.close()
        # on a file system whose rename overwrites, two drivers that end in one moment leave the later one's run
        if not fs.rename(aside, place):
            fs.delete(aside, False)
            return False
        return True

    def runs(self) -> DataFrame:
        """(run_id, attempt, tables, note) of the runs that are complete."""
        if not path_exists(self.spark, f"{self.path}/runs"):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).json(f"{self.path}/runs").filter("attempt IS NOT NULL")

    def table(self, name: str) -> DataFrame:
        """The rows of all complete runs that have this table, with ``run_id``; runs may have different columns.

        Attempts are folders, so the join leaves out those of other runs before they are read. None: ValueError.
        """
        mine = self.runs().filter(F.array_contains("tables", name)).select("run_id", "attempt")
        if mine.isEmpty():
            raise ValueError(f"no run has a table {name}")
        rows = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.path}/tables/{name}").parquet(f"{self.path}/tables/{name}")
        # a row of a few bytes for each run
        return rows.join(F.broadcast(mine), "attempt").drop("attempt")
