"""Several partitioned tables under one manifest: what a commit changes is seen at once or not at all.

A commit writes new files beside the old ones and then one manifest, a small table that says which version of every
``(survey_id, part)`` is in force. Readers go by the last manifest that was written whole. What no
manifest in use names is removed one commit later, so readers of the previous version can finish and files stay bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundlake.runtime import bounded_broadcast

PARTITION = ["survey_id", "part"]


@dataclass(frozen=True)
class VersionedTables:
    """Tables ``<path>/<name>/version=<n>/survey_id=<s>/part=<p>`` with their manifests ``<path>/manifest/version=<n>``.

    One writer at a time. A replayed commit of the same version overwrites its own files.
    """

    spark: SparkSession
    path: str

    def _files(self):
        """The Hadoop file system of the path and a maker of its paths."""
        jvm = self.spark._jvm
        make = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return make().getFileSystem(self.spark._jsc.hadoopConfiguration()), make

    def versions(self) -> list[int]:
        """Committed versions, oldest first: those whose manifest is whole."""
        files, make = self._files()
        found = files.globStatus(make("manifest", "version=*", "_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """``(name, survey_id, part, version, mark)`` of a version, the last one by default; None before the first commit."""
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.path}/manifest/version={known[-1] if version is None else version}")

    def mark(self) -> int | None:
        """The mark of the last commit, e.g. the last batch that is merged."""
        last = self.manifest()
        return None if last is None else last.agg(F.max("mark")).first()[0]

    def read(self, name: str, only: DataFrame | None = None, since: int | None = None) -> DataFrame | None:
        """Rows in force; of the partitions in ``only(survey_id, part)``, or changed after version ``since``, if given."""
        last = self.manifest()
        if last is None:
            return None
        wanted = last.where((F.col("name") == name) & F.col("survey_id").isNotNull())
        if since is not None:
            wanted = wanted.where(F.col("version") > since)
        if only is not None:
            wanted = wanted.join(only.select(*PARTITION).distinct(), PARTITION, "left_semi")
        wanted = wanted.select("version", *PARTITION)
        if wanted.isEmpty():
            return None
        stored = self.spark.read.parquet(f"{self.path}/{name}")
        typed = stored.withColumns({"version": F.col("version").cast("long"), "survey_id": F.col("survey_id").cast("long"), "part": F.col("part").cast("int")})
        # partition columns only: the scan skips the folders of other versions
        return typed.join(bounded_broadcast(wanted), ["version", *PARTITION], "left_semi").drop("version")

    def commit(self, changes: dict[str, DataFrame], mark: int = 0) -> int:
        """Replace the partitions that occur in ``changes`` in every table named; returns the new version.

        Until the manifest is written, readers see the version before.
        """
        last, known = self.manifest(), self.versions()
        version = (known[-1] if known else 0) + 1
        touched = None
        for name, rows in changes.items():
            folder = f"{self.path}/{name}/version={version}"
            # rows of a partition come together first, so that files grow with the partitions, not with tasks times partitions;
            # adaptive execution splits a large partition over several tasks
            rows.hint("rebalance", *PARTITION).write.mode("overwrite").partitionBy(*PARTITION).parquet(folder)
            if not self._has_parts(name, version):
                continue
            here = self.spark.read.parquet(folder).select(
                F.lit(name).alias("name"), F.col("survey_id").cast("long").alias("survey_id"), F.col("part").cast("int").alias("part")
            ).distinct()
            touched = here if touched is None else touched.unionByName(here)
        if touched is None:  # nothing changed, but the mark moves on
            touched = self.spark.createDataFrame([(None, None, None)], "name string, survey_id long, part int")
        fresh = touched.withColumn("version", F.lit(version).cast("long"))
        if last is not None:
            kept = last.where("survey_id is not null").join(touched, ["name", *PARTITION], "left_anti").select("name", *PARTITION, "version")
            fresh = kept.unionByName(fresh)
        fresh.withColumn("mark", F.lit(mark).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self._retire(known)
        return version

    def _has_parts(self, name: str, version: int) -> bool:
        files, make = self._files()
        return len(files.globStatus(make(name, f"version={version}", "survey_id=*")) or []) > 0

    def _retire(self, before: list[int]) -> None:
        """Remove what the version before last named and the last one doesn't; ``before`` are the versions before this commit."""
        files, make = self._files()
        for old, new in zip(before[:-1], before[1:], strict=True):
            gone = self.manifest(old).where("survey_id is not null").join(self.manifest(new), ["name", *PARTITION, "version"], "left_anti")
            for row in gone.toLocalIterator():  # one entry a replaced partition: file names, not data
                files.delete(make(row["name"], f"version={row['version']}", f"survey_id={row['survey_id']}", f"part={row['part']}"), True)
            files.delete(make("manifest", f"version={old}"), True)
