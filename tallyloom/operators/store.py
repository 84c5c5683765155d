"""Tables kept as changes in buckets, with verified snapshots.

A table is dealt out by a bucket number that its rows carry. A commit adds a run: files of the buckets it changes, and one manifest that
names, for every bucket, the runs that make it up, with their schema, row counts and checksums. So a writer reads and writes the buckets it
touches and no others, and readers of older versions keep what they read. Manifests are numbered; a version is taken by creating its file, which fails where it
exists: of two writers that began from one version the second is refused and begins again. A run that broke off before its manifest, or
a manifest that broke off while it was written, is as if it had never been.

Where a bucket has gathered MOST_RUNS runs the commit that adds one rewrites that bucket as a single run (the table's rule says which of its rows still
hold). `vacuum` deletes what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

#: Runs of a bucket beyond which a commit rewrites it.
MOST_RUNS = 8

Rule = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has taken the version."""


class Store:
    """Versions of tables under a root that all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, fs = self._path(*parts)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        """The numbers that are taken, whole or not."""
        return [int(x.removesuffix(".json")) for x in self._names("_versions") if x.endswith(".json")]

    def manifest(self, version: int) -> dict | None:
        """What a version names; none where its manifest is not whole."""
        path, fs = self._path("_versions", f"{version:010d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def latest(self) -> dict | None:
        """The last whole manifest, as it stands; its data is not read."""
        return next((m for v in reversed(self.versions()) if (m := self.manifest(v))), None)

    def _schema(self, entry: dict) -> StructType:
        return StructType.fromJson(entry["schema"]).add("run", StringType()).add("bucket", IntegerType())

    def read(self, manifest: dict | None, name: str, buckets: list[int] | None = None, runs: list[str] | None = None) -> DataFrame | None:
        """Rows of all runs of a table's buckets (all, or those given); none where the version has no such table."""
        entry = (manifest or {"tables": {}})["tables"].get(name)
        if entry is None:
            return None
        wanted = entry["buckets"].items() if buckets is None else [(str(b), entry["buckets"].get(str(b), [])) for b in buckets]
        paths = [f"{self.root}/{name}/run={run}/bucket={b}" for b, parts in wanted for run, *_ in parts if runs is None or run in runs]
        if not paths:
            return self.spark.createDataFrame([], self._schema(entry))
        return self.spark.read.schema(self._schema(entry)).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _sums(self, rows: DataFrame, schema: StructType) -> dict[tuple[str, str], tuple[int, str]]:
        """(run, bucket) -> rows and checksum; one row for each of them comes to the driver."""
        columns = [f.name for f in schema]
        found = rows.groupBy("run", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("sum")).collect()
        return {(r["run"], str(r["bucket"])): (r["n"], r["sum"]) for r in found}

    def _written(self, name: str, rows: DataFrame, run: str) -> tuple[dict, dict[str, list]]:
        """Write a run; its schema, and for each bucket the run with its sums."""
        body = rows.drop("run")
        body.write.partitionBy("bucket").parquet(f"{self.root}/{name}/run={run}")
        schema = StructType([f for f in body.schema if f.name != "bucket"])
        back = self.spark.read.schema(self._schema({"schema": json.loads(schema.json())})).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}/run={run}")
        return json.loads(schema.json()), {b: [run, n, total] for (_, b), (n, total) in self._sums(back, schema).items()}

    def commit(self, base: dict | None, run: int, changes: dict[str, DataFrame], rules: dict[str, Rule] | None = None) -> dict:
        """Add a run to the version `base` (none: the first) and return the new version; Conflict where another writer was faster.

        changes: for each table, rows with their `bucket`. Columns may be added to a table by a later run, not taken away.
        """
        tables = {name: {"schema": t["schema"], "buckets": {b: list(parts) for b, parts in t["buckets"].items()}} for name, t in (base or {"tables": {}})["tables"].items()}
        version = (base["version"] if base else 0) + 1
        taken = [v for v in self.versions() if v >= version]
        if any(self.manifest(v) for v in taken):
            raise Conflict(f"version {version} is taken")
        version = max([version, *[v + 1 for v in taken]])  # numbers of manifests that broke off are passed over
        made = {"version": version, "run": run, "tables": tables}
        for name, rows in changes.items():
            label = f"{run:010d}-{uuid.uuid4().hex[:12]}"
            schema, parts = self._written(name, rows, label)
            entry = tables.setdefault(name, {"schema": schema, "buckets": {}})
            entry["schema"] = schema
            for b, part in parts.items():
                entry["buckets"].setdefault(b, []).append(part)
            full = [int(b) for b, held in entry["buckets"].items() if len(held) > MOST_RUNS]
            if full and rules and name in rules:
                _, whole = self._written(name, rules[name](self.read(made, name, full)), f"{run:010d}-{uuid.uuid4().hex[:12]}")
                for b in full:
                    entry["buckets"][str(b)] = [whole[str(b)]] if str(b) in whole else []
        path, fs = self._path("_versions", f"{version:010d}.json")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {version} is taken") from e
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        return made

    def damaged(self, manifest: dict) -> list[tuple[str, str]]:
        """(table, run) of each run whose files are missing, unreadable, or do not sum up to what the manifest says."""
        out = []
        for name, entry in manifest["tables"].items():
            schema = StructType.fromJson(entry["schema"])
            for run in sorted({run for parts in entry["buckets"].values() for run, *_ in parts}):
                want = {(run, b): (n, total) for b, parts in entry["buckets"].items() for r, n, total in parts if r == run}
                try:
                    whole = self._sums(self.read(manifest, name, runs=[run]), schema) == want
                except Exception:  # a truncated or missing file, whatever the reader says about it
                    whole = False
                if not whole:
                    out.append((name, run))
        return out

    def verified(self) -> dict | None:
        """The last version of which every run is whole; older ones are tried where a run is damaged."""
        return next((m for v in reversed(self.versions()) if (m := self.manifest(v)) and not self.damaged(m)), None)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last `keep` whole versions, and runs that none of them names."""
        whole = [m for v in self.versions() if (m := self.manifest(v))][-keep:]
        if not whole:
            return
        named = {(name, part[0]) for m in whole for name, t in m["tables"].items() for parts in t["buckets"].values() for part in parts}
        for name in {name for m in whole for name in m["tables"]}:
            for folder in self._names(name):
                if (name, folder.removeprefix("run=")) not in named:
                    path, fs = self._path(name, folder)
                    fs.delete(path, True)
        for v in self.versions():
            if v < whole[0]["version"]:
                path, fs = self._path("_versions", f"{v:010d}.json")
                fs.delete(path, False)
