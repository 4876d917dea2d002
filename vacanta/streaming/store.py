"""Role history in a folder that all executors share, replaced bucket by bucket.

Roles are dealt by a hash of uid into buckets. A run rewrites only the buckets that its batch touches, into folders of its own:

    root/roles/run=<run>/bucket=<bucket>/   the bucket as that run left it
    root/runs/run=<run>/                    one row: the run and the sizes of what it read and wrote
    root/sources/run=<run>/                 how many postings each source gave in that run
    root/CURRENT                            the last whole run, and for each bucket the run that wrote it

CURRENT is switched last, by a rename. A run that fails before that leaves nothing that is read; run again it writes the same
folders anew. A run that CURRENT has passed changes nothing. What no bucket of CURRENT or of the run before it uses is
deleted, so a reader that began before the switch can end. One run merges at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.operators import history
from vacanta.tables import written

#: A bucket is rewritten by one task; have so many that each stays at some 100 MB.
BUCKETS = 64


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = self.current().get("of", buckets)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _conf(self):
        return self.spark._jsparkSession.sessionState().newHadoopConf()

    def current(self) -> dict:
        """run, of (the number of buckets), buckets (bucket: run, rows) and before (the same of the run before)."""
        path = self._path("CURRENT")
        fs = path.getFileSystem(self._conf())
        if not fs.exists(path):
            return {"run": 0, "buckets": {}, "before": {}}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _switch(self, state: dict) -> None:
        jvm, new, path = self.spark._jvm, self._path("CURRENT.new"), self._path("CURRENT")
        out = path.getFileSystem(self._conf()).create(new, True)
        out.write(json.dumps(state).encode())
        out.close()
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._conf()).rename(new, path, rename)

    def _sweep(self, state: dict) -> None:
        path = self._path("roles")
        fs = path.getFileSystem(self._conf())
        used = {(run, b) for part in ("buckets", "before") for b, (run, _) in state[part].items()}
        for folder in fs.listStatus(path) if fs.exists(path) else []:
            run = int(folder.getPath().getName().removeprefix("run="))
            kept = 0
            for f in fs.listStatus(folder.getPath()):
                name = f.getPath().getName()
                if name.startswith("bucket=") and (run, name.removeprefix("bucket=")) not in used:
                    fs.delete(f.getPath(), True)
                else:
                    kept += name.startswith("bucket=")
            if not kept and run < state["run"]:
                fs.delete(folder.getPath(), True)

    def _bucket(self, uid: str = "uid") -> Column:
        return F.pmod(F.xxhash64(uid), F.lit(self.buckets)).cast("int")

    def roles(self, only: list[int] | None = None) -> DataFrame | None:
        """The roles after the last whole run, of all buckets or some; None before any role was written."""
        held = self.current()["buckets"]
        paths = [f"{self.root}/roles/run={run}/bucket={b}" for b, (run, _) in held.items() if only is None or int(b) in only]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def _table(self, name: str) -> DataFrame:
        runs = range(1, self.current()["run"] + 1)
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*(f"{self.root}/{name}/run={r}" for r in runs))

    def runs(self) -> DataFrame:
        """run, today, sources, postings, kept, new and roles (in all) of each whole run."""
        return self._table("runs")

    def source_counts(self) -> DataFrame:
        """source_key, company, n and run."""
        return self._table("sources")

    def merge(self, batch: DataFrame, counts: DataFrame, run: int, today: Column, key: str = "uid") -> bool:
        """Merge a run's roles. Of rows with one uid the last one counts, by source_key and place where they are there. False: it was merged before.

        counts has source_key, company and n of every source of the run, also of those that gave nothing.
        """
        state = self.current()
        if state["run"] >= run:
            return False
        order = [c for c in ("source_key", "place") if c in batch.columns]
        rest = [c for c in batch.columns if c not in order]
        keyed = written(history.latest(batch, order + rest, key).drop(*order).withColumn("_bucket", self._bucket(key)), "batch")
        kept = keyed.count()
        touched = sorted(r[0] for r in keyed.select("_bucket").distinct().collect())
        fresh = 0
        buckets = dict(state["buckets"])
        if touched:
            stored = self.roles(touched)
            rows = keyed.drop("_bucket")
            if stored is None:
                stored = rows.limit(0).withColumns({"first_seen": today, "first_run": F.lit(run), "last_seen": today})
            after = history.upsert(stored, rows, today, F.lit(run), key).withColumn("bucket", self._bucket(key))
            path = f"{self.root}/roles/run={run}"
            after.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            for b, n, new in self.spark.read.parquet(path).groupBy("bucket").agg(F.count(F.lit(1)), F.count_if(F.col("first_run") == run)).collect():
                buckets[str(b)] = (run, n)
                fresh += new
        counts.write.mode("overwrite").parquet(f"{self.root}/sources/run={run}")
        said = self.spark.read.parquet(f"{self.root}/sources/run={run}").agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
        sizes = {"kept": kept, "new": fresh, "roles": sum(n for _, n in buckets.values())}
        said.select(today.alias("today"), "sources", "postings", *(F.lit(v).cast("long").alias(k) for k, v in sizes.items())).write.mode("overwrite").parquet(f"{self.root}/runs/run={run}")
        new_state = {"run": run, "of": self.buckets, "buckets": buckets, "before": state["buckets"]}
        self._switch(new_state)
        self._sweep(new_state)
        return True

    def throttled(self, run: int | None = None, least: int = 3) -> DataFrame:
        """Companies of sources that gave at least so many postings in the run before and none in this one, the last by default."""
        run = run or self.current()["run"]
        counts = self.source_counts()
        now, was = counts.filter(F.col("run") == run), counts.filter(F.col("run") == run - 1).select("source_key", F.col("n").alias("was"))
        return now.join(was, "source_key").filter((F.col("was") >= least) & (F.col("n") == 0)).select("company").distinct()

    def new_roles(self) -> DataFrame:
        """Roles first seen in the last run; none in the first run of all."""
        run = self.current()["run"]
        return self.roles().filter((F.col("first_run") == run) & F.lit(run > 1))
