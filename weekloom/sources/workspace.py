"""A workspace folder of Parquet tables: immutable snapshots, last-write-wins canonical tables, dimensions, mappings and runs.

Data is written first, under a name of its own, and counts once a commit log names it; of the rows of a key in a log the last commit counts, so nothing is
rewritten while it is read. A canonical table is kept in buckets of weeks: a rebuild reads what was uploaded since the last one and the buckets that it
touches, writes those anew and commits which version of each bucket holds. The folder may be in any store that Spark reads."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.sources.commits import CommitLog
from weekloom.sources.schemas import REFERENCES, STREAMS, grain, struct_of

# The metadata tables.
METADATA = {
    "snapshots": "snapshot_id string, stream string, table_name string, source_name string, row_count long, date_min date, date_max date, uploaded_at timestamp",
    "references_log": "name string, source_name string, row_count long, uploaded_at timestamp, version string",
    "mappings": "stream string, signature string, payload string, saved_at timestamp",
    "runs": "run_id string, as_of date, manifest string, created_at timestamp",
}
#: What a rebuild commits: up to which snapshot it goes, the columns that a row is about, and the version and rows of each bucket.
CANONICAL = "upto long, keys array<string>, buckets array<struct<bucket:int,version:string,rows:long>>, at timestamp"
#: Weeks in a bucket; rows without a week have a bucket of their own.
BUCKET_WEEKS = 13


def week_bucket(week: str = "week") -> F.Column:
    return F.coalesce(F.floor(F.datediff(F.col(week), F.lit("1970-01-05")) / (7 * BUCKET_WEEKS)).cast("int"), F.lit(-(2**31) + 1).cast("int"))


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


class Workspace:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- files ----

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _commits(self, name: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.path}/meta/{name}", METADATA[name])

    def _log(self, name: str) -> DataFrame:
        return self._commits(name).read()

    def _append(self, name: str, *row: object) -> int:
        return self._commits(name).append(dict(zip((f.split()[0] for f in METADATA[name].split(", ")), row, strict=True)))

    # ---- snapshots ----

    def add_snapshot(self, stream: str, df: DataFrame, source_name: str) -> str:
        """Writes ``df`` once under an id of its own, then commits its lineage; snapshots are ordered by their commits."""
        if stream not in STREAMS:
            raise KeyError(stream)
        now = _now()
        sid = f"snap_{stream}_{now:%Y%m%d%H%M%S}_{uuid.uuid4().hex[:8]}"
        df.write.mode("errorifexists").parquet(f"{self.path}/snapshots/{stream}/{sid}")
        kept = self.spark.read.parquet(f"{self.path}/snapshots/{stream}/{sid}")
        dated = "week" in kept.columns
        n, first, last = kept.agg(F.count(F.lit(1)), *([F.min("week"), F.max("week")] if dated else [F.lit(None), F.lit(None)])).first()
        self._append("snapshots", sid, stream, sid, source_name, n, first, last, now)
        return sid

    def list_snapshots(self, stream: str | None = None) -> DataFrame:
        """Newest first."""
        log = self._log("snapshots")
        return (log.where(F.col("stream") == stream) if stream else log).orderBy(F.desc("ordinal"))

    def latest_snapshot(self, stream: str) -> str | None:
        return self._log("snapshots").where(F.col("stream") == stream).agg(F.max_by("table_name", "ordinal")).first()[0]

    def snapshot_coverage(self, stream: str) -> DataFrame:
        return snapshot_coverage(self._log("snapshots").where(F.col("stream") == stream))

    # ---- canonical tables ----

    def _canonical(self, stream: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.path}/canonical_log/{stream}", CANONICAL)

    def _buckets(self, stream: str, buckets: list[dict]) -> DataFrame | None:
        paths = [f"{self.path}/canonical/{stream}/v={b['version']}/bucket={b['bucket']}" for b in buckets]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def rebuild_canonical(self, streams: list[str] | None = None, full: bool = False) -> dict[str, int]:
        """Row count of each rebuilt table, of all streams or those named.

        A rebuild goes on from the last one: it reads the snapshots since and the buckets in which they have rows. ``full`` starts from nothing, and so does
        a change of what a row is about. If another rebuild commits first, this one goes on from that."""
        out = {}
        for stream in streams or STREAMS:
            while (rows := self._rebuilt(stream, full)) is None:
                pass
            if rows >= 0:
                out[stream] = rows
        return out

    def _rebuilt(self, stream: str, full: bool) -> int | None:
        """Rows of the table; -1 if there is none, None if another rebuild came first."""
        log = self._canonical(stream)
        base = log.latest()
        upto, held = (0, []) if base is None or full else (base["upto"], base["buckets"])
        known = self._log("snapshots").where(F.col("stream") == stream)
        snaps = known.where(F.col("ordinal") > upto).orderBy("ordinal").collect()  # one row an upload
        if not snaps:
            return sum(b["rows"] for b in held) if base else -1
        parts = [self.spark.read.parquet(f"{self.path}/snapshots/{stream}/{r.snapshot_id}").withColumn("_ord", F.lit(r.ordinal)) for r in snaps]
        keys = grain(stream, parts[-1].columns)
        if held and keys != base["keys"]:
            return self._rebuilt(stream, full=True)
        dated = all("week" in p.columns for p in parts)
        bucket = week_bucket() if dated else F.lit(0)
        touched = {r.bucket for p in parts for r in p.select(bucket.alias("bucket")).distinct().collect()}  # a row for each BUCKET_WEEKS weeks
        before = self._buckets(stream, [b for b in held if b["bucket"] in touched])
        merged = latest_rows(([before.withColumn("_ord", F.lit(upto))] if before is not None else []) + parts, keys)
        version = uuid.uuid4().hex
        path = f"{self.path}/canonical/{stream}/v={version}"
        merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(path)
        counts = {r.bucket: r["count"] for r in self.spark.read.parquet(path).groupBy("bucket").count().collect()}
        buckets = [b for b in held if b["bucket"] not in touched] + [{"bucket": b, "version": version, "rows": n} for b, n in counts.items()]
        row = {"upto": snaps[-1].ordinal, "keys": keys, "buckets": sorted(buckets, key=lambda b: b["bucket"]), "at": _now()}
        return sum(b["rows"] for b in buckets) if log.commit_at((base["ordinal"] if base else 0) + 1, row) else None

    def vacuum_canonical(self) -> int:
        """Deletes the versions that the last commit of each stream no longer names; for when nobody reads an older one. How many went."""
        gone = 0
        for stream in STREAMS:
            base = self._canonical(stream).latest()
            if base is None:
                continue
            kept = {b["version"] for b in base["buckets"]}
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/canonical/{stream}")
            fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for f in fs.listStatus(folder):
                if f.getPath().getName().removeprefix("v=") not in kept:
                    gone += bool(fs.delete(f.getPath(), True))
        return gone

    def has_canonical(self, stream: str) -> bool:
        return bool(self._canonical(stream).ordinals())

    def read_canonical(self, stream: str) -> DataFrame:
        """Empty, with the stream's schema, if there is none."""
        base = self._canonical(stream).latest()
        found = self._buckets(stream, base["buckets"]) if base else None
        return self.spark.createDataFrame([], struct_of(stream)) if found is None else found

    def canonical_status(self) -> DataFrame:
        return canonical_status({s: self.read_canonical(s) for s in STREAMS})

    # ---- dimensions ----

    def add_reference(self, name: str, df: DataFrame, source_name: str) -> None:
        if name not in REFERENCES:
            raise KeyError(name)
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/dim/{name}/v={version}")
        rows = self.spark.read.parquet(f"{self.path}/dim/{name}/v={version}").count()
        self._append("references_log", name, source_name, rows, _now(), version)

    def has_reference(self, name: str) -> bool:
        return not self._log("references_log").where(F.col("name") == name).isEmpty()

    def read_reference(self, name: str) -> DataFrame | None:
        last = self._log("references_log").where(F.col("name") == name).agg(F.max_by("version", "ordinal")).first()[0]
        return self.spark.read.parquet(f"{self.path}/dim/{name}/v={last}") if last else None

    # ---- mappings and runs ----

    def save_mapping(self, stream: str, signature: str, mapping: dict) -> None:
        self._append("mappings", stream, signature, json.dumps(mapping), _now())

    def get_mapping(self, stream: str, signature: str) -> dict | None:
        found = self._log("mappings").where((F.col("stream") == stream) & (F.col("signature") == signature)).agg(F.max_by("payload", "ordinal")).first()[0]
        return json.loads(found) if found else None

    def save_run(self, run_id: str, as_of: dt.date, manifest: dict, outputs: dict[str, DataFrame]) -> None:
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(f"{self.path}/runs/{run_id}/{name}")
        self._append("runs", run_id, as_of, json.dumps(manifest, default=str), _now())

    def list_runs(self) -> DataFrame:
        latest = Window.partitionBy("run_id").orderBy(F.desc("ordinal"))
        return self._log("runs").withColumn("_k", F.row_number().over(latest)).where("_k = 1").drop("_k").orderBy(F.desc("ordinal"))

    def latest_run_id(self) -> str | None:
        return self._log("runs").agg(F.max_by("run_id", "ordinal")).first()[0]

    def run_manifest(self, run_id: str) -> dict | None:
        found = self._log("runs").where(F.col("run_id") == run_id).agg(F.max_by("manifest", "ordinal")).first()[0]
        return json.loads(found) if found else None

    def read_run_output(self, run_id: str, name: str) -> DataFrame:
        path = f"{self.path}/runs/{run_id}/{name}"
        return self.spark.read.parquet(path) if self._exists(path) else self.spark.createDataFrame([], "item_id string")

    def export_csv(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/export/{name}"
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return path

    def write_template(self, name: str) -> str:
        """A CSV of the header alone."""
        return self.export_csv(self.spark.createDataFrame([], struct_of(name)), f"template_{name}")


def latest_rows(snapshots: list[DataFrame], keys: list[str], ordinal: str = "_ord") -> DataFrame:
    """One row for each grain key, from the snapshot with the highest ordinal.

    Rows that tie inside one snapshot are ordered by all their values, so that the same row wins every time."""
    whole = snapshots[0]
    for part in snapshots[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    rest = sorted(c for c in whole.columns if c not in (*keys, ordinal))
    w = Window.partitionBy(*(keys or rest)).orderBy(F.desc(ordinal), *[F.desc_nulls_last(c) for c in rest])
    return whole.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", ordinal)


def snapshot_coverage(log: DataFrame) -> DataFrame:
    return log.groupBy("stream").agg(F.count(F.lit(1)).alias("snapshots"), F.sum("row_count").alias("rows"), F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"))


def canonical_status(streams: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in streams.items():
        one = df.agg(F.lit(name).alias("stream"), (F.count(F.lit(1)) > 0).alias("loaded"), F.count(F.lit(1)).alias("rows"), F.min("week").alias("week_min"), F.max("week").alias("week_max"))
        out = one if out is None else out.unionByName(one)
    return out
