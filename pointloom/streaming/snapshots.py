"""A table as a log of versions: bucketed deltas, a manifest for each version, compaction, and any earlier version again.

A version's delta has the rows that it brought, one a key, in folders by bucket of the key. The manifest of a version lists, by bucket, the
base that it starts from and the deltas on it; it is written last, so a version is there whole or not at all, and writing one
again replaces it. Compaction merges the buckets with enough deltas and leaves the others' bases as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

_ENTRY = "bucket int, path string, version long, base boolean"


class SnapshotLog:
    """Rows by `key`, of which the one that is last by `order` counts; where `gone` holds for it the key has no row.

    Rows that come late, behind a newer one of their key, change nothing, whatever version brings them; of equal orders the later version's
    counts, and within one version any. Null keys are one key.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, key: str, order: list[str], gone: Column | None = None, buckets: int = 64) -> None:
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), key, order, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _last(self, rows: DataFrame) -> DataFrame:
        """Of each key the last row; rows have bucket and version besides."""
        whole = F.struct(*[F.col(f"`{f.name}`") for f in self.schema], "bucket", "version")
        return rows.groupBy(self.key).agg(F.max_by(whole, F.struct(*self.order, "version")).alias("_r")).select("_r.*")

    def versions(self) -> list[int]:
        """The numbers of all versions."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.folder}/manifest")
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath() for x in system.listStatus(root)] if system.exists(root) else []
        return sorted(int(p.getName()) for p in found if system.exists(hadoop.Path(p, "_SUCCESS")))

    def manifest(self, version: int | None = None) -> list:
        """The entries of a version, the last by default: at most a base and some deltas a bucket."""
        known = self.versions()
        version = (known[-1] if known else None) if version is None else version
        if version is None:
            return []
        if version not in known:
            raise ValueError(f"no version {version}: {known}")
        return self.spark.read.schema(_ENTRY).json(f"{self.folder}/manifest/{version}").collect()

    def _publish(self, version: int, entries: list) -> None:
        self.spark.createDataFrame([tuple(e) for e in entries], _ENTRY).coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/{version}")

    def _rows(self, entries: list) -> DataFrame:
        names = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema]
        if not entries:
            return self.spark.createDataFrame([], ", ".join([*names, "bucket int", "version long"]))
        return self.spark.read.schema(", ".join([*names, "bucket int", "version long"])).parquet(*[e["path"] for e in entries])

    def commit(self, rows: DataFrame, version: int) -> None:
        """Add a version on the last one before it."""
        before = [v for v in self.versions() if v < version]
        entries = self.manifest(before[-1]) if before else []
        path = f"{self.folder}/delta/{version}"
        marked = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]).withColumns({"bucket": self._bucket(), "version": F.lit(version).cast("long")})
        self._write(self._last(marked), path)
        touched = [r["bucket"] for r in self.spark.read.schema("bucket int").parquet(f"{path}/*").select("bucket").distinct().collect()] if self._any(path) else []  # `buckets` at most
        self._publish(version, [tuple(e) for e in entries] + [(b, f"{path}/part={b}", version, False) for b in sorted(touched)])

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.withColumn("part", F.col("bucket")).repartition(min(self.buckets, 1024), "part").write.mode("overwrite").partitionBy("part").parquet(path)

    def _any(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(path)
        return any(x.getPath().getName().startswith("part=") for x in root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it was at a version, the last by default."""
        last = self._last(self._rows(self.manifest(version)))
        return last.filter(~self.gone).select(*[f"`{f.name}`" for f in self.schema])

    def compact(self, least: int = 4) -> list[int]:
        """Merge the last version's buckets with `least` deltas or more into new bases, in its manifest; the buckets. Rows that are gone stay
        as marks, so that late rows of their keys change nothing."""
        known = self.versions()
        entries = self.manifest()
        deltas = {}
        for e in entries:
            deltas[e["bucket"]] = deltas.get(e["bucket"], 0) + (not e["base"])
        full = sorted(b for b, n in deltas.items() if n >= least)
        if not full:
            return []
        path = f"{self.folder}/base/{known[-1]}"
        self._write(self._last(self._rows([e for e in entries if e["bucket"] in full])), path)
        self._publish(known[-1], [tuple(e) for e in entries if e["bucket"] not in full] + [(b, f"{path}/part={b}", known[-1], True) for b in full])
        return full

    def restore(self, version: int) -> int:
        """A new version that is what `version` was; its number."""
        new = self.versions()[-1] + 1
        self._publish(new, self.manifest(version))
        return new


def upsert_stream(updates: DataFrame, log: SnapshotLog, checkpoint: str, compact_every: int = 8) -> DataStreamWriter:
    """A query that commits each batch of updates as a version; a batch that is run again replaces its version."""

    def write(batch: DataFrame, number: int) -> None:
        log.commit(batch, number)
        if number % compact_every == compact_every - 1:
            log.compact()

    return updates.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
