"""A versioned store: immutable Parquet tables for each generation, named by a manifest that is written last."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "generation long, name string, path string, rows long, digest long"


class VersionedStore:
    """Tables under one folder. A generation is there once its manifest is; a reader pins one generation for all it reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self) -> DataFrame:
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/g*")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], _MANIFEST)
            raise

    def newest(self) -> int:
        return self._manifests().agg(F.max("generation")).first()[0] or 0

    def publish(self, tables: dict[str, DataFrame], expected: int | None = None) -> int:
        """Write the next generation; tables that aren't given stay as they are. ``expected``: the generation that the writer has read."""
        now = self.newest()
        if expected is not None and expected != now:
            raise ValueError(f"the store is at generation {now}, not {expected}")
        rows = {r.name: r for r in self._manifests().where(F.col("generation") == now).collect()} if now else {}
        entries = [(now + 1, r.name, r.path, r.rows, r.digest) for n, r in rows.items() if n not in tables]
        for name, df in tables.items():
            path = f"{self.root}/tables/{name}/g{now + 1:012d}-{uuid.uuid4().hex}"  # another writer's is another one
            df.write.parquet(path)
            entries.append((now + 1, name, path, *self._digest(self.spark.read.parquet(path))))
        self._commit(entries, now + 1, self.root)
        return now + 1

    def _commit(self, entries: list[tuple], generation: int, root: str) -> None:
        """Give the manifest its name, which only one writer of a generation can: renaming to a name that exists fails."""
        attempt, name = f"{root}/attempts/{uuid.uuid4().hex}", f"{root}/manifest/g{generation:012d}"
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.parquet(attempt)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        files, path = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path
        path(name).getFileSystem(conf).mkdirs(path(f"{root}/manifest"))
        none = self.spark.sparkContext._gateway.new_array(files.Options.Rename, 0)
        try:
            files.FileContext.getFileContext(path(name).getFileSystem(conf).getUri(), conf).rename(path(attempt), path(name), none)
        except Exception as e:
            path(attempt).getFileSystem(conf).delete(path(attempt), True)
            if "FileAlreadyExists" in str(e):
                raise ValueError(f"another writer has published generation {generation}") from e
            raise

    @staticmethod
    def _digest(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("d")).first()
        return r.n, r.d

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        at = self.newest() if generation is None else generation
        r = self._manifests().where((F.col("generation") == at) & (F.col("name") == name)).first()
        if r is None:
            raise KeyError(f"{name} at generation {at}")
        return self.spark.read.parquet(r.path)

    def replace_space(self, name: str, df: DataFrame, space: str) -> int:
        """The next generation with one space's rows replaced."""
        rest = self.read(name).where(F.col("space_id") != space) if self.newest() else df.limit(0)
        return self.publish({name: rest.unionByName(df.where(F.col("space_id") == space))})

    def verify(self) -> list[str]:
        """Tables of the newest generation that aren't what the manifest says."""
        wrong = []
        for r in self._manifests().where(F.col("generation") == self.newest()).collect():
            if self._digest(self.spark.read.parquet(r.path)) != (r.rows, r.digest):
                wrong.append(r.name)
        return wrong

    def backup(self, to: str) -> None:
        """Copy the newest generation; the manifest, copied last, makes it complete."""
        at = self.newest()
        entries = []
        for r in self._manifests().where(F.col("generation") == at).collect():
            path = f"{to.rstrip('/')}/tables/{r.name}/g{at:012d}"
            self.spark.read.parquet(r.path).write.mode("overwrite").parquet(path)
            entries.append((at, r.name, path, r.rows, r.digest))
        self._commit(entries, at, to.rstrip("/"))

    @staticmethod
    def restore(spark: SparkSession, backup: str, to: str) -> VersionedStore:
        """A store made of a backup, once it is found whole."""
        whole = VersionedStore(spark, backup)
        if wrong := whole.verify():
            raise ValueError(f"the backup of {', '.join(sorted(wrong))} isn't what its manifest says")
        whole.backup(to)
        return VersionedStore(spark, to)

    def inspect(self) -> DataFrame:
        """(name, path, rows, digest) of the newest generation."""
        return self._manifests().where(F.col("generation") == self.newest()).drop("generation")

    def export_json(self, name: str, to: str, spaces: list[str]) -> None:
        self.read(name).where(F.col("space_id").isin(spaces)).write.mode("overwrite").json(to)


def put_blobs(existing: DataFrame, sources: DataFrame, text: str = "text") -> DataFrame:
    """(blob, content) of sources that the table doesn't have: each content once, by its SHA-256."""
    rows = sources.select(F.sha2(text, 256).alias("blob"), F.col(text).alias("content")).dropDuplicates(["blob"])
    return rows.join(existing.select("blob"), "blob", "left_anti")


def corrupt_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs whose content isn't what their name says."""
    return blobs.where(F.sha2("content", 256) != F.col("blob")).select("blob")


_made: list[tuple[SparkSession, str]] = []


def working_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the session names for checkpoints; only where driver and executors are one process may it name none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratalens-")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete all working tables written so far; results that still read them become unusable."""
    while _made:
        spark, path = _made.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone already; the folder is then the cluster's to clear
            pass


atexit.register(release)


def settled(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: a table written to the working folder and read again."""
    spark = df.sparkSession
    path = working_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """A short list, bounded by the limit that made it, as a table of its own: what made it isn't planned again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
