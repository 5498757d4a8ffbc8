"""Portable packages: records of some spaces as JSON, with a manifest that says what must be in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.model import SERVING
from stratalens.operators.governance import duplicate_ids, package_fingerprint

VERSION = 1
_MANIFEST = "version int, records long, digest long, spaces array<string>"


class PackageError(ValueError):
    """A package that can't be read: unknown version, other content than its manifest says, or an id twice."""


def write_package(records: DataFrame, path: str, spaces: list[str]) -> None:
    """Write the records of these spaces; the manifest comes last and makes the package complete."""
    rows = records.where(F.col("space_id").isin(spaces))
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/records")
    told = package_fingerprint(read_records(records.sparkSession, path)).first()
    manifest = records.sparkSession.createDataFrame([(VERSION, told.records, told.digest or 0, sorted(spaces))], _MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERVING).json(f"{path}/records")


def read_package(spark: SparkSession, path: str) -> DataFrame:
    """The records of a package that is found whole."""
    manifest = spark.read.schema(_MANIFEST).json(f"{path}/manifest").first()
    if manifest is None or manifest.version != VERSION:
        raise PackageError("the package's version isn't known")
    records = read_records(spark, path)
    told = package_fingerprint(records).first()
    if (told.records, told.digest or 0) != (manifest.records, manifest.digest):
        raise PackageError("the records aren't those of the manifest")
    if duplicate_ids(records).limit(1).count():
        raise PackageError("an id is there twice")
    if records.where(~F.col("space_id").isin(manifest.spaces)).limit(1).count():
        raise PackageError("a record is of a space that the package doesn't have")
    return records
