"""Sessions and what executors need."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(app: str = "stratalens", **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; ``conf`` (underscores for dots) overrides."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each application, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_stratalens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stratalens-"), "stratalens_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    context._stratalens_shipped = True
