"""Session with the settings that results depend on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Results depend on the time zone; the rest lets adaptive execution size and split shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: Applications whose workers have been sent the package.
_SHIPPED: set[str] = set()


def build_session(name: str = "pitsight", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def new_folder(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names; without one (tests), below the temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    return f"{named or os.path.join(tempfile.gettempdir(), 'pitsight-streams')}/{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """The rows as a table of files in the shared folder, in folders of their own by the columns named: for loops, as
    files have their true sizes and no lineage. Columns that have folders come last, as Spark reads them."""
    path = new_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers where they couldn't find it: unless its folder is on PYTHONPATH, or is
    the working one of workers on this machine. Once for each application."""
    root = Path(__file__).resolve().parent.parent
    here = Path.cwd() == root and spark.sparkContext.master.startswith("local[")
    if spark.sparkContext.applicationId in _SHIPPED or here or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(spark.sparkContext.applicationId)
    archive = Path(tempfile.mkdtemp()) / "pitsight.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "pitsight").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
