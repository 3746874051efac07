"""The session's shared folder, lineage cuts in it, and the package's source for executors that have no copy of it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session.  Only where it names none: one of our own, on this machine in local mode (as in
    tests) and in the warehouse on a cluster, where no other folder is known to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = Path(tempfile.mkdtemp(prefix="snapstore-")).as_uri() if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.snapstore"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and written to the shared folder, with its lineage cut."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once a session, so that they need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent.parent
    # the driver's file server reads it as long as the program runs
    target = os.path.join(tempfile.mkdtemp(prefix="snapstore-zip-"), "snapstore_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(target)
