"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# What a deployment should set; submit-time values always win over these.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "serieslake", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine: there the one
    machine is the whole cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    named = tempfile.mkdtemp(prefix="serieslake-")
    spark.sparkContext.setCheckpointDir(named)
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/serieslake/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever they run; once per application."""
    context = spark.sparkContext
    if getattr(context, "_serieslake_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="serieslake-code-")) / "serieslake.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for module in sorted(package.rglob("*.py")):
            archive.write(module, Path(package.name) / module.relative_to(package))
    context.addPyFile(str(target))  # the driver serves it to executors that join later, too
    context._serieslake_shipped = True
