"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that may be changed on a running session.  Sizes of shuffle
# partitions are left to adaptive execution: it starts from a high number and
# merges small partitions, so the same code runs on a laptop and on a cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # small inputs with costly expressions keep their parallelism
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # long texts: what a Python worker holds at a time is bounded by bytes, not by rows
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application.

    Spark copies the archive to every executor, so workers find the package
    even where it was neither installed nor put on their path.
    """
    context = spark.sparkContext
    if getattr(context, "_tallygrain_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tallygrain-")) / "tallygrain.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, str(Path(top.name) / source.relative_to(top)))
    context.addPyFile(str(archive))
    context._tallygrain_shipped = True


# removes the shuffle files of a query as soon as it has ended; Spark before 4.0 does not know it
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For queries whose result is read from its table: what they shuffled goes when they end.

    Otherwise Spark keeps it until the driver happens to collect its garbage.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def get_session(master: str = "local[*]", app: str = "tallygrain", **conf: str) -> SparkSession:
    """Create a session for tests, benchmarks and notebooks."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": "8",
        **RUNTIME_CONF,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Tables and checkpoints go there, so an executor or driver that is lost can
    be replaced.  Only on one machine, where the setting may be absent (tests),
    is a temporary folder used; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallygrain-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tallygrain/{purpose}-{uuid.uuid4().hex}"
