"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tiersmith", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the submitter's own session is used instead."""
    root = str(Path(__file__).resolve().parents[1])
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # Python workers find the package from any folder
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    b = SparkSession.builder.master(f"local[{n}]").appName(app)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of a running session whose machines don't have it installed."""
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tiersmith-")) / "tiersmith.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate results.

    It is the one the session names in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder: on a cluster a machine-local
    path would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tiersmith-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once, so that later passes re-read them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def task_slots(spark: SparkSession) -> int:
    """Partitions for compute-bound grouped work.

    An explicit number keeps adaptive execution from merging groups whose
    input is small in bytes but expensive to process.
    """
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * spark.sparkContext.defaultParallelism, shuffle)


BYTES_PER_SLOT = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before per-row numeric work, when a small input would come in few partitions.

    Decided from the optimizer's size estimate, which runs nothing. A large
    input already has many partitions and is returned as it is.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < BYTES_PER_SLOT * spark.sparkContext.defaultParallelism:
        return df.repartition(task_slots(spark))
    return df
