"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``.

    Where none is configured, a local session gets a folder of its own that
    goes with the process; on a cluster that is an error, since the executors
    could not read back what the others wrote.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pathloom-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there (reliable, survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def storable(text: str) -> str:
    """``text`` as valid Unicode: escaped surrogate pairs become their character, lone halves the replacement sign."""
    if text.isascii() or not any("\ud800" <= c <= "\udfff" for c in text):
        return text
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def fits_broadcast(df: DataFrame, row_bytes: int, limit_bytes: int) -> bool:
    """Whether ``df`` has provably at most ``limit_bytes`` when a row takes ``row_bytes``.

    Counts at most one row beyond the bound, so the check itself stays cheap.
    """
    most = max(1, limit_bytes // max(1, row_bytes))
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed columnar table: for results that are read again by only some of their columns."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that ``written`` left in the shared folder.
_TABLES: list[str] = []


def discard_tables(spark: SparkSession) -> int:
    """Remove the tables this process has written so far, once no DataFrame on them is needed any more; how many there were."""
    n = 0
    while _TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        n += 1
    return n


def ship_package(spark: SparkSession) -> None:
    """Let the workers of this application import the package, wherever it lies on the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_pathloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pathloom-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))  # executors fetch it from the driver
    sc._pathloom_shipped = True
