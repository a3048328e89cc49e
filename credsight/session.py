"""Spark session and small plan helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "credsight") -> SparkSession:
    """Return the active session or build a local one configured like the tests.

    On a cluster the session already exists and owns every setting; the
    builder options below only apply to a fresh local session.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; in a local session without
    one set a fresh scratch folder.  A cluster must name a shared folder."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="credsight-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001  some deployments forbid runtime changes of core confs
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context: their Python workers unpickle
    functions by module name and need not share the driver's working folder or path."""
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_credsight_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith((".py", ".txt")):
                    at = os.path.join(folder, f)
                    z.write(at, os.path.relpath(at, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="credsight-package-"), "credsight.zip")   # read by the driver alone
    with open(path, "wb") as out:
        out.write(held.getvalue())
    sc.addPyFile(path)
    sc._credsight_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den with 0, NULL and non-finite results mapped to 0.0 (pandas safe_div)."""
    q = F.try_divide(num.cast("double"), F.nullif(den.cast("double"), F.lit(0.0)))
    return F.coalesce(F.when(F.abs(q) != F.lit(float("inf")), q), F.lit(0.0))


def positive_ratio(num: Column, den: Column) -> Column:
    """NULL when num is NULL or den is NULL, zero or negative; else num / den."""
    return F.when(num.isNotNull() & (den > 0), num.cast("double") / den.cast("double"))


def round6(c: Column) -> Column:
    return F.round(c, 6)


def add_columns(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.withColumns(cols)


def fresh_scratch(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint folder (never reused)."""
    import uuid

    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this driver wrote under the shared folder; to be
    called when the results built on them are consumed.  Returns how many went."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a parquet table in a fresh folder under the shared
    checkpoint folder and read it back: cuts the lineage (survives executor
    loss), gives a columnar, pruned scan and real size statistics to the
    planner."""
    path = fresh_scratch(df.sparkSession, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)
