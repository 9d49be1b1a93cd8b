"""Session helpers: defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "sessionlog") -> SparkSession:
    """Local session for tests, scripts and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; create a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` must name shared storage and is used as is.
    Local runs and tests, where it is unset, get a fresh temporary folder.  Works without a
    SparkContext (Spark Connect): the setting is then read from the session conf.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect has no SparkContext
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="sessionlog-ckpt-", dir=os.environ.get("SESSIONLOG_SCRATCH", "/tmp"))
    if sc is None:
        return conf_dir
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def materialize(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` but keeps the data columnar, so
    later consumers read only the columns they use.  The folder is unique per
    call; on a cluster it lives in ``spark.checkpoint.dir`` (shared storage).
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def ship_package(spark) -> None:
    """Give the executors this package as a zip file, once for each Spark context.

    Python code that runs in tasks imports the package, which need not be
    installed on the workers or lie on their path.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the package must be installed or sent with addArtifacts
        return
    if sc.applicationId in _shipped:
        return
    sc.addPyFile(package_zip())
    _shipped.add(sc.applicationId)


def package_zip() -> str:
    """The package in a new zip file.  Its folders need an ``__init__.py``: zips have no namespace packages."""
    import zipfile
    from pathlib import Path

    home = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="sessionlog-zip-"), "sessionlog_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(home.rglob("*.py")):
            out.write(p, p.relative_to(home.parent))
    return path


_shipped: set[str] = set()
