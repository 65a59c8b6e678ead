"""Spark session defaults for the library.

On a cluster the session already exists and its settings win; these helpers
only fill in what is unset (UTC clock, AQE, skew-join handling).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings the operators rely on. The time zone matters for correctness:
# the reference canonicalises every timestamp to UTC.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Performance defaults; only applied when the session does not set them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "cytotide",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one (local runs and tests)."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        spark = active
    else:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        # Checkpoint files of materialised small sides are removed once unreferenced.
        builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        builder = builder.config("spark.driver.memory", os.environ.get("CYTOTIDE_DRIVER_MEMORY", "8g"))
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        for k, v in (extra or {}).items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and lineage-cutting tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster's shared
    folder). Only when it is unset — local runs and tests — a scratch folder
    is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder shared by all "
                               "executors (a machine-local folder is not safe on a cluster)")
        path = tempfile.mkdtemp(prefix="cytotide-ckpt-")
        try:  # recorded for readers of the conf; some deployments reject core keys at run time
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001
            pass
    sc.setCheckpointDir(path)
    return path


_SHIPPED: set = set()
PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def ship_code(spark: SparkSession, *package_dirs: str) -> None:
    """Make Python packages importable on executors (``addPyFile`` of a zip).

    Needed where executor-side Python runs library code (the SQLite
    DataSource reader). Done once per application and package; defaults to
    this package.
    """
    sc = spark.sparkContext
    for pkg in package_dirs or (PACKAGE_DIR,):
        pkg = os.path.abspath(pkg)
        key = (sc.applicationId, pkg)
        if key in _SHIPPED:
            continue
        out = os.path.join(tempfile.mkdtemp(prefix="cytotide-py-"), os.path.basename(pkg) + ".zip")
        with zipfile.ZipFile(out, "w") as z:
            for root, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        sc.addPyFile(out)
        _SHIPPED.add(key)
