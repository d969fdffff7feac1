"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_local_scratch: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(master: str | None = None, app: str = "voltledger", **conf: str) -> SparkSession:
    """A session with the settings the plans assume.

    Shuffle partitions are left to adaptive execution: it starts from the
    configured number and merges small or splits skewed partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # The JVM leaves larger methods interpreted; beyond this size Spark uses
        # its row operators, whose code is split into small methods.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.session.timeZone": "UTC",
        # Sums of scaled integers must fail on overflow; without it they would wrap.
        "spark.sql.ansi.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """``hugeMethodLimit`` as above for an action run inside, whatever the session."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str | None:
    """Folder every executor can reach, for small derived tables.

    It is ``spark.checkpoint.dir`` where that is set.  A local session without
    the setting gets a temporary folder; a cluster without it gets None, which
    callers refuse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.TemporaryDirectory(prefix="voltledger-")
        atexit.register(_local_scratch[app].cleanup)
    return _local_scratch[app].name


def ends_with_session(spark: SparkSession, folder: str) -> str:
    """``folder``, made if missing and removed when the session's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)  # of a folder that isn't there it takes no note
    return folder
