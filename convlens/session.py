"""Session helpers.

The library sets nothing on a cluster.  ``spark.checkpoint.dir`` is read from the
session; only a local run may leave it unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Filled in only where the configuration leaves them unset.
_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, app: str = "convlens", **conf: str) -> SparkSession:
    """Return the active session, or build one.

    Values given here win; the defaults are those of a local run, and are set
    only for a local master and only where the configuration (spark-submit,
    spark-defaults) says nothing.
    """
    active = SparkSession.getActiveSession()
    if active is not None and master is None and not conf:
        return active
    from pyspark import SparkConf

    given = SparkConf()
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if (master or given.get("spark.master", "local")).startswith("local"):
        for k, v in _LOCAL_DEFAULTS.items():
            if not given.contains(k):
                builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder under the system's
    temporary one; any other master is an error, since executors would write
    to their own disks.  Jobs cut lineage with written tables, never with
    local checkpoints.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="convlens-ckpt-")
    sc.setCheckpointDir(local)
    return local


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that tasks import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="convlens-code-"), "convlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("convlens", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """A scope of intermediate tables: those that ``cut_lineage`` writes inside are removed at its end.

    Only for work whose result no longer reads them: a model at the driver, or
    rows written with ``keep=True``.
    """
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.pop()
        for path in own:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    read it back: the plan is computed once (``DataFrame.checkpoint`` computes
    it twice unless cached), the data is columnar, and it survives executor
    loss.  Never a machine-local folder on a cluster, never ``localCheckpoint``.
    With ``keep`` the table outlives the innermost ``scratch`` scope.
    """
    path = os.path.join(checkpoint_dir(df.sparkSession), "tables", uuid.uuid4().hex)
    around = _scopes[:-1] if keep else _scopes
    if around:
        around[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Caller's rows as a table whose size Spark knows, so that a join with a short list is a broadcast and shuffles nothing."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds), schema)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
