"""Where intermediate tables go: a folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Share of the driver's largest heap that may be in use by the JVM when a table is written, before garbage is collected.
GROWN = 0.5


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session's own inside the one that ``spark.checkpoint.dir`` names.

    Where the setting is absent and the master is this machine (tests), a temporary folder is made and used for
    checkpoints too; on a cluster, whose executors would write where nobody else can read, that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
            spark.sparkContext.setCheckpointDir(base)
        _ROOTS[app] = f"{base.rstrip('/')}/gridloom-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _ROOTS[app])
    return _ROOTS[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` from whichever store it names; at exit the session may be gone already."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the gateway is closed: nothing is left to ask
        pass


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def collect_garbage(spark: SparkSession) -> bool:
    """Collect the driver's garbage if its heap has grown past ``GROWN`` of its limit; whether it had.

    An operator of many queries leaves plans, broadcasts, shuffles and task metrics of those that are done.  They are
    let go only when the driver collects its garbage, and a heap that has grown shrinks only in a full collection.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() <= GROWN * runtime.maxMemory():
        return False
    gc.collect()  # what Python still names, the JVM keeps
    spark._jvm.java.lang.System.gc()
    return True


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    collect_garbage(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
