"""Session construction and shared-storage helpers.

The engine never writes to a machine-local temporary folder on a cluster:
scratch output and lineage cuts go under the shared folder the cluster names
in ``spark.checkpoint.dir``.  Only when that is unset (local tests) do we set
one of our own.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Defaults sized for a large cluster are applied by the caller; these are the
# settings every session of ours carries regardless of size.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "tablewright", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's base configuration."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  Only in local mode, where driver and
    executors are one process, is a folder of our own set when none is named."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tablewright-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for an input of ``input_bytes`` on ``cores`` task slots:
    scan splits and initial shuffle partitions of ~``target_partition_bytes``
    (AQE then coalesces small ones and splits skewed ones)."""
    parts = max(cores * 2, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that several passes read
    columns and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


@contextmanager
def compiled_methods(spark: SparkSession):
    """Queries planned inside generate no method beyond the 8,000 bytes up to which the JVM
    compiles; a stage of many expressions otherwise becomes one that is only interpreted."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_staged(df: DataFrame) -> None:
    """Delete the folder of a frame made by ``staged`` that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


_NOT_IN_PARQUET = re.compile(r"\b(void|interval|variant)\b")


def storable(df: DataFrame) -> bool:
    """Whether Parquet holds all columns of ``df``."""
    return not _NOT_IN_PARQUET.search(df.schema.simpleString())


#: Plan nodes that a pass over stored columns may have.
_SCAN_NODES = re.compile(r"Relation|LogicalRDD|LocalRelation|Range|Project|Filter|SubqueryAlias")


def staged_if_derived(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it scans stored columns, so that each pass reads only those it
    needs; anything that joins, shuffles, unites or samples is staged once, whatever its
    size.  Rows with columns that Parquet cannot hold stay as they are."""
    nodes = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    if all(_SCAN_NODES.search(re.sub(r"^[\s:+!'-]*", "", n).split(" ")[0]) for n in nodes if n.strip()):
        return df
    return staged(df, name) if storable(df) else df
