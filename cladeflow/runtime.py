"""Session, shared storage and skew helpers used by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_MADE: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller's session is used.

    shared: the folder for written tables (spark.checkpoint.dir); None: a temporary one.
    """
    if shared is None:
        shared = "file://" + tempfile.mkdtemp(prefix="cladeflow_")
        _MADE.append(shared)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cladeflow")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir of the session, or what setCheckpointDir was given.

    Only where both are unset on a single machine (master local) a temporary folder of this
    process is used; on a cluster that is an error, as its machines share no such folder.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not given:
        set_dir = sc._jsc.sc().getCheckpointDir()
        given = set_dir.get() if set_dir.isDefined() else None
    if given:
        return given
    if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="cladeflow_")
    return _OWN_DIR[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder is then the cluster's to clean
        pass


@atexit.register
def cleanup() -> None:
    """Deletes the tables that materialize() has written in this process."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())
    for d in [*_OWN_DIR.values(), *_MADE]:
        shutil.rmtree(d[len("file://") :], ignore_errors=True)
    _OWN_DIR.clear()
    _MADE.clear()


def materialize(df: DataFrame, name: str = "t", partition_by: list[str] | None = None, keep_shuffles: bool = True) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors.

    keep_shuffles: False removes df's shuffle files as soon as it is written; else they stay until
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"cladeflow_{name}_{uuid.uuid4().hex}")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    try:
        if not keep_shuffles:
            spark.conf.set(_DROP_SHUFFLES, "true")
        writer.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cladeflow_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing reads any more, such as the last round of a loop."""
    path = getattr(df, "_cladeflow_path", None)
    for k, (spark, p) in enumerate(_WRITTEN):
        if p == path:
            _delete(spark, p)
            del _WRITTEN[k]
            return


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over at least two tasks per core, for work whose cost is not in its bytes.

    The number is given, so that adaptive planning does not merge small partitions into one task.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hot_keys(df: DataFrame, keys: list[str], rows_per_salt: int) -> DataFrame:
    """Keys of df with more than rows_per_salt rows and their number of salts.

    At most count(df) / rows_per_salt rows; counted with map-side combine.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_cf_n"))
        .where(F.col("_cf_n") > rows_per_salt)
        .select(*keys, F.ceil(F.col("_cf_n") / F.lit(float(rows_per_salt))).cast("int").alias("_cf_salts"))
    )


def salt_hot(left: DataFrame, right: DataFrame, keys: list[str], row_id: str, rows_per_salt: int = 200_000) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi-join, spread by the column _cf_salt where left keys are hot, and the keys to join on.

    The hot keys are counted once and written. If there are none, both sides come back as they
    are. Else the rows of a left key with more than rows_per_salt rows are spread over salts and
    the right rows of that key repeated once per salt; all other keys have the one salt 0.
    """
    if left.limit(rows_per_salt + 1).count() <= rows_per_salt:  # too few rows for a hot key
        return left, right, keys
    hot = materialize(hot_keys(left, keys, rows_per_salt), "hot")
    if hot.isEmpty():
        return left, right, keys
    spread = F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_cf_salts")), F.lit(0)).cast("int")
    left = dimension_join(left, hot, keys, row_id).withColumn("_cf_salt", spread).drop("_cf_salts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_cf_salts"), F.lit(1)) - 1))
    right = dimension_join(right, hot, keys, keys[0]).withColumn("_cf_salt", each).drop("_cf_salts")
    return left, right, [*keys, "_cf_salt"]


def is_small(df: DataFrame, rows: int = 50_000, megabytes: int = 16) -> bool:
    """Whether a table has at most so many rows and so much text; reads no more than rows + 1 of it."""
    width = F.length(F.to_json(F.struct(*df.columns)))
    seen = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return seen["n"] <= rows and seen["b"] <= megabytes * 1_000_000


def dimension_join(left: DataFrame, dim: DataFrame, keys: list[str], row_id: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join of a large table with a table of one or a few small rows per key, safe for hot keys.

    dim should be cheap to read (a table on disk): its size is checked, and it is broadcast if
    is_small. Else every dim row is repeated salts times and a left row looks up the copy of its
    salt, so that a key with a third of all rows is spread over salts tasks.
    """
    if is_small(dim):
        return left.join(F.broadcast(dim), keys, how)
    left = left.withColumn("_cf_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    dim = dim.withColumn("_cf_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(dim, [*keys, "_cf_salt"], how).drop("_cf_salt")
