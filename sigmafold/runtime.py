"""Session settings and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = uuid.uuid4().hex[:12]
_cleaned: set[str] = set()


def local_session(app: str = "sigmafold", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set only where none is."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sigmafold-")
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(_remove_tree, named)
    return named.rstrip("/")


def _remove_tree(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/sigmafold/{_RUN}/{tag}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these, once nothing will read it again."""
    for table in tables:
        discard(table.sparkSession, table._scratch)


def _is_scan(df: DataFrame) -> bool:
    """Whether every row of ``df`` is a row of a file, chosen and projected at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def numbered(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` with a number for every row that each reading gives alike, and the name of that column, which no other has.

    A row of a file is numbered by its file and its place there.  Other rows are written once with their
    numbers: a number that each scan makes anew would follow how the work is split, and that changes with
    the executors.
    """
    name, taken = "__row", {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    if "_metadata" not in taken and _is_scan(df):
        spark, file = df.sparkSession, f"{name}_file"
        place = [F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(name)]
        try:
            rows = df.select("*", *place)
            # One row for each file, of which the driver holds a listing already; no column is read.
            files = [(f, k << 40) for k, f in enumerate(sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect()))]
            listed = spark.createDataFrame(files, f"`{file}` string, `{name}_first` bigint")
            joined = rows.join(F.broadcast(listed), file, "left")
            first = F.when(F.col(f"{name}_first").isNull(), F.raise_error(F.lit("a file that wasn't listed"))).otherwise(F.col(f"{name}_first"))
            return joined.select(*[F.col(f"`{c}`") for c in df.columns], (first + F.col(name)).alias(name)), name
        except AnalysisException:
            pass  # a format without places of rows
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), tag), name


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through the file system that Spark itself uses."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
