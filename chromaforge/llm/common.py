"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rules, as a Java regular expression and as plain characters.
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"

#: Parquet's vectored reads keep direct buffers as large as a column chunk for every reading thread, beside the heap.
#: Tables with whole texts are read column chunk by column chunk without them, so an executor's memory stays bounded.
READ = {"parquet.hadoop.vectored.io.enabled": "false"}

#: Rows and bytes of an Arrow batch sent to Python at most. A batch lies in the executor beside the heap and once more in
#: the Python worker; Spark's default of 10,000 rows sets no bound where texts are long.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20

_own_folders: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.options(**READ).parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary folder of its own; any other session must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own_folders:
            _own_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        where = _own_folders[context.applicationId]
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.options(**READ).schema(df.schema).parquet(path)
    table.table_path = path
    return table


def map_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of bounded size (a smaller bound of the session stays)."""
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)
    if not conf.get(size, None):
        conf.set(size, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "table_path", None)
        if path:
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words between ASCII white space, in order; none for null or blank text."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, GAP))


def lower_ascii(text: Column) -> Column:
    """text in lower case such that no letter outside A-Z becomes an ASCII one (two letters need a stand-in)."""
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    return F.lower(safe)
