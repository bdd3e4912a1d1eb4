"""Shared plumbing of the training-data operators: session settings, scratch tables, table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: documents average a few kB, so a batch stays at a few MB.
BATCH_ROWS = 512

#: Groups with one in so many rows or more are broadcast to their rows.
HEAVY = 10_000

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, since one row may hold a whole document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a
    temporary one; on a cluster that is an error, since executors could not read what the driver's machine holds."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lodestate-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder (a subfolder for each value of `by`) and read it back: lineage is cut, and a
    lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[back] = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove tables of `materialize` that nothing lazy reads any more."""
    for df in frames:
        path = _paths.pop(df, None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with `_doc`, a number of each row in the order of doc_id: doc_id itself, or where ids repeat or are null a row number in
    the order of (doc_id, text), nulls last; and whether it is a row number. All columns but doc_id, text and n_chars get neutral names,
    so that no name of a caller's column meets one of an operator's; toDF(*docs.columns) gives theirs back."""
    named = docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"column{i}" for i, c in enumerate(docs.columns)))
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return named.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), False  # not nullable: no filter, one exchange
    ordered = named.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return materialize(ordered.withColumn("_doc", F.monotonically_increasing_id()), "keyed"), True


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """rows joined with groups, which have one row for each key and in `size` the number of rows with that key, of `total`. Groups with
    one in `heavy` rows or more, at most `heavy` of them, are broadcast, so that no hot key shuffles; the others join by key."""
    large = F.broadcast(groups.where(F.col(size) * heavy >= total))
    small = groups.where(F.col(size) * heavy < total)
    return rows.join(large, on).unionByName(rows.join(large, on, "left_anti").join(small, on, how))


def unused(docs: DataFrame, name: str) -> str:
    """name, or where docs has such a column a longer one that it has not."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> F.Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def bounded_sample(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows, whole: those of the n smallest row hashes in the table, of equal rows one. Every row has its chance, and
    the choice doesn't depend on partitions or order. Only hashes are sorted; the rows are fetched by them."""
    keyed = rows.withColumn("_key", F.xxhash64(*rows.columns))
    last = keyed.select("_key").orderBy("_key").limit(n).agg(F.max("_key")).first()[0]
    return keyed.where(F.col("_key") <= F.lit(last)).dropDuplicates(["_key"]).drop("_key")
