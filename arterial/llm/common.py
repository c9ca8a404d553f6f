"""Storage, ranks and connected components shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of an Arrow batch for Python workers, which a task holds several times; kernels cut batches to a megabyte anyway.
BATCH_BYTES = 8 << 20

_ROOTS: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: inside ``spark.checkpoint.dir``, which every node shares.

    Where that is unset, a local master gets a temporary folder; on a cluster no folder is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        base = f"file://{tempfile.gettempdir()}/arterial"
    root = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(release, spark)
    return root


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to ``BATCH_BYTES``; a smaller one stays. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application. Call it once no result depends on them."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    for root in list(_ROOTS):
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _ROOTS.discard(root)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_paths = [path]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the tables behind results of :func:`stored` (or of what keeps its ``stored_paths``) that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for name in getattr(df, "stored_paths", []):
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ranked(df: DataFrame, columns: list[str], rank: str, name: str) -> DataFrame:
    """``df`` (distinct in ``columns``) with a long that grows with the columns' order, without gaps of meaning.

    Range partitions are sorted one by one, so no task sees all rows. The table is written before
    anything reads the ranks, because a second evaluation could cut the ranges elsewhere.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    return stored(out.withColumn(rank, F.monotonically_increasing_id()), name)


def components(edges: DataFrame, name: str = "components", rounds: int = 64) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)`` by alternating large and small stars.

    Returns ``(node, component)`` for every node of an edge that isn't its component's smallest one;
    all others are their own component. The edges may be discarded then. Each round is two aggregations that combine before the
    shuffle and two joins that adaptive execution can split, so a hub costs no single task all its
    edges. The number of rounds grows with the logarithm of the longest path.
    """
    e = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        name,
    )
    before = _mark(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.select("u", F.col("m").alias("v")).union(near.select(F.col("v").alias("u"), F.col("m").alias("v")))
        last, e = e, stored(small.where("u <> v").distinct(), name)
        discard(last)
        now = _mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    out.stored_paths = e.stored_paths
    return out


def _mark(e: DataFrame) -> tuple:
    """Count and an order-free digest of the edges: equal for equal sets."""
    row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    return tuple(row)


def text_key(df: DataFrame) -> DataFrame:
    """``doc_id, th, text``: null ids sort after all others (largest long), ``th`` tells equal ids apart."""
    return df.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"),
        F.xxhash64("text").alias("th"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
