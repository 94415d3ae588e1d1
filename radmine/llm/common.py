"""Helpers shared by the corpus operators: reading, cutting lineage, joins against small tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of narrow rows (a key and a few numbers, under 100 bytes each) is broadcast: 10 MB at most.
BROADCAST_ROWS = 100_000
#: Copies of a small-but-not-broadcast table in a salted join.
SALTS = 32
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *columns: str) -> str:
    """A column name like `name` that none of `columns` has (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder. Where neither
    is set, a local session gets a folder of its own; on a cluster that is an error, since machines don't see each other's."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        current = sc.getCheckpointDir()
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; release() removes what was written there."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables and archives that this process has written to the shared folder; results read from them lazily must
    have been written elsewhere before. Returns how many paths were there."""
    jvm, n = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: lost executors cost no recomputation."""
    sc = df.sparkSession.sparkContext
    path = shared_dir(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; columns keep their types."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt: Column | None = None, rows: int | None = None) -> DataFrame:
    """Join to an already materialized, narrow table with unique keys.

    Its rows are counted: up to BROADCAST_ROWS it is broadcast. Beyond that both sides shuffle, and where `salt`
    (a column of `big`) is given, `small` is replicated SALTS times so that no key of `big` meets one task.
    """
    n = small.count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    if salt is None:
        return big.join(small, on, how)
    extra = fresh("salt", *big.columns, *small.columns)
    wide = small.withColumn(extra, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn(extra, F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(wide, [*on, extra], how).drop(extra)


def frugal(spark: SparkSession) -> None:
    """Small Arrow batches for rows that hold whole texts, unless the session asks for others: the default of 10,000 rows or
    64 MB a batch, held by the JVM and by each Python worker at once, leaves little of a small executor."""
    for key, default, ours in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "16777216b")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def trim() -> None:
    """Give a Python worker's freed memory back to the system (workers live on and serve other stages)."""
    import ctypes
    import gc

    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: one row (node, component) per node that has an edge; component is the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Every step is a groupBy-min with map-side
    combine and an equi-join that adaptive execution can split, so a centre with very many edges never meets one
    task; rounds grow with the logarithm of the longest path. Edges are checkpointed each round.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        # large star: strictly larger neighbours of u go to the smallest neighbour of u (u itself included)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        nxt = big.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(nxt.where("u <> v").distinct())
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
