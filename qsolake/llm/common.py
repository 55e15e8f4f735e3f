"""Shared helpers of the corpus operators: shared-folder tables, global ranks, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words and is stripped from lines: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null id where a key can't be null.
NO_ID = -(1 << 63)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (in local mode only) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def with_let(value: Column, body) -> Column:
    """Bind value to a lambda variable, so that a large array is made once however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bytes of an Arrow batch that goes to Python, where the application doesn't set them.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(df: DataFrame) -> DataFrame:
    """df, after the session is told to bound Arrow batches by bytes, as whole texts can be long.

    Every operator that runs Python asks for the same bound, so it doesn't matter which one ran before; a value that the
    application has set, in its configuration or its session, stays. The setting is left, as the plan runs later."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df


def tidy() -> None:
    """Give memory that a task is done with back to the system, as a Python worker outlives its tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run):
    """run, then tidy()."""

    def wrapped(batches):
        yield from run(batches)
        tidy()

    return wrapped


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a column _rank: the exact 0-based position in the order, without a single-task sort.

    The rows are range-sorted and written; a row's place in its own range comes from the sort itself, and
    the ranges' sizes (one row each, as many as there are shuffle partitions) are summed up before it."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    rows = written(ranges.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col("_at"), 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    )
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn("_rank", F.col("_before") + place)
        .drop("_part", "_before", "_at")
    )


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps; each round is written to the shared folder, so that a lost
    executor costs one round. Hubs are only ever read through a partial min and a join on the edge list, which
    adaptive execution can split. Nodes without an edge don't appear; an empty table gives an empty table."""
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    kept: list[str] = []
    state = None
    for _ in range(rounds):
        path = new_path(spark, name)
        now.write.parquet(path)
        now = spark.read.schema("a long, b long").parquet(path)
        kept.append(path)
        if len(kept) > 1:
            removed(spark, [kept.pop(0)])
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state or new[0] == 0:
            break
        state = new
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        now = (
            large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .distinct()
        )
    else:
        raise RuntimeError(f"{name}: no fixed point after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


#: Rows of one side of a comparison block.
BLOCK = 1024


def met(rows: DataFrame, key: Column, member: Column) -> DataFrame:
    """Rows that share their key with another, put into comparison blocks of a bounded size.

    Adds _block (the rows to compare with each other), _left and _right (the two chunks that meet in it) and
    _chunk (the row's own). A key of up to BLOCK rows is one block. A larger one is cut into chunks by the hash of
    member, and each pair of chunks meets in one block: every pair of rows meets, in no task more than two chunks."""
    keyed = rows.withColumn("_key", key)
    shared = (
        keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .select("_key", F.when(F.col("_n") <= BLOCK, 1).otherwise(F.ceil(F.col("_n") * 1.1 / BLOCK)).cast("int").alias("_chunks"))
    )
    chunk = F.pmod(F.xxhash64(member, F.lit("chunk")), F.col("_chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other")
    return (
        keyed.join(shared, "_key").withColumn("_chunk", chunk).select("*", other)
        .withColumn("_left", F.least("_chunk", "_other")).withColumn("_right", F.greatest("_chunk", "_other"))
        .withColumn("_block", F.xxhash64("_key", "_left", "_right"))
        .drop("_key", "_chunks", "_other")
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Each block of met() in one task, its rows together."""
    return rows.repartition(tasks(rows.sparkSession), "_block").sortWithinPartitions("_block")


def blocks(batches, column: str):
    """The rows of one block after the other as Arrow tables, from batches that are sorted by column."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        ids = held.column(column).to_numpy()
        cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if len(cuts):
            for start, end in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                if end - start > 1:
                    yield held.slice(start, end - start)
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows > 1:
        yield held


def forest(adjacent):
    """Star edges (member, smallest member) of the components of a small adjacency matrix."""
    import numpy as np

    label = np.arange(len(adjacent))
    far = len(adjacent)
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], far).min(1))
        new = new[new]
        if (new == label).all():
            at = np.flatnonzero(label != np.arange(len(label)))
            return at, label[at]
        label = new
