"""Session helpers that every layer shares."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table, read as fewer partitions than there are cores, out to all of them; others stay as they are.

    For work that takes much more time a row than reading it does.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Weight of results, in characters, after which a Python worker passes them on.
PASSED_ON = 500_000


def row_by_row(batches: Iterable[tuple[pa.Array, ...]], make: Callable, weigh: Callable[[object], int], kind: pa.DataType) -> Iterator[pa.Array]:
    """`make` of each row of Arrow columns. Rows are read one at a time and results passed on as soon as they weigh
    PASSED_ON, so a worker's memory doesn't follow the size of its batches."""
    made, held = [], 0
    for columns in batches:
        for row in zip(*columns, strict=True):
            out = make(*(v.as_py() for v in row))
            made.append(out)
            held += weigh(out)
            if held >= PASSED_ON:
                yield pa.array(made, kind)
                made, held = [], 0
        if made:
            yield pa.array(made, kind)
            made, held = [], 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    A temporary one is set only where none is given and all runs on one machine, as in tests; a cluster must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, by Hadoop, so that any path works."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize `df` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 1 in the given order, without one task that holds them all: they are sorted in ranges, and
    a range begins after those before it. One count for each range reaches the driver."""
    rows = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for r in sorted(rows.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
        starts += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    start = F.create_map(*starts)[part] if starts else F.lit(0)
    return rows.withColumn(name, (start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_at")
