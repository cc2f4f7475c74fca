"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D. All else belongs to words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder, read by Spark (so any file system works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once and passes it to `body`. Without this, an array
    that a lambda looks at would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, in order; no words for a null or blank text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """`df`, with the session's Arrow batches kept to few rows, as rows are whole texts here:
    a batch is held by the executor, the pipe and the worker, some of it twice. The setting stays
    lowered in the session, as plans read it when they run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(key)) > rows or int(conf.get(key)) <= 0:
        conf.set(key, rows)
    return df


def tasks_for(spark: SparkSession, total: int, size: int = 64 << 20) -> int:
    """Tasks for a shuffle of `total` bytes: no fewer than the session's, and `size` bytes in each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // size + 1)


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the session names none, a temporary one is set on
    one machine (tests); on a cluster that would lose data, so it is refused."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leadloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, for tables of a few numbers a row, in no more than `parts`
    partitions. Spark removes its files with spark.cleaner.referenceTracking.cleanCheckpoints once the table isn't used any more."""
    _shared_folder(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def parts_for(spark: SparkSession, rows: int, each: int = 2000) -> int:
    """Partitions for tables that go with a counted number of rows: `each` of these in one, two for each core at least. Small
    tables of long chains of steps would else cost a task and a file for each of the session's partitions in each step."""
    return max(2 * spark.sparkContext.defaultParallelism, rows // each + 1)


def near(small: DataFrame, rows: int, most: int = 300_000) -> DataFrame:
    """A table for the small side of a join: broadcast if it was counted to have no more than `most` rows."""
    return F.broadcast(small) if rows <= most else small


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a Parquet table in the checkpoint folder, for texts."""
    path = f"{_shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that `written` gave."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of an action when it ends, not when the driver's JVM next collects garbage. For
    chains of steps that each write a table and don't run a frame twice.

    Spark would end an action as soon as one side of a join is known to be empty, while stages of the other side still run. Their
    tasks then ask for shuffles that are gone and hold their cores till the request times out (120 s, several times), so this
    short cut is off inside."""
    key, rules = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.optimizer.excludedRules"
    before, others = spark.conf.get(key), spark.conf.get(rules, None)
    spark.conf.set(rules, ",".join(filter(None, [others, "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"])))
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
        spark.conf.unset(rules) if others is None else spark.conf.set(rules, others)


def looked_up(rows: DataFrame, table: DataFrame, key: str, own: str, hot: int = 1000) -> DataFrame:
    """`rows` with the columns of `table` (key: binary, copies, ...), null where the key has none.

    `copies` tells how many rows have a key. Those with more than one in `hot` of all copies would be
    one task's; there are fewer than `hot` of them, so they are broadcast. Their rows, and rows with a null key, are
    spread by the column `own` in the join of the others, where they look for nothing."""
    total = table.agg(F.sum("copies")).first()[0] or 0
    values = [c for c in table.columns if c not in (key, "copies")]
    side = lambda df, x: df.select(F.col(key).alias(f"_{x}_key"), *[F.col(v).alias(f"_{x}_{v}") for v in values])
    out = rows.join(F.broadcast(side(table.filter(F.col("copies") * hot > total), "hot")), F.col(key) == F.col("_hot_key"), "left")
    idle = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_key", F.when(idle, F.coalesce(F.col(own).cast("string"), F.lit("")).cast("binary")).otherwise(F.col(key)))
    out = out.join(side(table, "own"), (F.col("_key") == F.col("_own_key")) & ~idle, "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hot_{v}", f"_own_{v}").alias(v) for v in values])


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: the first
    52 bits of an MD5, which other engines can compute as well."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
