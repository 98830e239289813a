"""What several operators share: tables in the shared folder, skew-safe group lookups, defined ids."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are null take part in every operator as this smallest id, so that order and equality stay defined.
NULL_ID = -(2**63)
#: The white space of the text contracts: blank and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set, a local session gets one of its own
    machine; a cluster has to name one, as its executors couldn't read the driver's."""
    here = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        here = spark.sparkContext.getCheckpointDir()
    if not here:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        here = tempfile.mkdtemp(prefix="patrika-")
        spark.sparkContext.setCheckpointDir(here)
    return here.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; grouped by application, for clearing up."""
    return f"{shared_dir(spark)}/patrika/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has stored. For when its results are written: until then they may be read."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/patrika/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here and lost executors cost nothing. What
    the driver's Python no longer needs goes back to the machine before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    released()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def defined_id(col: str | Column) -> Column:
    """The id as a long that is never null."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("long"), F.lit(NULL_ID))


def real_id(col: str | Column) -> Column:
    """Undoes defined_id."""
    return F.nullif(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID))


def named(name: str) -> Column:
    """The column of exactly this name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def released() -> None:
    """Gives the memory that Python has used and no longer needs back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives the memory that it has used back to the machine at its end: Spark keeps Python workers for the next
    tasks, and what each of them has once used would add up beside the executor's own memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return whole


def with_measured(docs: DataFrame, source: Column, out_col: str, kind: str, measure: Callable[[Iterator[pa.Array]], Iterator[pa.Array]]) -> DataFrame:
    """docs with `out_col` of type `kind`, which `measure` makes of `source`, array by array; it replaces a column of
    that name. The other columns go along under their positions, so their names don't matter."""
    rest = [c for c in docs.columns if c != out_col]
    plain = docs.select(source.alias("_source"), *[named(c).alias(f"_{i}") for i, c in enumerate(rest)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sources() -> Iterator[pa.Array]:
            for batch in batches:
                held.append(batch)
                yield batch.column(0)

        for made in measure(sources()):
            batch = held.pop()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], [*batch.schema.names[1:], "_made"])

    return plain.mapInArrow(run, plain.drop("_source").schema.add("_made", kind)).toDF(*rest, out_col)


def with_group(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], spread: Sequence[str | Column], having: Column | None = None, how: str = "inner", salts: int = 32) -> DataFrame:
    """df with the aggregates of each row's group, without a hot group meeting in one task.

    Rows carry a salt from `spread`. Groups are aggregated map-side first, and the one row of a group is repeated
    only for the salts that occur in it, so the join deals a group to as many as `salts` tasks. Keys must not be null.
    Rows that are equal in all of `spread` share a salt; where those are very many, Spark splits the join's partition.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    groups = salted.groupBy(*keys).agg(*aggs, F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_held"))
    if having is not None:
        groups = groups.filter(having)
    groups = groups.withColumn("_salt", salts_of("_held", salts)).drop("_held")
    return salted.join(groups, [*keys, "_salt"], how).drop("_salt")


def with_lookup(df: DataFrame, table: DataFrame, key: str, spread: Sequence[str | Column], how: str = "inner", salts: int = 32) -> DataFrame:
    """df joined with the rows that `table` has for its `key`, without a hot key meeting in one task: df carries a salt
    from `spread`, and rows of the table are repeated for the salts that occur with their key. Keys must not be null."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    held = salted.groupBy(key).agg(F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_held"))
    rows = table.join(held, key).withColumn("_salt", salts_of("_held", salts)).drop("_held")
    return salted.join(rows, [key, "_salt"], how).drop("_salt")


def salts_of(held: str, salts: int = 32) -> Column:
    """A row for each salt whose bit is set."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.call_function("getbit", F.col(held), i) == 1))


def groups_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first n_keys columns; a group that goes on waits for the rest."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in range(n_keys))

    for b in batches:
        if not b.num_rows:
            continue
        last = key(b, b.num_rows - 1)
        lo, hi = 0, b.num_rows - 1  # first row of the last key
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if key(b, mid) == last else (mid + 1, hi)
        if lo or (held and key(held[-1], held[-1].num_rows - 1) != last):
            done = [*held, b.slice(0, lo)] if lo else held
            yield pa.Table.from_batches(done)
            held = []
        held.append(b.slice(lo))
    if held:
        yield pa.Table.from_batches(held)
