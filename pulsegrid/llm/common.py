"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import materialize

#: Words of the contracts: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text (or of ids) that a Python worker works on at once.
SLICE_BYTES = 2_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    lineage, so a lost executor costs a re-read and not a recomputation."""
    return materialize(df, f"llm-{name}")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def row_key(*columns: Column) -> Column:
    """128-bit key of the given values; a null differs from every value.  Rows
    with equal values have equal keys, so they can be told apart only by count."""
    parts: list[Column] = []
    for c in columns:
        text = c.cast("string")
        parts += [F.coalesce(F.length(text).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.unhex(F.md5(F.concat(*parts)))


def pieces(count: int, per_piece: int) -> int:
    """How many pieces of at most about ``per_piece`` rows hold ``count`` rows."""
    return max(1, math.ceil(count / per_piece))


def ranked(df: DataFrame, *order: Column, out: str = "_rank") -> DataFrame:
    """``df`` with its place, from 0, in the order of ``order``.  Rows are dealt
    by range, ties too, so no task and no window holds more than a part; what
    reaches the driver is one count per part."""
    # The columns of ``df`` travel in one struct, so that none meets a name of this function.
    row = F.struct(*[column(c).alias(f"c{k}") for k, c in enumerate(df.columns)])
    keys = [F.col(f"o{k}") for k in range(len(order))]
    dealt = df.select(row.alias("row"), *[c.alias(f"o{k}") for k, c in enumerate(order)], F.monotonically_increasing_id().alias("tie"))
    parts = staged(dealt.repartitionByRange(*keys, F.col("tie")).withColumn("part", F.spark_partition_id()), "ranked")
    offsets, at = [], 0
    for part, n in sorted(tuple(r) for r in parts.groupBy("part").count().collect()):
        offsets.append((part, at))
        at += n
    before = df.sparkSession.createDataFrame(offsets, "part int, before long")
    own = Window.partitionBy("part").orderBy(*keys, "tie")
    placed = parts.withColumn("within", F.row_number().over(own)).join(F.broadcast(before), "part")
    return placed.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(df.columns)],
                         (F.col("before") + F.col("within") - 1).cast("long").alias(out))


def column(name: str) -> Column:
    """The top-level column ``name``, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def byte_slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of at most ``limit`` bytes, a larger value alone."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def added(df: DataFrame, value: Column, work: Callable[[], Callable[[pa.Array], pa.Array]], out: dict[str, str],
          keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``df`` and new columns ``out`` (name -> type) that
    Arrow batches of ``value`` give: ``work()`` runs once per task and returns
    the function from an Arrow array to a struct array with the fields of
    ``out``, by place.  Names of ``df`` meet no internal name: its columns
    travel in one struct.
    """
    fields = T.StructType([T.StructField(f"f{k}", T.StructType.fromDDL(f"x {kind}")[0].dataType) for k, kind in enumerate(out.values())])
    row = F.struct(*[column(c).alias(f"c{k}") for k, c in enumerate(keep)], F.lit(0).alias("none"))
    ready = df.select(row.alias("row"), value.alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = None
        for batch in batches:
            do = do or work()
            value = batch.column(1)
            for a, b in byte_slices(pc.fill_null(_bytes_of(value), 0).to_pylist(), SLICE_BYTES):
                got = do(value.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), got], names=["row", "out"])

    schema = T.StructType([ready.schema["row"], T.StructField("out", fields)])
    made = ready.mapInArrow(run, schema)
    return made.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(keep)],
                       *[F.col("out")[f"f{k}"].alias(c) for k, c in enumerate(out)])


def _bytes_of(value: pa.Array) -> pa.Array:
    """Bytes of each text, or about those of each list of 32-bit numbers."""
    if pa.types.is_list(value.type) or pa.types.is_large_list(value.type):
        return pc.multiply(pc.list_value_length(value), 4)
    return pc.binary_length(value)
