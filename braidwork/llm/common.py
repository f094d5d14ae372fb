"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.session import delete, discard, drop_scratch, drop_stored, scratch_path, shared_dir, stored  # noqa: F401

#: Rows, and about as many bytes, that a Python worker takes up at once.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows and about BATCH_BYTES. Spark bounds a batch in bytes itself, so no setting of the session is touched."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(rows, n * BATCH_BYTES // max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = BATCH_ROWS, keep: tuple[str, ...] = (), read: tuple[str, ...] = ()) -> DataFrame:
    """Arrow batches through a function of column lists; make() runs once a task and returns that function.

    Columns in keep are passed on as they are, whatever their type. The function sees those in read, by default all
    that aren't in keep.
    """
    made = T._parse_datatype_string(schema)
    arrow = arrow_schema(made)
    out_type = T.StructType([*made.fields, *(T.StructField(k, df.schema[k].dataType) for k in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in pieces(batches, rows):
            at = {k: i for i, k in enumerate(batch.schema.names)}
            out = each({k: batch.column(i).to_pylist() for k, i in at.items() if (k in read if read else k not in keep)})
            columns = [pa.array(out[f.name], f.type) for f in arrow] + [batch.column(at[k]) for k in keep]
            yield pa.RecordBatch.from_arrays(columns, names=[*arrow.names, *keep])

    return df.mapInArrow(run, out_type)


#: The one column that holds a row's other columns while an operator works, so that no name can clash.
REST = "_row"


def packed(df: DataFrame, *inner: str) -> DataFrame:
    """The inner columns, and all columns of df, of any name and type, as one struct REST (null where there are no others)."""
    others = [F.col(f"`{x}`") for x in df.columns if x not in inner]
    return df.select(*inner, (F.struct(*others) if others else F.lit(None).cast("int")).alias(REST))


def unpacked(df: DataFrame, columns: list[str], own: dict[str, Column]) -> DataFrame:
    """The columns in their order: those in own by their expressions, others out of REST."""
    return df.select(*(own[x].alias(x) if x in own else F.col(REST).getField(x).alias(x) for x in columns))


def arrow_schema(fields: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([pa.field(f.name, kinds[f.dataType.simpleString()]) for f in fields])


def ascii_lower(c: Column) -> Column:
    """Only A-Z change."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def cuts(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 ascending values that deal the rows into about equal ranges; the number of parts bounds what reaches the driver."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 20_000)).first()[0]
    return sorted(set(found or []))


def parts_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def range_index(column: Column, at: list[int]) -> Column:
    """How many of the ascending cuts are <= the value (0 for a null): a binary search in a literal array, so the plan doesn't deepen with the number of ranges."""
    if not at:
        return F.lit(0)
    cuts_ = F.expr(f"array({', '.join(f'{x}L' if x > -(1 << 63) else 'long(-9223372036854775808)' for x in at)})")
    powers = F.array(*(F.lit(1 << k) for k in reversed(range(len(at).bit_length()))))
    return F.aggregate(powers, F.lit(0), lambda place, p: F.when(F.get(cuts_, place + p - 1) <= column, place + p).otherwise(place))


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, by way of Arrow: no Python worker has to start for them on the executors."""
    arrow = arrow_schema(T._parse_datatype_string(schema))
    columns = zip(*rows) if rows else [()] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)
