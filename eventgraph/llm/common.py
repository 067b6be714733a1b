"""What several operators share: reliable checkpoints and batch-wise Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows and bytes of what a worker's Python works on at once, and rows of the batches that Spark sends it.
ROWS_AT_ONCE, BYTES_AT_ONCE, ROWS_SENT = 512, 4 << 20, 2048
#: A key with more than one in so many rows is hot; there are fewer hot keys than this.
HOT = 1000


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that all executors share.

    The folder is the one the session names in spark.checkpoint.dir; where none is set, a folder
    in the warehouse, which is shared as well.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, or in the warehouse where no checkpoint folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def own(df: DataFrame, *names: str) -> str:
    """A column name with the given stem that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = names[0]
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add; case does not count in names."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(column: str | Column) -> Column:
    """Words of a text; a null text has none."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def sliced(batch: pa.RecordBatch, rows: int = ROWS_AT_ONCE, size: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows and, unless it is one row, so many bytes."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > size):
        half = batch.num_rows // 2
        yield from sliced(batch.slice(0, half), rows, size)
        yield from sliced(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends Python no larger batches than ROWS_SENT rows from now on.

    Spark's default of 10,000 documents costs an executor some 300 MB in both of its processes; the
    bound on bytes (64 MB by default) stays as it is, and results do not depend on either.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= ROWS_SENT:
        df.sparkSession.conf.set(key, str(ROWS_SENT))
    return df


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with small parts of a batch for each call of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                yield work(part)

    return small_batches(df).mapInArrow(run, schema)


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of rows with a materialised table of one row a key, n of which says how many rows have the key.

    Rows of hot keys never meet in one task: those keys, fewer than HOT, are broadcast.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT > total
    few = F.broadcast(table.where(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(table.where(~hot), key))


def utf8_views(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text of a string column as its UTF-8 bytes, without a copy; a null text is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    for start, end, null in zip(bounds[:-1], bounds[1:], nulls):
        yield raw[0:0] if null else raw[start:end]


def columns_of(df: DataFrame, needed: str) -> None:
    """Fail early, and by name, where a column is missing."""
    missing = [c for c in needed.split() if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def crc32_sql(digits: str, table: str) -> str:
    """DuckDB's SQL for the CRC-32 of an ASCII string, over a table made by CRC32_TABLE_SQL."""
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({digits}, ''), lambda x: ascii(x)::ubigint)), lambda c, b: xor(c >> 8, {table}[((xor(c, b) & 255) + 1)::bigint])), 4294967295)::bigint"


CRC32_TABLE_SQL = "select list(c order by i) crc from (select i, list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i))"
