"""Session, storage and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the stored tables, read only through Spark's own reader.

    Texts that come in fewer pieces than there are cores (a single small file) are dealt out
    first; a large table is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir`` (every executor sees it).

    Only where a local session has no such setting (tests) is one chosen; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so
    a lost executor costs a reread and not a recomputation. ``slim``: the rows are few
    beside the input (ids, links), so a sixteenth of the usual files holds them."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if slim:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a ``store`` result that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of rows that go to a Python worker at once, so that very long texts don't gather.
ARROW_BYTES = 8 << 20


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(function, schema)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns with any name can't clash."""
    return df.select(*[df[f"`{n}`"] for n in names])


def remainder(col: str, by: int):
    """crc32 of the id as text, modulo ``by``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null")).cast("binary")) % by


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string column without a copy; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    nulls = np.asarray(column.is_null(), dtype=bool) if n else np.zeros(0, bool)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), nulls
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0], nulls


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have about ``limit`` bytes, or are one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at, _ = text_buffers(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
            yield batch.slice(i, min(j, n) - i)
            i = min(j, n)


def blocks(rows: DataFrame, most: int) -> Iterator[list]:
    """The ``rows`` of a stored table in blocks of about ``most`` by their hashes, each on the driver in its turn only."""
    many = -(-rows.count() // most)
    if many <= 1:
        yield rows.collect()
        return
    path = shared_dir(rows.sparkSession, "blocks")
    rows.withColumn("_block", F.pmod(F.xxhash64(*rows.columns), F.lit(many)).cast("int")).repartition(min(many, 200), "_block").write.partitionBy("_block").parquet(path)
    schema = StructType([*rows.schema.fields, StructField("_block", IntegerType())])
    for b in range(many):
        yield rows.sparkSession.read.schema(schema).parquet(path).where(F.col("_block") == b).collect()


def crc32_utf8(col):
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary"))


def grouped(df: DataFrame, keys: list[str], function, schema: str, dealt: bool = False) -> DataFrame:
    """``function`` (RecordBatch of one group → RecordBatch or None) for each group of equal
    ``keys`` (longs and ints). Rows are dealt (if they aren't ``dealt`` already) and sorted by key and
    read as a stream, so that many small groups cost little more than their rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def each(t: pa.Table, last: bool):
            x = t.combine_chunks()
            k = np.stack([x.column(c).to_numpy().astype(np.int64) for c in keys], 1)
            cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            edges = [0, *cut.tolist(), *([len(k)] if last else [])]
            batch = x.to_batches()[0]
            out = [y for lo, hi in zip(edges[:-1], edges[1:], strict=True) if (y := function(batch.slice(lo, hi - lo))) is not None and y.num_rows]
            return out, x.slice(edges[-1])

        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                out, rest = each(t if rest is None or not rest.num_rows else pa.concat_tables([rest, t]), False)
                yield from out
        if rest is not None and rest.num_rows:
            yield from each(rest, True)[0]

    return arrow_map((df if dealt else df.repartition(parts, *keys)).sortWithinPartitions(*keys), run, schema)
