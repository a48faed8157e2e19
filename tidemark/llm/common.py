"""What the operators share: worker import path, shared tables, Arrow text buffers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when the driver found it by its own sys.path."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), ROOT]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, a local master takes a folder of its own; a cluster, whose executors share none, is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and no executor's loss undoes it. options are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the table is what later jobs read; its shuffle files need not wait for a garbage collection
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote, once what was made of them is stored itself; they are not to be read again."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def n_words(text) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column laid end to end, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    buffers, n = column.buffers(), len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, limit: int = 4 << 20, column: str = "text"):
    """Cuts record batches so that each holds about `limit` bytes of text, and one row at least."""
    for batch in batches:
        ends = np.cumsum(np.diff(utf8(batch.column(column))[1]))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column out of bytes laid end to end."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII blanks: blank, tab, line feed, vertical tab, form feed, return.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: a binary column of them, the offsets of each text's words in it, and where in the data each begins."""
    solid = ~BLANK[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = solid[first]  # a word ends with its text
    at = np.flatnonzero(starts)
    upto = np.concatenate([[0], np.cumsum(solid)])
    words = binary(data[solid], np.append(upto[at], upto[-1]))
    return words, np.searchsorted(at, offsets), at


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: equal numbers stay equal, close ones become far apart."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def window_hashes(values: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of every window of `width` numbers, built by doubling; salt the numbers with mixed() first."""
    with np.errstate(over="ignore"):
        n = len(values) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        power, have = np.uint64(base | 1), 1
        block, block_power = values.astype(np.uint64), power
        out, out_len, left = None, 0, width
        while left:
            if left & 1:
                if out is None:
                    out, out_len = block, have
                else:
                    m = min(len(out), len(block) - out_len)
                    out = out[:m] * block_power + block[out_len : out_len + m]
                    out_len += have
            left >>= 1
            if left:
                m = len(block) - have
                block = block[:m] * block_power + block[have : have + m]
                block_power, have = block_power * block_power, have * 2
        return mixed(out[:n])
