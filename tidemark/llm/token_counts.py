"""Token counts by a map-side two-tier lookup: a broadcast hash table of frequent chunks, and each worker's cache for the rest."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, dropped, mixed, ship, stored, utf8
from .tokens import coder, tokenizer_path

#: Bytes of the longest chunk that the table holds, and distinct chunks that a task counts at once.
LONGEST, COUNTED = 16, 400_000
#: Masks of the lowest 0 to 8 bytes of a word.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def packed(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of up to LONGEST bytes as two numbers each. 16 bytes follow the last chunk."""
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
    return words[begins] & MASKS[np.minimum(sizes, 8)], words[begins + 8] & MASKS[np.maximum(sizes - 8, 0)]


class ChunkTable:
    """An open-addressing hash table in four arrays: a chunk's two numbers and its size, compared exactly, and its token count."""

    def __init__(self, known: list[bytes], tokens: list[int]):
        sizes = np.array([len(k) for k in known], np.int64)
        low, high = packed(np.frombuffer(b"".join(known) + bytes(16), np.uint8), np.cumsum(sizes) - sizes, sizes)
        room = 1 << max(4, int(2 * len(known)).bit_length())
        self.low, self.high = np.zeros(room, np.uint64), np.zeros(room, np.uint64)
        self.size, self.tokens = np.zeros(room, np.int8), np.zeros(room, np.int32)
        for k, slot in enumerate(self._slot(low, high).tolist()):
            while self.size[slot]:
                slot = (slot + 1) & (room - 1)
            self.low[slot], self.high[slot], self.size[slot], self.tokens[slot] = low[k], high[k], sizes[k], tokens[k]

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mixed(low ^ mixed(high, 51), 52) & np.uint64(len(self.low) - 1)).astype(np.int64)

    def find(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Token counts of chunks of up to LONGEST bytes, -1 of those that the table has not."""
        low, high = packed(data, begins, sizes)
        out, live, slot = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slot(low, high)
        while len(live):
            hit = (self.low[slot] == low[live]) & (self.high[slot] == high[live]) & (self.size[slot] == sizes[live])
            out[live[hit]] = self.tokens[slot[hit]]
            on = ~hit & (self.size[slot] > 0)
            live, slot = live[on], (slot[on] + 1) & (len(self.low) - 1)
        return out


def frequent_chunks(documents: DataFrame, path: str, size: int) -> ChunkTable:
    """A table of the chunks that make up at least one in `size` of all chunks: at most `size`, for all texts are counted.

    A task sends the chunks that come as often among its own (a chunk that does so nowhere does not do so on the whole), and how many it counted. When it holds
    COUNTED different ones, it takes off one count of each until half are left. Token counts never depend on the table, only how fast they are found.
    """

    def count(batches):
        found, total = Counter(), 0
        for batch in chunks(batches):
            words, _ = coder(path).chunks(*utf8(batch.column("text")))
            total += len(words)
            found.update(words)
            while len(found) > COUNTED:
                found = Counter({k: n - 1 for k, n in found.items() if n > 1})
        own = {k: n for k, n in found.items() if n * size >= total and len(k) <= LONGEST}
        yield pa.RecordBatch.from_arrays([pa.array([None, *own], pa.binary()), pa.array([total, *own.values()], pa.int64())], names=["chunk", "n"])

    def tokens(batches):
        for batch in batches:
            numbers = coder(path).numbers(batch.column("chunk").to_pylist())  # first, for it may lay out the counts anew
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(coder(path).count[numbers].astype(np.int32))], names=["chunk", "tokens"])

    sums = documents.select("text").mapInArrow(count, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    sums = stored(sums, "chunk-sums")
    whole = sums.where("chunk IS NULL").agg(F.sum("n")).head()[0] or 0
    top = sums.where(F.col("chunk").isNotNull() & (F.col("n") * size >= whole)).select("chunk").mapInArrow(tokens, "chunk binary, tokens int").collect()
    dropped(sums)
    return ChunkTable([bytes(r.chunk) for r in top], [r.tokens for r in top])


def count_tokens(documents: DataFrame, path: str, limit: int = 2048, size: int = 16384) -> DataFrame:
    """Counts the tokens of every row's whole text as the tokenizer at `path` gives them, without added special tokens.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Null or empty text: 0 and 0. Repeated rows and null numbers: each row counted by its text.
    Empty table: no rows. Other columns are not read. No text is shuffled; the broadcast holds `size` chunks of LONGEST bytes at most, each worker's cache 600,000.
    """
    spark = ship(documents.sparkSession)
    frequent = spark.sparkContext.broadcast(frequent_chunks(documents, path, size))

    def count(batches):
        table, own = frequent.value, coder(path)
        for batch in chunks(batches):
            data, offsets = utf8(batch.column("text"))
            if not own.checked:
                first = min(8, batch.num_rows)
                own.encode(data[: offsets[first]], offsets[: first + 1])
            laid, begins, ends, sizes = own.spans(data, offsets)
            width = ends - begins
            counts = np.full(len(begins), -1, np.int64)
            short = np.flatnonzero(width <= LONGEST)
            counts[short] = table.find(laid, begins[short], width[short])
            missing = np.flatnonzero(counts < 0)
            raw = laid.tobytes()
            numbers = own.numbers([raw[a:b] for a, b in zip(begins[missing].tolist(), ends[missing].tolist(), strict=True)])
            counts[missing] = own.count[numbers]
            total = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
