"""Hierarchical packing of documents into windows of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, ship, utf8
from .tokens import coder, tokenizer_path, with_end

TIERS = (512, 1024, 2048, 4096)
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Packer:
    """Packs the pieces of one partition's documents, as they come.

    A document longer than the longest window fills whole windows; what is left is routed to the shortest tier that holds it. Long tiers go first: a window takes its tier's
    largest piece, then the largest shorter pieces that fit, and if none fits, the gap takes the head of the shortest piece left. So each window is full. What can't fill
    a window waits for later documents; at the end the rest fills windows whose lengths are the powers of two that make it up.
    Windows of one tier are dealt to step groups of `step_tokens` tokens each, so that steps cost alike.
    """

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_id: int):
        self.tiers, self.step_tokens, self.next_id = sorted(tiers), step_tokens, first_id
        self.first_id, self.pool, self.waiting, self.order = first_id, [], 0, 0
        self.dealt: dict[int, int] = {}
        self.groups: dict[tuple[int, int], int] = {}
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        longest, n = self.tiers[-1], len(ids)
        whole = n - n % longest
        for start in range(0, whole, longest):
            self._emit([(longest, 0, doc, start, ids[start : start + longest], n)], longest)
        if n > whole:
            self._wait((n - whole, 0, doc, whole, ids[whole:], n))

    def _wait(self, piece: tuple) -> None:
        self.order += 1
        insort(self.pool, (piece[0], self.order, *piece[2:]), key=lambda p: p[:2])
        self.waiting += piece[0]

    def _fill(self, length: int) -> None:
        """Fills one window; there are tokens enough."""
        gap, pieces = length, []
        while gap:
            at = bisect_right(self.pool, gap, key=lambda p: p[0])
            piece = self.pool.pop(at - 1 if at else 0)
            self.waiting -= piece[0]
            if piece[0] > gap:
                size, _, doc, start, ids, n = piece
                self._wait((size - gap, 0, doc, start + gap, ids[gap:], n))
                piece = (gap, 0, doc, start, ids[:gap], n)
            pieces.append(piece)
            gap -= piece[0]
        self._emit(pieces, length)

    def _emit(self, pieces: list[tuple], length: int) -> None:
        k = self.dealt.get(length, 0)
        self.dealt[length] = k + 1
        group = self.groups.setdefault((length, k // max(1, self.step_tokens // length)), self.first_id + len(self.groups))
        offset = 0
        for size, _, doc, start, ids, n in pieces:
            self.out.append((doc, start, size, zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_id, offset, length, group))
            offset += size
        self.next_id += 1

    def pack(self, last: bool = False) -> None:
        for below, tier in reversed(list(zip([0, *self.tiers], self.tiers, strict=False))):
            while self.waiting >= tier and self.pool and self.pool[-1][0] > below:
                self._fill(tier)
        if last:
            while self.waiting:
                self._fill(min(self.tiers[-1], 1 << (self.waiting.bit_length() - 1)))

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[]] * 9
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])


def pack_documents(documents: DataFrame, path: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65536) -> DataFrame:
    """Packs all documents (doc_id, text) into windows of `tiers` token lengths.

    Returns one row per piece, PIECE_SCHEMA: its place in the document and in its sequence, the CRC-32 of its ids as little-endian unsigned 32-bit integers, the sequence's length (tier) and
    step group. Every id lies in one piece; every sequence is full, so nothing is padded.
    Null or empty text: the end id alone. Null doc_id: kept. Repeated rows: packed each. Empty table: no rows. Other columns are not read.
    Each partition packs its own rows as they come, about 4 MB of text at a time, so nothing is shuffled and a hot source needs no care; sequence_id holds the partition above bit 40.
    """
    ship(documents.sparkSession)

    def pack(batches):
        from pyspark import TaskContext

        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 40)
        for batch in chunks(batches):
            ids, offsets = with_end(*coder(path).encode(*utf8(batch.column("text"))), end_id)
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(doc, ids[offsets[i] : offsets[i + 1]])
            packer.pack()
            yield packer.taken()
        packer.pack(last=True)
        yield packer.taken()

    return documents.select("doc_id", "text").mapInArrow(pack, PIECE_SCHEMA)


def op10_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), end_id=2)
