"""Token-id files: each document compressed by itself with one shared zstandard dictionary, in blocks with an offset index."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary, chunks, shared_dir, ship, utf8
from .tokens import coder, tokenizer_path, with_end

#: Ids are stored as little-endian unsigned 16-bit integers, or 32-bit where a vocabulary needs it.
BLOCK_SCHEMA = "part int, block int, first_doc long, last_doc long, n_ids long, width int, dictionary string, doc_ids array<bigint>, counts array<int>, ends array<bigint>, data binary"


def train_dictionary(documents: DataFrame, path: str, sample: int, size: int) -> bytes:
    """A dictionary of about `size` bytes from the serialized ids of about `sample` documents of up to 20,000 characters, those with the smallest hashes of number and text.

    The sample bounds what training holds on the driver, whatever the number of documents (a parameter, like the dictionary's size); any dictionary gives the same ids.
    """
    share = min(1.0, sample / max(1, documents.count()))

    def serialize(batches):
        for batch in chunks(batches):
            ids, offsets = coder(path).encode(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([binary(ids.astype("<u2").view(np.uint8), offsets * 2)], names=["ids"])

    # By a threshold on the hash, so that no task sends more than its share; repeated rows have one hash and go once.
    own = documents.select("doc_id", "text").where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(share * (1 << 40))) & F.length("text").between(1, 20000))
    picked = own.dropDuplicates().limit(2 * sample)
    samples = [bytes(r.ids) for r in picked.mapInArrow(serialize, "ids binary").collect() if len(r.ids) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on
        return b"".join(samples)[:size]


def write_token_files(documents: DataFrame, target: str, path: str, end_id: int, sample: int = 512, dictionary_size: int = 32768, level: int = 3, parts: int | None = None) -> None:
    """Writes the ids of all documents, in ascending doc_id order, to the folder `target`.

    target/dictionary holds the dictionary and its SHA-256; target/blocks the blocks (about 4 MB of text each, BLOCK_SCHEMA): frames laid end to end, the end of each in
    `ends`, the ids in each in `counts`; target/starts the number of ids before each block. All are Parquet, written and committed by Spark.
    Null text: empty. Null doc_id: first. Equal doc_ids: by text. Repeated rows: one frame each. Empty table: no blocks. Other columns are not read.
    Rows are dealt by ranges of doc_id; a task holds one block at a time.
    """
    spark = ship(documents.sparkSession)
    dictionary = train_dictionary(documents, path, sample, dictionary_size)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{target}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        raw = shared.value
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for number, batch in enumerate(chunks(batches)):
            ids, offsets = with_end(*coder(path).encode(*utf8(batch.column("text"))), end_id)
            width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
            laid = ids.astype(f"<u{width}").tobytes()
            frames = [press.compress(laid[width * offsets[i] : width * offsets[i + 1]]) for i in range(batch.num_rows)]
            docs = batch.column("doc_id").to_pylist()
            named = [d for d in docs if d is not None]
            row = {"part": part, "block": number, "first_doc": min(named, default=None), "last_doc": max(named, default=None), "n_ids": len(ids), "width": width, "dictionary": sha, "doc_ids": docs, "counts": np.diff(offsets).tolist(), "ends": np.cumsum([len(f) for f in frames]).tolist(), "data": b"".join(frames)}
            yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("dictionary", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("data", pa.binary())])
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = documents.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{target}/blocks")
    sizes = spark.read.schema(BLOCK_SCHEMA).parquet(f"{target}/blocks").select("part", "block", "n_ids")
    # Two levels: parts are few (one row each), and blocks are summed within their part.
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    starts = sizes.withColumn("inside", inside).join(by_part, F.col("part") == F.col("p")).select("part", "block", (F.col("base") + F.col("inside")).alias("start"))
    starts.write.parquet(f"{target}/starts")


def _frames(target_dictionary: str, dictionary, wanted=None):
    """Reads blocks: every document, or those whose doc_id is in `wanted`, by their offsets alone."""

    def decode(batches):
        raw = dictionary.value
        if hashlib.sha256(raw).hexdigest() != target_dictionary:
            raise ValueError("the dictionary is not the one that these files name")
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("dictionary", "start", "width", "doc_ids", "counts", "ends", "data")}
                if row["dictionary"].as_py() != target_dictionary:
                    raise ValueError("a block names another dictionary")
                docs, counts, ends = row["doc_ids"].values, row["counts"].values.to_numpy(), row["ends"].values.to_numpy()
                data, width = row["data"].as_buffer(), row["width"].as_py()
                begins, starts = ends - np.diff(ends, prepend=0), row["start"].as_py() + np.cumsum(counts) - counts
                at = range(len(counts)) if wanted is None else np.flatnonzero(np.isin(docs.to_numpy(zero_copy_only=False), wanted))
                ids = [np.frombuffer(unpress.decompress(memoryview(data)[begins[i] : ends[i]]), f"<u{width}").astype("<u4").tobytes() for i in at]
                if any(len(x) != 4 * counts[i] for x, i in zip(ids, at, strict=True)):
                    raise ValueError("a frame has not the ids that its index tells of")
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(list(at), pa.int64())), pa.array(starts[list(at)], pa.int64()), pa.array(counts[list(at)].astype(np.int64)), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return decode


def read_token_files(spark: SparkSession, target: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Reads write_token_files() back: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit).

    With doc_ids, blocks are pruned by first_doc and last_doc, and only the frames of those documents are decompressed.
    """
    ship(spark)
    row = spark.read.parquet(f"{target}/dictionary").head()
    shared = spark.sparkContext.broadcast(bytes(row.dictionary))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{target}/blocks")
    if doc_ids is not None:
        blocks = blocks.where(" OR ".join(f"(first_doc <= {int(i)} AND last_doc >= {int(i)})" for i in doc_ids) or "false")
    starts = spark.read.schema("part int, block int, start long").parquet(f"{target}/starts")
    joined = blocks.join(starts, ["part", "block"]).select("dictionary", "start", "width", "doc_ids", "counts", "ends", "data")
    return joined.mapInArrow(_frames(row.sha256, shared, None if doc_ids is None else np.array(doc_ids, np.int64)), "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    target = f"{shared_dir(spark)}/tidemark/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), target, tokenizer_path(), end_id=2)
    return read_token_files(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
