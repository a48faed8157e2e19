"""Removal of long byte strings that start in more than one place, by suffix arrays over shards of suspected text.

1. Each string of `length` bytes names its anchor: the GRAM-byte string inside it with the smallest hash (the leftmost of equal ones). Equal strings name equal anchors, so only
   stretches under an anchor found twice can repeat. A stretch holds all strings in a row that name one anchor.
2. Stretches are dealt by anchor. Stretches with equal content are sent once, with their number; so a passage in any number of documents costs one.
3. Each shard of whole anchors gets a suffix array by induced sorting and permuted common prefixes: a start that shares `length` bytes with its neighbour repeats, as does one whose
   stretch comes more than once (where an anchor has only copies of one stretch, there is nothing else to sort it with). Stretches that share no text with another one beside the anchor, on either side, are left out: whatever repeats reaches that far on one side.
   An anchor with more different stretches than a shard should hold (the edge of a passage that very many documents quote) is dealt on by the content of each string: of every string
   found twice two witnesses go to shards of their own, which are sorted like any other.
4. The verdict on each stretch goes back to all its places, and each document's spans are joined.

Several lengths are judged in one pass: anchors are named by the shortest, and stretches reach as far as the longest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import binary, chunks, dropped, mixed, ship, stored, utf8, window_hashes
from .induced import common_prefixes, suffix_array

GRAM = 32
#: Bits of a place in a batch, below the bits of its hash when anchors are chosen: the same at every size, so that equal strings choose alike.
PLACE_BITS = np.uint64(31)
#: Different stretches of one anchor that a shard holds; bytes of a shard (of stretches that are sorted); bytes of anchors that are looked through at once.
MOST_STRETCHES, SHARD_BYTES, GROUP_BYTES = 2048, 2 << 20, 1 << 19
STRETCH_SCHEMA = "anchor long, seg long, doc_id long, tkey long, start int, run int, at int"
PIECE_SCHEMA = "anchor long, seg long, run int, n long, hot boolean, left long, right long, bytes binary"
VERDICT_SCHEMA = "anchor long, seg long, first int, last int, length int"
#: Bytes that hold 51 words of any language at hand, the shortest passage worth a report.
PASSAGE = 280


class _Hashes:
    """Hashes of any part of some bytes, from sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        base = 0x9E3779B97F4A7C15
        self.inverse = np.cumprod(np.full(len(data) + 1, np.uint64(pow(base, -1, 1 << 64))))
        power = np.cumprod(np.full(len(data) + 1, np.uint64(base)))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(np.arange(256), 8)[data] * power[:-1])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin]) ^ mixed(end - begin, 9)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, ...]:
    """Stretches of texts laid end to end: anchor hash, content hash (up to `reach` bytes from the last start), text, first start in the text, number of starts, anchor's distance."""
    none = np.zeros(0, np.int64)
    if not len(data) or int(np.diff(offsets).max()) < length:
        return (none,) * 6
    grams = window_hashes(mixed(np.arange(256), 7)[data], GRAM)
    key = grams >> PLACE_BITS << PLACE_BITS | np.arange(len(grams), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[: len(key) - have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    anchor = (key & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), starts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[text]
    named = anchor[place]
    first = np.flatnonzero(np.append(True, (named[1:] != named[:-1]) | (text[1:] != text[:-1])))
    run = np.diff(np.append(first, len(named)))
    begin, text = place[first], text[first]
    content = _Hashes(data).of(begin, np.minimum(begin + run + reach - 1, offsets[text + 1])) ^ mixed(run, 10)
    return grams[named[first]].astype(np.int64), content.astype(np.int64), text, begin - offsets[text], run, named[first] - begin


def _find(length: int, reach: int):
    def find(batches):
        for batch in chunks(batches, 512 << 10):
            anchor, content, text, *small = stretches(*utf8(batch.column("text")), length, reach)
            at = pa.array(text)
            columns = [pa.array(anchor), pa.array(content), batch.column("doc_id").take(at), batch.column("tkey").take(at), *[pa.array(x.astype(np.int32)) for x in small]]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STRETCH_SCHEMA.split(", ")])

    return find


def _cut(length: int, reach: int):
    """Stretches' bytes out of their texts, with hashes of what stands on either side of the anchor (the stretch's own content hash where the text ends before)."""
    half = (length - GRAM) // 2
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

    def cut(batches):
        for batch in chunks(batches, 2 << 20):
            data, offsets = utf8(batch.column("text"))
            hashes = _Hashes(data)
            lists = batch.column("wanted")
            wanted = lists.flatten()
            text = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            begin = offsets[text] + wanted.field("start").to_numpy()
            end = np.minimum(begin + wanted.field("run").to_numpy() + reach - 1, offsets[text + 1])
            gram, seg = begin + wanted.field("at").to_numpy(), wanted.field("seg").to_numpy()
            sides = []
            for a, b in ((gram - half, gram + GRAM), (gram, gram + GRAM + half)):
                inside = (a >= offsets[text]) & (b <= offsets[text + 1])
                sides.append(np.where(inside, hashes.of(np.where(inside, a, 0), np.where(inside, b, 0)).astype(np.int64), seg))
            step = max(1, (4 << 20) // (2 * reach))
            for k in range(0, len(text), step):
                part = slice(k, k + step)
                ends = np.concatenate([[0], np.cumsum(end[part] - begin[part])])
                where = np.repeat(begin[part] - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
                own = wanted.slice(k, step)
                yield pa.RecordBatch.from_arrays([*[own.field(c) for c in names[:5]], *[pa.array(x[part]) for x in sides], binary(data[where], ends)], names=names)

    return cut


def shared_lengths(pieces: pa.Array, runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces of bytes laid end to end, each found `counts` times: the most bytes that each of the first `runs` starts of a piece shares with any other such start within their pieces.

    Also the piece of each byte, and its place there. What follows the starts is their reach: it may be the text of another piece's starts, so it is sorted but never matched.
    """
    data, offsets = utf8(pieces)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    inner = np.ones(len(data) + n, bool)
    inner[offsets[1:] + np.arange(n)] = False
    laid = np.zeros(len(data) + n, np.uint8)
    laid[inner] = data
    s = laid.astype(np.uint16)
    s += inner  # 0 after each piece; bytes are 1 to 256
    ends = np.repeat((offsets[1:] + np.arange(n)).astype(np.int32), sizes + 1)
    sa = suffix_array(s)
    shared = common_prefixes(laid, sa, ends)[0][sa]
    piece = np.repeat(np.arange(n, dtype=np.int32), sizes)
    place = np.arange(len(data), dtype=np.int32) - np.repeat(offsets[:-1].astype(np.int32), sizes)
    start = np.zeros(len(s), bool)
    start[inner] = place < np.repeat(runs.astype(np.int32), sizes)
    at = start[sa].nonzero()[0]
    best = np.zeros(len(s), np.int32)
    if len(at) > 1:  # what two starts share is the least that neighbours from one to the other share
        between = np.minimum.reduceat(shared, at + 1)[:-1] if at[-1] + 1 < len(shared) else np.minimum.reduceat(shared, at[:-1] + 1)
        best[sa[at[1:]]] = between
        best[sa[at[:-1]]] = np.maximum(best[sa[at[:-1]]], between)
    best = best[inner]
    again = np.repeat(counts > 1, sizes)
    best[again] = (np.repeat(sizes.astype(np.int32), sizes) - place)[again]
    return best, piece, place


def _runs(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner, first place and last place of runs of flagged places."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.append(True, (np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return owner[at[first]], place[at[first]], place[at[last]]


def _sort(lengths: tuple[int, ...]):
    """Shards: whole anchors, about SHARD_BYTES of what must be sorted together."""

    def verdict(table: pa.Table, row: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> pa.RecordBatch:
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([table.column("anchor").combine_chunks().take(at), table.column("seg").combine_chunks().take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(np.full(len(row), length), pa.int32())], names=[c.split()[0] for c in VERDICT_SCHEMA.split(", ")])

    def times(column: pa.ChunkedArray) -> np.ndarray:
        _, which, counts = np.unique(column.to_numpy(), return_inverse=True, return_counts=True)
        return counts[which]

    def told(rows: list[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], pa.Table]:
        """Verdicts of whole anchors that need no sorting, and what must be sorted."""
        table = pa.Table.from_batches(rows).combine_chunks()
        counts, runs, alone = table.column("n").to_numpy(), table.column("run").to_numpy(), times(table.column("anchor")) == 1
        sizes, out = np.diff(utf8(table.column("bytes"))[1]), []
        for length in lengths:  # copies of one stretch and nothing else under its anchor: all that fits in it repeats
            row = np.flatnonzero(alone & (counts > 1) & (sizes >= length))
            out.append(verdict(table, row, np.zeros(len(row), np.int64), np.minimum(runs[row], sizes[row] - length + 1) - 1, length))
        # Hashes of different anchors or sides that meet only keep a stretch more.
        return out, table.filter(pa.array(~alone & ((counts > 1) | (times(table.column("left")) > 1) | (times(table.column("right")) > 1))))

    def shard(tables: list[pa.Table]):
        table = pa.concat_tables(tables).combine_chunks()
        counts, runs = table.column("n").to_numpy(), table.column("run").to_numpy()
        best, owner, place = shared_lengths(table.column("bytes").combine_chunks(), runs, counts)
        starts = place < runs[owner]
        for length in lengths:
            yield verdict(table, *_runs((best >= length) & starts, owner, place), length)

    def anchors(batches):
        """Rows of whole anchors, about GROUP_BYTES together."""
        held, size, last = [], 0, None
        for batch in batches:  # rows come ordered by anchor
            anchor, ends = batch.column("anchor").to_numpy(), utf8(batch.column("bytes"))[1]
            begins = np.flatnonzero(np.append(anchor[:1] != last, anchor[1:] != anchor[:-1]))
            at = 0
            while at < len(anchor):
                k = int(np.searchsorted(ends[begins], ends[at] + GROUP_BYTES - size))  # the first anchor that no longer fits
                to = int(begins[k]) if k < len(begins) else len(anchor)
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(ends[to] - ends[at])
                if k < len(begins):
                    yield held
                    held, size = [], 0
                at = to
            last = anchor[-1:] if len(anchor) else last
        if held:
            yield held

    def sort(batches):
        kept, size = [], 0
        for rows in anchors(batches):
            ready, table = told(rows)
            yield from ready
            if table.num_rows:
                kept.append(table)
                size += int(utf8(table.column("bytes"))[1][-1])
            if size >= SHARD_BYTES:
                yield from shard(kept)
                kept, size = [], 0
        if kept:
            yield from shard(kept)

    return sort


def _strings(length: int):
    """Hashes of every string of `length` bytes that begins at a start of a stretch under a hot anchor."""

    def each(batches):
        for batch in chunks(batches, 256 << 10, "bytes"):
            data, offsets = utf8(batch.column("bytes"))
            salted = [window_hashes(mixed(np.arange(256), k)[data], length) for k in (21, 22)]
            starts = np.clip(np.diff(offsets) - length + 1, 0, batch.column("run").to_numpy())
            row = np.repeat(np.arange(len(starts)), starts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in ("anchor", "seg", "n")], pa.array(place.astype(np.int32)), *[pa.array(h[place + offsets[row]].astype(np.int64)) for h in salted]], names=["anchor", "seg", "n", "place", "h1", "h2"])

    return each


def _joined(length: int):
    """Runs of the starts of a stretch that were judged one by one."""

    def join(batches):
        for batch in batches:
            lists = batch.column("places")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            place = lists.flatten().to_numpy()
            order = np.lexsort((place, owner))
            owner, place = owner[order], place[order]
            new = np.append(True, (np.diff(place) > 1) | (owner[1:] != owner[:-1]))[: len(place)]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place))[: len(first)] - 1
            at = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(at), batch.column("seg").take(at), pa.array(place[first], pa.int32()), pa.array(place[last], pa.int32()), pa.array(np.full(len(first), length), pa.int32())], names=[c.split()[0] for c in VERDICT_SCHEMA.split(", ")])

    return join


def _dealt(pieces: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Verdicts of shards of whole anchors."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_sort(lengths), VERDICT_SCHEMA)


def _hot(pieces: DataFrame, length: int) -> DataFrame:
    """Verdicts under hot anchors: strings found twice are sorted in shards of their own, two witnesses of each (one of a stretch that itself comes more than once may be the only one)."""
    strings = stored(pieces.mapInArrow(_strings(length), "anchor long, seg long, n long, place int, h1 long, h2 long"), "stretch-strings")
    where = F.struct("anchor", "seg", "place")
    twice = strings.groupBy("h1", "h2").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("rows"), F.min(where).alias("a"), F.max(where).alias("b")).where("times > 1")
    sent = twice.select("h1", "h2", F.explode(F.when(F.col("rows") > 1, F.array("a", "b")).otherwise(F.array("a"))).alias("w"), F.when(F.col("rows") > 1, F.lit(1)).otherwise(F.col("times")).cast("long").alias("n"))
    sent = sent.select("h1", "h2", "n", "w.*").join(pieces.select("anchor", "seg", "bytes"), ["anchor", "seg"])
    single = sent.select(F.col("h1").alias("anchor"), F.col("h2").alias("seg"), F.lit(1).alias("run"), "n", F.lit(False).alias("hot"), F.col("h2").alias("left"), F.col("h2").alias("right"), F.expr(f"substring(bytes, place + 1, {length})").alias("bytes"))
    proven = _dealt(single, (length,)).select(F.col("anchor").alias("h1"), F.col("seg").alias("h2")).distinct()
    again = strings.join(proven, ["h1", "h2"], "left_semi").groupBy("anchor", "seg").agg(F.collect_set("place").alias("places"))
    return again.mapInArrow(_joined(length), VERDICT_SCHEMA)


def repeated_spans(keyed: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """For rows (doc_id, tkey, text): doc_id, tkey, spans (array of start byte, end byte and length judged) of rows with repeated strings; equal rows come once."""
    length, reach = min(lengths), max(lengths)
    long = keyed.where(F.octet_length("text") >= length)
    found = stored(long.mapInArrow(_find(length, reach), STRETCH_SCHEMA), "stretches")
    # Stored, and merged by one plan at every size: a join whose two sides are plain shuffles can be split where an anchor is hot.
    twice = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "stretch-anchors")
    # All copies of a stretch are alike, so the first one met stands for them, whose columns come from one row.
    # Grouped by anchor and content as one value: the join's deal by anchor would satisfy two columns and leave a hot anchor in one task.
    kinds = found.join(twice.hint("merge"), "anchor", "left_semi").groupBy(F.struct("anchor", "seg").alias("kind")).agg(*[F.first(c).alias(c) for c in ("doc_id", "tkey", "start", "run", "at")], F.count(F.lit(1)).alias("n"))
    kinds_table = stored(kinds.select("kind.*", "doc_id", "tkey", "start", "run", "at", "n"), "stretch-kinds")
    hot = stored(kinds_table.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > MOST_STRETCHES).select("anchor", F.lit(True).alias("hot")), "stretch-hot")
    wanted = kinds_table.join(hot, "anchor", "left").select(F.col("doc_id").alias("d"), F.col("tkey").alias("k"), F.struct("anchor", "seg", "start", "run", "at", "n", F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    wanted = wanted.groupBy("d", "k").agg(F.collect_list("w").alias("wanted"))
    texts = long.join(wanted, (F.col("tkey") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("text", "wanted")
    pieces = stored(texts.mapInArrow(_cut(length, reach), PIECE_SCHEMA), "stretch-bytes")
    dropped(kinds_table, twice, hot)
    verdicts = _dealt(pieces.where("NOT hot"), lengths)
    for each in lengths:
        verdicts = verdicts.unionByName(_hot(pieces.where("hot"), each))
    verdicts = stored(verdicts.groupBy("anchor", "seg").agg(F.collect_set(F.struct("first", "last", "length")).alias("parts")), "stretch-verdicts")
    dropped(pieces)
    span = lambda p: F.struct((F.col("start") + p["first"]).alias("a"), (F.col("start") + p["last"] + p["length"]).alias("b"), p["length"].alias("length"))
    spans = found.join(verdicts, ["anchor", "seg"]).select("doc_id", "tkey", F.transform("parts", span).alias("s"))
    spans = stored(spans.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("s")).alias("spans")), "spans")
    dropped(found, verdicts)
    return spans


def _kept(size: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Which of `size` bytes stay without those from a to b, and the number of maximal removed runs."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return ~gone, int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))


def remove_repeats(documents: DataFrame, length: int = 400, with_text: bool = False, passage: int | None = None) -> DataFrame:
    """Removes every byte of a text that a string of `length` UTF-8 bytes covers which also starts anywhere else, in this or another row.

    Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes left) to every row's other columns but text; with_text also returns text, cut
    at characters: one that is removed in part stays whole. passage adds n_passage_bytes: bytes covered by such strings of `passage` bytes, which are counted and stay.
    Clashing columns of these names are replaced.
    Strings are judged on the input. Null or empty text: nothing removed (with_text keeps null). Repeated rows: each other's copies. Null doc_id: as any.
    Empty table: no rows. Long texts are whole: a batch holds about 4 MB, or one text.
    """
    spark = ship(documents.sparkSession)
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_passage_bytes"] * (passage is not None)
    own = documents.select(*[c for c in documents.columns if c not in (*added, "tkey", "spans")])
    keyed = own.withColumn("tkey", F.xxhash64("text"))
    lengths = tuple(dict.fromkeys([length, *([] if passage is None else [passage])]))
    spans = repeated_spans(keyed.select("doc_id", "tkey", "text"), lengths).select(F.col("doc_id").alias("d"), F.col("tkey").alias("k"), "spans")
    joined = keyed.join(spans, (F.col("tkey") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select(*own.columns, "spans")
    out = [f for f in own.schema.fields if with_text or f.name != "text"]

    def apply(batches):
        for batch in chunks(batches):
            data, offsets = utf8(batch.column("text"))
            spans, texts, rows = batch.column("spans"), [], []
            begins, ends, judged = (spans.flatten().field(c).to_numpy() for c in ("a", "b", "length"))
            upto = np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            for i in range(batch.num_rows):
                x = data[offsets[i] : offsets[i + 1]]
                part = slice(upto[i], upto[i + 1])
                kept = {n: _kept(len(x), begins[part][judged[part] == n], ends[part][judged[part] == n]) for n in lengths}
                keep, runs = kept[length]
                row = (len(x), len(x) - int(keep.sum()), runs, hashlib.sha256(x[keep].tobytes()).hexdigest())
                rows.append(row if passage is None else (*row, len(x) - int(kept[passage][0].sum())))
                if with_text:
                    lead = (x & 0xC0) != 0x80
                    char = np.cumsum(lead) - 1
                    whole = np.zeros(int(lead.sum()), bool)
                    whole[char[keep]] = True
                    texts.append(x[whole[char]].tobytes())
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "spans")}
            if with_text:
                columns["text"] = pa.array([t if v else None for t, v in zip(texts, batch.column("text").is_valid().to_pylist(), strict=True)], pa.binary()).cast(pa.string())
            columns |= dict(zip(added, map(pa.array, zip(*rows, strict=True)), strict=True)) if rows else {}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    names = [f.name for f in out] + added
    schema = StructType(out)
    for name in added:
        schema = schema.add(name, "string" if name == "kept_sha256" else "long")
    return joined.mapInArrow(apply, schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns at 400 bytes, and n_passage_bytes: a repeated passage of over 50 words is mostly shorter than 400 bytes, so its bytes are reported beside."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), passage=PASSAGE)
