"""Media columns: lossless FLAC streams of 8-bit mono samples, written and decoded in numpy, many frames at a time.

The format is the published one (RFC 9639): a STREAMINFO block with an MD5 sum, a SEEKTABLE, and frames of BLOCK samples whose subframes are constant, verbatim,
or predicted (fixed or linear) with Rice-coded residuals. The encoder writes one Rice partition a frame; the decoder reads any number of them, both coding methods, escaped
partitions and linear predictors of any order and precision. It reads streams of one channel, 8 bits and blocks of BLOCK samples, without wasted bits; others are refused by
an error. It verifies both checksums of every frame and the stream's MD5 sum, and gives blocks of samples by their offsets.
"""

from __future__ import annotations

import hashlib
import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import chunks, ship, stored, utf8

#: Samples in a frame, frames between seek points, sample rate and its code (fixed values of the format for 192 samples and 8 kHz).
BLOCK, SEEK_EVERY, RATE = 192, 8, 8000
HEAD = bytes([0xFF, 0xF8, 0x14, 0x02])
#: Predictors tried: (order, coefficients, shift); fixed ones first, then the mean of the last eight samples as a linear predictor of 5-bit precision.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
MEAN8, PRECISION, SHIFT = [2] * 8, 5, 4


#: How stored streams are compressed once more: texts come with copies, and equal texts are equal streams.
DENSE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out[i] = c & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of many byte ranges at once, byte by byte over all."""
    table, crc, top = (CRC8 if bits == 8 else CRC16), np.zeros(len(starts), np.uint32), bits - 8
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    own = crc[order]
    active = len(order)
    for t in range(int(lengths.max(initial=0))):
        while active and size[active - 1] <= t:
            active -= 1
        c = own[:active]
        own[:active] = ((c << np.uint32(8)) ^ table[(c >> np.uint32(top)) ^ data[begin[:active] + t]]) & np.uint32((1 << bits) - 1)
    crc[order] = own
    return crc


def _predicted(x: np.ndarray, coefs: list[int], shift: int) -> np.ndarray:
    order = len(coefs)
    guess = np.zeros((len(x), x.shape[1] - order), np.int32)
    for k, c in enumerate(coefs):
        guess += c * x[:, order - 1 - k : x.shape[1] - 1 - k]
    return x[:, order:] - (guess >> shift)


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the better of two Rice parameters near their mean, and the bits then needed."""
    z = ((residual << 1) ^ (residual >> 31)).astype(np.int32)
    n = z.shape[1]
    low = np.clip(np.log2(np.maximum(z.sum(1) / n * 0.7, 1)).astype(np.int32), 0, 13)
    costs = [(z >> (low + d)[:, None]).sum(1) + n * (1 + low + d) for d in (0, 1)]
    better = costs[1] < costs[0]
    return z, low + better, np.where(better, costs[1], costs[0])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = (value >> (width - 1 - b)) & 1


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8 like code: bytes (7 wide) and how many count."""
    size = 1 + sum((n >= x).astype(np.int64) for x in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31))
    out = np.zeros((len(n), 7), np.uint8)
    for k in range(1, 8):
        own = size == k
        for b in range(k):
            out[own, b] = (0x80 | (n[own] >> (6 * (k - 1 - b))) & 0x3F) if b else n[own] if k == 1 else ((0xFF00 >> k) & 0xFF) | (n[own] >> (6 * (k - 1)))
    return out, size


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of samples (one row each, signed) laid end to end, and their offsets."""
    x = samples.astype(np.int32)
    frames = len(x)
    plans = [(len(c), c, 0, o) for o, c in FIXED.items() if o < 2] + [(8, MEAN8, SHIFT, 32 + 7)]
    best = np.full(frames, 8 + 8 * BLOCK, np.int64)  # verbatim
    kind = np.ones(frames, np.int64)
    coded = {}
    for p, (order, coefs, shift, _) in enumerate(plans):
        z, k, cost = _rice(_predicted(x, coefs, shift))
        cost = cost + 8 + 8 * order + 10 + (9 + PRECISION * order if shift else 0)
        coded[p] = (z, k)
        kind, best = np.where(cost < best, 8 + p, kind), np.minimum(best, cost)
    same = (x == x[:, :1]).all(1)
    kind, best = np.where(same, 0, kind), np.where(same, 16, best)
    number, number_size = _number(numbers)
    lead = 4 + number_size + 1
    sizes = lead + (best + 7) // 8 + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if frames else 0
    bits = np.zeros(total * 8, np.uint8)
    body = (starts + lead) * 8
    kinds = np.where(kind == 0, 0, np.where(kind == 1, 1, 0))
    for p, (order, _, shift, _) in enumerate(plans):
        kinds = np.where(kind == 8 + p, 32 + order - 1 if shift else 8 + order, kinds)
    _put(bits, body, kinds << 1, 8)
    raw = x & 0xFF
    own = np.flatnonzero(kind == 0)
    _put(bits, body[own] + 8, raw[own, 0], 8)
    own = np.flatnonzero(kind == 1)
    _put(bits, (body[own] + 8)[:, None] + 8 * np.arange(BLOCK), raw[own], 8)
    for p, (order, coefs, shift, _) in enumerate(plans):
        own = np.flatnonzero(kind == 8 + p)
        if not len(own):
            continue
        at = body[own] + 8
        if order:
            _put(bits, at[:, None] + 8 * np.arange(order), raw[own, :order], 8)
            at = at + 8 * order
        if shift:
            _put(bits, at, np.full(len(own), (PRECISION - 1) << 5 | shift), 9)
            _put(bits, (at + 9)[:, None] + PRECISION * np.arange(order), np.tile(np.array(coefs) & 31, (len(own), 1)), PRECISION)
            at = at + 9 + PRECISION * order
        z, k = coded[p][0][own], coded[p][1][own].astype(np.int64)
        _put(bits, at, k, 10)  # coding method 0, partition order 0, parameter
        quotient = z >> k[:, None]
        width = quotient + 1 + k[:, None]
        stop = (at + 10)[:, None] + np.cumsum(width, axis=1) - width + quotient
        bits[stop] = 1
        for kk in np.unique(k):
            rows = k == kk
            _put(bits, stop[rows] + 1, z[rows], int(kk))
    data = np.packbits(bits)
    for i, b in enumerate(HEAD):
        data[starts + i] = b
    for b in range(7):
        own = number_size > b
        data[starts[own] + 4 + b] = number[own, b]
    data[starts + lead - 1] = crcs(data, starts, lead - 1, 8)
    check = crcs(data, starts, sizes - 2, 16)
    data[ends - 2], data[ends - 1] = check >> 8, check & 0xFF
    return data, np.append(starts, total)


def encode_media(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream for each payload, whose length is a positive multiple of BLOCK; bytes 0 to 255 are samples -128 to 127."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    upto = np.concatenate([[0], np.cumsum(counts)])
    frames, offsets = encode_frames(samples.reshape(-1, BLOCK), np.arange(upto[-1]) - np.repeat(upto[:-1], counts))
    raw, sizes, out = frames.tobytes(), np.diff(offsets), []
    for i, n in enumerate(counts):
        own = slice(upto[i], upto[i + 1])
        begin = offsets[upto[i]]
        info = b"".join([BLOCK.to_bytes(2, "big") * 2, int(sizes[own].min()).to_bytes(3, "big"), int(sizes[own].max()).to_bytes(3, "big"), (RATE << 44 | 7 << 36 | int(n) * BLOCK).to_bytes(8, "big"), hashlib.md5(samples[upto[i] * BLOCK : upto[i + 1] * BLOCK].tobytes()).digest()])
        points = np.zeros(-(-n // SEEK_EVERY), [("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
        points["sample"] = np.arange(0, n, SEEK_EVERY) * BLOCK
        points["at"] = offsets[upto[i] : upto[i + 1] : SEEK_EVERY] - begin
        points["n"] = BLOCK
        seek = points.tobytes()
        out.append(b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(seek).to_bytes(3, "big"), seek, raw[begin : offsets[upto[i + 1]]]]))
    return out


class _Bits:
    """Reads numbers at many bit places at once."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        d = self.data.astype(np.uint64)
        self.word = d[:-3] << np.uint64(24) | d[1:-2] << np.uint64(16) | d[2:-1] << np.uint64(8) | d[3:]

    def window(self, at: np.ndarray) -> np.ndarray:
        """32 bits, of which the first 25 at least are those from `at` on."""
        return (self.word[at >> 3] << (at & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFF)

    def read(self, at: np.ndarray, width) -> np.ndarray:
        return (self.window(at) >> np.asarray(32 - width, np.uint64)).astype(np.int64)


def _signed(value: np.ndarray, width: int) -> np.ndarray:
    return value - ((value >> (width - 1)) << width)


def _residuals(bits: _Bits, p: np.ndarray, rows: np.ndarray, depth: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of predicted subframes, of which the first `depth` are known, and the bit after each: residuals are read sample by sample, over all subframes at once."""
    method = bits.read(p, 2)
    if (method > 1).any():
        raise ValueError("residuals of a reserved coding method")
    wide, span = 4 + method, BLOCK >> bits.read(p + 2, 4)
    if (BLOCK % span).any() or (span < depth).any():
        raise ValueError("residuals in partitions that do not fit the block")
    p = p + 6
    k, raw = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)  # a Rice parameter; bits of an unencoded residual, and 1

    def head(own: np.ndarray) -> None:
        k[own] = bits.read(p[own], wide[own])
        p[own] += wide[own]
        raw[own] = 0
        plain = own[k[own] == (1 << wide[own]) - 1]
        raw[plain] = bits.read(p[plain], 5) + 1
        p[plain] += 5
        if (raw[plain] > 25).any():
            raise ValueError("unencoded residuals of over 24 bits")

    head(np.arange(len(p)))
    several, w = bool((span < BLOCK).any()), coefs.shape[1]
    coefs = coefs[:, ::-1]
    pad = np.concatenate([np.zeros((len(p), w), np.int64), rows], axis=1)
    for t in range(int(depth.min()), BLOCK):
        if several and t:
            own = np.flatnonzero((t % span == 0) & (depth <= t))
            if len(own):
                head(own)
        quotient = np.zeros(len(p), np.int64)
        view = bits.window(p)
        zeros = 32 - np.frexp(view.astype(np.float64))[1]
        here, coded = depth <= t, raw == 0
        far = np.flatnonzero((zeros >= 25) & here & coded)
        while len(far):  # a long run of zeros goes on in the next window
            quotient[far] += 24
            p[far] += 24
            zeros[far] = 32 - np.frexp(bits.window(p[far]).astype(np.float64))[1]
            if (quotient[far] > 1 << 16).any():
                raise ValueError("a residual has no end")
            far = far[zeros[far] >= 25]
        rice = np.where(coded, k, 0)
        z = (quotient + zeros) << rice | bits.read(p + np.minimum(zeros, 24) + 1, rice)
        value = (z >> 1) ^ -(z & 1)
        size = zeros + 1 + rice
        if not coded.all():
            width = np.maximum(raw - 1, 0)
            own = np.flatnonzero(width > 0)
            number = np.zeros(len(p), np.int64)
            number[own] = bits.read(p[own], width[own])
            number[own] -= (number[own] >> (width[own] - 1)) << width[own]
            value, size = np.where(coded, value, number), np.where(coded, size, width)
        value = value + ((pad[:, t : t + w] * coefs).sum(1) >> shift)
        if here.all():
            pad[:, w + t] = value
            p = p + size
        else:
            pad[here, w + t] = value[here]
            p = np.where(here, p + size, p)
    return pad[:, w:], p


def decode_frames(bits: _Bits, at: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decodes the frames that begin at bytes `at`: samples (one row each) and the bytes after them."""
    data = bits.data
    if not all((data[at + i] == b).all() for i, b in enumerate(HEAD)):
        raise ValueError("no frame of one channel, 8 bits and 192 samples begins here")
    number, number_size = _number(numbers)
    for b in range(7):
        own = number_size > b
        if (data[at[own] + 4 + b] != number[own, b]).any():
            raise ValueError("a frame has another number than its place")
    lead = 4 + number_size + 1
    if (crcs(data, at, lead - 1, 8) != data[at + lead - 1]).any():
        raise ValueError("a frame header's checksum is wrong")
    pos = (at + lead) * 8
    lead_byte = bits.read(pos, 8)
    if (lead_byte & 0x81).any():
        raise ValueError("a subframe has wasted bits, or does not begin where it should")
    kind = lead_byte >> 1
    pos = pos + 8
    n = len(at)
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    if not (fixed | linear | (kind <= 1)).all():
        raise ValueError("a subframe is of a reserved type")
    x = np.zeros((n, BLOCK), np.int64)
    own = np.flatnonzero(kind == 0)
    x[own] = _signed(bits.read(pos[own], 8), 8)[:, None]
    pos[own] += 8
    own = np.flatnonzero(kind == 1)
    x[own] = _signed(bits.read(pos[own][:, None] + 8 * np.arange(BLOCK), 8), 8)
    pos[own] += 8 * BLOCK
    deepest = int(order.max(initial=0))
    coefs, shift = np.zeros((n, max(deepest, 1)), np.int64), np.zeros(n, np.int64)
    for t in range(deepest):  # warm-up samples
        own = np.flatnonzero(order > t)
        x[own, t] = _signed(bits.read(pos[own], 8), 8)
        pos[own] += 8
    for o, c in FIXED.items():
        coefs[np.flatnonzero(fixed & (order == o))[:, None], np.arange(o)] = c
    own = np.flatnonzero(linear)
    if len(own):
        precision = bits.read(pos[own], 4) + 1
        shift[own] = bits.read(pos[own] + 4, 5)
        pos[own] += 9
        for t in range(deepest):
            use = order[own] > t
            value = bits.read(pos[own], precision)
            coefs[own[use], t] = (value - ((value >> (precision - 1)) << precision))[use]
            pos[own] += np.where(use, precision, 0)
    coded = np.flatnonzero(fixed | linear)
    if len(coded):
        x[coded], pos[coded] = _residuals(bits, pos[coded], x[coded], order[coded], coefs[coded], shift[coded])
    end = (pos + 7) // 8
    check = crcs(data, at, end - at, 16)
    if (check != (data[end].astype(np.uint32) << 8 | data[end + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    return x, end + 2


def decode_media(column: pa.Array) -> list[np.ndarray]:
    """Samples (signed, 8 bits) of FLAC streams, all frames between two seek points in step with those of the other streams. Checks every checksum and MD5 sum."""
    data, offsets = utf8(column)
    totals, sums, starts, numbers, lasts, owner = [], [], [], [], [], []
    for i in range(len(offsets) - 1):
        at = int(offsets[i])
        head = data[at : at + 42].tobytes()
        if head[:4] != b"fLaC" or head[4] & 0x7F:
            raise ValueError("not a FLAC stream")
        totals.append(int.from_bytes(head[18:26], "big") & ((1 << 36) - 1))
        sums.append(head[26:42])
        at, last, points = at + 42, head[4] >> 7, None
        while not last:
            last, kind, size = int(data[at]) >> 7, int(data[at]) & 0x7F, int.from_bytes(data[at + 1 : at + 4].tobytes(), "big")
            if kind == 3:
                points = np.frombuffer(data[at + 4 : at + 4 + size].tobytes(), [("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
            at += 4 + size
        frames = totals[-1] // BLOCK
        first = (points["sample"] // BLOCK).astype(np.int64) if points is not None else np.zeros(1, np.int64)
        starts.append(at + points["at"].astype(np.int64) if points is not None else np.array([at]))
        numbers.append(first)
        lasts.append(np.append(first[1:], frames))
        owner.append(np.full(len(first), i))
    base = np.concatenate([[0], np.cumsum(np.array(totals, np.int64) // BLOCK)])
    out = np.zeros((int(base[-1]), BLOCK), np.int8)
    if len(out):
        at, number, last, owner = map(np.concatenate, (starts, numbers, lasts, owner))
        bits = _Bits(data)
        while len(at):
            samples, after = decode_frames(bits, at, number)
            out[base[owner] + number] = samples
            number = number + 1
            on = number < last
            at, number, last, owner = after[on], number[on], last[on], owner[on]
    done = [out[base[i] : base[i + 1]].reshape(-1) for i in range(len(totals))]
    for x, md5 in zip(done, sums, strict=True):
        if hashlib.md5(x.tobytes()).digest() != md5:
            raise ValueError("a stream's samples have another MD5 sum")
    return done


def store_media(documents: DataFrame) -> DataFrame:
    """Adds n_bytes, payload_bytes and media (a FLAC stream) to rows (doc_id, text): the text's UTF-8 bytes, padded with blanks to a positive multiple of BLOCK, as samples.

    Null text: empty, one block of blanks. Repeated rows: equal streams. Empty table: no rows. Other columns are not read. Texts are whole; about 2 MB are coded at a time, or one text.
    """
    ship(documents.sparkSession)

    def encode(batches):
        for batch in chunks(batches, 2 << 20):
            data, offsets = utf8(batch.column("text"))
            raw, sizes = data.tobytes(), np.diff(offsets)
            payloads = [x.ljust(max(1, -(-len(x) // BLOCK)) * BLOCK) for x in (raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))]
            media = encode_media(payloads)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array([len(p) for p in payloads], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_bytes long, payload_bytes long, media binary")


def pcm_blocks(media: DataFrame, samples: int = 16 * BLOCK, carry: list[str] | None = None) -> DataFrame:
    """Decodes rows (doc_id, media, ...) to PCM blocks: doc_id, sample_offset, n_samples (of the whole stream), pcm (signed 8-bit samples, `samples` at most), and the columns of `carry`.

    A stream's blocks follow each other by offset, so that a block can be sought by it. A null stream gives no rows. Carried columns must not have the names above.
    """
    ship(media.sparkSession)
    own = media.where("media IS NOT NULL").select("doc_id", *(carry or []), "media")
    fields = [own.schema["doc_id"], *[own.schema[c] for c in carry or []]]
    schema = StructType(list(fields)).add("sample_offset", "long").add("n_samples", "long").add("pcm", "binary")

    def decode(batches):
        for batch in chunks(batches, 2 << 20, "media"):
            rows, at, sizes, blocks = [], [], [], []
            for i, x in enumerate(decode_media(batch.column("media"))):
                for start in range(0, len(x), samples):
                    rows.append(i), at.append(start), sizes.append(len(x)), blocks.append(x[start : start + samples].tobytes())
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[taken.column(f.name) for f in fields], pa.array(at, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary())], names=schema.names)

    return own.mapInArrow(decode, schema)


def feature(x: np.ndarray) -> str:
    """Mean, root mean square, crossings of the mean and the span of signed samples, all whole numbers."""
    wide = x.astype(np.int64)
    mean = int(wide.sum()) // len(x)
    above = wide > mean
    return f"mean={mean};rms={isqrt(int((wide * wide).sum()) // len(x))};crossings={int((above[1:] != above[:-1]).sum())};span={int(wide.max() - wide.min())}"


def describe_blocks(blocks: DataFrame) -> DataFrame:
    """Puts streams together again from pcm_blocks() rows as they come (carrying n_bytes, payload_bytes, media_bytes, media_sha256) and describes each payload.

    Blocks that are missing, out of place, or other than payload_bytes in all are an error. One stream is held at a time.
    """
    ship(blocks.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [c.split()[0] for c in schema.split(", ")]

    def describe(batches):
        held, size = [], 0
        for batch in batches:
            offsets, wholes, rows = batch.column("sample_offset").to_pylist(), batch.column("n_samples").to_pylist(), []
            for i, pcm in enumerate(batch.column("pcm")):
                if offsets[i] != size:
                    raise ValueError("a block of samples is out of place")
                held.append(np.frombuffer(pcm.as_buffer(), np.int8))
                size += len(held[-1])
                if size == wholes[i]:
                    x = np.concatenate(held)
                    payload = (x.view(np.uint8) ^ 0x80).tobytes()
                    own = {c: batch.column(c)[i].as_py() for c in ("doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256")}
                    if own["payload_bytes"] != size:
                        raise ValueError("a stream has another length than its row says")
                    rows.append(own | {"payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "feature": feature(x)})
                    held, size = [], 0
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], pa.string() if c in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for c in names})
        if held:
            raise ValueError("the last stream's blocks are not all there")

    return blocks.mapInArrow(describe, schema)


def read_media(media: DataFrame) -> DataFrame:
    """Decodes rows (doc_id, n_bytes, payload_bytes, media) through PCM blocks and describes payload and stream."""
    told = media.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return describe_blocks(pcm_blocks(told, carry=["n_bytes", "payload_bytes", "media_bytes", "media_sha256"]))


def op6_flac_media(spark, sf_dir: str) -> DataFrame:
    media = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_media(stored(media, "flac-media", DENSE))
