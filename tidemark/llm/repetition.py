"""Quality rules by repetition coverage: duplicated n-grams and lines, measured in characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BLANK, binary, chunks, mixed, ship, utf8, window_hashes, words_of

#: Largest shares of a text's word characters inside n-grams said before, by n, and of its lines and line characters (published rules for web text).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20
#: One line said twice in a text of few lines is no fault: the limit on lines counts from so many.
LINES_LEAST = 2
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _sums(per_byte: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def repeats(keys: np.ndarray, same) -> tuple[np.ndarray, np.ndarray]:
    """For hashes: which are found twice or more, and which have an equal one before. same(i, j) says whether positions hold equal items: hashes that clash are told apart by it."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    told = same(order[1:], order[:-1])
    if np.any(equal & ~told):  # two items share a hash: number each item of such hashes anew
        clash = np.unique(keys[order[1:]][equal & ~told])
        keys = keys.copy()
        for k in clash:
            at, kinds = np.flatnonzero(keys == k), []
            for i in at:
                j = next((j for j in kinds if same(np.array([i]), np.array([j]))[0]), None)
                kinds += [i] if j is None else []
                keys[i] = k + np.uint64(1 + (i if j is None else j))
        return repeats(keys, same)
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = equal
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    return twice, before


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in windows of `width` that begin at `at`."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of texts laid end to end, by name."""
    texts = len(offsets) - 1
    points = (data & 0xC0) != 0x80
    solid = ~BLANK[data]
    words, bounds, at = words_of(data, offsets)
    n = len(words)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(texts), np.diff(bounds))
    chars = np.add.reduceat(points & solid, at, dtype=np.int64) if n else np.zeros(0, np.int64)
    out = {"n_words": np.diff(bounds), "word_chars": _sums(points & solid, offsets), "n_symbols": _sums(SYMBOLS[data], offsets)}

    salted, own = mixed(ids), mixed(doc, 1)
    total = np.maximum(out["word_chars"], 1)
    inside = np.arange(n)
    for width in (3, *NGRAM_LIMITS):
        inside = inside[inside + width <= n]
        inside = inside[doc[inside] == doc[inside + width - 1]]
        hashes = window_hashes(salted, width)
        keys = hashes[inside] ^ own[inside]

        def same(i, j, width=width, inside=inside):
            i, j = inside[i], inside[j]
            equal = doc[i] == doc[j]
            for k in range(width):
                equal &= ids[i + k] == ids[j + k]
            return equal

        twice, before = repeats(keys, same)
        if width == 3:
            out["n_repeat_words"] = np.bincount(doc[covered(inside[twice], 3, n)], minlength=texts)
        else:
            said = covered(inside[before], width, n)
            out[f"dup_{width}gram_share"] = np.bincount(doc[said], weights=chars[said], minlength=texts) / total
        inside = inside[twice]  # a longer window is found twice only where a shorter one is

    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([ends + 1, offsets[:-1]])
    of = np.concatenate([np.searchsorted(offsets, ends, "right") - 1, np.arange(texts)])
    order = np.argsort(starts, kind="stable")
    starts, of = starts[order], of[order]
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    filled = np.concatenate([[0], np.cumsum(solid)])
    upto = np.append(starts, len(data))
    lines = binary(data[data != 10], upto - breaks[upto])
    # The break before a line's end is not part of it; an empty last line and the next text's first begin at one place.
    has = filled[upto[1:]] > filled[upto[:-1]]
    length = np.diff(np.concatenate([[0], np.cumsum(points & (data != 10))])[upto])
    line_ids = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(lines) else np.zeros(0, np.int64)
    key = np.flatnonzero(has)
    _, before = repeats(mixed(line_ids[key]) ^ mixed(of[key], 1), lambda i, j: (line_ids[key[i]] == line_ids[key[j]]) & (of[key[i]] == of[key[j]]))
    dup = key[before]
    out["n_dup_lines"] = np.bincount(of[dup], minlength=texts)
    out["dup_line_share"] = out["n_dup_lines"] / np.maximum(np.bincount(of[key], minlength=texts), 1)
    out["dup_line_chars_share"] = np.bincount(of[dup], weights=length[dup], minlength=texts) / np.maximum(np.bincount(of[key], weights=length[key], minlength=texts), 1)
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [f"dup_{n}gram_share" for n in NGRAM_LIMITS] + ["dup_line_share", "dup_line_chars_share"]


def quality(documents: DataFrame) -> DataFrame:
    """Adds repetition measures and a verdict to every row of `documents` (a column text is needed).

    New columns: COUNTS (long), SHARES (double), base_failed and kept. They replace columns of the same names.
    A text fails the base if it has under 50 words or over half of its words lie in 3-word windows found twice; it is kept if it does not fail
    and no share is above its limit (that on lines counts from LINES_LEAST duplicates on). Null or empty text: counts 0, shares 0, base_failed. Each row is judged by its own text, so repeated rows, ties and null numbers
    change nothing; an empty table stays empty. Long texts are whole: a batch holds about 4 MB of text, or one text.
    """
    ship(documents.sparkSession)
    kept_columns = [c for c in documents.columns if c not in {*COUNTS, *SHARES, "base_failed", "kept"}]
    source = documents.select(*kept_columns)

    def judge(batches):
        for batch in chunks(batches):
            found = measure(*utf8(batch.column("text")))
            failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
            good = ~failed & ((found["dup_line_share"] <= LINE_LIMIT) | (found["n_dup_lines"] < LINES_LEAST)) & (found["dup_line_chars_share"] <= LINE_CHARS_LIMIT)
            for n, most in NGRAM_LIMITS.items():
                good &= found[f"dup_{n}gram_share"] <= most
            new = [pa.array(found[c].astype(np.int64)) for c in COUNTS] + [pa.array(found[c].astype(np.float64)) for c in SHARES] + [pa.array(failed), pa.array(good)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *COUNTS, *SHARES, "base_failed", "kept"])

    schema = StructType(list(source.schema.fields))
    for c in COUNTS:
        schema = schema.add(c, "long")
    for c in SHARES:
        schema = schema.add(c, "double")
    return source.mapInArrow(judge, schema.add("base_failed", "boolean").add("kept", "boolean"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", *[F.round(c, 6).alias(c) for c in SHARES])
