"""Token ids of whole texts, as the tokenizers library gives them, by a worker's cache of blank-separated chunks."""

from __future__ import annotations

import json
from itertools import chain, repeat

import numpy as np

from .common import LOWER

#: The byte-level alphabet's letters for the two UTF-8 bytes of U+00AA to U+00FF: a printable Latin-1 byte is itself, any other is U+0100 and up, in order.
_ODD = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_LETTERS = {c: "".join(chr(b) if b not in _ODD else chr(256 + _ODD.index(b)) for b in chr(c).encode("utf-8")) for c in range(0xAA, 0x100)}
#: 1: ASCII blank, 2: full stop or comma, 3: ASCII letter, 0: any other byte.
KIND = np.zeros(256, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]], KIND[[44, 46]], KIND[65:91], KIND[97:123] = 1, 2, 3, 3
NAME = "word_bpe_49k.json"
#: What makes a tokenizer one of this kind: these normalizers, and a pattern none of whose matches holds white space (what it does not match is dropped). Fixed values.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkCoder:
    """Encodes chunks (bytes between ASCII blanks) once each.

    The tokenizer drops white space, folds case and composes characters letter by letter, so no token spans a blank and a text's ids are those of its chunks laid end to end.
    That holds for tokenizers of this kind only: any other normalizer, pattern or added token with a blank raises, and the first batch is compared both ways besides. The cache
    starts anew at `limit` chunks, so memory is bounded.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.checked = Tokenizer.from_file(path), limit, False
        parts = json.loads(self.tokenizer.to_str())
        normal, split = parts["normalizer"] or {}, parts["pre_tokenizer"] or {}
        split = split.get("pretokenizers", [split])
        first = split[0]
        known = [n["type"] for n in normal.get("normalizers", [])] == NORMALIZERS and first.get("pattern") == {"Regex": PATTERN} and (first["behavior"], first["invert"]) == ("Removed", True)
        plain = [x["type"] for x in split[1:]] == ["ByteLevel"] and not split[1]["add_prefix_space"] and not any(t["lstrip"] or t["rstrip"] or set(t["content"]) & set(" \t\n\v\f\r") for t in parts["added_tokens"])
        if not (known and plain):
            raise ValueError("this tokenizer is of another kind: its tokens might span blanks")
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _encode(self, new: list[bytes]) -> list[list[int]]:
        """Ids of chunks. A word of Latin-1 letters in lower case is one pre-token, so the model takes it without the pattern's pass."""
        out: list = [None] * len(new)
        rest, tokenize = [], self.tokenizer.model.tokenize
        for k, x in enumerate(new):
            word = x.decode("utf-8")
            if len(x) < 64 and word.isalpha():
                if word.isascii() and word.islower():
                    out[k] = [t.id for t in tokenize(word)]
                    continue
                word = word.lower()
                if max(word) <= "\xff":
                    out[k] = [t.id for t in tokenize(word.translate(BYTE_LETTERS))]
                    continue
            rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([new[k].decode("utf-8") for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            encoded = self._encode(part)
            counts = np.fromiter(map(len, encoded), np.int32, len(encoded))
            ids = np.fromiter(chain.from_iterable(encoded), np.uint32, int(counts.sum()))
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), self.flat.dtype)])
            if len(ids) and int(ids.max()) > np.iinfo(self.flat.dtype).max:
                self.flat = self.flat.astype(np.uint32)
            base = len(self.known)
            if base + len(part) > len(self.first):
                self.first, self.count = (np.concatenate([x, np.zeros(max(len(x), len(part)), x.dtype)]) for x in (self.first, self.count))
            self.flat[self.used : self.used + len(ids)] = ids
            self.first[base : base + len(part)] = self.used + np.cumsum(counts) - counts
            self.count[base : base + len(part)] = counts
            self.used += len(ids)
            self.known.update(zip(part, range(base, base + len(part)), strict=True))

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        """Numbers of chunks in the cache."""
        found = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = list({chunks[i] for i in missing.tolist()})
            if len(self.known) + len(new) > self.limit:
                self.clear()
                new, missing = list(set(chunks)), np.arange(len(chunks))
            self._learn(new)
            found[missing] = [self.known[chunks[i]] for i in missing.tolist()]
        return found

    def _laid(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts with blanks between them, where chunks begin in that, and how many each text has.

        A full stop or comma after a letter and before a blank is a chunk of its own, A-Z are in lower case: neither changes ids.
        """
        n, texts = len(data), len(offsets) - 1
        if b"<|" not in data.tobytes():  # special tokens are matched before case is folded
            data = LOWER[data]
        kind = KIND[data]
        at = np.flatnonzero(kind == 2)
        at = at[(at > 0) & (at < n - 1)]
        at = at[(kind[at - 1] == 3) & (kind[at + 1] == 1)]
        bounds = offsets + np.arange(texts + 1) + np.searchsorted(at, offsets)
        own = np.ones(n + len(at) + texts, bool)
        own[at + np.arange(len(at)) + np.searchsorted(offsets, at, "right") - 1] = False  # before each such stop
        own[bounds[1:] - 1] = False  # after each text
        laid = np.full(len(own), 32, np.uint8)
        laid[own] = data
        blank = KIND[laid] == 1
        starts = ~blank
        starts[1:] &= blank[:-1]
        begins = np.flatnonzero(starts)
        return laid, begins, np.diff(np.searchsorted(begins, bounds))

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Chunks of texts laid end to end, and how many each text has."""
        laid, _, sizes = self._laid(data, offsets)
        return laid.tobytes().split(), sizes

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes that hold the chunks of texts laid end to end (16 more at the end), where each chunk begins and ends in them, and how many each text has."""
        laid, begins, sizes = self._laid(data, offsets)
        blank = np.append(KIND[laid] == 1, True)
        return np.concatenate([laid, np.zeros(16, np.uint8)]), begins, np.flatnonzero(~blank[:-1] & blank[1:]) + 1, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and the offsets of their ids."""
        words, sizes = self.chunks(data, offsets)
        numbers = self.numbers(words)
        counts = self.count[numbers].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        where = np.repeat(self.first[numbers] - ends[:-1], counts) + np.arange(ends[-1])
        ids = self.flat[where].astype(np.uint32)
        out = ends[np.concatenate([[0], np.cumsum(sizes)])]
        if not self.checked and len(sizes):
            self.checked = True
            for i in range(min(len(sizes), 8)):
                plain = self.tokenizer.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids
                if plain != ids[out[i] : out[i + 1]].tolist():
                    raise ValueError("this tokenizer's ids of a text are not those of its blank-separated chunks")
        return ids, out


_coders: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    """This worker's coder; it lives as long as the worker does."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
    return _coders[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Puts the id `end` after each text's ids."""
    out = offsets + np.arange(len(offsets))
    full = np.empty(int(out[-1]), ids.dtype)
    keep = np.ones(len(full), bool)
    keep[out[1:] - 1] = False
    full[keep], full[out[1:] - 1] = ids, end
    return full, out
