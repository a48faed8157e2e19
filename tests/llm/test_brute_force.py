"""Operators against brute force on a small fixture with nulls, empty, long and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, flac, induced, jaccard, mixing, packing, repetition, suffix_dedup, token_counts, token_files, tokens, url_rules
from tidemark.llm.common import utf8
from tidemark.llm.tokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, copies long"


def fixture():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))
    passage, base, texts = say(120), say(150), [None, "", " \n ", "one", "Two words", "don't <|endoftext|> x"]
    texts += [say(rng.randrange(5, 300)) for _ in range(20)] + [base] * 4
    for _ in range(8):
        near = base.split(" ")
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [say(40) + passage + say(30) for _ in range(3)] + ["ab " * 400, "line of text\n" * 30, say(8000)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 0, 0) for i, t in enumerate(texts)]
    return rows + [rows[30], (None, base, "en", "s1", 5, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_mix(rows, weights, weigh=None, share=1.5, cap=2.0, seed=17):
    """Copies of rows (doc_id, text, source), in their order; weigh(row, size) gives their weights."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    weight = [weigh(r, n) if weigh else n.bit_length() or 1 for r, n in zip(rows, sizes)]
    total = collections.Counter()
    for (_, _, s), n in zip(rows, sizes):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s))
    part = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, full = {}, share * sum(total.values()), set()
    while True:  # those above their cap get it, the rest goes to the others by weight
        level = left / max(1, sum(part[s] for s in names if s not in full))
        over = [s for s in names if s not in full and part[s] * level > cap * total[s]]
        if not over:
            target = {s: cap * total[s] if s in full else part[s] * level for s in names}
            break
        full.update(over)
        left = share * sum(total.values()) - cap * sum(total[s] for s in full)
    out = [0] * len(rows)
    for s in names:
        own = [i for i, r in enumerate(rows) if r[2] == s]
        capped = set()
        while total[s]:
            goal = target[s] - cap * sum(sizes[i] for i in capped)
            level = goal / max(1e-9, sum(weight[i] * sizes[i] for i in own if i not in capped))
            more = {i for i in own if i not in capped and weight[i] * level > cap * (1 + 1e-12)}
            if not more:
                break
            capped |= more
        expected = {i: (cap if i in capped else level * weight[i]) if total[s] else 0.0 for i in own}
        ranked, certain = [], 0
        for i in own:
            out[i] = int(expected[i])
            certain += out[i] * sizes[i]
            p = expected[i] - out[i]
            number, text, _ = rows[i]
            inner = hashlib.md5((text or "").encode()).hexdigest()
            u = (int(hashlib.md5(f"{seed}:{'null' if number is None else number}:{inner}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            if p > 0 and sizes[i]:
                ranked.append((u * (1 - p) / (u * (1 - p) + (1 - u) * p), (number is not None, number), sizes[i], i))
        upto = 0
        for _, _, n, i in sorted(ranked):
            upto += n
            out[i] += upto - n / 2 <= target[s] - certain
    return out, target


@pytest.mark.parametrize("column", [None, "n_chars"])
def test_mix(spark, docs, column):
    rows = mixing.mix(docs, [3, 1, 2], weight_col=column).collect()
    assert len(rows) == len(fixture()) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, [3, 1, 2], weight_col=column).collect()))
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert all(r.taken <= 2 * r.size and r.size == len(WORD.findall(next(t for i, t, *_ in fixture() if i == r.doc_id) or "")) for r in rows)
    given = {(i, t): n for i, t, _, _, n, *_ in fixture()}
    plain = [(i, t, s) for i, t, _, s, *_ in fixture()]
    copies, target = brute_mix(plain, [3, 1, 2], (lambda r, n: given[r[:2]]) if column else None)
    assert collections.Counter((r.doc_id, r.copies) for r in rows) == collections.Counter((r[0], c) for r, c in zip(plain, copies))
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in rows)
    assert len({round(r.expected, 9) for r in rows if r.source == "s1" and r.size}) > 2  # inclusion is unequal within a source
    assert mixing.mix(empty(spark), [3, 1, 2]).count() == 0


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", r"<\|turn|> <|end|> <<SYS>> \\[INST]", None, "", "plain"]
    rows = [(1, i, role, t) for i, (role, t) in enumerate(zip(["user", "assistant"] * 3, texts))] + [(None, None, None, "x"), (2, 0, "assistant<|body|>\n", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formed = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_parts(df.text).alias("parts")))
    back = {r.conv_id: [(t.role, t.text, t.loss_text) for t in r.turns] for r in chat.read_chats(formed).collect()}
    assert back[1] == [(role, t or "", (t or "") if role == "assistant" else None) for _, _, role, t in rows[:5]]
    assert back[None] == [("", "x", None)] and back[2] == [("assistant<|body|>\n", "y", None)]
    parts = spark.sql("SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, array(named_struct('type', 'image', 'text', null, 'ref', 'a.png', 'units', 2L), named_struct('type', 'text', 'text', 'hi', 'ref', null, 'units', null)) AS parts")
    twice = chat.read_chats(chat.format_chats(spark.createDataFrame([(1, 0, "user", t) for t in ("b", "a", "a")], "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))).head()
    assert [t.text for t in twice.turns] == ["a", "a", "b"]
    kinds = spark.sql("SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, array(named_struct('type', 'audio', 'text', null, 'ref', 'b|>.wav', 'units', 3L), named_struct('type', 'document', 'text', null, 'ref', null, 'units', 0L), named_struct('type', 'odd', 'text', 'seen', 'ref', null, 'units', null)) AS parts")
    row = chat.format_chats(kinds).head()
    assert row.expanded_tokens == 3 * 25 + 512 and [(x.kind, x.ref, x.tokens) for x in row.attachments] == [("audio", "b|>.wav", 75), ("document", None, 512)]
    assert row.formatted == "<|turn|>user<|body|><|audio b|>.wav 75|><|document  512|>seen<|end|>"
    assert chat.read_chats(chat.format_chats(parts.limit(0))).count() == 0
    row = chat.format_chats(parts).head()
    assert row.expanded_tokens == 512 and row.attachments[0].ref == "a.png" and row.formatted == "<|turn|>user<|body|><|image a.png 512|>hi<|end|>"


def brute_quality(text):
    """Counts, shares and verdict of one text."""
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    chars = sum(map(len, w))
    shares = []
    for n in range(5, 11):
        said, again = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in said:
                again.update(range(i, i + n))
            said.add(g)
        shares.append(sum(len(w[i]) for i in again) / max(1, chars))
    lines, before, dup = [x for x in t.split("\n") if WORD.search(x)], set(), []
    for x in lines:
        if x in before:
            dup.append(x)
        before.add(x)
    shares += [len(dup) / max(1, len(lines)), sum(map(len, dup)) / max(1, sum(map(len, lines)))]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    good = not failed and all(x <= most for x, most in zip(shares, [0.15, 0.14, 0.13, 0.12, 0.11, 0.10])) and (shares[6] <= 0.3 or len(dup) < 2) and shares[7] <= 0.2
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", t)), len(dup), len(inside)), shares, failed, good


def repeating():
    """Texts that say lines and phrases again, each a little more than the one before."""
    rng = random.Random(11)
    line = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(12))
    out = []
    for k in range(0, 14):
        fresh, again = [line() for _ in range(20)], line()
        out += ["\n".join(fresh + [again] * k), " ".join(fresh + [f"{again} {i}" for i in range(k)])]
    return out


def test_quality(spark, docs):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(repeating())], "doc_id long, text string")
    rows = repetition.quality(docs.select("doc_id", "text").union(more)).collect()
    verdicts = collections.Counter()
    for r in rows:
        counts, shares, failed, good = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (*counts, failed, good)
        assert [r[c] for c in repetition.SHARES] == pytest.approx(shares)
        verdicts[failed, good] += 1
    assert verdicts[False, False] > 5 and verdicts[False, True] > 5
    assert repetition.quality(empty(spark)).count() == 0


def brute_repeats(raw, length):
    """Which bytes of each of some byte strings lie in strings of `length` that start in two places or more."""
    found = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if found[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("most", [2048, 1])
def test_suffix(spark, docs, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_STRETCHES", most)
    raw = [(i, (t or "").encode()) for i, t, *_ in fixture()]
    want = []
    for (i, b), gone, told in zip(raw, brute_repeats([b for _, b in raw], 90), brute_repeats([b for _, b in raw], 60)):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), int(told.sum())))
    own = docs.select("doc_id", "text", F.lit("x").alias("n_bytes"), F.lit(1).alias("spans"), F.lit(2).alias("tkey"))  # clashing columns are replaced
    got = suffix_dedup.remove_repeats(own, 90, passage=60)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert suffix_dedup.remove_repeats(empty(spark), 90, passage=60).count() == 0


def test_suffix_array():
    rng = random.Random(2)
    for block in (1, 256):
        induced.BLOCK = block
        for _ in range(300):
            letters, text = rng.choice([1, 2, 3, 9, 300]), []
            part = [rng.randrange(letters) for _ in range(rng.randrange(1, 20))]
            while len(text) < rng.randrange(1, 150):
                text += part if rng.random() < 0.5 else [rng.randrange(letters)]
            assert induced.suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_spans_under_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_STRETCHES", 1)
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(1000)
    df = spark.createDataFrame([(i, i, say(200) + passage + say(200)) for i in range(4)], "doc_id long, tkey long, text string")
    found = suffix_dedup.repeated_spans(df, (90,)).collect()
    assert len(found) == 4 and all(len(r.spans) < 60 for r in found)  # a run of starts is one span: stretches, not bytes


def test_shards_hold_what_is_sorted(monkeypatch):
    """Anchors that need no sorting don't fill shards, however the rows are cut into batches, and no anchor is lost or cut between two of them."""
    rng, sorted_bytes, shared = np.random.default_rng(3), [], suffix_dedup.shared_lengths
    monkeypatch.setattr(suffix_dedup, "shared_lengths", lambda pieces, *rest: sorted_bytes.append(len(utf8(pieces)[0])) or shared(pieces, *rest))
    rows, want = [], set()
    for anchor in range(9000):  # one in ten has two stretches that share their last 450 bytes, the others have copies of one
        text = rng.integers(97, 123, 600).astype(np.uint8)
        for seg in range(2 if anchor % 10 == 0 else 1):
            text[:150] = rng.integers(97, 123, 150)
            text[149] = seg
            rows.append((anchor, seg, 200, 1 if anchor % 10 == 0 else 3, False, seg + 2 * anchor, anchor, text.tobytes()))
            want.add((anchor, seg, 150 if anchor % 10 == 0 else 0, 199, 400))
    names = [c.split()[0] for c in suffix_dedup.PIECE_SCHEMA.split(", ")]
    for cut in (700, 10_000):
        sorted_bytes.clear()
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + cut], strict=True)], names=names) for k in range(0, len(rows), cut)]
        got = [tuple(r.values()) for b in suffix_dedup._sort((400,))(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(set(got))
        assert set(got) == want
        assert sorted_bytes == [1800 * 600]


@pytest.mark.parametrize("few", [0, 3, 64])
def test_suffix_array_of_few_and_many_items(few, monkeypatch):
    monkeypatch.setattr(induced, "FEW", few)
    rng = random.Random(few)
    for letters in (2, 5, 200):
        part = [rng.randrange(letters) for _ in range(150)]
        text = [x for _ in range(20) for x in (part[: rng.randrange(150)] if rng.random() < 0.6 else [rng.randrange(letters) for _ in range(60)])]
        assert induced.suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("letters", [3, 9, 300])
def test_suffix_array_of_long_falls(letters):
    rng = random.Random(letters)
    per = 64 // (letters + 1).bit_length()  # letters that are compared at once; substrings that tie up to just there end or go on
    for k in range(400):
        fall = sorted((rng.randrange(1, letters) for _ in range(rng.randrange(1, 2 * per))), reverse=True)
        text = list(range(letters)) * (k % 2)
        for _ in range(rng.randrange(2, 9)):
            text += fall + [rng.choice([letters - 1, *range(min(letters, 4))]) for _ in range(rng.randrange(3))]
        assert induced.suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("tile", [1024, 2])
def test_jaccard(spark, docs, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 1_000_000 if tile > 2 else 400)
    rows = fixture()
    sets = [(lambda w: {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())(WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))) for _, t, *_ in rows]
    name = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    name[i] = name[j] = min(name[i], name[j])
    first = {n: min((rows[k][0] for k in range(len(rows)) if name[k] == n and rows[k][0] is not None), default=None) for n in name}
    want = [(r[0], len(s), first[n]) for r, s, n in zip(rows, sets, name)]
    got = jaccard.jaccard_classes(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert jaccard.jaccard_classes(empty(spark), 4, 85).count() == 0


class BitWriter:
    """Numbers as bits, one after the other; written apart from the encoder, so that the decoder meets streams of another hand."""

    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def rice(self, value, k):
        folded = 2 * value if value >= 0 else -2 * value - 1
        self.bits += "0" * (folded >> k) + "1"
        self.put(folded, k)

    def done(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8))


def crc_of(data, poly, width):
    crc = 0
    for byte in data:
        crc ^= byte << (width - 8)
        for _ in range(8):
            crc = (crc << 1 ^ (poly if crc >> (width - 1) else 0)) & ((1 << width) - 1)
    return crc


def foreign_stream(samples, frames):
    """A stream without a seek table. frames: for each 192 samples, coefficients, shift, precision (0: a fixed predictor), coding method, and per partition a Rice parameter or None (unencoded)."""
    out = b""
    for number, (coefs, shift, precision, method, partitions) in enumerate(frames):
        x = [int(v) for v in samples[number * 192 : (number + 1) * 192]]
        head = bytes([0xFF, 0xF8, 0x14, 0x02, number])
        w = BitWriter()
        order = len(coefs)
        w.put((32 + order - 1 if precision else 8 + order) << 1, 8)
        for v in x[:order]:
            w.put(v, 8)
        if precision:
            w.put(precision - 1, 4), w.put(shift, 5)
            for c in coefs:
                w.put(c, precision)
        residual = [x[t] - (sum(c * x[t - 1 - j] for j, c in enumerate(coefs)) >> shift) for t in range(order, 192)]
        w.put(method, 2), w.put(len(partitions).bit_length() - 1, 4)
        at = 0
        for i, k in enumerate(partitions):
            own = residual[at : at + 192 // len(partitions) - (order if i == 0 else 0)]
            at += len(own)
            if k is None:
                size = max([1, *[v.bit_length() + 1 for v in own]]) if any(own) else 0
                w.put(31 if method else 15, 5 if method else 4), w.put(size, 5)
                for v in own:
                    w.put(v, size)
            else:
                w.put(k, 5 if method else 4)
                for v in own:
                    w.rice(v, k)
        frame = head + bytes([crc_of(head, 0x07, 8)]) + w.done()
        out += frame + crc_of(frame, 0x8005, 16).to_bytes(2, "big")
    info = b"".join([(192).to_bytes(2, "big") * 2, bytes(6), (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big"), hashlib.md5(np.array(samples, np.int8).tobytes()).digest()])
    return b"fLaC" + b"\x80" + len(info).to_bytes(3, "big") + info + out


def test_flac_of_another_hand():
    import pyarrow as pa

    rng = random.Random(3)
    wave = [max(-128, min(127, int(90 * np.sin(i / 7)) + rng.randrange(-9, 10))) for i in range(192 * 6)]
    wave[192 * 4 : 192 * 4 + 48] = [5] * 48
    frames = [
        ([2, -1], 0, 0, 0, [3, 4, None, 2]), ([1, -3, 2], 1, 4, 1, [5] * 8), ([], 0, 0, 0, [4, None]), ([3, -3, 1], 0, 0, 1, [None]),
        ([1], 0, 0, 0, [None, 3, 3, None]), ([7, -4, 1, 1, -2, 1, 0, 1, -1, 2], 2, 6, 0, [4]),
    ]
    stream = foreign_stream(wave, frames)
    assert flac.decode_media(pa.array([stream, stream], pa.binary()))[1].tolist() == wave
    damaged = bytearray(stream)
    damaged[60] ^= 1
    with pytest.raises(ValueError):
        flac.decode_media(pa.array([bytes(damaged)], pa.binary()))


def test_flac(spark, docs):
    media = flac.store_media(docs)
    for r in flac.read_media(media).collect():
        raw = (next(t for i, t, *_ in fixture() if i == r.doc_id) or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    blocks = flac.pcm_blocks(media, samples=192).collect()
    for i, t in {(r[0], r[1]) for r in fixture() if r[0] is not None and r[0] != 30}:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        own = [r for r in blocks if r.doc_id == i]
        assert {r.n_samples for r in own} == {len(payload)} and len(own) == len(payload) // 192
        assert all((np.frombuffer(r.pcm, np.uint8) ^ 0x80).tobytes() == payload[r.sample_offset : r.sample_offset + 192] for r in own)
    assert flac.read_media(flac.store_media(empty(spark))).count() == 0
    stream = bytearray(flac.encode_media([b"abc def " * 240])[0])
    stream[-9] ^= 4
    import pyarrow as pa

    with pytest.raises(ValueError):
        flac.decode_media(pa.array([bytes(stream)], pa.binary()))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://org/", "http://a.ORG/es/x", "https://b.example.org/es/1?x", "http://example.org/en/12", "http://xorg/", "http://x.com/de/1", "http://x.com/fr", "http://org", "http://a.org.net/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string")
    rules = spark.createDataFrame(url_rules.RULES, url_rules.RULE_SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(df, rules).collect()}
    assert got == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("org/", "allow"), 4: ("org/", "allow"), 5: ("example.org/es/", "block"), 6: ("example.org/en/1", "block"), 7: (None, "allow"), 8: ("com/de/", "block"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow")}
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0


def test_tokens(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids for i, t, *_ in fixture()}
    for r in token_counts.count_tokens(docs, tokenizer_path()).collect():
        assert r.n_tokens == len(ids[r.doc_id])
    token_files.write_token_files(docs, f"file://{tmp_path}/ids", tokenizer_path(), 2)
    start = 0
    for r in token_files.read_token_files(spark, f"file://{tmp_path}/ids").orderBy("start").collect():
        assert r.start == start and np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id] + [2]
        start += r.n_tokens
    assert [r.doc_id for r in token_files.read_token_files(spark, f"file://{tmp_path}/ids", [7]).collect()] == [7]
    token_files.write_token_files(empty(spark), f"file://{tmp_path}/none", tokenizer_path(), 2)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0
    assert token_counts.count_tokens(empty(spark), tokenizer_path()).count() == 0 and packing.pack_documents(empty(spark), tokenizer_path(), 2).count() == 0
    pieces = packing.pack_documents(docs, tokenizer_path(), 2).collect()
    assert sum(r.length for r in pieces) == start
    for r in pieces:
        own = np.array((ids[r.doc_id] + [2])[r.start : r.start + r.length], "<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
    full = collections.defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full[r.sequence_id]
        full[r.sequence_id] += r.length
    assert all(full[r.sequence_id] == r.tier for r in pieces)


def test_chunk_coder_starting_anew():
    rng = random.Random(4)
    texts = [None, "", "end.", ". a. b", *("".join(rng.choice(["a", "B", ".", ",", " ", "\n", "é", "9", "漢", "ab. "]) for _ in range(rng.randrange(60))) for _ in range(300))]
    made = tokens.ChunkCoder(tokenizer_path(), limit=50)
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        ids, ends = made.encode(*utf8(pa.array(part, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [made.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def test_token_counts_of_many_chunks(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = [" ".join(f"{chr(97 + i % 26)}{i}x{k}" for i in range(9000)) for k in range(5)] + ["the of and " * 5000]
    for size in (16384, 4):
        got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), tokenizer_path(), size=size).collect()
        assert {r.doc_id: (r.n_tokens, r.over_limit) for r in got} == {i: (n, n > 2048) for i, n in enumerate(len(plain.encode(t, add_special_tokens=False).ids) for t in texts)}


def brute_pipeline(rows, length):
    """(doc_id, text, source) rows that each stage leaves, for distinct numbers; after the mix as often as it takes them."""
    kept = [r for r in rows if brute_quality(r[1])[3]]
    sets = []
    for _, t, _ in kept:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    name = list(range(len(kept)))
    for _ in kept:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    name[i] = name[j] = min(name[i], name[j], key=lambda k: kept[k][0])
    one = [r for k, r in enumerate(kept) if name[k] == k]
    cut = []
    raw = [(t or "").encode() for _, t, _ in one]
    for (i, t, s), b, gone in zip(one, raw, brute_repeats(raw, length)):
        out, at = b"", 0
        for c in t or "":
            n = len(c.encode())
            out += b"" if gone[at : at + n].all() else b[at : at + n]
            at += n
        cut.append((i, None if t is None else out.decode(), s))
    copies, _ = brute_mix(cut, mixing.WEIGHTS)
    return kept, one, cut, [r for r, n in zip(cut, copies) for _ in range(n)]


def passages():
    """Documents of distinct words that share passages of 30 to 90 words, some of them in three places."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randrange(3, 9)))
    say = lambda n: [word() for _ in range(n)]
    shared = [say(n) for n in (30, 45, 51, 55, 60, 75, 90)]
    out = []
    for k, p in enumerate(shared):
        out += [say(90 + 9 * k) + p + say(120) for _ in range(2 + k % 2)]
    return [" ".join(w) for w in out], [" ".join(p) for p in shared]


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    texts, shared = passages()
    rows = [r for r in {r[0]: r for r in fixture()}.values() if r[0] is not None]
    rows += [(500 + i, t, "en", f"s{i % 2}", len(t), 0, 0) for i, t in enumerate(texts + [texts[0]] + repeating())]
    docs = spark.createDataFrame(rows, SCHEMA).select(*corpus_pipeline.COLUMNS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    after = brute_pipeline([(i, t, s) for i, t, _, s, *_ in rows], corpus_pipeline.PASSAGE_BYTES)
    for p in shared:  # passages of 51 words and more are gone, whole
        assert len(p.split()) < 51 or not any(p in (t or "") for _, t, _ in after[2])
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], after, strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted([(r.doc_id, r.text, r.source) for r in docs.collect()], key=repr) == sorted(want, key=repr), name
        assert all(name == "quality rules" or name == "near duplicates" or r.n_chars == len(r.text or "") for r in docs.collect())
    plain = Tokenizer.from_file(tokenizer_path())
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in after[3]}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = collections.Counter(i for i, _, _ in after[3])
    covered = collections.Counter()
    for r in pieces:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert covered == collections.Counter({(i, k): times[i] for i in times for k in range(len(ids[i]))})


def test_pipeline_odd_rows(spark):
    odd = [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, " \n", "en", "s", 2), (3, "é" * 5000, "fr", "s", 5000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        want = {"quality rules": 0, "near duplicates": 4, "repeated passages": 5, "source mix": None, "packing": None}[name]
        got = stage(spark, docs, "")
        assert want is None or got.count() == want, name
        assert stage(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_repeated_ids(spark):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    near = base[2].replace("c30 ", "other ")
    texts = [(1, base[0]), (1, base[0]), (2, base[0]), (None, base[1]), (None, base[1]), (5, base[2]), (6, near), (7, None), (8, ""), (9, base[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, base[0]), (None, base[1]), (5, base[2]), (7, None), (8, ""), (9, base[3])], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
