"""Suffix arrays by induced sorting in numpy, and permuted common prefixes.

Both induction scans take whole blocks of letters at once: as long as nothing that a block induces falls into the block itself, its suffixes are ready together. Over bytes a block is
one letter; over the names of a recursion, of which there are many with few suffixes each, a block holds hundreds of letters.
"""

from __future__ import annotations

import numpy as np

#: Suffixes of the first block of a scan; blocks grow while they induce nothing into themselves.
BLOCK = 256
#: So few items are dealt one by one, which takes less than the calls for many.
FEW = 64


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than the next one); the end of the text is smaller than any letter."""
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    rises = np.zeros(len(ends), bool)
    rises[:-1] = s[ends[:-1] + 1] > s[ends[:-1]]
    return np.repeat(rises, np.diff(ends, prepend=-1))


def _deal(sa: np.ndarray, place: np.ndarray, letters: np.ndarray, items: np.ndarray, step: int) -> None:
    """Puts items into their letters' buckets, in order, at place (moved on by each; step 1: from the left, -1: from the right)."""
    if len(items) <= FEW:
        for letter, item in zip(letters.tolist(), items.tolist(), strict=True):
            at = int(place[letter])
            sa[at] = item
            place[letter] = at + step
        return
    order = letters.argsort(kind="stable")
    sorted_letters = letters[order]
    new = np.empty(len(order), bool)
    new[0] = True
    np.not_equal(sorted_letters[1:], sorted_letters[:-1], out=new[1:])
    first = new.nonzero()[0]
    counts = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=counts[:-1])
    counts[-1] = len(order) - first[-1]
    used = sorted_letters[first]
    to = place[used]
    at = np.arange(len(order))
    if step > 0:
        at += np.repeat(to - first, counts)
    else:
        np.subtract(np.repeat(to + first, counts), at, out=at)
    sa[at] = items[order]
    place[used] = to + step * counts


def _scan(s: np.ndarray, wanted: np.ndarray, sa: np.ndarray, bounds: np.ndarray, place: np.ndarray, step: int) -> None:
    """One induction scan over all buckets, upwards (step 1) or downwards (step -1).

    wanted: suffixes of the type that the scan places; bounds: where buckets begin, and n; place: the next slot of each bucket, from its near end. Slots not yet filled hold -1.
    """
    letters = len(bounds) - 1
    near = bounds[:-1] if step > 0 else bounds[1:] - 1  # the slot of each bucket that the scan meets first

    def before(slots: np.ndarray) -> np.ndarray:
        items = slots[slots > 0] - 1
        return items[wanted[items]]

    c, size = (0, BLOCK) if step > 0 else (letters - 1, BLOCK)
    while 0 <= c < letters:
        if step > 0:
            d = min(letters, max(c + 1, int(np.searchsorted(bounds, bounds[c] + size, "right")) - 1))
        else:
            d = max(-1, min(c - 1, int(np.searchsorted(bounds, bounds[c + 1] - size, "left")) - 1))
        if d != c + step:
            items = before(sa[bounds[c] : bounds[d]] if step > 0 else sa[bounds[d + 1] : bounds[c + 1]][::-1])
            if not len(items):
                c, size = d, 2 * size
                continue
            to = s[items].astype(np.int64)
            nearest = int(to.min() if step > 0 else to.max())
            if (d - nearest) * step <= 0:
                _deal(sa, place, to, items, step)
                c, size = d, 2 * size
                continue
            if nearest != c:  # the letters before the first one that the block feeds
                ready = (s[items + 1].astype(np.int64) - nearest) * step < 0
                done = int(np.count_nonzero(ready))  # they come first
                if done:
                    _deal(sa, place, to[:done], items[:done], step)
                size = max(BLOCK, 2 * abs(int(bounds[nearest]) - int(bounds[c])))
                c = nearest
                continue
            size = BLOCK
        at = int(near[c])
        while at != place[c]:  # suffixes of this letter; those they add to this bucket come in the next round
            to = int(place[c])
            items = before(sa[at:to] if step > 0 else sa[to + 1 : at + 1][::-1])
            at = to
            if len(items):
                _deal(sa, place, s[items], items, step)
        items = before(sa[at : bounds[c + 1]] if step > 0 else sa[bounds[c] : at + 1][::-1])
        if len(items):
            _deal(sa, place, s[items], items, step)
        c += step


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array, given the LMS suffixes in order."""
    n, bounds = len(s), np.concatenate([[0], np.cumsum(sizes)])
    sa = np.full(n, -1, np.int32)
    letters = s[lms]
    count = np.bincount(letters, minlength=len(sizes))
    tails = bounds[1:] - count
    if len(lms):
        _deal(sa, tails.copy(), letters, lms, 1)
    head = bounds[:-1].copy()
    sa[head[s[n - 1]]] = n - 1  # the last suffix follows the end of the text
    head[s[n - 1]] += 1
    _scan(s, ~is_s, sa, bounds, head, 1)
    used = np.flatnonzero(count)
    lengths = count[used]
    sa[np.repeat(tails[used] - np.cumsum(lengths) + lengths, lengths) + np.arange(len(lms))] = -1
    _scan(s, is_s, sa, bounds, bounds[1:] - 1, -1)
    return sa


def _by_substring(s: np.ndarray, lms: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of LMS suffixes in the order of their LMS substrings, and whether each substring differs from the one before it.

    A substring reaches to the next LMS letter; one that ends there is above those that go on, and what the end of the text cuts is below all. So many letters as a 64-bit
    word holds are compared at once, then those of the ties that go on.
    """
    n, bits = len(s), (letters + 1).bit_length()
    per = 64 // bits
    block, have = s.astype(np.uint64) + np.uint64(1), 1
    word, got = np.zeros(n + 1, np.uint64), 0  # the last is what follows the end
    while got < per:  # letters of a block, twice as many each time
        if (per - got) & have:
            word <<= np.uint64(bits * have)
            word[: max(n - got, 0)] |= block[got:]
            got += have
        following = block[have:]
        block = block << np.uint64(bits * have)
        block[: len(following)] |= following
        have *= 2
    past = [sum((letters + 1) << bits * (per - 1 - k) for k in range(m, per)) for m in range(per + 1)]
    keep = np.array([(1 << bits * per) - (1 << bits * (per - m)) for m in range(per + 1)], np.uint64)
    past = np.array(past, np.uint64)
    size = np.diff(np.append(lms, n + per)) + 1  # the last one ends with the text's own end

    def key(which: np.ndarray, done: int) -> np.ndarray:
        left = np.minimum(size[which] - done, per)
        return word[np.minimum(lms[which] + done, n)] & keep[left] | past[left]

    keys = key(np.arange(len(lms)), 0)
    order = keys.argsort()
    keys = keys[order]
    new = np.ones(len(lms), bool)
    new[1:] = keys[1:] != keys[:-1]
    done = per
    while True:
        group = np.maximum.accumulate(np.where(new, np.arange(len(lms)), 0))
        tied = ~(new & np.append(new[1:], True)) & (size[order] >= done)  # one that ends just here is above those that tie with it and go on
        at = np.flatnonzero(tied)
        if not len(at):
            return order, new
        keys = key(order[at], done)
        sub = np.lexsort((keys, group[at]))
        order[at], keys, owner = order[at][sub], keys[sub], group[at]
        new[at[1:]] |= (keys[1:] != keys[:-1]) & (owner[1:] == owner[:-1])
        done += per


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (whole numbers from 0) in order. LMS substrings that are not all different are told apart by this function, over their names."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    counts = np.bincount(s)
    present = counts > 0
    s = (np.cumsum(present) - 1).astype(np.uint16 if np.count_nonzero(present) < 65536 else np.int32)[s]
    sizes = counts[present]
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + np.int32(1)
    order, new = _by_substring(s, lms, len(sizes)) if len(lms) else (np.zeros(0, np.int64), np.zeros(0, bool))
    if not new.all():
        names = np.empty(len(lms), np.int32)
        names[order] = np.cumsum(new) - 1
        order = suffix_array(names)
    return _induce(s, is_s, lms[order], sizes)


def common_prefixes(data: np.ndarray, sa: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: for each start in text order, how many bytes it shares with the suffix before it in the array (up to either piece's end), and that suffix.

    data: bytes of pieces, with any byte after each; ends: for each start, the end of the piece it lies in (a start at its own end shares nothing). Only starts whose left byte
    differs from their neighbour's (irreducible ones) and first bytes of pieces are compared; any other shares one byte less than the start before it.
    """
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    left = np.maximum(before - 1, 0)
    own = before <= 0
    own[0] = True
    own[1:] |= (data[:-1] != data[left[1:]]) | (ends[1:] != ends[:-1]) | (left[1:] == ends[left[1:]])
    at = np.flatnonzero(own & (before >= 0)).astype(np.int32)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded.data, strides=(1,))  # eight bytes from each start
    x, y = at, before[at]
    most = np.minimum(ends[x] - x, ends[y] - y).astype(np.int32)
    found, done = np.zeros(len(at), np.int32), 0
    live = np.flatnonzero(most > 0)
    x, y = x[live], y[live]
    while len(live):
        odd = words[x + done] ^ words[y + done]
        whole = odd == 0
        part = np.flatnonzero(~whole)
        low = odd[part] & (~odd[part] + np.uint64(1))  # the lowest bit that differs
        found[live[part]] = done + (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int32)
        done += 8
        live, x, y = live[whole], x[whole], y[whole]
        ended = most[live] <= done
        found[live[ended]] = done
        live, x, y = live[~ended], x[~ended], y[~ended]
    shared = np.zeros(n, np.int32)
    shared[at] = np.minimum(found, most)
    source = np.maximum.accumulate(np.where(own, np.arange(n, dtype=np.int32), 0))
    return np.maximum(shared[source] - (np.arange(n, dtype=np.int32) - source), 0), before
