"""Components of chains, stars and random links, within a bound on tables written; similarities below one half."""

import math
import random

import pytest

from tidemark.llm import components as module
from tidemark.llm import jaccard


def groups(pairs):
    name = {v: v for p in pairs if p[0] != p[1] for v in p}

    def top(x):
        while name[x] != x:
            name[x] = x = name[name[x]]
        return x

    for a, b in pairs:
        if a != b:
            name[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in name}


def shapes():
    rng = random.Random(3)
    some = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    return {
        "chain": [(i, i + 1) for i in range(3000)],
        "falling": [(i + 1, i) for i in range(3000)] + [(5, 5)],
        "star": [(3000, i) for i in range(3000)],
        "comb": [(i, 2000 - i) for i in range(2000)] + [(i, 2001 - i) for i in range(2, 2000)],
        "random": some + some[:20],
        "none": [],
    }


@pytest.mark.parametrize("shape", sorted(shapes()))
def test_components(spark, shape, monkeypatch):
    pairs, written, real = shapes()[shape], [], module.stored

    def counted(df, name):
        written.append(name)
        assert len(written) <= 2 + 5 * math.ceil(math.log2(4096)), "too many tables"
        return real(df, name)

    monkeypatch.setattr(module, "stored", counted)
    want = groups(pairs)
    got = module.components(spark.createDataFrame(pairs, "a long, b long").coalesce(2)).collect()
    assert len(got) == len(want)
    root = {r.id: r.root for r in got}
    assert set(root) == set(want) and all(root[r] == r for r in root.values())
    assert {(want[v], root[v]) for v in want} == {(w, root[w]) for w in want.values()} and len(set(root.values())) == len(set(want.values()))


def test_wide_apart_sizes(spark):
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words[:k]) for k in (600, 130)] + ["alone in the world here"]
    got = jaccard.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=1, percent=20)
    assert {r.doc_id: r.component_id for r in got.collect()} == {0: 0, 1: 0, 2: 2}
