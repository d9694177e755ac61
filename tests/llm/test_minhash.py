import collections
import random

import numpy as np
import pytest
from conftest import documents, prose

from curveboard.llm import graph, minhash


def bag(text):
    w = (text or "").split()
    if not w:
        return collections.Counter()
    if len(w) < 5:
        return collections.Counter([tuple(w)])
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(texts):
    bags = {i: bag(t) for i, t in enumerate(texts)}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in bags:
        for j in range(i):
            shared = sum(min(n, bags[j][k]) for k, n in bags[i].items())
            total = sum(bags[i].values()) + sum(bags[j].values()) - shared
            if total and 5 * shared >= 4 * total:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in bags}


def edited(text, n, seed):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    rows, hashes, weights, true = [], [], [], []
    for i in range(300):
        e = rng.integers(1, 1 << 60, 30).astype(np.uint64)
        a = rng.integers(0, 12, 30)
        b = np.where(rng.random(30) < 0.6, a, rng.integers(0, 12, 30))
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        for row, w in ((2 * i, a), (2 * i + 1, b)):
            rows += [row] * int((w > 0).sum())
            hashes += list(e[w > 0])
            weights += list(w[w > 0])
    s = minhash.signatures(np.array(rows), np.array(hashes, np.uint64), np.array(weights), 600)
    agree = (s[0::2] == s[1::2]).mean(axis=1)
    true = np.array(true)
    assert abs((agree - true).mean()) < 4 * np.sqrt((true * (1 - true) / 64).mean() / 300)


def test_equals_brute_force(spark):
    texts = [prose(i, 120) for i in range(40)]
    texts += [edited(texts[i % 4], i % 7, i) for i in range(120)]
    texts += [texts[3]] * 5 + ["a b", "a b", "a b c", "", None, "  ", texts[5] + " " + texts[5]]
    out = minhash.near_duplicates(documents(spark, texts).repartition(6))
    found = {r.doc_id: r.component_id for r in out.collect()}
    assert found == brute(texts)


def test_members_apart_from_their_leader_are_not_lost(spark, monkeypatch):
    """A chain in which neighbours are near and others are not, all forced into one bucket."""
    monkeypatch.setattr(minhash, "banded", lambda s: np.ones((len(s), 16), np.int64))
    chain, text = [], prose(7, 100)
    for i in range(12):
        chain.append(text)
        text = edited(text, 2, i)
    texts = [*chain, *(prose(50 + i, 80) for i in range(10))]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert found == brute(texts)


def test_odd_rows(odd_documents, no_documents):
    rows = odd_documents.orderBy("doc_id").collect()
    out = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(odd_documents).collect()}
    want = brute([r.text for r in rows])
    assert out == {i: (c, c == i) for i, c in want.items()}
    assert minhash.near_duplicates(no_documents).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 400)] + [(9, 9)]
    out = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 100 for i in range(100, 161))
    assert all(out[i] == 5 for i in [5, *range(200, 400)]) and out[9] == 9
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chain", [[1, 5, 3, 6, 2], *[random.Random(i).sample(range(1, 9), 8) for i in range(6)]])
def test_components_of_chains_in_any_order(spark, chain):
    """A chain alone, so that no other component keeps the loop going."""
    edges = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "a long, b long")
    out = {r.id: r.component for r in graph.components(edges).collect()}
    assert out == dict.fromkeys(chain, 1)


def test_many_variants_of_a_short_notice(spark, monkeypatch):
    """Texts that differ in the last words only share a band and are compared in blocks of bounded rows."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    texts = [f"all rights to this short notice are held by owner number {i} of {i % 7}" for i in range(150)]
    texts += [t + " again and again" for t in texts[:40]]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert out == brute(texts)
