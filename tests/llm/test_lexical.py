import math
import random
import re
from collections import Counter

import numpy as np
from conftest import documents, prose

from curveboard.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=20):
    """Every document against every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    total, every = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for (doc, c), n in zip(counts, sizes):
            m = 75 + (25 * n * total) // max(every, 1)
            s = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in terms(text)
                if c[t]
            )
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=20):
    table = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.ranked(docs, table, k).collect()), key=str)


def corpus():
    rng = random.Random(3)
    words = [prose(i, 1) for i in range(150)] + ["Äé", "naïve", "1st", "ZZ"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(900)]
    texts += texts[:40] * 3 + [None, "", " .,; ", "\x00\x7f"] + [" ".join(rng.choices(words, weights, k=9000))]
    items = [(i, "; ".join(rng.choices(words, k=rng.randint(1, 25))).title()) for i in range(60)]
    return texts, items + [(60, None), (61, ""), (62, "nowhere"), (None, words[3]), items[0], (0, words[4])]


def test_equals_brute_force(spark, monkeypatch):
    texts, items = corpus()
    docs = documents(spark, texts)
    expected = brute_force(list(enumerate(texts)), items)
    assert found(spark, docs, items) == expected
    monkeypatch.setattr(lexical, "LEAF", 3)
    monkeypatch.setattr(lexical, "TREE_ROWS", 50)
    monkeypatch.setattr(lexical, "SLICE_BYTES", 100)
    monkeypatch.setattr(lexical, "ITEMS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        assert found(spark, docs, items) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_odd_documents(spark, odd_documents, no_documents):
    texts = [(r.doc_id, r.text) for r in odd_documents.collect()]
    items = [(1, "one a b E 5678 café 你好"), (2, prose(1, 20))]
    assert found(spark, odd_documents, items) == brute_force(texts, items)
    assert found(spark, no_documents, items) == []
    assert lexical.ranked(odd_documents, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_ties_repeats_and_missing_ids(spark):
    rows = [(5, "x y"), (None, "x y"), (3, "x y"), (3, "x y"), (9, "z")] + [(100 + i, "q r s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "x x y"), (2, "q")]
    assert found(spark, docs, items, 3) == brute_force(rows, items, 3)


def test_bounds_leave_most_documents_out():
    """A search on a tree scores a part of the documents that hold one of the item's terms."""
    rng = np.random.default_rng(1)
    words, rows = 400, 4000
    p = 1 / np.arange(1, words + 1)
    lists = [np.unique(rng.choice(words, 30, p=p / p.sum()), return_counts=True) for _ in range(rows)]
    sizes = np.array([len(t) for t, _ in lists])
    flat, tfs = (np.concatenate(c) for c in zip(*lists))
    tree = lexical.Tree(
        np.arange(rows), np.ones(rows, bool), np.full(rows, 100), sizes, words - 1 - flat, tfs, words
    )
    holding = scored = 0
    for seed in range(20):
        item = np.unique(np.random.default_rng(seed).choice(words, 12))
        weights = 20_000 - 40 * item
        search = lexical.Search(tree, item, weights, 20)
        search.run()
        scored += search.scored
        holding += sum(len(np.intersect1d(words - 1 - t, item)) > 0 for t, _ in lists)
    assert scored < 0.5 * holding
