import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL, documents
from pyspark.sql import functions as F

from curveboard.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(df, texts, library, width):
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    places = defaultdict(list)
    pieces = defaultdict(list)
    for r in df.collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and 1 <= r.length <= width
            part = np.array(ids[d][at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids[d]) and all(r.length == width for r in own[1:])
        assert len(own) == 1 or len(ids[d]) > width
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= width
    return len(places), sum(map(len, ids.values()))


def test_ids_and_places(spark, library, odd_documents, no_documents):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    n, tokens = check(packing.pack_documents(df, PATH), texts, library, 2048)
    # a heuristic: within one sequence of the least possible number
    assert n <= -(-tokens // 2048) + 1
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    check(packing.pack_documents(odd_documents, PATH, width=64), texts, library, 64)
    assert packing.pack_documents(no_documents, PATH).count() == 0


def test_special_strings_have_their_ids(spark, library):
    mark = "<|endoftext|>"
    texts = [mark, f"a {mark} b", f"{mark}{mark}  {mark}\n", f"a  {mark}  b {mark[:-1]}", f"{'y' * 5000} {mark} z"]
    texts.append("I'll we've 'sam it''s x's\n\n  y \t z  ")
    check(packing.pack_documents(documents(spark, texts), PATH), dict(enumerate(texts)), library, 2048)
    out = packing.tokenised(documents(spark, [mark]), PATH, with_ids=True).first()
    assert out.ids == [50256, 0]


def test_sequences_hold_the_ids(spark, library):
    texts = [f"text number {i} " * (1 + i % 9) for i in range(60)] + [None]
    docs = documents(spark, texts)
    out = packing.sequences(docs, PATH, width=32).collect()
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    assert sum(len(r.ids) for r in out) == want and max(len(r.ids) for r in out) <= 32


def test_fullest_combination_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        left = [0] * 41
        items = [rng.randint(1, 20) for _ in range(rng.randint(0, 9))]
        for x in items:
            left[x] += 1
        room = rng.randint(0, 40)
        got = packing.fullest(room, sorted(set(items)), left)
        best = max((s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room))
        assert sum(got) == best and all(got.count(x) <= left[x] for x in got)


def test_plan_uses_every_piece_once():
    rng = random.Random(5)
    histogram = {length: rng.randint(1, 500) for length in rng.sample(range(1, 129), 90)}
    runs = packing.plan(histogram, 128)
    used = defaultdict(set)
    fill = defaultdict(int)
    for length, rank, n, sequence, _ in runs:
        for i in range(n):
            assert rank + i not in used[length]
            used[length].add(rank + i)
            fill[sequence + i] += length
    assert {length: len(s) for length, s in used.items()} == histogram
    assert max(fill.values()) <= 128
    # never worse than best-fit decreasing
    free, bins = [0] * 129, 0
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        room = next((r for r in range(length, 129) if free[r]), None)
        if room is None:
            bins, room = bins + 1, 128
        else:
            free[room] -= 1
        free[room - length] += 1
    assert len(fill) <= bins


def test_repeated_rows_are_packed_each(spark, library):
    docs = documents(spark, ["same words", "same words"]).withColumn("doc_id", F.lit(1))
    assert packing.pack_documents(docs, PATH).count() == 2
