import itertools
import math

import numpy as np
import public_tokenizers
from conftest import documents

from curveboard.llm import pieces
from curveboard.llm.blocks import text_blocks

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, weights):
    n = len(word)
    for cuts in itertools.product([0, 1], repeat=n - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [n]
        parts = [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        if all(p in weights for p in parts):
            yield tuple(parts), sum(weights[p] for p in parts)


def test_draws_follow_the_lattice():
    import pyarrow as pa

    v = pieces.Pieces(PATH, 0.3)
    weights = dict(zip((v.bytes[i] for i in v.ids), v.weights, strict=True))
    word = "other"
    all_of = dict(segmentations(b" " + word.encode(), weights))
    total = sum(math.exp(s) for s in all_of.values())
    n = 20_000
    texts = pieces.prefixed(pa.array([word] * n))
    seen = {}
    for first, last, data, offs in text_blocks(texts):
        ids, count, score = pieces.segmented(data, offs, np.arange(first, last).astype(np.uint64), v)
        for i, part in enumerate(np.split(ids, np.cumsum(count)[:-1])):
            key = tuple(v.bytes[k] for k in part)
            seen[key] = seen.get(key, 0) + 1
            assert abs(score[i] - (all_of[key] - math.log(total))) < 1e-9
    for key, s in all_of.items():
        p = math.exp(s) / total
        assert abs(seen.get(key, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_lossless_and_reproducible(odd_documents, no_documents):
    a = {r.doc_id: r for r in pieces.encoded(odd_documents, PATH).collect()}
    b = {r.doc_id: r for r in pieces.encoded(odd_documents.repartition(5), PATH).collect()}
    assert a == b
    assert a[0].ids is None and a[0].n_pieces == 0 and a[1].ids == []
    assert all(r.lossless for r in a.values())
    texts = {r.doc_id: r.text for r in odd_documents.select("doc_id", "text").collect()}
    back = pieces.decoded(pieces.encoded(odd_documents, PATH), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == texts
    assert pieces.encoded(no_documents, PATH).count() == 0


def test_library_decodes_the_same_text(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["Hello  world", " lead", "a\nb\tc", "naïve 你好 👍", "thing" * 30]
    for r in pieces.encoded(documents(spark, texts), PATH, alpha=0.2).collect():
        assert library.decode(list(r.ids)) == texts[r.doc_id]


def test_a_repeated_row_draws_the_same(spark):
    df = documents(spark, ["some other things"])
    rows = pieces.encoded(df.union(df), PATH, alpha=0.1).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
