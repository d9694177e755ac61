"""Ranked lexical search by branch and bound on frequency-ordered trees of documents.

A document keeps the terms that the items ask for, rarest first. Blocks of documents become trees whose
paths share such terms; a node knows the documents below it (one run of the sorted block), the largest
frequency of its own term and the smallest length norm among them. For an item, the rarest of its terms
opens its nodes first; a subtree whose bound stays below the score of the last hit so far is left out.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curveboard.llm.blocks import column, mapped, small_batches, text_blocks
from curveboard.llm.store import stored

#: Items that share one pass over the documents, and the bytes of their texts.
ITEMS, ITEM_BYTES = 2000, 32 << 20
#: A tree takes up to so many documents or entries of their vectors.
TREE_ROWS, TREE_ENTRIES = 1 << 15, 2 << 20
#: Subtrees of up to so many documents are scored at once.
LEAF = 128
SLICE_BYTES = 1 << 20
#: Bytes of terms: digits, letters in lower case, and all beyond ASCII; the others part terms.
PARTS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def term_slices(text: bytes):
    """Terms of a text with repeats, some of them at a time."""
    plain, at = text.translate(PARTS), 0
    while at < len(plain):
        end = at + SLICE_BYTES
        if end < len(plain):
            cut = plain.rfind(b" ", at, end)
            cut = plain.find(b" ", end) if cut < 0 else cut
            end = len(plain) if cut < 0 else cut + 1
        yield plain[at:end].split()
        at = end


def restricted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of terms of each whole text, and its counts of ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batch):
        place, wide = shared.value.get, len(shared.value) + 1
        for first, last, data, offs in text_blocks(column(batch, "text")):
            raw, edges = data.tobytes(), offs.tolist()
            sizes, found = np.zeros(last - first, np.int64), []
            for i in range(last - first):
                for words in term_slices(raw[edges[i] : edges[i + 1]]):
                    sizes[i] += len(words)
                    at = np.fromiter(map(place, words, repeat(-1)), np.int64, len(words))
                    at, tf = np.unique(at[at >= 0], return_counts=True)
                    found.append((i * wide + at, tf))
            keys = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            tfs = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            keys, back = np.unique(keys, return_inverse=True)
            tfs = np.bincount(back, tfs, len(keys)).astype(np.int32)
            ends = np.searchsorted(keys, np.arange(last - first + 1) * wide).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id").slice(first, last - first),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(ends, pa.array((keys % wide).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(tfs)),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(rows, run, "doc_id long, n long, terms array<int>, tfs array<int>")


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count is worth under a length norm; rises with ``tf``, falls with ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return 100 - 25 + (25 * n * documents) // max(terms, 1)


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the ranges, in turn."""
    sizes = ends - starts
    stops = np.cumsum(sizes)
    return np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(starts - (stops - sizes), sizes)


class Tree:
    """Trie of a block of documents over their terms, rarest first, as arrays of nodes by term.

    ``ids``, ``m`` and ``ptr`` follow the documents sorted by their paths, so the documents below a
    node are one run. Nodes of a term are sorted by the start of their run, and the runs are disjoint.
    """

    def __init__(self, ids, known, m, sizes, terms, tfs, vocabulary: int):
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((terms, row))
        terms, tfs = terms[order].astype(np.int64), tfs[order].astype(np.int64)
        ptr = np.concatenate(([0], np.cumsum(sizes)))
        raw, edges = terms.astype(">u4").tobytes(), (4 * ptr).tolist()
        paths = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        sort = sorted(range(len(paths)), key=paths.__getitem__)
        shared = [0]
        for a, b in zip(sort, sort[1:], strict=False):
            x, y = terms[ptr[a] : ptr[a + 1]], terms[ptr[b] : ptr[b + 1]]
            k = min(len(x), len(y))
            differ = np.flatnonzero(x[:k] != y[:k])
            shared.append(int(differ[0]) if len(differ) else k)
        sort, shared = np.array(sort, np.int64), np.array(shared, np.int64)
        flat = spread(ptr[sort], ptr[sort + 1])
        self.ids, self.known, self.m = ids[sort], known[sort], m[sort]
        self.terms, self.tfs, sizes = terms[flat], tfs[flat], sizes[sort]
        self.ptr = np.concatenate(([0], np.cumsum(sizes)))
        self._nodes(sizes, shared, vocabulary)

    def _nodes(self, sizes, shared, vocabulary):
        levels, live, depth = [], np.flatnonzero(sizes > 0), 0
        while len(live):
            new = np.ones(len(live), bool)
            new[1:] = (live[1:] != live[:-1] + 1) | (shared[live[1:]] <= depth)
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(live)) - 1
            entry = self.ptr[live] + depth
            levels.append(
                (
                    self.terms[entry[at]],
                    live[at],
                    live[last] + 1,
                    np.maximum.reduceat(self.tfs[entry], at),
                    np.minimum.reduceat(self.m[live], at),
                )
            )
            depth += 1
            live = live[sizes[live] > depth]
        empty = np.zeros(0, np.int64)
        term, start, end, tf, m = (np.concatenate(c) for c in zip(*levels, strict=True)) if levels else (empty,) * 5
        order = np.lexsort((start, term))
        term, self.start, self.end, self.tf, self.least_m = (c[order] for c in (term, start, end, tf, m))
        self.head = np.searchsorted(term, np.arange(vocabulary + 1))
        self.bound = saturation(self.tf, self.least_m)
        self.most, self.most_tf = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        have = np.flatnonzero(np.diff(self.head))
        if len(have):
            self.most[have] = np.maximum.reduceat(self.bound, self.head[have])
            self.most_tf[have] = np.maximum.reduceat(self.tf, self.head[have])

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int | None, int]]:
        """The k best (doc_id, score) for terms in ascending order with their weights."""
        return Search(self, terms, weights, k).run()


class Search:
    """Depth-first branch and bound of one item on one tree."""

    def __init__(self, tree: Tree, terms: np.ndarray, weights: np.ndarray, k: int):
        here = tree.most[terms] > 0
        self.tree, self.k = tree, k
        self.terms, self.weights = terms[here], weights[here]
        self.hits = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.least = 1
        self.scored = 0

    def run(self) -> list[tuple[int | None, int]]:
        if len(self.terms):
            self.dense = np.zeros(len(self.tree.most), np.int64)
            self.dense[self.terms] = self.weights
            self.descend(0, len(self.tree.ids), 0, 0, 1)
        score, row = self.hits
        known = self.tree.known[row]
        ids = self.tree.ids[row]
        return [(int(i) if ok else None, int(s)) for s, i, ok in zip(score, ids, known, strict=True)]

    def rest(self, m) -> np.ndarray:
        """Most that terms from each place on can add under norms of ``m`` or more."""
        tree = self.tree
        each = self.weights * np.minimum(tree.most[self.terms], saturation(tree.most_tf[self.terms], m))
        return np.append(np.cumsum(each[::-1])[::-1], 0)

    def descend(self, start: int, end: int, place: int, sure: int, m: int) -> None:
        """Documents of a run that hold none of the terms before ``place`` but those bounded in ``sure``."""
        tree, rest = self.tree, self.rest(m)
        met = np.zeros(end - start + 1, np.int64)
        for j in range(place, len(self.terms)):
            if sure + rest[j] < self.least:
                return
            low, high = tree.head[self.terms[j]], tree.head[self.terms[j] + 1]
            nodes = np.arange(
                low + np.searchsorted(tree.start[low:high], start), low + np.searchsorted(tree.start[low:high], end)
            )
            if not len(nodes):
                continue
            nodes = nodes[np.cumsum(met[:-1])[tree.start[nodes] - start] == 0]
            met[tree.start[nodes] - start] += 1
            np.subtract.at(met, tree.end[nodes] - start, 1)
            bound = sure + self.weights[j] * tree.bound[nodes] + rest[j + 1]
            nodes = nodes[bound >= self.least]
            if len(nodes):
                self.visit(nodes, j, sure)
        if sure >= self.least:
            self.score(start + np.flatnonzero(np.cumsum(met[:-1]) == 0))

    def visit(self, nodes: np.ndarray, j: int, sure: int) -> None:
        """Subtrees of the j-th term, best bound first: small ones are scored together, large ones searched."""
        tree, m = self.tree, self.tree.least_m[nodes]
        own = sure + self.weights[j] * tree.bound[nodes]
        bound = own.copy()
        for i in range(j + 1, len(self.terms)):
            t = self.terms[i]
            starts = tree.start[tree.head[t] : tree.head[t + 1]]
            below = np.searchsorted(starts, tree.end[nodes]) > np.searchsorted(starts, tree.start[nodes])
            worth = np.minimum(tree.most[t], saturation(tree.most_tf[t], m))
            bound += np.where(below, self.weights[i] * worth, 0)
        order = np.argsort(-bound, kind="stable")
        waiting, size = [], 0
        for v in order.tolist():
            if bound[v] < self.least:
                break
            node = nodes[v]
            run = int(tree.end[node] - tree.start[node])
            if run > LEAF:
                self.descend(int(tree.start[node]), int(tree.end[node]), j + 1, int(own[v]), int(m[v]))
                continue
            waiting.append(node)
            size += run
            if size >= LEAF:
                self.score(spread(tree.start[waiting], tree.end[waiting]))
                waiting, size = [], 0
        if waiting:
            self.score(spread(tree.start[waiting], tree.end[waiting]))

    def score(self, rows: np.ndarray) -> None:
        """Exact scores of documents; the best k so far stay."""
        tree = self.tree
        self.scored += len(rows)
        sizes = tree.ptr[rows + 1] - tree.ptr[rows]
        entry = spread(tree.ptr[rows], tree.ptr[rows + 1])
        weight = self.dense[tree.terms[entry]]
        at = np.flatnonzero(weight)
        m = np.repeat(tree.m[rows], sizes)[at]
        worth = weight[at] * saturation(tree.tfs[entry[at]], m)
        total = np.concatenate(([0], np.cumsum(worth)))
        ends = np.searchsorted(at, np.cumsum(sizes))
        score = total[ends] - total[np.concatenate(([0], ends[:-1]))]
        good = score >= self.least
        score = np.concatenate((self.hits[0], score[good]))
        row = np.concatenate((self.hits[1], rows[good]))
        best = np.lexsort((tree.ids[row], ~tree.known[row], -score))[: self.k]
        self.hits = (score[best], row[best])
        if len(best) == self.k:
            self.least = max(1, int(score[best[-1]]))


def trees(vectors: DataFrame, order: np.ndarray, documents: int, terms: int, search) -> DataFrame:
    """Search results of every block: (item, doc_id, score).

    A task takes its rows in blocks; ``order`` gives each vocabulary entry's place, rarest first.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((order, search))

    def run(batches):
        held, rows, entries = [], 0, 0

        def found():
            order, items = shared.value
            ids, known, n, sizes, places, tfs = (np.concatenate(c) for c in zip(*held, strict=True))
            tree = Tree(ids, known, norms(n, documents, terms), sizes, order[places], tfs, len(order))
            out = [(item, *hit) for item, (wanted, weights, k) in enumerate(items) for hit in tree.search(wanted, weights, k)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                names=["item", "doc_id", "score"],
            )

        for batch in batches:
            # documents without any of the terms cannot be found
            batch = batch.filter(pa.compute.greater(pa.compute.list_value_length(column(batch, "terms")), 0))
            if not batch.num_rows:
                continue
            doc_id, lists = column(batch, "doc_id"), column(batch, "terms")
            held.append(
                (
                    doc_id.fill_null(0).to_numpy(zero_copy_only=False),
                    doc_id.is_valid().to_numpy(zero_copy_only=False),
                    column(batch, "n").to_numpy(zero_copy_only=False),
                    pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64),
                    lists.flatten().to_numpy(zero_copy_only=False),
                    column(batch, "tfs").flatten().to_numpy(zero_copy_only=False),
                )
            )
            rows, entries = rows + batch.num_rows, entries + len(held[-1][4])
            if rows >= TREE_ROWS or entries >= TREE_ENTRIES:
                yield found()
                held, rows, entries = [], 0, 0
        if held:
            yield found()

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, words): distinct items with their terms, repeats included."""
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(plain, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().select("item_id", words.alias("words"))


def search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each of a bounded list of items' term lists."""
    vocabulary = sorted({w.encode() for words in items for w in words})
    vectors = stored(restricted(docs, vocabulary))
    totals = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = totals["documents"], totals["terms"] or 0
    df = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[row["t"]] = row["count"]
    order = np.empty(len(vocabulary), np.int64)
    order[np.lexsort((np.arange(len(df)), df))] = np.arange(len(df))
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) for f in df.tolist()]
    place = {t: i for i, t in enumerate(vocabulary)}
    wanted = []
    for words in items:
        own: dict[int, int] = {}
        for w in words:
            i = place[w.encode()]
            own[i] = own.get(i, 0) + weight[i]
        at = sorted((int(order[i]), w) for i, w in own.items() if w > 0)
        wanted.append((np.array([a for a, _ in at], np.int64), np.array([w for _, w in at], np.int64), k))
    return trees(vectors, order, documents, terms, wanted)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, of score above 0.

    Scores are integers: the weight of a term times its saturated count, over the item's terms with
    repeats. Equal scores order by doc_id; documents without id come last. Counts and weights cover all
    documents. Rows that repeat a document are found each. A row that repeats an item counts once; an
    id with several texts has a ranking for each. Items without terms, and null ones, have no rows;
    null and empty texts of documents are never found. Other columns are ignored.

    Items come in blocks of about ``ITEMS`` and ``ITEM_BYTES``, whose terms alone are kept in the tasks;
    every block passes over the documents once. A task holds one tree of bounded size at a time and hands
    on k rows per item and tree.
    """
    small_batches(docs.sparkSession)
    given = stored(item_terms(items).filter(F.size("words") > 0))
    size = given.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.concat_ws(" ", "words"))).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-(size["bytes"] or 0) // ITEM_BYTES))
    order = Window.partitionBy("item_id", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = None
    for block in range(blocks):
        own = given.filter(F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)) == block).collect()
        names = docs.sparkSession.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(own)], "item int, item_id long"
        )
        hits = search_block(docs, [r["words"] for r in own], k).join(names, "item")
        hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        hits = hits.select("item_id", "rank", "doc_id", "score")
        found = hits if found is None else found.unionByName(hits)
    return found
