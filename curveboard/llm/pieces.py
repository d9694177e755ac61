"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and its decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveboard.llm.blocks import U, column, mapped, mix, powers, text_blocks, uniform

#: Bytes of text whose words share one lattice.
BLOCK = 3 << 19
#: Slots of the table that tells which substrings can be pieces at all.
SIEVE_BITS = 20
SPACE = 32
MARK = "▁"


class Pieces:
    """Vocabulary as byte strings, where the word mark is a plain space.

    A BPE file scores pieces by merge rank, so the log weight of a piece is that of a Zipf law
    over ranks, times ``alpha``; a byte of a character without a piece has the weight of the last
    rank.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        self.bytes: list[bytes] = [b""] * n
        plain: dict[bytes, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.bytes[i] = piece.replace(MARK, " ").encode()
                plain.setdefault(self.bytes[i], i)
        self.width = max(map(len, plain))
        first = min(plain.values())
        self.byte_weight = -alpha * np.log(n + 2.0)
        data = np.frombuffer(b"".join(plain), np.uint8)
        lengths = np.array([len(p) for p in plain])
        ends = np.cumsum(lengths)
        self.hashes = substring_hashes(data, ends - lengths, lengths)
        order = np.argsort(self.hashes)
        self.hashes = self.hashes[order]
        self.ids = np.array(list(plain.values()))[order]
        self.weights = -alpha * np.log(self.ids - first + 3.0)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.hashes >> U(64 - SIEVE_BITS)).astype(np.int64)] = True
        size = np.array([len(b) for b in self.bytes])
        self.offsets = np.concatenate(([0], np.cumsum(size)))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and where those stand in the table."""
        maybe = np.flatnonzero(self.sieve[(hashes >> U(64 - SIEVE_BITS)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == hashes[maybe]
        return maybe[hit], at[hit]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all pieces in turn."""
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        return self.flat[spread(self.offsets[ids], lengths)]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range, in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def substring_hashes(data: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[starts + lengths] - total[starts]) * down[starts])


class Lattice:
    """Sampling tables for distinct words: edges by end node, with cumulative probabilities.

    A word of n bytes has nodes 0..n. ``cdf`` holds, for the edges into node d, values in
    (d, d + 1], so one sorted search finds the edge of a node and a uniform draw.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: Pieces):
        words = len(starts)
        own = np.arange(words)
        word = np.repeat(own, lengths)
        # byte p of the block stands between nodes p + word and p + word + 1
        self.base = starts + own
        self.lengths = lengths
        inner = np.arange(len(data)) - np.repeat(starts, lengths)
        room = np.repeat(lengths, lengths) - inner
        up, down = powers(len(data) + 1)
        total = np.empty(len(data) + 1, U)
        total[0] = 0
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
        lead = (data & 0xC0) != 0x80
        size = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        covered = np.zeros(len(data), bool)
        begin, end, ids, weight = [], [], [], []
        starts_here = np.flatnonzero(lead)
        for n in range(1, min(pieces.width, int(lengths.max(initial=0))) + 1):
            starts_here = starts_here[room[starts_here] >= n]
            if not len(starts_here):
                break
            hit, at = pieces.find(mix((total[starts_here + n] - total[starts_here]) * down[starts_here]))
            p = starts_here[hit]
            begin.append(p)
            end.append(p + n)
            ids.append(pieces.ids[at])
            weight.append(pieces.weights[at])
            for k in range(n if n <= 4 else 0):
                covered[p[size[p] == n] + k] = True
        bare = np.flatnonzero(~covered)
        begin.append(bare)
        end.append(bare + 1)
        ids.append(pieces.byte_id[data[bare]])
        weight.append(np.full(len(bare), pieces.byte_weight))
        begin, end, ids, weight = map(np.concatenate, (begin, end, ids, weight))
        # edges by target: the parts are sorted already, so a merging sort is quick
        order = np.argsort(end, kind="stable")
        begin, end, self.ids, weight = begin[order], end[order], ids[order], weight[order]
        shift = word[begin]
        self.source, target = begin + shift, end + shift
        longest = int(lengths.max(initial=0))
        step = end - starts[shift]
        step = step.astype(np.int16) if longest < 1 << 15 else step
        # words advance together, one end position at a time
        by_step = np.argsort(step, kind="stable")
        ordered = target[by_step]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, bool)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(step, minlength=longest + 1)[1:])))
        alpha = np.full(len(data) + words, -np.inf)
        alpha[self.base] = 0.0
        weight_of, source_of = weight[by_step], self.source[by_step]
        share = np.empty(len(weight))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            p = np.exp(alpha[source_of[a:b]] + weight_of[a:b])
            heads = np.flatnonzero(fresh[a:b])
            mass = np.add.reduceat(p, heads)
            if mass.min() < 1e-280:
                # a long word: repeat this step with the largest term taken out
                value = alpha[source_of[a:b]] + weight_of[a:b]
                top = np.maximum.reduceat(value, heads)
                top = np.where(np.isfinite(top), top, 0.0)
                p = np.exp(value - np.repeat(top, np.diff(np.append(heads, b - a))))
                mass = np.add.reduceat(p, heads)
            else:
                top = 0.0
            with np.errstate(divide="ignore"):
                alpha[ordered[a:b][heads]] = top + np.log(mass)
            share[a:b] = p / np.repeat(np.where(mass > 0, mass, 1.0), np.diff(np.append(heads, b - a)))
        placed = np.empty(len(share))
        placed[by_step] = share
        heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else target
        counts = np.diff(np.append(heads, len(target)))
        run = np.cumsum(placed)
        run -= np.repeat(run[heads] - placed[heads], counts)
        run[np.append(heads[1:], len(target)) - 1] = 1.0
        self.share = placed
        self.cdf = target + np.minimum(run, 1.0)

    def sample(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of each occurrence of a word: ids in turn, number per occurrence, log probability.

        Occurrences of one word are drawn together, which keeps the search local.
        """
        node, stop = self.base[words] + self.lengths[words], self.base[words]
        active = np.argsort(words, kind="stable")
        picks, owners, n = [], [], np.zeros(len(words), np.int64)
        score = np.zeros(len(words))
        step = 0
        while len(active):
            u = uniform(keys[active] + np.full(1, step, U) * U(0xD1342543DE82EF95))
            edge = np.searchsorted(self.cdf, node[active] + u, "left")
            picks.append(self.ids[edge])
            owners.append(active)
            n[active] += 1
            score[active] += np.log(self.share[edge])
            node[active] = self.source[edge]
            active = active[node[active] != stop[active]]
            step += 1
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (pick, owner) in enumerate(zip(picks, owners, strict=True)):
            out[ends[owner] - 1 - k] = pick
        return out, n, score


def segmented(data: np.ndarray, offs: np.ndarray, row_keys: np.ndarray, pieces: Pieces):
    """Sampled ids of rows whose bytes already start with the dummy space.

    Returns ids, ids per row, log probability per row. A word is a run of spaces and what follows
    up to the next space; no piece crosses its border, so the words' draws are independent and
    the result is an exact draw from the lattice of the whole text.
    """
    rows = len(offs) - 1
    if not len(data):
        return np.empty(0, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
    space = data == SPACE
    head = space.copy()
    head[1:] &= ~space[:-1]
    first = offs[:-1][np.diff(offs) > 0]
    head[first] = True
    starts = np.flatnonzero(head)
    lengths = np.diff(np.append(starts, len(data)))
    row = np.searchsorted(offs, starts, "right") - 1
    hashes = substring_hashes(data, starts, lengths)
    _, sample, word = np.unique(hashes, return_index=True, return_inverse=True)
    own = lengths[sample]
    ends = np.cumsum(own)
    lattice = Lattice(data[spread(starts[sample], own)], ends - own, own, pieces)
    place = np.arange(len(starts)) - np.searchsorted(row, np.arange(rows))[row]
    keys = mix(row_keys[row] + (place.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    ids, n, score = lattice.sample(word, keys)
    per_row = np.bincount(row, weights=n, minlength=rows).astype(np.int64)
    return ids, per_row, np.bincount(row, weights=score, minlength=rows)


def prefixed(array: pa.Array) -> pa.Array:
    """Texts with the dummy space in front; empty and null ones stay empty."""
    text = array.fill_null("") if array.null_count else array
    spaced = pc.binary_join_element_wise(pa.scalar("", text.type), text, pa.scalar(" ", text.type))
    return pc.if_else(pc.equal(pc.binary_length(text), 0), text, spaced)


def encoded(docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 11) -> DataFrame:
    """Sampled pieces of every whole text: doc_id, n_pieces, ids, log_prob, lossless.

    The draw depends on the seed, doc_id and the word's place alone, so any partitioning and any
    rerun give the same ids. ``alpha`` sharpens (above 1) or flattens the distribution over
    segmentations. A null text has null ids and 0 pieces, an empty one no ids; rows of the same
    id and text get the same draw, a null id draws as id -1. An empty table gives an empty one; a text
    of any length is cut into words, whose lattices are handled in blocks. A literal word mark in a text is
    spelled by byte pieces, so it is not mistaken for a space. ``lossless`` says that decoding
    gives the text back. Other columns are ignored.
    """

    known: dict[str, Pieces] = {}  # read once in each task, as the function travels without it

    def run(batch):
        pieces = known.get(path) or known.setdefault(path, Pieces(path, alpha))
        source = column(batch, "text")
        text = prefixed(source)
        doc = column(batch, "doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = mix(doc.astype(U) + mix(np.array([seed], U)))
        for first, last, data, offs in text_blocks(text, BLOCK):
            ids, n, score = segmented(data, offs, keys[first:last], pieces)
            size = pieces.offsets[ids + 1] - pieces.offsets[ids]
            id_ends = np.concatenate(([0], np.cumsum(n)))
            back = np.concatenate(([0], np.cumsum(size)))[id_ends]
            same = np.diff(back) == np.diff(offs)
            if same.all():
                wrong = np.concatenate(([0], np.cumsum(pieces.decode(ids) != data)))
                same = wrong[offs[1:]] == wrong[offs[:-1]]
            lists = pa.ListArray.from_arrays(pa.array(id_ends, pa.int32()), pa.array(ids, pa.int32()))
            if source.null_count:
                lists = pc.if_else(source[first:last].is_valid(), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id")[first:last], pa.array(n, pa.int32()), lists, pa.array(score), pa.array(same)],
                names=["doc_id", "n_pieces", "ids", "log_prob", "lossless"],
            )

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    return mapped(plain, run, "doc_id long, n_pieces int, ids array<int>, log_prob double, lossless boolean")


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the exact bytes that were encoded. Null ids give null."""

    known: dict[str, Pieces] = {}

    def run(batch):
        pieces = known.get(path) or known.setdefault(path, Pieces(path, 1.0))
        texts = []
        for ids in column(batch, "ids").to_pylist():
            if ids is None:
                texts.append(None)
            else:
                joined = b"".join(pieces.bytes[i] for i in ids)
                texts.append((joined[1:] if joined[:1] == b" " else joined).decode())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return mapped(encodings.select("doc_id", "ids"), run, "doc_id long, text string")
