"""Packing of token pieces into sequences by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveboard.llm.blocks import SPACED, column, mapped, runs, small_batches, text_blocks
from curveboard.llm.store import numbered, stored

#: The split of text before merges, in the possessive form that runs fast; it cuts as the file's own does.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Runs without a change between white space and other bytes from which the slower encoder takes over.
LONG_RUN = 2000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE file, as its own library gives them: special tokens in a text have their ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
        back = byte_symbols()
        vocab = model["model"]["vocab"]
        ranks = {bytes(back[c] for c in p): i for p, i in vocab.items() if p not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.path, self.slow = path, None

    def encode(self, text: str, plain: bool) -> list[int]:
        """``plain`` texts hold no very long run; the others go to the encoder with a heap."""
        if not plain:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        if not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        ids: list[int] = []
        for part in self.cuts.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self.fast.encode_ordinary(part)
        return ids


def tokenised(docs: DataFrame, path: str, width: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``width`` ids per document: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its ids and then ``end``. A longer one is cut into pieces of ``width``, of which
    the first may be shorter. ``path`` is a file that every executor can open.
    """

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path)
            ids_of, text = column(batch, "doc_id").to_pylist(), column(batch, "text")
            for first, last, data, offs in text_blocks(text):
                starts, ends, rows = runs(data, offs, SPACED + 1)
                slow = set(rows[ends - starts > LONG_RUN].tolist())
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for i, s in enumerate(text[first:last].to_pylist()):
                    ids = array("I", encoder.encode(s or "", i not in slow))
                    ids.append(end)
                    n = len(ids)
                    head = n - (n - 1) // width * width
                    for piece, begin in enumerate((0, *range(head, n, width))):
                        part = ids[begin : head if not piece else begin + width]
                        out["doc_id"].append(ids_of[first + i])
                        out["piece"].append(piece)
                        out["start"].append(begin)
                        out["length"].append(len(part))
                        out["ids_crc32"].append(zlib.crc32(part))
                        if with_ids:
                            out["ids"].append(np.asarray(part, np.int32))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = list(out) if with_ids else list(out)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[k], t) for k, t in zip(names, kinds, strict=False)], names=names
                )

    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def fullest(room: int, lengths: list[int], left: list[int]) -> list[int]:
    """Lengths, among those left, whose sum comes closest to ``room`` without passing it.

    Bitset subset-sum: bit s of ``reach`` says that some combination sums to s. Longest lengths
    come first and the search ends as soon as the room is filled exactly.
    """
    reach, steps, goal, mask = 1, [], 1 << room, (1 << (room + 1)) - 1
    for length in reversed(lengths):
        if length > room:
            continue
        for _ in range(min(left[length], room // length)):
            grown = (reach | (reach << length)) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach & goal:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not (before >> total) & 1:
            out.append(length)
            total -= length
    return out


def plan(histogram: dict[int, int], width: int) -> list[tuple[int, int, int, int, int]]:
    """Sequences for all pieces: (length, first rank, ranks, first sequence, offset) per run.

    Minimum bin slack: the longest piece left opens a sequence, and the combination that fills
    the rest best joins it. The same combination is then used as often as the counts allow, so
    the work depends on the number of lengths and not on the number of documents.
    """
    left = [0] * (width + 1)
    for length, n in histogram.items():
        left[length] = n
    used = [0] * (width + 1)
    lengths = sorted(histogram)
    out, sequence = [], 0
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        pattern = [longest, *fullest(width - longest, lengths, left)]
        left[longest] += 1
        need: dict[int, int] = {}
        for length in pattern:
            need[length] = need.get(length, 0) + 1
        times = min(left[length] // n for length, n in need.items())
        offset = 0
        for length in pattern:
            out.append((length, used[length], times, sequence, offset))
            used[length] += times
            left[length] -= times
            offset += length
        sequence += times
        lengths = [x for x in lengths if left[x]]
    return out


def pack(pieces: DataFrame, width: int = 2048, slice_rows: int = 2000) -> DataFrame:
    """Add sequence_id and offset to pieces of (doc_id, piece, length).

    Only the histogram of lengths (at most ``width`` rows) reaches the driver, and only the runs
    of the plan, whose number depends on ``width``, go back. Each piece finds its place by its
    rank among the pieces of its length; equal lengths are interchangeable, so a repeated row
    just takes another rank. ``pieces`` is read twice: pass a stored table.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = sorted(plan(histogram, width))
    keys = np.array([(length << 40) | rank for length, rank, *_ in table], np.int64)
    places = np.array([(rank, sequence, offset) for _, rank, _, sequence, offset in table], np.int64).reshape(-1, 3)
    shared = pieces.sparkSession.sparkContext.broadcast((keys, places))
    slices = 1 + max(histogram.values(), default=0) // slice_rows
    ranked = numbered(pieces, ["length"], ["doc_id", "piece"], "__rank", slices)

    def place(batch):
        keys, places = shared.value
        rank = column(batch, "__rank").to_numpy(zero_copy_only=False).astype(np.int64)
        length = column(batch, "length").to_numpy(zero_copy_only=False).astype(np.int64)
        at = places[np.searchsorted(keys, (length << 40) | rank, "right") - 1]
        kept = [n for n in batch.schema.names if n != "__rank"]
        yield pa.RecordBatch.from_arrays(
            [*(column(batch, n) for n in kept), pa.array(at[:, 1] + rank - at[:, 0]), pa.array(at[:, 2])],
            names=[*kept, "sequence_id", "offset"],
        )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return mapped(ranked.select(*pieces.columns, "__rank"), place, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, width: int = 2048, end: int = 0) -> DataFrame:
    """Tokenise all documents and pack their pieces: one row per piece.

    Null and empty texts are one piece of the end id. The string of a special token in a text becomes
    its id, as the file's library does by default. Documents with equal ids are packed each.
    An empty table gives an empty one. Other columns are ignored.
    """
    return pack(stored(tokenised(docs, path, width, end)), width)


def sequences(docs: DataFrame, path: str, width: int = 2048, end: int = 0) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, at most ``width`` ids each."""
    packed = pack(stored(tokenised(docs, path, width, end, with_ids=True)), width)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
