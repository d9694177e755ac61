"""Token ids of documents in ORC files that are ordered by document and can be read in parts.

Documents are range-partitioned and sorted by id before they are encoded, so every file holds a range
of ids in order. ORC writes the ids as run-length encoded integers in stripes, with minima and maxima
of every row group and a Bloom filter on the document id. A reader takes stripes side by side, and a
filter on the id skips files, stripes and row groups by these alone.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curveboard.llm.blocks import column, mapped, small_batches, text_blocks
from curveboard.llm.packing import byte_symbols
from curveboard.session import shared_folder

#: Bytes of a text that are split into words at once.
SLICE_BYTES = 1 << 20
#: Words that are remembered from block to block; all are encoded alike.
WORDS = 1 << 19
#: Stands for the end of a word in lower-case text.
END = "A"
#: Words of printable ASCII and of Latin letters that are one character in every form, and their parts.
FAST = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")
PARTS = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[^ -@\[-`{-~]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Options of the files: stripes that several tasks can share, small row groups, a filter on the id.
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
ID_BATCH_BYTES = 4 << 20


class WordEncoder:
    """Ids of a tokenizer that drops white space, word by word.

    The file's pattern and its special tokens never cross white space, so a text has the ids of its
    words in turn. Words between ASCII white space are encoded once and remembered. Words of printable
    ASCII and Latin letters go to the faster of two installed encoders: after lower-casing, no upper-case
    letter is left, so one can stand for the end of a word. All other words go to the file's library.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        end, back = model["model"]["end_of_word_suffix"], byte_symbols()
        ranks = {}
        for piece, i in model["model"]["vocab"].items():
            if piece not in special:
                plain = piece.removesuffix(end) if end else piece
                ranks[bytes(back[c] for c in plain) + (END.encode() if plain != piece else b"")] = i
        self.fast = tiktoken.Encoding("file", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})
        self.space = ranks[f" {END}".encode()]
        self.known: dict[bytes, bytes] = {}

    def slow(self, words: list[bytes]) -> dict[bytes, bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        found = {}
        for i in range(0, len(words), 1000):
            own = words[i : i + 1000]
            coded = self.library.encode_batch([w.decode() for w in own], add_special_tokens=False)
            found.update((w, array("I", c.ids).tobytes()) for w, c in zip(own, coded, strict=True))
        return found

    def coded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word. The fast ones are encoded together: a space with an end parts them again."""
        texts = [w.decode() for w in words]
        plain = [FAST.fullmatch(t) is not None and "<|" not in t for t in texts]
        fast = list(compress(words, plain))
        found = self.slow([w for w, ok in zip(words, plain, strict=True) if not ok])
        if fast:
            parts = PARTS.findall(" ".join(compress(texts, plain)).lower())
            ids = np.array(self.fast.encode_ordinary(END.join([*parts, ""])), np.uint32)
            cuts = np.flatnonzero(ids == self.space)
            data, starts, ends = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            found.update((w, data[x:y]) for w, x, y in zip(fast, starts, ends, strict=True))
        return found

    def learn(self, words: list[list[bytes]]) -> None:
        """Make all words known; what is not needed any more goes first where the table is full."""
        if len(self.known) > WORDS:
            self.known.clear()
        missing = set().union(*words).difference(self.known)
        if missing:
            self.known.update(self.coded(list(missing)))

    def slices(self, text: bytes) -> Iterable[list[bytes]]:
        """Words of the text, some of them at a time."""
        at = 0
        while at < len(text):
            end = at + SLICE_BYTES
            if end < len(text):
                cut = max(text.rfind(white, at, end) for white in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut < 0:
                    # a word longer than a slice: up to the next white space
                    later = [text.find(white, end) for white in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")]
                    cut = min((x for x in later if x >= 0), default=len(text))
                end = max(cut, at) + 1
            yield text[at:end].split()
            at = end

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, 32 bits each."""
        if len(texts) == 1:
            out = []
            for words in self.slices(texts[0]):
                self.learn([words])
                out.append(b"".join(map(self.known.__getitem__, words)))
            return [b"".join(out)]
        words = [text.split() for text in texts]
        self.learn(words)
        return [b"".join(map(self.known.__getitem__, own)) for own in words]


def encoded(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """(doc_id, part, start, n_tokens, ids) of documents, in the order the rows have.

    ``ids`` ends with ``end``; ``start`` counts the ids before the row within its part (task).
    """

    def run(batches):
        part, start, encoder, last_id = TaskContext.get().partitionId(), 0, None, array("I", [end]).tobytes()
        for batch in batches:
            encoder = encoder or WordEncoder(path)
            doc_ids = column(batch, "doc_id")
            for first, last, data, offs in text_blocks(column(batch, "text")):
                raw, edges = data.tobytes(), offs.tolist()
                rows = encoder.encode([raw[a:b] for a, b in zip(edges, edges[1:], strict=False)])
                rows = [ids + last_id for ids in rows]
                lengths = np.array([len(ids) // 4 for ids in rows], np.int64)
                ends = np.cumsum(lengths)
                flat = np.frombuffer(b"".join(rows), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(first, last - first),
                        pa.array(np.full(len(rows), part, np.int32)),
                        pa.array(start + ends - lengths),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(flat)),
                    ],
                    names=["doc_id", "part", "start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = 1) -> None:
    """Encode whole texts with the tokenizer file ``path`` and write them to ``folder`` as ORC.

    Files follow each other in ascending doc_id, rows without id first; rows of one id order by a hash
    of their text and then by the text, so rows of an id given very often are spread over files too.
    Null texts are empty: they hold the end id alone. Repeated rows are written each. An empty table
    gives files without rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    by = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text")
    encoded(ordered, path, end).write.options(**ORC).orc(folder)


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None, low: int | None = None,
                high: int | None = None) -> DataFrame:
    """(doc_id, part, start, n_tokens, ids) from the files; conditions on the id prune stripes and row groups."""
    df = spark.read.schema("doc_id long, part int, start long, n_tokens long, ids array<int>").orc(folder)
    if doc_ids is not None:
        df = df.filter(F.col("doc_id").isin(doc_ids))
    if low is not None:
        df = df.filter(F.col("doc_id") >= low)
    if high is not None:
        df = df.filter(F.col("doc_id") <= high)
    return df


def placed(tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """Tokens with ``start`` counted over all files.

    ``parts`` has part, start and n_tokens of all rows and is reduced to a row per file.
    """
    sizes = parts.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__before"))
    return (
        tokens.join(offsets, "part")
        .withColumn("start", F.col("start") + F.col("__before"))
        .drop("part", "__before")
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by their number and the CRC-32 of their bytes, as read from the files."""

    def run(batch):
        ids = column(batch, "ids")
        data = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        offs = (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist()
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offs, offs[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [*(column(batch, c) for c in ("doc_id", "part", "start")), pa.array(np.diff(offs), pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "start", "n_tokens", "ids_crc32"],
        )

    kept = tokens.select("doc_id", "part", "start", "ids")
    return mapped(kept, run, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end: int = 1) -> str:
    """Write the files to a new folder of the cluster's shared folder and name it."""
    folder = f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}"
    write_tokens(docs, path, folder, end)
    return folder
