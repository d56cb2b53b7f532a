"""Best-fit packing of tokenized documents into sequences, online and in bounded space.

Each partition keeps at most OPEN open sequences, found by a bitset over their free
space: a piece goes where it leaves the least room.  Where none has room and OPEN are
open, the fullest closes first.  Pieces are dealt out and ordered by a hash, so a run
gives the same sequences again, and no partition's work depends on another's.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import plain, quick_partitions, table, tidy, written

SEQUENCE, END, OPEN = 1024, 2, 1024
#: Pieces that a task packs, about; beyond them its open sequences are no loss.
PIECES = 200_000
#: Longer runs of one kind of character are left to the tokenizers library, whose time doesn't depend on them.
RUN = regex.compile(r"\s{2000}|\S{2000}")


class Ids:
    """Token ids of a byte-level BPE file of the tokenizers library.

    tiktoken applies the same pattern and merges three times as fast; it is used
    where the two agree by construction: the file has ranks in the order of its ids,
    and the text holds no added token and no very long run.
    """

    def __init__(self, path: str) -> None:
        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = [t["content"] for t in said["added_tokens"]]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(of[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in self.added}
        merged = [ranks[bytes(of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in said["model"]["merges"]]
        plainly = said["normalizer"] is None and said["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = None
        if plainly and merged == sorted(merged):
            self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self) -> Tokenizer:
        if self._slow is None:
            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def of(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added) or (len(text) >= 2000 and RUN.search(text)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def _pieces(tokenizer: str, sequence: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(public_tokenizers.path(tokenizer))
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.append(ids.of(text.as_py() or ""), np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(tokens) % sequence or sequence, len(tokens), sequence), len(tokens)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(tokens[a:b].tobytes()))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class OpenSequences:
    """place(length) -> (number of a sequence, offset there)."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.free = 0  # bit f is set where an open sequence has f free places
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = self.opened = 0

    def _take(self, f: int) -> int:
        number = self.by_free[f].pop()
        if not self.by_free[f]:
            self.free &= ~(1 << f)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            f = length + ((fits & -fits).bit_length() - 1)
            number = self._take(f)
        else:
            if self.count >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            f, number = self.size, self.opened
            self.opened += 1
        if f > length:
            self.by_free[f - length].append(number)
            self.free |= 1 << (f - length)
            self.count += 1
        return number, self.size - f


def _packed(sequence: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        places = OpenSequences(sequence, most)
        for batch in batches:
            found = [places.place(n) for n in batch.column(3).to_pylist()]
            numbers = np.array([n for n, _ in found], np.int64) + first
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers), pa.array([o for _, o in found], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", sequence: int = SEQUENCE, end: int = END, most: int = OPEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    A document is its token ids and ``end``; only one longer than ``sequence`` is cut,
    into pieces of that length of which the first may be shorter.  A null or empty
    text is ``end`` alone.  Rows without an id and repeated rows are packed each.  An
    empty table gives an empty result; other columns are left out.
    """
    docs = plain(docs, doc_id=docs[f"`{id_col}`"].cast("long"), text=docs[f"`{text_col}`"].cast("string"))
    pieces = written(docs.mapInArrow(tidy(_pieces(tokenizer, sequence, end)), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    mark = F.xxhash64("doc_id", "piece", "ids_crc32")
    tasks = quick_partitions(docs.sparkSession, pieces.count(), PIECES)
    dealt = pieces.withColumn("mark", mark).repartition(tasks, "mark").sortWithinPartitions("mark", "doc_id", "piece", "start", "ids_crc32").drop("mark")
    return dealt.mapInArrow(tidy(_packed(sequence, most)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
