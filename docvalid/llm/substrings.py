"""Substring deduplication by content-defined chunking.

A gear rolling hash of the last 32 bytes ends a chunk where its top bits are 0, so a
text inserted before a passage moves the passage's chunks but does not change them.
Chunks are compared by a digest of 96 bits: of 3 * 10^12 different chunks two agree with
a chance of 10^-4.  Of a digest's occurrences the first (by doc_id, then place) stays; a
run of later ones that is long enough is removed.

A task sends each of its digests once: later occurrences within the task are known to
be repeats already.  So a chunk that all documents share meets as one row a task.  A row
is four numbers: 64 bits of the digest; 32 more, above the start; the document; 48 bits
of a hash of its text, above the chunk's length and two marks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import plain, table, tidy
from .textarrays import pieces, string_buffers, word_hashes

#: 32 bytes a chunk on average, MOST at most; WINDOW bytes decide on a cut.
CUT_BITS, MOST, WINDOW = 5, 256, 32
#: Runs of repeated chunks from so many bytes up are removed.
LEAST_RUN = 80
#: Chunks that a task sorts at a time, and then sends.
FLUSH = 1_500_000

_GEAR = np.random.default_rng(20240611).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where the chunks of one text begin and end: 0, ..., len(data); never within a character."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    rolling = _GEAR[data]
    step = 1
    while step < WINDOW:  # the sum over the last 2 * step bytes from two over the last step
        rolling[step:] += rolling[:-step] << np.uint32(step)
        step *= 2
    at = np.flatnonzero(rolling[: n - 1] >> np.uint32(32 - CUT_BITS) == 0) + 1
    at = at[(at >= WINDOW) & ((data[at] & 0xC0) != 0x80)]
    at = np.concatenate([[0], at, [n]])
    wide = np.flatnonzero(np.diff(at) > MOST)
    if len(wide):
        more = []
        for k in wide.tolist():
            x = int(at[k])
            while at[k + 1] - x > MOST:
                x += MOST
                while data[x] & 0xC0 == 0x80 and data[x - 1] >= 0x80:
                    x -= 1
                more.append(x)
        at = np.unique(np.concatenate([at, more]))
    return at


#: Of the last number of a row: the bits below the hash, and its marks.
LOW, KNOWN, MORE = 16, 1, 2
#: Rows of a document without an id.
NO_ID = -(2**63)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk [start, end), 64 bits, and 32 that other coefficients give."""
    first = word_hashes(data, starts, ends, lower=False)
    return first.view(np.int64), word_hashes(data ^ np.uint8(0xA5), starts, ends, lower=False) >> np.uint64(32)


def _chunks(flush: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            keys = batch.column(1).to_numpy()
            data, at = string_buffers(batch.column(2))
            for first, last in pieces(at):
                begins, ends, of = [], [], []
                for k in range(first, last):
                    c = cuts(data[at[k] : at[k + 1]]) + at[k]
                    begins.append(c[:-1]), ends.append(c[1:]), of.append(np.full(len(c) - 1, k))
                b, e, d = np.concatenate(begins), np.concatenate(ends), np.concatenate(of)
                if len(b):
                    one, two = digests(data[at[first] : at[last]], b - at[first], e - at[first])
                    place = (two << np.uint64(32) | (b - at[d]).astype(np.uint64)).view(np.int64)
                    parts.append([one, place, ids[d], keys[d] << LOW | (e - b) << 2])
            if sum(len(p[0]) for p in parts) > flush:
                yield from _sent(parts)
                parts = []
        if parts:
            yield from _sent(parts)

    return run


def _starts(place: np.ndarray) -> np.ndarray:
    return place & 0xFFFFFFFF


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _sent(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    one, place, doc, what = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((_starts(place), what >> LOW, doc, place >> 32, one))
    one, place, doc, what = (x[order] for x in (one, place, doc, what))
    once = _changes(one, place, doc, what)  # a row that is repeated is one document
    one, place, doc, what = (x[once] for x in (one, place, doc, what))
    new = _changes(one, place >> 32)
    what[~new] |= KNOWN
    what[:-1][new[:-1] & ~new[1:]] |= MORE
    for a in range(0, len(one), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (one, place, doc, what)], ["digest", "place", "doc", "what"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of (known, digest, doc, key, start): the repeated ones, and whether each is its digest's first."""
    rest = [np.zeros(0, np.int64)] * 4
    last: tuple[int, ...] | None = None  # the last row that is through and not known

    def made(x: list[np.ndarray], whole: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        nonlocal last
        if last is not None:  # it goes before the others again, so that they are told apart from it
            x = [np.concatenate([[v], c]) for v, c in zip(last, x)]
        known = x[3] & KNOWN > 0
        same = ~_changes(x[0], x[1], x[2], x[3] >> LOW) & ~known
        if same.any():  # the same document from another task; that it is repeated there counts still
            heads = np.maximum.accumulate(np.where(~same, np.arange(len(same)), 0))
            np.bitwise_or.at(x[3], heads[same], x[3][same] & MORE)
            x, known = [c[~same] for c in x], known[~same]
        one, place, doc, what = x
        new = _changes(one, place >> 32)
        new |= np.append(False, known[1:] != known[:-1])[: len(new)]
        single = new.copy()
        single[:-1] &= new[1:]
        end = len(one)
        if not whole and end and new[-1] and not known[-1]:  # whether the last is repeated shows in the next batch
            end -= 1
        begin = int(last is not None)
        through = np.arange(len(one)) >= begin
        take = np.flatnonzero((~single | (what & MORE > 0) | known) & through & (np.arange(len(one)) < end))
        first = new & ~known
        if end > begin and not known[end - 1]:
            last = tuple(int(c[end - 1]) for c in x)
        kinds = {"doc": doc[take], "key": what[take] >> LOW, "start": _starts(place[take]).astype(np.int32), "length": (what[take] >> 2 & 0x3FFF).astype(np.int32), "is_first": first[take]}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in kinds.values()], list(kinds)), [c[end:] for c in x]

    for batch in batches:
        x = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns)]
        if len(x[0]):
            out, rest = made(x, False)
            yield out
    if len(rest[0]):
        yield made(rest, True)[0]


def runs(found: list[tuple[int, int, bool]]) -> tuple[list[tuple[int, int]], int]:
    """The spans (start, length) to remove, and the bytes of runs that stand elsewhere too, as first or later."""
    at: dict[int, tuple[int, int, bool]] = {}
    for start, length, is_first in sorted(found):  # two tasks may tell of one chunk
        at[start] = (start, length, is_first or at.get(start, (0, 0, False))[2])
    found = list(at.values())
    spans: list[tuple[int, int]] = []
    shared = 0
    a = 0
    while a < len(found):  # chunks that touch, whether first or later
        b = a + 1
        while b < len(found) and found[b][0] == found[b - 1][0] + found[b - 1][1]:
            b += 1
        total = found[b - 1][0] + found[b - 1][1] - found[a][0]
        if total >= LEAST_RUN:
            shared += total
            k = a
            while k < b:
                if found[k][2]:
                    k += 1
                    continue
                m = k
                while m < b and not found[m][2]:
                    m += 1
                length = found[m - 1][0] + found[m - 1][1] - found[k][0]
                if length >= LEAST_RUN:
                    spans.append((found[k][0], length))
                k = m
        a = b
    return spans, shared


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        texts, spans, shared = [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            cut, bytes_ = runs([(f["start"], f["length"], f["is_first"]) for f in found]) if found else ([], 0)
            if cut:
                data, kept, at = (text or "").encode(), [], 0
                for start, length in cut:
                    kept.append(data[at:start])
                    at = start + length
                text = b"".join([*kept, data[at:]]).decode()
            texts.append(text), shared.append(bytes_)
            spans.append([{"start": s, "length": n} for s, n in cut])
        removed = [sum(s["length"] for s in x) for x in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(shared, pa.int64()), pa.array(spans, kind)], ["doc_id", "text", "n_removed", "n_repeated", "spans"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_removed, n_repeated, spans) for every row of ``docs``.

    text is without the spans (start and length in UTF-8 bytes of the whole text);
    n_removed are their bytes, n_repeated those of all runs of LEAST_RUN bytes and more
    whose chunks stand elsewhere too, be they the first or not.  A null text stays null,
    and an empty one empty.  Rows that agree in id and text are one document; rows
    without an id come first.  A passage that a document itself repeats counts like
    others.  An empty table gives an empty result; other columns are left out.
    """
    docs = plain(docs, doc_id=docs[f"`{id_col}`"].cast("long"), text=docs[f"`{text_col}`"].cast("string"))
    docs = docs.withColumn("key", F.shiftright(F.xxhash64("text"), LOW))
    rows = docs.select("doc_id", "key", "text").where("length(text) > 0")
    rows = rows.mapInArrow(tidy(_chunks(FLUSH)), "digest long, place long, doc long, what long")
    known, more, start = F.col("what").bitwiseAND(KNOWN), F.shiftright("place", 32), F.col("place").bitwiseAND(0xFFFFFFFF)
    to = F.when(known == KNOWN, F.xxhash64("doc", "place")).otherwise(F.xxhash64("digest"))
    rows = rows.repartition(to).sortWithinPartitions(known, "digest", more, "doc", F.shiftright("what", LOW), start)
    found = rows.mapInArrow(tidy(_repeated), "doc long, key long, start int, length int, is_first boolean")
    found = found.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "length", "is_first")).alias("found"))
    named = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID).cast("long")))
    return named.join(found, ["doc", "key"], "left").select("doc_id", "text", "found").mapInArrow(tidy(_removed), "doc_id long, text string, n_removed long, n_repeated long, spans array<struct<start:bigint,length:bigint>>")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
