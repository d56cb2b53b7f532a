"""Toxicity by a factorization machine over hashed terms.

A term is a word (lower case in A-Z, without punctuation at its ends) or the first
4, 5 or 6 bytes of a longer one, hashed to 20 bits.  The machine's inputs are terms,
where a document has them, however often: those whose shares among toxic and other
training documents differ clearly, with their log ratio as value, and those of pairs,
as an insult with the mention of a group, that tell what the former do not, with 1.
Pairs are looked for among the PAIRED terms that vary most: what a machine of the clear
terms leaves unexplained in the documents that have both, as a squared deviation in
units of its variance, is by PAIR more than in those that have either.  The machine is

    bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

so that a pair of terms can weigh more or less than both alone.  It is fitted on the
driver from at most TRAINING labelled documents; every document is scored from its
whole text, on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import give_back, plain, table, tidy, written
from .textarrays import pieces, string_buffers, word_hashes, words

BITS = 20
PREFIXES = (4, 5, 6)
#: Labelled documents that the machine is fitted on, and bytes of their texts, at most; which ones, a hash of the id decides.
TRAINING, TRAINING_BYTES = 16_000, 64 << 20
#: Inputs, factors, and how clearly a term must differ (twice its log-likelihood ratio) in how many documents.
INPUTS, FACTORS, CLEAR, LEAST_DOCUMENTS = 1024, 8, 18.0, 4
EPOCHS, BATCH, RATE, DECAY = 25, 256, 0.02, 1e-4
#: Terms among which pairs are looked for, twice the gain in log-likelihood that makes one clear, and the epochs where there are any.
PAIRED, PAIR, PAIR_EPOCHS = 2048, 40.0, 120
#: Of the PAIRED terms and of the documents, how many are held against all others at once; the result is the same for any.
PAIR_TERMS, PAIR_DOCUMENTS = 256, 500

#: ASCII marks, which a word's ends lose.
_EDGE = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])


def document_terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of texts that lie end to end, once for each occurrence."""
    starts, ends, of = words(data, at)
    if len(starts):
        # the next byte that is no mark, and the last one before
        places = np.flatnonzero(~_EDGE[data])
        first, last = np.searchsorted(places, starts), np.searchsorted(places, ends) - 1
        inside = first <= last
        starts = np.where(inside, places[np.minimum(first, len(places) - 1)] if len(places) else starts, ends)
        ends = np.where(inside, places[np.maximum(last, 0)] + 1 if len(places) else ends, ends)
    real = ends > starts
    starts, ends, of = starts[real], ends[real], of[real]
    documents, terms = [of], [word_hashes(data, starts, ends) >> np.uint64(64 - BITS)]
    for k in PREFIXES:
        longer = ends - starts > k
        begins = starts[longer]
        documents.append(of[longer])
        terms.append((word_hashes(data, begins, begins + k) * np.uint64(2 * k + 1)) >> np.uint64(64 - BITS))
    return np.concatenate(documents), np.concatenate(terms).astype(np.int64)


@dataclass
class Machine:
    place: np.ndarray  #: of each of the 2^BITS terms among the inputs, or -1
    value: np.ndarray  #: of each input
    weight: np.ndarray
    factors: np.ndarray
    bias: float

    def raw(self, documents: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """The machine's value for each of n documents, given their terms in any order and number."""
        out = np.full(n, self.bias)
        if len(self.value):
            inputs = self.place[terms].astype(np.int64)
            held = inputs >= 0
            pairs = np.unique(documents[held] * len(self.value) + inputs[held])
            d, i = pairs // len(self.value), pairs % len(self.value)
            x = self.value[i]
            out += np.bincount(d, self.weight[i] * x, n)
            for f in range(self.factors.shape[1]):
                vx = self.factors[i, f] * x
                out += (np.bincount(d, vx, n) ** 2 - np.bincount(d, vx * vx, n)) / 2
        return out

    def of(self, terms: list[np.ndarray]) -> np.ndarray:
        """Scores of documents given as their distinct terms."""
        out = np.zeros(len(terms))
        for first in range(0, len(terms), 500):
            some = terms[first : first + 500]
            documents = np.repeat(np.arange(len(some)), [len(t) for t in some])
            out[first : first + 500] = self.raw(documents, np.concatenate([*some, np.zeros(0, np.int32)]), len(some))
        return sigmoid(out)

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, at = string_buffers(texts)
        out = np.full(len(at) - 1, self.bias)
        for first, last in pieces(at) if len(self.value) else ():
            low, high = at[first], at[last]
            documents, terms = document_terms(data[low:high], at[first : last + 1] - low)
            out[first:last] = self.raw(documents, terms, last - first)
        return sigmoid(out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def clearness(seen: np.ndarray, total: np.ndarray, positive: int, n: int) -> np.ndarray:
    """Twice the log-likelihood ratio of having something (total documents, of which seen are toxic) and being toxic (positive of n)."""
    out = np.zeros(np.shape(total))
    for count, rows, columns in ((seen, total, positive), (total - seen, total, n - positive), (positive - seen, n - total, positive), (n - positive - total + seen, n - total, n - positive)):
        expected = np.maximum(rows * (columns / n), 1e-9)
        out += 2 * np.where(count > 0, count * np.log(np.maximum(count, 1) / expected), 0)
    return out


def clear_pairs(terms: list[np.ndarray], labels: np.ndarray, expected: np.ndarray, among: np.ndarray) -> list[tuple[float, int, int]]:
    """(gain, term, term) of the pairs of terms in among that tell what the expected labels leave open, the clearest first."""
    n, m = len(labels), len(among)
    place = np.full(1 << BITS, -1, np.int32)
    place[among] = np.arange(m)
    rest, spread = labels - expected, np.maximum(expected * (1 - expected), 0.01)
    alone, varies = np.zeros(m), np.zeros(m)
    for t, r, v in zip(terms, rest, spread):
        found = place[t]
        found = found[found >= 0]
        alone[found] += r
        varies[found] += v
    alone, out = alone**2 / np.maximum(varies, 1e-9), []
    for low in range(0, m, PAIR_TERMS):  # against themselves and the terms after them
        high = min(low + PAIR_TERMS, m)
        left, variance = (np.zeros((high - low, m - low), np.float32) for _ in range(2))
        for first in range(0, n, PAIR_DOCUMENTS):
            some = slice(first, min(first + PAIR_DOCUMENTS, n))
            x = np.zeros((some.stop - first, m - low), np.float32)
            for row, t in enumerate(terms[some]):
                found = place[t] - low
                x[row, found[found >= 0]] = 1
            rows = x[:, : high - low]
            left += (rows * rest[some, None].astype(np.float32)).T @ x
            variance += (rows * spread[some, None].astype(np.float32)).T @ x
        for k, i in enumerate(range(low, high)):
            gain = left[k, k + 1 :] ** 2 / np.maximum(variance[k, k + 1 :], np.float32(1e-9)) - np.maximum(alone[i], alone[i + 1 :])
            out += [(float(gain[j]), int(among[i]), int(among[i + 1 + j])) for j in np.flatnonzero((gain >= PAIR) & (np.abs(left[k, k + 1 :]) >= LEAST_DOCUMENTS))]
    return sorted(out, key=lambda p: (-p[0], p[1:]))


@dataclass
class Chosen:
    inputs: np.ndarray  #: terms that differ clearly, the clearest first
    value: np.ndarray  #: of each input
    among: np.ndarray  #: terms among which pairs are looked for


def choose(terms: list[np.ndarray], labels: np.ndarray) -> Chosen:
    """The terms that a machine of these documents can need."""
    n, positive = len(labels), int(labels.sum())
    if not 0 < positive < n:
        return Chosen(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    with_, both = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for t, y in zip(terms, labels):
        both[t] += 1
        if y:
            with_[t] += 1
    often = np.flatnonzero(both >= LEAST_DOCUMENTS)
    seen, total = with_[often].astype(np.float64), both[often].astype(np.float64)
    ratio = np.log((seen + 0.5) / (positive + 1)) - np.log((total - seen + 0.5) / (n - positive + 1))
    clear = clearness(seen, total, positive, n)
    clear[np.abs(ratio) < 1] = 0
    best = np.argsort(-clear, kind="stable")[:INPUTS]
    best = best[clear[best] >= CLEAR]
    varying = total * (n - total)
    most = np.argsort(-varying, kind="stable")[:PAIRED]
    return Chosen(often[best], ratio[best], often[most[varying[most] > 0]])


def narrowed(terms: list[np.ndarray], chosen: Chosen) -> list[np.ndarray]:
    """Copies of the documents' terms, without those that were not chosen."""
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen.inputs] = wanted[chosen.among] = True
    return [t[wanted[t]] for t in terms]


def fit(terms: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """The machine of documents given as their distinct terms, by Adam on the logistic loss."""
    chosen = choose(terms, labels)
    return learn(narrowed(terms, chosen), labels, chosen, seed)


def learn(terms: list[np.ndarray], labels: np.ndarray, chosen: Chosen, seed: int = 7) -> Machine:
    """fit of documents given as those of their terms that were chosen."""
    n, positive, inputs = len(labels), int(labels.sum()), chosen.inputs
    if not 0 < positive < n:
        rate = np.clip((positive + 0.5) / (n + 1), 1e-3, 1 - 1e-3)
        return Machine(np.full(1 << BITS, -1, np.int32), np.zeros(0), np.zeros(0), np.zeros((0, FACTORS)), float(np.log(rate / (1 - rate))))
    machine = _fitted(terms, labels, inputs, chosen.value, np.full(len(inputs), 0.01), EPOCHS, seed)
    paired: dict[int, None] = {}
    for _, i, j in clear_pairs(terms, labels, machine.of(terms), chosen.among):
        if len(paired) + 2 <= INPUTS:
            paired |= {i: None, j: None}
    if not paired:
        return machine
    more = np.array([t for t in paired if machine.place[t] < 0], np.int64)
    spread = np.full(len(inputs) + len(more), 0.1)
    spread[[k for k, t in enumerate(inputs.tolist()) if t not in paired]] = 0.01
    return _fitted(terms, labels, np.concatenate([inputs, more]), np.concatenate([chosen.value, np.ones(len(more))]), spread, PAIR_EPOCHS, seed)


def _fitted(terms: list[np.ndarray], labels: np.ndarray, inputs: np.ndarray, value: np.ndarray, spread: np.ndarray, epochs: int, seed: int) -> Machine:
    n, place, rng = len(labels), np.full(1 << BITS, -1, np.int32), np.random.default_rng(seed)
    place[inputs] = np.arange(len(inputs))
    rate = np.clip((labels.sum() + 0.5) / (n + 1), 1e-3, 1 - 1e-3)
    state = [np.array([np.log(rate / (1 - rate))]), np.where(value == 1, 0.0, 0.5), rng.normal(0, 1, (len(inputs), FACTORS)) * spread[:, None]]
    if not len(inputs):
        return Machine(place, value, state[1], state[2], float(state[0][0]))
    has, worth = np.zeros((n, len(inputs)), bool), value.astype(np.float32)
    for row, t in enumerate(terms):
        found = place[t]
        has[row, found[found >= 0]] = True
    first, second, step = [np.zeros_like(s) for s in state], [np.zeros_like(s) for s in state], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            rows = order[a : a + BATCH]
            xb = (has[rows] * worth).astype(np.float64)
            bias, weight, factors = state
            xv = xb @ factors
            raw = bias[0] + xb @ weight + 0.5 * ((xv**2).sum(1) - (xb**2) @ (factors**2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            xe = xb * error[:, None]
            grads = [np.array([error.sum()]), xe.sum(0) + DECAY * weight, xe.T @ xv - factors * ((xb * xe).sum(0))[:, None] + DECAY * factors]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                state[k] = state[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(place, value, state[1], state[2], float(state[0][0]))


def _training_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = string_buffers(batch.column(0))
        for first, last in pieces(at):
            low, high = at[first], at[last]
            documents, terms = document_terms(data[low:high], at[first : last + 1] - low)
            pairs = np.unique(documents * (1 << BITS) + terms)
            cuts = np.searchsorted(pairs, np.arange(last - first + 1) << BITS)
            values = pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(first, last - first)], ["terms", "toxic"])


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id's text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fits on labelled rows that are not held out, at most TRAINING of them and TRAINING_BYTES of text, by a hash of their ids."""
    chosen = plain(labels, id=labels[f"`{id_col}`"].cast("long"), toxic=labels[f"`{label_col}`"].cast("int"))
    chosen = chosen.where(~held_out(F.col("id"))).where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(TRAINING)
    texts = plain(docs, doc_id=docs[f"`{id_col}`"].cast("long"), text=docs[f"`{text_col}`"].cast("string"))
    # one text an id, however many rows have it: that of the least hash
    text = F.coalesce("text", F.lit(""))
    found = texts.join(F.broadcast(chosen), texts.doc_id == chosen.id).select("id", "toxic", F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("of"))
    found = written(found.groupBy("id").agg(F.min("of")["text"].alias("text"), F.first("toxic").alias("toxic")), "training")
    so_far = Window.orderBy(F.xxhash64("id"), "id")  # of TRAINING rows at most
    within = found.select("id", F.sum(F.octet_length("text")).over(so_far).alias("bytes")).where(F.col("bytes") <= TRAINING_BYTES).select("id")
    rows = found.join(F.broadcast(within), "id").select("text", "toxic").mapInArrow(tidy(_training_terms), "terms array<int>, toxic int").toArrow()
    terms, toxic = _in_order(rows)
    del rows
    chosen = choose(terms, toxic)
    terms = narrowed(terms, chosen)  # the others, most of what was sent, go before the machine is fitted
    give_back()
    machine = learn(terms, toxic, chosen)
    del terms
    give_back()
    return machine


def _in_order(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms, which stay where they are, and labels of documents; tasks end in any order."""
    alike: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in rows.to_batches():
        lists, toxic = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for k, y in enumerate(toxic.tolist()):
            alike.setdefault((y, int(cuts[k + 1] - cuts[k])), []).append(values[cuts[k] : cuts[k + 1]])
    terms, labels = [], []
    for key in sorted(alike):
        terms += sorted(alike[key], key=lambda t: t.tobytes())
        labels += [key[0]] * len(alike[key])
    return terms, np.array(labels, np.float64)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of ``docs``; a null or empty text gets the machine's bias."""
    docs = plain(docs, doc_id=docs[f"`{id_col}`"].cast("long"), text=docs[f"`{text_col}`"].cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], ["doc_id", "score"])

    return docs.mapInArrow(tidy(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    score is from 0 to 1; predicted is 1 from 0.5 up.  Labels train the machine where
    they are 0 or 1 and not held out; a document with several labels is toxic if one
    says so.  Without labels of both kinds every score is the labels' (smoothed) rate,
    0.5 for none at all.  Rows with equal texts get equal scores, rows without an id
    are scored and not held out.  An empty table gives an empty result; other columns
    are left out.
    """
    scored = score(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
