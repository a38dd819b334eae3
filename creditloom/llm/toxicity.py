"""Toxicity: subword bags, averaged embeddings, a linear softmax, trained in numpy."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.hashing import BYTE_VALUES, U64, Rolling, word_hashes, word_spans

#: Bytes of the character n-grams of a word with its borders.
GRAMS = (3, 4, 5)
BUCKETS = 1 << 19
#: Distinct words that the training reads of a text, by class, or more while all have not over ``WORDS`` (scoring reads all).
CLEAN_WORDS, TOXIC_WORDS, WORDS = 100, 2_000, 350_000
#: Text bytes scored at a time.
SLICE_BYTES = 1 << 20


def _word_bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram buckets of all words, one word after another, and how many each has."""
    marked = [b"<" + w + b">" for w in words]
    lens = np.array([len(w) for w in marked], np.int64)
    data = np.frombuffer(b"".join(marked), dtype=np.uint8)
    ends = np.repeat(np.cumsum(lens), lens)
    rolling = Rolling(BYTE_VALUES[data])
    at, of, grams = np.arange(len(data)), np.repeat(np.arange(len(words)), lens), []
    for n in GRAMS:
        fits = at[at + n <= ends]
        grams.append((of[fits].astype(np.int32), ((rolling.windows(n)[fits] ^ U64(n)) % U64(BUCKETS)).astype(np.int32)))
    whole = rolling.spans(np.cumsum(lens) - lens, np.cumsum(lens)) % U64(BUCKETS) if len(words) else np.zeros(0, U64)
    grams.append((np.arange(len(words), dtype=np.int32), whole.astype(np.int32)))
    word = np.concatenate([g[0] for g in grams])
    bucket = np.concatenate([g[1] for g in grams])
    order = np.argsort(word, kind="stable")
    return bucket[order], np.bincount(word, minlength=len(words))


@dataclass
class Model:
    """``gain`` is each bucket's embedding times the softmax's difference of classes; ``bias`` its offset."""

    gain: np.ndarray
    bias: float

    def margins(self, words: list[bytes]) -> np.ndarray:
        """Log odds of label 1 for each word alone: its subword vectors averaged, times the classes."""
        if not words:
            return np.zeros(0)
        bucket, count = _word_bags(words)
        starts = np.cumsum(count) - count
        return np.add.reduceat(self.gain[bucket], starts) / count + self.bias


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(b".,;:!?|\"'()[]") for w in text.lower().split()]


def _some_words(words: set[bytes], most: int) -> list[bytes]:
    """At most ``most`` distinct words of a training text, drawn by a hash; one empty word if there is none."""
    return sorted(heapq.nsmallest(most, words, key=zlib.crc32) if len(words) > most else words) or [b""]


def fit(texts: list[bytes], labels: list[int], dim: int = 8, steps: int = 120, rate: float = 0.08, seed: int = 7) -> Model:
    """Train embeddings and softmax together on whole labelled texts.

    A text is the bag of its distinct words (a bounded number, see above).  Its class is read from its words weighed by how strongly they speak
    (a softmax over word margins whose sharpness grows from an average to nearly a maximum), so that one word counts
    in a long text as in a short one.  Classes weigh the same.  Adam over all texts at once, with
    one step size for all n-grams, so that those of many texts learn faster than those of few.
    """
    rng = np.random.default_rng(seed)
    room = max(CLEAN_WORDS, WORDS // max(1, len(texts)))
    bags = [_some_words(set(words_of(t)), room if k == 0 else max(room, TOXIC_WORDS)) for t, k in zip(texts, labels)]
    # A word that one text alone has tells nothing about its class that others share.
    seen_in = Counter(w for b in bags for w in b)
    bags = [[w for w in b if seen_in[w] > 1] or b if k == 1 else b for b, k in zip(bags, labels)]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*bags)))} if bags else {}
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        prior = 0.0 if not len(y) else (8.0 if y[0] else -8.0)
        return Model(np.zeros(BUCKETS), prior)
    bucket, count = _word_bags(list(vocabulary))
    seen = np.zeros(BUCKETS, bool)
    seen[bucket] = True
    used = np.flatnonzero(seen)
    slot = (np.cumsum(seen, dtype=np.int32) - 1)[bucket]
    starts = np.cumsum(count) - count
    word_of = np.repeat(np.arange(len(count), dtype=np.int32), count)
    lens = np.array([len(b) for b in bags])
    pair_word = np.array([vocabulary[w] for b in bags for w in b])
    pair_start = np.cumsum(lens) - lens
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    table = rng.normal(0, 0.1, (len(used), dim)).astype(np.float32)
    head = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    params = [table, head, offset]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        sharp = 0.5 + 7.5 * min(1.0, step / (0.7 * steps))
        # Averaging and the head are linear, so the head is applied before the average, and its gradient split after.
        apart = head[:, 1] - head[:, 0]
        margin = np.add.reduceat((table @ apart)[slot], starts) / count + (offset[1] - offset[0])
        mine = margin[pair_word]
        top = np.maximum.reduceat(mine, pair_start)
        attention = np.exp(np.clip(sharp * (mine - np.repeat(top, lens)), -60, 0))
        attention /= np.repeat(np.add.reduceat(attention, pair_start), lens)
        score = np.add.reduceat(attention * mine, pair_start)
        error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y)
        per_word = np.bincount(pair_word, attention * np.repeat(error, lens), minlength=len(count))
        per_bucket = np.bincount(slot, (per_word / count)[word_of], minlength=len(used)).astype(np.float32)  # one number per n-gram
        toward = table.T @ per_bucket
        grads = [
            np.outer(per_bucket, apart) + np.float32(1e-8) * table,
            np.stack([-toward, toward], axis=1) + np.float32(1e-5) * head,
            np.array([-1.0, 1.0], np.float32) * np.float32(error.sum()),
        ]
        for i, (p, g) in enumerate(zip(params, grads)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * np.float32((g * g).sum() / max(1, np.count_nonzero(g)))
            p -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    gain = np.zeros(BUCKETS)
    gain[used] = table @ (head[:, 1] - head[:, 0])
    return Model(gain, float(offset[1] - offset[0]))


def training_rows(docs: DataFrame, labels: DataFrame, held_out, most: int = 1000) -> DataFrame:
    """At most ``most`` toxic and 2.5 times as many other texts, drawn by a hash of the id among rows that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).select(F.col("doc_id").cast("bigint").alias("_id"), "toxic").dropDuplicates(["_id"])
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in ((0, most * 5 // 2), (1, most))]
    chosen = some[0].unionByName(some[1])  # 3.5 * most rows at most
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("bigint") == F.col("_id")).select("_id", F.col("text").cast("binary").alias("text"), "toxic")


def train(docs: DataFrame, labels: DataFrame, held_out, most: int = 1000, sample_bytes: int = 16 << 20) -> Model:
    """Fit on a bounded sample: ``training_rows`` and ``sample_bytes`` in all (longer texts beyond that are left out)."""
    rows = training_rows(docs, labels, held_out, most)
    sized = rows.select("_id", "toxic", F.octet_length("text").alias("n")).collect()  # 3.5 * most small rows
    taken, total = [], 0
    for r in sorted(sized, key=lambda r: (r["n"] or 0, r["_id"])):
        total += r["n"] or 0
        if total <= sample_bytes:
            taken.append(r["_id"])
    chosen = rows.where(F.col("_id").isin(taken)) if len(taken) < len(sized) else rows

    def run(batches):
        got = sorted({(r["_id"], bytes(r["text"] or b""), r["toxic"]) for batch in batches for r in batch.to_pylist()})
        one = {i: (text, label) for i, text, label in reversed(got)}  # of rows that share an id, the least
        model = fit([one[i][0] for i in sorted(one)], [one[i][1] for i in sorted(one)])
        yield pa.RecordBatch.from_arrays([pa.array([model.gain.tobytes()], pa.binary()), pa.array([model.bias])], names=["gain", "bias"])

    # One task fits, as the sample is bounded; the driver only gets the table of gains.
    fitted = chosen.select("_id", "text", "toxic").repartition(1).mapInArrow(run, "gain binary, bias double").collect()
    return Model(np.frombuffer(fitted[0]["gain"]), fitted[0]["bias"]) if fitted else fit([], [])


def _score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """As ``_score_some``, over slices of about ``SLICE_BYTES``."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    parts = [_score_some(model, texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a]
    return np.concatenate(parts) if parts else np.zeros(0)


def _score_some(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text: that of its strongest word."""
    texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    start, end, doc = word_spans(data, offsets)
    best = np.full(len(texts), model.margins([b""])[0])
    if len(start):
        _, first, which = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        margins = model.margins([(words_of(data[a:e].tobytes()) or [b""])[0] for a, e in zip(start[first], end[first])])[which]
        new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        best[doc[new]] = np.maximum.reduceat(margins, new)
    return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def score(docs: DataFrame, model: Model, text: Column) -> Column:
    """The probability of label 1 of a whole text, a column of ``docs``: only texts go through Python.

    Null and empty texts score as an empty word.  A slice's distinct words are scored once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the data

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(_score_texts(shared.value, texts))

    return probability(text.cast("binary"))


def held_out_rows(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows whose text scores below ``threshold``; the model learns from labelled rows that are not held out."""
    model = train(docs, labels, held_out_rows(F.col("doc_id")))
    return docs.where(score(docs, model, F.col("text")) < threshold)
