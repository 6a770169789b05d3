"""Quality classifier: supervised subword embeddings (operator 7).

A document is the average of learned vectors of its hashed words, word pairs and character
n-grams of words; a softmax over two outputs gives the probability of label 1. Vectors and
outputs are trained together by stochastic gradient descent in numpy, on a bounded, class-wise
sample of the labelled rows whose crc32(doc_id as text) mod 5 is not 0; the class priors of all
those rows are put back by a shift of the output. Only the text enters a score.

Scoring needs of each feature only its vector's product with the outputs' difference (a number),
which is the same softmax; so the broadcast model has BUCKETS numbers, whatever the corpus.
A batch's distinct words are hashed once.

Defined results: null text counts as empty; a text without words has the prior as its score;
repeated rows are scored each; labels without document, null labels and documents without label
aren't trained on; without any usable label every score is 0.5; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.textbatches import map_batches, slices
from tomewright.session import materialize

BUCKETS, DIM, EPOCHS, RATE = 1 << 18, 16, 4, 12.0
NGRAMS = (3, 4, 5)
#: Training rows of a class, and bytes of text in all, at most.
CLASS_ROWS, SAMPLE_BYTES = 1500, 48 << 20
#: One bucket for every pair of equal words.
SAME = BUCKETS - 1
THRESHOLD = 0.3


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _bucket(h: np.ndarray) -> np.ndarray:
    """Hashes to buckets, all but SAME."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Features:
    """Features of a batch of texts: of its distinct words, and how texts use them."""

    word: np.ndarray  #: bucket of each feature of the distinct words
    owner: np.ndarray  #: the distinct word it belongs to
    picks: np.ndarray  #: distinct word at each place of the texts
    offsets: np.ndarray  #: places of each text
    pair: np.ndarray  #: bucket of the pair that ends at each place, or -1 at a text's first
    distinct: int

    @classmethod
    def of(cls, texts: pa.Array) -> Features:
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, picks = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        offsets, real = offsets - offsets[0], np.array([bool(w) for w in words], bool)
        keep = real[picks] if len(picks) else np.empty(0, bool)  # splitting leaves empty words at the ends
        offsets, picks = np.r_[0, np.cumsum(keep)][offsets], picks[keep]
        whole = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)
        sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
        points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
        owner, ends = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes)
        buckets, owners = [_bucket(whole)], [np.arange(len(words))]
        h = np.zeros(len(points), np.uint64)
        for n in range(1, max(NGRAMS) + 1):
            if n > len(points):
                break
            h = h[: len(points) - n + 1] * np.uint64(1_000_003) + points[n - 1 :] + np.uint64(n)
            if n in NGRAMS:
                inside = np.flatnonzero(np.arange(len(h)) + n <= ends[: len(h)])
                buckets.append(_bucket(h[inside]))
                owners.append(owner[inside])
        hashed = whole[picks] if len(picks) else np.empty(0, np.uint64)
        pair = np.full(len(picks), -1, np.int64)
        if len(picks) > 1:
            made = _bucket(hashed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[1:])
            pair[1:] = np.where(picks[1:] == picks[:-1], SAME, made)
            firsts = offsets[:-1]
            pair[firsts[firsts < len(pair)]] = -1
        return cls(np.concatenate(buckets), np.concatenate(owners), picks, offsets, pair, len(words))

    def totals(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the sum of its features' weights and their number."""
        per_word = np.bincount(self.owner, weights=weight[self.word], minlength=self.distinct)
        count = np.bincount(self.owner, minlength=self.distinct)
        paired = self.pair >= 0
        value = per_word[self.picks] + np.where(paired, weight[self.pair], 0.0)
        number = count[self.picks] + paired
        return tuple(np.diff(np.r_[0, np.cumsum(x)][self.offsets]) for x in (value, number))

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text, its distinct buckets and their shares."""
        order = np.argsort(self.owner, kind="stable")
        word, starts = self.word[order], np.searchsorted(self.owner[order], np.arange(self.distinct + 1))
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            own, times = np.unique(self.picks[a:b], return_counts=True)
            n = starts[own + 1] - starts[own]
            at = np.arange(n.sum()) + np.repeat(starts[own] - (np.cumsum(n) - n), n)
            pairs = self.pair[a:b][self.pair[a:b] >= 0]
            buckets = np.concatenate([word[at], pairs])
            counts = np.concatenate([np.repeat(times, n), np.ones(len(pairs), np.int64)])
            idx, inverse = np.unique(buckets, return_inverse=True)
            share = np.bincount(inverse, weights=counts)
            yield idx, (share / max(1, counts.sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  #: of each bucket, its vector's product with the outputs' difference
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        value, number = Features.of(texts).totals(self.weight)
        return 1 / (1 + np.exp(-np.clip(value / np.maximum(number, 1) + self.bias, -60, 60)))


def fit(texts: list[str], labels: list[int], prior: float, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
    """Train on a sample; ``prior`` is the share of label 1 among all labelled rows."""
    if not texts or len(set(labels)) < 2:
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    rows = []
    for at in range(0, len(texts), 256):
        rows += list(Features.of(pa.array(texts[at : at + 256], pa.large_string())).rows())
    y, step, steps = np.asarray(labels), 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            idx, share = rows[k]
            if not len(idx):
                continue
            pace = 1 - step / steps
            step += 1
            taken = vectors[idx]
            hidden = share @ taken
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = out @ p
            out -= 0.5 * pace * np.outer(hidden, p)
            bias -= 0.05 * pace * p
            # shares sum to 1 over thousands of features, so their own rate is larger
            vectors[idx] = taken - (rate * pace * np.minimum(share * len(idx), 4.0) / np.sqrt(len(idx)))[:, None] * back
    sampled = np.mean(y)
    shift = np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled)) if 0 < prior < 1 else 0.0
    difference = out[:, 1] - out[:, 0]
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0] + shift))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = CLASS_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents of each class, those of the smallest hashes of doc_id, and on half
    of SAMPLE_BYTES of each class: a text that doesn't fit into what is left of that is passed over (if none of a
    class fits, the beginning of one stands for it). A repeated id counts once, with its least label."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = texts.groupBy("id").agg(F.min(F.octet_length("text")).cast("long").alias("bytes"))
    labelled = usable.groupBy("id").agg(F.min("y").alias("y")).join(sizes, "id").withColumn("h", F.xxhash64("id"))
    labelled, picked = materialize(labelled, "labelled"), []
    for y in (0, 1):
        left, wanted, after = SAMPLE_BYTES // 2, rows, F.lit(True)
        one = labelled.where(F.col("y") == y)
        while wanted:
            # in a round all rows fit alone; what is passed over can't fit later, as less is left then
            some = one.where(after & (F.col("bytes") <= left)).orderBy("h", "id").limit(wanted).collect()
            for r in some:
                if r.bytes <= left:
                    picked.append((r.id, y, r.bytes))
                    left, wanted = left - r.bytes, wanted - 1
            if not some:
                break
            after = (F.col("h") > some[-1].h) | ((F.col("h") == some[-1].h) & (F.col("id") > some[-1].id))
        if wanted == rows:  # all are too long: the beginning of one
            picked += [(r.id, y, r.bytes) for r in one.orderBy("h", "id").limit(1).collect()]
    # at most 2 * rows picked rows, so they may be broadcast; their texts are bounded
    id_type = labelled.schema["id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(picked, f"id {id_type}, y int, bytes long")
    sample = texts.join(F.broadcast(chosen), "id").where(F.octet_length("text") == F.col("bytes"))
    # of different texts of one id and length the least
    sample = sample.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    # a character has four bytes at most
    fitting = F.when(F.octet_length("text") <= SAMPLE_BYTES // 2, F.col("text")).otherwise(F.substring("text", 1, SAMPLE_BYTES // 8))
    found = sample.orderBy(F.xxhash64("id"), "id").select(fitting.alias("text"), "y").toPandas()
    return fit(found.text.tolist(), found.y.tolist(), counts.get(1, 0) / sum(counts.values()))


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) and ``out``: the probability of label 1. Row by row."""
    spark, kept = docs.sparkSession, docs.drop(out) if keep is None else docs.select(*keep)
    shared = spark.sparkContext.broadcast((model.weight, model.bias))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                at = part.schema.get_field_index("__text")
                scores = own.score(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(scores)], names=[*part.schema.names[:at], out])

    scored = docs.select(*[docs[c] for c in kept.columns], F.col(text_col).alias("__text"))
    return map_batches(scored, run, f"{fields}, `{out}` double")


def filter_documents(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    return score_documents(docs, model, text_col=text_col, out="__score").where(F.col("__score") >= threshold).drop("__score")
