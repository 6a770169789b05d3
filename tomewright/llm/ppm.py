"""Language-model scoring by prediction by partial matching (operator 10).

A trie of byte contexts up to ORDER bytes is counted over all training texts, the end of a text
being a symbol too (byte 0xFF, which no text holds; it also fills the context before a text).
A byte is coded in the longest context that was seen; where it wasn't seen there, an escape is
coded (method C: as likely as the context's distinct symbols) and the next shorter context is
tried with all symbols of the longer one excluded; below order 0 all bytes left are alike.
Sets of symbols are nested along a context's suffixes, so what an escape excludes depends on
the context escaped from alone, and the code length of any byte is a sum of stored numbers.

(ORDER+1)-grams of all texts are counted, added up within tasks before they are dealt. All nodes
of the trie are kept, however many: grams are dealt by the last bytes of their contexts, so that
a bucket has all nodes that its grams' code lengths need, but for the shortest ones, which are
shared; so each gram that occurs gets its code length once, into a table. Neither this table nor
words' counts are bounded: the HOT_GRAMS and HOT_WORDS most frequent are broadcast, the others joined.
Words are named by 64-bit hashes.

Defined results: null text counts as empty (its end is still coded); rows with null doc_id are
scored and learnt from like others; repeated rows are learnt and scored each; with no training
rows bytes are alike, and the word model's numbers follow from its formula; an empty table
gives no rows; other columns are ignored."""

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

ORDER, HOT_GRAMS, HOT_WORDS = 5, 1_000_000, 300_000
END = 0xFF
#: Bytes of text that a task takes at once, and symbols that it scores at once.
SLICE, AT_ONCE = 2 << 20, 1 << 18
#: Grams of a bucket on average, and of the contexts with an ending before they are dealt by longer endings.
BUCKET, CROWDED = 1 << 18, 1 << 17


def grams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol of the lower-cased texts and their ends, the bytes of it and of the ``order``
    before as a number (last byte lowest); and len(texts)+1 offsets."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(sizes + order + 1) - (sizes + order + 1)
    raw = np.full(int((sizes + order + 1).sum()), END, np.uint8)
    # the texts' bytes, without gaps, to places after each text's padding
    lowered = pc.ascii_lower(texts.cast(pa.large_string()))
    cuts = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + len(texts) + 1]
    body = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]] if len(texts) else raw[:0]
    first = np.cumsum(sizes) - sizes
    raw[np.arange(len(body)) + np.repeat(start + order - first, sizes)] = body
    key = np.zeros(max(0, len(raw) - order), np.uint64)
    for k in range(order + 1):
        key = (key << np.uint64(8)) | raw[k : len(raw) - order + k]
    offsets = np.r_[0, np.cumsum(sizes + 1)]
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes + 1)
    return key[at], offsets


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct lower-cased words, the distinct word at each place, and offsets."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    distinct, picks = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    keep = np.array([bool(x) for x in distinct], bool)[picks] if distinct else np.empty(0, bool)
    hashes = pd.util.hash_array(np.array(distinct, dtype=object), categorize=False) if distinct else np.empty(0, np.uint64)
    return hashes, picks[keep], np.r_[0, np.cumsum(keep)][offsets - offsets[0]]


WORD, GRAM = 0, 1


def count(docs: DataFrame, train: Column, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(kind, key, n, every) of all texts' words and grams: their counts in training texts, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                texts, learnt = part.column(0), np.asarray(part.column(1).to_numpy(zero_copy_only=False), bool)
                hashes, picks, cuts = words(texts)
                key, offsets = grams(texts, order)
                # a gram once for training texts and once for others, next to each other
                both, times = np.unique((key << np.uint64(1)) | np.repeat(learnt, np.diff(offsets)), return_counts=True)
                first = np.flatnonzero(np.r_[True, (both[1:] >> np.uint64(1)) != (both[:-1] >> np.uint64(1))][: len(both)])
                keys = both[first] >> np.uint64(1)
                n, every = np.add.reduceat(times * (both & np.uint64(1)).astype(np.int64), first), np.add.reduceat(times, first)
                found = np.bincount(picks[np.repeat(learnt, np.diff(cuts))], minlength=len(hashes))
                seen = found > 0
                columns = [
                    np.concatenate([np.full(seen.sum(), WORD, np.int32), np.full(len(keys), GRAM, np.int32)]),
                    np.concatenate([hashes[seen].view(np.int64), keys.view(np.int64)]),
                    np.concatenate([found[seen], n]).astype(np.int64),
                    np.concatenate([found[seen], every]).astype(np.int64),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "n", "every"])

    rows = map_batches(docs.select(F.col(text_col).alias("text"), train.alias("train")), run, "kind int, key long, n long, every long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


class Table:
    """Open addressing from 64-bit keys to indices, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(len(keys) * 1.5 + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.index = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.index[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.index[slot[won]], self.keys[slot[won]] = left[won], keys[left[won]]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1."""
        slot = self._slot(keys)
        out = self.index[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            got = self.index[slot]
            out[open_] = got
            go = (got >= 0) & (self.keys[slot] != keys[open_])
            open_, slot = open_[go], slot[go]
        return out


def _tagged(key: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of a key, marked with their number."""
    return (key & np.uint64((1 << 8 * length) - 1)) | np.uint64((length + 1) << 56)


@dataclass
class Trie:
    """Nodes are byte strings; a node is a symbol after its context, and a context itself."""

    order: int
    table: Table
    seen: np.ndarray  #: log10 probability of the node's symbol in its context, nothing excluded
    times: np.ndarray  #: log10 of the node's count
    escape: np.ndarray  #: log10 probability of an escape from the node as a context, nothing excluded
    rest: np.ndarray  #: after an escape from the node: log10 of what is left in its suffix
    onward: np.ndarray  #: after an escape from the node: log10 probability of an escape from its suffix
    left: int  #: bytes that no context has seen

    @classmethod
    def of(cls, key: np.ndarray, length: np.ndarray, n: np.ndarray, order: int) -> Trie:
        """From all strings of 1 to order+1 bytes (as numbers) with their counts."""
        tags, n = key.astype(np.uint64) | ((length + 1).astype(np.uint64) << np.uint64(56)), n.astype(np.float64)
        mask = (np.uint64(1) << (np.uint64(8) * (length - 1).astype(np.uint64))) - np.uint64(1)
        above = (key.astype(np.uint64) >> np.uint64(8)) | (length.astype(np.uint64) << np.uint64(56))
        # contexts that are no symbol's node (paddings) get nodes without a count
        all_tags = np.unique(np.concatenate([tags, above, np.array([1 << 56], np.uint64)]))
        table = Table(all_tags)
        size = len(all_tags)
        own, context = table.find(tags), table.find(above)
        count = np.zeros(size)
        count[own] = n
        total = np.bincount(context, weights=n, minlength=size)
        distinct = np.bincount(context, minlength=size).astype(np.float64)
        # a string without its first byte is the same symbol in the shorter context
        suffix = np.zeros(len(tags), np.int64)
        longer = length > 1
        suffix[longer] = table.find((key.astype(np.uint64) & mask)[longer] | (length.astype(np.uint64) << np.uint64(56))[longer])
        excluded = np.bincount(context[longer], weights=count[suffix[longer]], minlength=size)
        width = (all_tags >> np.uint64(56)).astype(np.int64) - 1
        body = all_tags & np.uint64((1 << 56) - 1)
        shorter = np.zeros(size, np.int64)
        deep = width >= 1
        cut = (np.uint64(1) << (np.uint64(8) * np.maximum(width - 1, 0).astype(np.uint64))) - np.uint64(1)
        shorter[deep] = table.find((body & cut)[deep] | (width.astype(np.uint64) << np.uint64(56))[deep])
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.full(size, np.nan)
            seen[own] = np.log10(n / (total[context] + distinct[context]))
            escape = np.log10(distinct / (total + distinct))
            new = distinct[shorter] - distinct
            rest = total[shorter] - excluded + new
            onward = np.where(new > 0, np.log10(new / rest), 0.0)
            root = table.find(np.array([1 << 56], np.uint64))[0]
            return cls(order, table, seen, np.log10(count), np.where(distinct > 0, escape, np.nan), np.log10(rest), onward, 256 - int(distinct[root]))

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each (order+1)-gram, given those before."""
        parts = [self._log10(key[at : at + AT_ONCE]) for at in range(0, len(key), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _log10(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key))
        at, came = np.arange(len(key)), np.full(len(key), -1, np.int64)
        for k in range(self.order, -1, -1):
            if not len(at):
                break
            some = key[at]
            node = self.table.find(_tagged(some, k + 1))
            known = node >= 0
            known[known] = ~np.isnan(self.seen[node[known]])
            hit, fresh = at[known], came[known] < 0
            value = np.where(fresh, self.seen[node[known]], self.times[node[known]] - self.rest[came[known]])
            out[hit] += value
            at, came, some = at[~known], came[~known], some[~known]
            context = self.table.find(_tagged(some >> np.uint64(8), k))
            is_context = context >= 0
            is_context[is_context] = ~np.isnan(self.escape[context[is_context]])
            some_out = np.where(came < 0, self.escape[context], self.onward[came])
            out[at[is_context]] += some_out[is_context]
            came = np.where(is_context, context, came)
        out[at] -= np.log10(max(1, self.left))
        return out


def _summed(key: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of ``length`` bytes that strings with counts end in: keys, lengths and counts."""
    keys, at = np.unique(key & ((1 << 8 * length) - 1), return_inverse=True)
    return keys, np.full(len(keys), length, np.int64), np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)


def _nodes(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate([empty, *(p[k] for p in parts)]) for k in range(3))  # type: ignore[return-value]


def code_lengths(counts: DataFrame, order: int = ORDER, bucket: int = BUCKET, crowded: int = CROWDED) -> DataFrame:
    """(key, every, value) of each gram of (key, n, every): ``value`` is the log10 probability of its last
    byte after those before, by the whole trie of all grams with their ``n``.

    A gram's code length needs nodes that end in its last bytes, and their contexts' other symbols. So it
    is dealt by its context's last two bytes, or the least longer ending that ``crowded`` grams at most share;
    nodes whose contexts are shorter than that are shared by all (2**16 of two bytes at most, and 256 for each
    crowded ending, of which there are few)."""
    short = min(2, order)
    ending = lambda k: F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))
    node = lambda k: F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long")).alias("key")
    learnt, shared = counts.where(F.col("n") > 0), []

    def collect(rows: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
        found = rows.groupBy(node(length)).agg(F.sum("n").alias("n")).toArrow()
        return tuple(found[c].to_numpy().astype(np.int64) for c in ("key", "n"))

    if short:
        key, n = collect(learnt, short)
        shared += [_summed(key, n, k) for k in range(1, short + 1)]
    depth, full = F.lit(short), F.lit(True)
    for k in range(short, order):
        sizes = counts.where(full).groupBy(ending(k).alias("ending")).agg(F.count("*").alias("c")).where(F.col("c") > crowded)
        many = [r.ending for r in sizes.collect()]
        if not many:
            break
        full = full & ending(k).isin(many)
        shared.append(_summed(*collect(learnt.where(full), k + 1), k + 1))
        depth = F.when(full, F.lit(k + 1)).otherwise(depth)
    known = counts.sparkSession.sparkContext.broadcast(_nodes(shared))
    buckets = max(1, -(-counts.count() // bucket))

    def run(rows: pa.Table) -> pa.Table:
        key, n, depth = (rows[c].to_numpy().astype(np.int64) for c in ("key", "n", "depth"))
        own = [_summed(key[use], n[use], k) for k in range(1, order + 2) if (use := (depth < k) & (n > 0)).any()]
        trie = Trie.of(*_nodes([known.value, *own]), order)
        return pa.table({"key": rows["key"], "every": rows["every"], "value": trie.log10(key.view(np.uint64))})

    place = F.coalesce(*[F.when(F.col("depth") == k, F.xxhash64(ending(k), F.lit(k))) for k in range(short, order + 1)])
    dealt = counts.select("key", "n", "every", depth.cast("int").alias("depth")).withColumn("bucket", F.pmod(place, F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(run, "key long, every long, value double")


#: Least counts that are tried, in order, until few enough rows have them.
FLOORS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, *(1 << k for k in range(7, 60))]


def frequent(rows: DataFrame, most: int, n: str = "n") -> dict[str, np.ndarray]:
    """The columns of the rows of ``n`` at or above the least floor that leaves ``most`` rows."""
    sizes = rows.agg(*[F.count_if(F.col(n) >= f).alias(str(f)) for f in FLOORS]).first()
    floor = next((f for f, size in zip(FLOORS, sizes, strict=True) if size <= most), FLOORS[-1])
    found = rows.where(F.col(n) >= floor).toArrow()
    return {c: found[c].to_numpy() for c in found.column_names}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, hot_grams: int = HOT_GRAMS, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = ~held_out(F.col("doc_id"))
    counts = materialize(count(docs, train, order=order), "lm-counts")
    ends = docs.where(train).count()
    word_counts = counts.where(F.col("kind") == WORD).select("key", "n")
    sums = word_counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    tokens, distinct = sums.n + ends, sums.v + (ends > 0)
    under = float(np.log10(tokens + 0.5 * (distinct + 1)))
    hot = frequent(word_counts, hot_words)
    order_ = np.argsort(hot["key"])
    lengths = materialize(code_lengths(counts.where(F.col("kind") == GRAM).select("key", "n", "every"), order), "code-lengths")
    often = frequent(lengths, hot_grams, "every")
    shared = spark.sparkContext.broadcast((Table(often["key"].view(np.uint64)), often["value"], hot["key"][order_], hot["n"][order_]))
    fields = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>, grams array<long>, gram_times array<int>"

    def lists(doc: np.ndarray, at: np.ndarray, names: np.ndarray, n: int) -> list[pa.ListArray]:
        """Of each of n texts, its distinct names (by index) and how often it has them."""
        size = max(1, len(names))
        pairs, times = np.unique(doc * size + at, return_counts=True)
        cuts = pa.array(np.searchsorted(pairs, np.arange(n + 1) * size).astype(np.int32))
        return [pa.ListArray.from_arrays(cuts, pa.array(names[pairs % size])), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, values, hot_keys, hot_counts = shared.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                texts, n = part.column(part.schema.get_field_index("text")), part.num_rows
                key, offsets = grams(texts, order)
                place = np.concatenate([table.find(key[a : a + AT_ONCE]) for a in range(0, len(key), AT_ONCE)])
                far = np.flatnonzero(place < 0)
                score = np.add.reduceat(np.where(place < 0, 0.0, values[place]) if len(values) else np.zeros(len(key)), offsets[:-1])
                others, far_at = np.unique(key[far], return_inverse=True)
                gram_lists = lists(np.searchsorted(offsets, far, side="right") - 1, far_at, others.view(np.int64), n)
                hashes, picks, cuts = words(texts)
                h = hashes.view(np.int64)
                at = np.minimum(np.searchsorted(hot_keys, h), max(0, len(hot_keys) - 1))
                is_hot = hot_keys[at] == h if len(hot_keys) else np.zeros(len(h), bool)
                value = np.where(is_hot, np.log10(hot_counts[at] + 0.5) - under, 0.0) if len(hot_keys) else np.zeros(len(h))
                add = lambda x: np.diff(np.r_[0, np.cumsum(x[picks])][cuts])
                base = add(value) + np.log10(ends + 0.5) - under
                known = add(is_hot.astype(np.int64)) + (ends > 0)
                doc = np.repeat(np.arange(n), np.diff(cuts))
                rare = ~is_hot[picks]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(cuts) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), *lists(doc[rare], picks[rare], h, n), *gram_lists],
                    names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "times", "grams", "gram_times"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = materialize(map_batches(rows, run, fields), "lm-scored")
    # rare words: a row for each that a document has, joined to its count (none: never seen in training)
    used = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    cold = used.join(word_counts, "key", "left")
    worth = F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(under))
    sums_ = cold.groupBy("row").agg(F.sum(worth).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    # and rare grams, all of which have a code length
    apart = scored.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row", F.col("x.grams").alias("key"), F.col("x.gram_times").alias("times"))
    coded = apart.join(lengths.select("key", "value"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("longer"))
    whole = scored.drop("rare", "times", "grams", "gram_times").join(sums_, "row", "left").join(coded, "row", "left")
    return whole.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("longer", F.lit(0.0))).alias("score"),
    )
