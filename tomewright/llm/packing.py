"""Best-fit packing of token pieces by a grouping genetic algorithm on islands (operator 2).

Pieces are dealt to shards by a hash of their number, so no key is hot. Every shard is bred on
several islands (tasks): solutions are groupings of pieces into sequences, seeded by best fits
in noisy descending order; a crossover injects
whole well-filled sequences of one parent into the other, drops the sequences that now hold a
piece twice, and puts the displaced pieces back by best fit. Fewer sequences are fitter; of as many, those
whose room is left over in one place, so that a shard's worst-filled sequence holds little and can be
pooled. Every island breeds all its generations. After each epoch the islands'
elites migrate to their neighbours. The best island's grouping stands; sequences that it left
less than well filled are pooled over shards and bred again, until one shard holds them or
nothing is gained. Island state is a shard's lengths, whose number is bounded.

Defined results: a piece has 1 to ``capacity`` tokens; pieces of full length are sequences of
their own; repeated rows are pieces of their own; an empty table gives an empty result."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewright.llm.textbatches import DistinctWordTokenizer, map_batches, slices
from tomewright.session import forget, materialize

SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 2, 2, 4, 4
WELL_FILLED = 0.995


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every whole text's ids and end id.

    Only texts of more than ``capacity`` ids are cut; null text counts as empty; rows aren't shuffled."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = DistinctWordTokenizer(tokenizer, "dropped")
        for batch in batches:
            for part in slices(batch):
                flat, offsets = encoder.encode(part.column(1))
                ids = np.insert(flat, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                sizes = np.diff(offsets)
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                lo = offsets[row] + start
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
                cols = [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(lo, lo + length, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


class Breeder:
    """Groupings of one shard's pieces: lists of sequences, each a list of piece indices."""

    def __init__(self, lengths: list[int], capacity: int, seed: int) -> None:
        self.n, self.capacity, self.rng = lengths, capacity, np.random.default_rng(seed)
        self.crossings, self.gains = 0, 0

    def best_fit(self, pieces: list[int], bins: list[list[int]]) -> list[list[int]]:
        """Put each piece, in order, where the least room is left over; open a sequence if none has room."""
        n, room, mask = self.n, {}, 0
        for b in bins:
            left = self.capacity - sum(n[i] for i in b)
            if left:
                room.setdefault(left, []).append(b)
                mask |= 1 << left
        for i in pieces:
            fits = mask >> n[i]
            if fits:
                left = n[i] + (fits & -fits).bit_length() - 1
                b = room[left].pop()
                if not room[left]:
                    mask ^= 1 << left
            else:
                left, b = self.capacity, []
                bins.append(b)
            b.append(i)
            left -= n[i]
            if left:
                if not mask >> left & 1:
                    mask |= 1 << left
                    room[left] = []
                room[left].append(b)
        return bins

    def fill(self, b: list[int]) -> float:
        return sum(self.n[i] for i in b) / self.capacity

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Lower is better: sequences, then unevenness of their fill."""
        return len(bins), -sum(self.fill(b) ** 2 for b in bins)

    def seed(self, noise: float) -> list[list[int]]:
        keys = np.array(self.n) * (1 + noise * self.rng.standard_normal(len(self.n)))
        return self.best_fit(np.argsort(-keys, kind="stable").tolist(), [])

    def cross(self, taker: list[list[int]], giver: list[list[int]]) -> list[list[int]]:
        """Inject whole well-filled sequences of ``giver``; best-fit what that displaces."""
        fills = np.array([self.fill(b) for b in giver])
        good = np.flatnonzero(fills >= np.quantile(fills, 0.5))
        picked = self.rng.choice(good, size=max(1, len(good) // 3), replace=False)
        injected = [list(giver[k]) for k in picked]
        inside = {i for b in injected for i in b}
        kept, loose = [], []
        for b in taker:
            if inside.isdisjoint(b):
                kept.append(list(b))
            else:
                loose += [i for i in b if i not in inside]
        # a mutation: the worst-filled sequences give up their pieces too
        kept.sort(key=self.fill)
        drop = min(len(kept), 1 + len(kept) // 20)
        loose += [i for b in kept[:drop] for i in b]
        loose.sort(key=lambda i: -self.n[i])
        return self.best_fit(loose, kept[drop:] + injected)

    def breed(self, elites: list[list[list[int]]]) -> list[list[int]]:
        """The fittest after GENERATIONS. ``crossings`` counts the crossovers, ``gains`` those children
        that were fitter than all before them."""
        people = [e for e in elites if e]
        while len(people) < POPULATION:
            people.append(self.seed(0.02 * len(people)))
        ranked = sorted(((self.fitness(x), x) for x in people), key=lambda x: x[0])
        for _ in range(GENERATIONS):
            a, b = sorted(self.rng.choice(len(ranked), 2, replace=False).tolist())
            for taker, giver in ((a, b), (b, a)):
                child = self.cross(ranked[taker][1], ranked[giver][1])
                fit = self.fitness(child)
                self.crossings, self.gains = self.crossings + 1, self.gains + (fit < ranked[0][0])
                ranked.append((fit, child))
            ranked = sorted(ranked, key=lambda x: x[0])[:POPULATION]
        return ranked[0][1]


def _epoch(capacity: int, first: bool):
    """A group (shard, island) -> its elite grouping, from scratch or from migrated elites."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["origin", "item"])
        own = rows[rows.origin == rows.origin.iloc[0]]
        items, lengths = own.item.to_numpy(), own.length.to_numpy()
        breeder = Breeder(lengths.tolist(), capacity, int(key[0]) * 31 + int(key[1]))
        elites = []
        if not first:
            for _, x in rows.groupby("origin"):  # the same items in the same order
                groups: dict[int, list[int]] = {}
                for i, b in enumerate(x.bin.tolist()):
                    groups.setdefault(b, []).append(i)
                elites.append(list(groups.values()))
        best = breeder.breed(elites)
        bins = np.empty(len(items), np.int64)
        for k, b in enumerate(best):
            bins[b] = k
        return pd.DataFrame({"shard": key[0], "island": key[1], "item": items, "length": lengths, "bin": bins})

    return run


def _breed(items: DataFrame, capacity: int, shards: int, label: str) -> tuple[DataFrame, DataFrame]:
    """(item, length, shard, bin): the best island's grouping of every shard; and the table that it is read from."""
    rows = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(label)), F.lit(shards)).cast("long").alias("shard"))
    out = "shard long, island long, item long, length long, bin long"
    state = rows.withColumn("island", F.explode(F.array(*[F.lit(i).cast("long") for i in range(ISLANDS)]))).withColumn("origin", F.col("island")).withColumn("bin", F.lit(0).cast("long"))
    for epoch in range(EPOCHS):
        elite = state.groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch == 0), out)
        elite = materialize(elite, f"elite-{label}-{epoch}")
        if epoch > 0:
            forget(bred)
        bred = elite
        if epoch < EPOCHS - 1:  # elites stay, and migrate to the next island
            here = F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)
            state = elite.withColumn("origin", F.col("island")).withColumn("island", F.explode(here))
    fills = elite.groupBy("shard", "island", "bin").agg(F.sum("length").alias("fill"))
    score = fills.groupBy("shard", "island").agg(F.count("*").alias("bins"), F.sum(F.pow(F.col("fill") / capacity, 2)).alias("even"))
    best = score.groupBy("shard").agg(F.min_by("island", F.struct("bins", -F.col("even"), "island")).alias("island"))
    return elite.join(best, ["shard", "island"]).select("item", "length", "shard", "bin"), elite


def pack(pieces: DataFrame, capacity: int, *, item: str = "item", length: str = "length") -> DataFrame:
    """(item, sequence_id, offset) for pieces with a unique long ``item`` and a ``length``."""
    items = pieces.select(F.col(item).alias("item"), F.col(length).cast("long").alias("length"))
    whole = items.where(F.col("length") == capacity).select("item", (-F.col("item") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, done, level, numbered = items.where(F.col("length") < capacity), [], 0, 0
    n = left.count()
    while n:
        shards = -(-n // SHARD)
        bred, elites = _breed(left, capacity, shards, f"level{level}")
        fills = Window.partitionBy("shard", "bin")
        # a shard is given 2**14 numbers, and each level those after the last one's
        sequence = F.lit(numbered).cast("long") + F.col("shard") * F.lit(1 << 14) + F.col("bin")
        numbered += shards << 14
        bred = materialize(bred.withColumn("fill", F.sum("length").over(fills)).withColumn("sequence_id", sequence), f"bred-{level}")
        forget(elites)
        good = (F.col("fill") >= WELL_FILLED * capacity) if shards > 1 else F.lit(True)
        done.append(bred.where(good))
        left = bred.where(~good).select("item", "length")
        more = left.count()
        if shards > 1 and more > n * 0.9:  # pooling all gains nothing any more: only each shard's worst-filled sequence
            worst = bred.groupBy("shard").agg(F.min_by("bin", F.struct("fill", "bin")).alias("worst"))
            marked = bred.join(worst, "shard")
            done[-1] = marked.where(F.col("bin") != F.col("worst")).drop("worst")
            left = marked.where(F.col("bin") == F.col("worst")).select("item", "length")
            more = left.count()
            if more > n * 0.9:
                done[-1], more = bred, 0
        n, level = more, level + 1
    if not done:
        return whole
    packed = done[0]
    for x in done[1:]:
        packed = packed.unionByName(x)
    order = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    packed = packed.select("item", "length", "sequence_id")
    return packed.select("item", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset")).unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize ``docs`` and pack them: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    pieces = token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    pieces = materialize(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity), "item").drop("item")
