"""Jaccard self-join of documents on word n-grams, with Bayesian pruning (operator 3).

Documents of equal word sequences are one text. Texts that share a band of ROWS of their HASHES
MinHash values meet in that band's bucket; at similarity 0.8 some band agrees but for one pair in
2*10**7. Buckets with the same members are one bucket. A bucket's members are dealt to blocks and
its pairs to tiles of two blocks, so no task gets an unbounded group and no pair becomes a row:

1. a tile compares MinHash values of its pairs incrementally, STEP at a time, and drops a pair once
   the posterior probability (uniform prior) that its similarity reaches the threshold is below
   TOLERANCE. A pair belongs to the first band in which it agrees, so it is looked at once;
2. members of surviving pairs come with their texts, and the tile verifies its pairs exactly, on
   shingle sets. It returns each text's number of links and a spanning forest of the linked texts.

Forests are joined to classes by connected components.

Words are runs without ASCII white space. A text of fewer than WORDS words is one shingle.
Defined results: texts without words (null too) link with nothing and are each their own class;
equal texts are one class whatever their doc_id; repeated rows give a row each; a null doc_id is
allowed; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.textbatches import map_batches, slices
from tomewright.operators.components import connected_components
from tomewright.session import materialize

WORDS, THRESHOLD = 5, 0.8
HASHES, ROWS, STEP, TOLERANCE = 128, 4, 16, 1e-6
#: Members of a tile's block, and shingles, at most on average.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
PAIRS_AT_ONCE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, len(texts)+1 offsets, and a 64-bit hash of each word sequence."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    distinct, picks = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    keep = np.array([bool(x) for x in distinct], bool)[picks] if distinct else np.empty(0, bool)
    names = pd.util.hash_array(np.array(distinct, dtype=object), categorize=False) if distinct else np.empty(0, np.uint64)
    word, offsets = names[picks[keep]], np.r_[0, np.cumsum(keep)][offsets - offsets[0]]
    counts = np.diff(offsets)
    place = np.arange(len(word)) - np.repeat(offsets[:-1], counts)
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(counts.max(initial=0)) + size, np.uint64(0xD6E8FEB86659FD93))])
    sequence = np.r_[np.uint64(0), np.cumsum(word * power[place] + power[place])]
    sequence = (sequence[offsets[1:]] - sequence[offsets[:-1]]) * _MIX
    sequence ^= sequence >> np.uint64(29)
    # the hash of a window starting at each word; short texts have one window of all their words
    padded = np.r_[word, np.zeros(size, np.uint64)]
    left = np.repeat(counts, counts) - place
    window = np.zeros(len(word), np.uint64)
    for k in range(size):
        window += np.where(k < left, padded[k : k + len(word)], np.uint64(0)) * power[k + 1]
    starts = (left >= size) | (place == 0)
    window = (window ^ (window >> np.uint64(32))) * _MIX
    window ^= window >> np.uint64(29)
    return window[starts], np.r_[0, np.cumsum(starts)][offsets], sequence


def signatures(hashes: np.ndarray, offsets: np.ndarray, seed: int = 11) -> np.ndarray:
    """MinHash values, 16 bits each (texts x HASHES); the texts must have shingles."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adds = rng.integers(0, 2**63, HASHES, dtype=np.uint64)
    out = np.empty((len(offsets) - 1, HASHES), np.uint16)
    for k in range(HASHES):
        mixed = hashes * factors[k] + adds[k]
        least = np.minimum.reduceat(mixed >> np.uint64(16), offsets[:-1])
        out[:, k] = ((least * _MIX) >> np.uint64(48)).astype(np.uint16)
    return out


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n values compared, the least number of equal ones with which a pair stays.

    With a uniform prior, P(similarity >= t | m of n equal) is P(Binomial(n + 1, t) <= m)."""
    found = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        found[n] = m
    return found


def surviving_pairs(bands: np.ndarray, left: np.ndarray, right: np.ndarray | None, band: int, floors: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile (within ``left`` if ``right`` is None) that first agree in ``band`` and aren't pruned."""
    values, found = np.ascontiguousarray(bands).view(np.uint16), []
    width = len(left) if right is None else len(right)
    rows = max(1, PAIRS_AT_ONCE // max(1, width))
    for at in range(0, len(left), rows):
        some = np.arange(at, min(at + rows, len(left)))
        if right is None:
            p, q = np.repeat(some, width), np.tile(np.arange(width), len(some))
            p, q = left[p[p < q]], left[q[p < q]]
        else:
            p, q = np.repeat(left[some], width), np.tile(right, len(some))
        for g in range(band):
            apart = bands[p, g] != bands[q, g]
            p, q = p[apart], q[apart]
        equal = np.zeros(len(p), np.int32)
        for n, floor in floors.items():
            equal += (values[p, n - STEP : n] == values[q, n - STEP : n]).sum(axis=1, dtype=np.int32)
            stay = equal >= floor
            p, q, equal = p[stay], q[stay], equal[stay]
        found.append((p, q))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def common_counts(sets: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function giving the size of the intersection of the sets at p and q, exactly.

    Shingles that most sets hold are the base; sets are told by what they lack of it and what
    they have besides, so that near copies cost what they differ in."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    names, code = np.unique(flat, return_inverse=True)
    held = np.bincount(code, minlength=len(names))
    base = held * 2 > n
    out = np.zeros((n, n), np.int32)
    in_base = base[code]
    has = np.zeros((n, int(base.sum())), bool)
    place = np.cumsum(base) - 1
    has[owner[in_base], place[code[in_base]]] = True
    lack_doc, lack_code = np.nonzero(~has)
    extra = ~in_base & (held[code] > 1)
    for doc, what in ((lack_doc, lack_code), (owner[extra], code[extra])):
        order = np.argsort(what, kind="stable")
        doc, what = doc[order], what[order]
        cuts = np.flatnonzero(np.r_[True, what[1:] != what[:-1], True]) if len(what) else np.zeros(1, int)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                out[np.ix_(doc[a:b], doc[a:b])] += 1
    lacks = np.bincount(lack_doc, minlength=n)
    whole = int(base.sum())
    return lambda p, q: whole - lacks[p] - lacks[q] + out[p, q]


def verified(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold exactly."""
    sizes = np.array([len(s) for s in sets])
    if len(p) <= 4:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(p, q, strict=True)], dtype=np.int64)
    else:
        both = common_counts(sets)(p, q)
    return both >= threshold * (sizes[p] + sizes[q] - both) - 1e-9


def forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least member that each of n members is linked with, over any number of links."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, p, label[q])
        np.minimum.at(low, q, label[p])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal ``tile`` in sorted batches, whole."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]).tolist() + [batch.num_rows]
        if kept and kept[-1].column(0)[0].as_py() != tile[0]:
            yield pa.Table.from_batches(kept)
            kept = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            kept.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(kept)
                kept = []
    if kept:
        yield pa.Table.from_batches(kept)


def _sides(tile: pa.Table, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Indices of the tile's two blocks, or of its one."""
    own, other = tile["own"].to_numpy(), tile["other"].to_numpy()
    low = np.minimum(own, other)
    if (own == other).all():
        return np.arange(len(rid)), None
    return np.flatnonzero(own == low), np.flatnonzero(own != low)


def sign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, twin, rid, n, bands) of every row: hashes of the text and of its word sequence, its
    shingles' number, and its bands' values (none for texts without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, offsets, sequence = shingles(part.column(2))
                n = np.diff(offsets)
                full = n > 0
                values = np.empty(0, np.int64)
                if full.any():
                    values = signatures(hashes, np.r_[offsets[:-1][full], len(hashes)]).view(np.int64).ravel()
                ends = np.r_[0, np.cumsum(full * (HASHES // ROWS))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                rid = sequence.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(rid), pa.array(n), lists],
                    names=["doc_id", "twin", "rid", "n", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("twin"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, twin long, rid long, n long, bands array<long>")


def _prune(floors: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            rid = tile["rid"].to_numpy()
            bands = tile["bands"].combine_chunks().flatten().to_numpy().reshape(len(rid), -1)
            p, q = surviving_pairs(bands, *_sides(tile, rid), int(tile["band"][0].as_py()), floors)
            stay = np.unique(np.concatenate([p, q]))
            if len(stay):
                yield from tile.select(["tile", "band", "own", "other", "rid"]).take(pa.array(stay)).to_batches()

    return run


def _verify(floors: dict[int, int], threshold: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            rid, first = np.unique(tile["rid"].to_numpy(), return_index=True)  # repeated rows of a text
            tile = tile.take(pa.array(first))
            hashes, offsets, _ = shingles(tile["text"].combine_chunks().cast(pa.large_string()), size)
            bands = np.ascontiguousarray(signatures(hashes, offsets)).view(np.int64)
            p, q = surviving_pairs(bands, *_sides(tile, rid), int(tile["band"][0].as_py()), floors)
            sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            true = verified(sets, p, q, threshold)
            p, q = p[true], q[true]
            if not len(p):
                continue
            links, root = np.bincount(np.concatenate([p, q]), minlength=len(rid)), forest(len(rid), p, q)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(rid[root[some]]), pa.array(links[some])], names=["rid", "root", "links"])

    return run


def join_documents(docs: DataFrame, *, threshold: float = THRESHOLD, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row: the least doc_id of its class, the number of
    other texts that it is linked with, and the rows of its own text."""
    return classes(docs, threshold=threshold, size=size, id_col=id_col, text_col=text_col).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the least doc_id (and, of those, of one text) of every class, with all its columns."""
    found = classes(docs, threshold=threshold, id_col=id_col, text_col=text_col)
    least = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "twin")).alias("of")).select("of.*")
    wanted = least.unionByName(found.where(F.col("root").isNull()).select("doc_id", "twin").distinct())
    wanted = wanted.select(F.col("doc_id").alias("__id"), F.col("twin").alias("__twin"))
    keyed = docs.withColumn("__own", F.xxhash64(text_col))
    same = keyed[id_col].cast("long").eqNullSafe(wanted["__id"]) & (keyed["__own"] == wanted["__twin"])
    kept = keyed.join(wanted, same, "left_semi")
    # a row of the same doc_id and text is the same document
    return kept.dropDuplicates([id_col, "__own"]).drop("__own")


def classes(docs: DataFrame, *, threshold: float = THRESHOLD, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``join_documents`` gives, with ``twin`` (a hash of the text) and ``root`` (the class; null for texts without words)."""
    if size != WORDS:
        raise ValueError("signatures are of five words")
    floors = least_matches(threshold)
    signed = materialize(sign(docs, id_col=id_col, text_col=text_col), "signed")
    texts = signed.where("n > 0").groupBy("rid").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "twin")).alias("of"))
    bare = signed.where("n > 0").select("rid", F.col("doc_id"), "twin", "n", "bands")
    kept = texts.select("rid", F.col("of.doc_id").alias("_d"), F.col("of.twin").alias("_t"))
    one = bare.join(kept, (bare.rid == kept.rid) & bare.doc_id.eqNullSafe(kept._d) & (bare.twin == kept._t)).select(bare.rid, "doc_id", "twin", "n", "bands")
    one = materialize(one.dropDuplicates(["rid"]), "texts")
    # buckets of two texts or more, and of those with the same members the first
    banded = one.select("rid", "n", F.posexplode("bands").alias("band", "value"))
    mark = [F.bit_xor(F.xxhash64("rid", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    buckets = banded.groupBy("band", "value").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), *mark).where("members > 1")
    buckets = buckets.groupBy("members", "mark1", "mark2").agg(F.min(F.struct("band", "value", "shingles")).alias("b"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("b.shingles") / BLOCK_SHINGLES)).cast("int")
    buckets = buckets.select("b.band", "b.value", blocks.alias("blocks"))
    members = banded.drop("n").join(buckets, ["band", "value"])
    own = F.pmod(F.xxhash64("rid", "value", "band"), F.col("blocks")).cast("int").alias("own")
    members = materialize(members.select("band", "value", "rid", "blocks", own), "members")
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other")).alias("tile")
    with_bands = dealt.select(tile, "band", "own", "other", "rid").join(one.select("rid", "bands"), "rid")
    with_bands = with_bands.select("tile", "band", "own", "other", "rid", "bands")
    pruned = map_batches(with_bands.repartition("tile").sortWithinPartitions("tile"), _prune(floors), "tile long, band int, own int, other int, rid long")
    pruned = materialize(pruned, "survivors")
    wanted = pruned.select("rid").distinct().join(one.select("rid", "doc_id", "twin"), "rid")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("twin"), F.col(text_col).alias("text"))
    same = source.doc_id.eqNullSafe(wanted.doc_id) & (source.twin == wanted.twin)
    whole = source.join(wanted, same).select("rid", "text")
    with_text = pruned.join(whole, "rid").select("tile", "band", "own", "other", "rid", "text")
    linked = map_batches(with_text.repartition("tile").sortWithinPartitions("tile"), _verify(floors, threshold, size), "rid long, root long, links long")
    linked = materialize(linked, "links")
    roots = connected_components(linked, "rid", "root").withColumnRenamed("node", "rid")
    links = linked.groupBy("rid").agg(F.sum("links").alias("links"))
    classed = texts.join(roots, "rid", "left").join(links, "rid", "left")
    classed = classed.select("rid", F.coalesce("root", "rid").alias("root"), F.coalesce("links", F.lit(0)).alias("n_links"), "copies", F.col("of.doc_id").alias("least"))
    classed = materialize(classed, "classes")
    least = classed.groupBy("root").agg(F.min("least").alias("class_id"))
    classed = classed.join(least, "root").select("rid", "root", "class_id", "n_links", "copies")
    rows = signed.select("doc_id", "twin", F.when(F.col("n") > 0, F.col("rid")).alias("rid"))
    named = rows.join(classed, "rid", "left")
    return named.select(
        "doc_id", "twin", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )
