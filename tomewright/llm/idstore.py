"""Content-addressed store of token-id streams (operator 5).

Every whole text is encoded, the end id appended, and its id stream cut into chunks where a
rolling hash of the last WINDOW ids meets a mask, so equal passages give equal chunks wherever
they stand. Chunks are addressed by a digest of their bytes and stored once. A document's
recipe lists its chunks' digests. Recipes lie in ascending doc_id order, over files and within them, with their start; Merkle manifests (a
root for each block of recipes, a root over the blocks) verify them, and digests the chunks.

Layout under the store's path: ``kind=0/`` chunks (digest, payload), ``kind=1/`` recipes,
both Parquet; ``manifest/`` one row a block with its root, and ``root/`` the top root.
A payload is the chunk's ids, little-endian, of ``width`` bytes (2 if the vocabulary allows).

Defined results: a null text is empty, and an empty text has only the end id; repeated rows
(also of one doc_id) each have their recipe, ordered by text within a doc_id; an empty table
gives a store without rows; other columns are ignored."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.textbatches import DistinctWordTokenizer, map_batches, slices
from tomewright.operators.ordered import prefix_sum
from tomewright.session import drop_path

WINDOW = 16
#: A cut comes after 1 id in 2**MASK_BITS; no chunk is longer than LONGEST.
MASK_BITS, LONGEST = 8, 2048
#: Ids of a Merkle block.
BLOCK_IDS = 1 << 22
#: Digests under one node of the manifests' tree.
FAN = 4096
#: Distinct digests that a task remembers, so that it sends a chunk once.
REMEMBERED = 200_000
ROWS = "kind int, key binary, payload binary, doc_id long, twin long, n_tokens long, chunks array<binary>"
STORED = ROWS + ", start long"


def gear_table(seed: int = 7) -> np.ndarray:
    """A 64-bit word for each of 2**16 residues of an id."""
    return np.random.default_rng(seed).integers(0, 2**63, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray, offsets: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all streams (flat ``ids``, a stream between two ``offsets``), ascending."""
    h, j = gear[ids & 0xFFFF], 1
    while j < min(WINDOW, len(ids)):  # sums over 2j words from sums over j
        moved = h[:-j] << np.uint64(j)
        h[j:] += moved
        j *= 2
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MASK_BITS)
    found = np.flatnonzero(h == 0) + 1
    begins = offsets[np.searchsorted(offsets, found - 1, side="right") - 1]
    found = found[found - begins >= WINDOW]  # the window lies within the stream
    cuts = np.unique(np.concatenate([found, offsets[1:]]))
    cuts = cuts[cuts > 0]
    gaps = np.diff(np.r_[0, cuts])
    if (gaps > LONGEST).any():
        more = [np.arange(end - gap + LONGEST, end, LONGEST) for end, gap in zip(cuts[gaps > LONGEST], gaps[gaps > LONGEST], strict=True)]
        cuts = np.unique(np.concatenate([cuts, *more]))
    return cuts


def crc_shift(crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What crcs become when ``sizes`` zero bytes follow (the linear part of joining checksums)."""
    out = crcs.astype(np.uint32).copy()
    # the operator for one zero bit, then squares of it for 2**k zero bytes
    op = np.array([0xEDB88320, *(1 << i for i in range(31))], dtype=np.uint32)

    def apply(op: np.ndarray, v: np.ndarray) -> np.ndarray:
        r = np.zeros_like(v)
        for bit in range(32):
            r ^= np.where((v >> np.uint32(bit)) & np.uint32(1), op[bit], np.uint32(0))
        return r

    for _ in range(3):
        op = apply(op, op)
    left = sizes.astype(np.int64).copy()
    while left.any():
        on = (left & 1).astype(bool)
        out[on] = apply(op, out[on])
        op, left = apply(op, op), left >> 1
    return out


@dataclass(frozen=True)
class IdStore:
    """A written store."""

    spark: SparkSession
    path: str
    width: int

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self.path + "/rows")

    def chunks(self) -> DataFrame:
        """(digest, n, crc32, payload) of each chunk, read back and held against its address."""
        width = self.width

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                crcs = []
                for key, payload in zip(keys, payloads, strict=True):
                    if digest(payload) != key:
                        raise ValueError(f"chunk {key.hex()} isn't what its address says")
                    crcs.append(zlib.crc32(np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()))
                n = [len(x) // width for x in payloads]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.int64()), batch.column(1)], names=["key", "n", "crc", "payload"])

        return map_batches(self._rows().where("kind = 0").select("key", "payload"), read, "key binary, n long, crc long, payload binary")

    def recipes(self) -> DataFrame:
        """(doc_id, twin, n_tokens, chunks, start, leaf); ``leaf`` is the recipe's Merkle leaf."""
        rows = self._rows().where("kind = 1").select("doc_id", "twin", "n_tokens", "chunks", "start")
        parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens").cast("string"), F.hex(F.concat(F.lit(b""), F.array_join(F.transform("chunks", F.hex), "").cast("binary")))]
        return rows.withColumn("leaf", F.sha2(F.concat_ws("|", *parts), 256))

    def placed(self) -> DataFrame:
        """Recipes with ``start`` made again: the ids of all documents before."""
        return prefix_sum(self.recipes().drop("start"), "doc_id", "n_tokens", "start", ties=["twin", "leaf"])

    @staticmethod
    def roots(placed: DataFrame) -> DataFrame:
        """(block, first, leaves, root): the digest over each block's leaves in order. A block
        holds the documents that start within BLOCK_IDS ids, so its leaves are bounded too."""
        one = F.array_sort(F.collect_list(F.struct("start", "leaf")))
        block = F.floor(F.col("start") / BLOCK_IDS).cast("long").alias("block")
        return placed.groupBy(block).agg(F.min("start").alias("first"), F.count("*").alias("leaves"), F.sha2(F.array_join(F.transform(one, lambda x: F.concat_ws("|", x["start"].cast("string"), x["leaf"])), ""), 256).alias("root"))

    def manifest(self) -> DataFrame:
        return self.spark.read.schema("block long, first long, leaves long, root string").parquet(self.path + "/manifest")

    def top_root(self) -> str:
        """The digest over the blocks' roots (a row for BLOCK_IDS ids), level by level: no more than FAN digests
        are put together at once, here or on the executors."""
        level = self.manifest().select("block", "root")
        while level.count() > FAN:
            listed = F.array_sort(F.collect_list(F.struct("block", "root")))
            above = level.groupBy(F.floor(F.col("block") / FAN).cast("long").alias("block"))
            level = above.agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["root"]), ""), 256).alias("root"))
        order = [x.root for x in level.orderBy("block").collect()]
        return hashlib.sha256("".join(order).encode()).hexdigest()

    def verify(self) -> None:
        """Hold recipes against the manifests, and these against the top root."""
        fresh = self.roots(self.recipes()).alias("a").join(self.manifest().alias("b"), "block", "full_outer")
        bad = fresh.where(~(F.col("a.root").eqNullSafe(F.col("b.root")) & F.col("a.leaves").eqNullSafe(F.col("b.leaves")))).limit(1).collect()
        kept = self.spark.read.schema("root string").parquet(self.path + "/root").first()
        if bad or kept is None or kept.root != self.top_root():
            raise ValueError("the store's recipes aren't those of its manifest")

    def checksums(self) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

        Chunks are read once and their content reduced to a checksum; only checksums are
        dealt to the recipes, whose documents' checksums are then joined in order."""
        recipes = self.recipes().select("doc_id", "start", "chunks", "n_tokens")
        parts = recipes.select("doc_id", "start", "n_tokens", F.posexplode("chunks").alias("pos", "key"))
        found = parts.join(self.chunks().drop("payload"), "key", "left")
        # start is a document's own: every document has an id at least
        docs = found.groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))
        width = 4

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(3)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.flatten()
                n, crc = (np.asarray(flat.field(k).fill_null(-1), dtype=np.int64) for k in (1, 2))
                if (n < 0).any():
                    raise ValueError("a recipe names a chunk that the store doesn't have")
                at = offsets - offsets[0]
                # shift each chunk's checksum by the bytes that follow it in its document
                ends = np.cumsum(n)
                total = np.r_[0, ends][at]
                after = np.repeat(total[1:], np.diff(at)) - ends
                moved = crc_shift(crc, after * width)
                out = np.bitwise_xor.reduceat(moved, at[:-1]) if len(moved) else np.empty(0, np.uint32)
                if not np.array_equal(np.diff(total), np.asarray(batch.column(2))):
                    raise ValueError("a document's chunks don't have its length")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return map_batches(docs, join, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def streams(self) -> DataFrame:
        """(doc_id, start, ids) of every document, rebuilt from its chunks."""
        parts = self.recipes().select("doc_id", "start", F.posexplode("chunks").alias("pos", "key"))
        rows = parts.join(self.chunks().select("key", "payload"), "key")
        whole = rows.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("p"))
        dtype = f"<u{self.width}"

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = [np.frombuffer(b"".join(x["payload"] for x in p), dtype).astype(np.int32) for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

        return map_batches(whole, decode, "doc_id long, start long, ids array<int>")


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def write_store(docs: DataFrame, tokenizer: str, path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 1 << 16) -> IdStore:
    """Encode ``docs`` with a byte-level BPE file and write the store to ``path``.

    One shuffle: a task sends a chunk the first time it sees it (pre-aggregation), chunks are
    dealt by digest and recipes by document, and equal digests meet in one sorted run."""
    spark, width = docs.sparkSession, 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, gear, seen = DistinctWordTokenizer(tokenizer, "kept"), gear_table(), set()
        for batch in batches:
            for part in slices(batch):
                flat, offsets = encoder.encode(part.column(1))
                ids = np.insert(flat, offsets[1:], end_id).astype(np.int64)
                offsets = offsets + np.arange(len(offsets))
                cuts = cut_points(ids, offsets, gear)
                raw = ids.astype(f"<u{width}").tobytes()
                keys = [digest(raw[a * width : b * width]) for a, b in zip(np.r_[0, cuts[:-1]].tolist(), cuts.tolist(), strict=True)]
                fresh, at = [], 0
                for key, end in zip(keys, cuts.tolist(), strict=True):
                    if key not in seen:
                        seen.add(key)
                        fresh.append((key, raw[at * width : end * width]))
                    at = end
                if len(seen) > REMEMBERED:
                    seen.clear()
                first = np.searchsorted(cuts, offsets[:-1], side="right")
                last = np.searchsorted(cuts, offsets[1:], side="right")
                n, docs_n = len(fresh), part.num_rows
                lists = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(n, np.int64), first, last[-1:]].astype(np.int32)), pa.array(keys, pa.binary()))
                arrays = [
                    pa.array(np.r_[np.zeros(n, np.int32), np.ones(docs_n, np.int32)].astype(np.int32)),
                    pa.array([k for k, _ in fresh] + [None] * docs_n, pa.binary()),
                    pa.array([p for _, p in fresh] + [None] * docs_n, pa.binary()),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), part.column(0)]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), part.column(2)]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.diff(offsets))]),
                    lists,
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = pa.array([None], pa.binary())
        for batch in batches:
            keys = batch.column(1)
            same = pc.equal(keys, pa.concat_arrays([last, keys[:-1]]))  # null beside a recipe, which has no key
            last = keys[-1:] if len(keys) else last
            yield batch.filter(pc.invert(pc.fill_null(same, False)))

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("twin"))
    rows = map_batches(picked, encode, ROWS)
    dealt = rows.repartition(F.coalesce("key", F.hash("doc_id", "twin").cast("string").cast("binary"))).sortWithinPartitions("kind", "key")
    map_batches(dealt, once, ROWS).write.partitionBy("kind").option("compression", "zstd").parquet(path + "/rows")
    store = IdStore(spark, path, width)
    # recipes again, with their start and in its order, in place of the dealt ones
    ordered = store.placed().drop("leaf", "block").repartitionByRange("start").sortWithinPartitions("start")
    ordered.write.option("compression", "zstd").parquet(path + "/ordered")
    drop_path(spark, path + "/rows/kind=1")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = hadoop(path + "/rows/kind=1")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(hadoop(path + "/ordered"), place):
        raise OSError("the ordered recipes can't be put in their place")
    store.roots(store.recipes()).select("block", "first", "leaves", "root").write.parquet(path + "/manifest")
    spark.createDataFrame([(store.top_root(),)], "root string").write.parquet(path + "/root")
    return store


SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("twin", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.list_(pa.binary()))])
