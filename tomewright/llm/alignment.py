"""Alignment of two tokenizers' tokens over the same bytes.

Spark deals the documents; in every Arrow batch both tokenizers give tables of token intervals (token, first byte,
end), and DuckDB joins them: an equi-join finds where tokens of both end, window sums number the groups that end there, and
ASOF joins lead a token to those that it overlaps. What a batch counts of id pairs is merged in Spark, and
read back by documents: frequent pairs by broadcast, all others by a join."""

from __future__ import annotations

import hashlib
import json
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.sentencepieces import SPACE, LibraryEncoder
from tomewright.llm.textbatches import DistinctWordTokenizer, gather, map_batches, slices
from tomewright.session import materialize

#: Bytes of texts that are encoded together, and whose tokens are joined together (longer texts are cut where tokens of both end).
SLICE, STRETCH = 2 << 20, 1 << 20
#: At most so many id pairs are broadcast, the most frequent; the others are joined.
HOT_PAIRS = 1_000_000
#: Floors of frequency that are tried for that.
FLOORS = [1 << k for k in range(42)]
MEMORY = "256MB"

FIELDS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups string, groups_sha256 string, pairs array<long>, times array<int>"

#: Where tokens of both end, numbered in order: each ends a group.
LINKS = """CREATE OR REPLACE TEMP TABLE links AS
SELECT a.doc, a.id AS a_id, b.id AS b_id, a.pos AS a_pos, b.pos AS b_pos, CAST(sum(1) OVER (ORDER BY a.till ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part
FROM a JOIN b ON a.till = b.till"""

GROUPS = "SELECT part, doc, a_pos, b_pos FROM links ORDER BY part"

COUNTS = "SELECT doc, count(*) AS n_links, max(part) - min(part) + 1 AS n_groups FROM links GROUP BY doc ORDER BY doc"

PAIRS = "SELECT doc, (CAST(a_id AS BIGINT) << 32) + b_id AS pair, count(*) AS n FROM links GROUP BY ALL ORDER BY doc, pair"

#: From the first token of B that a token of A overlaps to the last.
OVERLAPS = """SELECT f.doc, CAST(l.s - f.s + f.n AS BIGINT) AS n_overlaps FROM
  (SELECT a.doc, sum(b.pos) AS s, count(*) AS n FROM a ASOF JOIN b ON a.since < b.till GROUP BY a.doc) f JOIN
  (SELECT a.doc, sum(b.pos) AS s FROM a ASOF JOIN b ON a.till > b.since GROUP BY a.doc) l USING (doc) ORDER BY f.doc"""


def byte_level_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others in turn from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spellings:
    """The bytes of all ids of a tokenizer."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    @classmethod
    def byte_level(cls, path: str) -> Spellings:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        alphabet = byte_level_alphabet()
        spelled = dict.fromkeys(range(max(content["model"]["vocab"].values()) + 1), b"")
        for token, i in content["model"]["vocab"].items():
            spelled[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token in content.get("added_tokens", []):
            spelled[token["id"]] = token["content"].encode()
        return cls([spelled.get(i, b"") for i in range(max(spelled) + 1)])

    @classmethod
    def pieces(cls, library) -> Spellings:
        return cls(
            [bytes([int(library.id_to_piece(i)[1:-1], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace(SPACE, " ").encode() for i in range(library.get_piece_size())]
        )

    def differs(self, ids: np.ndarray, want: np.ndarray, at_once: int = 1 << 20) -> bool:
        """Whether the ids' joined bytes are others than ``want``."""
        at = 0
        for k in range(0, len(ids), at_once):
            got, _ = gather(self.bytes, self.starts, self.lengths, ids[k : k + at_once])
            if not np.array_equal(got, want[at : at + len(got)]):
                return True
            at += len(got)
        return at != len(want)


class Digits:
    """Ids as decimal text, each with what may stand after it."""

    AFTER = (",", "|", ";", "")

    def __init__(self, ids: int) -> None:
        spelled = [f"{i}{x}".encode() for i in range(ids) for x in self.AFTER]
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(doc, groups) of all documents, from the ids of both sides and, of each group, its document and the places of its last tokens."""
        n_a, n_b = np.diff(np.r_[-1, a_last]), np.diff(np.r_[-1, b_last])
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)
        ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[a_last], after_b[b_last] = 1, 2
        after_b[b_last[ends]] = 3
        picks = np.empty(len(a) + len(b), np.int64)
        picks[place_a] = a * len(self.AFTER) + after_a
        picks[place_b] = b * len(self.AFTER) + after_b
        out, until = gather(self.bytes, self.starts, self.lengths, picks)
        stops = until[place_b[b_last[ends]]]
        for k, start, stop in zip(doc[ends].tolist(), np.r_[0, stops[:-1]].tolist(), stops.tolist()):
            yield k, out[start:stop].tobytes()


class Aligner:
    """Both tokenizers, and a DuckDB connection of one thread."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import duckdb

        self.a = DistinctWordTokenizer(byte_level, "kept", special_as_text=True)
        self.b = LibraryEncoder(pieces)
        self.spell_a, self.spell_b = Spellings.byte_level(byte_level), Spellings.pieces(self.b.library)
        self.digits = Digits(max(len(self.spell_a.lengths), len(self.spell_b.lengths)))
        self.scratch = tempfile.TemporaryDirectory()  # for joins larger than the memory; of this task alone
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.scratch.name})

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by both tokenizers of each text; none where there are no bytes, or where they spell another text."""
        none, space = (pa.scalar(x, type=texts.type) for x in ("", " "))
        spaced = pc.binary_join_element_wise(none, texts, space)
        a, a_at = self.a.encode(spaced)
        b, b_at = self.b.encode(texts)
        want = [np.frombuffer(x.as_buffer(), np.uint8) for x in spaced]
        out_a, out_b = [], []
        for k, text in enumerate(want):
            ids_a, ids_b = a[a_at[k] : a_at[k + 1]], b[b_at[k] : b_at[k + 1]]
            if len(text) == 1 or self.spell_a.differs(ids_a, text) or self.spell_b.differs(ids_b, text):
                ids_a = ids_b = a[:0]
            out_a.append(ids_a.astype(np.int64))
            out_b.append(ids_b.astype(np.int64))
        return out_a, out_b

    def stretches(self, a: list[np.ndarray], b: list[np.ndarray], limit: int) -> Iterator[tuple[pa.Table, pa.Table]]:
        """Tables of token intervals (doc, pos, id, since, till) of about ``limit`` bytes, on one axis of bytes."""
        held: list[list[tuple]] = [[], []]
        base, pos = 0, [0, 0]

        def table(rows: list[tuple]) -> pa.Table:
            return pa.table({n: np.concatenate([r[i] for r in rows]) for i, n in enumerate(("doc", "pos", "id", "since", "till"))})

        for doc, ids in enumerate(zip(a, b)):
            ends = [np.cumsum(s.lengths[x]) for s, x in zip((self.spell_a, self.spell_b), ids)]
            total = int(ends[0][-1]) if len(ends[0]) else 0
            done = [0, 0]
            for cut in [*_cuts(ends[0], ends[1], limit), total] if total else []:
                for i in range(2):
                    stop = int(np.searchsorted(ends[i], cut, side="right"))
                    till = ends[i][done[i] : stop]
                    part = ids[i][done[i] : stop]
                    lengths = (self.spell_a, self.spell_b)[i].lengths[part]
                    held[i].append((np.full(len(part), doc), np.arange(len(part)) + pos[i], part, base + till - lengths, base + till))
                    pos[i] += len(part)
                    done[i] = stop
                if int(held[0][-1][4][-1]) - int(held[0][0][3][0]) >= limit:
                    yield table(held[0]), table(held[1])
                    held = [[], []]
            base += total
        if held[0]:
            yield table(held[0]), table(held[1])

    def rows(self, sql: str) -> list[np.ndarray]:
        found = self.con.sql(sql).to_arrow_table()
        return [found[c].to_numpy() for c in found.column_names]


def _cuts(a: np.ndarray, b: np.ndarray, limit: int) -> list[int]:
    """Ends of tokens of both, about every ``limit`` bytes, before the last."""
    cuts, mark, last = [], limit, int(a[-1])
    while mark < last:
        for end in a[np.searchsorted(a, mark) :].tolist():
            at = int(np.searchsorted(b, end))
            if b[at] == end:
                break
        if end >= last:
            break
        cuts.append(end)
        mark = end + limit
    return cuts


def _aligned(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str, spell: bool, stretch: int) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(byte_level, pieces)
    con = aligner.con
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            a, b = aligner.encode(part.column(part.schema.get_field_index("text")))
            n = part.num_rows
            sums = {c: np.zeros(n, np.int64) for c in ("n_links", "n_groups", "n_overlaps")}
            digests: list = [None] * n
            texts: list[list[str]] = [[] for _ in range(n)]
            pair_doc, pair_id, pair_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for rows_a, rows_b in aligner.stretches(a, b, stretch):
                con.register("a", rows_a)
                con.register("b", rows_b)
                con.execute(LINKS)
                doc, links, groups = aligner.rows(COUNTS)
                sums["n_links"][doc] += links
                sums["n_groups"][doc] += groups
                doc, overlaps = aligner.rows(OVERLAPS)
                sums["n_overlaps"][doc] += overlaps
                for found, kept in zip(aligner.rows(PAIRS), (pair_doc, pair_id, pair_n)):
                    kept.append(found.astype(np.int64))
                _, doc, a_last, b_last = aligner.rows(GROUPS)
                sides = [(x["id"].to_numpy(), x["pos"][0].as_py()) for x in (rows_a, rows_b)]
                (ids_a, first_a), (ids_b, first_b) = sides
                for k, spelled in aligner.digits.spell(ids_a, ids_b, doc, a_last - first_a, b_last - first_b):
                    if digests[k] is None:
                        digests[k] = hashlib.sha256()
                    else:
                        spelled = b";" + spelled
                    digests[k].update(spelled)
                    if spell:
                        texts[k].append(spelled.decode())
                con.unregister("a")
                con.unregister("b")
            doc, pair, times = (np.concatenate(x) for x in (pair_doc, pair_id, pair_n))
            order = np.lexsort((pair, doc))
            cuts = pa.array(np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array([len(x) for x in a], pa.int64()), pa.array([len(x) for x in b], pa.int64()),
                    pa.array(sums["n_groups"]), pa.array(sums["n_links"]), pa.array(sums["n_overlaps"]),
                    pa.array(["".join(x) if spell else None for x in texts], pa.string()),
                    pa.array([x.hexdigest() if x else "" for x in digests], pa.string()),
                    pa.ListArray.from_arrays(cuts, pa.array(pair[order])), pa.ListArray.from_arrays(cuts, pa.array(times[order].astype(np.int32))),
                ],
                names=[f.split()[0] for f in FIELDS.split(", ")],
            )


def align(
    docs: DataFrame, byte_level: str, pieces: str, *, id_col: str = "doc_id", text_col: str = "text", spell: bool = False, hot_pairs: int = HOT_PAIRS, stretch: int = STRETCH
) -> DataFrame:
    """One row for each row of ``docs``: how a byte-level BPE (A, of a space and the text) and a SentencePiece model (B, of the text) cut it.

    Returns doc_id, n_a and n_b (tokens), n_groups (stretches between the places where tokens of both end), n_links (pairs of
    tokens that end together), n_best (links whose pair is the corpus' most frequent of its B id, or as frequent as that),
    count_sum (over the links, how many links of the corpus have their pair), n_overlaps (pairs of tokens that share bytes), groups
    (with ``spell``: ``a1,a2|b1;a3|b2,b3``, else null) and its SHA-256.

    Special tokens' strings are ordinary text. Null and empty texts, and texts that a tokenizer changes, so that its tokens don't
    spell them, have zeros and an empty digest. Null and repeated ids keep their rows; texts of any length are read whole, with
    joins of bounded size; other columns are left out; an empty table gives none."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run = lambda batches: _aligned(batches, byte_level, pieces, spell, stretch)
    done = materialize(map_batches(rows, run, FIELDS), "aligned")
    used = done.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = materialize(used.groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("highest"))  # a row for each id of B's vocabulary, at most
    known = counts.withColumn("b", b_id).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    sizes = counts.agg(*[F.count_if(F.col("n") >= f).alias(str(f)) for f in FLOORS]).first()
    floor = next((f for f, size in zip(FLOORS, sizes, strict=True) if size <= hot_pairs), FLOORS[-1])
    hot = F.broadcast(known.where(F.col("n") >= floor))

    def sums(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    scored = sums(used.join(hot, "pair"))
    if floor > 1:  # else no pair is left
        cold = used.join(hot.select("pair"), "pair", "left_anti").join(known.where(F.col("n") < floor), "pair")
        scored = scored.unionByName(sums(cold)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = done.drop("pairs", "times").join(scored, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "n_overlaps", "groups", "groups_sha256")
