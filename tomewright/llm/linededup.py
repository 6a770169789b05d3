"""Removal of repeated line runs, by a suffix array over line ids (operator 9).

Documents are sequences of the ids of their lines with a word. Lines that occur once in the
corpus end every repeated run, so only stretches of repeated lines enter the suffix array.
Prefix doubling orders their suffixes: the rank of 2k lines is the order of the pairs (rank of k
lines, rank of the k lines after), found by a distributed sort of the distinct pairs, and
dealt back by a join. Suffixes that share their first n lines are an interval of the suffix array
with a longest common prefix of n or more, and two ranks of the largest power of two within n name it.

A run counts if it has MIN_WORDS words or more. The shortest such runs from every line, and up to every
line, are held against their intervals: if one has an earlier member, its lines are a later copy and go.
Every maximal repeated run is the union of such runs, so it goes whole and nothing else does. A run
of MIN_WORDS words has at most MIN_WORDS lines, so the doubling ends after log2(MIN_WORDS) rounds
whatever the corpus.

"Earlier" is by doc_id, then by row, then by line. Lines without words are never deleted and
don't interrupt a run. Defined results: null texts stay null; repeated rows are copies of the first;
null doc_ids come first; an empty table gives no rows; other columns are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewright.llm.textbatches import map_batches
from tomewright.operators.ordered import prefix_sum
from tomewright.session import forget, materialize

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"


def sequences(rows: DataFrame) -> DataFrame:
    """(row, start, ids, words) of each text of (row, doc_id, text): its lines' 128-bit hashes and numbers of words,
    and the number of lines in all texts before."""
    with_words = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(_WORD))
    lines = rows.where(F.col("text").isNotNull()).select("row", "doc_id", with_words.alias("lines")).where(F.size("lines") > 0)
    lines = lines.select(
        "row", "doc_id", F.size("lines").cast("long").alias("n"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("ids"), F.transform("lines", lambda x: F.regexp_count(x, F.lit(_WORD))).alias("words"),
    )
    lines = materialize(lines, "lines")
    starts = prefix_sum(lines.select("row", "doc_id", "n"), "doc_id", "n", "start", ties=["row"])
    found = materialize(lines.join(starts.select("row", "start"), "row").select("row", "start", "ids", "words"), "sequences")
    forget(lines)
    return found


def stretches(texts: DataFrame) -> DataFrame:
    """(pos, seg, row, rank0, words) of each line that occurs twice or more; lines of a ``seg`` are neighbours,
    and equal lines have the same rank0."""
    lines = texts.select("row", "start", F.posexplode(F.arrays_zip("ids", "words")).alias("at", "x"))
    lines = lines.select("row", (F.col("start") + F.col("at")).alias("pos"), F.col("x.ids.a").alias("a"), F.col("x.ids.b").alias("b"), F.col("x.words").alias("words"))
    # a table, so that both sides of the join are plain exchanges, of which Spark splits a very common line's
    twice = lines.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b", F.monotonically_increasing_id().alias("rank0"))
    found = lines.join(materialize(twice, "repeated"), ["a", "b"])
    place = F.row_number().over(Window.partitionBy("row").orderBy("pos"))
    return found.withColumn("seg", F.col("pos") - place).select("pos", F.xxhash64("row", "seg").alias("seg"), "row", "rank0", "words")


def double(positions: DataFrame, level: int) -> tuple[DataFrame, list[DataFrame]]:
    """Add ``rank{level+1}``, the order of 2**(level+1) lines, from ``rank{level}``; also the tables that this reads."""
    k, own = 1 << level, f"rank{level}"
    after = F.lead(own, k).over(Window.partitionBy("seg").orderBy("pos"))
    paired = materialize(positions.withColumn("after", after), f"pairs{level}")
    # ids that grow with the range partition and the place in it are an order of the sorted pairs
    distinct = paired.select(own, "after").distinct()
    order = [F.col(own).asc(), F.col("after").asc_nulls_first()]
    ranks = materialize(distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rank", F.monotonically_increasing_id()), f"ranks{level}")
    ranked = ranks.select(F.col(own).alias("_own"), F.col("after").alias("_after"), "_rank")
    same = (paired[own] == ranked["_own"]) & paired["after"].eqNullSafe(ranked["_after"])
    return paired.join(ranked, same).drop("_own", "_after", "after").withColumnRenamed("_rank", f"rank{level + 1}"), [paired, ranks]


def suffix_ranks(positions: DataFrame, levels: int) -> tuple[DataFrame, list[DataFrame]]:
    """Ranks of 1, 2, 4, ... 2**levels lines of every position; also the tables that this reads."""
    spent: list[DataFrame] = []
    for level in range(levels):
        positions, read = double(positions, level)
        forget(*spent)
        spent = read
    return positions, spent


def _windows(min_words: int, levels: int):
    """Of each stretch, its shortest runs of enough words from and up to each line, with their intervals' names."""
    names = ["row", "pos", "n", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for k in range(batch.num_rows):
                line = batch.column(1)[k].values
                order = np.argsort(line.field(0).to_numpy())
                pos, words = (line.field(i).to_numpy()[order] for i in (0, 1))
                done = np.cumsum(words)
                before = done - words
                ahead = np.searchsorted(done, before + min_words, side="left")
                starts = np.flatnonzero(ahead < len(pos))
                back = np.searchsorted(before, done - min_words, side="right") - 1
                ends = np.flatnonzero(back >= 0)
                both = np.unique(np.stack([np.r_[starts, back[ends]], np.r_[ahead[starts], ends]], axis=1), axis=0)
                if not len(both):
                    continue
                first, n = both[:, 0], both[:, 1] - both[:, 0] + 1
                level = np.minimum(np.log2(n).astype(np.int64), levels)
                ranks = np.stack([line.field(2 + i).to_numpy()[order] for i in range(levels + 1)])
                for x, value in zip(out, (np.full(len(n), batch.column(0)[k].as_py()), pos[first], n, ranks[level, first], ranks[level, first + n - (1 << level)]), strict=True):
                    x.append(value)
            arrays = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run, ", ".join(f"{x} long" for x in names)


def later_copies(texts: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, pos, n): runs of n lines from the line of number pos (over all texts) that occur earlier too."""
    levels = max(0, min_words.bit_length() - 1)
    repeated = materialize(stretches(texts), "stretches")
    ranked, spent = suffix_ranks(repeated, levels)
    fields = ["pos", F.col("words").cast("long").alias("words"), *[f"rank{i}" for i in range(levels + 1)]]
    whole = ranked.groupBy("row", "seg").agg(F.collect_list(F.struct(*fields)).alias("lines")).select("row", "lines")
    windows = materialize(map_batches(whole, *_windows(min_words, levels)), "windows")
    forget(repeated, *spent)
    first = materialize(windows.groupBy("n", "a", "b").agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "intervals")
    return windows.join(first, ["n", "a", "b"]).where("first < pos").select("row", "pos", "n")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text, and two columns more:
    ``n_lines`` with a word before, and ``n_deleted`` of them."""
    kept = docs.withColumns({"__row": F.monotonically_increasing_id()})
    kept = materialize(kept, "documents")
    rows = kept.select(F.col("__row").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = sequences(rows)
    copies = later_copies(texts, min_words=min_words)
    runs = copies.groupBy("row").agg(F.collect_set(F.struct("pos", "n")).alias("runs"))
    cut = texts.select("row", "start", F.size("ids").cast("long").alias("n_lines")).join(runs, "row")
    # numbers, within the text, of the lines that go
    at = F.flatten(F.transform("runs", lambda x: F.sequence(x["pos"], x["pos"] + x["n"] - 1)))
    cut = cut.select(F.col("row").alias("__row"), F.array_sort(F.array_distinct(F.transform(at, lambda x: (x - F.col("start")).cast("int")))).alias("__gone"))
    both = kept.join(cut, "__row", "left").drop("__row")
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = str.maketrans("", "", " \t\n\x0b\x0c\r")
        for batch in batches:
            by_name = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            texts, gone = by_name[text_col], by_name["__gone"]
            # a line with a word is matched from the word to its end
            counts = pc.fill_null(pc.count_substring_regex(texts, pattern=r"[^\x20\x09-\x0D][^\n]*"), 0).cast(pa.int64())
            changed = pc.is_valid(gone)
            made = []
            for text, at in zip(texts.filter(changed).to_pylist(), gone.filter(changed).to_pylist(), strict=True):
                lines = text.split("\n")
                real = [k for k, x in enumerate(lines) if x.translate(white)]
                drop = {real[k] for k in at}
                made.append("\n".join(x for k, x in enumerate(lines) if k not in drop))
            by_name[text_col] = pc.replace_with_mask(texts, changed, pa.array(made, texts.type))
            deleted = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(by_name[c] for c in names), counts, deleted], names=[*names, "n_lines", "n_deleted"])

    return map_batches(both.select(*names, "__gone"), run, f"{kinds}, n_lines long, n_deleted long")
