"""The training-data operators against brute force, their libraries, and SQL."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomewright.llm import idstore, jaccard, linededup, neighbours, packing, ppm, quality, queries, rules, sentencepieces, textbatches, urlfilter

ODD = ["", " ", "  ", " a", "a ", "a  b", "a   b", " \n", "a \n b", "a\n \nb", "\n \n", "a\tb  ", "▁x ▁", "日本語 テキスト", "😀 é̀ x", "<s> </s> <unk> <0x0A>", "x" * 300, "ab " * 50, "Σίσυφος ΟΔΟΣ", "İstanbul", "<|endoftext|> a", "\x00 b", "don't we'll", "a\x1c b \x1c", "a\r\n b"]
TEXT = st.text(alphabet=st.sampled_from("ab \n\t　é.▁1's😀"), max_size=30)
WIDE = "doc_id long, text string, score string, n_lines string"


def wide(spark, rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], WIDE)


@pytest.fixture(scope="module")
def encoder():
    return sentencepieces.MergeEncoder(public_tokenizers.path("piece_bpe_32k.model"))


def lists(flat, offsets):
    return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_agenda_equals_library(encoder):
    assert lists(*encoder.encode(pa.array(ODD, pa.large_string()))) == encoder.library.encode(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_agenda_equals_library_on_any_text(encoder, texts):
    assert lists(*encoder.encode(pa.array(texts, pa.large_string()))) == encoder.library.encode(texts)


SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "a\n <|endoftext|>\n<|startoftext|>c, d.", "x <|EndOfText|>!<|endoftext|", "one<|startoftext|>  two"]


def plain_library(name, special_as_text=False):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", "kept"), ("word_bpe_49k.json", "dropped")])
def test_distinct_pieces_equal_whole_texts(name, spaces, special_as_text):
    tokenizer = textbatches.DistinctWordTokenizer(public_tokenizers.path(name), spaces, special_as_text=special_as_text)
    rng = random.Random(3)
    texts = ODD + SPECIAL + ["".join(rng.choice("abÉß \n\t　é.,!▁1'sΣİ") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(rng.choice(["the", " cat", " dog's", ",", "...", "\n", "\n\n", " ", "<|endoftext|>", "'ll", "Été"]) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    texts.append("word, " * 200_000)
    want = [x.ids for x in plain_library(name, special_as_text).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        assert lists(*tokenizer.encode(pa.array(texts, pa.large_string()))) == want


def test_op1(spark, encoder):
    docs = wide(spark, [(i, x) for i, x in enumerate([*ODD, None, "twice", "twice"])])
    got = {r.doc_id: r for r in sentencepieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("ids", "decoded", "n_tokens", "ids_sha256")).collect()}
    for i, x in enumerate([*ODD, "", "twice", "twice"]):
        ids = [1, *encoder.library.encode(x), 2]
        assert got[i].ids == ids and got[i].decoded == encoder.library.decode(ids) and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sentencepieces.encode_documents(docs.where("false"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_op2(spark):
    rng = random.Random(1)
    texts = [*ODD, *SPECIAL, None, *[" ".join(rng.choice(["one", "two,", "three3"]) for _ in range(rng.randint(1, 300))) for _ in range(120)], "word " * 1000, "twice", "twice"]
    docs = wide(spark, list(enumerate(texts)))
    rows = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=256).toPandas()
    tokenizer = plain_library("word_bpe_49k.json")
    for i, x in enumerate(tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        ids, mine = np.array([*x.ids, 1], "<u4"), rows[rows.doc_id == i].sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids), 256)) and mine.length.sum() == len(ids)
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 256].tobytes()) for a in range(0, len(ids), 256)]
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 256
    decreasing = packing.Breeder(rows.length.tolist(), 256, 0).seed(0.0)
    assert -(-rows.length.sum() // 256) <= rows.sequence_id.nunique() <= len(decreasing)
    assert packing.pack_documents(docs.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(0)
    b = packing.Breeder(rng.integers(1, 100, 300).tolist(), 100, 1)
    child = b.cross(b.seed(0.3), b.seed(0.5))
    assert sorted(i for x in child for i in x) == list(range(300)) and max(map(b.fill, child)) <= 1
    assert len(b.breed([])) <= len(b.seed(0.0))


def test_islands_breed_real_pieces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lengths = [r.length for r in packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1).collect() if r.length < 4096]
    b = packing.Breeder(lengths, 4096, 5)
    first = b.fitness(b.seed(0.0))
    best = b.breed([])
    assert b.crossings == 2 * packing.GENERATIONS and b.gains > 0 and b.fitness(best) < first
    assert sorted(i for x in best for i in x) == list(range(len(lengths))) and max(map(b.fill, best)) <= 1


def exact_classes(texts, size=5, threshold=0.8):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append(frozenset([tuple(w[k : k + size]) for k in range(len(w) - size + 1)] or ([tuple(w)] if w else [])))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.defaultdict(set)
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            root[max(find(a), find(b))] = min(find(a), find(b))
            if (texts[a] or "").split() != (texts[b] or "").split():
                links[a].add(" ".join(texts[b].split()))
                links[b].add(" ".join(texts[a].split()))
    return [find(i) for i in range(len(texts))], [len(links[i]) for i in range(len(texts))]


def near_copies(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "a b", "a b", "a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 120))]
        texts += [" ".join(base), "  ".join(base)]
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


def test_op3_equals_brute_force(spark, monkeypatch):
    texts = near_copies()
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # so that buckets have many tiles
    got = {r.doc_id: r for r in jaccard.join_documents(wide(spark, list(enumerate(texts)))).collect()}
    classes, links = exact_classes(texts)
    assert [got[i].class_id for i in range(len(texts))] == classes
    assert [got[i].n_links for i in range(len(texts))] == links
    kept = {r.doc_id for r in jaccard.keep_one(wide(spark, list(enumerate(texts)))).collect()}
    assert kept == set(classes)


def test_op3_empty_and_repeated_rows(spark):
    assert jaccard.join_documents(wide(spark, []).where("false")).count() == 0
    rows = jaccard.join_documents(wide(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y"), (2, "a b c d e f")])).collect()
    assert len(rows) == 4 and {(r.doc_id, r.class_id, r.n_copies) for r in rows} == {(1, 1, 3), (2, 1, 3), (None, None, 1)}


def test_pruning_floors_rise_with_evidence():
    floors = jaccard.least_matches(0.8)
    assert list(floors) == list(range(16, 129, 16)) and floors[128] > 70
    rng = np.random.default_rng(0)
    drawn = (rng.random((20_000, 128)) < 0.8).cumsum(axis=1)
    lost = np.any([drawn[:, n - 1] < f for n, f in floors.items()], axis=0).mean()
    assert lost < 1e-3


def test_op4_recall_and_measure(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((12, 16))
    points = centers[rng.integers(0, 12, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    points[:200] = points[0]  # many equal vectors
    rows = [(i, [float(np.float32(x)) for x in p], "x") for i, p in enumerate(points)]
    rows += [(5000, None, "x"), (5001, [0.0] * 16, "x"), (5002, [float("nan")] * 16, "x"), (5003, [1.0, None] * 8, "x"), (5004, [1.0], "x"), (7, rows[7][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0).toPandas()
    exact = np.array([r[1] for r in rows[:3000]])
    hits = 0
    for q, mine in got.groupby("query_id"):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.argsort(d, kind="stable")[:10]
        mine = mine.sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.array_equal(mine.score.to_numpy(), d[mine.vec_id])
        hits += len(set(best) & set(mine.vec_id))
    assert got.query_id.nunique() == 30 and hits / 300 >= 0.9
    few = neighbours.search(df.where("vec_id IN (0, 300, 301)"), F.col("vec_id") % 100 == 0).collect()
    assert len(few) == 4
    assert neighbours.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def unit_vectors(n, dim=64):
    points = np.random.default_rng(8).standard_normal((n, dim))
    return (points / np.linalg.norm(points, axis=1)[:, None]).astype(np.float32).astype(np.float64)


def test_op4_recall_of_unstructured_vectors_in_many_lists(spark):
    points = unit_vectors(4000)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    got = neighbours.search(df, F.col("vec_id") % 100 == 0, list_rows=16).toPandas()
    hits = 0
    for q, mine in got.groupby("query_id"):
        d = np.sqrt(((points - points[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10]) & set(mine.vec_id))
    assert got.query_id.nunique() == 40 and hits / 400 >= 0.98


def test_op4_replicates_unstructured_vectors():
    points = unit_vectors(4000).astype(np.float32)
    index = neighbours.ListIndex.of(neighbours.balanced_centroids(points, 100))
    row, lists = index.postings(points)
    assert len(row) / len(points) > 1.5 and len({*zip(row.tolist(), lists.tolist(), strict=True)}) == len(row)


def test_op4_ratio_selects_lists(spark):
    """Queries read the lists within the ratio, some few and some many, and the graph leads to them."""
    rng = np.random.default_rng(4)
    centers = 6 * rng.standard_normal((40, 16))
    points = (centers[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 16))).astype(np.float32)
    index = neighbours.ListIndex.of(neighbours.balanced_centroids(points, 60))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points.astype(float))], "vec_id long, v array<double>")
    ratio, most = neighbours.fit_ratio(df, df.where("vec_id % 50 = 0"), index, 10)
    asked = points[::50]
    row, lists = index.lists(asked, ratio, most)
    reads = np.bincount(row, minlength=len(asked))
    assert 1 <= reads.min() < reads.max() < len(index.centroids) and reads.mean() < 0.7 * len(index.centroids) and ratio > 1, (reads.min(), reads.mean(), reads.max(), ratio)
    d = neighbours.distances(asked, index.centroids)
    near = np.maximum(d.min(1), neighbours.LEAST * index.spacing.mean())
    nth = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable")
    want = {(i, j) for i, j in zip(*np.nonzero((d <= ratio * near[:, None] * (1 - 1e-4)) & (nth < most)))}
    got = {*zip(row.tolist(), lists.tolist(), strict=True)}
    assert len(want - got) <= 0.01 * len(want) and all(d[i, j] <= ratio * near[i] * (1 + 1e-4) for i, j in got)


def test_op5_round_trip(spark, tmp_path):
    texts = [*ODD, *SPECIAL, None, "same passage here " * 200, "x" + "same passage here " * 200, "twice"]
    docs = wide(spark, [*enumerate(texts), (len(texts) - 1, "twice")])
    store = idstore.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/store", end_id=2)
    store.verify()
    tokenizer = plain_library("byte_bpe_50k.json")
    ids = [[*x.ids, 2] for x in tokenizer.encode_batch([t or "" for t in [*texts, "twice"]], add_special_tokens=False)]
    starts = np.cumsum([0, *map(len, ids)])
    rows = sorted(store.checksums().collect(), key=lambda r: r.start)
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in rows] == [(starts[i], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]
    assert [r.ids for r in sorted(store.streams().collect(), key=lambda r: r.start)] == ids
    chunks = store.chunks()
    assert chunks.count() == chunks.select("key").distinct().count() < store.recipes().select(F.explode("chunks")).count()
    empty = idstore.write_store(docs.where("false"), public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/none", end_id=2)
    assert empty.checksums().count() == 0


def test_op5_finds_a_changed_chunk(spark, tmp_path):
    store = idstore.write_store(wide(spark, [(1, "a b c"), (2, "d e f")]), public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/store", end_id=2)
    bad = spark.read.schema(idstore.ROWS).parquet(store.path + "/rows").withColumn("payload", F.when(F.col("kind") == 0, F.unhex(F.lit("01000200"))))
    bad.write.partitionBy("kind").parquet(f"file://{tmp_path}/bad/rows")
    with pytest.raises(Exception, match="isn't what its address says"):
        idstore.IdStore(spark, f"file://{tmp_path}/bad", 2).checksums().collect()


def test_manifest_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idstore, "BLOCK_IDS", 4)
    monkeypatch.setattr(idstore, "FAN", 3)
    docs = wide(spark, [(i, f"text number {i} of a few words") for i in range(40)])
    store = idstore.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/store", end_id=2)
    assert store.manifest().count() > 9
    store.verify()
    assert store.top_root() == store.top_root() and len(store.top_root()) == 64


def test_crc_of_joined_parts():
    a, b, c = b"abc", b"defghij" * 9, b"x"
    parts = [a, b, c]
    after = [len(b) + len(c), len(c), 0]
    moved = idstore.crc_shift(np.array([zlib.crc32(x) for x in parts], np.uint32), np.array(after))
    assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(a + b + c)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])


def test_op6_edges(spark):
    pages = spark.sql("""SELECT * FROM VALUES (1, 'https://A.b.example.com:80/en/x?y', timestamp '2024-01-10 00:00:00'), (2, 'https://a.b.example.com/en/x', timestamp '2024-01-20 00:00:00'),
      (3, NULL, timestamp '2024-01-10 00:00:00'), (4, 'http://b.example.com/', NULL), (5, 'junk', timestamp '2024-01-10 00:00:00'), (6, 'http://u@b.example.com./EN', timestamp '2024-01-10 00:00:00') AS t(page_id, url, fetched)""")
    entries = spark.sql("""SELECT * FROM VALUES ('l', 'domain', 'B.example.com', 'add', timestamp '2024-01-05 00:00:00'), ('l', 'domain', 'b.example.com', 'remove', timestamp '2024-01-15 00:00:00'),
      ('m', 'prefix', 'a.b.example.com/en', 'add', timestamp '2024-01-01 00:00:00'), ('m', 'prefix', 'a.b.example.com/en', 'add', timestamp '2024-01-01 00:00:00'), ('n', 'host', 'b.example.com', 'add', timestamp '2024-02-01 00:00:00') AS t(list, kind, key, action, at)""")
    got = {r.page_id: (r.n_lists, r.list) for r in urlfilter.evaluate(pages, entries).collect()}
    assert got == {1: (2, "l"), 2: (1, "m"), 3: (0, None), 4: (0, None), 5: (0, None), 6: (1, "l")}
    capitals = spark.sql("SELECT 'm' AS list, 'prefix' AS kind, explode(array('A.B.Example.com/en/', 'B.example.com/en')) AS key, 'add' AS action, timestamp '2024-01-01 00:00:00' AS at")
    assert {r.page_id for r in urlfilter.evaluate(pages, capitals).where("blocked").collect()} == {1, 2}
    assert urlfilter.evaluate(pages, entries.where("false")).where("blocked").count() == 0
    assert urlfilter.evaluate(pages.where("false"), entries).count() == 0


def test_op7_held_out_accuracy(spark):
    rows = queries.QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((held.predicted == held.quality).mean()) >= 0.95 and rows.score.between(0, 1).all()


def test_op7_edges(spark):
    docs = wide(spark, [(1, None), (2, ""), (3, "good words here " * 20), (3, "good words here " * 20), (4, "bad bad$$ bad$$"), (6, "x" * 5000)])
    labels = spark.createDataFrame([(3, 1), (4, 0), (9, 1), (None, 0), (2, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scored = quality.score_documents(docs, model)
    assert scored.count() == 6 and scored.columns == ["doc_id", "text", "n_lines", "score"] and scored.where("score < 0 OR score > 1").count() == 0
    nothing = quality.train(docs, labels.where("false"))
    assert {r.score for r in quality.score_documents(docs, nothing).collect()} == {0.5}


def test_op7_totals_are_averages():
    texts = pa.array(["the cat the", "", "  b\n"], pa.large_string())
    f = quality.Features.of(texts)
    weight = np.random.default_rng(0).standard_normal(quality.BUCKETS).astype(np.float32)
    value, number = f.totals(weight)
    for k, (idx, share) in enumerate(f.rows()):
        assert math.isclose(value[k] / max(1, number[k]), float(weight[idx].astype(float) @ share), rel_tol=1e-5, abs_tol=1e-6)


def words_of(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_op8_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [*ODD, None, *["".join(rng.choice(["a ", "b ", "c\n", "# ", "dd ", "\t\n"]) for _ in range(rng.randint(0, 150))) for _ in range(60)], "x y z " * 60, "ab\n" * 80]
    got = {r.doc_id: r for r in rules.measure(wide(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = words_of(t)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if words_of(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
        assert r.kept == (r.failed_rule is None and not r.base_failed)
    kept = {r.doc_id for r in rules.filter_documents(wide(spark, list(enumerate(texts)))).collect()}
    assert kept == {i for i, r in got.items() if r.kept}
    assert rules.measure(wide(spark, []).where("false")).count() == 0


def test_rejected_rows_skip_costly_rules(spark):
    bomb = rules.Rule("bomb", lambda t: F.raise_error(F.concat(F.lit("asked "), F.left(t, F.lit(20)))).cast("boolean"))
    cheap = rules.Rule("cheap", lambda t: F.contains(t, F.lit("stop")))
    short, loops = (0, "a b stop"), (1, "one two three " * 40)
    stopped = (2, " ".join(f"w{i}" for i in range(60)) + " stop")
    rows = rules.measure(wide(spark, [short, loops, stopped]), [*rules.production_rules(), cheap, bomb], in_order=True)
    assert {r.doc_id: r.failed_rule for r in rows.collect()} == {0: "too_few_words", 1: "repeated_words", 2: "cheap"}
    left = wide(spark, [(3, " ".join(f"w{i}" for i in range(60)))])
    with pytest.raises(Exception, match="asked w0"):
        rules.measure(left, [cheap, bomb], in_order=True).collect()


def test_rules_are_ordered_by_rejection_per_cost(spark):
    docs = wide(spark, [(i, f"text {i} " + "x " * (i % 7)) for i in range(20_000)])
    assert 100 < rules.sample(docs, "text").count() <= rules.SAMPLE_ROWS
    a, b, c = (rules.Rule(x, lambda t: F.lit(True)) for x in "abc")
    assert [r.name for r in rules.by_gain([(a, 1.0, 0.1), (b, 0.1, 0.1), (c, 0.01, 0.0)])] == ["b", "a", "c"]


def test_op8_very_long_text(spark):
    text = "\n".join(f"line {i % 50000} of a long text" for i in range(120_000))
    (row,) = rules.measure(wide(spark, [(0, text)])).collect()
    w = text.split()
    again = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    marks = {p for i in range(len(w) - 2) if again[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    assert (row.n_words, row.n_dup_lines, row.n_repeat_words) == (len(w), 70_000, len(marks))



def test_op8_has_no_python_in_its_plan(spark):
    plan = rules.measure(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_op9_edges(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    half, other = " ".join(f"h{i}" for i in range(30)), " ".join(f"k{i}" for i in range(30))
    docs = wide(spark, [(3, f"new\n{passage}\nend"), (1, f"a\n{passage}\nb"), (2, None), (4, ""), (5, f"{half}\n\n{other}"), (6, f"{other}\n{half}"), (7, f"x\n{half}\n{other}\ny"), (8, "short\nshort"), (8, "short\nshort")])
    got = sorted((r.doc_id, r.text, r.n_deleted) for r in linededup.dedup_lines(docs).where("text IS NOT NULL").collect())
    assert got == sorted([(1, f"a\n{passage}\nb", 0), (3, "new\nend", 1), (4, "", 0), (5, f"{half}\n\n{other}", 0), (6, f"{other}\n{half}", 0), (7, "x\ny", 2), (8, "short\nshort", 0), (8, "short\nshort", 0)])
    assert linededup.dedup_lines(docs).columns == ["doc_id", "text", "score", "n_lines", "n_deleted"]
    assert linededup.dedup_lines(docs.where("false")).count() == 0


def test_op9_ranks_are_a_suffix_array(spark):
    rng = random.Random(6)
    seq = {r: [rng.choice("ab") for _ in range(rng.randint(2, 9))] for r in range(12)}
    rows = [(r * 100 + k, r, r, ord(c), 1) for r, s in seq.items() for k, c in enumerate(s)]
    ranked = linededup.suffix_ranks(spark.createDataFrame(rows, "pos long, seg long, row long, rank0 long, words int"), 2)[0].collect()
    key = lambda r, n: seq[r.row][r.pos % 100 : r.pos % 100 + n]
    for n, name in ((1, "rank0"), (2, "rank1"), (4, "rank2")):
        for a, b in itertools.combinations(ranked, 2):
            assert (key(a, n) < key(b, n)) == (a[name] < b[name]) and (key(a, n) == key(b, n)) == (a[name] == b[name])


def brute_ppm(train, text, order):
    seen = collections.defaultdict(collections.Counter)
    pad = lambda t: bytes([ppm.END]) * order + "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode() + bytes([ppm.END])
    for b in map(pad, train):
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen[b[i - k : i]][b[i]] += 1
    b, total = pad(text), 0.0
    for i in range(order, len(b)):
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            live = {s: n for s, n in seen.get(b[i - k : i], {}).items() if s not in excluded}
            if not live:
                continue
            under = sum(live.values()) + len(live)
            if b[i] in live:
                total += math.log10(live[b[i]] / under)
                break
            total += math.log10(len(live) / under)
            excluded |= set(live)
        else:
            total -= math.log10(256 - len(excluded))
    return total


@pytest.mark.parametrize(("order", "hot"), [(2, 5), (5, 1000)])
def test_op10_equals_brute_force(spark, order, hot):
    rng = random.Random(2)
    texts = [None, "", "zzz", "ÿé", "a" * 50, *["".join(rng.choice("abAB é\n") for _ in range(rng.randint(0, 60))) for _ in range(60)]]
    rows = [*enumerate(texts), (5, texts[5])]
    got = ppm.score_documents(wide(spark, rows), order=order, hot_words=hot).toPandas()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    train = [t or "" for i, t in rows if not held(i)]
    counts = collections.Counter(w for t in train for w in words_of(low(t)))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for r in got.itertuples():
        w = words_of(low(texts[r.doc_id]))
        base = sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(counts[x] for x in w), len(train)])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w) + 1, sum(x in counts for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, brute_ppm(train, texts[r.doc_id] or "", order), rel_tol=1e-9, abs_tol=1e-9)


def odd_texts():
    rng = random.Random(4)
    return [None, "", "zzz", *["".join(rng.choice("abAB é\n") for _ in range(rng.randint(0, 60))) for _ in range(40)]]


@pytest.mark.parametrize(("order", "crowded"), [(1, 5), (5, 1000), (5, 8)])
def test_op10_keeps_all_nodes(spark, order, crowded):
    """Few frequent grams, many buckets and crowded endings give what the whole trie gives."""
    texts = odd_texts()
    df = wide(spark, [*enumerate(texts)]).select("doc_id", "text")
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    train = [t or "" for t, h in zip(texts, held, strict=True) if not h]
    counts = ppm.count(df, ~ppm.held_out(F.col("doc_id")), order=order).where(F.col("kind") == ppm.GRAM).select("key", "n", "every")
    got = {r.key: r.value for r in ppm.code_lengths(counts, order, bucket=20, crowded=crowded).collect()}
    for t in texts:
        keys, _ = ppm.grams(pa.array([t or ""], pa.large_string()), order)
        assert math.isclose(sum(got[k] for k in keys.view(np.int64).tolist()), brute_ppm(train, t or "", order), rel_tol=1e-9, abs_tol=1e-9)


def test_op10_joins_what_is_not_frequent(spark):
    texts = odd_texts()
    train = [t or "" for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = ppm.score_documents(wide(spark, [*enumerate(texts)]), hot_grams=3).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r.score, brute_ppm(train, texts[r.doc_id] or "", ppm.ORDER), rel_tol=1e-9, abs_tol=1e-9)


def test_op10_pruned_trie_is_a_distribution():
    texts = pa.array(["abracadabra", "abraham", "cadabra"], pa.large_string())
    key, _ = ppm.grams(texts, 3)
    keys, n = np.unique(key, return_counts=True)
    ks, ls, ns = [], [], []
    for length in range(1, 5):
        cut, inverse = np.unique(keys & np.uint64((1 << 8 * length) - 1), return_inverse=True)
        times = np.bincount(inverse, weights=n)
        keep = (times >= 2) | (length <= 2)
        ks, ls, ns = [*ks, cut[keep]], [*ls, np.full(keep.sum(), length)], [*ns, times[keep]]
    trie = ppm.Trie.of(np.concatenate(ks).astype(np.int64), np.concatenate(ls), np.concatenate(ns).astype(np.int64), 3)
    for context in (b"abr", b"bra", b"zzz", b"\xff\xff\xff"):
        every = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert math.isclose((10 ** trie.log10(every)).sum(), 1, rel_tol=1e-9)


def test_op10_without_training(spark):
    rows = ppm.score_documents(wide(spark, [(1, "a")]).where(ppm.held_out(F.col("doc_id")) | F.lit(True)).where("false"))
    assert rows.count() == 0
    some = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = ppm.score_documents(wide(spark, [(some, "ab")])).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.score, -3 * math.log10(256))


def test_slices_stand_alone():
    """Slices of a batch, nulls included, give what their texts give by themselves."""
    texts = ["Ab c", None, "", "Zz\nY " * 9, "é A"] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    seen = []
    for part in textbatches.slices(batch, limit=50):
        key, offsets = ppm.grams(part.column(1), 3)
        hashes, picks, cuts = ppm.words(part.column(1))
        for k, t in enumerate(part.column(1).to_pylist()):
            alone, _ = ppm.grams(pa.array([t], pa.large_string()), 3)
            h, p, _ = ppm.words(pa.array([t], pa.large_string()))
            assert key[offsets[k] : offsets[k + 1]].tolist() == alone.tolist()
            assert hashes[picks[cuts[k] : cuts[k + 1]]].tolist() == h[p].tolist()
            seen.append(t)
    assert seen == [t or "" for t in texts]


def test_op7_passes_over_texts_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 4000)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels, prior: seen.append((texts, labels)))
    first = [r.id for r in spark.range(400).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").collect()]
    # in hash order: labels without documents, then long texts, then short ones; class 1 has long ones only
    docs = [(i, "long " * 1000) for i in first[20:40]] + [(i, "short one") for i in first[40:80]] + [(i, "much " * 1000) for i in first[80:90]]
    labels = [(i, 0) for i in first[:80]] + [(i, 1) for i in first[80:90]]
    quality.train(wide(spark, docs).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int"), rows=30)
    texts, classes = seen[0]
    assert classes.count(0) == 30 and classes.count(1) == 1 and set(texts) - {"short one"} == {("much " * 1000)[:500]}


def test_op2_pools_the_last_sequences_of_shards(spark, monkeypatch):
    """Pieces of like lengths fill no sequence well; each shard's last one is pooled nevertheless."""
    monkeypatch.setattr(packing, "SHARD", 50)
    pieces = spark.range(600).select(F.col("id").alias("item"), F.lit(30).cast("long").alias("length"))
    got = packing.pack(pieces, 100).toPandas()
    assert len(got) == 600 and got.item.nunique() == 600 and not got.duplicated(["sequence_id", "offset"]).any()
    assert got.sequence_id.nunique() == 200


def test_op5_recipes_lie_in_order(spark, tmp_path):
    docs = wide(spark, [(i * 37 % 101, f"text {i} " * (i % 7)) for i in range(101)]).repartition(5)
    idstore.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/store", end_id=2).verify()
    files = sorted((tmp_path / "store/rows/kind=1").glob("part-*.parquet"))
    rows = [r for f in files for r in pq.read_table(f, partitioning=None).to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(101))
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()


def test_very_long_texts(spark, encoder):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(200_000))
    docs = wide(spark, [(0, long), (1, long + " end of it"), (2, "short text of no more than nine words here"), (3, "")])
    (row,) = sentencepieces.encode_documents(docs.where("doc_id = 0"), public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256")).collect()
    ids = [1, *encoder.library.encode(long), 2]
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    found = {r.doc_id: r for r in jaccard.join_documents(docs).collect()}
    assert (found[1].class_id, found[1].n_links, found[2].n_links) == (0, 1, 0)
    lines = "\n".join(f"line {i} with some words of its own" for i in range(30_000))
    left = {r.doc_id: r for r in linededup.dedup_lines(wide(spark, [(0, lines), (1, "a\n" + lines + "\nb")])).collect()}
    assert (left[0].n_deleted, left[1].n_deleted, left[1].text) == (0, 30_000, "a\nb")


def test_long_url_has_only_prefixes_that_entries_have(spark):
    url = "http://a.example/" + "x/" * 3000
    pages = spark.createDataFrame([(1, url, "2024-01-05", "clash"), (2, "http://b.example/y", "2024-01-05", "clash")], "page_id long, url string, fetched string, list string")
    entries = spark.createDataFrame([("l", "prefix", "a.example/x/x", "add", "2024-01-01")], "list string, kind string, key string, action string, at string").withColumn("at", F.to_timestamp("at"))
    assert urlfilter.depth_of(entries) == 2
    (size,) = pages.where("page_id = 1").select(F.size(urlfilter.keys_of(F.col("url"), 2))).first()
    assert size <= 6
    assert {r.page_id: r.blocked for r in urlfilter.evaluate(pages, entries).collect()} == {1: True, 2: False}
