"""Duplicate links against all pairs, in plain loops."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest

from tomewright.functions import names
from tomewright.functions import udfs
from tomewright.operators import dedupe
from tomewright.operators.components import connected_components
from tomewright.session import materialize

FIELDS = "id long, kind string, nt string, mt string, nums array<string>, mnums array<string>, ak string, surname string, seq string, fp string, asin string, isbn string, dur double"


def digits(s: str) -> list[str]:
    return [c for c in s.split() if c.isdigit()]


def all_pairs(recs: list[dict], threshold: int) -> list[tuple]:
    """(src, dst, reason, score) of every pair that may be linked, ids ascending."""
    out = []
    for a, b in itertools.combinations(sorted(recs, key=lambda r: r["id"]), 2):
        if a["kind"] != b["kind"]:
            continue
        apart = a["seq"] and b["seq"] and a["seq"] != b["seq"]
        add = lambda reason, score=100: out.append((a["id"], b["id"], reason, score))  # noqa: B023, E731
        if a["fp"] and a["fp"] == b["fp"]:
            add("Identical files")
        if apart:
            continue
        for key, sizes, reason in (("asin", (10,), "Same ASIN"), ("isbn", (10, 13), "Same ISBN")):
            if len(a[key]) in sizes and a[key] == b[key]:
                add(reason)
        if a["nt"] and a["ak"] and (a["nt"], a["ak"]) == (b["nt"], b["ak"]):
            add("Same title and author")
        if not a["surname"] or a["surname"] != b["surname"]:
            continue
        if a["nt"] != b["nt"] and (a["ak"] == b["ak"] or names.similar(a["ak"], b["ak"]) * 100 >= 85):
            if len(a["mt"]) >= 4 and (a["mt"], a["mnums"]) == (b["mt"], b["mnums"]):
                add("Same title, other subtitle")
            elif a["nums"] == b["nums"] and (s := names.similar(a["nt"], b["nt"]) * 100) >= threshold:
                add("Similar title", int(s))
        if a["kind"] == "audio" and a["ak"] == b["ak"] and min(a["dur"], b["dur"]) >= 1200:
            low, high = sorted((a["dur"], b["dur"]))
            if high - low <= max(3.0, low * 0.0005):
                add("Same author and length")
    return out


def told(links: list[tuple]) -> dict:
    """Of every component: its least id, its members, and each reason's greatest score."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, *_ in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    members, reasons = defaultdict(set), defaultdict(dict)
    for a, b, reason, score in links:
        members[find(a)] |= {a, b}
        reasons[find(a)][reason] = max(score, reasons[find(a)].get(reason, 0))
    return {k: (frozenset(members[k]), tuple(sorted(reasons[k].items()))) for k in members}


def records(rng: random.Random, n: int) -> list[dict]:
    words = ["story", "storm", "stone", "the wood", "a way", "saga one", "saga 2", "of old", "deep", ""]
    out = []
    for i in range(n):
        mt = " ".join(filter(None, rng.sample(words, 2)))
        mt = rng.choice([mt, mt, mt, ""])
        nt = mt and mt + rng.choice(["", "", " part", " 3", "s"])
        ak = rng.choice(["ann bell", "ann bell", "anne bell", "rob inn", ""])
        out.append({
            "id": i * 3 + 1, "kind": rng.choice(["audio", "ebook"]), "nt": nt, "mt": mt, "nums": digits(nt), "mnums": digits(mt), "ak": ak,
            "surname": ak.split()[-1] if ak else "", "seq": rng.choice(["", "01", "02"]), "fp": rng.choice(["", "", "", f"f{rng.randint(0, n // 3)}"]),
            "asin": rng.choice(["", "", "B00000000" + str(rng.randint(0, 9))]), "isbn": rng.choice(["", "", "", "978000000000" + str(rng.randint(0, 9)), "short"]), "dur": rng.choice([0.0, 1300.0, 1302.0, 9000.0 + rng.randint(0, 6), 5e4]),
        })
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, n, threshold", [(1, 14, 90), (2, 30, 80), (3, 60, 90), (4, 25, 60)])
def test_links_have_the_components_of_all_pairs(spark, seed, n, threshold):
    recs = records(random.Random(seed), n)
    df = spark.createDataFrame([tuple(r.values()) for r in recs], FIELDS)
    want = all_pairs(recs, threshold)
    links = [tuple(r) for r in dedupe.edges(df, threshold).collect()]
    assert {x[:3] for x in links} <= {x[:3] for x in want}, "a link that isn't allowed"
    assert told(links) == told(want)
    every = [tuple(r) for r in dedupe.edges(df, threshold, every=True).collect()]
    different = ("Similar title", "Same title, other subtitle")
    assert sorted(x for x in every if x[2] in different) == sorted(x for x in want if x[2] in different)


def test_guards_do_not_cut_what_lies_beyond(spark):
    """Books 1 and 3 are audio with an ebook of their ASIN between; 4 and 6 are ebooks with an audio of their files between."""
    base = dict(nt="", mt="", nums=[], mnums=[], ak="", surname="", seq="", fp="", asin="", isbn="", dur=0.0)
    recs = [base | {"id": i, "kind": k, "asin": a, "fp": f, "seq": s} for i, k, a, f, s in [
        (1, "audio", "B123456789", "", ""), (2, "ebook", "B123456789", "", ""), (3, "audio", "B123456789", "", ""), (4, "ebook", "", "x", "01"), (5, "audio", "", "x", ""), (6, "ebook", "", "x", "02"),
        (7, "audio", "B999999999", "", "01"), (8, "audio", "B999999999", "", "02"), (9, "audio", "B999999999", "", "01"), (10, "audio", "B777777777", "", "05"), (11, "audio", "B777777777", "", ""), (12, "audio", "B777777777", "", "06"),
    ]]
    df = spark.createDataFrame([tuple(r[f.split()[0]] for f in FIELDS.split(", ")) for r in recs], FIELDS)
    links = {tuple(r)[:3] for r in dedupe.edges(df).collect()}
    assert links == {(1, 3, "Same ASIN"), (4, 6, "Identical files"), (7, 9, "Same ASIN"), (10, 11, "Same ASIN"), (11, 12, "Same ASIN")}
    roots = {r.node: r.root for r in connected_components(dedupe.edges(df)).collect()}
    assert roots[12] == 10 and 8 not in roots


def test_links_grow_with_the_rows(spark):
    """A key with a third of all rows gives a link a row, and equal titles are compared once."""
    rows = [(i, "audio", "same title" if i % 3 else "same titles", "same", [], [], "ann bell", "bell", "", "f" if i % 3 == 0 else "", "B123456789", "", 5000.0) for i in range(3000)]
    df = spark.createDataFrame(rows, FIELDS)
    links = dedupe.edges(df).groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in links} == {
        "Identical files": 999, "Same ASIN": 2999, "Same title and author": 2998, "Same title, other subtitle": 1, "Same author and length": 2999
    }


def test_rare_pairs_miss_nothing_and_cut_candidates(spark):
    rng = random.Random(9)
    parts = ["dragon", "stone", "river", "night", "king", "garden", "silver", "winter", "shadow", "road", "house", "light"]
    titles = {" ".join(rng.sample(parts, rng.randint(1, 4))) for _ in range(250)}
    titles |= {t[:i] + rng.choice(["", "s", "e "]) + t[i + rng.randint(0, 2) :] for t in list(titles)[:120] for i in [rng.randint(0, len(t))]}
    titles |= {"a", "ab", "axb", "abc", ""}
    rows = [(i, "ebook", t, t, [], [], "ann bell", "bell", "", "", "", "", 0.0) for i, t in enumerate(sorted(titles))]
    of = dedupe.classes(spark.createDataFrame(rows, FIELDS))
    for threshold in (0.9, 0.8, 0.7):
        want = {(a, b) for a, b in itertools.combinations(sorted(titles), 2) if max(names.similar(a, b), names.similar(b, a)) >= threshold}
        got = {(r.nt1, r.nt2) for r in dedupe.title_candidates(of, threshold).collect()}
        assert want <= got and len(want) > 10
        if threshold == 0.9:
            assert len(got) < 0.2 * len(titles) ** 2 / 2
    for a, b in itertools.combinations(sorted(titles)[:80], 2):
        s = max(names.similar(a, b), names.similar(b, a))
        shared = len(set(udfs._pairs_of(a)) & set(udfs._pairs_of(b)))
        if a != b and s > 0.67:
            assert shared >= udfs._fewest_shared(len(a), s) and shared >= udfs._fewest_shared(len(b), s)


def test_decisions_on_groups_and_policies(spark):
    from test_catalog import book, frame

    books = frame(spark, [
        book(id=1, title="Emma", author="Jane Austen", kind="ebook", files=["/l/e.epub"], fingerprint="f1", src_display="e1"), book(id=2, title="Emma", author="Jane Austen", kind="ebook", files=["/l/e.mobi"], fingerprint="f2", src_display="e2"),
        book(id=3, title="Dune", author="Frank Herbert", fingerprint="f3", files=["/l/3.mp3"]), book(id=4, title="Dune", author="Frank Herbert", fingerprint="f4", files=["/l/4.mp3"]),
        book(id=5, title="Kim", author="Rudyard Kipling", fingerprint="f5", files=["/l/5.mp3"]), book(id=6, title="Kim", author="Rudyard Kipling", fingerprint="f6", files=["/l/6.mp3"]),
    ])
    files = spark.createDataFrame([(f"/l/{i}.mp3", 10 * i, None) for i in range(3, 7)] + [("/l/e.epub", 5, None), ("/l/e.mobi", 6, None)], "path string, size long, mtime timestamp")
    found = dedupe.groups(books, files)
    rows = {tuple(g.ids): g for g in found.collect()}
    assert set(rows) == {(1, 2), (3, 4), (5, 6)}
    other = 3 if rows[3, 4].keep == 4 else 4
    told = spark.createDataFrame([(rows[1, 2].key, "merge", None), (rows[3, 4].key, "keep", other), (rows[5, 6].key, "dismiss", None), ("gone", "keep", 1)], "key string, action string, keep long")
    after, corrections, journal, dismissed = dedupe.decide(books, found, told)
    status = {r.id: r for r in after.collect()}
    merged = rows[1, 2].keep
    assert set(status) == {merged, 3, 4, 5, 6} and len(status[merged].files) == 2
    assert status[other].status == "ready" and status[7 - other].status == "skipped" and status[7 - other].dup_skipped and {status[5].status, status[6].status} == {"ready"}
    assert [r.key for r in dismissed.collect()] == [rows[5, 6].key] and corrections.count() == 2 and {r.action for r in journal.collect()} == {"merge-formats", "skip-duplicate"}
    assert (5, 6) not in {tuple(g.ids) for g in dedupe.groups(books, files, dismissed).collect()}
    largest = {tuple(r.ids): r.keep for r in dedupe.by_policy(books, files, found, "keep_largest").collect()}
    assert largest == {(1, 2): 2, (3, 4): 4, (5, 6): 6} and dedupe.by_policy(books, files, found, "keep_all").count() == 0
    with pytest.raises(ValueError, match="unknown policy"):
        dedupe.by_policy(books, files, found, "x")


def test_components_of_stars_need_no_round(spark, monkeypatch):
    from tomewright.operators import components

    labels = []
    monkeypatch.setattr(components, "materialize", lambda df, label: labels.append(label) or materialize(df, label))
    stars = spark.createDataFrame([(1, i) for i in range(2, 20)] + [(30, 31)], "src long, dst long")
    found = {r.node: r.root for r in connected_components(stars).collect()}
    assert found == {i: 1 for i in range(1, 20)} | {30: 30, 31: 30}
    assert labels == ["stars", "least"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 50)], "src long, dst long")
    assert {r.node: r.root for r in connected_components(chain).collect()} == dict.fromkeys(range(41), 0)
    assert connected_components(stars.where("false")).count() == 0


def test_only_blocks_of_different_titles_are_compared(spark):
    from tomewright.operators import similarity

    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("b", "y"), (None, "x"), (None, "y")], "k string, t string")
    assert sorted(similarity.crowded(rows, ["k"], "t").collect()) == [("b", "x"), ("b", "y"), ("b", "y")]


def test_dismissal_searches_once(spark, monkeypatch):
    from tomewright.plans import library

    calls = []
    whole = dedupe.groups
    monkeypatch.setattr(dedupe, "groups", lambda *a, **k: calls.append(1) or whole(*a, **k))
    library.dismiss_anti(spark, "/root/testdata/sf0.001").count()
    assert len(calls) == 1


def test_file_stats_of_odd_books(spark):
    books = spark.createDataFrame([(1, ["a/x.mp3", "a/y.M4B", None]), (2, []), (3, None), (4, ["b/none"]), (5, ["c/z.epub", "c/q.epub"])], "id long, files array<string>")
    files = spark.createDataFrame([("a/x.mp3", 5, 1), ("a/y.M4B", 7, 2), ("c/q.epub", 3, 9)], "path string, size long, mtime long")
    got = {r.id: (r["size"], r.mtime, r.nfiles, r.exts, r.names) for r in dedupe.file_stats(books, files).collect()}
    assert got == {1: (12, 2, 3, [".m4b", ".mp3"], "x.mp3 y.M4B"), 4: (0, None, 1, [""], "none"), 5: (3, 9, 2, [".epub"], "q.epub z.epub")}
