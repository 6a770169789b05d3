"""Ordered greedy clusters against the loop that takes pair after pair."""

from __future__ import annotations

import itertools
import random

import pytest
from conftest import SF

from tomewright.functions import columns as C
from tomewright.functions import fixed, names
from tomewright.operators import authors, enrich
from tomewright.plans import catalog, registry


def loop(keys: list[str], block: dict[str, str], rejected: set, threshold=90, gray=82) -> set:
    """(members, confidence) of the clusters, by pairs in order."""
    owner: dict[str, int] = {}
    low: dict[int, bool] = {}
    for a, b in itertools.combinations(sorted(keys), 2):
        if block[a] != block[b] or (a, b) in rejected or (a in owner and b in owner):
            continue
        s = names.token_sort(a, b)
        if s < gray:
            continue
        ends = [set(k.split()) & set(fixed.NAME_SUFFIXES) for k in (a, b)]
        mine = owner.get(a, owner.get(b, len(low)))
        owner[a] = owner[b] = mine
        low[mine] = low.get(mine, False) or ends[0] != ends[1] or s < threshold
    members: dict[int, set] = {}
    for k, c in owner.items():
        members.setdefault(c, set()).add(k)
    return {(frozenset(m), "low" if low[c] else "medium") for c, m in members.items()}


def clusters_of(found) -> set:
    out: dict[str, tuple[set, str]] = {}
    for r in found:
        out.setdefault(r.cluster, (set(), r.confidence))[0].add(r.key)
    return {(frozenset(m), c) for m, c in out.values()}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    first, last = ["jon", "john", "jo", "anna", "ann", "anne", "rob", "bob"], ["smith", "smyth", "smithe", "bell", "bellow", "belle", "oak", "oake jr", "oaks sr"]
    keys = sorted({" ".join(rng.sample([rng.choice(first), rng.choice(last) + rng.choice(["", "s", "son"])], 2)) for _ in range(90)})
    rejected = {tuple(sorted(rng.sample(keys, 2))) for _ in range(60)}
    df = spark.createDataFrame([(rng.choice("xy"), k) for k in keys], "block string, key string")
    edges = authors.alike(df, 90, 82)
    block = {r.key: r.block for r in df.collect()}
    pairs = {(r.a, r.b) for r in edges.collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(keys, 2) if block[a] == block[b] and names.token_sort(a, b) >= 82}
    apart = spark.createDataFrame(sorted(rejected), "a string, b string")
    found = authors.greedy_clusters(edges.join(apart, ["a", "b"], "left_anti")).collect()
    want = loop(keys, block, rejected)
    assert clusters_of(found) == want and len(want) > 5


@pytest.mark.parametrize("name", ["author_cluster", "reject_anti"])
def test_queries_equal_the_loop(spark, name):
    rows = catalog._names(spark, SF).withColumn("key", catalog.udfs.author_key("name")).withColumn("block", C.signature("key")).collect()
    block = {r.key: r.block for r in rows}
    assert len(block) > 60
    rejected = {(k, f"{k}e") for k in block} if name == "reject_anti" else set()
    want = {m for m, _ in loop(list(block), block, rejected)}
    got = [r for r in registry.QUERIES[name](spark, SF).collect() if r.confidence in ("medium", "low")]
    assert {frozenset(names.author_key(v.rsplit(":", 1)[0]) for v in r.variants.split("|")) for r in got} == want and len(want) > 5


def test_a_block_of_many_names(spark):
    """Thousands of names of one block: candidates are a small part of all pairs, and no block is left out."""
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    rng = random.Random(3)
    keys = sorted({f"ann {''.join(rng.choices(syllables, k=rng.randint(3, 5)))}" for _ in range(3000)})
    df = spark.createDataFrame([("b", k) for k in keys], "block string, key string")
    edges = authors.alike(df, 90, 90)
    found = edges.collect()
    some = rng.sample(keys, 60)
    for k in some:
        want = {tuple(sorted((k, x))) for x in keys if x != k and names.token_sort(*sorted((k, x))) >= 90}
        assert want == {(r.a, r.b) for r in found if k in (r.a, r.b)}


def test_votes_decide_between_spellings_of_as_many_books(spark):
    named = spark.createDataFrame([("Pierce Brown", 2, 10), ("Pierce Browne", 2, 90)], "name string, n long, trust long")
    assert authors.cluster(named).first().canonical == "Pierce Browne"
    contested = named.select("name", catalog.udfs.author_key("name").alias("key"))
    sources = spark.createDataFrame([("Pierce Brown",), ("Brown, Pierce",), ("Pierce Browne",)], "author string")
    votes = enrich.spelling_votes(sources, contested)
    assert {r.name: r.votes for r in votes.collect()} == {"Pierce Brown": 2, "Pierce Browne": 1}
    assert authors.cluster(named, votes=votes).first().canonical == "Pierce Brown"
