"""Every catalog query against DuckDB, and the driver's contract."""

from __future__ import annotations

import hashlib
import itertools

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

import __spark_entry__
from tomewright.functions import columns as C
from tomewright.functions import names
from tomewright.operators import authors
from tomewright.plans import registry
from tomewright.sources import tree


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_fuzzy_pairs_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_brand", C.norm_title("p_name").alias("nt"), C.numbers(C.norm_title("p_name")).alias("nums")).collect()
    key = {r.p_partkey: names.author_key("Maker " + r.p_brand.translate(str.maketrans("0123456789", "abcdefghij", "#"))) for r in rows}
    want = set()
    for a, b in itertools.combinations(sorted(rows, key=lambda r: r.p_partkey), 2):
        if key[a.p_partkey].split()[-1] != key[b.p_partkey].split()[-1]:
            continue
        if a.nt != b.nt and a.nums == b.nums and (s := names.similar(a.nt, b.nt) * 100) >= 80:
            want.add((a.p_partkey, b.p_partkey, "Similar title", int(s)))
    got = {tuple(r) for r in registry.QUERIES["fuzzy_pairs"](spark, SF).collect()}
    similar = {r for r in got if r[2] == "Similar title"}
    assert similar == want and len(want) > 0
    chains = {r[:2] for r in got if r[2] == "Same title and author"}
    assert all((a < b) for a, b in chains)


def test_author_cluster_equals_brute_force(spark):
    """Greedy clusters of one block, in the order of keys, done in plain loops."""
    rows = [("Ann Bell", 5, 9), ("Anne Bell", 2, 1), ("Bell, Ann", 1, 1), ("Ann Bel", 1, 0), ("A. Bell", 1, 1), ("Rob Inn", 3, 3), ("Rob Inn Jr.", 1, 1), ("Zed Oak and Ann Bell", 1, 1)]
    named = spark.createDataFrame(rows, "name string, n long, trust long")
    keys = sorted({names.author_key(r[0]) for r in rows})
    block = {k: spark.range(1).select(C.signature(F.lit(k))).first()[0] for k in keys}
    owner, groups = {}, []
    for a, b in itertools.combinations(keys, 2):
        if block[a] != block[b] or names.token_sort(a, b) < 82 or (a in owner and b in owner):
            continue
        if a not in owner and b not in owner:
            owner[a] = owner[b] = len(groups)
            groups.append({a, b})
        else:
            g = owner.get(a, owner.get(b))
            owner[a] = owner[b] = g
            groups[g] |= {a, b}
    found = [r for r in authors.cluster(named).collect() if r.confidence != "glued"]
    got = sorted(sorted({names.author_key(v["name"]) for v in r.variants}) for r in found)
    single = [[k] for k in keys if k not in owner and sum(names.author_key(r[0]) == k for r in rows) > 1]
    assert got == sorted([*(sorted(g) for g in groups), *single])
    rejected = spark.createDataFrame([("ann bell", "anne bell")], "a string, b string")
    assert all({"ann bell", "anne bell"} != {names.author_key(v["name"]) for v in r.variants} for r in authors.cluster(named, rejected).collect())


def test_entry_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__spark_entry__.__file__).parent
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    shutil.copytree(repo / "tomewright", tmp_path / "tomewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.registry.QUERIES), len(e.oracle_sql()) > 30)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).stdout.split() == ["True", "True"]


def _one_table(tmp_path, spark, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    return con


def test_exact_dupes_reads_whole_pages(spark, tmp_path):
    """Long pages that differ in the middle alone, or beyond the first 64 KB, are no copies."""
    rows = [(1, "a" * 100_000), (2, "a" * 99_999 + "b"), (3, "a" * 100_000 + "b" + "a" * 100_000), (4, "a" * 100_000 + "c" + "a" * 100_000), (5, "a" * 100_000), (6, "é"), (7, ""), (8, None)]
    con = _one_table(tmp_path, spark, "pages", rows, "page_id long, html string")
    same_rows(registry.QUERIES["exact_dupes"](spark, str(tmp_path)), con, registry.ORACLES["exact_dupes"])


def test_html_text_resolves_what_its_sql_does(spark, tmp_path):
    rows = [(1, "a &amp b"), (2, "&nbsp;x&nbsp;y&eacute; &lt &mdash;"), (3, "&amp;lt; &amp;#39; &#39;"), (4, "a\x0bb \x0b"), (5, "<SCRIPT>1</script>x<style\n>y</STYLE> <\u017fcript>z</\u017fcript>"), (6, None), (7, "a\u00a0 b\u2003"), (8, "\n&nbsp;\r\n a\n ")]
    con = _one_table(tmp_path, spark, "pages", rows, "page_id long, html string")
    same_rows(registry.QUERIES["html_text"](spark, str(tmp_path)), con, registry.ORACLES["html_text"])


def test_book_fingerprints_hold_no_list_a_part(spark, tmp_path):
    """Odd books equal the SQL, and what is dealt for a part doesn't grow with its book."""
    rows = [(i, "s", "en") for i in range(3000)] + [(i, "s", None) for i in range(3)] + [(3, "s", None), (None, "t", "x"), (None, "u", "en"), (5, "u", "en")]
    con = _one_table(tmp_path, spark, "documents", rows, "doc_id long, source string, lang string")
    made = registry.QUERIES["book_fingerprints"](spark, str(tmp_path))
    same_rows(made, con, registry.ORACLES["book_fingerprints"])
    books = spark.createDataFrame([("d", "audio", [f"p{i}" for i in range(3000)]), ("d", "audio", ["q"]), ("e", "ebook", ["r", "p0"])], "book_dir string, kind string, files array<string>")
    found = tree.book_fingerprints(books, spark.range(3000).selectExpr("concat('p', id) AS rel_path", "sha1(CAST(id AS STRING)) AS fp"))
    digest = lambda n: hashlib.sha1("|".join(sorted(hashlib.sha1(str(i).encode()).hexdigest() for i in range(n))).encode()).hexdigest()[:20]
    assert {(r.book_dir, r.kind, len(r.files), r.fingerprint) for r in found.collect()} == {("d", "audio", 3000, digest(3000)), ("d", "audio", 1, ""), ("e", "ebook", 2, digest(1))}
    # the list itself never goes with a part
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "files#" in line for line in plan.splitlines())
