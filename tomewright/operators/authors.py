"""Author names that are one person's: exact keys, then greedy clusters of alike ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions import columns as C
from tomewright.functions import fixed, udfs
from tomewright.operators import similarity
from tomewright.operators.components import connected_components
from tomewright.session import materialize


def counts(books: DataFrame) -> DataFrame:
    """(name, n, trust): books, and the sum of their confidence, of every author that isn't done with."""
    live = books.where((C.text("author") != "") & ~F.col("status").isin("copied", "moved"))
    return live.groupBy(F.col("author").alias("name")).agg(F.count("*").alias("n"), F.coalesce(F.sum("confidence"), F.lit(0)).alias("trust"))


def preference(name: str = "name", n: str = "n", trust: str = "trust", key: str = "key") -> Column:
    """What is greatest in the spelling to keep: books, trust, then tidiness."""
    v = F.col(name)
    words = F.filter(F.split(v, r"\s+"), lambda w: w != "")
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return F.struct(
        F.col(n), F.col(trust), ~v.contains(","), ~v.contains("  "), F.size(F.filter(F.split(F.col(key), " "), lambda w: w != "")),
        capitals, F.length(F.regexp_replace(v, r"[\x00-\x7F]", "")), F.least(F.length(v) - F.length(F.replace(v, F.lit("."))), F.lit(4)), F.length(v), v,
    )


def greedy_clusters(edges: DataFrame) -> DataFrame:
    """(key, cluster, confidence) that the greedy rule makes of edges (a, b, level; a < b), taken in order of a, then b: an edge
    whose ends both are in clusters does nothing; else its free ends join, and a cluster that a low edge has joined is low.

    A key is free until its first edge, so it is by its first edge that it joins: the edges that do something are those that are
    the first of one of their ends, and the clusters are what these connect. That needs no order between
    tasks: a least edge of each key, then components."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("key"), F.struct("a", "b", "level").alias("edge"))
    first = materialize(ends.groupBy("key").agg(F.min("edge").alias("edge")).select("edge.*").distinct(), "first-edges")
    roots = connected_components(first, "a", "b")
    low = first.join(roots, first.a == roots.node).groupBy("root").agg(F.max(F.col("level") == "low").alias("low"))
    # a cluster is called by its least key, which is the root
    return roots.join(low, "root").select(F.col("node").alias("key"), F.col("root").alias("cluster"), F.when(F.col("low"), "low").otherwise("medium").alias("confidence"))


def alike(keys: DataFrame, threshold: int, gray: int) -> DataFrame:
    """(a, b, level) of keys (block, key) of one block that are alike from ``gray`` on, whatever the order of their words."""
    words = F.array_join(F.array_sort(F.filter(F.split("key", r"\s+"), lambda w: w != "")), " ")
    rows = keys.select("block", "key", words.alias("words"))
    met = similarity.candidates(rows, ["block"], "words", gray / 100)
    side = lambda x: rows.select("block", F.col("key").alias(f"key{x}"), F.col("words").alias(f"text{x}"))
    pairs = met.join(side(1), ["block", "text1"]).join(side(2), ["block", "text2"]).select(F.least("key1", "key2").alias("a"), F.greatest("key1", "key2").alias("b"))
    # the same words in another order
    twins = side(1).join(side(2).withColumnRenamed("text2", "text1"), ["block", "text1"]).where("key1 < key2").select(F.col("key1").alias("a"), F.col("key2").alias("b"))
    scored = pairs.unionByName(twins).withColumn("s", udfs.token_sort("a", "b")).where(F.col("s") >= gray)
    suffixes = lambda c: F.array_sort(F.array_intersect(F.split(c, " "), F.array(*map(F.lit, fixed.NAME_SUFFIXES))))
    low = (suffixes("a") != suffixes("b")) | (F.col("s") < threshold)
    return scored.select("a", "b", F.when(low, "low").otherwise("medium").alias("level"))


def cluster(named: DataFrame, rejected: DataFrame | None = None, threshold: int = 90, gray: int = 82, votes: DataFrame | None = None) -> DataFrame:
    """(confidence, canonical, variants) of groups of names from (name, n, trust), in order of confidence and size.

    ``rejected`` (a, b) are pairs of keys that are known to be different people. ``votes`` (name, votes) are what sources say of
    the spelling (``enrich.spelling_votes``): they decide between spellings of as many books."""
    rows = named.where(F.trim("name") != "").withColumn("key", udfs.author_key("name"))
    if votes is not None:
        told = votes.select("name", F.col("votes").alias("_votes"))
        rows = rows.join(told, "name", "left").withColumn("trust", F.coalesce("_votes", F.lit(0)) * 1000 + F.col("trust")).drop("_votes")
    best = rows.groupBy("key").agg(F.max_by("name", preference()).alias("rep"), F.count("*").alias("spellings"))
    edges = alike(best.select(C.signature(udfs.author_key("rep")).alias("block"), "key"), threshold, gray)
    if rejected is not None:
        apart = rejected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = edges.join(apart, ["a", "b"], "left_anti")
    fuzzy = greedy_clusters(edges)
    grouped = rows.join(fuzzy, "key", "left").join(best.select("key", "spellings"), "key")
    grouped = grouped.where(F.col("cluster").isNotNull() | (F.col("spellings") > 1)).withColumns({"grp": F.coalesce(F.concat(F.lit("f|"), "cluster"), F.concat(F.lit("k|"), "key")), "confidence": F.coalesce("confidence", F.lit("high"))})
    glued = rows.where(C.looks_glued("name") & (F.col("n") > 0)).withColumns({"grp": F.concat(F.lit("g|"), "name"), "confidence": F.lit("glued")})
    first = F.regexp_replace(F.get(F.split("name", "(?i)" + fixed.GLUE), F.lit(0)), r"^[ .,&]+|[ .,&]+$", "")
    every = grouped.select("grp", "confidence", "name", "n", "trust", "key").unionByName(glued.select("grp", "confidence", "name", "n", "trust", "key"))
    variants = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "name"))), lambda x: F.struct(x["name"].alias("name"), (-x["m"]).alias("count")))
    made = every.groupBy("grp", "confidence").agg(F.max_by("name", preference()).alias("best"), F.min(first).alias("first"), variants.alias("variants"), F.sum("n").alias("total"))
    order = F.element_at(F.create_map(*[F.lit(x) for pair in fixed.AUTHOR_CONFIDENCE.items() for x in pair]), F.col("confidence"))
    made = made.withColumn("canonical", F.when(F.col("confidence") == "glued", F.col("first")).otherwise(F.col("best")))
    return made.orderBy(order, F.desc("total"), "canonical").select("confidence", "canonical", "variants")


def merge(books: DataFrame, variants: list[str], canonical: str) -> tuple[DataFrame, DataFrame]:
    """(books with the variants rewritten, alias rows)."""
    canonical = canonical.strip()
    hit = F.col("author").isin(variants) & ~F.col("status").isin("copied", "moved")
    aliases = books.sparkSession.createDataFrame([(v,) for v in sorted({*variants, canonical})], "name string")
    aliases = aliases.select(udfs.author_key("name").alias("variant_key"), F.lit(canonical).alias("canonical"), F.current_timestamp().alias("ts"))
    return books.withColumn("author", F.when(hit, F.lit(canonical)).otherwise(F.col("author"))), aliases


def reject(names_: DataFrame) -> DataFrame:
    """(a, b): all pairs of one contested group's keys, remembered as different people."""
    keys = names_.select(udfs.author_key("name").alias("k")).distinct()
    grouped = keys.agg(F.array_sort(F.collect_set("k")).alias("ks"))
    a = grouped.select("ks", F.posexplode("ks").alias("i", "a"))
    return a.select("a", F.explode(F.expr("slice(ks, i + 2, greatest(size(ks) - i - 1, 0))")).alias("b"))
