"""Enrichment as stages over the catalog: probe, fill, agreement, online match, covers, confidence."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tomewright.functions import columns as C
from tomewright.functions import udfs
from tomewright.operators import resolve
from tomewright.session import materialize
from tomewright.sources import clients, online


def probe(parts: DataFrame) -> DataFrame:
    """(id, duration, bitrate, codec, chapters, health) from (id, ordinal, name, size, length, bitrate, codec, chapters):
    lengths add up, the rest is the first part's, and the first three problems are told."""
    bad = F.when(F.col("size") == 0, F.concat("name", F.lit(" is empty (0 bytes)"))).when(F.coalesce("length", F.lit(0.0)) == 0, F.concat("name", F.lit(" could not be read (damaged or unsupported?)")))
    told = F.transform(F.array_sort(F.collect_list(F.when(bad.isNotNull(), F.struct("ordinal", bad.alias("x"))))), lambda s: s["x"])
    first = lambda c: F.min_by(c, "ordinal").alias(c)
    rows = parts.groupBy("id").agg(F.bround(F.sum(F.coalesce("length", F.lit(0.0))), 1).alias("duration"), first("bitrate"), first("codec"), first("chapters"), told.alias("bad"))
    health = F.concat(F.array_join(F.slice("bad", 1, 3), "; "), F.when(F.size("bad") > 3, " ...").otherwise(""))
    return rows.select("id", "duration", "bitrate", "codec", "chapters", health.alias("health"))


#: Pictures of fewer bytes are no covers.
SMALLEST = 1500


def gather_covers(found: DataFrame, most: int = 8) -> DataFrame:
    """(id, cover, cover_info, cover_candidates) from (id, kind, path, origin, w, h, bytes, ordinal): images of 1,500 bytes or
    more, each once, best first; of equal scores the first found."""
    nth = F.row_number().over(Window.partitionBy("id", "path").orderBy("ordinal"))
    rows = found.where((F.col("bytes") >= SMALLEST) & (F.col("w") > 0)).withColumn("_n", nth).where("_n = 1").drop("_n")
    rows = rows.withColumn("score", C.cover_score(F.col("w"), F.col("h"), F.col("kind")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "ordinal"))
    rows = rows.withColumn("_r", rank).where(F.col("_r") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_r", "path", "origin", "w", "h", "score")))
    rows = rows.groupBy("id").agg(listed.alias("l"))
    best = F.get("l", F.lit(0))
    info = F.concat(best["w"].cast("string"), F.lit("x"), best["h"].cast("string"), F.lit(" "), best["origin"])
    kept = F.transform("l", lambda x: F.struct(x["path"].alias("path"), x["origin"].alias("origin"), x["w"].alias("w"), x["h"].alias("h"), x["score"].alias("score")))
    return rows.select("id", best["path"].alias("cover"), info.alias("cover_info"), kept.alias("cover_candidates"))


def spelling_votes(sources: DataFrame, contested: DataFrame) -> DataFrame:
    """(name, votes): of each contested name (name, key), how many sources' authors are spelled most like it."""
    told = sources.select(udfs.clean_author("author").alias("a")).where("a <> ''").withColumn("key", udfs.author_key("a"))
    pairs = told.withColumn("s", F.monotonically_increasing_id()).join(contested, "key").withColumn("r", udfs.ratio("name", "a"))
    best = pairs.groupBy("s").agg(F.max_by("name", F.struct("r", "name")).alias("name"))
    return best.groupBy("name").agg(F.count("*").alias("votes"))


def enrich(
    books: DataFrame, cache: DataFrame, client: clients.Client, *, probes: DataFrame | None = None, extras: DataFrame | None = None, votes: DataFrame | None = None,
    spoken: DataFrame | None = None, fix_names: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(books, cache) after enrichment. ``probes`` as ``probe`` gives them; ``extras`` (id, side, local) structs of the
    fill-only fields; ``votes`` (id, votes) arrays of the sources' titles and authors; ``spoken`` (id, transcript) intros."""
    columns = books.columns
    if probes is not None:
        p = probes.select("id", *[F.col(c).alias(f"_{c}") for c in ("duration", "bitrate", "codec", "chapters", "health")])
        books = books.join(p, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("duration", "bitrate", "codec", "chapters", "health")}).select(*columns)
    if extras is not None:
        books = online.fill(books.join(extras, "id", "left"), ["side", "local"]).select(*columns)
        own = udfs.similar("narrator", "author") > 0.9  # a composer's tag that holds the author
        books = books.withColumn("narrator", F.when(own, "").otherwise(F.col("narrator")))
    if spoken is not None:
        books = hear_intro(books, spoken)
    if votes is not None:
        books = resolve.agreement_bonus(books.join(votes, "id", "left").withColumn("votes", F.coalesce("votes", F.array().cast("array<struct<title:string,author:string>>")))).select(*columns)
    asked = online.questions(books).withColumn("key", F.concat_ws(":", "kind", F.sha1("query")))
    answers, after = clients.ask(asked.select("key", "kind", "query").distinct(), cache, client, days=30)
    found = online.candidates(asked.join(answers.select("key", "value"), "key"))
    # what the detail service says of the candidates that it knows
    query = F.to_json(F.struct("asin"))
    known = found.where(C.text("c.asin") != "").select(F.col("c.asin").alias("asin")).distinct().withColumn("query", query)
    known = known.withColumn("key", F.concat(F.lit("audnexus:"), F.sha1("query"))).withColumn("kind", F.lit("audnexus"))
    details, after = clients.ask(known.select("key", "kind", "query"), after, client, days=30)
    found = online.merge_details(found, details.join(known.select("key", "asin"), "key").select("asin", "value"))
    scored = resolve.score_candidates(found.join(books.select("id", "title", "author", "duration", "isbn", "asin", "series_index"), "id"))
    matched = resolve.accept_best(books, scored, fix_names)
    best = scored.groupBy("id").agg(F.max_by(F.struct("c.source", "c.title", "c.author", "c.series", "c.series_index", "c.narrator", "c.year", "score", "c.runtime", "c.asin", "c.isbn"), F.struct("score", -F.col("ordinal"))).alias("_best"))
    matched = matched.join(best, "id", "left").withColumn("online_best", F.coalesce(F.col("_best"), F.col("online_best"))).withColumn("enriched", F.lit(True))
    return matched.select(*columns), after


def enrich_files(
    books: DataFrame, root: str, cache: DataFrame, client: clients.Client, *, covers: str | None = None, spoken: DataFrame | None = None, fix_names: bool = True
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(books, cache, counters): the whole of it, from the files below ``root``.

    Files are opened once, by the executors; then lengths, fields, votes, intros, catalogs with their details, and pictures
    (kept in the folder ``covers``) are joined. The counters are observed while the result is written: no job of their own."""
    from tomewright.operators import local

    columns = books.columns
    told = materialize(local.read_books(books.where(~F.col("status").isin("copied", "moved")), root, covers), "read-books")
    parts = told.select("id", F.explode("parts").alias("p")).select("id", "p.*")
    extras, votes = told.select("id", "side", "local"), told.select("id", "votes")
    found, after = enrich(books, cache, client, probes=probe(parts), extras=extras, votes=votes, spoken=spoken, fix_names=fix_names)
    rows = found.join(told.select("id", "empty", "isbn_from_text"), "id", "left")
    rows = rows.withColumn("health", F.when((F.col("kind") == "ebook") & F.col("empty").isNotNull(), F.col("empty")).otherwise(F.col("health")))
    if covers is not None:
        pictures = told.select("id", F.explode("covers").alias("c")).join(books.select("id", "kind"), "id").select("id", "kind", "c.*")
        best = gather_covers(pictures).select("id", *[F.col(c).alias(f"_{c}") for c in ("cover", "cover_info", "cover_candidates")])
        free = ~(F.array_contains(F.coalesce("locked", F.array().cast("array<string>")), "cover") & (C.text("cover") != "")) & F.col("_cover").isNotNull()
        put = {c: F.when(free, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("cover", "cover_info")}
        rows = rows.join(best, "id", "left").withColumns(put | {"cover_candidates": F.coalesce("_cover_candidates", "cover_candidates")})
    rows = rows.withColumn("confidence", resolve.book_confidence())
    seen = Observation(f"enriched-{uuid.uuid4().hex}")
    matched = F.coalesce(F.col("online_best.score") >= 0.8, F.lit(False))
    count = lambda name, condition: F.count_if(F.coalesce(condition, F.lit(False))).alias(name)
    rows = rows.observe(
        seen, F.count("*").alias("books"), count("matched", matched),
        *(count(f"matched_{name}", matched & F.col("online_best.source").startswith(source)) for name, source in (("audible", "Audible"), ("google", "Google"), ("openlibrary", "Open Library"))),
        count("heard", F.col("meta_source") == "spoken intro"), count("isbn_from_text", F.col("isbn_from_text")), count("damaged", C.text("health") != ""),
        count("with_cover", C.text("cover") != ""), count("unmatched", ~matched),
    )
    out = materialize(rows.select(*columns), "enriched")
    return out, after, dict(seen.get)


def hear_intro(books: DataFrame, spoken: DataFrame) -> DataFrame:
    """Books after their spoken intro (id, transcript): it fills what is empty, or what is held below 40."""
    rows = books.join(spoken.select("id", F.col("transcript").alias("_t")), "id", "left").withColumn("_h", C.parse_intro("_t"))
    heard = F.col("_h.title") != ""
    weak = F.coalesce("confidence", F.lit(0)) < 40
    free = lambda k: ~F.array_contains(F.coalesce("locked", F.array().cast("array<string>")), k)
    value = {"title": F.col("_h.title"), "author": udfs.clean_author("_h.author"), "narrator": F.col("_h.narrator")}
    put: dict[str, Column] = {k: F.when(heard & free(k) & ((C.text(k) == "") | weak) & (v != ""), v).otherwise(F.col(k)) for k, v in value.items()}
    put |= {"transcript": F.coalesce("_t", "transcript"), "meta_source": F.when(heard, "spoken intro").otherwise(F.col("meta_source"))}
    return rows.withColumns(put).withColumn("confidence", resolve.book_confidence()).select(*books.columns)
