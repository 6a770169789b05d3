"""The catalog's operators as queries on books made from the driver's tables, each with SQL for the same rows.

The tables hold no books, so orders are made into books: an order is a book, its customer stands for the
author and the title, its status and priority for the book's state. ``FIELDS`` are expressions that Spark and
DuckDB read alike, so the SQL starts from the same books and then follows the operators' rules in its own way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions import udfs
from tomewright.operators import authors as A
from tomewright.operators import copying, dedupe, edits, enrich, resolve, schema
from tomewright.operators import decisions as D
from tomewright.operators import views as V
from tomewright.plans.registry import query
from tomewright.plans.scan import conform
from tomewright.session import materialize
from tomewright.sources import metadata, tree

FIELDS = {
    "id": "o_orderkey",
    "kind": "CASE WHEN o_orderkey % 3 = 0 THEN 'ebook' ELSE 'audio' END",
    "author": "CASE WHEN o_custkey % 11 = 0 THEN '' ELSE concat('Writer ', chr(CAST(65 + o_custkey % 26 AS INT)), chr(CAST(97 + o_custkey % 25 AS INT)), 'son') END",
    "title": "CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('Story ', CAST(o_custkey AS STRING)) END",
    "series": "CASE WHEN o_custkey % 5 = 0 THEN 'Saga' ELSE '' END",
    "series_index": "CASE WHEN o_custkey % 5 = 0 THEN CAST(o_custkey % 7 AS STRING) ELSE '' END",
    "narrator": "CASE WHEN o_custkey % 9 = 0 THEN 'Reader One' ELSE '' END",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'F' THEN CASE o_orderkey % 4 WHEN 0 THEN 'copied' WHEN 1 THEN 'moved' WHEN 2 THEN 'skipped' ELSE 'in destination' END ELSE CASE o_orderkey % 2 WHEN 0 THEN 'ERROR: disk' ELSE 'pending' END END",
    "confidence": "CAST(o_custkey % 101 AS INT)",
    "health": "CASE WHEN o_orderpriority LIKE '5%' THEN 'bad header' ELSE '' END",
    "fingerprint": "concat('f', CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 3 AS STRING), '-', CAST(o_orderkey % 2 AS STRING))",
    "meta_source": "CASE WHEN o_orderkey % 4 = 0 THEN 'filename' ELSE 'tags' END",
    "src_display": "concat('d', CAST(o_custkey % 500 AS STRING))",
    "path": "concat('d', CAST(o_custkey % 500 AS STRING), '/b', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 > 0 THEN '.m4b' WHEN o_orderkey % 2 = 0 THEN '.epub' ELSE '.mobi' END)",
    "size": "CAST(o_custkey * 1000 + o_orderkey % 100 * 10 + 3 AS BIGINT)",
}
#: The same as a common table expression of SQL; ``locks`` counts title and author among the locked fields.
BOOKS = "b AS (SELECT " + ", ".join(f"{e} AS {k}" for k, e in FIELDS.items()) + ", CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS locks, o_orderkey % 5 = 0 AS pending, o_orderdate AS mtime FROM orders)"
DONE = "status IN ('copied', 'moved', 'skipped')"


def books(spark: SparkSession, sf_dir: str, **other: str) -> DataFrame:
    """Rows of the catalog's table; ``other`` replaces expressions."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*[f"{e} AS {k}" for k, e in (FIELDS | other).items()], "o_orderdate AS mtime")
    locked = F.when(F.col("id") % 7 == 0, F.array(F.lit("author"), F.lit("title"))).when(F.col("id") % 7 == 1, F.array(F.lit("title"))).otherwise(F.array().cast("array<string>"))
    answer = F.struct(F.lit("").alias("title"), F.lit("").alias("author"), F.lit(0).alias("confidence"), (F.col("id") % 5 == 0).alias("pending"))
    return conform(rows.withColumns({"files": F.array("path"), "locked": locked, "ai": answer, "extras": F.array().cast("array<string>"), "flags": F.array().cast("array<string>")}))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(f"{FIELDS['path']} AS path", f"{FIELDS['size']} AS size", "o_orderdate AS mtime")


# --- views ---


@query("state_counts", f"""WITH {BOOKS}, x AS (SELECT *, NOT ({DONE}) AS live, author <> '' AND title <> '' AS named, status LIKE 'ERROR%' AS failed FROM b)
SELECT count(*) AS total, count(*) FILTER (live AND NOT failed AND status <> 'in destination' AND named) AS ready,
  count(*) FILTER (live AND NOT failed AND status <> 'in destination' AND NOT named) AS review, count(*) FILTER (status = 'copied') AS copied,
  count(*) FILTER (status = 'moved') AS moved, count(*) FILTER (status = 'in destination') AS "exists", count(*) FILTER (failed) AS error,
  count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (live AND confidence < 70) AS low, count(*) FILTER (live AND health <> '') AS damaged,
  count(*) FILTER (live AND pending) AS ai, CAST(0 AS BIGINT) AS dups FROM x""")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.state_counts(books(spark, sf_dir), 70)


LISTED = "lower(author), lower(series), CASE WHEN series_index = '' THEN '' ELSE lpad(series_index, 2, '0') END, lower(title), id"


@query("list_page", f"WITH {BOOKS} SELECT id, author, series, series_index, title, status FROM b WHERE NOT ({DONE}) AND contains(lower(concat_ws(' ', author, series, title, narrator, src_display)), 'story') ORDER BY {LISTED} LIMIT 200 OFFSET 200")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.listing(books(spark, sf_dir), status="pending", q=" STORY ")
    return V.page(rows.select("id", "author", "series", "series_index", "title", "status"), 2, 200)[0]


@query("list_by_confidence", f"WITH {BOOKS} SELECT id, confidence FROM b WHERE NOT ({DONE}) AND confidence < 50 ORDER BY confidence, lower(author), id LIMIT 100")
def list_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.listing(books(spark, sf_dir), status="low", sort="conf", threshold=50).select("id", "confidence").limit(100)


@query("lock_containment", f"WITH {BOOKS} SELECT id FROM b WHERE locks = 2 OR confidence >= 70")
def lock_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir).where(V.matches("approved", 70)).select("id")


@query("book_rows", f"""WITH {BOOKS} SELECT id, confidence < 70 AS low, locks = 2 OR confidence >= 70 AS approved, concat_ws('/', 'lib', CASE WHEN author = '' THEN 'Unknown Author' ELSE author END,
  CASE WHEN series = '' THEN NULL ELSE series END, CASE WHEN title = '' THEN 'Unknown' ELSE title END) AS dest FROM b""")
def book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.list_columns(books(spark, sf_dir), 70, root="lib").select("id", "low", "approved", "dest")


@query("journal_page", "SELECT event_id AS id, event_type AS action FROM events ORDER BY event_id DESC LIMIT 1000")
def journal_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"))
    return V.journal_page(journal, 1000)


# --- duplicates ---

#: Groups are the books of one kind and customer (author and title follow from it), if 2 to 50 are open and named.
GROUPS = f"""{BOOKS}, o AS (SELECT * FROM b WHERE NOT ({DONE}) AND title <> ''),
k AS (SELECT *, CASE WHEN author = '' THEN fingerprint ELSE concat(kind, '|', title) END AS root,
  round((9 - CASE WHEN kind = 'audio' THEN 0 WHEN id % 2 = 0 THEN 0 ELSE 3 END) * 10.0 + CASE WHEN kind = 'audio' THEN 6.0 + least(size / 1e9, 2.0) * 3 ELSE least(size / 5e6, 3.0) END
    + confidence / 20 - CASE WHEN health <> '' THEN 25 ELSE 0 END, 2) AS q FROM o),
g AS (SELECT root, string_agg(fingerprint, '|' ORDER BY fingerprint) AS key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, count(*) AS n, min(kind) AS kind,
  count(DISTINCT fingerprint) < count(*) AS same, max(CASE WHEN author <> '' THEN 1 ELSE 0 END) AS named, count(DISTINCT id % 2) AS formats, arg_max(id, (q, id)) AS keep FROM k GROUP BY root HAVING count(*) > 1)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.groups(books(spark, sf_dir), files(spark, sf_dir))


@query("dup_groups", f"""WITH {GROUPS} SELECT key, ids, n, concat_ws('|', CASE WHEN same THEN 'Identical files:100' END, CASE WHEN named = 1 THEN 'Same title and author:100' END) AS reasons, keep,
  kind = 'ebook' AND NOT same AND formats = n AS merge_formats FROM g""")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_join(F.transform("reasons", lambda x: F.concat_ws(":", x["reason"], x["score"])), "|")
    return _groups(spark, sf_dir).select("key", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.size("ids").cast("long").alias("n"), told.alias("reasons"), "keep", "merge_formats")


@query("dismiss_anti", f"WITH {GROUPS} SELECT key, keep FROM g WHERE key NOT IN (SELECT key FROM g WHERE keep % 3 = 0)")
def dismiss_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _groups(spark, sf_dir)
    return dedupe.in_order(dedupe.undismissed(found, found.where("keep % 3 = 0"))).select("key", "keep")


@query("file_stats", f"WITH {BOOKS} SELECT id, size, mtime, CASE WHEN kind = 'audio' OR id % 2 = 0 THEN 0 ELSE 3 END AS rank, CAST(1 AS BIGINT) AS nfiles, '.' || split_part(path, '.', 2) AS exts, split_part(path, '/', 2) AS names FROM b")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.file_stats(books(spark, sf_dir), files(spark, sf_dir)).withColumn("exts", F.array_join("exts", ","))


@query("resolved_duplicates", f"""WITH {GROUPS}, m AS (SELECT id, keep, k.kind = 'ebook' AND NOT same AND formats = n AS merged, status FROM k JOIN g USING (root)),
x AS (SELECT b.id, coalesce(m.id <> keep, false) AS loses, coalesce(merged, false) AS merged, b.status, m.id = keep AND merged AS takes FROM b LEFT JOIN m ON b.id = m.id)
SELECT id, CASE WHEN loses THEN 'skipped' ELSE status END AS status, CASE WHEN takes THEN 2 ELSE 1 END AS nfiles FROM x WHERE NOT (loses AND merged)""")
def resolved_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, _, _ = dedupe.resolve(books(spark, sf_dir), _groups(spark, sf_dir), "smart")
    return after.select("id", "status", F.size("files").alias("nfiles"))


@query("remembered_merges", f"""WITH {BOOKS}, t AS (SELECT fingerprint AS keep, replace(fingerprint, '-0-0', '-0-1') AS fp FROM b WHERE fingerprint LIKE '%-0-0'),
first AS (SELECT fingerprint, max(id) AS keeper FROM b GROUP BY fingerprint),
gone AS (SELECT DISTINCT b.id, keeper FROM b JOIN t ON b.fingerprint = t.fp JOIN first ON first.fingerprint = t.keep WHERE b.kind = 'ebook' AND b.id <> keeper)
SELECT id, CASE WHEN id IN (SELECT keeper FROM gone) THEN 2 ELSE 1 END AS nfiles FROM b WHERE id NOT IN (SELECT id FROM gone)""")
def remembered_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    to = rows.where("fingerprint LIKE '%-0-0'").select(F.col("fingerprint").alias("keep")).distinct()
    told = to.select(F.regexp_replace("keep", "-0-0$", "-0-1").alias("fp"), F.create_map(F.lit("_merge_into"), "keep").alias("fields"), F.current_timestamp().alias("ts"))
    return D.merge_remembered(rows, told).select("id", F.size("files").alias("nfiles"))


# --- decisions, edits, transfers ---


@query("alias_apply", f"""WITH {BOOKS}, x AS (SELECT *, lower(author) LIKE 'writer a%' AS alias, o.fp IS NOT NULL AS told FROM b LEFT JOIN (SELECT DISTINCT fingerprint AS fp FROM b WHERE id % 10 = 3) o ON fingerprint = fp)
SELECT id, CASE WHEN alias THEN concat('W. ', substr(author, 8)) ELSE author END AS author, CASE WHEN told THEN 'Corrected' ELSE title END AS title,
  CASE WHEN told AND meta_source IN ('filename', 'tags') THEN 'you' ELSE meta_source END AS meta_source, CASE WHEN locks = 2 THEN 'author,title' WHEN locks = 1 OR told THEN 'title' ELSE '' END AS locked FROM x""")
def alias_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    told = rows.where("author LIKE 'Writer A%'").select("author").distinct()
    aliases = told.select(udfs.author_key("author").alias("variant_key"), F.concat(F.lit("W. "), F.substring("author", 8, 100)).alias("canonical"), F.current_timestamp().alias("ts"))
    fixes = rows.where("id % 10 = 3").select(F.col("fingerprint").alias("fp"), F.create_map(F.lit("title"), F.lit("Corrected")).alias("fields"), F.current_timestamp().alias("ts")).dropDuplicates(["fp"])
    return D.apply_memory(rows, aliases, fixes).select("id", "author", "title", "meta_source", F.array_join("locked", ",").alias("locked"))


@query("semi_anti_swap", f"""WITH {BOOKS}, x AS (SELECT id, status, CASE WHEN id % 13 = 0 THEN 'filename' ELSE meta_source END AS meta_source, locks, CASE WHEN id % 13 = 0 THEN concat('Story ', chr(CAST(97 + id % 26 AS INT)), 'x') ELSE author END AS author,
  CASE WHEN id % 13 = 0 THEN 'Writer Abson' ELSE title END AS title FROM b),
known AS (SELECT DISTINCT lower(author) AS k FROM x WHERE status NOT IN ('copied', 'moved') AND author <> '' AND meta_source NOT LIKE 'filename%'),
s AS (SELECT *, status NOT IN ('copied', 'moved') AND locks = 0 AND author <> '' AND title <> '' AND lower(title) IN (SELECT k FROM known) AND lower(author) NOT IN (SELECT k FROM known) AS swap FROM x)
SELECT id, CASE WHEN swap THEN title ELSE author END AS author, CASE WHEN swap THEN author ELSE title END AS title, CASE WHEN swap THEN concat(meta_source, ' (swapped)') ELSE meta_source END AS meta_source FROM s""")
def semi_anti_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = f"CASE WHEN o_orderkey % 13 = 0 THEN concat('Story ', chr(CAST(97 + o_orderkey % 26 AS INT)), 'x') ELSE {FIELDS['author']} END"
    # what the parsers say of every thirteenth file name has author and title the wrong way round
    source = f"CASE WHEN o_orderkey % 13 = 0 THEN 'filename' ELSE {FIELDS['meta_source']} END"
    title = f"CASE WHEN o_orderkey % 13 = 0 THEN 'Writer Abson' ELSE {FIELDS['title']} END"
    return resolve.library_pass(books(spark, sf_dir, author=author, title=title, meta_source=source)).select("id", "author", "title", "meta_source")


@query("hold_reasons", f"""WITH {BOOKS}, h AS (SELECT CASE WHEN health <> '' THEN 'damaged' WHEN author = '' OR title = '' THEN 'incomplete' WHEN confidence < 70 AND locks < 2 THEN 'unapproved' END AS move,
  CASE WHEN health <> '' THEN 'damaged' WHEN author = '' OR title = '' THEN 'incomplete' WHEN confidence < 30 THEN 'low confidence' END AS copy FROM b WHERE NOT ({DONE}))
SELECT 'move' AS mode, coalesce(move, 'free') AS hold, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT 'copy', coalesce(copy, 'free'), count(*) FROM h GROUP BY ALL""")
def hold_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for mode, o in (("move", copying.Options(move=True)), ("copy", copying.Options(min_confidence=30))):
        free, held = copying.split(books(spark, sf_dir), o)
        both = held.select("hold").unionByName(free.select(F.lit("free").alias("hold")))
        one = both.groupBy(F.lit(mode).alias("mode"), "hold").agg(F.count("*").alias("n"))
        found = one if found is None else found.unionByName(one)
    return found


@query("set_difference", f"WITH {BOOKS} SELECT id FROM b WHERE NOT ({DONE}) AND health = '' AND author <> '' AND title <> '' AND id % 2 = 0")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    return copying.split(edits.remove(rows, rows.where("id % 2 = 1")), copying.Options())[0].select("id")


@query("dirs_in_use", f"WITH {BOOKS} SELECT DISTINCT split_part(path, '/', 1) AS dir FROM b WHERE NOT ({DONE}) AND NOT (confidence < 70)")
def dirs_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    return copying.dirs_in_use(rows, edits.targets(rows, which="low"))


@query("skipped_books", f"WITH {BOOKS} SELECT id, CASE WHEN confidence < 20 AND NOT ({DONE}) THEN 'skipped' ELSE status END AS status FROM b")
def skipped_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    return edits.skip(rows, edits.targets(rows, which="low", threshold=20))[0].select("id", "status")


@query("bytes_needed", f"WITH {BOOKS} SELECT CAST(sum(size) AS BIGINT) AS need FROM b WHERE NOT ({DONE}) AND health = '' AND author <> '' AND title <> ''")
def bytes_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    todo, _ = copying.split(books(spark, sf_dir), copying.Options())
    return spark.createDataFrame([(copying.bytes_needed(todo, files(spark, sf_dir)),)], "need long")


# --- authors, covers, sidecars, fingerprints ---


@query("canonical", """
WITH c AS (SELECT p_brand, p_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS trust FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, trust DESC, contains(p_type, ','), contains(p_type, '  '), len(regexp_extract_all(p_type, '[^ ]+')) DESC,
  len(regexp_extract_all(p_type, '(?:^| )[A-Z]')) DESC, least(len(regexp_extract_all(p_type, '[.]')), 4) DESC, length(p_type) DESC, p_type DESC) AS rn FROM c)
SELECT p_brand, p_type AS canonical FROM r WHERE rn = 1""")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand", F.col("p_type").alias("name")).agg(F.count("*").alias("n"), F.sum("p_size").alias("trust"))
    return named.withColumn("key", F.lower("name")).groupBy("p_brand").agg(F.max_by("name", A.preference()).alias("canonical"))


@query("best_covers", """
WITH i AS (SELECT p_size AS id, p_partkey AS ordinal, 'c' || (p_partkey % 700) AS path, CAST(600 + p_partkey % 1300 AS INT) AS w, CAST(200 + p_partkey % 1500 AS INT) AS h, CAST(p_retailprice * 2 AS BIGINT) AS bytes FROM part),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, path ORDER BY ordinal) AS rn FROM i WHERE bytes >= 1500) WHERE rn = 1),
s AS (SELECT *, round(greatest(0.0, CAST(least(least(w, h), 1600) AS DOUBLE) / 1600 - 0.6 * least(1.5 * abs(CAST(w AS DOUBLE) / h - 1.0), 0.9) - CASE WHEN least(w, h) < 300 THEN 0.5 ELSE 0 END), 3) AS score FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ordinal) AS k FROM s)
SELECT CAST(id AS BIGINT) AS id, max(path) FILTER (k = 1) AS cover, max(w || 'x' || h || ' folder') FILTER (k = 1) AS cover_info, string_agg(path, ',' ORDER BY k) FILTER (k <= 8) AS candidates FROM r GROUP BY id""")
def best_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_size").cast("long").alias("id"), F.lit("audio").alias("kind"), F.concat(F.lit("c"), (F.col("p_partkey") % 700).cast("string")).alias("path"), F.lit("folder").alias("origin"),
        (600 + F.col("p_partkey") % 1300).cast("int").alias("w"), (200 + F.col("p_partkey") % 1500).cast("int").alias("h"), (F.col("p_retailprice") * 2).cast("long").alias("bytes"), F.col("p_partkey").alias("ordinal"),
    )
    made = enrich.gather_covers(found)
    return made.select("id", "cover", "cover_info", F.array_join(F.transform("cover_candidates", lambda c: c["path"]), ",").alias("candidates"))


@query("json_sidecar", """SELECT event_id, event_type AS title, 'U ' || user_id AS author, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'S ' || (user_id % 7) END AS series,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) END AS series_index FROM events""")
def json_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.get_json_object("props", "$.k")
    name, series = F.concat(F.lit("U "), F.col("user_id").cast("string")), F.concat(F.lit("S "), (F.col("user_id") % 7).cast("string"))
    # authors as objects or strings; series as objects, as "S #k", or missing
    as_objects = F.to_json(F.struct(F.col("event_type").alias("title"), F.array(F.struct(name.alias("name"))).alias("authors"), F.array(F.struct(series.alias("name"), k.alias("sequence"))).alias("series")))
    as_strings = F.to_json(F.struct(F.col("event_type").alias("title"), F.array(name).alias("authors"), F.array(F.concat_ws(" #", series, k)).alias("series")))
    bare = F.to_json(F.struct(F.col("event_type").alias("title"), F.array(name).alias("authors")))
    content = F.when(F.col("event_id") % 4 == 0, bare).when(F.col("event_id") % 4 == 1, as_strings).otherwise(as_objects)
    return rows.select("event_id", metadata.read_json(content.cast("binary")).alias("m")).select("event_id", "m.title", "m.author", "m.series", "m.series_index")


@query("exact_dupes", """
WITH f AS (SELECT page_id, sha1(CAST(strlen(html) AS VARCHAR) || html) AS fp FROM pages)
SELECT fp, min(page_id) AS first_id, count(*) AS n FROM f GROUP BY fp""")
def exact_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("html").cast("binary")
    fp = tree.content_fingerprint(content, F.octet_length("html").cast("long"), chunk=None)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fp.alias("fp")).groupBy("fp").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))


@query("book_fingerprints", """
WITH f AS (SELECT source, lang, sha1(CAST(doc_id AS VARCHAR)) AS fp FROM documents)
SELECT source AS book_dir, lang AS kind, count(*) AS parts, substr(sha1(string_agg(fp, '|' ORDER BY fp)), 1, 20) AS fingerprint FROM f GROUP BY source, lang""")
def book_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("book_dir"), F.col("lang").alias("kind"), F.col("doc_id").cast("string").alias("rel_path"))
    fps = parts.select("rel_path").distinct().withColumn("fp", F.sha1("rel_path"))
    return tree.fingerprints_of_parts(parts, fps, ["book_dir", "kind"]).withColumn("fingerprint", F.nullif("fingerprint", F.lit("")))


@query("probed_books", """WITH p AS (SELECT l_orderkey AS id, sum(l_quantity) AS duration, arg_min(CAST(l_suppkey AS INT), l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS bitrate,
  coalesce(list('p' || l_partkey || ' is empty (0 bytes)' ORDER BY l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) FILTER (l_quantity < 9), []) AS bad FROM lineitem GROUP BY l_orderkey)
SELECT id, duration, bitrate, array_to_string(bad[1:3], '; ') || CASE WHEN len(bad) > 3 THEN ' ...' ELSE '' END AS health FROM p""")
def probed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("id"), F.expr("l_linenumber * 10000000000L + l_partkey * 10000 + l_suppkey").alias("ordinal"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_quantity") < 9, 0).otherwise(1).alias("size"),
        F.col("l_quantity").alias("length"), F.col("l_suppkey").cast("int").alias("bitrate"), F.lit("mp3").alias("codec"), F.lit(0).alias("chapters"),
    )
    return enrich.probe(parts).select("id", "duration", "bitrate", "health")


# --- names ---

X = "chr(CAST(97 + c_custkey % 26 AS INT))"


def _case(*values: str) -> str:
    """One of several expressions, by the customer's number."""
    return "CASE " + " ".join(f"WHEN c_custkey % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


def names_query(name: str, raw: list[str], made, /, **want: list[str]) -> None:
    """Register a function of names: ``raw`` names, and what it makes of each, by column."""
    none = lambda k: {"disc": "-1", "n": "-1"}.get(k, "''")
    sql = "SELECT c_custkey, " + ", ".join(f"coalesce({_case(*v)}, {none(k)}) AS {k}" for k, v in want.items()) + " FROM customer"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", f"{_case(*raw)} AS raw").withColumn("m", made("raw"))
        fields = [F.col("m") if len(want) == 1 else F.col("m")[k] for k in want]
        return rows.select("c_custkey", *[F.coalesce(c, F.expr(none(k))).alias(k) for c, k in zip(fields, want, strict=True)])


T = f"concat('Tale ', {X})"
names_query(
    "parsed_names",
    [f"concat('Ann Bell - Tale ', {X}, '.mp3')", f"concat('Tale ', {X}, ' by Ann Bell')", f"concat('[Saga 3] Tale ', {X})", f"concat('Ann Bell - Saga - 02 Tale ', {X})", f"concat('Saga 7 - Tale ', {X})", f"concat('Ann Bell - Tale ', {X}, ' - Saga, Book 4')"],
    udfs.parse_name, title=[T] * 6, author=["'Ann Bell'", "'Ann Bell'", "''", "'Ann Bell'", "''", "'Ann Bell'"], series=["''", "''", "'Saga'", "'Saga'", "'Saga'", "'Saga'"], series_index=["''", "''", "'3'", "'02'", "'7'", "'4'"],
)
names_query(
    "paths_told",
    [f"concat('Ann Bell/Saga Series/03 - Tale ', {X})", f"concat('Dark Trilogy/02 - Tale ', {X})", f"concat('unsorted/Tale ', {X})", f"concat('Dark Saga by Ann Bell/Book 5 - Tale ', {X})"],
    udfs.infer_from_path, title=[T, T, "''", T], author=["'Ann Bell'", "''", "''", "'Ann Bell'"], series=["'Saga'", "'Dark'", "''", "'Dark'"], series_index=["'03'", "'02'", "''", "'5'"],
)
names_query("author_keys", [f"concat('Bell, Ann ', upper({X}), '.')", f"concat('J. R. R. Bell-', {X})", f"concat('Zoë O’Bell', {X})"], udfs.author_key, key=[f"concat('ann ', {X}, ' bell')", f"concat('jrr bell ', {X})", f"concat('zoe o bell', {X})"])
names_query("clean_authors", [f"concat('Bell, Ann', {X}, ' (123)')", f"concat('Ann', {X}, ' Bell & Bob Cole')", f"concat('Ann', {X}, ' Bell Collection')", f"concat('Bell, Ann', {X}, ', Jr.')"], udfs.clean_author, author=[f"concat('Ann', {X}, ' Bell')"] * 3 + [f"concat('Ann', {X}, ' Bell Jr.')"])
names_query("release_junk", [f"concat('[MAM] Tale ', {X}, 'x 128k mono')", f"concat('audiobook_The_Tale_', {X}, 'x_full')", f"concat('Tale ', {X}, 'x {{465mb}} retail')"], udfs.strip_release_junk, name=[f"concat('Tale ', {X}, 'x')", f"concat('The Tale ', {X}, 'x')", f"concat('Tale ', {X}, 'x')"])
names_query("disc_markers", [f"concat('Tale ', {X}, 'x - Disc 2')", "'CD 12'", f"concat('Tale ', {X}, 'x (Part IV of 9)')", f"concat('Tale ', {X}, 'x')"], udfs.split_disc_marker, base=[f"concat('Tale ', {X}, 'x')", "''", f"concat('Tale ', {X}, 'x')", f"concat('Tale ', {X}, 'x')"], disc=["2", "12", "4", "NULL"])
names_query("disc_folders", ["concat('0', CAST(c_custkey % 10 AS STRING))", "concat('D', CAST(c_custkey % 100 AS STRING))", "concat('(', CAST(c_custkey % 17 AS STRING), 'of17)')", "'Part VII - The End'", "'Home'"], udfs.disc_child_number, n=["CAST(c_custkey % 10 AS INT)", "CAST(c_custkey % 100 AS INT)", "CAST(c_custkey % 17 AS INT)", "7", "NULL"])
names_query("group_prefixes", [f"concat('Ann Bell - Tale ', {X}, 'x - 07')", f"concat('Chapter 3 Tale ', {X}, 'x')", f"concat('Tale ', {X}, 'x_Track12')", f"concat('Tale ', {X}, 'x')"], udfs.prefix_key, key=[f"concat('ann bell - tale ', {X}, 'x')", "''", f"concat('tale ', {X}, 'x')", "NULL"])
names_query("clean_titles", [f"concat('Tale ', {X}, 'x (read by Rob Inn) [MP3]')", f"concat('Tale ', {X}, 'x_ A Story (Unabridged)')", f"concat('Tale ', {X}, 'x: A Novel')"], lambda c: udfs.clean_text(c, F.lit("Ann Bell"), F.lit("")), text=[f"concat('Tale ', {X}, 'x')", f"concat('Tale ', {X}, 'x: A Story')", f"concat('Tale ', {X}, 'x')"], narrator=["'Rob Inn'", "''", "''"])
names_query(
    "finished_books",
    [f"concat('Tale ', {X}, 'x: Dark Saga, Book 3')", f"concat('tale ', {X}, 'x.epub')", f"concat('Tale ', {X}, 'x (narrated by Rob Inn)')"],
    lambda c: resolve.finished(c, F.lit("Bell, Ann"), F.lit("Dark Saga"), F.lit("3"), F.lit("Box (Books 5-8)")),
    title=[f"concat('Tale ', {X}, 'x (5-8)')", f"concat('Tale ', upper({X}), 'x (5-8)')", f"concat('Tale ', {X}, 'x (5-8)')"], author=["'Ann Bell'"] * 3, series=["'Dark Saga'"] * 3, series_index=["'3'"] * 3, narrator=["''", "''", "'Rob Inn'"],
)
names_query("part_numbers", [f"concat('01 - Tale ', {X}, 'x')", f"concat('Tale ', {X}, 'x Part 3')", f"concat('Tale ', {X}, 'x (3 of 12)')", "'1984'"], udfs.file_group_key, key=[f"concat('tale ', {X}, 'x')"] * 3 + ["'1984'"])


# --- without SQL: held against brute force in the tests ---


@query("fuzzy_pairs")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between parts as books (name as title, brand as author): all reasons, with no cap on blocks."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("id"), F.lit("ebook").alias("kind"), F.col("p_name").alias("title"), F.concat(F.lit("Maker "), F.translate("p_brand", "0123456789#", "abcdefghij")).alias("author"), F.lit("ready").alias("status"),
    )
    return dedupe.edges(materialize(dedupe.records(conform(rows)), "recs"), threshold=80, every=True)


assert set(FIELDS) - {"id", "path", "size"} <= {x.split()[0] for x in schema.BOOK.replace("\n", " ").split(", ")}
