"""From a file tree to catalog rows: listing, grouping, evidence, clean-up, memory, library-wide passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions import columns as C
from tomewright.functions import udfs
from tomewright.operators import decisions, resolve, schema
from tomewright.session import materialize
from tomewright.sources import ledger, metadata, tree

EMPTY_META = "named_struct('title', '', 'author', '', 'series', '', 'series_index', '')"


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    """The books below ``root`` as rows of the catalog's table (see ``schema.BOOK``)."""
    return scan_again(spark, root, None, **options)[0]


def scan_again(spark: SparkSession, root: str, known: DataFrame | None, *, aliases: DataFrame | None = None, corrections: DataFrame | None = None, **trust: bool) -> tuple[DataFrame, DataFrame]:
    """(books, ledger): ``known`` is the ledger of the scan before, and only files that it doesn't know, or knows with
    another size or time, are opened."""
    files = materialize(tree.list_tree(spark, root), "tree")
    found = materialize(tree.books_of(files), "books")
    told = materialize(ledger.brought_up_to_date(ledger.wanted(files, found), root, known), "ledger")
    found = tree.book_fingerprints(found, told.select("rel_path", "fp"))
    side = metadata.sidecar_choice(files, told.where("content IS NOT NULL").select("rel_path", "content"))
    first = told.where("many IS NOT NULL").select(F.col("rel_path").alias("_first"), "tags")
    rows = found.join(side.withColumnRenamed("dir", "book_dir"), "book_dir", "left").join(first, F.get(F.col("files"), F.lit(0)) == F.col("_first"), "left")
    none = F.expr(EMPTY_META)
    many = F.size("files") > 1
    leaf = C.strip_catalog_id(C.basename("book_dir"))
    parent = C.basename(C.dirname("book_dir"))
    # a number below an author's folder is a title ('George Orwell/1984'), else a year or a count
    numeric = leaf.rlike(r"^\d{1,4}$") & (parent != "") & C.looks_like_author(parent)
    folder = F.when(C.is_junk_folder(leaf) & ~numeric, "").otherwise(udfs.split_disc_marker(leaf)["base"])
    stem = F.when(many & (F.col("kind") == "audio"), "").otherwise(udfs.split_disc_marker(C.stem("_first"))["base"])
    rows = rows.withColumns({
        "opf": F.coalesce("opf", none), "json": F.coalesce("json", none), "path": udfs.infer_from_path("book_dir"),
        "tags": F.coalesce("tags", none),
    })
    known = F.coalesce(*[F.nullif(F.col(f"{c}.author"), F.lit("")) for c in ("opf", "json", "path", "tags")], F.lit(""))
    rows = rows.withColumns({"_known": known, "_folder": folder, "_stem": stem})
    ebook = F.col("kind") == "ebook"  # whose file name goes before its folder's
    rows = rows.withColumns({"hint_meta": resolve.ordered_name("hint", "_known"), "folder": resolve.ordered_name(F.when(ebook, F.col("_stem")).otherwise(F.col("_folder")), "_known"), "stem": resolve.ordered_name(F.when(ebook, F.col("_folder")).otherwise(F.col("_stem")), "_known"), "hint_text": F.col("hint")})
    rows = rows.drop("hint").withColumnRenamed("hint_meta", "hint")
    rows = resolve.merge_evidence(rows, resolve.order(**trust))
    # the sidecar that speaks is the package, if it says anything
    says = lambda c: F.concat_ws("", *[F.col(f"{c}.{k}") for k in resolve.FIELDS]) != ""
    rows = rows.withColumn("_side", F.when(says("opf"), F.col("opf")).otherwise(F.col("json")))
    rows = rows.withColumn("meta_source", resolve.note_conflict(F.col("meta_source"), "_side", "tags", "path", trust.get("trust_folders", True)))
    lone = (F.col("author") == "") & (parent != "") & C.looks_like_author(parent) & ~parent.rlike("(?i)" + tree.fixed.SERIES_WORDS)
    fallback = F.when(F.col("hint_text") != "", F.col("hint_text")).when(F.col("_folder") != "", F.col("_folder")).otherwise(C.stem("_first"))
    rows = rows.withColumns({"author": F.when(lone, parent).otherwise(F.col("author")), "title": F.when(F.col("title").rlike(r"\p{L}|\p{N}{3,}"), F.col("title")).otherwise(fallback)})
    # which of title and series an audio book's folder names is the title
    said = F.lower(udfs.clean_text(F.regexp_replace("_folder", r"^(?:19|20)\d{2}\s*[-._]\s*", ""), F.col("author"), F.lit(""))["text"])
    swap = ~ebook & (F.col("series") != "") & (F.col("title") != "") & (said != "") & (udfs.similar(said, "series") > 0.85) & (udfs.similar(said, "title") < 0.6)
    rows = rows.withColumns({"title": F.when(swap, F.col("series")).otherwise(F.col("title")), "series": F.when(swap, F.col("title")).otherwise(F.col("series"))})
    rows = rows.withColumn("_done", resolve.finished("title", "author", "series", "series_index", F.concat_ws(" ", C.basename("book_dir"), "hint_text")))
    books = rows.select(
        F.xxhash64("book_dir", "kind", "files").alias("id"), "kind", "files", "extras", F.col("book_dir").alias("src_display"), "_done.*", "meta_source", "fingerprint",
        F.lit("pending").alias("status"), F.lit(0).alias("match_bonus"), F.array().cast("array<string>").alias("locked"), F.array().cast("array<string>").alias("flags"),
    )
    books = conform(books)
    if aliases is not None and corrections is not None:
        books = decisions.merge_remembered(decisions.apply_memory(books, aliases, corrections), corrections)
    return resolve.narrator_pass(resolve.library_pass(materialize(books, "resolved"))), told


def conform(books: DataFrame) -> DataFrame:
    """All columns of the catalog's table, in order; those that are missing are null."""
    wanted = books.sparkSession.createDataFrame([], schema.BOOK).schema
    return books.select(*[(F.col(f.name) if f.name in books.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def load_plan(spark: SparkSession, path: str) -> DataFrame:
    """A saved plan: JSON rows; fields that are unknown are ignored, missing ones null."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    # a save that was cut off between its two renames has left the old plan beside
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema.BOOK).option("mode", "PERMISSIVE").json(path if fs.exists(there) else f"{path}.old")


def save_plan(books: DataFrame, path: str) -> None:
    """The plan as JSON rows: written whole beside the old one, which then gives way, so one of both is always there."""
    fresh, old = f"{path}.new", f"{path}.old"
    books.write.mode("overwrite").json(fresh)
    jvm, conf = books.sparkSession.sparkContext._jvm, books.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(fresh), at(path))
    fs.delete(at(old), True)
