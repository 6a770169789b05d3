"""Views of the catalog: counters, filters, search, sorting, paging, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions import columns as C


def state_counts(books: DataFrame, threshold: int, duplicates: DataFrame | None = None) -> DataFrame:
    """One row of conditional counts, in one pass."""
    s, live = F.col("status"), ~F.col("status").isin("copied", "moved", "skipped")
    named = (C.text("author") != "") & (C.text("title") != "")
    open_ = live & (s != "in destination") & ~s.startswith("ERROR")
    counts = {
        "total": F.count("*"), "ready": F.count_if(open_ & named), "review": F.count_if(open_ & ~named), "copied": F.count_if(s == "copied"),
        "moved": F.count_if(s == "moved"), "exists": F.count_if(s == "in destination"), "error": F.count_if(s.startswith("ERROR")),
        "skipped": F.count_if(s == "skipped"), "low": F.count_if(live & (F.col("confidence") < threshold)),
        "damaged": F.count_if(live & (C.text("health") != "")), "ai": F.count_if(live & F.coalesce(F.col("ai.pending"), F.lit(False))),
    }
    out = books.agg(*[c.alias(k) for k, c in counts.items()])
    if duplicates is None:
        return out.withColumn("dups", F.lit(0).cast("long"))
    return out.join(duplicates.select(F.explode("ids").alias("id")).agg(F.count_distinct("id").alias("dups")))


def matches(status: str, threshold: int) -> Column:
    """The predicate behind a status filter of the list."""
    done = F.col("status").isin("copied", "moved", "skipped")
    known = (C.text("author") != "") & (C.text("title") != "")
    return {
        "": F.lit(True), "review": ~known, "copied": F.col("status").isin("copied", "moved"), "pending": ~done, "skipped": F.col("status") == "skipped",
        "low": ~done & (F.col("confidence") < threshold), "damaged": C.text("health") != "", "ai": F.coalesce(F.col("ai.pending"), F.lit(False)),
        "nocover": C.text("cover") == "", "exists": F.col("status") == "in destination",
        "approved": (F.size(F.array_intersect("locked", F.array(F.lit("title"), F.lit("author")))) == 2) | (F.col("confidence") >= threshold),
    }[status]


def search(q: str, *columns: str) -> Column:
    """A substring of the lower-cased values; '%' and '_' are letters like others."""
    return F.lower(F.concat_ws(" ", *[C.text(c) for c in columns])).contains(q.lower().strip()) if q.strip() else F.lit(True)


def listing(books: DataFrame, *, status: str = "", q: str = "", sort: str = "author", threshold: int = 70, duplicates: DataFrame | None = None) -> DataFrame:
    """Filtered and sorted books."""
    if status == "dups":
        rows = books.join(duplicates.select(F.explode("ids").alias("id")).distinct(), "id", "left_semi") if duplicates is not None else books.where("false")
    else:
        rows = books.where(matches(status, threshold))
    rows = rows.where(search(q, "author", "series", "title", "narrator", "src_display"))
    low = lambda c: F.lower(C.text(c))
    order = ["confidence", low("author"), "id"] if sort == "conf" else [low("author"), low("series"), C.series_index("series_index"), low("title"), "id"]
    return rows.orderBy(*order)


def page(rows: DataFrame, number: int = 1, per_page: int = 200) -> tuple[DataFrame, int, int]:
    """(rows of a page, total, pages); pages have 10 to 2,000 rows."""
    per, total = min(2000, max(10, per_page)), rows.count()
    return rows.offset((max(1, number) - 1) * per).limit(per), total, max(1, -(-total // per))


def list_columns(books: DataFrame, threshold: int, root: str = "", layout: str = "nested_series") -> DataFrame:
    dest = C.dest_folder(root, F.col("author"), F.col("series"), F.col("series_index"), F.col("title"), layout)
    return books.select(
        "id", "kind", "author", "series", "series_index", "title", "narrator", "status", "meta_source", "confidence",
        (F.col("confidence") < threshold).alias("low"), matches("approved", threshold).alias("approved"), C.duration("duration").alias("duration"), dest.alias("dest"),
    )


def detail(books: DataFrame, book_id: int, root: str = "") -> DataFrame:
    """One book with all fields and at most 60 of its files, relative to the root."""
    short = F.transform(F.slice("files", 1, 60), lambda f: F.when(f.startswith(root + "/") & F.lit(bool(root)), F.substr(f, F.lit(len(root) + 2))).otherwise(f))
    return books.where(F.col("id") == book_id).withColumn("file_list", short)


def hold_reason(threshold: int, move: bool, min_confidence: int | None = None, *, hold_damaged: bool = True, hold_review: bool = True) -> Column:
    """Why a book isn't transferred, or null; the first reason that applies counts. A move takes only books that
    are approved: sure enough, or with title and author locked; a copy holds back what is below ``min_confidence``."""
    locked = F.size(F.array_intersect(F.coalesce("locked", F.array().cast("array<string>")), F.array(F.lit("title"), F.lit("author")))) == 2
    held = F.when(F.lit(hold_damaged) & (C.text("health") != ""), "damaged").when(F.lit(hold_review) & ((C.text("author") == "") | (C.text("title") == "")), "incomplete")
    if move:
        return held.when((F.col("confidence") < max(threshold, min_confidence or 0)) & ~locked, "unapproved")
    return held.when(F.col("confidence") < min_confidence, "low confidence") if min_confidence else held


def collisions(books: DataFrame, dest: str = "dest") -> DataFrame:
    """(folder, n) of destination folders, equal but for case, that two books or more would share."""
    return books.groupBy(F.lower(dest).alias("folder")).agg(F.count("*").alias("n")).where("n > 1")


def numbered_folders(rows: DataFrame, base: str, order: str) -> DataFrame:
    """``free``: the folder, with ' (k)' from the second of a name on."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(F.lower(base)).orderBy(order))
    return rows.withColumn("free", F.when(k == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit(" ("), k.cast("string"), F.lit(")"))))


EXPORT = (
    "id", "kind", "status", "author", "series", "series_index", "title", "narrator", "year", "publisher", "language", "asin", "isbn",
    "confidence", "meta_source", "health", "src_display", "fingerprint",
)


def export_csv(books: DataFrame, path: str) -> None:
    """The plan as CSV, sorted."""
    books.select(*EXPORT).orderBy(F.lower("author"), F.lower("series"), F.lower("title"), "id").write.csv(path, header=True)


def journal_page(journal: DataFrame, limit: int = 100_000) -> DataFrame:
    """What was done, newest first."""
    return journal.orderBy(F.col("id").desc()).limit(limit)


def export_journal(journal: DataFrame, path: str, limit: int = 100_000) -> None:
    journal_page(journal, limit).write.csv(path, header=True)
