"""Edits of the plan: which books an action is meant for, and what it makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.functions import fixed
from tomewright.operators import decisions

NONE = "array<string>"


def targets(books: DataFrame, ids: list[int] | None = None, which: str = "all", threshold: int = 70) -> DataFrame:
    """(id) of the books that an action is for: those named, or, of those not done with, all, the 'low' or the 'new'."""
    if ids:
        return books.where(F.col("id").isin(ids)).select("id")
    live = books.where(~F.col("status").isin(*fixed.DONE_STATUSES))
    kept = {"low": F.col("confidence") < threshold, "new": ~F.coalesce("enriched", F.lit(False))}.get(which, F.lit(True))
    return live.where(kept).select("id")


def remove(books: DataFrame, ids: DataFrame) -> DataFrame:
    """The plan without some books; their files stay where they are."""
    return books.join(ids.select("id"), "id", "left_anti").select(*books.columns)


def skip(books: DataFrame, ids: DataFrame, skipped: bool = True) -> tuple[DataFrame, DataFrame]:
    """(books, corrections): books are skipped, or taken up again; it is remembered by content."""
    rows = books.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.col("status").isin("copied", "moved")
    state = F.lit("skipped") if skipped else decisions.status(F.col("author"), F.col("title"), F.lit("pending"))
    told = rows.where(hit & (F.coalesce("fingerprint", F.lit("")) != ""))
    fields = F.create_map(F.lit("_status"), F.lit("skipped" if skipped else ""))
    corrections = told.select(F.col("fingerprint").alias("fp"), fields.alias("fields"), F.current_timestamp().alias("ts"))
    return rows.withColumn("status", F.when(hit, state).otherwise(F.col("status"))).select(*books.columns), corrections


def approve(books: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, corrections): title and author of books are confirmed as they are."""
    said = F.create_map(F.lit("title"), F.col("title"), F.lit("author"), F.col("author"))
    return decisions.remember(books, books.join(ids.select("id"), "id", "left_semi").select("id", said.alias("fields")))


def set_fields(books: DataFrame, ids: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(books, corrections) after one edit of many books; only editable fields count."""
    said = [F.lit(x) for k, v in fields.items() if k in fixed.EDITABLE for x in (k, v.strip())]
    if not said:
        raise ValueError("no field that can be edited")
    return decisions.remember(books, ids.select("id", F.create_map(*said).alias("fields")))


def accept_answers(books: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, corrections): pending answers of a model become title and author."""
    told = books.join(ids.select("id"), "id", "left_semi").where("ai.pending")
    either = lambda k: F.when(F.coalesce(F.col(f"ai.{k}"), F.lit("")) != "", F.col(f"ai.{k}")).otherwise(F.col(k))
    fields = F.create_map(F.lit("title"), either("title"), F.lit("author"), either("author"))
    after, corrections = decisions.remember(books, told.select("id", fields.alias("fields")))
    done = after.join(told.select("id", F.lit(True).alias("_hit")), "id", "left")
    return done.withColumn("ai", F.when(F.col("_hit"), F.col("ai").withField("pending", F.lit(False))).otherwise(F.col("ai"))).select(*books.columns), corrections


def choose_cover(books: DataFrame, book_id: int, path: str) -> DataFrame:
    """One of a book's gathered covers becomes its cover."""
    found = F.get(F.filter("cover_candidates", lambda c: c["path"] == path), F.lit(0))
    hit = (F.col("id") == book_id) & found.isNotNull()
    info = F.concat(found["w"].cast("string"), F.lit("x"), found["h"].cast("string"), F.lit(" "), found["origin"])
    return books.withColumns({"cover": F.when(hit, found["path"]).otherwise(F.col("cover")), "cover_info": F.when(hit, info).otherwise(F.col("cover_info"))})
