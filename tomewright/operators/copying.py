"""The copy or move of a plan: what is held back, what would go wrong, and the books one by one."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.functions import columns as C
from tomewright.functions import fixed
from tomewright.operators import sink, views
from tomewright.session import forget, materialize


class Refused(ValueError):
    """The transfer isn't begun; the message says why."""


@dataclass(frozen=True)
class Options:
    move: bool = False
    conflict: str = "skip"
    layout: str = "nested_series"
    threshold: int = 70
    min_confidence: int = 0
    hold_damaged: bool = True
    hold_review: bool = True
    keep_all: bool = False
    force: bool = False
    rename_parts: bool = False
    write_opf: bool = True
    write_json: bool = True
    write_cover: bool = True
    embed: bool = True
    embed_cover: bool = True


def split(books: DataFrame, o: Options, ids: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(books to transfer, (id, hold) of those held back) of the books that aren't done with."""
    todo = books.where(~F.col("status").isin(*fixed.DONE_STATUSES))
    todo = todo.where(F.col("id").isin(ids)) if ids else todo
    reason = views.hold_reason(o.threshold, o.move, o.min_confidence, hold_damaged=o.hold_damaged, hold_review=o.hold_review)
    judged = todo.withColumn("hold", reason)
    return judged.where("hold IS NULL").drop("hold"), judged.where("hold IS NOT NULL").select("id", "hold")


def mixed_folders(todo: DataFrame, dest: str, layout: str) -> DataFrame:
    """(folder, n) of the folders that books would share."""
    folder = C.dest_folder(dest, F.col("author"), F.col("series"), F.col("series_index"), F.col("title"), layout)
    return views.collisions(todo.select(folder.alias("dest")))


def dirs_in_use(books: DataFrame, moving: DataFrame) -> DataFrame:
    """(dir) of source folders where a book lives that isn't done with and isn't among ``moving``."""
    waiting = books.where(~F.col("status").isin(*fixed.DONE_STATUSES)).join(moving.select("id"), "id", "left_anti")
    return waiting.select(F.explode("files").alias("f")).select(C.dirname("f").alias("dir")).distinct()


def bytes_needed(todo: DataFrame, files: DataFrame) -> int:
    """Bytes of the books' files and extras, of (path, size)."""
    every = F.concat("files", F.coalesce("extras", F.array().cast("array<string>")))
    parts = todo.select(F.explode(every).alias("path"))
    return parts.join(files.select("path", "size"), "path").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n


def writable(folder: str) -> bool:
    """Whether files can be made and removed in a folder."""
    probe = os.path.join(folder, f".write-test-{os.getpid()}")
    try:
        with open(probe, "w"):
            pass
        os.remove(probe)
    except OSError:
        return False
    return True


def guard(todo: DataFrame, files: DataFrame, source: str, dest: str, o: Options) -> None:
    """Refuse what would mix books, fill the disk, or copy into the source."""
    source, dest = os.path.normpath(source), os.path.normpath(dest)
    if o.conflict not in ("skip", "keep_better", "replace", "keep_both"):
        raise Refused(f"unknown conflict option {o.conflict}")
    if dest == source or dest.startswith(source + os.sep):
        raise Refused("the destination must not be inside the source folder")
    if o.move and not writable(source):
        raise Refused("a move removes books from the source, which can't be written")
    os.makedirs(dest, exist_ok=True)
    if o.force or o.keep_all:
        return
    shared = mixed_folders(todo, dest, o.layout).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).first().n
    if shared:
        raise Refused(f"{shared} book(s) would land in a folder that another book already uses")
    need, free = bytes_needed(todo, files), shutil.disk_usage(dest).free
    if need > free * 0.98 and not (o.move and os.stat(source).st_dev == os.stat(dest).st_dev):
        raise Refused(f"not enough space: {need} bytes are needed and {free} are free")


def transfer(books: DataFrame, files: DataFrame, source: str, dest: str, o: Options = Options(), ids: list[int] | None = None, journal: str | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(books with their new status, (id, status, folder) of every book that was tried).

    What is done of each book is in ``journal`` (a folder in the destination, if none is named) as soon as it is
    done; a run that was killed or stopped goes on from there when it is called again."""
    todo, held = split(books, o, ids)
    todo = materialize(todo, "to-transfer")
    if todo.isEmpty():
        raise Refused("nothing to transfer: " + ", ".join(f"{r['count']} {r.hold}" for r in held.groupBy("hold").count().orderBy("hold").collect()))
    guard(todo, files, source, dest, o)
    plan = sink.copy_plan(todo, dest, layout=o.layout, rename_parts=o.rename_parts, write_cover=o.write_cover, move=o.move)
    if o.keep_all:  # books that would share a folder get folders of their own
        own = plan.select("id", "folder").distinct()
        plan = plan.join(views.numbered_folders(own, "folder", "id").select("id", "free"), "id").withColumn("folder", F.col("free")).drop("free")
    nothing = F.lit(None).cast("string")
    documents = todo.select(
        "id", (sink.opf_document() if o.write_opf else nothing).alias("opf"), (F.to_json(F.struct(*fixed.EDITABLE)) if o.write_json else nothing).alias("document"),
        (F.col("cover") if o.write_cover else nothing).alias("cover"),
    )
    how = sink.Finishing(o.embed, o.embed_cover)
    # a written table: the plan must not change while its books move
    plan = materialize(plan, "transfer-plan")
    waiting = materialize(dirs_in_use(books, todo), "dirs-in-use")
    done = list(sink.execute(plan, dest, move=o.move, conflict=o.conflict, source_root=source, documents=documents, in_use=waiting, journal=journal, how=how))
    told = books.sparkSession.createDataFrame(done, "id long, status string, folder string")
    after = books.join(told.select("id", F.col("status").alias("_s")), "id", "left").withColumn("status", F.coalesce("_s", "status"))
    forget(plan, waiting)
    return after.select(*books.columns), told
