"""The copy or move of resolved books: planned as DataFrames, carried out by a data source that writes books.

A book is transferred whole or not at all, and nothing is deleted before its content is found equal at the
destination in full (sizes and all bytes, not only the fingerprint). Tasks run on the executors, which must see
source and destination at the same paths. Spark may run a task again, and a run may be killed: so every
operation is written to a journal before it is done. Who comes next finds there which books are done, undoes what
was begun and not committed, and completes what was committed."""

from __future__ import annotations

import fcntl
import filecmp
import glob
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tomewright.functions import columns as C
from tomewright.functions import fixed
from tomewright.operators import containers, writers
from tomewright.sources.tree import os_path, path_text

OS_JUNK = ("thumbs.db", "desktop.ini", ".ds_store", "@eadir", ".@__thumb", ".@__desc")


def copy_plan(books: DataFrame, root: str, *, layout: str = "nested_series", rename_parts: bool = False, write_cover: bool = False, move: bool = False) -> DataFrame:
    """(id, ordinal, src, folder, target, is_primary): the names that a book's files get, unique within it."""
    folder = C.dest_folder(root, F.col("author"), F.col("series"), F.col("series_index"), F.col("title"), layout)
    dirs = F.size(F.array_distinct(F.transform("files", lambda f: C.dirname(f))))
    every = F.concat(F.transform("files", lambda f, i: F.struct(f.alias("src"), (i + 1).alias("part"))), F.transform("extras", lambda f: F.struct(f.alias("src"), F.lit(0).alias("part"))))
    rows = books.select("id", "kind", "title", "cover", folder.alias("folder"), F.size("files").alias("n"), dirs.alias("dirs"), F.posexplode(every).alias("ordinal", "x"))
    rows = rows.select("*", F.col("x.src").alias("src"), F.col("x.part").alias("part"), C.extension("x.src").alias("ext"), C.basename("x.src").alias("leaf"))
    audio, ebook = F.col("ext").isin(*fixed.AUDIO_EXTS), F.col("ext").isin(*fixed.EBOOK_EXTS)
    is_cover = F.lit(write_cover) & (C.text("cover") != "") & (F.col("part") == 0) & F.col("leaf").rlike(r"(?i)^(cover|folder|front)\.(jpe?g|png)$")
    single = ((F.col("kind") == "ebook") | (F.col("n") == 1)) & (audio | ebook)
    number = F.lpad(F.col("part").cast("string"), F.greatest(F.lit(2), F.length(F.col("part").cast("string"))), "0")
    plain = F.when((F.col("dirs") > 1) & audio, F.concat(C.sanitize(C.basename(C.dirname("src"))), F.lit(" - "), "leaf")).otherwise(F.col("leaf"))
    renamed = F.lit(rename_parts) & (F.col("part") > 0) & audio
    name = F.when(is_cover, F.concat(F.lit("original-"), "leaf")).when(single, F.concat(C.sanitize("title"), "ext")).when(renamed, F.concat(C.sanitize("title"), F.lit(" - "), number, "ext")).otherwise(plain)
    rows = rows.withColumn("name", name)
    if not move:
        rows = rows.where(~is_cover)
    again = F.row_number().over(Window.partitionBy("id", F.lower("name")).orderBy("ordinal"))
    mark = F.concat(F.lit(" ("), F.col("part").cast("string"), F.lit(")"))
    stem_, end = F.regexp_replace("name", r"(?<=[^.])\.[^.]*$", ""), F.regexp_extract("name", r"[^.](\.[^.]*)$", 1)
    rows = rows.withColumn("target", F.when(again > 1, F.concat(stem_, mark, end)).otherwise(F.col("name")))
    return rows.select("id", "ordinal", "src", "folder", "target", (F.col("part") > 0).alias("is_primary"))


def opf_document(author: str = "author", title: str = "title") -> Column:
    """A package document of a book's columns, as a Column."""
    esc = lambda c: F.replace(F.replace(F.replace(C.text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda tag, c: F.when(C.text(c) != "", F.concat(F.lit(f"<dc:{tag}>"), esc(c), F.lit(f"</dc:{tag}>")))
    meta = lambda name, c: F.when(C.text(c) != "", F.concat(F.lit(f'<meta name="{name}" content="'), F.replace(esc(c), F.lit('"'), F.lit("&quot;")), F.lit('"/>')))
    subjects = F.array_join(F.transform(F.slice(F.filter(F.transform(F.split(C.text("genres"), ","), F.trim), lambda g: g != ""), 1, 6), lambda g: F.concat(F.lit("<dc:subject>"), g, F.lit("</dc:subject>"))), "\n")
    return F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="utf-8"?>'),
        F.lit('<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">'),
        line("title", title), F.when(C.text(author) != "", F.concat(F.lit('<dc:creator opf:role="aut">'), esc(author), F.lit("</dc:creator>"))),
        F.when(C.text("narrator") != "", F.concat(F.lit('<dc:contributor opf:role="nrt">'), esc("narrator"), F.lit("</dc:contributor>"))),
        line("publisher", "publisher"), line("date", "year"), line("language", "language"), line("description", "description"), F.nullif(subjects, F.lit("")),
        F.when(C.text("isbn") != "", F.concat(F.lit('<dc:identifier opf:scheme="ISBN">'), esc("isbn"), F.lit("</dc:identifier>"))),
        F.when(C.text("asin") != "", F.concat(F.lit('<dc:identifier opf:scheme="ASIN">'), esc("asin"), F.lit("</dc:identifier>"))),
        meta("calibre:series", "series"), meta("calibre:series_index", "series_index"), F.lit("</metadata></package>"),
    )


def json_document(row: dict, old: dict) -> dict:
    """metadata.json of a book: our values, and the old file's where ours are empty."""
    listed = lambda s: [x.strip() for x in (s or "").split(",") if x.strip()]
    series = [f"{row['series']} #{row['series_index']}" if row.get("series_index") else row["series"]] if row.get("series") else []
    ours = {
        "title": row.get("title"), "authors": listed(row.get("author")), "narrators": listed(row.get("narrator")), "series": series, "genres": listed(row.get("genres")),
        "publishedYear": row.get("year"), "publisher": row.get("publisher"), "description": row.get("description"), "isbn": row.get("isbn"), "asin": row.get("asin"), "language": row.get("language"),
    }
    return old | {k: v for k, v in ours.items() if v or k not in old}


class BookExists(Exception):
    """Another copy of the book is at the destination."""


class Transfer:
    """One book's file operations, each told to ``log`` before it is done, which can all be undone."""

    def __init__(self, move: bool, log: Callable[[list], None] = lambda op: None) -> None:
        self.move, self.log = move, log
        self.done: list[tuple[str, str, str]] = []
        self.sources: list[tuple[str, str]] = []

    def _begin(self, how: str, src: str, target: str) -> None:
        self.log([how, src, target])
        self.done.append((how, src, target))

    def put(self, src: str, target: str) -> None:
        same_drive = os.stat(src).st_dev == os.stat(os.path.dirname(target)).st_dev
        if self.move and same_drive:
            self._begin("rename", src, target)
            os.rename(src, target)
            return
        part = f"{target}.{uuid.uuid4().hex}.part"  # a half-written file never has the final name
        self._begin("part", src, part)
        shutil.copy2(src, part)
        if not filecmp.cmp(src, part, shallow=False):
            raise OSError(f"the copy of {src} differs")
        self._begin("copy", src, target)
        os.rename(part, target)
        if self.move:
            self.sources.append((src, target))

    def set_aside(self, target: str, place: str) -> None:
        os.makedirs(os.path.dirname(place), exist_ok=True)
        self._begin("aside", target, place)
        os.rename(target, place)

    def undo(self) -> list[str]:
        problems = undo(self.done)
        self.done.clear()
        return problems

    def finish(self) -> None:
        """From here on the book is at the destination, whatever happens."""
        self.log(["commit", self.sources])
        remove_sources(self.sources)


def undo(operations: list) -> list[str]:
    """Take operations back, the last first; those that hadn't happened are passed over. Returns what couldn't be undone."""
    problems = []
    for how, src, target in reversed(operations):
        try:
            if how == "part" and os.path.exists(target):
                os.remove(target)
            elif how == "copy" and os.path.exists(target) and filecmp.cmp(src, target, shallow=False):
                os.remove(target)
            elif how in ("rename", "aside") and os.path.exists(target) and not os.path.exists(src):
                os.makedirs(os.path.dirname(src), exist_ok=True)
                os.rename(target, src)
        except OSError as e:
            problems.append(f"could not restore {src}: {e}")
    return problems


def remove_sources(sources: list) -> None:
    """Delete originals whose copies are at the destination."""
    for src, target in sources:
        if os.path.exists(src) and os.path.exists(target):
            os.remove(src)


def _better(mine: list[str], theirs: list[str], bitrate: Callable[[str], int]) -> bool:
    total = lambda paths: (bitrate(paths[0]), sum(os.path.getsize(p) for p in paths))
    return total(mine) > total(theirs)


def _free(folder: str) -> str:
    k, found = 2, folder
    while os.path.exists(found):
        found, k = f"{folder} ({k})", k + 1
    return found


def transfer_book(files: list[tuple[str, str, bool]], folder: str, root: str, *, move: bool = False, conflict: str = "skip", aside: str = ".replaced", bitrate: Callable[[str], int] = lambda p: 0, log: Callable[[list], None] = lambda op: None) -> tuple[str, list[tuple[str, str]]]:
    """Carry out one book's plan [(src, name, primary)]; returns its folder and what was done. Raises BookExists
    where another copy is in the way and ``conflict`` (skip, keep_better, replace, keep_both) says to leave it."""
    at = lambda name: os.path.join(folder, name)
    clashes = [(s, at(n)) for s, n, primary in files if primary and os.path.exists(at(n)) and not filecmp.cmp(s, at(n), shallow=False)]
    if clashes and conflict == "keep_both":
        folder, clashes = _free(folder), []
    elif clashes and (conflict == "skip" or conflict == "keep_better" and not _better([s for s, _ in clashes], [x for _, x in clashes], bitrate)):
        raise BookExists(folder)
    work, made = Transfer(move, log), not os.path.isdir(folder)
    os.makedirs(folder, exist_ok=True)
    try:
        for _, old in clashes:
            work.set_aside(old, os.path.join(root, aside, os.path.relpath(old, root)))
        for src, name, primary in files:
            target = at(name)
            if os.path.exists(target):
                if filecmp.cmp(src, target, shallow=False):
                    work.sources += [(src, target)] * move
                    continue
                if not primary:
                    stem_, end = os.path.splitext(target)
                    target = next(p for k in range(2, 10_000) if not os.path.exists(p := f"{stem_} ({k}){end}"))
            work.put(src, target)
        told = [(how, target) for how, _, target in work.done]
        work.finish()
        return folder, told
    except BaseException as e:
        problems = work.undo()
        if made and not os.listdir(folder):
            os.rmdir(folder)
        if problems:
            raise OSError("; ".join(problems)) from e
        raise


def tidy(dirs: list[str], root: str) -> None:
    """Remove folders that a move has emptied (but for what file managers leave), never the root."""
    for folder in sorted(set(dirs), key=len, reverse=True):
        while os.path.realpath(folder).startswith(os.path.realpath(root) + os.sep) and os.path.isdir(folder):
            left = os.listdir(folder)
            if any(x.lower() not in OS_JUNK for x in left):
                break
            shutil.rmtree(folder)
            folder = os.path.dirname(folder)


def follow(dirs: list[str], folder: str) -> None:
    """Sidecars that are all that is left in a book's folders go after it; nothing at the destination is overwritten."""
    for place in (d for d in dirs if os.path.isdir(d)):
        left = [os.path.join(place, x) for x in os.listdir(place) if x.lower() not in OS_JUNK]
        if not all(os.path.isfile(x) and os.path.splitext(x)[1].lower() in fixed.SIDECAR_EXTS for x in left):
            continue
        for src in left:
            name = os.path.basename(src)
            free = next((t for t in (os.path.join(folder, name), os.path.join(folder, f"original-{name}")) if not os.path.exists(t)), None)
            if os.path.exists(os.path.join(folder, name)) and filecmp.cmp(src, os.path.join(folder, name), shallow=False):
                os.remove(src)
            elif free:
                shutil.move(src, free)


@dataclass(frozen=True)
class Finishing:
    """What is written once a book's files are there."""

    embed: bool = False
    embed_cover: bool = False


def finish(folder: str, opf: str | None, document: str | None, cover: str | None, parts: list[str] = [], how: Finishing = Finishing()) -> list[str]:  # noqa: B006, B008
    """A book's cover, package and metadata.json beside it, and its fields and cover within ``parts`` (its files, in
    order). Each by itself: what goes wrong with one is told, and the others are written all the same."""
    problems: list[str] = []
    image = b""

    def attempt(what: str, run: Callable[[], None]) -> None:
        try:
            run()
        except (OSError, ValueError) as e:
            problems.append(f"could not write {what}: {e}")

    def put_cover() -> None:
        nonlocal image
        with open(cover, "rb") as fh:
            image = fh.read()
        png = image[:8] == b"\x89PNG\r\n\x1a\n"
        write_whole(os.path.join(folder, "cover.png" if png or cover.lower().endswith(".png") else "cover.jpg"), image)

    if cover and os.path.isfile(cover):
        attempt("cover", put_cover)
    if opf:
        attempt("metadata.opf", lambda: write_whole(os.path.join(folder, "metadata.opf"), opf.encode()))
    if document:
        attempt("metadata.json", lambda: write_json(folder, json.loads(document)))
    sound = [p for p in parts if os.path.splitext(p)[1].lower() in fixed.AUDIO_EXTS]
    book = {k: v or "" for k, v in json.loads(document).items()} if document else None
    inside = image if how.embed_cover and image[:2] in (b"\xff\xd8", b"\x89P") else None
    if sound and (how.embed and book or inside):
        problems += containers.embed(sound, book if how.embed else None, inside)[1]
    for path in parts if how.embed and book else ():
        if path.lower().endswith(".epub"):
            attempt(os.path.basename(path), lambda: writers.rewrite_epub(path, book))  # noqa: B023
    return problems


def write_whole(path: str, data: bytes) -> None:
    """A file that is there whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as fh:
        fh.write(data)
    os.replace(part, path)


# --- the journal ---

#: Statuses that a later run doesn't try again.
SETTLED = ("copied", "moved", "in destination")
_LINE = "id long, plan string, op array<string>, commit array<array<string>>, folder string, status string, notes array<string>, targets array<string>"


class Journal:
    """A task's file of lines: what it is about to do, and which books are done. Flushed to disk line by line.

    A task holds a lock on its part of the run while it writes, so an attempt that takes another's place waits until that
    one is gone, and then reads what it has left."""

    def __init__(self, folder: str, run: str, partition: int) -> None:
        os.makedirs(folder, exist_ok=True)
        self.folder, name = folder, f"{run}-{partition:05d}"
        self.lock = open(os.path.join(folder, f"{name}.lock"), "w")
        fcntl.flock(self.lock, fcntl.LOCK_EX)
        self.earlier = read_lines(sorted(glob.glob(os.path.join(glob.escape(folder), f"{name}-*.jsonl"))))
        self.file = open(os.path.join(folder, f"{name}-{uuid.uuid4().hex}.jsonl"), "w", encoding="utf-8")

    def write(self, **line) -> None:
        self.file.write(json.dumps(line, ensure_ascii=False) + "\n")
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()
        self.lock.close()

    @property
    def stopped(self) -> bool:
        return os.path.exists(os.path.join(self.folder, "STOP"))


def read_lines(paths: list[str]) -> list[dict]:
    """The lines of journals; one that a crash cut off is no line."""
    out = []
    for path in paths:
        with open(path, encoding="utf-8") as fh:
            for line in fh:
                try:
                    out.append(json.loads(line))
                except ValueError:
                    continue
    return out


def journal_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of a journal folder (``_LINE``, with their file and place in it)."""
    if not glob.glob(os.path.join(glob.escape(folder), "*.jsonl")):
        return spark.createDataFrame([], _LINE + ", seq long, file string")
    raw = spark.read.schema(_LINE).option("mode", "DROPMALFORMED").json(f"file://{folder}/*.jsonl")
    return raw.where("id IS NOT NULL").select("*", F.monotonically_increasing_id().alias("seq"), F.col("_metadata.file_path").alias("file"))


def progress(spark: SparkSession, folder: str) -> dict[str, int]:
    """Books by their status so far: copied, moved, in destination, error."""
    lines = journal_lines(spark, folder).where("status IS NOT NULL")
    kind = F.when(F.col("status").startswith("ERROR"), "error").otherwise(F.col("status"))
    return {r.kind: r.n for r in lines.groupBy(kind.alias("kind")).agg(F.countDistinct("id").alias("n")).collect()}


def stop(folder: str) -> None:
    """Ask a transfer to end after the books it is at; ``resume`` takes that back."""
    os.makedirs(folder, exist_ok=True)
    open(os.path.join(folder, "STOP"), "w").close()


def resume(folder: str) -> None:
    path = os.path.join(folder, "STOP")
    if os.path.exists(path):
        os.remove(path)


def recover(pending: list[list[str]], commit: list[list[str]] | None) -> list[str]:
    """Bring a book that a dead task left into a state of all or nothing."""
    if commit is not None:
        remove_sources([tuple(map(os_path, x)) for x in commit])
        return []
    return undo([tuple(map(os_path, x)) for x in pending])


# --- the data source that writes books ---

#: A book of the plan: what the sink writes.
TRANSFER = """id long, plan string, folder string, files array<struct<src:string,target:string,is_primary:boolean>>, opf string, document string, cover string,
pending array<array<string>>, committed array<array<string>>, settled string, settled_folder string"""


def _partition() -> int:
    return TaskContext.get().partitionId()


@dataclass
class Written(WriterCommitMessage):
    books: int
    left: int


class _BookWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.journal, self.run = options["root"], options["journal"], options["run"]
        self.move, self.conflict = options["move"] == "true", options["conflict"]
        self.how = Finishing(options["embed"] == "true", options["embedcover"] == "true")

    def write(self, iterator) -> Written:
        journal = Journal(self.journal, self.run, _partition())
        # what an attempt before this one has done of these books
        done = {x["id"]: x for x in journal.earlier if "status" in x}
        begun: dict[int, list] = {}
        commits: dict[int, list] = {}
        for line in journal.earlier:
            if "op" in line:
                begun.setdefault(line["id"], []).append(line["op"])
            elif "commit" in line:
                commits[line["id"]] = line["commit"]
        books = left = 0
        try:
            for row in iterator:
                if journal.stopped:
                    left += 1
                elif row.id not in done:
                    pending = begun.get(row.id, row.pending or [])
                    self.one(row, journal, pending, commits.get(row.id, row.committed))
                    books += 1
        finally:
            journal.close()
        return Written(books, left)

    def one(self, row, journal: Journal, pending: list, commit: list | None) -> None:
        folder, parts, notes = row.folder, [], []
        files = [(os_path(f.src), f.target, f.is_primary) for f in row.files]

        def tell(op: list) -> None:
            said = {"commit": [list(map(path_text, x)) for x in op[1]]} if op[0] == "commit" else {"op": list(map(path_text, op))}
            journal.write(id=row.id, plan=row.plan, **said)

        try:
            if pending or commit is not None:
                notes = recover(pending, commit)
                if notes:
                    raise OSError("; ".join(notes))
            if commit is not None:  # all of it is there
                parts = [os_path(t) for how, _, t in pending if how in ("copy", "rename")]
                folder = os.path.dirname(parts[0]) if parts else folder
            else:
                folder, log = transfer_book(files, row.folder, self.root, move=self.move, conflict=self.conflict, log=tell)
                parts = [t for how, t in log if how in ("copy", "rename")]
            status = "moved" if self.move else "copied"
        except BookExists:
            status = "in destination"
        except OSError as e:
            status = path_text(f"ERROR: {e}")
        if status in ("moved", "copied"):
            primary = {f[1] for f in files if f[2]}
            notes = finish(folder, row.opf, row.document, row.cover, [p for p in parts if os.path.basename(p) in primary], self.how)
        targets = [path_text(os.path.join(folder, f[1])) for f in files if f[2]]
        journal.write(id=row.id, plan=row.plan, folder=folder, status=status, notes=notes, targets=targets)

    def commit(self, messages) -> None:
        """Nothing: every book was committed by its line in the journal."""

    def abort(self, messages) -> None:
        """Nothing: books that are done stay done, and the journal tells of the others."""


class BookSink(DataSource):
    """``df.write.format("books")``: carries out transfers, one row (``TRANSFER``) a book."""

    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return TRANSFER

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BookWriter(dict(self.options))


def _there(targets: pd.Series) -> pd.Series:
    return targets.map(lambda paths: all(os.path.exists(os_path(p)) for p in paths) if paths is not None else False)


def _planned(plan: DataFrame, documents: DataFrame | None, journal: str) -> DataFrame:
    """The plan as one row a book, with what earlier runs have left of it in the journal."""
    spark = plan.sparkSession
    files = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "src", "target", "is_primary"))), lambda x: F.struct(x["src"].alias("src"), x["target"].alias("target"), x["is_primary"].alias("is_primary")))
    books = plan.groupBy("id").agg(F.first("folder").alias("folder"), files.alias("files"))
    digest = F.sha1(F.concat_ws("\n", "folder", F.to_json("files")))
    books = books.withColumn("plan", digest)
    nothing = F.lit(None).cast("string")
    books = books.join(documents, "id", "left") if documents is not None else books.withColumns({c: nothing for c in ("opf", "document", "cover")})
    lines = journal_lines(spark, journal)
    there = F.pandas_udf(_there, "boolean")
    # an earlier run's word is taken where it is of the same plan, and the files are where it says
    last = F.struct("seq")
    settled = lines.where(F.col("status").isin(*SETTLED)).groupBy("id", "plan").agg(F.max_by("status", last).alias("settled"), F.max_by("folder", last).alias("settled_folder"), F.max_by("targets", last).alias("targets"))
    settled = settled.where(there("targets")).drop("targets")
    # operations of a file that no status follows were cut off
    ended = lines.where("status IS NOT NULL").select("id", "file").distinct()
    open_ = lines.where("status IS NULL").join(ended, ["id", "file"], "left_anti")
    ops = F.transform(F.array_sort(F.collect_list(F.when(F.col("op").isNotNull(), F.struct("seq", "op")))), lambda x: x["op"])
    begun = open_.groupBy("id").agg(ops.alias("pending"), F.max_by("commit", F.when(F.col("commit").isNotNull(), F.col("seq"))).alias("committed"))
    return books.join(settled, ["id", "plan"], "left").join(begun, "id", "left")


def execute(
    plan: DataFrame, root: str, *, move: bool = False, conflict: str = "skip", source_root: str = "", documents: DataFrame | None = None, in_use: DataFrame | None = None,
    journal: str | None = None, how: Finishing = Finishing(), tasks: int | None = None,  # noqa: B008
) -> Iterator[tuple[int, str, str]]:
    """Carry the plan out on the executors; returns (id, status, folder) of every book that was tried: copied, moved,
    in destination, or ERROR: why.

    ``documents`` (id, opf, document, cover) are what is written beside each book. ``in_use`` (dir) are source folders where
    other books stay: what is in them isn't tidied. ``journal`` is a folder that all executors see; run again with the same one, books
    that are done are left alone, and those that were cut off are undone or completed. Books of one folder are
    transferred in order by one task."""
    spark = plan.sparkSession
    journal = journal or os.path.join(root, ".transfers")
    os.makedirs(journal, exist_ok=True)
    spark.dataSource.register(BookSink)
    books = _planned(plan, documents, journal)
    kept = spark.createDataFrame(books.where("settled IS NOT NULL").select("id", "settled", "settled_folder").toArrow())
    todo = books.where("settled IS NULL").select(*[x.strip().split()[0] for x in TRANSFER.replace("\n", " ").split(", ")])
    todo = todo.repartition(tasks or spark.sparkContext.defaultParallelism, "folder").sortWithinPartitions("folder", "id")
    run = uuid.uuid4().hex
    options = {"root": root, "journal": journal, "run": run, "move": str(move).lower(), "conflict": conflict, "embed": str(how.embed).lower(), "embedCover": str(how.embed_cover).lower()}
    todo.write.format("books").mode("append").options(**options).save()
    lines = journal_lines(spark, journal).where(F.col("file").contains(run) & F.col("status").isNotNull())
    told = lines.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.max_by("folder", "seq").alias("folder")).unionByName(kept.toDF("id", "status", "folder"))
    if move and source_root:
        dirs = plan.select("id", C.dirname("src").alias("dir")).distinct()
        if in_use is not None:
            dirs = dirs.join(in_use.select("dir").distinct(), "dir", "left_anti")
        left = dirs.join(told.where("status = 'moved'"), "id").groupBy("dir").agg(F.max_by("folder", "id").alias("folder"))
        _tidy_all(left, source_root)
    return ((r.id, r.status, r.folder) for r in told.orderBy("id").toLocalIterator())


def _tidy_all(left: DataFrame, source_root: str) -> None:
    """Follow and tidy the folders that moves have left, those below one folder of the source by one task."""

    def run(batches):
        for rows in batches:
            for place, folder in zip(rows.dir, rows.folder, strict=True):
                follow([os_path(place)], folder)
                tidy([os_path(place)], source_root)
            yield pd.DataFrame({"n": [len(rows)]})

    top = F.substring_index(F.substring(F.col("dir"), len(source_root.rstrip("/")) + 2, 1 << 20), "/", 1)
    spread = left.repartition(left.sparkSession.sparkContext.defaultParallelism, top).sortWithinPartitions(F.length("dir").desc(), "dir")
    spread.mapInPandas(run, "n long").agg(F.sum("n")).collect()


def write_json(folder: str, row: dict) -> None:
    """metadata.json beside the book, merged with what is there (if that can be read); written whole or not at all."""
    path, old = os.path.join(folder, "metadata.json"), {}
    if os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as fh:
                found = json.load(fh)
            old = found if isinstance(found, dict) else {}
        except ValueError:
            old = {}
    write_whole(path, json.dumps(json_document(row, old), ensure_ascii=False, indent=2).encode())
