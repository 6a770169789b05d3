"""File trees as DataFrames: a Python data source that lists every file, and books made of the listing.

Spark's own file listing leaves out empty and hidden files, which the catalog must report, so
``tree`` walks by itself, on the executors. Names may be any bytes (see ``path_text``)."""

from __future__ import annotations

import hashlib
import os
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tomewright.functions import columns as C
from tomewright.functions import fixed, names, stems, udfs
from tomewright.operators.schema import FILE


#: Folders that are shared out, at least, where the tree has so many on a level.
SHARES = 64
#: Bytes of names that are no UTF-8 stand as these letters of the private use area, one each.
_ODD = 0xF700


def path_text(path: str) -> str:
    """A path as the system gives it, as text that tables can hold: bytes that are no UTF-8 become letters for private use,
    and so do such letters themselves, so that ``os_path`` gives the same path back."""
    if path.isascii():
        return path
    out = []
    for c in path:
        code = ord(c)
        if 0xDC80 <= code <= 0xDCFF:
            out.append(chr(_ODD + code - 0xDC00))
        elif _ODD + 0x80 <= code <= _ODD + 0xFF:
            out += [chr(_ODD + b) for b in c.encode()]
        else:
            out.append(c)
    return "".join(out)


def os_path(text: str) -> str:
    """The path that a text of ``path_text`` stands for."""
    if text.isascii():
        return text
    raw = b"".join(bytes([ord(c) - _ODD]) if _ODD + 0x80 <= ord(c) <= _ODD + 0xFF else c.encode() for c in text)
    return os.fsdecode(raw)


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        super().__init__(path)
        self.deep = deep


class _TreeReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def partitions(self):
        """Folders to be listed: level by level, until there are enough to share out; those above are listed alone."""
        alone, deep = [], [self.root]
        while deep and len(deep) < SHARES:
            below = []
            for folder in deep:
                alone.append(folder)
                try:
                    with os.scandir(folder) as found:
                        below += sorted(e.path for e in found if e.is_dir(follow_symlinks=False))
                except OSError:
                    continue  # gone, or not for us
            deep = below
        return [*(_Folder(path_text(p), False) for p in alone), *(_Folder(path_text(p), True) for p in deep)]

    def read(self, partition: _Folder):
        for folder, below, files in os.walk(os_path(partition.value)):
            below.sort()
            if not partition.deep:
                below.clear()
            for name in sorted(files):
                path = os.path.join(folder, name)
                try:
                    st = os.stat(path)
                except OSError:
                    continue  # gone meanwhile
                rel, name = path_text(os.path.relpath(path, self.root)), path_text(name)
                dot = name.rfind(".")
                at = datetime.fromtimestamp(st.st_mtime, timezone.utc)
                yield rel, os.path.dirname(rel), name, name[dot:].lower() if dot > 0 else "", st.st_size, at


class TreeSource(DataSource):
    """``spark.read.format("tree").load(root)``: a row for every file below a local folder."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"])


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").load(root)


def _folder_books(rows: pd.DataFrame) -> pd.DataFrame:
    """The audio books of one folder's files (and its absorbed discs')."""
    audio = rows[rows.ext.isin(fixed.AUDIO_EXTS)]
    paths = sorted(audio.rel_path, key=stems.natural_key)
    sidecar = bool(((rows.name.str.lower() == "metadata.json") | (rows.ext == ".opf"))[rows.dir == rows.book_dir].any())
    spans = audio.dir.nunique() > 1
    groups = [(None, paths)] if spans else stems.group_files(paths, sidecar)
    out = []
    for hint, files in groups:
        files = sorted(files, key=stems.disc_order)
        if hint is None and len(files) > 1 and not spans:
            hint = stems.group_hint(files)
        useful = bool(hint) and (len(groups) > 1 or bool(names.parse_name(hint).get("author")))
        extras = sorted(rows[rows.ext.isin(fixed.EXTRA_EXTS)].rel_path, key=stems.natural_key) if len(groups) == 1 else []
        base = rows.base.iloc[0]
        out.append((rows.book_dir.iloc[0], "audio", files, extras, base or (hint if useful else "")))
    return pd.DataFrame(out, columns=["book_dir", "kind", "files", "extras", "hint"])


def book_folders(files: DataFrame) -> DataFrame:
    """Add ``book_dir`` (the folder whose book a file is part of) and ``base`` (the title that sibling disc folders share).

    A folder that is named like a part, holds audio, and stands below the first level is
    absorbed by the folder above; 'Title - Disc 1' and 'Title - Disc 2' make one book."""
    audio = F.col("ext").isin(*fixed.AUDIO_EXTS)
    folders = files.where(audio).groupBy("dir").agg(F.count("*").alias("n")).select("dir")
    leaf, parent = C.basename("dir"), C.dirname("dir")
    parts = folders.withColumns({"_n": udfs.disc_child_number(leaf), "_d": udfs.split_disc_marker(leaf), "_sim": udfs.similar(udfs.split_disc_marker(leaf)["base"], F.lower(C.basename(parent)))})
    with_audio = folders.select(F.col("dir").alias("_p"), F.lit(True).alias("_pa"))
    parts = parts.join(with_audio, parent == F.col("_p"), "left")
    under_author = ~F.contains(parent, F.lit("/")) & ~F.coalesce("_pa", F.lit(False)) & ~leaf.contains(" ")
    absorbed = (parent != "") & (F.col("_n").isNotNull() & ~under_author | F.col("_d.disc").isNotNull() & (F.col("_sim") > 0.8))
    sibling = ~absorbed & F.col("_d.disc").isNotNull() & (F.col("_d.base") != "")
    placed = parts.select("dir", F.when(absorbed, parent).when(sibling, F.concat_ws("/", F.when(parent != "", parent), F.lower("_d.base"))).otherwise(F.col("dir")).alias("book_dir"), F.when(sibling, F.col("_d.base")).otherwise("").alias("base"))
    return files.join(placed, "dir", "left").withColumns({"book_dir": F.coalesce("book_dir", "dir"), "base": F.coalesce("base", F.lit(""))})


def books_of(files: DataFrame, include_audio: bool = True, include_ebooks: bool = True) -> DataFrame:
    """(book_dir, kind, files, extras, hint) of a listing: one row a book; files are in playback order."""
    out = "book_dir string, kind string, files array<string>, extras array<string>, hint string"
    placed = book_folders(files)
    has_audio = F.max(F.col("ext").isin(*fixed.AUDIO_EXTS)).over(Window.partitionBy("book_dir"))
    found = placed.withColumn("_a", has_audio).where("_a").drop("_a").groupBy("book_dir").applyInPandas(_folder_books, out)
    ebooks = files.where(F.col("ext").isin(*fixed.EBOOK_EXTS)).groupBy("dir", F.lower(C.stem("name")).alias("_s"))
    ebooks = ebooks.agg(F.array_sort(F.collect_list("rel_path")).alias("files")).select(F.col("dir").alias("book_dir"), F.lit("ebook").alias("kind"), "files", F.array().cast("array<string>").alias("extras"), F.lit("").alias("hint"))
    if not include_audio:
        return ebooks if include_ebooks else ebooks.where("false")
    return found.unionByName(ebooks) if include_ebooks else found


def file_fingerprint(path: str, chunk: int = 65536) -> str:
    """SHA-1 of a file's size and both its ends, read by seeking; an empty string where it can't be read."""
    try:
        with open(path, "rb") as fh:
            size = os.fstat(fh.fileno()).st_size
            digest = hashlib.sha1(str(size).encode())
            digest.update(fh.read(chunk))
            if size > 2 * chunk:
                fh.seek(-chunk, os.SEEK_END)
                digest.update(fh.read(chunk))
        return digest.hexdigest()
    except OSError:
        return ""


def fingerprints(files: DataFrame, root: str, chunk: int = 65536) -> DataFrame:
    """(rel_path, fp) of files, read on the executors."""

    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"rel_path": rows.rel_path, "fp": [file_fingerprint(os.path.join(root, os_path(p)), chunk) for p in rows.rel_path]})

    return files.select("rel_path").mapInPandas(run, "rel_path string, fp string")


def content_fingerprint(content, length, chunk: int | None = 65536):
    """The same as a Column, over the ``binaryFile`` source's columns; without ``chunk``, of the whole content."""
    if chunk is None:
        return F.sha1(F.concat(length.cast("string").cast("binary"), content))
    tail = F.when(length > 2 * chunk, F.substring(content, length.cast("int") - (chunk - 1), chunk)).otherwise(F.lit(b""))
    return F.sha1(F.concat(length.cast("string").cast("binary"), F.substring(content, 1, chunk), tail))


def fingerprints_of_parts(parts: DataFrame, fps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts, fingerprint) of the books that ``keys`` name, from a row a part: SHA-1 over the parts' sorted fingerprints,
    20 digits; an empty string where no part has one.

    Fingerprints are sorted by Spark and digested as they come, so no task holds those of a whole book."""
    book = F.sha1(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    met = parts.join(fps.where("fp <> ''").select("rel_path", "fp"), "rel_path", "left").select(book.alias("_book"), *keys, "fp")
    told = met.groupBy("_book", *keys).agg(F.count("*").alias("parts"))
    rows = met.where("fp IS NOT NULL").select("_book", "fp").repartition("_book").sortWithinPartitions("_book", "fp")

    def run(batches):
        open_book, digest = None, None
        for batch in batches:
            names, values = batch.column(0), batch.column(1)
            ends = pc.run_end_encode(names)
            start = 0
            for name, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                joined = "|".join(values.slice(start, end - start).to_pylist()).encode()
                start = end
                if name == open_book:
                    digest.update(b"|" + joined)
                    continue
                if digest:
                    yield pa.RecordBatch.from_pydict({"_book": [open_book], "fingerprint": [digest.hexdigest()[:20]]})
                open_book, digest = name, hashlib.sha1(joined)
        if digest:
            yield pa.RecordBatch.from_pydict({"_book": [open_book], "fingerprint": [digest.hexdigest()[:20]]})

    made = rows.mapInArrow(run, "_book string, fingerprint string")
    return told.join(made, "_book", "left").select(*keys, "parts", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def book_fingerprints(books: DataFrame, fps: DataFrame) -> DataFrame:
    """(book columns, fingerprint): SHA-1 over the parts' sorted fingerprints, 20 digits. A part's row names its book by a digest of
    the list, never by the list itself."""
    listed = F.sha1(F.to_json(F.struct("book_dir", "kind", "files"), {"ignoreNullFields": "false"}))
    named = books.withColumn("_list", listed)
    parts = named.select("_list", F.explode("files").alias("rel_path"))
    return named.join(fingerprints_of_parts(parts, fps, ["_list"]).drop("parts"), "_list").drop("_list")
