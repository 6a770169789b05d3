"""What a book's own files, and those beside it, say: one pass of the executors that opens each file once.

The pass gives a row a book: its parts' lengths, the fields in its files and sidecars, the sources that vote on its
title, its front matter, and its pictures, which are kept once by their content."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.functions import names
from tomewright.operators import enrich
from tomewright.operators.sink import write_whole
from tomewright.sources import audio, metadata, tree

IMAGES = (".jpg", ".jpeg", ".png", ".webp")
#: Bytes of a picture, pictures of a folder, and bytes of a described book that are read at most.
PICTURE, PICTURES, TOLD = 15_000_000, 6, 5000
_EXTRAS = "struct<" + ", ".join(f"{k}: string" for k in metadata.EXTRAS.names) + ">"
READ = f"""id long, parts array<struct<ordinal: int, name: string, size: long, length: double, bitrate: int, codec: string, chapters: int>>,
side {_EXTRAS}, local {_EXTRAS}, votes array<struct<title: string, author: string>>, front string, isbn_from_text boolean, empty string,
covers array<struct<ordinal: int, path: string, origin: string, w: int, h: int, bytes: long>>"""
_ISBN = re.compile(r"(?<![\dX])(97[89][\- ]?(?:\d[\- ]?){9}\d|\d{9}[\dXx])(?![\dX])")


def keep_picture(data: bytes, folder: str) -> str:
    """A picture's place in a folder shared by all books: it is named by its content, so equal ones are kept once. It
    appears whole, by a rename, so any number of tasks may keep it at a time."""
    end = ".png" if data[:8] == b"\x89PNG\r\n\x1a\n" else ".webp" if data[8:12] == b"WEBP" else ".jpg"
    path = os.path.join(folder, hashlib.sha1(data).hexdigest()[:16] + end)
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        write_whole(path, data)
    return path


def _bytes(path: str, most: int = -1) -> bytes:
    try:
        with open(path, "rb") as fh:
            return fh.read(most)
    except OSError:
        return b""


def _try(run, data, empty):
    try:
        return run(data) if data else empty
    except (*metadata._BROKEN, *audio.BROKEN):
        return empty


def side_extras(folder: str, listing: list[str]) -> dict[str, str]:
    """The fill-only fields of metadata.json, then the package, then desc.txt and reader.txt; the first that has one."""
    by_name = {x.lower(): os.path.join(folder, x) for x in listing}
    package = by_name.get("metadata.opf") or next((by_name[x] for x in sorted(by_name) if x.endswith(".opf")), "")
    out = _try(metadata.json_extras, _bytes(by_name.get("metadata.json", "")), {}) if "metadata.json" in by_name else {}
    told = _try(lambda b: metadata.opf_extras(ElementTree.fromstring(b)), _bytes(package), {}) if package else {}
    out = {k: told[k] for k in ("narrator", "isbn", "asin", "description") if k in told} | out
    for name, field in (("desc.txt", "description"), ("description.txt", "description"), ("reader.txt", "narrator")):
        if name in by_name and not out.get(field):
            text = _bytes(by_name[name], TOLD).decode("utf-8", "ignore").strip()
            out[field] = text if field == "description" else text.split("\n")[0].strip()
    return {k: v for k, v in out.items() if v}


def side_meta(folder: str, listing: list[str]) -> dict[str, str]:
    """Title and author of the sidecar that speaks first."""
    found = sorted((x for x in listing if x.lower().endswith(".opf")), key=lambda x: (x.lower() != "metadata.opf", x.lower()))
    for name in found:
        if told := _try(lambda b: metadata.opf_meta(ElementTree.fromstring(b)), _bytes(os.path.join(folder, name)), {}):
            return told
    return _try(metadata.json_meta, _bytes(os.path.join(folder, "metadata.json")), {}) if "metadata.json" in listing else {}


def _pictures(kind: str, first: str, extras: list[str], listing: list[str]) -> list[str]:
    """The pictures beside a book: an audio book's extras; of an ebook's folder those named for it, or as a cover."""
    folder = os.path.dirname(first)
    stem = lambda p: os.path.splitext(os.path.basename(p))[0].lower()
    beside = extras if kind == "audio" else [os.path.join(folder, x) for x in listing if "cover" in x.lower() or stem(x) == stem(first)]
    found = [p for p in beside if os.path.splitext(p)[1].lower() in IMAGES]
    return sorted(found, key=lambda p: (not re.search("cover|folder|front", os.path.basename(p), re.IGNORECASE), p))[:PICTURES]


def read_book(book, root: str, covers: str | None) -> dict:
    """All of it, of one book (id, kind, src_display, files, extras)."""
    paths = [os.path.join(root, tree.os_path(f)) for f in book.files]
    extras = [os.path.join(root, tree.os_path(f)) for f in (book.extras if book.extras is not None else [])]
    first = paths[0]
    folder = os.path.dirname(first)
    try:
        listing = os.listdir(folder)
    except OSError:
        listing = []
    out: dict = {"id": book.id, "parts": [], "local": {}, "front": "", "isbn_from_text": False, "empty": "", "covers": []}
    inside: list[bytes] = []
    own: dict[str, str] = {}
    empty = []
    for i, path in enumerate(paths):
        name, ext = tree.path_text(os.path.basename(path)), os.path.splitext(path)[1].lower()
        try:
            with open(path, "rb") as fh:
                size = os.fstat(fh.fileno()).st_size
                sound = audio.read(fh, i == 0 and covers is not None) if book.kind == "audio" and size else None
        except OSError:
            size, sound = -1, None
        empty += [f"{name} is empty (0 bytes)"] * (size == 0)
        if book.kind == "audio":
            out["parts"].append({"ordinal": i, "name": name, "size": size, "length": sound.length if sound else 0.0, "bitrate": sound.bitrate if sound else 0, "codec": sound.codec if sound else "", "chapters": sound.chapters if sound else 0})
            if i == 0 and sound:
                own, out["local"] = metadata.sound_meta(sound, len(paths) > 1), metadata.sound_extras(sound)
                inside += [sound.picture] if sound.picture else []
        elif ext == ".epub" and not own and size > 0:
            data = _bytes(path)
            own, out["local"] = (_try(run, data, {}) for run in (metadata.epub_meta, metadata.epub_extras))
            out["front"] = out["front"] or _try(metadata.epub_front, data, "")
            inside += [x for x in [_try(metadata.epub_cover, data, b"")] if x] if covers is not None else []
        elif ext == ".pdf" and not out["front"] and size > 0:
            out["front"] = _try(metadata.pdf_front, _bytes(path), "")
    if book.kind != "audio":
        out["empty"] = "; ".join(empty)
        isbn = next(filter(None, (metadata.valid_isbn(m[0]) for m in _ISBN.finditer(out["front"]))), "")
        if isbn and not out["local"].get("isbn"):
            out["local"] = {**out["local"], "isbn": isbn}
            out["isbn_from_text"] = True
    out["side"] = side_extras(folder, listing)
    # what is said of title and author by sources that don't know of each other
    leaf = tree.path_text(os.path.basename(folder))
    said = [side_meta(folder, listing), own, names.infer_from_path(book.src_display if book.kind == "audio" else os.path.dirname(book.src_display))]
    said += [names.parse_name(names.strip_catalog_id(leaf))] if not names.is_junk_folder(leaf) else []
    said += [names.parse_name(os.path.splitext(tree.path_text(os.path.basename(first)))[0])] if len(paths) == 1 else []
    out["votes"] = [{"title": m.get("title", ""), "author": m.get("author", "")} for m in said if m]
    if covers is not None:
        pictures = [(_bytes(p, PICTURE), f"folder: {tree.path_text(os.path.basename(p))}") for p in _pictures(book.kind, first, extras, listing)]
        for n, (data, origin) in enumerate([*pictures, *((x, "embedded") for x in inside)]):
            size = _try(metadata.image_size, data, (0, 0))
            if len(data) >= enrich.SMALLEST and size[0]:
                out["covers"].append({"ordinal": n, "path": keep_picture(data, covers), "origin": origin, "w": size[0], "h": size[1], "bytes": len(data)})
    return out


def read_books(books: DataFrame, root: str, covers: str | None = None) -> DataFrame:
    """``READ`` rows of books whose files are paths below ``root`` (or whole paths). ``covers`` is the shared folder of
    pictures; without one none are taken."""
    fields = [f.name for f in books.sparkSession.createDataFrame([], READ).schema]
    keys = metadata.EXTRAS.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [read_book(b, root, covers) for b in rows.itertuples()]
            for x in found:
                x |= {s: {k: x[s].get(k) or "" for k in keys} for s in ("side", "local")}
            yield pd.DataFrame({f: [x[f] for x in found] for f in fields})

    wanted = books.where(F.size("files") > 0).select("id", "kind", F.coalesce("src_display", F.lit("")).alias("src_display"), "files", "extras")
    return wanted.mapInPandas(run, READ)
