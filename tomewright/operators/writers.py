"""Metadata written into EPUB packages at the destination (``containers`` does audio files)."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Mapping
from xml.etree import ElementTree

from tomewright.sources.metadata import CONTAINER, DC, OPF


def epub_with(data: bytes, book: Mapping[str, str]) -> bytes:
    """An EPUB with the book's title, author and series in its package; date, publisher, description and
    language only where it has none. The other files stay as they are, the mimetype uncompressed."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = [(i.filename, z.read(i.filename)) for i in z.infolist()]
    files = dict(entries)
    path = ElementTree.fromstring(files["META-INF/container.xml"]).find(f".//{CONTAINER}rootfile").get("full-path")
    ElementTree.register_namespace("dc", DC[1:-1])
    ElementTree.register_namespace("opf", OPF[1:-1])
    package = ElementTree.fromstring(files[path])
    meta = package.find(f"{OPF}metadata")

    def put(tag: str, value: str, always: bool) -> None:
        node = meta.find(f"{DC}{tag}")
        if value and (always or node is None or not (node.text or "").strip()):
            node = ElementTree.SubElement(meta, f"{DC}{tag}") if node is None else node
            node.text = value

    for tag, field, always in (("title", "title", True), ("creator", "author", True), ("date", "year", False), ("publisher", "publisher", False), ("description", "description", False), ("language", "language", False)):
        put(tag, book.get(field) or "", always)
    for node in [m for m in meta.findall(f"{OPF}meta") if (m.get("name") or "").startswith("calibre:series")]:
        meta.remove(node)
    if book.get("series"):
        ElementTree.SubElement(meta, f"{OPF}meta", name="calibre:series", content=book["series"])
        if book.get("series_index"):
            ElementTree.SubElement(meta, f"{OPF}meta", name="calibre:series_index", content=book["series_index"].lstrip("0") or "0")
    files[path] = ElementTree.tostring(package, encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, _ in entries:
            z.writestr(name, files[name], zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def rewrite_epub(path: str, book: Mapping[str, str]) -> None:
    """The same on a file at the destination, whole or not at all."""
    with open(path, "rb") as fh:
        made = epub_with(fh.read(), book)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as fh:
        fh.write(made)
    os.replace(part, path)
