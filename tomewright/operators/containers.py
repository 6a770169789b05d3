"""Tags and pictures written into audio files: the container is put together anew around the same audio bytes.

Each writer returns the new file as pieces: bytes, or (start, end) of the old file. They are copied to a part
beside the file, synced, and put in its place by a rename, so a crash leaves the old file whole."""

from __future__ import annotations

import base64
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Mapping
from typing import BinaryIO

import numpy as np

from tomewright.sources import audio
from tomewright.sources.metadata import image_size

Piece = bytes | tuple[int, int]
#: Room that is left for later edits.
PADDING = 2048


class Unsupported(ValueError):
    """The container can't be written without harm."""


# --- what a book's fields are called ---


def _index(book: Mapping[str, str]) -> str:
    number = book.get("series_index") or ""
    return (number.lstrip("0") or "0") if number else ""


def mp4_fields(book: Mapping[str, str], part: int, parts: int) -> dict[str, tuple[int, bytes]]:
    """Items of a book's part: (type, value) by key."""
    text = lambda s: (1, s.encode())
    out = {"©alb": text(book["title"]), "©ART": text(book["author"]), "aART": text(book["author"]), "trkn": (0, struct.pack(">HHHH", 0, part, parts, 0))}
    if parts == 1:
        out["©nam"] = text(book["title"])
    for field, *keys in (("narrator", "©wrt", "©nrt"), ("series", "©mvn", "----:com.apple.iTunes:SERIES"), ("year", "©day"), ("description", "ldes"), ("asin", "----:com.apple.iTunes:ASIN"), ("isbn", "----:com.apple.iTunes:ISBN")):
        if book.get(field):
            out |= {k: text(book[field]) for k in keys}
    if book.get("description"):
        out["desc"] = text(book["description"][:255])
    if book.get("genres"):
        out["©gen"] = text(book["genres"].split(",")[0].strip())
    if book.get("series") and _index(book):
        out["----:com.apple.iTunes:SERIES-PART"] = text(_index(book))
        if re.fullmatch(r"\d+(\.\d+)?", _index(book)):
            out["©mvi"] = (21, int(float(_index(book))).to_bytes(2, "big"))
    return out


def id3_fields(book: Mapping[str, str], part: int, parts: int) -> dict[str, str | None]:
    """Frames of a book's part by name (user fields as TXXX:name); None takes a frame away."""
    out: dict[str, str | None] = {"TALB": book["title"], "TPE1": book["author"], "TPE2": book["author"], "TRCK": f"{part}/{parts}", "TIT1": None, "TXXX:SERIES": None, "TXXX:SERIES-PART": None}
    if parts == 1:
        out["TIT2"] = book["title"]
    for field, *names in (("narrator", "TCOM"), ("series", "TXXX:SERIES", "MVNM"), ("year", "TDRC"), ("description", "COMM"), ("asin", "TXXX:ASIN"), ("isbn", "TXXX:ISBN")):
        if book.get(field):
            out |= dict.fromkeys(names, book[field])
    if book.get("genres"):
        out["TCON"] = book["genres"].split(",")[0].strip()
    if book.get("series") and _index(book):
        out |= {"TXXX:SERIES-PART": _index(book), "MVIN": _index(book)}
    return out


def comment_fields(book: Mapping[str, str], part: int, parts: int) -> dict[str, str]:
    """Vorbis comments of a book's part."""
    out = {"album": book["title"], "artist": book["author"], "albumartist": book["author"], "tracknumber": f"{part}/{parts}"}
    if parts == 1:
        out["title"] = book["title"]
    for key, field in (("composer", "narrator"), ("series", "series"), ("date", "year"), ("genre", "genres"), ("description", "description"), ("asin", "asin"), ("isbn", "isbn")):
        if book.get(field):
            out[key] = book[field]
    if book.get("series") and _index(book):
        out["series-part"] = _index(book)
    return out


def _mime(image: bytes) -> str:
    return "image/png" if image[:8] == b"\x89PNG\r\n\x1a\n" else "image/jpeg"


# --- MP4 ---


def _box(name: str, content: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(content), name.encode("latin-1")) + content


def _item(key: str, kind: int, value: bytes) -> bytes:
    data = _box("data", struct.pack(">II", kind, 0) + value)
    if not key.startswith("----:"):
        return _box(key, data)
    _, mean, name = key.split(":", 2)
    return _box("----", _box("mean", bytes(4) + mean.encode()) + _box("name", bytes(4) + name.encode()) + data)


def _items(fh: BinaryIO, place: tuple[int, int] | None, fields: Mapping[str, tuple[int, bytes]], image: bytes | None) -> bytes:
    """The list of items: those that stay as they are, then ours."""
    ours = dict(fields) | ({"covr": (14 if _mime(image) == "image/png" else 13, image)} if image else {})
    kept = b""
    for name, at, a, b in audio.boxes(fh, *place) if place else ():
        if audio.item_key(fh, name, a, b) not in ours:
            kept += audio.take(fh, at, b - at)
    return _box("ilst", kept + b"".join(_item(k, *v) for k, v in ours.items()))


def _moov(fh: BinaryIO, a: int, b: int, items: bytes, wide: bool) -> bytearray:
    """The movie box with other items; with ``wide``, its chunk offsets are of 64 bits."""
    handler = _box("hdlr", bytes(8) + b"mdirappl" + bytes(9))
    out, told = b"", False

    def meta(place: tuple[int, int]) -> bytes:
        inner = place[0] + (0 if audio.take(fh, place[0] + 4, 4) == b"hdlr" else 4)
        rest = [(n, audio.take(fh, at, y - at)) for n, at, _, y in audio.boxes(fh, inner, place[1]) if n not in ("ilst", "free")]
        head = b"".join(data for n, data in rest if n == "hdlr") or handler
        return _box("meta", bytes(4) + head + items + b"".join(data for n, data in rest if n != "hdlr") + _box("free", bytes(PADDING)))

    def track(at: int, y: int) -> bytes:
        """A track whose table of chunks is of 64 bits."""
        def walk(x: int, y: int, path: tuple[str, ...]) -> bytes:
            made = b""
            for n, at, p, q in audio.boxes(fh, x, y):
                if path and n == path[0]:
                    made += _box(n, walk(p, q, path[1:]))
                elif not path and n == "stco":
                    table = audio.take(fh, p, q - p)
                    made += _box("co64", table[:8] + np.frombuffer(table, ">u4", offset=8).astype(">u8").tobytes())
                else:
                    made += audio.take(fh, at, q - at)
            return made

        return _box("trak", walk(at, y, ("mdia", "minf", "stbl")))

    for name, at, x, y in audio.boxes(fh, a, b):
        if name == "udta":
            parts = b""
            for n, start, p, q in audio.boxes(fh, x, y):
                told = told or n == "meta"
                parts += meta((p, q)) if n == "meta" else audio.take(fh, start, q - start)
            if not told:
                told, parts = True, parts + _box("meta", bytes(4) + handler + items + _box("free", bytes(PADDING)))
            out += _box("udta", parts)
        elif name == "trak" and wide:
            out += track(x, y)
        else:
            out += audio.take(fh, at, y - at)
    if not told:
        out += _box("udta", _box("meta", bytes(4) + handler + items + _box("free", bytes(PADDING))))
    return bytearray(_box("moov", out))


def _tables(moov: bytes) -> Iterable[tuple[str, int, int]]:
    """(name, start of the numbers, how many) of the tables of chunk offsets in a movie box."""
    fh = audio._Bytes(bytes(moov))
    for name, _, a, b in audio.boxes(fh, 8, len(moov)):
        if name == "trak" and (place := audio.within(fh, a, b, "mdia", "minf", "stbl")):
            for n, _, x, _ in audio.boxes(fh, *place):
                if n in ("stco", "co64"):
                    yield n, x + 8, struct.unpack(">I", audio.take(fh, x + 4, 4))[0]


def _shift(moov: bytearray, behind: int, by: int) -> bool:
    """Move the chunk offsets that lie behind a place; False where one no longer fits 32 bits."""
    for name, at, n in _tables(moov):
        kind = ">u4" if name == "stco" else ">u8"
        table = np.frombuffer(moov, kind, n, at).astype(np.int64)
        table = np.where(table >= behind, table + by, table)
        if name == "stco" and n and table.max() >= 1 << 32:
            return False
        moov[at : at + n * int(kind[-1])] = table.astype(kind).tobytes()
    return True


def mp4_pieces(fh: BinaryIO, fields: Mapping[str, tuple[int, bytes]], image: bytes | None = None) -> list[Piece]:
    size = audio.size_of(fh)
    top = list(audio.boxes(fh, 0, size))
    if not top or top[-1][3] != size:
        raise Unsupported("the file's boxes don't fill it")
    at = next((i for i, x in enumerate(top) if x[0] == "moov"), None)
    if at is None:
        raise Unsupported("no moov box")
    _, start, a, b = top[at]
    items = _items(fh, audio.within(fh, a, b, "udta", "meta", "ilst"), fields, image)
    for wide in (False, True):
        moov = _moov(fh, a, b, items, wide)
        end, padding = b, b""
        by = len(moov) - (b - start)
        # free space behind the box takes the change in, if it can
        free = top[at + 1] if at + 1 < len(top) and top[at + 1][0] in ("free", "skip") else None
        if free and (left := free[3] - free[1] - by) >= 8:
            end, by, padding = free[3], 0, _box("free", bytes(left - 8))
        if by and any(x[0] == "moof" for x in top):
            raise Unsupported("a fragmented file")
        if _shift(moov, b, by):
            return [(0, start), bytes(moov), padding, (end, size)]
    raise Unsupported("offsets that don't fit")


# --- ID3 ---


def _frame(name: str, content: bytes, version: int) -> bytes:
    size = len(content)
    length = bytes(size >> 7 * i & 0x7F for i in (3, 2, 1, 0)) if version == 4 else size.to_bytes(4, "big")
    return name.encode() + length + b"\0\0" + content


def _text(value: str, version: int) -> tuple[int, bytes, bytes]:
    """(encoding, text, end): UTF-8 where the version has it, else UTF-16."""
    return (3, value.encode(), b"\0") if version == 4 else (1, b"\xff\xfe" + value.encode("utf-16-le"), b"\0\0")


def _ours(name: str, value: str, version: int) -> bytes:
    encoding, text, end = _text(value, version)
    if name.startswith("TXXX:"):
        return _frame("TXXX", bytes([encoding]) + _text(name[5:], version)[1] + end + text, version)
    if name == "COMM":
        return _frame("COMM", bytes([encoding]) + b"eng" + _text("", version)[1] + end + text, version)
    return _frame("TYER" if name == "TDRC" and version == 3 else name, bytes([encoding]) + text, version)


def id3_pieces(fh: BinaryIO, fields: Mapping[str, str | None], image: bytes | None = None) -> list[Piece]:
    """A new tag of the old one's version (2.4 where there was none, or an older one), then the audio."""
    size, found = audio.size_of(fh), audio.plain_tag(fh)
    inner, old, flags, _ = found or (fh, 4, 0, 0)
    start, version = (audio.tag_header(fh)[2] if found else 0), (old if old in (3, 4) else 4)
    replaced = {k.upper() for k in fields} | ({"APIC"} if image else set())
    replaced |= {"TYER", "TDRC"} if "TDRC" in replaced else set()
    kept = b""
    for name, marks, at, n in audio.frames(inner, old, flags, found[3]) if found else ():
        data = audio.take(inner, at, n)
        key = name
        if name == "TXXX":
            plain = audio.frame_content(old, marks, data)
            key = f"TXXX:{audio.strings(plain[0], plain[1:])[0].upper()}"
        if key in replaced:
            continue
        if old == version and not flags & 0x80:
            kept += audio.take(inner, at - 10, 10) + data  # with its flags
        elif len(name) == 4 and name != "APIC":
            kept += _frame(name, audio.frame_content(old, marks, data), version)
        elif name == "APIC":
            kind, picture = audio.picture_frame(old, audio.frame_content(old, marks, data))
            kept += _frame("APIC", b"\0" + _mime(picture).encode() + b"\0" + bytes([kind]) + b"\0" + picture, version)
    tag = kept + b"".join(_ours(k, v, version) for k, v in fields.items() if v is not None)
    if image:
        tag += _frame("APIC", b"\0" + _mime(image).encode() + b"\0\x03Cover\0" + image, version)
    tag += bytes(PADDING)
    if len(tag) >= 1 << 28:
        raise Unsupported("a tag of more than 256 MB")
    head = b"ID3" + bytes([version, 0, 0]) + bytes(len(tag) >> 7 * i & 0x7F for i in (3, 2, 1, 0))
    return [head + tag, (start, size)]


# --- FLAC and Ogg ---


def _comment(data: bytes | None, fields: Mapping[str, str]) -> bytes:
    vendor, old = audio.comments(data) if data else ("tomewright", [])
    every = [(k, v) for k, v in old if k not in fields] + list(fields.items())
    lines = [f"{k.upper()}={v}".encode() for k, v in every]
    return struct.pack("<I", len(vendor.encode())) + vendor.encode() + struct.pack("<I", len(lines)) + b"".join(struct.pack("<I", len(x)) + x for x in lines)


def picture_of(image: bytes) -> bytes:
    """A front cover as a FLAC picture block."""
    mime, (w, h) = _mime(image).encode(), image_size(image)
    return struct.pack(">II", 3, len(mime)) + mime + struct.pack(">IIIIII", 0, w, h, 24, 0, len(image)) + image


def flac_pieces(fh: BinaryIO, fields: Mapping[str, str], image: bytes | None = None) -> list[Piece]:
    size, at = audio.size_of(fh), audio.flac_start(fh)
    made: list[tuple[int, bytes]] = []
    told, end = None, at
    for kind, start, n, _ in audio.blocks(fh, at):
        end = start + n
        if kind == 4:
            told = audio.take(fh, start, n)
        elif kind != 1 and not (kind == 6 and image):
            made.append((kind, audio.take(fh, start, n)))
    made.insert(1, (4, _comment(told, fields)))
    if image:
        made.append((6, picture_of(image)))
    made.append((1, bytes(PADDING)))
    if any(len(data) >= 1 << 24 for _, data in made):
        raise Unsupported("a block of more than 16 MB")
    heads = [bytes([kind | 0x80 * (i == len(made) - 1)]) + len(data).to_bytes(3, "big") + data for i, (kind, data) in enumerate(made)]
    return [(0, at), b"".join(heads), (end, size)]


_MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(data: bytes) -> int:
    """Ogg's checksum: the usual polynomial over mirrored bits, from zero."""
    value = zlib.crc32(data.translate(_MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{value:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, sizes: list[int], content: bytes) -> bytes:
    data = b"OggS\0" + struct.pack("<BqIII", flags, granule, serial, number, 0) + bytes([len(sizes), *sizes]) + content
    return data[:22] + struct.pack("<I", page_checksum(data)) + data[26:]


def ogg_pieces(fh: BinaryIO, fields: Mapping[str, str], image: bytes | None = None) -> Iterable[Piece]:
    """New comment pages; where their number changes, all later pages of the stream are numbered anew."""
    size = audio.size_of(fh)
    first = audio.packets(fh, 1)[0][0]
    headers = 2 if first[:8] == b"OpusHead" else 3 if first[:7] == b"\x01vorbis" else 0
    if not headers:
        raise Unsupported("an unknown stream")
    told, after = audio.packets(fh, headers)
    _, serial, _, sizes, start = audio.page(fh, 0)
    begin = start + sum(sizes)
    mark = b"OpusTags" if headers == 2 else b"\x03vorbis"
    if told[1][: len(mark)] != mark:
        raise Unsupported("no comment")
    fields = dict(fields) | ({"metadata_block_picture": base64.b64encode(picture_of(image)).decode()} if image else {})
    new = [mark + _comment(told[1][len(mark) :], fields) + b"\x01" * (headers == 3), *told[2:headers]]
    # the old header pages must end with the packets; pages of other streams among them aren't moved
    at, old = begin, 0
    while at < after:
        _, s, _, n, x = audio.page(fh, at)
        if s != serial:
            raise Unsupported("streams that are mixed")
        at, old, last = x + sum(n), old + 1, n
    if old and last[-1:] == [255]:
        raise Unsupported("audio on a header's page")
    segments = [n for data in new for n in [*[255] * (len(data) // 255), len(data) % 255]]
    body, made, place = b"".join(new), [], 0
    for i in range(0, len(segments), 255):
        part = segments[i : i + 255]
        continued = i > 0 and segments[i - 1] == 255
        ends = any(n < 255 for n in part)
        made.append(_page(1 if continued else 0, 0 if ends else -1, serial, i // 255 + 1, part, body[place : place + sum(part)]))
        place += sum(part)
    yield (0, begin)
    yield b"".join(made)
    if len(made) == old:
        yield (after, size)
        return
    at = after
    while at < size:
        granule, s, flags, n, x = audio.page(fh, at)
        end = x + sum(n)
        if s == serial:
            number = struct.unpack("<I", audio.take(fh, at + 18, 4))[0] + len(made) - old
            yield _page(flags, granule, s, number, n, audio.take(fh, x, end - x))
        else:
            yield (at, end)
        at = end


# --- files ---


def pieces(fh: BinaryIO, ext: str, book: Mapping[str, str] | None, part: int, parts: int, image: bytes | None) -> Iterable[Piece] | None:
    """The new file of a book's part, by its name's end; None for kinds that have no tags."""
    if ext in (".m4b", ".m4a", ".aac"):
        return mp4_pieces(fh, mp4_fields(book, part, parts) if book else {}, image)
    if ext == ".mp3":
        return id3_pieces(fh, id3_fields(book, part, parts) if book else {}, image)
    if ext == ".flac":
        return flac_pieces(fh, comment_fields(book, part, parts) if book else {}, image)
    if ext in (".ogg", ".opus"):
        return ogg_pieces(fh, comment_fields(book, part, parts) if book else {}, image)
    return None


def replace_file(path: str, fh: BinaryIO, made: Iterable[Piece], at_once: int = 1 << 20) -> None:
    """Write pieces beside a file, then put them in its place."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as out:
            for piece in made:
                if isinstance(piece, bytes):
                    out.write(piece)
                    continue
                fh.seek(piece[0])
                left = piece[1] - piece[0]
                while left > 0 and (data := fh.read(min(left, at_once))):
                    out.write(data)
                    left -= len(data)
                if left > 0:
                    raise EOFError("the file became shorter")
            out.flush()
            os.fsync(out.fileno())
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise


def embed(paths: list[str], book: Mapping[str, str] | None, image: bytes | None = None) -> tuple[int, list[str]]:
    """Write a book's fields, numbered, and its cover into its audio files, in playback order.

    Returns how many were written, and what went wrong with others: a file that can't be written stays as it is."""
    done, problems = 0, []
    for k, path in enumerate(paths, 1):
        try:
            with open(path, "rb") as fh:
                made = pieces(fh, os.path.splitext(path)[1].lower(), book, k, len(paths), image)
                if made is None:
                    continue
                replace_file(path, fh, made)
            done += 1
        except (Unsupported, *audio.BROKEN) as e:
            problems.append(f"could not tag {os.path.basename(path)}: {e}")
    return done, problems
