"""Audio containers, read by seeking: MP4 boxes, ID3 frames, MPEG and ADTS frame headers, FLAC blocks, Ogg pages, ASF objects.

``read`` looks only at headers and small fields, so of a file of any size little is read; pictures and
unknown fields are passed over unless they are asked for. What can't be read is None, never an error."""

from __future__ import annotations

import base64
import binascii
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

#: Fields longer than this are not text.
LONGEST = 1 << 20
BROKEN = (struct.error, IndexError, ValueError, KeyError, OSError, EOFError, TypeError, OverflowError, ZeroDivisionError, zlib.error, binascii.Error)


@dataclass
class Sound:
    """What a file says of itself. ``kind`` tells how its tags are named: mp4, id3 or vorbis."""

    kind: str
    codec: str = ""
    length: float = 0.0
    bitrate: int = 0
    chapters: int = 0
    tags: dict[str, list[str]] = field(default_factory=dict)
    picture: bytes = b""

    def add(self, key: str, value: str) -> None:
        if value := value.strip("\0").strip():
            self.tags.setdefault(key, []).append(value)

    def first(self, *keys: str) -> str:
        return next((self.tags[k][0] for k in keys if self.tags.get(k)), "")


def size_of(fh: BinaryIO) -> int:
    return fh.seek(0, 2)


def take(fh: BinaryIO, at: int, n: int) -> bytes:
    """Exactly n bytes; fewer are an error."""
    fh.seek(at)
    data = fh.read(n)
    if len(data) < n:
        raise EOFError("the file is shorter than it says")
    return data


# --- MP4 ---


def boxes(fh: BinaryIO, start: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, start, start of the content, end) of the boxes between two places."""
    while start + 8 <= end:
        size, name = struct.unpack(">I4s", take(fh, start, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", take(fh, start + 8, 8))[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield name.decode("latin-1"), start, start + head, start + size
        start += size


def within(fh: BinaryIO, start: int, end: int, *path: str) -> tuple[int, int] | None:
    """The content of the first box at a path of names."""
    for name in path:
        found = next(((a, b) for n, _, a, b in boxes(fh, start, end) if n == name), None)
        if found is None:
            return None
        start, end = found
        if name == "meta" and take(fh, start + 4, 4) != b"hdlr":
            start += 4  # version and flags
    return start, end


def item_key(fh: BinaryIO, name: str, a: int, b: int) -> str:
    """An item's name; free-form items are named by what they hold."""
    if name != "----":
        return name
    parts = {n: take(fh, x + 4, y - x - 4).decode("utf-8", "replace") for n, _, x, y in boxes(fh, a, b) if n in ("mean", "name")}
    return f"----:{parts.get('mean', '')}:{parts.get('name', '')}"


def _descriptor(data: bytes, at: int) -> tuple[int, int]:
    """(tag, start of the content) of an MPEG-4 descriptor, whose length is of one to four bytes."""
    tag, at = data[at], at + 1
    while data[at] & 0x80:
        at += 1
    return tag, at + 1


def _sample_entry(data: bytes) -> tuple[str, int]:
    """Codec and bitrate of the first sample description."""
    name = data[12:16].decode("latin-1")
    at = data.find(b"esds", 16)
    if at < 0:
        return name, 0
    tag, at = _descriptor(data, at + 8)
    if tag == 3:
        flags = data[at + 2]
        at += 3 + 2 * bool(flags & 0x80) + (1 + data[at + 3] if flags & 0x40 else 0) + 2 * bool(flags & 0x20)
        tag, at = _descriptor(data, at)
    if tag != 4:
        return name, 0
    kind, rate = data[at], struct.unpack_from(">I", data, at + 9)[0]
    name = f"{name}.{kind:x}"
    if kind == 0x40 and data[at + 13 : at + 14] == b"\x05":
        name += f".{data[_descriptor(data, at + 13)[1]] >> 3}"
    return name, rate


def read_mp4(fh: BinaryIO, size: int, pictures: bool) -> Sound:
    out = Sound("mp4")
    moov = within(fh, 0, size, "moov")
    if moov is None:
        raise ValueError("no moov box")
    tracks, chaptered, samples = [], set(), {}
    for name, _, a, b in boxes(fh, *moov):
        if name != "trak":
            continue
        head, handler, media = (within(fh, a, b, *p) for p in (("tkhd",), ("mdia", "hdlr"), ("mdia", "mdhd")))
        number = struct.unpack(">I", take(fh, head[0] + (20 if take(fh, head[0], 1) == b"\x01" else 12), 4))[0]
        if sizes := within(fh, a, b, "mdia", "minf", "stbl", "stsz"):
            samples[number] = struct.unpack(">I", take(fh, sizes[0] + 8, 4))[0]
        if take(fh, handler[0] + 8, 4) == b"soun":
            tracks.append((a, b, media[0]))
            if names := within(fh, a, b, "tref", "chap"):
                chaptered |= set(struct.unpack(f">{(names[1] - names[0]) // 4}I", take(fh, names[0], (names[1] - names[0]) // 4 * 4)))
    if tracks:
        a, b, at = tracks[0]
        scale, units = struct.unpack(">IQ" if take(fh, at, 1) == b"\x01" else ">II", take(fh, at + 20, 12) if take(fh, at, 1) == b"\x01" else take(fh, at + 12, 8))
        out.length = units / scale if scale else 0.0
        if entry := within(fh, a, b, "mdia", "minf", "stbl", "stsd"):
            out.codec, out.bitrate = _sample_entry(take(fh, entry[0], min(entry[1] - entry[0], 4096)))
    if marks := within(fh, *moov, "udta", "chpl"):
        out.chapters = take(fh, marks[0] + 8, 1)[0]
    out.chapters = out.chapters or max((samples.get(n, 0) for n in chaptered), default=0)
    items = within(fh, *moov, "udta", "meta", "ilst")
    for name, _, a, b in boxes(fh, *items) if items else ():
        for inner, _, x, y in boxes(fh, a, b):
            if inner != "data" or y - x < 8:
                continue
            if name == "covr":
                if pictures and not out.picture:
                    out.picture = take(fh, x + 8, y - x - 8)
            elif y - x <= LONGEST:
                kind, value = struct.unpack(">I", take(fh, x, 4))[0] & 0xFFFFFF, take(fh, x + 8, y - x - 8)
                number = kind == 21 or name in ("©mvi", "trkn", "disk") and kind == 0
                out.add(item_key(fh, name, a, b), str(int.from_bytes(value[:4] if name in ("trkn", "disk") else value, "big", signed=kind == 21)) if number else value.decode("utf-16-be" if kind == 2 else "utf-8", "ignore"))
    return out


# --- ID3 and MPEG frames ---

#: Frames of version 2.2 and their later names. Fixed values.
OLD_FRAMES = {"TT1": "TIT1", "TT2": "TIT2", "TAL": "TALB", "TP1": "TPE1", "TP2": "TPE2", "TCM": "TCOM", "TCO": "TCON", "TYE": "TYER", "TPB": "TPUB", "TLA": "TLAN", "TRK": "TRCK", "COM": "COMM", "TXX": "TXXX", "PIC": "APIC"}
_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def sync_safe(data: bytes) -> int:
    return sum((x & 0x7F) << 7 * (len(data) - 1 - i) for i, x in enumerate(data))


def tag_header(fh: BinaryIO) -> tuple[int, int, int] | None:
    """(version, flags, end) of the ID3v2 tag at the start."""
    fh.seek(0)
    head = fh.read(10)
    if len(head) < 10 or head[:3] != b"ID3" or max(head[6:10]) > 0x7F:
        return None
    return head[3], head[5], 10 + sync_safe(head[6:10]) + 10 * bool(head[5] & 0x10)


def frames(fh: BinaryIO, version: int, flags: int, end: int) -> Iterator[tuple[str, bytes, int, int]]:
    """(name, flags, start, size) of a tag's frames. (Whole tags made unsynchronised are read through ``plain_tag``.)"""
    short = version == 2
    at, head = 10, 6 if short else 10
    if flags & 0x40 and not short:
        extended = take(fh, at, 4)
        at += sync_safe(extended) if version == 4 else 4 + int.from_bytes(extended, "big")
    while at + head <= end:
        data = take(fh, at, head)
        name = data[: 3 if short else 4].decode("latin-1")
        if not name.strip("\0") or not name.isalnum():
            return
        size = int.from_bytes(data[3:6], "big") if short else sync_safe(data[4:8]) if version == 4 else int.from_bytes(data[4:8], "big")
        if at + head + size > end:
            return
        yield (OLD_FRAMES.get(name, name) if short else name), data[8:10], at + head, size
        at += head + size


class _Bytes:
    """Bytes that ``take`` can read."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def seek(self, at: int, whence: int = 0) -> int:
        self.at = at + (len(self.data) if whence == 2 else 0)
        return self.at

    def read(self, n: int = -1) -> bytes:
        return self.data[self.at : self.at + n]


def plain_tag(fh: BinaryIO) -> tuple[BinaryIO, int, int, int] | None:
    """(file, version, flags, end) of the tag, in which bytes put in for old decoders are taken out again."""
    found = tag_header(fh)
    if found is None:
        return None
    version, flags, end = found
    if flags & 0x80 and version < 4:
        data = take(fh, 0, min(end, size_of(fh))).replace(b"\xff\x00", b"\xff")
        return _Bytes(data), version, flags, len(data)
    return fh, version, flags, end


def frame_content(version: int, flags: bytes, data: bytes) -> bytes:
    """A frame's content without what its flags put before it."""
    if version == 4 and flags:
        if flags[1] & 0x02:
            data = data.replace(b"\xff\x00", b"\xff")
        if flags[1] & 0x01:
            data = data[4:]
        return zlib.decompress(data) if flags[1] & 0x08 else data
    return zlib.decompress(data[4:]) if version == 3 and flags and flags[1] & 0x80 else data


def strings(encoding: int, data: bytes) -> list[str]:
    """Strings with ends between them."""
    name = _ENCODINGS[encoding] if encoding < 4 else "latin-1"
    if encoding in (1, 2):
        parts, at = [], 0
        for i in range(0, len(data) - 1, 2):
            if data[i : i + 2] == b"\0\0":
                parts.append(data[at:i])
                at = i + 2
        parts.append(data[at : at + (len(data) - at) // 2 * 2])
    else:
        parts = data.split(b"\0")
    return [p.decode(name if encoding != 1 or p[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-16-le", "ignore") for p in parts]


def picture_frame(version: int, data: bytes) -> tuple[int, bytes]:
    """(type, image) of a picture's frame."""
    at = 4 if version == 2 else data.index(b"\0", 1) + 1
    kind, rest = data[at], data[at + 1 :]
    if data[0] in (1, 2):
        end = next(i for i in range(0, len(rest) - 1, 2) if rest[i : i + 2] == b"\0\0") + 2
    else:
        end = rest.index(b"\0") + 1
    return kind, rest[end:]


def _tags_of(fh: BinaryIO, size: int, out: Sound, pictures: bool) -> int:
    """Put an ID3 tag's fields into ``out``; returns where the audio starts."""
    found = plain_tag(fh)
    if found is None:
        if size >= 128 and (old := take(fh, size - 128, 128))[:3] == b"TAG":
            for key, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
                out.add(key, old[a:b].split(b"\0")[0].decode("latin-1"))
        return 0
    inner, version, flags, end = found
    best = None
    for name, marks, at, n in frames(inner, version, flags, end):
        if name == "APIC" and pictures:
            kind, image = picture_frame(version, frame_content(version, marks, take(inner, at, n)))
            if best is None or kind == 3 and best != 3:
                best, out.picture = kind, image
        elif (name[0] == "T" or name in ("COMM", "MVNM", "MVIN")) and 1 < n <= LONGEST:
            data = frame_content(version, marks, take(inner, at, n))
            if name == "TXXX":
                desc, *values = strings(data[0], data[1:])
                name = f"TXXX:{desc.lower()}"
            elif name == "COMM":
                _, *values = strings(data[0], data[4:])
            else:
                values = strings(data[0], data[1:])
            for value in values[:1]:
                out.add(name, value)
    return tag_header(fh)[2]


_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Kilobits by version (1, or 2 and 2.5) and layer, from index 1. Fixed values of the format.
_KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_KBITS[2, 3] = _KBITS[2, 2]


def mpeg_header(head: bytes) -> tuple[int, int, int, int, bool, int] | None:
    """(bitrate, sample rate, samples of a frame, its bytes, mono, version) of an MPEG audio frame's header."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, sampled = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3), head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or sampled == 3:
        return None
    bits = _KBITS[1 if version == 3 else 2, layer][rate - 1] * 1000
    hertz = _RATES[version][sampled]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    padding = head[2] >> 1 & 1
    size = (12 * bits // hertz + padding) * 4 if layer == 1 else samples // 8 * bits // hertz + padding
    return bits, hertz, samples, size, head[3] >> 6 == 3, version


def read_mpeg(fh: BinaryIO, size: int, pictures: bool) -> Sound:
    out = Sound("id3", codec="mp3")
    start = _tags_of(fh, size, out, pictures)
    fh.seek(start)
    data = fh.read(1 << 16)
    at = data.find(b"\xff")
    while at >= 0:
        head = mpeg_header(data[at : at + 4])
        if head and (after := data[at + head[3] : at + head[3] + 4]) is not None and (len(after) < 4 or mpeg_header(after)):
            break
        at = data.find(b"\xff", at + 1)
    if at < 0:
        return out
    bits, hertz, samples, _, mono, version = mpeg_header(data[at : at + 4])
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    x = at + 4 + side
    count = total = 0
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(data[x + 4 : x + 8], "big")
        if flags & 1:
            count = int.from_bytes(data[x + 8 : x + 12], "big")
        if flags & 2:
            total = int.from_bytes(data[x + 8 + 4 * (flags & 1) : x + 12 + 4 * (flags & 1)], "big")
    elif data[at + 36 : at + 40] == b"VBRI":
        total, count = struct.unpack_from(">II", data, at + 46)
    body = size - start - at
    if size >= 128 and take(fh, size - 128, 3) == b"TAG":
        body -= 128
    if count:
        out.length = count * samples / hertz
        out.bitrate = int((total or body) * 8 / out.length)
    else:
        out.length, out.bitrate = body * 8 / bits, bits
    return out


def read_adts(fh: BinaryIO, size: int, pictures: bool) -> Sound:
    """Raw AAC: frames are counted over the start, and the length is what the whole file's bytes last."""
    out = Sound("id3", codec="aac")
    start = _tags_of(fh, size, out, pictures)
    fh.seek(start)
    data, at, n = fh.read(1 << 17), 0, 0
    hertz = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
    rate = 0
    while at + 7 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xF6 == 0xF0:
        rate = hertz[data[at + 2] >> 2 & 15]
        step = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if step < 7:
            break
        at, n = at + step, n + 1
    if n:
        out.bitrate = int(at * 8 * rate / (1024 * n))
        out.length = (size - start) * 8 / out.bitrate
    return out


# --- FLAC and Ogg ---


def comments(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """(vendor, fields) of a Vorbis comment."""
    n = struct.unpack_from("<I", data)[0]
    vendor, at = data[4 : 4 + n].decode("utf-8", "replace"), 8 + n
    out = []
    for _ in range(struct.unpack_from("<I", data, at - 4)[0]):
        n = struct.unpack_from("<I", data, at)[0]
        key, _, value = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        out.append((key.lower(), value))
        at += 4 + n
    return vendor, out


def picture_block(data: bytes) -> tuple[int, bytes]:
    """(type, image) of a FLAC picture block."""
    kind, n = struct.unpack_from(">II", data)
    at = 8 + n
    at += 4 + struct.unpack_from(">I", data, at)[0] + 16
    n = struct.unpack_from(">I", data, at)[0]
    return kind, data[at + 4 : at + 4 + n]


def blocks(fh: BinaryIO, at: int) -> Iterator[tuple[int, int, int, bool]]:
    """(type, start of the content, size, whether the last) of FLAC's metadata blocks."""
    last = False
    while not last:
        head = take(fh, at, 4)
        last, size = bool(head[0] & 0x80), int.from_bytes(head[1:], "big")
        yield head[0] & 0x7F, at + 4, size, last
        at += 4 + size


def _put_comments(out: Sound, data: bytes, pictures: bool) -> None:
    for key, value in comments(data)[1]:
        if key != "metadata_block_picture":
            out.add(key, value)
        elif pictures and not out.picture:
            out.picture = picture_block(base64.b64decode(value))[1]


def flac_start(fh: BinaryIO) -> int:
    """Where the blocks start: an ID3 tag may stand before them."""
    found = tag_header(fh)
    at = found[2] if found else 0
    if take(fh, at, 4) != b"fLaC":
        raise ValueError("no FLAC stream")
    return at + 4


def read_flac(fh: BinaryIO, size: int, pictures: bool) -> Sound:
    out, at = Sound("vorbis", codec="flac"), flac_start(fh)
    for kind, start, n, _ in blocks(fh, at):
        if kind == 0:
            packed = int.from_bytes(take(fh, start + 10, 8), "big")
            out.length = (packed & (1 << 36) - 1) / (packed >> 44)
        elif kind == 4:
            _put_comments(out, take(fh, start, n), pictures)
        elif kind == 6 and pictures and not out.picture:
            out.picture = picture_block(take(fh, start, n))[1]
        at = start + n
    out.bitrate = int((size - at) * 8 / out.length) if out.length else 0
    return out


def page(fh: BinaryIO, at: int) -> tuple[int, int, int, list[int], int]:
    """(granule position, serial, header flags, sizes of the segments, start of the content) of an Ogg page."""
    head = take(fh, at, 27)
    if head[:4] != b"OggS":
        raise ValueError("no Ogg page")
    sizes = list(take(fh, at + 27, head[26]))
    return struct.unpack_from("<q", head, 6)[0], struct.unpack_from("<I", head, 14)[0], head[5], sizes, at + 27 + head[26]


def packets(fh: BinaryIO, most: int) -> tuple[list[bytes], int]:
    """The first packets of the first stream, and where the page after them starts."""
    out, part, at, stream = [], b"", 0, None
    while len(out) < most:
        _, serial, _, sizes, start = page(fh, at)
        data, at = take(fh, start, sum(sizes)), start + sum(sizes)
        stream = serial if stream is None else stream
        place = 0
        for n in sizes if serial == stream else []:
            part += data[place : place + n]
            place += n
            if n < 255:
                out.append(part)
                part = b""
    return out, at


def read_ogg(fh: BinaryIO, size: int, pictures: bool) -> Sound:
    (head, told), _ = packets(fh, 2)[0][:2], None
    serial = page(fh, 0)[1]
    if head[:8] == b"OpusHead":
        out, rate, skip = Sound("vorbis", codec="oggopus"), 48000, struct.unpack_from("<H", head, 10)[0]
        _put_comments(out, told[8:], pictures)
    elif head[:7] == b"\x01vorbis":
        out, rate, skip = Sound("vorbis", codec="oggvorbis"), struct.unpack_from("<I", head, 12)[0], 0
        out.bitrate = max(0, struct.unpack_from("<i", head, 20)[0])
        _put_comments(out, told[7:], pictures)
    elif head[:5] == b"\x7fFLAC":
        out, rate, skip = Sound("vorbis", codec="oggflac"), int.from_bytes(head[27:30], "big") >> 4, 0
        _put_comments(out, told[4:], pictures)
    else:
        raise ValueError("an unknown stream")
    # the last page of the stream says how many samples there are
    reach = 1 << 16
    tail = take(fh, max(0, size - reach), min(size, reach))
    at = tail.rfind(b"OggS")
    while at >= 0:
        if tail[at + 14 : at + 18] == struct.pack("<I", serial) and len(tail) >= at + 14:
            samples = struct.unpack_from("<q", tail, at + 6)[0]
            if samples > 0:
                out.length = max(0, samples - skip) / rate
                break
        at = tail.rfind(b"OggS", 0, at)
    return out


# --- ASF ---


def read_asf(fh: BinaryIO, size: int, pictures: bool) -> Sound:
    """Length and bitrate of a WMA file (its tags have no fields of a book)."""
    out = Sound("", codec="asf")
    at, end = 30, struct.unpack("<Q", take(fh, 16, 8))[0]
    while at + 24 <= end:
        name, n = take(fh, at, 16), struct.unpack("<Q", take(fh, at + 16, 8))[0]
        if name == bytes.fromhex("a1dcab8c47a9cf118ee400c00c205365"):  # file properties
            data = take(fh, at + 24, 80)
            played, preroll, out.bitrate = (*struct.unpack_from("<Q", data, 40), *struct.unpack_from("<Q", data, 56), struct.unpack_from("<I", data, 76)[0])
            out.length = max(0.0, played / 1e7 - preroll / 1e3)
        if n < 24:
            break
        at += n
    return out


def read(fh: BinaryIO, pictures: bool = False) -> Sound | None:
    """What an open audio file says of itself, by its content whatever its name; None where nothing can be read."""
    try:
        size = size_of(fh)
        fh.seek(0)
        head = fh.read(12)
        if head[4:8] == b"ftyp":
            return read_mp4(fh, size, pictures)
        if head[:4] == b"OggS":
            return read_ogg(fh, size, pictures)
        if head[:16].startswith(bytes.fromhex("3026b2758e66cf11")):
            return read_asf(fh, size, pictures)
        tag = tag_header(fh)
        after = tag[2] if tag else 0
        fh.seek(after)
        head = fh.read(4)
        if head == b"fLaC":
            return read_flac(fh, size, pictures)
        if len(head) > 1 and head[0] == 0xFF and head[1] & 0xF6 == 0xF0:
            return read_adts(fh, size, pictures)
        return read_mpeg(fh, size, pictures) if tag or head else None
    except BROKEN:
        return None
