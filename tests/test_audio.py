"""Audio containers made byte by byte: read by seeking, written without touching the audio."""

from __future__ import annotations

import base64
import io
import os
import struct

import pytest

from tomewright.operators import containers
from tomewright.sources import audio, metadata

JPEG = b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", 600, 500) + b"\x03" + bytes(2000) + b"\xff\xd9"
PNG = b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 640, 480) + bytes(1900)
BOOK = {"title": "Der Prozeß", "author": "Franz Kafka", "series": "Saga", "series_index": "02", "narrator": "Rob Inn", "year": "1925", "genres": "Novel, Law", "description": "K. " * 200, "asin": "B012345678", "isbn": "9780306406157"}


def box(name, *parts):
    data = b"".join(parts)
    return struct.pack(">I4s", 8 + len(data), name.encode("latin-1")) + data


def item(name, value, kind=1):
    return box(name, box("data", struct.pack(">II", kind, 0), value))


def freeform(name, value):
    return box("----", box("mean", bytes(4), b"com.apple.iTunes"), box("name", bytes(4), name.encode()), box("data", struct.pack(">II", 1, 0), value))


def esds(rate):
    config = b"\x05\x02\x12\x10"
    decoder = bytes([0x40, 0x15]) + bytes(3) + struct.pack(">II", rate, rate) + config
    es = struct.pack(">HB", 1, 0) + b"\x04\x80\x80\x80" + bytes([len(decoder)]) + decoder
    return box("esds", bytes(4), b"\x03\x80\x80\x80" + bytes([len(es)]) + es)


CHUNKS = [b"chunk-%03d-" % i + bytes([i]) * (50 + i) for i in range(40)]


def mp4(items=b"", *, moov_first=True, free=0, udta=True, wide=False, big_mdat=False, chapters=3, extra=b"", stsz=0):
    """An MP4 of 40 chunks; the table of offsets is right for where they are."""

    def moov(base):
        offsets, at = [], base
        for c in CHUNKS:
            offsets.append(at)
            at += len(c)
        table = box("co64", bytes(4), struct.pack(f">I{len(offsets)}Q", len(offsets), *offsets)) if wide else box("stco", bytes(4), struct.pack(f">I{len(offsets)}I", len(offsets), *offsets))
        entry = box("mp4a", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 2, 16, 0, 0, 44100 << 16), esds(64000))
        stbl = box("stbl", box("stsd", bytes(4), struct.pack(">I", 1), entry), box("stsz", bytes(4), struct.pack(">II", 0, stsz), bytes(4 * stsz)), table)
        mdia = box("mdia", box("mdhd", bytes(12), struct.pack(">II", 44100, 44100 * 3725), bytes(4)), box("hdlr", bytes(8), b"soun", bytes(13)), box("minf", box("smhd", bytes(8)), stbl))
        trak = box("trak", box("tkhd", bytes(12), struct.pack(">I", 1), bytes(68)), mdia)
        told = box("udta", box("chpl", b"\x01", bytes(7), bytes([chapters]), bytes(9 * chapters)), box("meta", bytes(4), box("hdlr", bytes(8), b"mdirappl", bytes(9)), box("ilst", items)))
        return box("moov", box("mvhd", bytes(100)), trak, told if udta else b"", extra)

    head, payload = box("ftyp", b"M4B ", bytes(4), b"M4B mp42"), b"".join(CHUNKS)
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload if big_mdat else box("mdat", payload)
    skip = 16 if big_mdat else 8
    if not moov_first:
        return head + mdat + moov(len(head) + skip)
    gap = box("free", bytes(free)) if free else b""
    size = len(moov(0))
    return head + moov(len(head) + size + len(gap) + skip) + gap + mdat


def chunks_of(data):
    """The chunks that the offsets of a file point to."""
    fh = io.BytesIO(data)
    place = audio.within(fh, 0, len(data), "moov", "trak", "mdia", "minf", "stbl")
    for name, _, a, b in audio.boxes(fh, *place):
        if name in ("stco", "co64"):
            n = struct.unpack(">I", data[a + 4 : a + 8])[0]
            offsets = struct.unpack(f">{n}{'I' if name == 'stco' else 'Q'}", data[a + 8 : b])
            return [data[o : o + len(c)] for o, c in zip(offsets, CHUNKS)]


def id3(version, frames, flags=0, padding=50):
    body = b"".join(frames) + bytes(padding)
    if flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff\x00\x00")
    return b"ID3" + bytes([version, 0, flags]) + bytes(len(body) >> 7 * i & 0x7F for i in (3, 2, 1, 0)) + body


def frame(version, name, data):
    n = len(data)
    if version == 2:
        return name.encode() + n.to_bytes(3, "big") + data
    size = bytes(n >> 7 * i & 0x7F for i in (3, 2, 1, 0)) if version == 4 else n.to_bytes(4, "big")
    return name.encode() + size + b"\0\0" + data


def mpeg(n=100, xing=None):
    """Frames of 128 kbit/s at 44.1 kHz, stereo: 417 bytes each."""
    one = b"\xff\xfb\x90\x00"
    frames = [one + bytes([i % 200 + 1]) * 413 for i in range(n)]
    if xing:
        frames.insert(0, (one + bytes(32) + b"Info" + struct.pack(">III", 3, xing, 417 * n)).ljust(417, b"\0"))
    return b"".join(frames)


def comment(**fields):
    lines = [f"{k}={v}".encode() for k, v in fields.items()]
    return struct.pack("<I", 3) + b"ven" + struct.pack("<I", len(lines)) + b"".join(struct.pack("<I", len(x)) + x for x in lines)


def flac(fields, image=b"", padding=100, prefix=b""):
    info = bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 44100 * 61).to_bytes(8, "big") + bytes(16)
    blocks = [(0, info), (3, bytes(18)), (4, comment(**fields))]
    if image:
        blocks.append((6, containers.picture_of(image)))
    blocks.append((1, bytes(padding)))
    return prefix + b"fLaC" + b"".join(bytes([k | 0x80 * (i == len(blocks) - 1)]) + len(d).to_bytes(3, "big") + d for i, (k, d) in enumerate(blocks)) + b"\xff\xf8audio" * 300


def slow_checksum(data):
    value = 0
    for x in data:
        value ^= x << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
    return value


def ogg(headers, pages=30, serial=77, rate=48000):
    first, *rest = headers
    segs = lambda data: [*[255] * (len(data) // 255), len(data) % 255]
    out = containers._page(2, 0, serial, 0, segs(first), first)
    sizes = [n for d in rest for n in segs(d)]
    body, number, at = b"".join(rest), 1, 0
    for i in range(0, len(sizes), 255):
        part = sizes[i : i + 255]
        out += containers._page(1 if i and sizes[i - 1] == 255 else 0, 0, serial, number, part, body[at : at + sum(part)])
        at, number = at + sum(part), number + 1
    for i in range(pages):
        out += containers._page(4 if i == pages - 1 else 0, rate * (i + 1), serial, number + i, [200, 100], bytes([i + 1]) * 300)
    return out


def opus(fields, **k):
    return ogg([b"OpusHead\x01\x02" + struct.pack("<HIhB", 312, 44100, 0, 0), b"OpusTags" + comment(**fields)], **k)


def vorbis(fields, **k):
    head = b"\x01vorbis" + struct.pack("<IBIiii", 0, 2, 44100, 0, 96000, 0) + b"\xb8\x01"
    return ogg([head, b"\x03vorbis" + comment(**fields) + b"\x01", b"\x05vorbis" + bytes(range(256)) * 3], rate=44100, **k)


def ogg_audio(data):
    """(granule, content) of the pages after the headers, whose numbers and checksums are right."""
    fh, at, out, n = io.BytesIO(data), 0, [], 0
    while at < len(data):
        granule, _, _, sizes, start = audio.page(fh, at)
        end = start + sum(sizes)
        raw = bytearray(data[at:end])
        told = struct.unpack_from("<I", raw, 22)[0]
        raw[22:26] = bytes(4)
        assert told == slow_checksum(bytes(raw)) and struct.unpack_from("<I", raw, 18)[0] == n
        if granule > 0:
            out.append((granule, data[start:end]))
        at, n = end, n + 1
    return out


def read(data, pictures=False):
    return audio.read(io.BytesIO(data), pictures)


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_mp4_fields_and_little_is_read():
    items = item("©alb", "Álbum".encode()) + item("aART", b"A. Thor") + item("©mvi", (7).to_bytes(2, "big"), 21) + freeform("SERIES", b"S") + freeform("ASIN", b"b012345678") + item("©day", b"2011-05-01") + item("©nrt", b"N") + item("covr", JPEG * 200, 13)
    data = mp4(items, stsz=500_000)
    fh = Counting(data)
    s = audio.read(fh)
    assert (s.kind, s.codec, s.length, s.bitrate, s.chapters) == ("mp4", "mp4a.40.2", 3725.0, 64000, 3)
    assert fh.taken < 20_000 and len(data) > 2_000_000
    assert metadata.audio_meta(data) == {"title": "Álbum", "author": "A. Thor", "series": "S", "series_index": "7"}
    assert metadata.audio_extras(data) == {"narrator": "N", "year": "2011", "asin": "B012345678"}
    assert read(data, True).picture == JPEG * 200
    # chapters as a track of text
    text = box("trak", box("tkhd", bytes(12), struct.pack(">I", 9), bytes(68)), box("mdia", box("mdhd", bytes(24)), box("hdlr", bytes(8), b"text", bytes(13)), box("minf", box("stbl", box("stsz", bytes(4), struct.pack(">II", 0, 12))))))
    plain = mp4(items, chapters=0, extra=text)
    at = plain.index(b"mdia", plain.index(b"tkhd")) - 4
    tref = box("tref", box("chap", struct.pack(">I", 9)))
    trak = plain.index(b"trak") - 4
    grown = bytearray(plain[:at] + tref + plain[at:])
    for place in (trak, plain.index(b"moov") - 4):
        grown[place : place + 4] = struct.pack(">I", struct.unpack(">I", plain[place : place + 4])[0] + len(tref))
    assert read(bytes(grown)).chapters == 12 and read(plain).chapters == 0


@pytest.mark.parametrize("version", [2, 3, 4])
def test_id3_fields(version):
    f = lambda name, data: frame(version, name if version > 2 else {v: k for k, v in audio.OLD_FRAMES.items()}[name], data)
    wide = b"\x01\xff\xfe" + "Größe".encode("utf-16-le") + b"\0\0"
    picture = (b"\0JPG\x03\0" if version == 2 else b"\0image/jpeg\0\x03c\0") + JPEG
    frames = [f("TALB", wide), f("TPE1", b"\0Second"), f("TPE2", b"\x03First\0Other" if version == 4 else b"\0First"), f("TXXX", b"\0Series\0Saga"), f("TXXX", b"\0series-part\x003.5"), f("TXXX", b"\0ASIN\0B012345678"), f("APIC", picture), f("COMM", b"\0eng\0About"), f("TCOM", b"\0Reader"), f("TCON", b"\0Novel"), f("TYER", b"\x002001")]
    data = id3(version, frames) + mpeg(1000)
    assert metadata.audio_meta(data) == {"title": "Größe", "author": "First", "series": "Saga", "series_index": "3.5"}
    assert metadata.audio_extras(data) == {"narrator": "Reader", "year": "2001", "description": "About", "genres": "Novel", "asin": "B012345678"}
    s = read(data, True)
    assert s.picture == JPEG and s.bitrate == 128000 and abs(s.length - 417_000 * 8 / 128000) < 1e-9 and s.codec == "mp3"
    if version < 4:
        odd = id3(version, [f("TALB", b"\0" + b"a\xff\x00b")], 0x80) + mpeg(10)
        assert metadata.audio_meta(odd)["title"].startswith("aÿ")


def test_mpeg_headers_and_old_tags():
    s = read(id3(3, []) + mpeg(10, xing=5000))
    assert abs(s.length - 5000 * 1152 / 44100) < 1e-6 and s.bitrate == int(4170 * 8 / s.length)
    last = b"TAG" + b"Name".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + b"Album".ljust(30, b"\0") + b"1999" + bytes(31)
    data = mpeg(100) + last
    assert metadata.audio_meta(data) == {"title": "Album", "author": "Who"} and abs(read(data).length - 41_700 * 8 / 128000) < 1e-9
    adts = b"".join(bytes([0xFF, 0xF1, 0x50, 0x80, 200 >> 3, (200 & 7) << 5 | 0x1F, 0xFC]) + bytes(193) for _ in range(430))
    assert read(adts).codec == "aac" and abs(read(adts).length - 430 * 1024 / 44100) < 0.05
    asf = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c") + struct.pack("<QIH", 30 + 104, 1, 0x201) + bytes.fromhex("a1dcab8c47a9cf118ee400c00c205365") + struct.pack("<Q", 104) + bytes(40) + struct.pack("<QQQIIII", 650_000_000, 0, 5000, 0, 0, 0, 64000)
    assert (read(asf).length, read(asf).bitrate) == (60.0, 64000)


def test_flac_and_ogg_fields():
    fields = {"ALBUM": "T", "artist": "A", "SERIES": "S", "series-part": "4", "Narrator": "N", "date": "2020"}
    data = flac(fields, PNG, prefix=id3(3, []))
    assert metadata.audio_meta(data) == {"title": "T", "author": "A", "series": "S", "series_index": "4"}
    assert metadata.audio_extras(data) == {"narrator": "N", "year": "2020"}
    assert abs(read(data).length - 61) < 1e-9 and read(data, True).picture == PNG
    s = read(opus({**fields, "metadata_block_picture": base64.b64encode(containers.picture_of(PNG)).decode()}), True)
    assert s.picture == PNG and abs(s.length - (30 * 48000 - 312) / 48000) < 1e-9 and s.first("album") == "T" and s.codec == "oggopus"
    s = read(vorbis(fields))
    assert s.length == 30.0 and s.bitrate == 96000 and s.first("series") == "S"
    assert not any("metadata_block_picture" in k for k in s.tags)


def test_broken_files_are_no_errors():
    for whole in (mp4(item("©alb", b"T")), id3(4, [frame(4, "TALB", b"\0T")]) + mpeg(5), flac({"album": "T"}), opus({"album": "T"}), vorbis({"album": "T"})):
        for n in range(0, min(len(whole), 900), 7):
            read(whole[:n], True)
        for i in range(0, min(len(whole), 900), 11):
            read(whole[:i] + b"\xff" * 5 + whole[i + 5 :], True)
    assert read(b"") is None and metadata.audio_meta(b"") == {}


MP4S = {
    "moov first": dict(), "moov last": dict(moov_first=False), "room behind": dict(free=9000), "little room": dict(free=10), "64 bit offsets": dict(wide=True), "64 bit mdat": dict(big_mdat=True), "no tags": dict(udta=False),
}


@pytest.mark.parametrize("name", MP4S)
def test_mp4_round_trip(tmp_path, name):
    old = item("©alb", b"Old") + item("©too", b"Encoder") + freeform("SERIES", b"Old") + freeform("OTHER", b"kept") + item("covr", PNG, 14)
    path = tmp_path / "a.m4b"
    path.write_bytes(mp4(old, **MP4S[name]))
    for _ in range(2):  # the second time over what the first has written
        assert containers.embed([str(path)], BOOK, JPEG) == (1, [])
        data = path.read_bytes()
        assert chunks_of(data) == CHUNKS and b"".join(CHUNKS) in data
        assert metadata.audio_meta(data) == {"title": "Der Prozeß", "author": "Franz Kafka", "series": "Saga", "series_index": "2"}
        assert metadata.audio_extras(data) == {k: BOOK[k] for k in ("narrator", "year", "asin", "isbn")} | {"genres": "Novel", "description": BOOK["description"].strip()}
        s = read(data, True)
        assert s.picture == JPEG and s.length == 3725.0 and s.chapters == (3 if name != "no tags" else 0)
        if name != "no tags":
            assert s.first("©too") == "Encoder" and s.first("----:com.apple.iTunes:OTHER") == "kept"
    assert os.listdir(tmp_path) == ["a.m4b"]


def test_mp4_offsets_that_outgrow_32_bits():
    """A table near 4 GB gets 64 bits; the chunks themselves aren't in this file."""
    data = bytearray(mp4())
    at = data.index(b"stco") + 12
    far = (1 << 32) - 100
    data[at : at + 4] = struct.pack(">I", far)
    made = containers.mp4_pieces(io.BytesIO(bytes(data)), containers.mp4_fields(BOOK, 1, 1), JPEG)
    new = b"".join(p if isinstance(p, bytes) else bytes(data[p[0] : p[1]]) for p in made)
    grown = len(new) - len(data)
    at = new.index(b"co64") + 12
    assert b"stco" not in new and struct.unpack(">Q", new[at : at + 8])[0] == far + grown
    assert new[struct.unpack(">Q", new[at + 8 : at + 16])[0] :].startswith(CHUNKS[1])


@pytest.mark.parametrize("version", [0, 2, 3, 4])
def test_mp3_round_trip(tmp_path, version):
    sound = mpeg(50)
    old = b""
    if version:
        f = lambda name, data: frame(version, name if version > 2 else {v: k for k, v in audio.OLD_FRAMES.items()}[name], data)
        picture = (b"\0PNG\x03\0" if version == 2 else b"\0image/png\0\x03c\0") + PNG
        old = id3(version, [f("TALB", b"\0Old"), f("TIT1", b"\0chapter"), f("TXXX", b"\0series\0Old"), f("TXXX", b"\0mood\0calm"), f("TPUB", b"\0House"), f("APIC", picture)])
    paths = [tmp_path / f"{i}.mp3" for i in (1, 2)]
    for p in paths:
        p.write_bytes(old + sound)
    assert containers.embed([str(p) for p in paths], BOOK) == (2, [])
    for i, p in enumerate(paths, 1):
        data = p.read_bytes()
        s = read(data, True)
        assert data.endswith(sound) and s.first("TRCK") == f"{i}/2" and s.tags["TXXX:series"] == ["Saga"] and "TIT2" not in s.tags and "TIT1" not in s.tags
        assert metadata.audio_meta(data) == {"title": "Der Prozeß", "author": "Franz Kafka", "series": "Saga", "series_index": "2"}
        assert metadata.audio_extras(data)["year"] == "1925" and metadata.audio_extras(data)["isbn"] == BOOK["isbn"]
        if version:
            assert s.picture == PNG and s.first("TXXX:mood") == "calm" and s.first("TPUB") == "House"
    assert containers.embed([str(paths[0])], None, JPEG) == (1, [])
    s = read(paths[0].read_bytes(), True)
    assert s.picture == JPEG and s.first("TALB") == "Der Prozeß" and paths[0].read_bytes().endswith(sound)


@pytest.mark.parametrize("kind", ["flac", "opus", "vorbis"])
def test_flac_and_ogg_round_trip(tmp_path, kind):
    made = {"flac": flac, "opus": opus, "vorbis": vorbis}[kind]({"album": "Old", "encoder": "x"})
    path = tmp_path / f"a.{'ogg' if kind == 'vorbis' else kind}"
    path.write_bytes(made)
    image = JPEG + bytes(90_000)  # the comment outgrows a page
    for _ in range(2):
        assert containers.embed([str(path)], BOOK, image) == (1, [])
        data = path.read_bytes()
        assert metadata.audio_meta(data) == {"title": "Der Prozeß", "author": "Franz Kafka", "series": "Saga", "series_index": "2"}
        s = read(data, True)
        assert s.picture == image and s.first("encoder") == "x" and s.length == read(made).length and len(s.tags["album"]) == 1
        if kind == "flac":
            assert data.endswith(b"\xff\xf8audio" * 300)
        else:
            assert ogg_audio(data) == ogg_audio(made)


def test_a_crash_leaves_the_old_file(tmp_path, monkeypatch):
    path = tmp_path / "a.mp3"
    path.write_bytes(mpeg(50))
    old = path.read_bytes()
    monkeypatch.setattr(containers.os, "replace", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    done, problems = containers.embed([str(path)], BOOK)
    assert done == 0 and "disk" in problems[0] and path.read_bytes() == old and os.listdir(tmp_path) == ["a.mp3"]
    (tmp_path / "b.m4b").write_bytes(b"no container")
    (tmp_path / "c.wma").write_bytes(b"x")
    assert containers.embed([str(tmp_path / "b.m4b"), str(tmp_path / "c.wma")], BOOK)[0] == 0
    assert (tmp_path / "b.m4b").read_bytes() == b"no container"
