"""Transfers on the executors: whole books or nothing, whatever is killed and whenever."""

from __future__ import annotations

import json
import os
import shutil
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_audio import JPEG, mp4, mpeg
from test_catalog import put

from tomewright.operators import copying, sink
from tomewright.plans import scan
from tomewright.sources import audio, metadata


def tree(root) -> dict[str, bytes]:
    """Every file below a folder, but for the journal."""
    out = {}
    for folder, _, files in os.walk(root):
        for f in files:
            path = os.path.join(folder, f)
            if "/.transfers" not in path and "/journal" not in path:
                with open(path, "rb") as fh:
                    out[os.path.relpath(path, root)] = fh.read()
    return out


def options(root, **k):
    return {"root": str(root / "dest"), "journal": str(root / "journal"), "run": "r1", "move": "false", "conflict": "replace", "embed": "false", "embedcover": "false"} | k


def book_row(root, **k):
    files = [SimpleNamespace(src=str(root / f"src/{n}.mp3"), target=f"{n}.mp3", is_primary=True) for n in (1, 2)]
    files.append(SimpleNamespace(src=str(root / "src/cover.jpg"), target="cover.jpg", is_primary=False))
    base = dict(id=1, plan="p", folder=str(root / "dest/A/T"), files=files, opf="<opf/>", document=json.dumps({"title": "T", "author": "A"}), cover=None, pending=None, committed=None)
    return SimpleNamespace(**(base | k))


def set_up(root):
    put(root, {"src/1.mp3": "one", "src/2.mp3": "two", "src/cover.jpg": "img", "dest/A/T/1.mp3": "an older one"})


def killed_at(step: int, before: bool, opts: dict, row) -> bool:
    """Run the writer in a process that dies at its n-th line of the journal; whether it died."""
    pid = os.fork()
    if pid == 0:
        try:
            write, count = sink.Journal.write, [0]

            def dying(self, **line):
                count[0] += 1
                if count[0] == step and before:
                    os._exit(9)
                write(self, **line)
                if count[0] == step:
                    os._exit(9)

            sink.Journal.write, sink._partition = dying, lambda: 0
            sink._BookWriter(opts).write(iter([row]))
        finally:
            os._exit(0)
    return os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1]) == 9


@pytest.mark.parametrize("how", ["copy", "rename", "move"])
def test_killed_at_every_step_and_tried_again(tmp_path, monkeypatch, how):
    monkeypatch.setattr(sink, "_partition", lambda: 0)
    if how == "move":
        monkeypatch.setattr(sink.Transfer, "put", put_between_drives)
    opts = lambda root: options(root, move=str(how != "copy").lower())
    whole = tmp_path / "whole"
    set_up(whole)
    sink._BookWriter(opts(whole)).write(iter([book_row(whole)]))
    want = tree(whole)
    assert want["dest/A/T/1.mp3"] == b"one" and want["dest/.replaced/A/T/1.mp3"] == b"an older one" and ("src/1.mp3" in want) == (how == "copy")
    for before in (True, False):
        for step in range(1, 40):
            root = tmp_path / f"{before}{step}"
            set_up(root)
            died = killed_at(step, before, opts(root), book_row(root))
            # the next attempt of the task finds the journal of the one before
            sink._BookWriter(opts(root)).write(iter([book_row(root)]))
            assert tree(root) == want, (before, step)
            lines = sink.read_lines([str(p) for p in (root / "journal").glob("*.jsonl")])
            assert [x["status"] for x in lines if "status" in x] == ["copied" if how == "copy" else "moved"]
            if not died:
                break
        assert 6 < step < 39


def put_between_drives(self, src, target):
    """What ``Transfer.put`` does of a file that is moved to another drive."""
    part = f"{target}.x.part"
    self._begin("part", src, part)
    shutil.copy2(src, part)
    self._begin("copy", src, target)
    os.rename(part, target)
    if self.move:
        self.sources.append((src, target))


def library(spark, root, n=6):
    """Books of one file each, two of them in one folder; and the list of their files."""
    put(root, {f"source/b{i}/book.mp3": f"book {i} " * 50 for i in range(n)})
    put(root, {"source/b0/desc.txt": "about", f"source/b{n - 1}/more.mp3": "another book"})
    paths = [str(root / f"source/b{i}/book.mp3") for i in range(n)]
    rows = [(i, f"Title {i}", "Ann Bell", 90, [p], "audio", "ready", [], []) for i, p in enumerate(paths)]
    books = scan.conform(spark.createDataFrame(rows, "id long, title string, author string, confidence int, files array<string>, kind string, status string, extras array<string>, locked array<string>"))
    return books, spark.createDataFrame([(p, 400) for p in paths], "path string, size long")


def test_a_run_that_was_cut_off_goes_on(spark, tmp_path):
    """A book of an earlier run is done, one was cut off while its file was moved, one was committed."""
    books, files = library(spark, tmp_path)
    source, dest, journal = (str(tmp_path / x) for x in ("source", "dest", "journal"))
    o = copying.Options(move=True, embed=False)
    first, _ = copying.transfer(books.where("id = 0"), files, source, dest, o, journal=journal)
    assert first.first().status == "moved" and not os.path.exists(f"{source}/b0")
    src1, at1, src2, at2 = f"{source}/b1/book.mp3", f"{dest}/Ann Bell/Title 1/Title 1.mp3", f"{source}/b2/book.mp3", f"{dest}/Ann Bell/Title 2/Title 2.mp3"
    os.makedirs(os.path.dirname(at1))
    os.makedirs(os.path.dirname(at2))
    os.rename(src1, at1)  # moved, but not committed: it goes back, and is moved again
    shutil.copy(src2, at2)  # committed: the original goes
    with open(f"{journal}/dead-00000-x.jsonl", "w") as fh:
        fh.write(json.dumps({"id": 1, "plan": "p", "op": ["rename", src1, at1]}) + "\n")
        fh.write(json.dumps({"id": 2, "plan": "p", "op": ["copy", src2, at2]}) + "\n" + json.dumps({"id": 2, "plan": "p", "commit": [[src2, at2]]}) + "\n")
        fh.write('{"id": 3, "plan": "p", "op": ["copy", "cut of')
    after, told = copying.transfer(books, files, source, dest, o, journal=journal)
    assert {r.id: r.status for r in after.collect()} == dict.fromkeys(range(6), "moved")
    assert {r.id: r.folder for r in told.collect()}[0] == f"{dest}/Ann Bell/Title 0"
    for i in range(6):
        with open(f"{dest}/Ann Bell/Title {i}/Title {i}.mp3") as fh:
            assert fh.read() == f"book {i} " * 50
    assert os.listdir(source) == ["b5"] and os.listdir(f"{source}/b5") == ["more.mp3"] and os.path.exists(f"{dest}/Ann Bell/Title 0/desc.txt")
    assert sink.progress(spark, journal) == {"moved": 6}
    again, told = copying.transfer(books, files, source, dest, o, journal=journal)
    assert {r.status for r in again.collect()} == {"moved"} and told.count() == 6


def test_stopped_between_books(spark, tmp_path):
    books, files = library(spark, tmp_path, 3)
    source, dest, journal = (str(tmp_path / x) for x in ("source", "dest", "journal"))
    sink.stop(journal)
    after, told = copying.transfer(books, files, source, dest, journal=journal)
    assert {r.status for r in after.collect()} == {"ready"} and told.count() == 0 and tree(dest) == {}
    sink.resume(journal)
    after, _ = copying.transfer(books, files, source, dest, journal=journal)
    assert {r.status for r in after.collect()} == {"copied"}
    shutil.rmtree(f"{dest}/Ann Bell/Title 1")  # the journal isn't believed where the files are gone
    again, _ = copying.transfer(books, files, source, dest, journal=journal)
    assert os.path.exists(f"{dest}/Ann Bell/Title 1/Title 1.mp3") and {r.status for r in again.collect()} == {"copied"}


def test_fields_and_covers_within_the_files(spark, tmp_path):
    """One broken metadata.json at the destination ends nothing; tags and covers are written into the copies."""
    put(tmp_path, {"dest/Ann Bell/One/metadata.json": "{broken"})
    (tmp_path / "source").mkdir()
    (tmp_path / "source/one.m4b").write_bytes(mp4())
    (tmp_path / "source/two.mp3").write_bytes(mpeg(30))
    (tmp_path / "source/pic.jpg").write_bytes(JPEG)
    rows = [(i, t, "Ann Bell", 90, [str(tmp_path / f"source/{f}")], "audio", "ready", [], [], str(tmp_path / "source/pic.jpg"), "Rob Inn") for i, t, f in ((1, "One", "one.m4b"), (2, "Two", "two.mp3"))]
    books = scan.conform(spark.createDataFrame(rows, "id long, title string, author string, confidence int, files array<string>, kind string, status string, extras array<string>, locked array<string>, cover string, narrator string"))
    files = spark.createDataFrame([(r[4][0], 10) for r in rows], "path string, size long")
    old = tree(tmp_path / "source")
    after, told = copying.transfer(books, files, str(tmp_path / "source"), str(tmp_path / "dest"))
    assert {r.status for r in after.collect()} == {"copied"} and tree(tmp_path / "source") == old
    for title, name in (("One", "One.m4b"), ("Two", "Two.mp3")):
        folder = tmp_path / "dest/Ann Bell" / title
        with open(folder / name, "rb") as fh:
            sound = audio.read(fh, True)
        assert metadata.sound_meta(sound) == {"title": title, "author": "Ann Bell"} and metadata.sound_extras(sound)["narrator"] == "Rob Inn" and sound.picture == JPEG
        assert json.loads((folder / "metadata.json").read_text())["title"] == title and (folder / "cover.jpg").read_bytes() == JPEG


def test_what_cannot_be_written_is_told(tmp_path):
    os.makedirs(tmp_path / "metadata.opf")
    (tmp_path / "c.jpg").write_bytes(JPEG)
    problems = sink.finish(str(tmp_path), "<opf/>", json.dumps({"title": "T", "author": "A"}), str(tmp_path / "c.jpg"))
    assert len(problems) == 1 and "metadata.opf" in problems[0] and (tmp_path / "metadata.json").exists() and (tmp_path / "cover.jpg").exists()


def test_names_that_are_no_utf8(spark, tmp_path):
    """A file's name may be any bytes: it is listed, scanned and moved like any other."""
    from tomewright.sources import tree as trees

    odd = os.fsencode(str(tmp_path)) + b"/source/Ann Bell/caf\xe9 \xf0\x9f\x98\x80.mp3"
    os.makedirs(os.path.dirname(odd))
    with open(odd, "wb") as fh:
        fh.write(mpeg(30))
    put(tmp_path, {"source/Rob Inn/Plain.mp3": "x" * 50})
    for name in (os.fsdecode(odd), "/a/b", "/a/é", "plain"):
        assert trees.os_path(trees.path_text(name)) == name
        trees.path_text(name).encode()
    books = scan.scan(spark, str(tmp_path / "source"))
    rows = {r.author: r for r in books.collect()}
    assert set(rows) == {"Ann Bell", "Rob Inn"} and rows["Ann Bell"].fingerprint
    full = F.transform("files", lambda f: F.concat(F.lit(f"{tmp_path}/source/"), f))
    books = books.withColumn("files", full)
    files = books.select(F.explode("files").alias("path"), F.lit(10).alias("size"))
    after, _ = copying.transfer(books, files, str(tmp_path / "source"), str(tmp_path / "dest"), copying.Options(move=True, force=True, hold_review=False, threshold=0, embed=False))
    assert {r.status for r in after.collect()} == {"moved"} and not os.path.exists(odd)
    there = [f for _, _, found in os.walk(tmp_path / "dest/Ann Bell") for f in found if f.endswith(".mp3")]
    assert len(there) == 1
