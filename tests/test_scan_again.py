"""Scans that open only what has changed, and remarks on sources that disagree."""

from __future__ import annotations

import os

from test_audio import id3, frame as id3_frame, mpeg
from test_catalog import put

from tomewright.plans import scan
from tomewright.session import materialize

OPF = '<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{}</dc:title><dc:creator>{}</dc:creator></metadata></package>'


def song(title: bytes, n: int = 20) -> bytes:
    return id3(4, [id3_frame(4, "TALB", b"\0" + title), id3_frame(4, "TPE1", b"\0Ann Bell")]) + mpeg(n)


def test_a_second_scan_opens_only_what_changed(spark, tmp_path):
    for name, title in (("a/one.mp3", b"One"), ("b/two.mp3", b"Two"), ("c/three.mp3", b"Three")):
        put(tmp_path, {name: ""})
        (tmp_path / name).write_bytes(song(title))
    put(tmp_path, {"b/metadata.opf": OPF.format("Two of Opf", "Ann Bell")})
    books, ledger = scan.scan_again(spark, str(tmp_path), None)
    first = {r.src_display: r for r in books.collect()}
    assert {k: r.title for k, r in first.items()} == {"a": "One", "b": "Two of Opf", "c": "Three"}
    ledger = materialize(ledger, "kept")
    # other bytes, but the same size and time: they aren't read; one file has changed, one is new, one is gone
    for name, title in (("a/one.mp3", b"Uno"), ("b/metadata.opf", None)):
        path = tmp_path / name
        st, data = os.stat(path), path.read_bytes()
        path.write_bytes(song(title) if title else b"x" * len(data))
        assert os.stat(path).st_size == st.st_size
        os.utime(path, ns=(st.st_atime_ns, st.st_mtime_ns))
    (tmp_path / "c/three.mp3").write_bytes(song(b"Drei", 30))
    put(tmp_path, {"d/four.mp3": ""})
    (tmp_path / "d/four.mp3").write_bytes(song(b"Four"))
    again, after = scan.scan_again(spark, str(tmp_path), ledger)
    second = {r.src_display: r for r in again.collect()}
    assert {k: r.title for k, r in second.items()} == {"a": "One", "b": "Two of Opf", "c": "Drei", "d": "Four"}
    assert second["a"] == first["a"] and second["b"].fingerprint == first["b"].fingerprint and second["c"].fingerprint != first["c"].fingerprint
    assert sorted(r.rel_path for r in after.collect()) == ["a/one.mp3", "b/metadata.opf", "b/two.mp3", "c/three.mp3", "d/four.mp3"]
    # a file that is no longer alone is asked again for what names a book of many files
    (tmp_path / "d/four - 02.mp3").write_bytes(song(b"Four"))
    os.rename(tmp_path / "d/four.mp3", tmp_path / "d/four - 01.mp3")
    third = {r.src_display: r for r in scan.scan_again(spark, str(tmp_path), materialize(after, "kept"))[0].collect()}
    assert third["d"].title == "Four" and len(third["d"].files) == 2
    assert {r.title for r in scan.scan(spark, str(tmp_path)).collect()} >= {"Uno", "Drei"}


def test_sources_that_disagree_are_remarked(spark, tmp_path):
    put(tmp_path, {"Xan Bell/Some Title/a.mp3": "x", "Xan Bell/Some Title/metadata.opf": OPF.format("Some Title", "Wholly Other"), "Zoe Oak/First Book/b.mp3": "", "Rob Inn/Second Book/c.mp3": "y", "Rob Inn/Second Book/metadata.opf": OPF.format("Second Book", "Rob Inn")})
    (tmp_path / "Zoe Oak/First Book/b.mp3").write_bytes(song(b"Quite Another Thing"))
    found = {r.src_display: r for r in scan.scan(spark, str(tmp_path)).collect()}
    assert {k: r.meta_source for k, r in found.items()} == {"Xan Bell/Some Title": "opf (path differs)", "Zoe Oak/First Book": "folders (tags differ)", "Rob Inn/Second Book": "opf"}
    assert found["Xan Bell/Some Title"].confidence == found["Rob Inn/Second Book"].confidence - 15


def test_a_plan_is_saved_whole(spark, tmp_path):
    path = str(tmp_path / "plan")
    one = scan.conform(spark.createDataFrame([(1, "One")], "id long, title string"))
    scan.save_plan(one, path)
    scan.save_plan(one.unionByName(scan.conform(spark.createDataFrame([(2, "Two")], "id long, title string"))), path)
    assert sorted(r.title for r in scan.load_plan(spark, path).collect()) == ["One", "Two"] and sorted(os.listdir(tmp_path)) == ["plan"]
    os.rename(path, path + ".old")  # what a crash between the renames leaves
    assert scan.load_plan(spark, path).count() == 2
