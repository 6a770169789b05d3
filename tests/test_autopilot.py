"""Stages that are kept: an interrupted run goes on behind what is done, and changed files are seen."""

from __future__ import annotations

import json
import os

import pytest
from test_audio import id3, mpeg
from test_audio import frame as id3_frame
from test_catalog import put
from test_enrich_files import counting

from tomewright.plans import autopilot


def song(title: bytes, author: bytes) -> bytes:
    return id3(4, [id3_frame(4, "TALB", b"\0" + title), id3_frame(4, "TPE1", b"\0" + author)]) + mpeg(40)


def test_an_interrupted_run_goes_on(spark, tmp_path, monkeypatch):
    root, folder, log = str(tmp_path / "lib"), f"file://{tmp_path}/stages", str(tmp_path / "asked")
    names = {"a/one.mp3": (b"One", b"J. R. R. Oak"), "b/two.mp3": (b"Two", b"J.R.R. Oak"), "c/three.mp3": (b"Three", b"J.R.R. Oak"), "d/one.mp3": (b"One", b"J.R.R. Oak")}
    for path, (title, author) in names.items():
        put(tmp_path / "lib", {path: ""})
        (tmp_path / "lib" / path).write_bytes(song(title, author))

    class Model:
        inner = counting({}, log)

        def get(self, kind, query):
            told = self.inner.get(kind, query)
            return json.dumps({"title": "Three of Them", "author": "J.R.R. Oak", "confidence": 95}) if kind == "model" and "Three" in query else told

    whole = autopilot.merge_safe_authors
    monkeypatch.setattr(autopilot, "merge_safe_authors", lambda books: (_ for _ in ()).throw(KeyboardInterrupt()))
    o = autopilot.Options(threshold=101)
    with pytest.raises(KeyboardInterrupt):
        autopilot.autopilot(spark, root, folder, Model(), o)
    asked = open(log).read()
    monkeypatch.setattr(autopilot, "merge_safe_authors", whole)
    monkeypatch.setattr(autopilot.scan, "scan_again", lambda *a, **k: pytest.fail("scanned again"))
    monkeypatch.setattr(autopilot.enrich, "enrich_files", lambda *a, **k: pytest.fail("enriched again"))
    books, done = autopilot.autopilot(spark, root, folder, Model(), o)
    assert done == ["authors", "asked", "resolved"]
    rows = {r.src_display: r for r in books.collect()}
    assert {r.author for r in rows.values()} == {"J.R.R. Oak"} and rows["c"].title == "Three of Them"
    assert sorted(rows[x].status == "skipped" for x in "ad") == [False, True]
    assert [x for x in open(log).read()[len(asked) :].splitlines() if not x.startswith("model")] == []
    again, done = autopilot.autopilot(spark, root, folder, Model(), o)
    assert done == [] and again.count() == 4
    # a file more is another listing; a stop is heeded between stages
    monkeypatch.undo()
    put(tmp_path / "lib", {"e/five.mp3": ""})
    put(tmp_path / "stages", {"STOP": ""})
    with pytest.raises(autopilot.Stopped, match="before scanned"):
        autopilot.autopilot(spark, root, folder, Model(), o)
    os.remove(tmp_path / "stages/STOP")
    books, done = autopilot.autopilot(spark, root, folder, Model(), autopilot.Options(ask_model=False, resolve_duplicates=False))
    assert done == ["scanned", "enriched", "authors"] and books.count() == 5
