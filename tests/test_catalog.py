"""Scan, duplicates, authors, decisions, views and the sink on small libraries."""

from __future__ import annotations

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tomewright.operators import authors, decisions, dedupe, resolve, schema, sink, views
from tomewright.plans import scan
from tomewright.sources import clients, metadata, tree

OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:title>The Name of the Wind</dc:title><dc:creator>Rothfuss, Patrick</dc:creator><dc:identifier>9780306406157</dc:identifier>
<meta name="calibre:series" content="Kingkiller"/><meta name="calibre:series_index" content="1"/></metadata>
<manifest><item id="a" href="a.html"/></manifest><spine><itemref idref="a"/></spine></package>"""


def put(root, files):
    for rel, data in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())


def epub(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        z.writestr("c.opf", OPF)
        z.writestr("a.html", "<p>Front &amp; matter ISBN 9780306406157</p>")
    return path.read_bytes()


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    put(root, {
        "Stephen King/The Stand/Disc 1/01.mp3": "a1", "Stephen King/The Stand/Disc 1/02.mp3": "a2", "Stephen King/The Stand/Disc 2/01.mp3": "b1", "Stephen King/The Stand/Disc 10/01.mp3": "c1",
        "temp/unsorted_042/metadata.opf": OPF, "New folder (3)/wise mans fear book2/a.m4b": "w", "loose/Andy Weir - The Martian.epub": "x",
        "_hidden/Dune - Frank Herbert/empty.mp3": b"", "audiobooks/Leslie Wolfe - Dawn Girl - 01 - Opening.mp3": "d1", "audiobooks/Leslie Wolfe - Dawn Girl - 02 - End.mp3": "d2",
    })
    (root / "temp/unsorted_042/book.epub").write_bytes(epub(root / "temp/unsorted_042/book.epub"))
    return root


def test_tree_lists_empty_and_hidden_files(spark, library):
    rows = {r.rel_path: r.size for r in tree.list_tree(spark, str(library)).collect()}
    assert rows["_hidden/Dune - Frank Herbert/empty.mp3"] == 0 and len(rows) == 11


def test_scan(spark, library):
    books = {r.src_display + "|" + r.files[0]: r for r in scan.scan(spark, str(library)).collect()}
    by_title = {r.title: r for r in books.values()}
    assert len(books) == 6
    stand = by_title["The Stand"]
    assert [f.split("/")[2:] for f in stand.files] == [["Disc 1", "01.mp3"], ["Disc 1", "02.mp3"], ["Disc 2", "01.mp3"], ["Disc 10", "01.mp3"]]
    assert stand.author == "Stephen King" and stand.status == "ready" and len(stand.fingerprint) == 20
    wind = by_title["The Name of the Wind"]
    assert (wind.author, wind.series, wind.series_index, wind.meta_source) == ("Patrick Rothfuss", "Kingkiller", "1", "opf")
    assert by_title["The Martian"].author == "Andy Weir"
    assert len(by_title["Dawn Girl"].files) == 2 and by_title["Dawn Girl"].author == "Leslie Wolfe"


def test_readers(spark, tmp_path):
    data = epub(tmp_path / "b.epub")
    side = json.dumps({"title": "T", "authors": [{"name": "A"}], "series": ["S #2"], "isbn": "9780306406157", "narrators": ["N"]}).encode()
    df = spark.createDataFrame([(bytearray(data), bytearray(side), ".epub")], "e binary, j binary, ext string")
    r = df.select(metadata.read_epub("e").alias("e"), metadata.read_json("j").alias("j"), metadata.read_epub_extras("e").alias("x"), metadata.read_json_extras("j").alias("y"), metadata.read_front("e", "ext").alias("f"), metadata.read_mobi("j").alias("bad")).first()
    assert r.e.series == "Kingkiller" and r.j.series_index == "2" and r.x.isbn == "9780306406157" and r.y.narrator == "N"
    assert r.f.startswith("Front & matter") and r.bad.title == ""
    assert metadata.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (600).to_bytes(4, "big") + (800).to_bytes(4, "big")) == (600, 800)


def book(**k):
    return {"kind": "audio", "files": [f"/l/{k['id']}.mp3"], "extras": [], "status": "ready", "meta_source": "tags", "locked": [], "flags": [], "confidence": 50} | k


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA(spark)) for r in rows], schema.BOOK)


def SCHEMA(spark):
    return spark.createDataFrame([], schema.BOOK).schema


def test_duplicate_groups(spark):
    books = frame(spark, [
        book(id=1, title="The Martian", author="Andy Weir", fingerprint="f1", bitrate=64000), book(id=2, title="Martian (Unabridged)", author="Andy Weir", fingerprint="f2", bitrate=128000),
        book(id=3, title="Dune", author="Frank Herbert", duration=5000.0, fingerprint="f3"), book(id=4, title="Something Else", author="Frank Herbert", duration=5001.0, fingerprint="f4"),
        book(id=5, title="Mistborn 1", author="Brandon Sanderson", fingerprint="f5"), book(id=6, title="Mistborn 2", author="Brandon Sanderson", fingerprint="f6"),
        book(id=7, title="Emma", author="Jane Austen", kind="ebook", files=["/l/e.epub"], fingerprint="f7"), book(id=8, title="Emma", author="Jane Austen", kind="ebook", files=["/l/e.mobi"], fingerprint="f8"),
        book(id=9, title="Dune", author="Frank Herbert", status="skipped", fingerprint="f3"),
    ])
    files = spark.createDataFrame([("/l/1.mp3", 10, None), ("/l/2.mp3", 20, None)], "path string, size long, mtime timestamp")
    found = {tuple(g.ids): g for g in dedupe.groups(books, files).collect()}
    assert set(found) == {(1, 2), (3, 4), (7, 8)}
    assert found[1, 2].keep == 2 and found[1, 2].reasons[0].reason in ("Same title and author", "Similar title")
    assert found[3, 4].reasons[0].reason == "Same author and length" and found[3, 4].keep == 4
    assert found[7, 8].merge_formats
    dismissed = spark.createDataFrame([(found[3, 4].key,)], "key string")
    left = dedupe.groups(books, files, dismissed)
    assert left.count() == 2
    after, corrections, journal = dedupe.resolve(books, left)
    rows = {r.id: r for r in after.collect()}
    assert rows[1].status == "skipped" and 8 not in rows and rows[7].files == ["/l/e.epub", "/l/e.mobi"]
    assert {r.action for r in journal.collect()} == {"skip-duplicate", "merge-formats"} and corrections.count() == 2


def test_band_pairs_equal_brute_force(spark):
    values = [(i, "k", float(v)) for i, v in enumerate([1200, 1201, 1203, 1203, 1206, 90000, 90040, 90050, 90095])]
    df = spark.createDataFrame(values, "id long, k string, v double")
    got = {(r.src, r.dst) for r in dedupe.band_pairs(df, "k", "v", lambda v: F.greatest(F.lit(3.0), v * 0.0005)).collect()}
    want = {(a, b) for a, _, x in values for b, _, y in values if (y > x or y == x and b > a) and y - x <= max(3.0, x * 0.0005)}
    assert got == want


def test_authors(spark):
    named = spark.createDataFrame([("Pierce Brown", 5, 1), ("Pierce Browne", 1, 1), ("J.R.R. Tolkien", 3, 1), ("J. R. R. Tolkien", 2, 1), ("Gaiman & Pratchett", 1, 1)], "name string, n long, trust long")
    got = {r.canonical: (r.confidence, len(r.variants)) for r in authors.cluster(named).collect()}
    assert got == {"Pierce Brown": ("medium", 2), "J.R.R. Tolkien": ("high", 2), "Gaiman": ("glued", 1)}
    rejected = spark.createDataFrame([("pierce brown", "pierce browne")], "a string, b string")
    assert "Pierce Brown" not in {r.canonical for r in authors.cluster(named, rejected).collect()}


def test_memory_and_passes(spark):
    books = frame(spark, [book(id=1, title="Frank Herbert", author="Dune", meta_source="filename", fingerprint="x"), book(id=2, title="Emma", author="Frank Herbert", fingerprint="y"), book(id=3, title="Untitled", author="calibre", fingerprint="z"), book(id=4, title="Hail Mary", author="Ray Porter", fingerprint="w")])
    rows = {r.id: r for r in resolve.narrator_pass(resolve.library_pass(books)).collect()}
    assert (rows[1].title, rows[1].author, rows[1].meta_source) == ("Dune", "Frank Herbert", "filename (swapped)")
    assert (rows[3].title, rows[3].author, rows[3].status) == ("", "", "needs review")
    assert rows[4].flags == [resolve.FLAG] and rows[4].confidence == 42
    aliases = spark.createDataFrame([("frank herbert", "F. Herbert", None)], schema.ALIASES)
    corrections = spark.createDataFrame([("y", {"title": "Emma!", "_status": "skipped"}, None)], schema.CORRECTIONS)
    r = {x.id: x for x in decisions.apply_memory(books, aliases, corrections).collect()}[2]
    assert (r.title, r.author, r.status, r.locked, r.meta_source) == ("Emma!", "F. Herbert", "skipped", ["title"], "you")
    edits = spark.createDataFrame([(3, {"author": "A", "title": "B"})], "id long, fields map<string,string>")
    after, kept = decisions.remember(books, edits)
    assert {x.id: x for x in after.collect()}[3].locked == ["author", "title"] and kept.count() == 1


def test_views(spark):
    books = frame(spark, [book(id=1, title="T", author="A", confidence=90), book(id=2, title="", author="A"), book(id=3, title="x", author="b", status="copied"), book(id=4, title="50%", author="c", health="bad", status="ERROR: x")])
    c = views.state_counts(books, 70).first()
    assert (c.total, c.ready, c.review, c.copied, c.error, c.low, c.damaged) == (4, 1, 1, 1, 1, 2, 1)
    assert [r.id for r in views.listing(books, q="50%").collect()] == [4]
    assert [r.id for r in views.listing(books, status="low", sort="conf").collect()] == [2, 4]
    assert views.page(views.listing(books), 1, 10)[1:] == (4, 1)


def test_candidates(spark):
    rows = frame(spark, [book(id=1, title="Project Hail Mary", author="Ray Porter", duration=58000.0, meta_source="filename")])
    c = "named_struct('source', 'Audible', 'asin', '', 'title', 'Project Hail Mary', 'subtitle', '', 'author', 'Andy Weir', 'narrator', 'Ray Porter', 'series', '', 'series_index', '', 'runtime', 58020, 'year', '2021', 'publisher', '', 'language', '', 'description', '', 'genres', '', 'cover_url', '', 'isbn', '')"
    scored = resolve.score_candidates(rows.withColumn("c", F.expr(c)).withColumn("ordinal", F.lit(0)))
    assert scored.first().narrator_swap and scored.first().score == 1.13
    r = resolve.accept_best(rows, scored).first()
    assert (r.author, r.narrator, r.year, r.meta_source, r.match_bonus) == ("Andy Weir", "Ray Porter", "2021", "Audible", 20)


def test_client_asks_only_misses(spark):
    cache = spark.createDataFrame([("k1", "old", None)], schema.CACHE).withColumn("ts", F.current_timestamp())
    questions = spark.createDataFrame([("k1", "a", "x"), ("k2", "a", "y")], "key string, kind string, query string")
    answers, after = clients.ask(questions, cache, clients.Canned({("a", "y"): "new"}), days=30)
    assert {(r.key, r.value) for r in answers.collect()} == {("k1", "old"), ("k2", "new")} and after.count() == 2


@pytest.mark.parametrize(("conflict", "size", "status", "there"), [("skip", 7, "in destination", 7), ("replace", 7, "copied", 4), ("keep_both", 7, "copied", 7), ("keep_better", 7, "in destination", 7), ("keep_better", 2, "copied", 4), ("skip", -1, "copied", 4)])
def test_sink_conflicts(spark, tmp_path, conflict, size, status, there):
    put(tmp_path, {"src/a.m4b": "book"})
    if size >= 0:
        put(tmp_path, {"dest/A/T/T.m4b": "x" * size})
    books = frame(spark, [book(id=1, title="T", author="A", files=[f"{tmp_path}/src/a.m4b"])])
    plan = sink.copy_plan(books, f"{tmp_path}/dest")
    assert [x[1] for x in sink.execute(plan, f"{tmp_path}/dest", conflict=conflict)] == [status]
    assert os.path.getsize(f"{tmp_path}/dest/A/T/T.m4b") == there and os.path.exists(f"{tmp_path}/src/a.m4b")
    assert os.path.exists(f"{tmp_path}/dest/A/T (2)/T.m4b") == (conflict == "keep_both")
    assert os.path.exists(f"{tmp_path}/dest/.replaced/A/T/T.m4b") == (there == 4 and size >= 0)


def test_sink_moves_whole_books_or_nothing(spark, tmp_path):
    put(tmp_path, {"src/T/1.mp3": "1", "src/T/2.mp3": "2", "src/T/Thumbs.db": "x"})
    files = [f"{tmp_path}/src/T/{n}.mp3" for n in (1, 2)]
    bad = frame(spark, [book(id=1, title="T", author="A", files=[*files, f"{tmp_path}/src/T/3.mp3"])])
    done = list(sink.execute(sink.copy_plan(bad, f"{tmp_path}/dest", move=True), f"{tmp_path}/dest", move=True, source_root=f"{tmp_path}/src"))
    assert done[0][1].startswith("ERROR") and all(os.path.exists(f) for f in files) and not os.path.exists(f"{tmp_path}/dest/A/T")
    good = frame(spark, [book(id=1, title="T", author="A", files=files)])
    plan = sink.copy_plan(good, f"{tmp_path}/dest", rename_parts=True, move=True)
    assert [x[1] for x in sink.execute(plan, f"{tmp_path}/dest", move=True, source_root=f"{tmp_path}/src")] == ["moved"]
    assert sorted(os.listdir(tmp_path / "dest/A/T")) == ["T - 01.mp3", "T - 02.mp3"] and not os.path.exists(tmp_path / "src/T")


def test_stream_of_arrivals(spark, tmp_path):
    from tomewright.streaming.arrivals import new_files

    put(tmp_path, {"in/a.json": '{"path": "/x", "size": 1, "mtime": "2024-01-01T00:00:00Z"}\n{"path": "/y", "size": 2, "mtime": "2024-01-01T00:00:00Z"}\n'})
    known = spark.sql("SELECT '/x' AS path, 1L AS size, timestamp '2024-01-01 00:00:01' AS mtime, 'fp' AS fp")
    got = []
    q = new_files(spark, f"{tmp_path}/in", lambda: known, lambda df, n: got.extend(r.path for r in df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert got == ["/y"]


GOOGLE = json.dumps({"items": [{"volumeInfo": {"title": "Emma", "authors": ["Jane Austen"], "publishedDate": "1815-12", "publisher": "Murray", "industryIdentifiers": [{"type": "ISBN_10", "identifier": "x"}, {"type": "ISBN_13", "identifier": "9780306406157"}], "imageLinks": {"thumbnail": "http://g/i?zoom=1&edge=curl"}, "description": "<b>A</b> novel"}}]})


def test_enrichment_end_to_end(spark):
    from tomewright.operators import enrich

    books = frame(spark, [book(id=1, kind="ebook", title="Emma", author="Jane Austin", meta_source="filename", files=["/l/e.epub"], confidence=38)])
    query = json.dumps({"title": "Emma", "author": "Jane Austin"}, separators=(",", ":"))
    cache = spark.createDataFrame([], schema.CACHE)
    extras = spark.createDataFrame([(1, {"language": "en"}, {"publisher": "Own"})], "id long, side struct<narrator:string,year:string,publisher:string,description:string,genres:string,asin:string,isbn:string,language:string>, local struct<narrator:string,year:string,publisher:string,description:string,genres:string,asin:string,isbn:string,language:string>")
    votes = spark.createDataFrame([(1, [("Emma", "Jane Austin"), ("Emma", ""), ("", "Jane Austin")])], "id long, votes array<struct<title:string,author:string>>")
    after, kept = enrich.enrich(books, cache, clients.Canned({("google", query): GOOGLE}), extras=extras, votes=votes)
    r = after.first()
    assert (r.author, r.year, r.publisher, r.isbn, r.language, r.meta_source) == ("Jane Austen", "1815", "Own", "9780306406157", "en", "Google Books")
    assert r.match_bonus == 10 + 20 or r.match_bonus == 10 + 12
    assert r.online_best.source == "Google Books" and r.enriched and r.confidence >= 80
    assert kept.count() == 2  # what was asked: found or not


def test_probe_and_covers(spark):
    from tomewright.operators import enrich

    parts = spark.createDataFrame([(1, 0, "a", 5, 10.25, 64, "mp3", 0), (1, 1, "b", 0, None, 0, "", 0), (1, 2, "c", 9, 1.0, 0, "", 0)], "id long, ordinal int, name string, size long, length double, bitrate int, codec string, chapters int")
    r = enrich.probe(parts).first()
    assert (r.duration, r.bitrate, r.codec, r.health) == (11.2, 64, "mp3", "b is empty (0 bytes)")
    images = spark.createDataFrame([(1, "audio", "p", "folder", 300, 600, 9999, 0), (1, "audio", "q", "embedded", 1600, 1600, 9999, 1), (1, "audio", "tiny", "x", 900, 900, 100, 2)], "id long, kind string, path string, origin string, w int, h int, bytes long, ordinal int")
    c = enrich.gather_covers(images).first()
    assert c.cover == "q" and c.cover_info == "1600x1600 embedded" and len(c.cover_candidates) == 2


def test_writers_and_settings(tmp_path):
    from tomewright import settings
    from tomewright.operators import writers

    data = writers.epub_with(epub(tmp_path / "b.epub"), {"title": "New", "author": "A B", "series": "S", "series_index": "02", "publisher": "P"})
    assert metadata.epub_meta(data) == {"title": "New", "author": "A B", "series": "S", "series_index": "2"}
    assert metadata.epub_extras(data)["publisher"] == "P" and metadata.epub_front(data).startswith("Front")
    path = str(tmp_path / "s.json")
    settings.save(path, settings.Settings(threshold=80))
    assert settings.load(path, {"TOMEWRIGHT_THRESHOLD": "1", "TOMEWRIGHT_NUMBER_FOLDERS": "true"}) == settings.Settings(threshold=80, number_folders=True)


def test_model_answers(spark):
    rows = frame(spark, [book(id=1, title="x", author="", meta_source="filename"), book(id=2, title="Home", author="q", meta_source="filename")])
    answers = spark.createDataFrame([(1, "T", "A", "S", "1", 92), (2, "T2", "A2", "", "", 86)], "id long, title string, author string, series string, series_index string, confidence int")
    got = {r.id: r for r in resolve.apply_answers(rows, answers).collect()}
    assert (got[1].title, got[1].author, got[1].series, got[1].meta_source, got[1].match_bonus) == ("T", "A", "S", "AI", 32)
    assert got[2].title == "Home" and got[2].ai.pending


def test_transfer_holds_refuses_and_copies(spark, tmp_path):
    from tomewright.operators import copying, edits
    from tomewright.plans.scan import conform

    source, dest = tmp_path / "source", tmp_path / "dest"
    put(source, {"a/one.m4b": "1" * 10, "b/two.m4b": "2" * 20, "c/three.m4b": "3" * 30})
    rows = [(1, "Ann Bell", "One", 90, str(source / "a/one.m4b"), "", ""), (2, "Ann Bell", "Two", 20, str(source / "b/two.m4b"), "", ""), (3, "Ann Bell", "Three", 95, str(source / "c/three.m4b"), "bad", "")]
    books = spark.createDataFrame(rows, "id long, author string, title string, confidence int, f string, health string, series string")
    books = conform(books.withColumns({"files": F.array("f"), "kind": F.lit("audio"), "status": F.lit("ready"), "extras": F.array().cast("array<string>"), "locked": F.array().cast("array<string>")}))
    files = spark.createDataFrame([(r[4], 10 * r[0]) for r in rows], "path string, size long")
    todo, held = copying.split(books, copying.Options(move=True))
    assert [r.id for r in todo.collect()] == [1] and {r.id: r.hold for r in held.collect()} == {2: "unapproved", 3: "damaged"}
    assert {r.id for r in copying.split(books, copying.Options())[0].collect()} == {1, 2} and copying.bytes_needed(books, files) == 60
    for bad in (str(source), str(source / "x")):
        with pytest.raises(copying.Refused, match="inside"):
            copying.guard(books, files, str(source), bad, copying.Options())
    twins = books.withColumn("title", F.lit("Same"))
    with pytest.raises(copying.Refused, match="land in a folder"):
        copying.transfer(twins, files, str(source), str(dest), copying.Options())
    with pytest.raises(copying.Refused, match="3 damaged|nothing"):
        copying.transfer(books.withColumn("health", F.lit("bad")), files, str(source), str(dest))
    after, told = copying.transfer(books, files, str(source), str(dest), copying.Options())
    assert {r.id: r.status for r in after.collect()} == {1: "copied", 2: "copied", 3: "ready"}
    assert (dest / "Ann Bell/One/One.m4b").read_text() == "1" * 10 and "<dc:title>One" in (dest / "Ann Bell/One/metadata.opf").read_text()
    own, _ = copying.transfer(twins, files, str(source), str(dest), copying.Options(keep_all=True, write_opf=False))
    assert sorted(x.name for x in (dest / "Ann Bell").iterdir()) == ["One", "Same", "Same (2)", "Two"]

    low = edits.targets(books, which="low", threshold=70)
    assert [r.id for r in low.collect()] == [2] and {r.id for r in edits.remove(books, low).collect()} == {1, 3}
    assert {r.id: r.status for r in edits.skip(books, low)[0].collect()} == {1: "ready", 2: "skipped", 3: "ready"}
    changed, kept = edits.set_fields(books.withColumn("fingerprint", F.col("title")), low, {"series": " Saga ", "nope": "x"})
    assert {r.id: r.series for r in changed.collect()} == {1: "", 2: "Saga", 3: ""} and kept.first().fields == {"series": "Saga"}
    asked = books.withColumn("ai", F.struct(F.lit("New").alias("title"), F.lit("").alias("author"), F.lit(90).alias("confidence"), F.lit(True).alias("pending")))
    done = {r.id: r for r in edits.accept_answers(asked, low)[0].collect()}
    assert (done[2].title, done[2].author, done[2].ai.pending, done[1].title) == ("New", "Ann Bell", False, "One")
    assert {r.id: sorted(r.locked) for r in edits.approve(books, low)[0].collect()}[2] == ["author", "title"]
    covers = books.withColumn("cover_candidates", F.array(F.struct(F.lit("c.jpg").alias("path"), F.lit("folder").alias("origin"), F.lit(5).alias("w"), F.lit(6).alias("h"), F.lit(0.5).alias("score"))))
    assert {r.id: r.cover_info for r in edits.choose_cover(covers, 2, "c.jpg").collect()}[2] == "5x6 folder"


def test_dedupe_exact_option_and_report(spark):
    rows = [(i, "ebook", f"Title {'x' * (i % 2)}", "Ann Bell", "ready") for i in range(6)]
    books = scan.conform(spark.createDataFrame(rows, "id long, kind string, title string, author string, status string"))
    recs = dedupe.records(books)
    assert {r.reason: r.rows for r in dedupe.left_out(recs, largest=2, block=5).collect()} == {"Same title and author": 6, "Similar title": 6}
    assert dedupe.edges(recs, largest=2, block=5).count() == 0
    assert dedupe.edges(recs, largest=None, block=None).where("reason = 'Same title and author'").count() == 4
    gone = books.withColumn("status", F.when(F.col("id") < 5, "copied").otherwise("ready"))
    assert dedupe.records(gone).count() == 1


def test_small_fixes(spark):
    from tomewright.functions import columns as C

    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(C.series_index(F.lit(x))) for x in ("1.125", "1.005", "2.25", "0.5", "12.375")] == ["01.12", "01.005", "02.25", "00.5", "12.38"]
    assert one(C.html_to_text(F.lit("caf&eacute; &mdash; &#8217;"))) == "café — ’"


def test_move_takes_leftovers_along(spark, tmp_path):
    from tomewright.operators import copying

    source, dest = tmp_path / "source", tmp_path / "dest"
    put(source, {"a/one.m4b": "1" * 10, "a/cover.jpg": "img", "a/desc.txt": "about", "a/Thumbs.db": "x", "b/two.m4b": "2" * 20, "b/three.m4b": "3" * 30, "b/notes.txt": "n"})
    rows = [(1, "One", 90, "a/one.m4b"), (2, "Two", 90, "b/two.m4b"), (3, "Three", 20, "b/three.m4b")]
    books = scan.conform(spark.createDataFrame([(i, t, "Ann Bell", c, [str(source / f)], "audio", "ready", [], []) for i, t, c, f in rows], "id long, title string, author string, confidence int, files array<string>, kind string, status string, extras array<string>, locked array<string>"))
    files = spark.createDataFrame([(str(source / f), 10) for _, _, _, f in rows], "path string, size long")
    after, _ = copying.transfer(books, files, str(source), str(dest), copying.Options(move=True))
    assert {r.id: r.status for r in after.collect()} == {1: "moved", 2: "moved", 3: "ready"}
    assert sorted(x.name for x in (dest / "Ann Bell/One").iterdir()) == ["One.m4b", "cover.jpg", "desc.txt", "metadata.json", "metadata.opf"]
    assert json.loads((dest / "Ann Bell/One/metadata.json").read_text())["authors"] == ["Ann Bell"]
    # another book stays in b, so what is beside it stays too
    assert not (source / "a").exists() and sorted(x.name for x in (source / "b").iterdir()) == ["notes.txt", "three.m4b"]
