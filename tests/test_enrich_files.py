"""Enrichment from the files themselves, by clients that count what they are asked."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F
from test_audio import JPEG, PNG, id3, item, mp4, mpeg
from test_audio import frame as id3_frame
from test_catalog import epub, put

from tomewright.operators import enrich, local, schema
from tomewright.plans import scan
from tomewright.sources import clients

PRODUCTS = json.dumps({"products": [{"asin": "B012345678", "title": "The Trial", "authors": [{"name": "Franz Kafka"}], "narrators": [{"name": "Rob Inn"}], "runtime_length_min": 62}]})
DETAIL = json.dumps({"title": "The Trial", "seriesPrimary": {"name": "Classics", "position": "4"}, "genres": [{"name": "Novel", "type": "genre"}], "narrators": [{"name": "Rob Inn"}], "isbn": "9780306406157"})


def counting(answers, path):
    """A client that writes down every question (a class of its own, which executors get by value)."""

    class Counting:
        def get(self, kind, query):
            with open(path, "a") as fh:
                fh.write(f"{kind} {query}\n")
            return answers.get((kind, query), "")

    return Counting()


def library(root):
    tags = item("©alb", b"The Trial") + item("aART", b"Franz Kafka") + item("©nrt", b"Rob Inn") + item("©day", b"1925") + item("covr", JPEG, 13)
    put(root, {"lib/Franz Kafka/The Trial/a.m4b": "", "lib/Franz Kafka/The Trial/desc.txt": "About K.", "lib/Franz Kafka/The Trial/reader.txt": "Rob Inn\nmore", "lib/Ann Bell/Parts/1.mp3": "", "lib/Ann Bell/Parts/2.mp3": "", "lib/Jane Austen/Emma.epub": "", "lib/Jane Austen/Void.epub": ""})
    (root / "lib/Franz Kafka/The Trial/a.m4b").write_bytes(mp4(tags))
    (root / "lib/Franz Kafka/The Trial/cover.png").write_bytes(PNG)
    (root / "lib/Ann Bell/Parts/1.mp3").write_bytes(id3(4, [id3_frame(4, "TALB", b"\0Parts"), id3_frame(4, "TPE1", b"\0Ann Bell"), id3_frame(4, "TCOM", b"\0Ann Bell")]) + mpeg(2000))
    (root / "lib/Ann Bell/Parts/cover.jpg").write_bytes(JPEG)
    (root / "lib/Jane Austen/Emma.epub").write_bytes(epub(root / "x.epub"))


def test_books_are_enriched_from_their_files(spark, tmp_path):
    library(tmp_path)
    books = scan.scan(spark, str(tmp_path / "lib"))
    by_name = json.dumps({"title": "The Trial", "author": "Franz Kafka"}, separators=(",", ":"))
    detail = json.dumps({"asin": "B012345678"}, separators=(",", ":"))
    log = tmp_path / "asked"
    client = counting({("audible", by_name): PRODUCTS, ("audnexus", detail): DETAIL}, str(log))
    cache = spark.createDataFrame([], schema.CACHE)
    done, after, counters = enrich.enrich_files(books, str(tmp_path / "lib"), cache, client, covers=str(tmp_path / "covers"))
    rows = {r.title: r for r in done.collect()}
    trial, parts = rows["The Trial"], rows["Parts"]
    assert (trial.duration, trial.bitrate, trial.codec, trial.chapters, trial.health) == (3725.0, 64000, "mp4a.40.2", 3, "")
    assert (trial.narrator, trial.year, trial.description, trial.series, trial.series_index, trial.isbn, trial.online_best.source) == ("Rob Inn", "1925", "About K.", "Classics", "4", "9780306406157", "Audible+Audnexus")
    assert trial.match_bonus > 20 and trial.confidence > 70 and trial.enriched
    assert abs(parts.duration - 52.1) < 0.2 and parts.health == "2.mp3 is empty (0 bytes)" and parts.narrator in ("", None)
    assert rows["Void"].health == "Void.epub is empty (0 bytes)"
    # the jpeg is within one book and beside another: one file, a candidate of both
    assert sorted(os.path.splitext(x)[1] for x in os.listdir(tmp_path / "covers")) == [".jpg", ".png"]
    assert {c.origin for c in trial.cover_candidates} == {"folder: cover.png", "embedded"} and parts.cover_info == "500x600 folder: cover.jpg"
    assert parts.cover in {c.path for c in trial.cover_candidates}
    assert counters["books"] == len(rows) and counters["matched"] == counters["matched_audible"] == 1 and counters["damaged"] == 2 and counters["with_cover"] == 2 and counters["matched_google"] == 0
    # everything was asked once, however often the result is read
    done.count()
    after.count()
    asked = log.read_text().splitlines()
    assert len(asked) == len(set(asked)) and f"audnexus {detail}" in asked
    again, _, _ = enrich.enrich_files(books, str(tmp_path / "lib"), after, client)
    assert again.count() == len(rows) and log.read_text().splitlines() == asked


def test_intros_votes_and_front_text(spark, tmp_path):
    library(tmp_path)
    root = str(tmp_path / "lib")
    books = scan.scan(spark, root).where("title = 'Parts' OR title = 'Emma'").withColumn("author", F.when(F.col("title") == "Parts", "").otherwise(F.col("author")))
    spoken = books.where("title = 'Parts'").select("id", F.lit("This is Audible. Parts of Me, written by Anna Bellow, narrated by Sue Ray.").alias("transcript"))
    done, _, counters = enrich.enrich_files(books, root, spark.createDataFrame([], schema.CACHE), clients.Canned({}), spoken=spoken)
    rows = {r.kind: r for r in done.collect()}
    assert rows["audio"].meta_source == "spoken intro" and rows["audio"].author == "Anna Bellow" and counters["heard"] == 1
    votes = {r.id: r for r in local.read_books(books, root).collect()}[rows["audio"].id]
    assert {(v.title, v.author) for v in votes.votes} >= {("Parts", "Ann Bell")} and votes.covers == []


def test_side_files_in_order(tmp_path):
    put(tmp_path, {"metadata.json": json.dumps({"narrators": ["J"], "publishedYear": 1999}), "desc.txt": "D", "reader.txt": "R", "x.opf": '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:description>O &lt;b&gt;x&lt;/b&gt;</dc:description></package>'})
    assert local.side_extras(str(tmp_path), os.listdir(tmp_path)) == {"narrator": "J", "year": "1999", "description": "O  x"}
    os.remove(tmp_path / "metadata.json")
    os.remove(tmp_path / "x.opf")
    assert local.side_extras(str(tmp_path), os.listdir(tmp_path)) == {"narrator": "R", "description": "D"}
