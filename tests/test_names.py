"""Golden cases of the name functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tomewright.functions import columns as C
from tomewright.functions import names, stems, udfs


@pytest.mark.parametrize(("raw", "want"), [
    ("Sanderson, Brandon", "Brandon Sanderson"), ("Le Guin, Ursula K.", "Ursula K. Le Guin"), ("Neil Gaiman & Terry Pratchett", "Neil Gaiman"),
    ("Smith, John, Jr.", "John Smith Jr."), ("Stephen King (4567)", "Stephen King"), ("Stephen King Collection", "Stephen King"), ("A; B", "A"), ("", ""), ("Homer", "Homer"),
])
def test_clean_author(raw, want):
    assert names.clean_author(raw) == want
    assert names.clean_author(want) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("[MAM] Dean Koontz - Watchers", "Dean Koontz - Watchers"), ("Death's End {465mb} 128k stereo lame", "Death's End"),
    ("audiobook_The_Great_Gatsby_full", "The Great Gatsby"), ("11.22.63", "11.22.63"), ("1984", "1984"), ("Stereo Hearts", "Stereo Hearts"), ("mp3", "mp3"),
])
def test_release_junk(raw, want):
    assert names.strip_release_junk(raw) == want


@pytest.mark.parametrize(("args", "want"), [
    (("Belinda (read by Ray Bouche)",), ("Belinda", "Ray Bouche")), (("Star Force Universe (Jyr)", "Aer-ki Jyr"), ("Star Force Universe", "")),
    (("Dune (Unabridged) [2019]",), ("Dune", "")), (("Box Set (5-8)",), ("Box Set (5-8)", "")), (("Dawn Girl_ A Thriller",), ("Dawn Girl: A Thriller", "")), (("MR 23 Memorial Day",), ("Memorial Day", "")),
])
def test_clean_text(args, want):
    assert names.clean_text(*args) == want


@pytest.mark.parametrize(("name", "want"), [
    ("Larry Niven-Saturns Race", {"author": "Larry Niven", "title": "Saturns Race"}), ("THE MARTIAN by andy weir", {"title": "THE MARTIAN", "author": "Andy Weir"}),
    ("Death by chocolate", {"title": "Death by chocolate"}), ("Jack Ryan 12 - Teeth of the Tiger", {"series": "Jack Ryan", "series_index": "12", "title": "Teeth of the Tiger"}),
    ("[Dune 2] Messiah", {"series": "Dune", "series_index": "2", "title": "Messiah"}), ("Frank Herbert - Dune - 02 Messiah.mp3", {"author": "Frank Herbert", "series": "Dune", "series_index": "02", "title": "Messiah"}),
    ("A - T - S, Book 3", {"author": "A", "title": "T", "series": "S", "series_index": "3"}),
])
def test_parse_name(name, want):
    assert names.parse_name(name) == want


def test_discs_and_groups():
    assert stems.split_disc_marker("The Martian - Disc 2") == ("The Martian", 2)
    assert stems.split_disc_marker("Part IV") == ("", 4)
    assert stems.split_disc_marker("Fahrenheit 451") == ("Fahrenheit 451", None)
    assert [stems.disc_child_number(x) for x in ("03", "D01", "(6of17)", "Part VII", "1_ Part I - The World", "Home")] == [3, 1, 6, 7, 1, None]
    assert stems.prefix_key("Lee Child - Reacher 27 - Personal 12") == "lee child - reacher 27 - personal"
    assert stems.prefix_key("Opening Credits") is None
    grouped = stems.group_files(["d/Dawn Girl - 01.mp3", "d/Dawn Girl - 02.mp3", "d/Bonus.mp3", "d/Other.m4b"], False)
    assert grouped == [("Dawn Girl", ["d/Dawn Girl - 01.mp3", "d/Dawn Girl - 02.mp3", "d/Bonus.mp3"]), ("Other", ["d/Other.m4b"])]
    assert stems.group_hint(["028 - Prodigal_Son.mp3", "029 - Prodigal_Son.mp3"]) == "Prodigal Son"


def test_paths():
    assert names.infer_from_path("Brandon Sanderson/Mistborn Saga/01 - The Final Empire") == {"author": "Brandon Sanderson", "series": "Mistborn", "series_index": "01", "title": "The Final Empire"}
    assert names.infer_from_path("New folder (3)/x") == {}
    assert names.looks_like_author("J.R.R. Tolkien") and not names.looks_like_author("dupes")


def test_keys():
    assert names.author_key("J. R. R. Tolkien") == names.author_key("Tolkien, J.R.R.") == "jrr tolkien"
    assert names.author_key("Émile Zola") == "emile zola"


def test_columns_agree_with_functions(spark):
    cases = ["New folder (3)", "Unsorted", "Brandon Sanderson", "Le Guin, Ursula K.", "dupes", "A", "Larry Niven-Saturns Race", "Stephen King Collection", "The Martian (123)", "M-Z", ""]
    df = spark.createDataFrame([(c,) for c in cases], "s string").coalesce(1)
    rows = df.select("s", C.is_junk_folder("s").alias("junk"), C.looks_like_author("s").alias("author"), udfs.author_key("s").alias("key")).collect()
    assert [(r.junk, r.author, r.key) for r in rows] == [(names.is_junk_folder(c), names.looks_like_author(c), names.author_key(c)) for c in cases]


def test_small_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(C.series_index(F.lit(x))) for x in ("1", "1.5", "5-8", "", "12", "inf")] == ["01", "01.5", "5-8", "", "12", "inf"]
    assert [one(C.unshout(F.lit(x))) for x in ("THE LORD OF THE RINGS", "dune", "iPod Days")] == ["The Lord of the Rings", "Dune", "iPod Days"]
    assert one(C.sanitize(F.lit('A: B? <"x">..'))) == "A - B- --x--"
    assert one(C.find_isbn(F.lit("x 9780306406158 and 978-0-306-40615-7."))) == "9780306406157"
    assert one(C.valid_isbn(F.lit("080442957X"))) == "080442957X"
    assert [one(C.duration(F.lit(x))) for x in (3720.0, 300.0, 0.0)] == ["1h 02m", "5m", ""]
    assert one(C.numbers(C.norm_title(F.lit("Book Two of 007")))) == ["2", "7"]
    assert one(C.parse_intro(F.lit("Audible presents The Martian by Andy Weir, narrated by R.C. Bray."))).author == "Andy Weir"
    assert one(C.answer_json(F.lit('```json\n{"title": "T", "author": "A", "confidence": 91}\n```'))).confidence == 91
    assert one(C.html_to_text(F.lit("<p>a<script>x</script>&amp; b</p>"))) == "a & b"
