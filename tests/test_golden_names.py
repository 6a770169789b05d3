"""Golden names: what a scan makes of folders and loose files, and which loose files are one book."""

from __future__ import annotations

import pytest

from tomewright.functions import names, stems
from tomewright.plans import scan

#: (path below the library, title, author or None for any, whether the path is a loose file)
NAMES = [
    ("2018 - Blue Collar Space (multi) 128k {465mb}", "Blue Collar Space", None, False),
    ("[bitsearch.to] Dean Koontz - Watchers", "Watchers", "Dean Koontz", False),
    ("The Martian Full Audiobook Unabridged", "The Martian", None, False),
    ("audiobook_The_Great_Gatsby_full", "The Great Gatsby", None, False),
    ("Brandon Sanderson - Mistborn 01 - The Final Empire [MP3]", "The Final Empire", "Brandon Sanderson", False),
    ("Gateway MP3", "Gateway", None, False),
    ("Foundation AAC 256k", "Foundation", None, False),
    ("The Hobbit 320kbps", "The Hobbit", None, False),
    ("The Three-Body Problem 128k mono vbr", "The Three-Body Problem", None, False),
    ("Death's End {465mb} 128k stereo lame", "Death's End", None, False),
    ("[MAM] Dean Koontz - Watchers (2021)", "Watchers", "Dean Koontz", False),
    ("Stephen King - 11.22.63", "11.22.63", "Stephen King", False),
    ("1984", "1984", None, True),
    ("George Orwell/1984", "1984", "George Orwell", False),
    ("George Orwell - 1984", "1984", "George Orwell", False),
    ("Joseph Heller - Catch-22", "Catch-22", "Joseph Heller", False),
    ("Stephen King - It", "It", "Stephen King", False),
    ("A Space Odyssey by Arthur C. Clarke", "A Space Odyssey", "Arthur C. Clarke", False),
    ("Leaving Las Vegas by John O'Brien", "Leaving Las Vegas", "John O'Brien", False),
    ("LAST RITES by Ozzy Osbourne (Audiobook)(Nonfiction)", "Last Rites", "Ozzy Osbourne", False),
    ("Some Book by Jane Doe (Unabridged)", "Some Book", "Jane Doe", False),
    ("THE MARTIAN by andy weir", "The Martian", "Andy Weir", True),
    ("Stephen King/The Shining (123)", "The Shining", "Stephen King", False),
    ("Peter F. Hamilton (123)/Pandora's Star", "Pandora's Star", "Peter F. Hamilton", False),
    ("Stephen King Collection - The Shining", "The Shining", "Stephen King", False),
    ("Brandon Sanderson Anthology - Mistborn", "Mistborn", "Brandon Sanderson", False),
    ("Isaac Asimov Complete Works/Foundation", "Foundation", "Isaac Asimov", False),
    *[(f"{x}/Some Real Title", "Some Real Title", "", False) for x in ("Unknown", "Various", "Unknown Author", "Various Authors", "watch", "downloads", "incoming", "import", "new", "tmp", "metadata")],
]


def test_scanned_names(spark, tmp_path):
    for rel, _, _, loose in NAMES:
        path = tmp_path / (f"{rel}.m4b" if loose else f"{rel}/audio.m4b")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 20)
    found = {r.files[0]: r for r in scan.scan(spark, str(tmp_path)).collect()}
    got = {rel: found[f"{rel}.m4b" if loose else f"{rel}/audio.m4b"] for rel, _, _, loose in NAMES}
    wrong = [(rel, got[rel].title, got[rel].author) for rel, title, author, _ in NAMES if got[rel].title.lower() != title.lower() or author is not None and got[rel].author != author]
    assert wrong == []


@pytest.mark.parametrize(("raw", "want"), [
    ("Weir, Andy", "Andy Weir"), ("Le Guin, Ursula K.", "Ursula K. Le Guin"), ("Neil Gaiman & Terry Pratchett", "Neil Gaiman"), ("Larry Niven and Jerry Pournelle", "Larry Niven"),
    ("Smith, John, Jr.", "John Smith Jr."), ("Freida McFadden", "Freida McFadden"), ("Mary O'Brien", "Mary O'Brien"),
])
def test_author_clean_up(raw, want):
    assert names.clean_author(raw) == want


@pytest.mark.parametrize(("files", "want"), [
    (["Andy Weir - Project Hail Mary (Unabridged) 32k.mp3", "Dennis E Taylor - For We Are Many.m4b"], 2),
    (["Andy Weir - The Martian.mp3", "Blake Crouch - Dark Matter.mp3"], 2),
    (["Dawn Girl - 01 - Opening Credits.mp3", "Dawn Girl - 02 - Chapter 1.mp3", "Bonus.mp3"], 1),
    (["Title - Part 1.mp3", "Title - Part 2.mp3", "Author - Title.mp3"], 1),
    (["Book 64k - 01.mp3", "Book 64k - 02.mp3"], 1),
    (["Intro.mp3", "Chapter One.mp3"], 1),
])
def test_loose_files(files, want):
    groups = stems.group_files([f"/x/{f}" for f in files], False)
    assert len(groups) == want and sorted(f for _, g in groups for f in g) == sorted(f"/x/{f}" for f in files)


@pytest.mark.parametrize(("stem", "want"), [
    ("LNSR01-95 Larry Niven - Saturn's Race", "Larry Niven - Saturn's Race"), ("01 - Dune", "Dune"), ("Dune Part 3", "Dune"), ("track07", "track"), ("Dune (3 of 12)", "Dune"),
    ("Dune 3 of 12", "Dune"), ("Fahrenheit 451", "Fahrenheit 451"), ("1984", "1984"), ("1-95 Dune", "Dune"), ("07", ""),
])
def test_part_numbers(stem, want):
    assert stems.strip_part_numbers(stem) == want and stems.file_group_key(f"{stem}.mp3") == want.lower()
