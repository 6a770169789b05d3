from __future__ import annotations

import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from tokenizers import Tokenizer

from tomewright.llm import alignment
from tomewright.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_overlaps", "groups_sha256")


def brute(texts: list[str | None]) -> list[tuple]:
    """The same by the libraries, on whole texts, token by token."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    of_a = {i: bytes(byte_of[c] for c in token) for token, i in json.load(open(A))["model"]["vocab"].items() if token != "<|endoftext|>"}
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def ends(ids, spell):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(spell(i))))
            at = out[-1][2]
        return out

    docs, counts = [], Counter()
    for text in texts:
        want = f" {text}".encode()
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        if not text or b"".join(map(of_a.get, ids_a)) != want or b"".join(map(of_b, ids_b)) != want:
            docs.append(None)
            continue
        xs, ys = ends(ids_a, of_a.get), ends(ids_b, of_b)
        by_end = {y[2]: y for y in ys}
        links = [(x[0], by_end[x[2]][0]) for x in xs if x[2] in by_end]
        cuts = sorted({x[2] for x in xs} & set(by_end))
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t[0]) for t in side if low < t[2] <= cut) for side in (xs, ys))) if len(xs) < 400 else None
            low = cut
        spelled = ";".join(groups) if groups else spell_linear(xs, ys, cuts)
        overlaps = sum(x[1] < y[2] and y[1] < x[2] for x in xs for y in ys) if len(xs) < 400 else None
        docs.append((len(xs), len(ys), len(cuts), links, overlaps, spelled))
        counts.update(links)
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [
        (0, 0, 0, 0, 0, 0, 0, "") if d is None
        else (d[0], d[1], d[2], len(d[3]), sum(counts[x] == highest[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4], hashlib.sha256(d[5].encode()).hexdigest())
        for d in docs
    ]


def spell_linear(xs, ys, cuts):
    out, i, j = [], 0, 0
    for cut in cuts:
        sides = []
        for side, at in ((xs, i), (ys, j)):
            stop = at
            while stop < len(side) and side[stop][2] <= cut:
                stop += 1
            sides.append((",".join(str(t[0]) for t in side[at:stop]), stop))
        (a, i), (b, j) = sides
        out.append(f"{a}|{b}")
    return ";".join(out)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        row = tuple(g[c] for c in COLUMNS)
        assert row == w or w[6] is None and row[:6] + row[7:] == w[:6] + w[7:], (row, w)


def test_op12_equals_the_libraries(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(QUERIES["op12_alignment"](spark, SF).collect())
    assert [r.doc_id for r in got] == [d.doc_id for d in docs]
    same(got, brute([d.text for d in docs]))


ODD = [
    "", None, " ", "  two  spaces ", "a▁b", "<s>x</s> <unk> <|endoftext|> <0x0A>", "tab\t\nline\r\n", "\x00 nul", "café café \U0001f600\U0001f468‍\U0001f469",
    " 　 ", "ﬁ Ω Ａ", "aaaa " * 50, "same words", "same words", "你好世界", "x" * 300,
]


@pytest.mark.parametrize("hot_pairs, stretch", [(alignment.HOT_PAIRS, alignment.STRETCH), (5, 16), (0, 1)])
def test_odd_texts_cold_pairs_and_short_stretches(spark, hot_pairs, stretch):
    rows = [(i if i % 5 else None, t, 7, "x") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair long, n_a string").repartition(3)
    found = alignment.align(df, A, B, hot_pairs=hot_pairs, stretch=stretch, spell=True).collect()
    want = brute(ODD)
    key = lambda r: tuple(map(str, r))
    got = sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in found if r.doc_id is not None)
    assert got == sorted((i, *w) for i, w in enumerate(want) if i % 5)
    none = sorted((tuple(r[c] for c in COLUMNS) for r in found if r.doc_id is None), key=key)
    assert none == sorted((w for i, w in enumerate(want) if not i % 5), key=key)
    for r in found:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")


def test_a_very_long_text_and_no_rows(spark):
    long = "The quick brown fox. " * 30_000 + "y" * 50_000
    df = spark.createDataFrame([(1, long), (2, "The quick")], "doc_id long, text string")
    same(sorted(alignment.align(df, A, B, stretch=1 << 16).collect()), brute([long, "The quick"]))
    assert alignment.align(df.where("doc_id > 5"), A, B).collect() == []


def test_pieces_come_from_the_library_once(monkeypatch):
    """The alignment merges no pieces itself, and its ids are the library's for odd texts too."""
    import public_tokenizers
    import pyarrow as pa

    from tomewright.llm import sentencepieces
    from tomewright.llm.alignment import Aligner

    merged = []
    agenda = sentencepieces.MergeEncoder._shared_agenda
    monkeypatch.setattr(sentencepieces.MergeEncoder, "_shared_agenda", lambda self, s, o: merged.append(len(s)) or agenda(self, s, o))
    aligner = Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a plain text", "", "two  spaces ", " ", "   ", "▁x ▁", "é\x00\n\tz", "x" * 5000, "日本 語"]
    flat, at = aligner.b.encode(pa.array(texts, pa.large_string()))
    for k, text in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == aligner.b.library.encode(text), text
    assert sum(merged) <= 2  # a lone space
