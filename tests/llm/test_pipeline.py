"""The pipeline's stages against brute force on the smallest tables."""

from __future__ import annotations

import collections

import pytest
from conftest import SF
from test_operators import exact_classes, words_of

import corpus_pipeline
from tomewright.llm import quality
from tomewright.session import materialize


def brute_rules(text):
    w, t = words_of(text), text or ""
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    chars, symbols = sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>")
    return (
        len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and symbols * 10 <= len(w) and 5 * len(w) <= 2 * chars <= 30 * len(w)
        and (len(lines) - len(set(lines))) * 10 <= len(lines) * 3
    )


def brute_lines(docs, least=50):
    """{doc_id: text} without later copies of runs of at least ``least`` words."""
    runs, seen, gone = {}, set(), collections.defaultdict(set)
    for d in sorted(docs):
        lines = [(k, x, len(words_of(x))) for k, x in enumerate(docs[d].split("\n")) if words_of(x)]
        found = set()
        for s in range(len(lines)):
            total = 0
            for e in range(s, len(lines)):
                total += lines[e][2]
                if total >= least:
                    found.add((s, e))
                    break
        for e in range(len(lines)):
            total = 0
            for s in range(e, -1, -1):
                total += lines[s][2]
                if total >= least:
                    found.add((s, e))
                    break
        runs[d] = (lines, sorted(found))
    for d in sorted(docs):
        lines, found = runs[d]
        for s, e in found:
            key = tuple(x for _, x, _ in lines[s : e + 1])
            if key in seen:
                gone[d] |= {k for k, _, _ in lines[s : e + 1]}
            seen.add(key)
    out = {}
    for d in docs:
        if not gone[d] or len(gone[d]) < len(runs[d][0]):
            out[d] = "\n".join(x for k, x in enumerate(docs[d].split("\n")) if k not in gone[d])
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "line_dedup", "ngram_jaccard", "best_fit_packing"]
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_classifier(spark, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality.score_documents(stages[0], model).collect()
    assert set(texts(stages[1])) == {r.doc_id for r in scored if r.score >= 0.3}


def test_rules(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert after == {d: t for d, t in before.items() if brute_rules(t)}


def test_lines(stages):
    assert texts(stages[3]) == brute_lines(texts(stages[2]))
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_near_duplicates(stages):
    before = texts(stages[3])
    ids = sorted(before)
    classes, _ = exact_classes([before[d] for d in ids])
    assert texts(stages[4]) == {ids[k]: before[ids[k]] for k in set(classes)}


def test_packing(stages):
    rows = stages[5].toPandas()
    assert set(rows.doc_id) == set(texts(stages[4]))
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 4096
