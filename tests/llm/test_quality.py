"""The classifier written again in plain loops: features word by word, gradient steps number by number."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from tomewright.llm import quality

M64 = (1 << 64) - 1


def bucket(h: int) -> int:
    h = ((h ^ (h >> 31)) * 0x9E3779B97F4A7C15) & M64
    return (h >> 33) % (quality.BUCKETS - 1)


def features(text: str) -> Counter:
    """Buckets of the words, their pairs, and the runs of 3 to 5 characters of each word between marks."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    name = lambda w: int(pd.util.hash_array(np.array([w], dtype=object), categorize=False)[0])
    out: Counter = Counter()
    for i, w in enumerate(words):
        out[bucket(name(w))] += 1
        marked = f"<{w}>"
        for n in (3, 4, 5):
            for at in range(len(marked) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 1_000_003 + ord(marked[at + k]) + k + 1) & M64
                out[bucket(h)] += 1
        if i:
            out[quality.SAME if w == words[i - 1] else bucket((name(words[i - 1]) * 0xC2B2AE3D27D4EB4F + name(w)) & M64)] += 1
    return out


def shares(text: str) -> dict[int, float]:
    found = features(text)
    return {b: n / sum(found.values()) for b, n in found.items()}


def plain_fit(texts, labels, prior, epochs=quality.EPOCHS, rate=quality.RATE, seed=5):
    rng = np.random.default_rng(seed)
    start = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float32)
    rows = [shares(t) for t in texts]
    vectors = {b: [float(x) for x in start[b]] for r in rows for b in r}
    dims = range(quality.DIM)
    out, bias = [[0.0, 0.0] for _ in dims], [0.0, 0.0]
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            row = rows[k]
            if not row:
                continue
            pace = 1 - step / steps
            step += 1
            hidden = [sum(s * vectors[b][d] for b, s in row.items()) for d in dims]
            z = [sum(hidden[d] * out[d][c] for d in dims) + bias[c] for c in (0, 1)]
            top = max(z)
            e = [math.exp(x - top) for x in z]
            p = [x / sum(e) for x in e]
            p[labels[k]] -= 1
            back = [sum(out[d][c] * p[c] for c in (0, 1)) for d in dims]
            for c in (0, 1):
                for d in dims:
                    out[d][c] -= 0.5 * pace * hidden[d] * p[c]
                bias[c] -= 0.05 * pace * p[c]
            for b, s in row.items():
                own = rate * pace * min(s * len(row), 4.0) / math.sqrt(len(row))
                vectors[b] = [v - own * g for v, g in zip(vectors[b], back)]
    sampled = sum(labels) / len(labels)
    shift = math.log(prior / (1 - prior)) - math.log(sampled / (1 - sampled))

    def score(text: str) -> float:
        value = bias[1] - bias[0] + shift
        for b, s in shares(text).items():
            v = vectors.get(b) or [float(x) for x in start[b]]
            value += s * sum(v[d] * (out[d][1] - out[d][0]) for d in dims)
        return 1 / (1 + math.exp(-value))

    return score


ODD = ["", "  \n\t ", "a", "same same same", "café \U0001f600 naïve", "x" * 300, "a\x00b c", "end \n"]


def test_op7_features_equal_plain_loops():
    texts = [*ODD, "the cat sat on the the mat"]
    for text, (idx, share) in zip(texts, quality.Features.of(pa.array(texts, pa.large_string())).rows(), strict=True):
        want = shares(text)
        assert idx.tolist() == sorted(want)
        assert np.allclose(share, [want[b] for b in sorted(want)], rtol=1e-6)


def test_op7_training_equals_plain_loops():
    rng = random.Random(1)
    good, bad = ["river", "stone", "garden", "letter", "winter"], ["buy$$", "click", "now!!", "free", "win###"]
    made = [(" ".join(rng.choices(good if y else bad, k=rng.randint(4, 9)) + rng.choices(["the", "of", "and"], k=3)), y) for y in (0, 1) for _ in range(12)]
    rng.shuffle(made)
    texts, labels = [t for t, _ in made], [y for _, y in made]
    model, plain = quality.fit(texts, labels, 0.7), plain_fit(texts, labels, 0.7)
    new = [*texts, *ODD, "a river of stone", "free free win now", "letter $$$ buy"]
    got = model.score(pa.array(new, pa.large_string()))
    assert np.allclose(got, [plain(t) for t in new], atol=2e-3)
    assert all((s >= 0.5) == bool(y) for s, y in zip(got, labels)) and got[new.index("a river of stone")] > got[new.index("free free win now")]


def test_op7_a_very_long_text_is_scored_whole():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.standard_normal(quality.BUCKETS).astype(np.float32), 0.1)
    long = "alpha beta " * 40_000 + "gamma"
    found = scaled(40_000)
    mean = sum(n * float(model.weight[b]) for b, n in found.items()) / sum(found.values())
    assert abs(float(model.score(pa.array([long], pa.large_string()))[0]) - 1 / (1 + math.exp(-mean - 0.1))) < 1e-6


def scaled(times: int) -> Counter:
    """The features of so many repeats of two words, and another word at the end, by counting."""
    one, two = features("alpha beta " * 2 + "gamma"), features("alpha beta " * 3 + "gamma")
    more = two - one
    return one + Counter({b: n * (times - 2) for b, n in more.items()})
