"""The functions of ``names`` as vectorised (Arrow) UDFs."""

from __future__ import annotations

import html

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.functions import names, stems


def strings(*fields: str) -> T.StructType:
    """A struct of strings. (Type objects, unlike DDL, can be made before there is a session.)"""
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


_FIELDS = ("title", "author", "series", "series_index")
META = strings(*_FIELDS)


def _structs(found) -> pd.DataFrame:
    return pd.DataFrame([{k: m.get(k, "") for k in _FIELDS} for m in found], columns=list(_FIELDS))


def _plain(function, kind: T.DataType):
    """A UDF of one string that works on each distinct value of a batch once."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        values = s.fillna("")
        return values.map({v: function(v) for v in values.unique()})

    return run


def _pair(function, kind: T.DataType = T.DoubleType()):  # noqa: B008
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])

    return run


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Every entity of HTML resolved; texts without one aren't touched."""
    return s.where(~s.str.contains("&", regex=False, na=False), s.map(html.unescape, na_action="ignore"))


def _most_alike(values: pd.Index, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What ``similar`` of each pair is at most: by the letters that the strings have in common, in any order."""
    counts = np.zeros((len(values), 64), np.int32)
    for i, v in enumerate(values):
        letters = np.frombuffer(v.lower().encode("utf-32-le"), "<u4") % 64
        counts[i] = np.bincount(letters, minlength=64)
    sizes = counts.sum(1)
    total = sizes[left] + sizes[right]
    return np.where(total > 0, 2 * np.minimum(counts[left], counts[right]).sum(1) / np.maximum(total, 1), 1.0)


def similar_from(least: float):
    """A UDF as ``similar``, but 0 for pairs that can't reach ``least``, which aren't compared."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        codes, values = pd.factorize(pd.concat([a.fillna(""), b.fillna("")], ignore_index=True))
        pairs, back = np.unique(codes[: len(a)].astype(np.int64) * len(values) + codes[len(a) :], return_inverse=True)
        left, right = pairs // max(len(values), 1), pairs % max(len(values), 1)
        found = (left == right).astype(float)
        for i in np.flatnonzero((left != right) & (_most_alike(values, left, right) >= least - 1e-9)).tolist():
            found[i] = names.similar(values[left[i]], values[right[i]])
        found = found[back]
        return pd.Series(found)

    return run


def _pairs_of(text: str) -> list[tuple[str, int]]:
    """The pairs of neighbouring letters of a text between marks, each with how often it came before."""
    marked, seen, out = f"\x02{text.lower()}\x03", {}, []
    for i in range(len(marked) - 1):
        pair = marked[i : i + 2]
        out.append((pair, seen.get(pair, 0)))
        seen[pair] = out[-1][1] + 1
    return out


def _fewest_shared(length: int, threshold: float) -> int:
    """How many pairs of letters a text shares at least with any text that it is alike to from ``threshold`` on.

    Let texts of lengths n and m be alike: they have s >= threshold * (n + m) / 2 matching letters, and d = n + m - 2s others.
    The matching blocks, marks included, are at most d + 1, since an unmatched letter stands between two of them; they hold s + 2
    letters, and so s + 2 - (d + 1) pairs of neighbours, which both texts have."""
    least = None
    for other in range(int(np.ceil(length * threshold / (2 - threshold) - 1e-9)), int((2 - threshold) * length / threshold + 1e-9) + 1):
        matched = int(np.ceil(threshold * (length + other) / 2 - 1e-9))
        if matched <= min(length, other):
            shared = matched - (length + other - 2 * matched) + 1
            least = shared if least is None else min(least, shared)
    return length + 1 if least is None else least


@F.pandas_udf(T.ArrayType(T.StringType()))
def letter_pairs(s: pd.Series) -> pd.Series:
    """The different pairs of neighbouring letters of a text, its ends marked."""
    return s.fillna("").map(lambda x: sorted({pair for pair, _ in _pairs_of(x)}))


def rare_pairs(threshold: float, common: dict[str, int]):
    """A UDF of the keys under which a text meets all texts that it is alike to (``similar``) from ``threshold`` on.

    Two texts that share k of their counted pairs, put in one order, share one of the first n - k + 1 of either's n.
    The order is rarest first (by ``common``), so those keys are few and rare. Where a text need not share a
    pair (thresholds of two thirds and below), all have one key."""
    bounds: dict[int, int] = {}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        def keys(text: str) -> list[str]:
            pairs = _pairs_of(text)
            shared = bounds.setdefault(len(text), _fewest_shared(len(text), threshold)) if threshold > 2 / 3 else 0
            if shared < 1:
                return [""]
            pairs.sort(key=lambda p: (common.get(p[0], 0), p))
            return [f"{pair}{n}" for pair, n in pairs[: max(0, len(pairs) - shared + 1)]]

        return s.fillna("").map(keys)

    return run


similar = _pair(names.similar)
ratio = _pair(names.ratio)
token_sort = _pair(names.token_sort)
ascii_fold = _plain(names.ascii_fold, T.StringType())
author_key = _plain(names.author_key, T.StringType())
clean_author = _plain(names.clean_author, T.StringType())
strip_release_junk = _plain(names.strip_release_junk, T.StringType())
disc_child_number = _plain(stems.disc_child_number, T.IntegerType())
prefix_key = _plain(stems.prefix_key, T.StringType())
file_group_key = _plain(stems.file_group_key, T.StringType())


@F.pandas_udf(META)
def parse_name(s: pd.Series) -> pd.DataFrame:
    return _structs(names.parse_name(x) for x in s.fillna(""))


@F.pandas_udf(META)
def infer_from_path(s: pd.Series) -> pd.DataFrame:
    return _structs(names.infer_from_path(x) for x in s.fillna(""))


@F.pandas_udf(T.StructType([T.StructField("base", T.StringType()), T.StructField("disc", T.IntegerType())]))
def split_disc_marker(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([stems.split_disc_marker(x) for x in s.fillna("")], columns=["base", "disc"]).astype({"disc": "Int32"})


@F.pandas_udf(strings("text", "narrator"))
def clean_text(text: pd.Series, author: pd.Series, series: pd.Series) -> pd.DataFrame:
    rows = zip(text.fillna(""), author.fillna(""), series.fillna(""), strict=True)
    return pd.DataFrame([names.clean_text(*r) for r in rows], columns=["text", "narrator"])


def norm_title_of(title: Column) -> Column:
    """``columns.norm_title`` behind the accent folding that the JVM lacks."""
    from tomewright.functions import columns

    return columns.norm_title(ascii_fold(title))
