"""Quality rules as a short-circuit cascade (operator 8), with DataFrame functions only.

A rule is a predicate over metrics of the whole text that says whether a document fails.
Cost and selectivity of every rule are estimated on a bounded hashed sample of rows; rules then run
in descending order of rejection per cost, as the branches of one CASE, so a document that
a cheap rule rejects never pays for a dear one. The order can't change a verdict.
``filter_documents`` computes every rule from the text, and only where the rules before it left a document.
``measure`` returns the base metrics of every document, so there a rule that needs no more than those costs
a comparison; the others are computed only for documents that neither the base nor a rule before rejected.

Words are runs of characters other than space and U+0009..U+000D.

Defined results: a null text has no words and fails; repeated rows are judged each; an empty
table gives no rows; other columns are kept by ``filter_documents`` and ignored by ``measure``; a text
of any length is read whole, in one row's arrays (a few times its size)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.session import materialize

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which cost and selectivity are estimated: the first to be found among 1 in SAMPLE_STEP by hash.
SAMPLE_ROWS, SAMPLE_STEP = 400, 16


def text_of(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """A text's words in order. (Spark's split keeps empty strings at the ends.)"""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Words, without making an array: where a word starts."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(text, WHITE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    found = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return F.when(F.instr(text, "\n") == 0, F.lit(0)).otherwise(found).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)).cast("long")


def n_repeat_words(word_list: Column) -> Column:
    """Words in windows of three words that occur twice or more in the text.

    Windows are sorted by their hash; equal neighbours repeat. Their places, in order, cover
    three words each, less where the next one begins."""

    def keys(w: Column) -> Column:
        at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(at, lambda i: F.xxhash64(F.get(h, i), F.get(w, i + 1), F.get(w, i + 2))))

    def covered(k: Column) -> Column:
        return let(F.array_sort(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twins)

    def twins(order: Column) -> Column:
        same = F.filter(order, lambda x, k: (F.get(order, k - 1)["h"] == x["h"]) | (F.get(order, k + 1)["h"] == x["h"]))
        return _cover(F.sort_array(F.transform(same, lambda x: x["i"])))

    def judged(k: Column) -> Column:
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k))

    return let(word_list, lambda w: let(keys(w), judged)).cast("long")


def _cover(places: Column) -> Column:
    """Words under windows of three that begin at sorted ``places``."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``. An expression named inside a lambda would be
    evaluated for every element that the lambda sees."""
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass(frozen=True)
class Rule:
    """``fails`` says of the text column whether a document is rejected; ``known``, if given, says the same
    where the base metrics are columns. ``base`` rules are part of ``base_failed``."""

    name: str
    fails: Callable[[Column], Column]
    known: Callable[[Column], Column] | None = None
    base: bool = False

    def __call__(self, text: Column) -> Column:
        return self.fails(text)

    def after_metrics(self, text: Column) -> Column:
        return (self.known or self.fails)(text)


def production_rules() -> list[Rule]:
    """Rules of this engine. The first and the last are the base; the others catch markup
    debris, shouting, and texts of repeated lines, with room for clean prose."""
    words_, chars, symbols, dup = (F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines"))
    return [
        Rule("too_few_words", lambda t: n_words(t) < 50, lambda t: words_ < 50, base=True),
        Rule("symbols", lambda t: n_symbols(t) * 10 > n_words(t), lambda t: symbols * 10 > words_),
        Rule("word_length", lambda t: (word_chars(t) * 2 < n_words(t) * 5) | (word_chars(t) > n_words(t) * 15), lambda t: (chars * 2 < words_ * 5) | (chars > words_ * 15)),
        # texts without such a line don't have their lines counted
        Rule("repeated_lines", lambda t: n_dup_lines(t) * 10 > n_lines(t) * 3, lambda t: (dup > 0) & (dup * 10 > n_lines(t) * 3)),
        Rule("repeated_words", lambda t: 100 * n_repeat_words(words(t)) > 50 * n_words(t), lambda t: 100 * F.col("n_repeat_words") > 50 * words_, base=True),
    ]


def sample(docs: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A table of at most ``rows`` texts that a hash picks: no pass over all rows."""
    text = text_of(text_col)
    return materialize(docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_STEP)) == 0).limit(rows), "rule-sample")


def estimate(local: DataFrame, failures: list[tuple[Rule, Column]]) -> list[tuple[Rule, float, float]]:
    """(rule, cost in seconds, share rejected) on the rows of ``local``, for rules given with their column there."""
    total, found = max(1, local.count()), []
    base = _timed(local, F.length("text") < 0)[0]
    for rule, failed in failures:
        cost, hits = _timed(local, failed)
        found.append((rule, max(cost - base, 1e-4), hits / total))
    return found


def _timed(rows: DataFrame, failed: Column) -> tuple[float, int]:
    """The faster of two runs: seconds, and rows that fail."""
    best, hits = float("inf"), 0
    for _ in range(2):
        began = time.perf_counter()
        hits = rows.agg(F.count_if(F.coalesce(failed, F.lit(True)))).first()[0]
        best = min(best, time.perf_counter() - began)
    return best, hits


def by_gain(scored: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules in descending order of rejection per cost."""
    return [r for r, cost, share in sorted(scored, key=lambda x: (-x[2] / x[1], x[1]))]


def ordered(docs: DataFrame, rules: list[Rule] | None = None, *, text_col: str = "text") -> list[Rule]:
    """The order of rules that are computed from the text."""
    local = sample(docs, text_col)
    return by_gain(estimate(local, [(r, r(F.col("text"))) for r in rules or production_rules()]))


def first_failure(text: Column, rules: list[Rule], failed: Callable[[Rule], Column] | None = None) -> Column:
    """The name of the first rule that a text fails, or null; later rules aren't evaluated.
    ``failed`` gives a rule's column, by default that from the text."""
    case = None
    for rule in rules:
        bad = F.coalesce(failed(rule) if failed else rule(text), F.lit(True))
        case = F.when(bad, F.lit(rule.name)) if case is None else case.when(bad, F.lit(rule.name))
    return F.lit(None).cast("string") if case is None else case


def filter_documents(docs: DataFrame, rules: list[Rule] | None = None, *, text_col: str = "text") -> DataFrame:
    """The documents that pass every rule, with all their columns."""
    return docs.where(first_failure(text_of(text_col), ordered(docs, rules, text_col=text_col)).isNull())


def metrics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, which has a ``text`` without nulls, and the base metrics."""
    text = F.col("text")
    found = docs.select(
        "*",
        word_chars(text).alias("word_chars"),
        n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).alias("r"))).alias("_w"),
    )
    return found.select(*docs.columns, F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_w.r").alias("n_repeat_words"))


def measure(docs: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """Metrics and verdict of every document: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and the first rule that failed (null if none).

    The base metrics are asked of every document. Of the other rules, a document is put to each only if
    the base and the rules before left it; their order is estimated on the sample, unless ``in_order``
    says that ``rules`` have it."""
    rules, text = rules or production_rules(), F.col("text")
    base, others = [r for r in rules if r.base], [r for r in rules if not r.base]
    if not in_order:
        local = materialize(metrics(sample(docs, text_col)), "rule-metrics")
        others = by_gain(estimate(local, [(r, r.after_metrics(text)) for r in others]))
    flat = metrics(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")))
    few = F.col("n_words") < 50
    flat = flat.withColumn("base_failed", few | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    judged = flat.withColumn("failed_rule", first_failure(text, [*base, *others], lambda r: r.after_metrics(text)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), "failed_rule",
    )
