"""Connectors to services, behind an interface that is passed in: nothing here opens a connection by itself.

A client is any object with ``get(kind, query) -> str`` (a JSON text, '' if nothing is found) that can be sent to
executors. Answers are cached by a digest of their question, so only misses are asked."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.operators.decisions import fresh, upsert
from tomewright.session import materialize


class Client(Protocol):
    def get(self, kind: str, query: str) -> str: ...


class Canned:
    """A client of fixed answers, for tests and machines without a network."""

    def __init__(self, answers: Mapping[tuple[str, str], str]) -> None:
        self.answers = dict(answers)

    def get(self, kind: str, query: str) -> str:
        return self.answers.get((kind, query), "")


def question(kind: str, *parts: str) -> str:
    """The cache's key of a question."""
    return f"{kind}:" + hashlib.sha1(json.dumps([p or "" for p in parts]).encode()).hexdigest()


def ask(questions: DataFrame, cache: DataFrame, client: Client, *, days: int, at_once: int = 6) -> tuple[DataFrame, DataFrame]:
    """(answers, cache) for (key, kind, query): from the cache where it is fresh, else from the client,
    by at most ``at_once`` tasks at a time."""
    known = fresh(cache, F.current_timestamp(), days)
    missing = questions.dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")

    def run(batches):
        for rows in batches:
            yield pd.DataFrame({"key": rows.key, "value": [client.get(k, q) for k, q in zip(rows.kind, rows["query"], strict=True)]})

    # written before they are used: whoever reads the answers again must not ask again
    asked = missing.select("key", "kind", "query").coalesce(at_once).mapInPandas(run, "key string, value string")
    found = materialize(asked.withColumn("ts", F.current_timestamp()), "answers")
    after = upsert(cache, found, ["key"])
    return questions.join(known.select("key", "value").unionByName(found.select("key", "value")), "key", "left"), after


def evidence(books: DataFrame) -> DataFrame:
    """(id, evidence): what a model is told of a book, as JSON."""
    files = F.transform("files", lambda f: F.substring_index(f, "/", -1))
    more = F.when(F.size(files) > 12, F.array(F.concat(F.lit("... +"), (F.size(files) - 12).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    guess = F.struct("title", "author", "series", "series_index", "narrator", F.col("meta_source").alias("chosen_from"))
    kept = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return books.select("id", F.to_json(F.struct(
        F.when(F.col("kind") == "audio", "audiobook").otherwise("ebook").alias("kind"), F.col("src_display").alias("folder_path"), F.size("files").alias("file_count"),
        F.concat(F.slice(files, 1, 12), more).alias("file_names"), guess.alias("current_guess"), kept("isbn"), kept("asin"), kept("year"), kept("publisher"),
        F.when(F.col("duration") > 0, F.format_string("%.2f hours", F.col("duration") / 3600)).alias("probed_duration"),
        F.when(F.size("flags") > 0, F.col("flags")).alias("warnings"), F.nullif(F.substring("transcript", 1, 1200), F.lit("")).alias("spoken_intro_transcript"),
    )).alias("evidence"))
