"""All of the preparation in one go: scan, enrichment, safe author merges, the model's answers, duplicates. Nothing is copied.

Each stage's result is a table whose name is a digest of all that went into it: the tree's listing, the options, and the stages
before. A run that was interrupted finds the tables that are complete and goes on behind them; where files or options have
changed, the names have too, and the stages are done again."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions import columns as C
from tomewright.functions import fixed
from tomewright.operators import authors, dedupe, enrich, resolve, schema
from tomewright.plans import scan
from tomewright.session import materialize
from tomewright.sources import clients, tree


#: What a model's answer may hold.
ANSWER = "title string, author string, series string, series_index string, narrator string, confidence int"


class Stopped(RuntimeError):
    """A stop was asked for; what is done is kept."""


@dataclass(frozen=True)
class Options:
    threshold: int = 70
    fix_names: bool = True
    ask_model: bool = True
    resolve_duplicates: bool = True
    similar: int = 90


class Stages:
    """Tables in a folder, named by what they are made of."""

    def __init__(self, spark: SparkSession, folder: str, origin: str) -> None:
        self.spark, self.folder, self.digest, self.done = spark, folder, origin, []

    def _complete(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def table(self, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The frames that ``make`` returns, written, or as an earlier run has written them. Spark marks a table that is
        complete; one without the mark is made again."""
        if os.path.exists(os.path.join(self.folder.removeprefix("file://"), "STOP")):
            raise Stopped(f"stopped before {name}")
        self.digest = hashlib.sha1(f"{self.digest}|{name}".encode()).hexdigest()
        made = f"{self.folder}/{name}-{self.digest[:20]}"
        listing = f"{made}/parts"
        if not self._complete(listing):
            frames = make()
            for part, frame in frames.items():
                frame.write.mode("overwrite").parquet(f"{made}/{part}")
            # the last to be written: the stage is complete when its list of parts is
            self.spark.createDataFrame([(p,) for p in frames], "part string").write.mode("overwrite").parquet(listing)
            self.done.append(name)
        return {r.part: self.spark.read.parquet(f"{made}/{r.part}") for r in self.spark.read.parquet(listing).collect()}


def merge_safe_authors(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, aliases): the spellings of every group that is sure become the one to keep."""
    found = authors.cluster(authors.counts(books)).where("confidence = 'high'")
    to = materialize(found.select(F.explode("variants.name").alias("_name"), F.col("canonical").alias("_to")), "safe-merges")
    live = ~F.col("status").isin("copied", "moved")
    rows = books.join(to, books.author == to["_name"], "left").withColumn("author", F.when(live & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("author")))
    aliases = to.select(authors.udfs.author_key("_name").alias("variant_key"), F.col("_to").alias("canonical"), F.current_timestamp().alias("ts")).distinct()
    return rows.withColumn("confidence", resolve.book_confidence()).select(*books.columns), aliases


def ask_model(books: DataFrame, cache: DataFrame, client: clients.Client, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(books, cache) after a model was told what is known of every book that isn't sure enough."""
    unsure = books.where(~F.col("status").isin(*fixed.DONE_STATUSES) & (F.coalesce("confidence", F.lit(0)) < threshold))
    told = clients.evidence(unsure).withColumn("key", F.concat(F.lit("model:"), F.sha1("evidence")))
    answers, after = clients.ask(told.select("key", F.lit("model").alias("kind"), F.col("evidence").alias("query")).distinct(), cache, client, days=365)
    said = told.join(answers.where(C.text("value") != "").select("key", "value"), "key").select("id", C.answer_json("value", ANSWER).alias("a"))
    return resolve.apply_answers(books, said.where("a IS NOT NULL").select("id", "a.*")), after


def autopilot(spark: SparkSession, root: str, folder: str, client: clients.Client, options: Options = Options(), covers: str | None = None) -> tuple[DataFrame, list[str]]:  # noqa: B008
    """(books, stages that this run has done). ``folder`` is where the tables are kept; it must be shared, as the root must."""
    files = tree.list_tree(spark, root)
    seen = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rel_path", "size", "mtime")).alias("x")).first()
    stages = Stages(spark, folder, json.dumps([root, seen.n, seen.x, asdict(options), covers]))
    known = f"{folder}/ledger"
    last = spark.read.parquet(known) if stages._complete(known) else None

    def scanned() -> dict[str, DataFrame]:
        books, ledger = scan.scan_again(spark, root, last)
        return {"books": books, "ledger": ledger}

    first = stages.table("scanned", scanned)
    if "scanned" in stages.done:  # for the next scan; without it that reads all files again, no more
        first["ledger"].write.mode("overwrite").parquet(known)

    def enriched() -> dict[str, DataFrame]:
        books, cache, _ = enrich.enrich_files(first["books"], root, spark.createDataFrame([], schema.CACHE), client, covers=covers, fix_names=options.fix_names)
        return {"books": books, "cache": cache}

    second = stages.table("enriched", enriched)

    def merged() -> dict[str, DataFrame]:
        books, aliases = merge_safe_authors(second["books"])
        return {"books": books, "aliases": aliases}

    books = stages.table("authors", merged)["books"]
    if options.ask_model:
        asked_of = books
        books = stages.table("asked", lambda: dict(zip(("books", "cache"), ask_model(asked_of, second["cache"], client, options.threshold))))["books"]
    if options.resolve_duplicates:
        before = books

        def resolved() -> dict[str, DataFrame]:
            stats = files.select(F.col("rel_path").alias("path"), "size", "mtime")
            after, corrections, journal = dedupe.resolve(before, materialize(dedupe.groups(before, stats, threshold=options.similar), "groups"), "smart")
            return {"books": after, "corrections": corrections, "journal": journal}

        books = stages.table("resolved", resolved)["books"]
    return books, stages.done
