"""Remembered decisions as snapshot tables: what was decided last stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.functions import columns as C
from tomewright.functions import fixed, udfs


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The table after INSERT OR REPLACE of ``changes``: of each key the row with the last ``ts``."""
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col("_new").desc())
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_new")


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def merge_corrections(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Corrections patched, not replaced: of each field the last value."""
    both = table.unionByName(changes).where(C.text("fp") != "").select("fp", "ts", F.explode("fields"))
    last = both.groupBy("fp", "key").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    return last.groupBy("fp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"), F.max("ts").alias("ts"))


def append_journal(journal: DataFrame, rows: DataFrame) -> DataFrame:
    """New rows numbered after the last; a journal is read newest first."""
    top = journal.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    numbered = rows.withColumn("id", F.row_number().over(Window.orderBy("ts", "action", "src")) + F.lit(top))
    return journal.unionByName(numbered.select(*journal.columns))


def fresh(cache: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Cache rows younger than ``days``: 90, 30 for online records, 365 for model answers."""
    return cache.where(now.cast("timestamp") < F.col("ts") + F.make_dt_interval(F.lit(days)))


def fresh_fingerprints(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files with the fingerprint that is still good for their size and time (within 2 seconds), else null."""
    k = known.toDF("_path", "_size", "_mtime", "fp")
    near = F.abs(F.unix_micros("mtime") - F.unix_micros("_mtime")) < 2_000_000
    return files.join(k, (F.col("path") == F.col("_path")) & (F.col("size") == F.col("_size")) & near, "left").drop("_path", "_size", "_mtime")


def status(author: Column, title: Column, old: Column) -> Column:
    """'ready' with author and title, else 'needs review'; what was finished stays."""
    final = old.isin("copied", "moved", "skipped") | old.startswith("ERROR")
    ready = (C.text(author) != "") & (C.text(title) != "")
    return F.when(final, old).when(ready, "ready").otherwise("needs review")


def apply_memory(books: DataFrame, aliases: DataFrame, corrections: DataFrame) -> DataFrame:
    """Aliases, then corrections, put over the books; corrected fields become locked."""
    a = aliases.select(F.col("variant_key").alias("_k"), "canonical")
    c = corrections.select(F.col("fp").alias("_fp"), F.col("fields").alias("_f"))
    rows = books.withColumn("_k", F.when(C.text("author") != "", udfs.author_key("author")))
    rows = rows.join(a, "_k", "left").join(c, (F.col("fingerprint") == F.col("_fp")) & (C.text("fingerprint") != ""), "left")
    rows = rows.withColumn("author", F.coalesce("canonical", "author"))
    has = lambda k: F.coalesce(F.map_contains_key("_f", k), F.lit(False))
    put = {k: F.when(has(k), F.element_at("_f", F.lit(k))).otherwise(F.col(k)) for k in fixed.EDITABLE}
    keys = F.coalesce(F.filter(F.map_keys("_f"), lambda k: k.isin(*fixed.EDITABLE)), F.array().cast("array<string>"))
    told = F.col("meta_source").isin("filename", "folders", "tags") & (has("title") | has("author"))
    skip = has("_status") & (F.element_at("_f", F.lit("_status")) == "skipped") & ~F.col("status").isin("copied", "moved")
    put |= {"locked": F.array_sort(F.array_union(F.coalesce("locked", F.array().cast("array<string>")), keys)), "meta_source": F.when(told, "you").otherwise(F.col("meta_source")), "status": F.when(skip, "skipped").otherwise(F.col("status"))}
    return rows.withColumns(put).select(*books.columns)


def remember(books: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, corrections) after edits (id, fields): the fields are set, locked and stored by content."""
    e = edits.select(F.col("id").alias("_id"), F.col("fields").alias("_f"))
    rows = books.join(e, books.id == e["_id"], "left")
    has = lambda k: F.coalesce(F.map_contains_key("_f", k), F.lit(False))
    put = {k: F.when(has(k), F.element_at("_f", F.lit(k))).otherwise(F.col(k)) for k in fixed.EDITABLE}
    put["locked"] = F.array_sort(F.array_union(F.coalesce("locked", F.array().cast("array<string>")), F.coalesce(F.map_keys("_f"), F.array().cast("array<string>"))))
    put["status"] = status(put["author"], put["title"], F.col("status"))
    corrections = rows.where("_f IS NOT NULL AND coalesce(fingerprint, '') <> ''").select(F.col("fingerprint").alias("fp"), F.col("_f").alias("fields"), F.current_timestamp().alias("ts"))
    return rows.withColumns(put).select(*books.columns), corrections


def merge_remembered(books: DataFrame, corrections: DataFrame) -> DataFrame:
    """Ebooks that were merged into another before are merged again: the keeper takes the files whose
    formats it lacks, and the merged book goes."""
    to = corrections.where(F.map_contains_key("fields", F.lit("_merge_into"))).select(F.col("fp").alias("fingerprint"), F.element_at("fields", F.lit("_merge_into")).alias("_keep"))
    first = books.where("coalesce(fingerprint, '') <> ''").groupBy(F.col("fingerprint").alias("_keep")).agg(F.max("id").alias("_keeper"))
    gone = books.where("kind = 'ebook'").join(to, "fingerprint").join(first, "_keep").where("id <> _keeper")
    parts = gone.select("_keeper", "id", F.posexplode("files").alias("_p", "_f")).withColumn("_e", C.extension("_f"))
    once = parts.groupBy("_keeper", "_e").agg(F.min_by("_f", F.struct("id", "_p")).alias("_f"))
    more = once.groupBy("_keeper").agg(F.array_sort(F.collect_list(F.struct("_e", "_f"))).alias("_more"))
    rows = books.join(gone.select("id").distinct(), "id", "left_anti").join(more, F.col("id") == F.col("_keeper"), "left")
    have = F.transform("files", lambda f: C.extension(f))
    lacking = F.transform(F.filter("_more", lambda x: ~F.array_contains(have, x["_e"])), lambda x: x["_f"])
    return rows.withColumn("files", F.concat("files", F.coalesce(lacking, F.array().cast("array<string>")))).select(*books.columns)


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n): rows of every decisions table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out
