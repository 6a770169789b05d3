"""What files told when they were last read, kept by path, size and time, so that a scan opens only what has changed."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.functions import fixed
from tomewright.functions.udfs import META
from tomewright.sources import metadata, tree

_TAGS = "struct<" + ", ".join(f"{k}: string" for k in META.names) + ">"
#: A row for each file that has been read; ``many`` tells how its tags were read, and is null where they weren't.
LEDGER = f"rel_path string, size long, mtime timestamp, many boolean, fp string, tags {_TAGS}, content binary"


def wanted(files: DataFrame, books: DataFrame) -> DataFrame:
    """(rel_path, size, mtime, many, hashed, whole) of the files of which a scan wants to know something: audio and ebooks are
    hashed, books' first files give their tags, and sidecars are read whole."""
    leading = books.select(F.get("files", F.lit(0)).alias("rel_path"), (F.size("files") > 1).alias("many")).groupBy("rel_path").agg(F.max("many").alias("many"))
    hashed = F.col("ext").isin(*fixed.AUDIO_EXTS, *fixed.EBOOK_EXTS)
    whole = (F.col("ext") == ".opf") | (F.lower("name") == "metadata.json")
    rows = files.join(leading, "rel_path", "left").select("rel_path", "size", "mtime", "many", hashed.alias("hashed"), whole.alias("whole"))
    return rows.where("hashed OR whole OR many IS NOT NULL")


def read(rows: DataFrame, root: str) -> DataFrame:
    """The ledger of files (as ``wanted`` gives them), read now on the executors."""

    def run(batches):
        for part in batches:
            out = {"rel_path": part.rel_path, "size": part["size"], "mtime": part.mtime, "many": part.many, "fp": [], "tags": [], "content": []}
            for rel, many, hashed, whole in zip(part.rel_path, part.many, part.hashed, part.whole, strict=True):
                path = os.path.join(root, tree.os_path(rel))
                told = metadata.embedded(path, bool(many)) if many is not None and not pd.isna(many) else {}
                out["fp"].append(tree.file_fingerprint(path) if hashed else "")
                out["tags"].append({k: told.get(k, "") for k in META.names})
                out["content"].append(_content(path) if whole else None)
            yield pd.DataFrame(out)

    return rows.select("rel_path", "size", "mtime", "many", "hashed", "whole").mapInPandas(run, LEDGER)


def _content(path: str) -> bytes:
    try:
        with open(path, "rb") as fh:
            return fh.read()
    except OSError:
        return b""


def brought_up_to_date(rows: DataFrame, root: str, known: DataFrame | None) -> DataFrame:
    """The ledger of ``rows``: of files whose size and time are those of ``known``, what that tells; others are opened."""
    if known is None:
        return read(rows, root)
    same = ["rel_path", "size", "mtime"]
    last = known.select(*same, F.col("many").alias("_many"), "fp", "tags", "content", F.lit(True).alias("_known"))
    met = rows.join(last, same, "left")
    # tags are read anew where a file has become a book's first, or its book one of many files
    fresh = F.coalesce("_known", F.lit(False)) & (F.col("many").isNull() | F.col("many").eqNullSafe(F.col("_many")))
    kept = met.where(fresh).select(*same, F.col("_many").alias("many"), "fp", "tags", "content")
    return kept.unionByName(read(met.where(~fresh), root))
