"""Answers of online catalogs as candidate rows: JSON text in, ``schema.CANDIDATE`` structs out, all in the JVM.

Requests are (kind, query) pairs for a ``clients.Client``; where they are sent is the client's business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions import columns as C
from tomewright.functions import fixed
from tomewright.operators import schema
from tomewright.sources.metadata import online_record

PERSON = "array<struct<name:string>>"
PRODUCT = f"""struct<asin:string,title:string,subtitle:string,authors:{PERSON},narrators:{PERSON},runtime_length_min:int,
series:array<struct<title:string,sequence:string>>,release_date:string,publisher_name:string,product_images:map<string,string>,
publisher_summary:string,language:string,category_ladders:array<struct<ladder:array<struct<name:string>>>>>"""
DETAIL = f"""title string, subtitle string, seriesPrimary struct<name:string,position:string>, genres array<struct<name:string,type:string>>,
narrators {PERSON}, authors {PERSON}, image string, summary string, isbn string"""
VOLUMES = """items array<struct<volumeInfo:struct<title:string,subtitle:string,authors:array<string>,publishedDate:string,publisher:string,
industryIdentifiers:array<struct<type:string,identifier:string>>,imageLinks:map<string,string>,description:string,categories:array<string>,language:string>>>"""
WORKS = """docs array<struct<title:string,author_name:array<string>,first_publish_year:int,isbn:array<string>,cover_i:long,publisher:array<string>>>"""
KINDS = ("audible", "audnexus", "google", "openlibrary")


def questions(books: DataFrame) -> DataFrame:
    """(id, ordinal, kind, query): what to ask about each book, in the order in which candidates are preferred."""
    by_name = F.to_json(F.struct("title", "author"))
    alone = F.to_json(F.struct("title"))
    has = lambda c: C.text(c) != ""
    audio = F.col("kind") == "audio"
    suspect = F.array_contains(F.coalesce("flags", F.array().cast("array<string>")), "author looks like a narrator")
    asked = [
        (audio & has("asin"), "audible", F.to_json(F.struct("asin"))), (audio & has("title"), "audible", by_name), (audio & has("title") & suspect, "audible", alone),
        (has("isbn"), "google", F.to_json(F.struct("isbn"))), (has("isbn"), "openlibrary", F.to_json(F.struct("isbn"))),
        (has("title"), "google", by_name), (has("title"), "openlibrary", by_name),
    ]
    every = F.filter(F.array(*[F.when(ok, F.struct(F.lit(i).alias("ordinal"), F.lit(kind).alias("kind"), q.alias("query"))) for i, (ok, kind, q) in enumerate(asked)]), lambda x: x.isNotNull())
    return books.select("id", F.explode(every).alias("q")).select("id", "q.*")


def _struct(**known: Column) -> Column:
    fields = [x.strip().split() for x in schema.CANDIDATE.split(",")]
    empty = {"string": F.lit(""), "int": F.lit(0)}
    return F.struct(*[F.coalesce(known.get(n, empty[kind]), empty[kind]).cast(kind).alias(n) for n, kind in fields])


def _product(p: Column) -> Column:
    """A product with its subtitle, language, and the first four names of its category ladders."""
    steps = F.transform(F.flatten(F.transform(p["category_ladders"], lambda x: x["ladder"])), lambda x: x["name"])
    genres = F.slice(F.array_distinct(F.filter(steps, lambda n: F.coalesce(n, F.lit("")) != "")), 1, 4)
    record = online_record(p)
    for field, value in (("genres", F.array_join(genres, ", ")), ("subtitle", p["subtitle"]), ("language", F.initcap(p["language"]))):
        record = record.withField(field, F.coalesce(value, F.lit("")))
    return record


def _volume(x: Column) -> Column:
    v = x["volumeInfo"]
    number = lambda kind: F.get(F.filter(v["industryIdentifiers"], lambda i: i["type"] == kind), F.lit(0))["identifier"]
    cover = F.coalesce(*[F.element_at(v["imageLinks"], F.lit(k)) for k in ("extraLarge", "large", "medium", "thumbnail")])
    cover = F.concat(F.regexp_replace(F.regexp_replace(cover, "^http://", "https://"), r"&edge=curl|&zoom=\d", ""), F.lit("&fife=w1200"))
    return _struct(
        source=F.lit("Google Books"), title=v["title"], subtitle=v["subtitle"], author=F.array_join(F.slice(v["authors"], 1, 3), ", "), year=F.substring(v["publishedDate"], 1, 4),
        publisher=v["publisher"], description=v["description"], isbn=F.coalesce(number("ISBN_13"), number("ISBN_10")), genres=F.array_join(F.slice(v["categories"], 1, 3), ", "),
        language=v["language"], cover_url=cover,
    )


def _work(d: Column) -> Column:
    valid = F.get(F.filter(F.transform(d["isbn"], lambda i: C.valid_isbn(i)), lambda i: i != ""), F.lit(0))
    return _struct(
        source=F.lit("Open Library"), title=d["title"], author=F.array_join(F.slice(d["author_name"], 1, 3), ", "), year=d["first_publish_year"].cast("string"),
        publisher=F.get(d["publisher"], F.lit(0)), isbn=valid, cover_url=F.concat(F.lit("https://covers.openlibrary.org/b/id/"), d["cover_i"].cast("string"), F.lit("-L.jpg")),
    )


def candidates(answers: DataFrame) -> DataFrame:
    """(id, ordinal, c) of answers (id, ordinal, kind, value): a row for each record, those without a title left out."""
    v = F.col("value")
    product = F.from_json(v, f"product {PRODUCT}, products array<{PRODUCT}>")
    products = F.concat(F.filter(F.array(product["product"]), lambda p: p.isNotNull()), F.coalesce(F.slice(product["products"], 1, 10), F.array().cast(f"array<{PRODUCT}>")))
    found = F.when(F.col("kind") == "audible", F.transform(products, _product))
    found = found.when(F.col("kind") == "google", F.transform(F.slice(F.from_json(v, VOLUMES)["items"], 1, 6), _volume))
    found = found.when(F.col("kind") == "openlibrary", F.transform(F.slice(F.from_json(v, WORKS)["docs"], 1, 5), _work))
    rows = answers.where(C.text("value") != "").select("id", "ordinal", F.posexplode(found).alias("n", "c"))
    plain = F.col("c").withField("description", C.html_to_text("c.description"))  # here, since no UDF runs in a lambda
    return rows.where(C.text("c.title") != "").select("id", (F.col("ordinal") * 100 + F.col("n")).alias("ordinal"), plain.alias("c"))


def merge_details(found: DataFrame, details: DataFrame) -> DataFrame:
    """Candidates with an asin, and what the detail service says of it (asin, value) put over seven fields."""
    d = details.select(F.col("asin").alias("_asin"), F.from_json("value", DETAIL).alias("d")).where(C.text("d.title") != "")
    names_ = lambda people, n: F.array_join(F.transform(F.slice(people, 1, n), lambda x: x["name"]), ", ")
    genres = F.array_join(F.slice(F.transform(F.filter("d.genres", lambda g: g["type"] == "genre"), lambda g: g["name"]), 1, 4), ", ")
    told = {
        "series": F.col("d.seriesPrimary.name"), "series_index": F.col("d.seriesPrimary.position"), "genres": genres, "narrator": names_(F.col("d.narrators"), 4),
        "isbn": C.valid_isbn("d.isbn"), "description": C.html_to_text("d.summary"), "cover_url": F.col("d.image"),
    }
    rows = found.join(d, (F.col("c.asin") == F.col("_asin")) & (C.text("c.asin") != ""), "left")
    c = F.col("c")
    for k, x in told.items():
        c = c.withField(k, F.coalesce(F.nullif(x, F.lit("")), F.col(f"c.{k}")))
    c = c.withField("source", F.lit("Audible+Audnexus"))
    return rows.withColumn("c", F.when(F.col("d").isNotNull(), c).otherwise(F.col("c"))).drop("d", "_asin")


def fill(rows: DataFrame, sources: list[str]) -> DataFrame:
    """The fill-only fields, each from the first of ``sources`` (structs) that has it; values that are there, and locked ones, stay."""
    free = lambda k: ~F.array_contains(F.coalesce("locked", F.array().cast("array<string>")), k)
    put = {k: F.when((C.text(k) == "") & free(k), F.coalesce(*[F.nullif(F.col(f"{s}.{k}"), F.lit("")) for s in sources], F.col(k))).otherwise(F.col(k)) for k in fixed.FILL_FIELDS}
    return rows.withColumns(put)
