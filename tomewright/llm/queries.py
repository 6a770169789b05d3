"""The queries of the training-data operators, with production parameters, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import alignment, conversations, htmltext, idstore, jaccard, linededup, neighbours, packing, ppm, quality, rules, sentencepieces, urlfilter
from tomewright.session import fresh_path, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every whole document's SentencePiece ids, and of the text decoded from them."""
    return sentencepieces.encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("piece_bpe_32k.model"),
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


@query
def op5_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of all documents' id streams, read back from the content-addressed store."""
    store = idstore.write_store(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "store"), end_id=2
    )
    store.verify()
    return store.checksums()


@query
def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality metrics and verdict of every document."""
    return rules.measure(table(spark, sf_dir, "documents")).drop("failed_rule")


ORACLES["op8_rules"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t
), pos AS (
  SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos
), rep AS (
  SELECT rid, count(DISTINCT p) AS r FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c >= 2) GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t
), dup AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS d
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n, 0) AS n_lines
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)
), b AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols * 10 > n_words) AND word_chars * 2 >= n_words * 5 AND word_chars <= n_words * 15
    AND NOT (n_dup_lines * 10 > n_lines * 3) AS kept
FROM b"""


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole document under the byte-context model, and under word counts."""
    return ppm.score_documents(table(spark, sf_dir, "documents"))


@query
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, for five-word shingles and similarity 0.8."""
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


@query
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and deleted lines of every document, and the digest of the text that is left."""
    left = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_deleted", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


ORACLES["op9_lines"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT doc_id, line, num, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS num FROM t)
), c AS (
  SELECT *, row_number() OVER w AS idx, sum(words) OVER w AS done FROM l WHERE words > 0
  WINDOW w AS (PARTITION BY doc_id ORDER BY num ROWS UNBOUNDED PRECEDING)
), d AS (
  SELECT doc_id, list(line ORDER BY idx) AS lines FROM c GROUP BY doc_id
), win AS (
  SELECT a.doc_id, a.idx AS s, min(b.idx) AS e FROM c a JOIN c b
    ON a.doc_id = b.doc_id AND b.idx >= a.idx AND b.done - a.done + a.words >= 50 GROUP BY a.doc_id, a.idx
  UNION
  SELECT b.doc_id, max(a.idx) AS s, b.idx AS e FROM c a JOIN c b
    ON a.doc_id = b.doc_id AND b.idx >= a.idx AND b.done - a.done + a.words >= 50 GROUP BY b.doc_id, b.idx
), k AS (
  SELECT win.doc_id, s, e, array_to_string(lines[s:e], chr(10)) AS key FROM win JOIN d ON win.doc_id = d.doc_id
), f AS (
  SELECT doc_id, s, e, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS nth FROM k
), gone AS (
  SELECT DISTINCT c.doc_id, c.num FROM c JOIN f ON c.doc_id = f.doc_id AND c.idx BETWEEN f.s AND f.e WHERE f.nth > 1
), j AS (
  SELECT l.doc_id, l.num, l.line, l.words, gone.num IS NOT NULL AS del FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.num = gone.num
)
SELECT doc_id, CAST(count(*) FILTER (WHERE words > 0) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE del) AS BIGINT) AS n_deleted,
  md5(coalesce(string_agg(line, chr(10) ORDER BY num) FILTER (WHERE NOT del), '')) AS text_md5
FROM j GROUP BY doc_id"""


@query
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every hundredth embedding."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: Fetch times and list entries of the query on ``pages``, which has neither: made by rule from its rows.
FETCHED = "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST((page_id * 37) % 57600 AS INT), 0)"


@query
def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as of its fetch time against lists of hosts, domains and path prefixes."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched"))
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = materialize(hosts.withColumn("h", (F.ascii("host") * 31 + F.length("host") * 17) % 97), "hosts")
    day = lambda e: F.expr(f"timestamp '2024-01-01 00:00:00' + make_dt_interval(CAST({e} AS INT), 0, 0, 0)")
    changes = [("add", "h % 20"), ("remove", "h % 20 + 10 + h % 7"), ("add", "h % 20 + 25")]
    entries = None
    for action, when in changes:
        one = hosts.where("h % 3 <> 0").select(F.lit("spam").alias("list"), F.lit("host").alias("kind"), F.col("host").alias("key"), F.lit(action).alias("action"), day(when).alias("at"))
        two = hosts.where("h % 2 = 0").select(F.lit("legal").alias("list"), F.lit("prefix").alias("kind"), F.concat("host", F.lit("/en")).alias("key"), F.lit(action).alias("action"), day(f"({when}) / 2").alias("at"))
        entries = one.unionByName(two) if entries is None else entries.unionByName(one).unionByName(two)
    domain = hosts.select(F.substring_index("host", ".", -2).alias("key")).distinct().where("length(key) % 2 = 1")
    entries = entries.unionByName(domain.select(F.lit("adult").alias("list"), F.lit("domain").alias("kind"), "key", F.lit("add").alias("action"), day("30").alias("at")))
    found = urlfilter.evaluate(pages, entries)
    return found.select("page_id", "blocked", "n_lists", F.coalesce("list", F.lit("")).alias("list"), F.coalesce(F.date_format("since", "yyyy-MM-dd"), F.lit("")).alias("since"))


ORACLES["op6_urlfilter"] = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, url,
    regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '[.]+$', '') AS host,
    rtrim(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS path,
    (page_id * 37) % 57600 AS fetched
  FROM pages
), h AS (
  SELECT host, (ascii(host) * 31 + length(host) * 17) % 97 AS h FROM (SELECT DISTINCT host FROM p WHERE host <> '')
), spam AS (
  SELECT 'spam' AS list, host AS key, CAST(floor(s) AS BIGINT) AS s, CAST(floor(e) AS BIGINT) AS e FROM (
    SELECT host, h % 20 AS s, h % 20 + 10 + h % 7 AS e FROM h WHERE h % 3 <> 0
    UNION ALL SELECT host, h % 20 + 25, 100000 FROM h WHERE h % 3 <> 0)
), legal AS (
  SELECT 'legal' AS list, host || '/en' AS key, CAST(floor(s / 2.0) AS BIGINT) AS s, CAST(floor(e / 2.0) AS BIGINT) AS e FROM (
    SELECT host, h % 20 AS s, h % 20 + 10 + h % 7 AS e FROM h WHERE h % 2 = 0
    UNION ALL SELECT host, h % 20 + 25, 200000 FROM h WHERE h % 2 = 0)
), adult AS (
  SELECT DISTINCT 'adult' AS list, regexp_extract(host, '([^.]*[.])?[^.]*$') AS key, 30 AS s, 100000 AS e FROM h
), hit AS (
  SELECT rid, list, s FROM p JOIN spam ON host = key AND fetched >= s * 1440 AND fetched < e * 1440
  UNION ALL SELECT rid, list, s FROM p JOIN legal ON (host || path = key OR starts_with(host || path, key || '/')) AND fetched >= s * 1440 AND fetched < e * 1440
  UNION ALL SELECT rid, list, s FROM p JOIN adult ON (host = key OR ends_with(host, '.' || key)) AND length(key) % 2 = 1 AND fetched >= s * 1440 AND fetched < e * 1440
), v AS (
  SELECT rid, count(DISTINCT list) AS n, min(list) AS list, min(s) AS s FROM hit GROUP BY rid
)
SELECT page_id, n IS NOT NULL AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_lists, coalesce(list, '') AS list,
  coalesce(strftime(DATE '2024-01-01' + CAST(s AS INTEGER), '%Y-%m-%d'), '') AS since
FROM p LEFT JOIN v USING (rid)"""


@query
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage by rule."""
    repaired = conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
    return repaired.withColumn("repaired_sha256", conversations.digest(F.col("messages"))).drop("messages")


ORACLES["op11_conversations"] = r"""
WITH RECURSIVE tb AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations
), k AS (
  SELECT * EXCLUDE (bytes, tab), xor(list_reduce(bytes, lambda c, b: xor(tab[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8),
    CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind
  FROM keyed, tb
), r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0
), o AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS pair,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(bare, '[.!?]$') THEN 't' ELSE '' END AS fault,
    coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS odd
  FROM o
), g AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (odd) AS illegal, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts, list(fault ORDER BY i) AS faults
  FROM f GROUP BY conv_id
), c AS (
  SELECT a.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(roles, CAST([] AS VARCHAR[])) AS roles, coalesce(texts, CAST([] AS VARCHAR[])) AS texts, coalesce(faults, CAST([] AS VARCHAR[])) AS faults
  FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id
), paths(conv_id, i, state, cost, path) AS (
  SELECT conv_id, 0, 'E', 0, '' FROM c
  UNION ALL
  SELECT conv_id, i, state, cost, path FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, path) AS nth FROM (
      SELECT q.conv_id, q.i + 1 AS i, e.state, q.cost + e.cost AS cost, q.path || e.letters AS path
      FROM (
        SELECT p.conv_id, p.i, x.state, p.cost + x.cost AS cost, p.path || x.letters AS path FROM paths p
        JOIN (VALUES ('E', 'E', 0, ''), ('S', 'S', 0, ''), ('U', 'U', 0, ''), ('A', 'A', 0, ''), ('E', 'U', 3, 'I'), ('S', 'U', 3, 'I'),
          ('A', 'U', 3, 'I'), ('U', 'A', 3, 'J'), ('E', 'A', 6, 'IJ'), ('S', 'A', 6, 'IJ'), ('A', 'A', 6, 'IJ'), ('U', 'U', 6, 'JI')) x(was, state, cost, letters) ON p.state = x.was
      ) q JOIN c ON q.conv_id IS NOT DISTINCT FROM c.conv_id AND q.i < c.n
      JOIN (VALUES ('E', 'E', 4, 'D', ''), ('S', 'S', 4, 'D', ''), ('U', 'U', 4, 'D', ''), ('A', 'A', 4, 'D', ''), ('E', 'S', 0, 'K', 's'),
        ('E', 'U', 0, 'K', 'u'), ('S', 'U', 0, 'K', 'u'), ('A', 'U', 0, 'K', 'u'), ('U', 'A', 0, 'K', 'a'),
        ('E', 'U', 3, 'R', ''), ('S', 'U', 3, 'R', ''), ('A', 'U', 3, 'R', ''), ('U', 'A', 3, 'S', '')) v(was, state, cost, letters, initial)
        ON q.state = v.was AND (v.initial = '' OR v.initial = c.roles[q.i + 1][1]) AND (v.letters = 'D' OR c.faults[q.i + 1] NOT IN ('b', 'd')),
      LATERAL (SELECT v.state, v.letters, v.cost + CASE WHEN v.letters <> 'D' AND c.faults[q.i + 1] = 't' THEN 3 ELSE 0 END AS cost) e
    )) WHERE nth = 1
), last AS (
  SELECT conv_id, min({'cost': cost, 'path': path}) AS best FROM (
    SELECT p.conv_id, p.cost + x.cost AS cost, p.path || x.letters AS path
    FROM paths p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n
    JOIN (VALUES ('E', 0, ''), ('A', 0, ''), ('U', 3, 'J'), ('S', 6, 'IJ')) x(was, cost, letters) ON p.state = x.was
  ) GROUP BY conv_id
), done AS (
  SELECT c.*, best.cost AS cost, best.path AS path, regexp_extract_all(best.path, '[IJ]*[KRSD]') AS edits, regexp_extract(best.path, '[IJ]*$') AS tail
  FROM c JOIN last ON c.conv_id IS NOT DISTINCT FROM last.conv_id
), t AS (
  SELECT *, array_to_string(list_transform(range(1, n + 1), lambda j: replace(replace(regexp_extract(edits[j], '^[IJ]*'), 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10))
    || CASE right(edits[j], 1) WHEN 'K' THEN roles[j] || ':' || texts[j] || chr(10) WHEN 'R' THEN 'user:' || texts[j] || chr(10)
      WHEN 'S' THEN 'assistant:' || texts[j] || chr(10) ELSE '' END), '') || replace(replace(tail, 'I', 'user:' || chr(10)), 'J', 'assistant:' || chr(10)) AS text
  FROM done
)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated,
  CAST(illegal AS BIGINT) AS illegal, CAST(cost AS BIGINT) AS cost, translate(path, 'JS', 'IR') AS audit,
  sha256(CASE WHEN text = '' THEN '' ELSE left(text, -1) END) AS repaired_sha256
FROM t"""


@query
def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two public tokenizers meet in every whole document."""
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.drop("groups")
