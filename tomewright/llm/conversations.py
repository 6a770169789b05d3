"""Repair of a conversation's structure: the cheapest edits that make its turns alternate.

Windows flag the faults of every turn; a conversation's turns are then collected, sorted, into one array, and
``aggregate`` folds them. The fold carries four structs (cost, audit), one for each place in the wanted order
``(s?(ua)+)?``: nothing yet, after the system turn, after a user's, after an assistant's. Each step extends them
and keeps the ``least``: the cheapest, and of those the first audit in ASCII.

Why that is the best over all: from each place a letter leads to one place only, so equal audits end in the same
place at the same cost; and no audit is the beginning of another one of equal cost, as only insertions
(which cost) could follow. So the least of the parts stays the least of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits: insert, give another role, delete; and of a truncated turn that stays.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
_SPACE = " \t\n\x0b\x0c\r"
_STATE = "struct<cost: bigint, audit: string>"


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by rule, for tests of ``repair``: the checksum of ``conv_id:turn``, modulo 20, drops a row (0),
    empties its text (1), takes the ends of its sentences (2), repeats it (3), or makes its role user (4).

    Returns conv_id, turn, role, text and ``present``, which is false for what stands for a dropped row.
    Nulls in role and text, and in the checksum, are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    marked = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return marked.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("kind") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Add ``fault`` (the first of blank, duplicate, truncated, or an empty string) and ``illegal`` (whether a turn may
    not follow the one before it). One exchange by conversation serves both windows."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    order = [F.col("present").desc(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    turns = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "role", "text").orderBy(*order[:2])
    pair = F.concat(F.lag(F.substring("role", 1, 1)).over(turns), F.substring("role", 1, 1))
    fault = F.when(bare == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    return (
        rows.withColumn("illegal", F.coalesce(F.col("present") & ~pair.isin("su", "ua", "au"), F.lit(False)))
        .withColumn("seen", F.row_number().over(same))
        .withColumn("fault", F.coalesce(fault, F.lit("")))
        .drop("seen")
    )


def _more(state: Column, cost: int | Column, letters: str | Column) -> Column:
    """A state with an edit added; null (a place that can't be reached) stays null."""
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letters).alias("audit")))


def _places(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(none.alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _inserted(at: Column) -> Column:
    """The places after any insertions that can pay: one turn, or a user's and an assistant's."""
    return _places(
        at["none"],
        at["system"],
        F.least(at["user"], _more(F.least(at["none"], at["system"], at["assistant"]), INSERT, "I")),
        F.least(at["assistant"], _more(at["user"], INSERT, "J"), _more(F.least(at["none"], at["system"]), 2 * INSERT, "IJ")),
    )


def _step(at: Column, turn: Column) -> Column:
    """The places after a turn is kept, given another role or deleted. Letters: D, I and J (a user's or an
    assistant's turn inserted), K, R and S (made a user's or an assistant's)."""
    stays = ~turn["fault"].isin("blank", "duplicate")
    extra = F.when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    first = F.substring(turn["role"], 1, 1)
    as_user = F.when(first == "u", F.struct(extra.alias("cost"), F.lit("K").alias("letter"))).otherwise(F.struct((extra + REROLE).alias("cost"), F.lit("R").alias("letter")))
    as_assistant = F.when(first == "a", F.struct(extra.alias("cost"), F.lit("K").alias("letter"))).otherwise(F.struct((extra + REROLE).alias("cost"), F.lit("S").alias("letter")))
    return _places(
        _more(at["none"], DELETE, "D"),
        F.least(_more(at["system"], DELETE, "D"), F.when(stays & (first == "s"), _more(at["none"], extra, "K"))),
        F.least(
            _more(at["user"], DELETE, "D"),
            F.when(stays, _more(F.least(at["none"], at["system"], at["assistant"]), as_user["cost"], as_user["letter"])),
        ),
        F.least(_more(at["assistant"], DELETE, "D"), F.when(stays, _more(at["user"], as_assistant["cost"], as_assistant["letter"]))),
    )


def _fold(turns: Column) -> Column:
    """The cheapest edits of a conversation."""
    never = F.lit(None).cast(_STATE)
    start = _places(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit("").alias("audit")), never, never, never)

    def merge(at: Column, turn: Column) -> Column:
        # an array of one element names the places after insertions, which would else be worked out for each use
        return F.element_at(F.transform(F.array(_inserted(at)), lambda ready: _step(ready, turn)), 1)

    def finish(at: Column) -> Column:
        return F.element_at(F.transform(F.array(_inserted(at)), lambda ready: F.least(ready["none"], ready["assistant"])), 1)

    return F.aggregate(turns, start, merge, finish)


def _message(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))


def _apply(turns: Column, audit: Column) -> Column:
    """The messages that the edits leave."""
    none = F.array().cast("array<struct<role: string, text: string>>")

    def inserts(letters: Column) -> Column:
        added = F.filter(F.split(letters, ""), lambda c: c.isin("I", "J"))
        return F.transform(added, lambda c: _message(F.when(c == "I", "user").otherwise("assistant"), F.lit("")))

    def edited(turn: Column, letters: Column) -> Column:
        last = F.right(letters, F.lit(1))
        role = F.when(last == "K", turn["role"]).when(last == "R", "user").otherwise("assistant")
        return F.concat(inserts(letters), F.when(last == "D", none).otherwise(F.array(_message(role, turn["text"]))))

    done = F.zip_with(turns, F.regexp_extract_all(audit, F.lit("[IJ]*[KRSD]"), F.lit(0)), edited)
    return F.concat(F.flatten(done), inserts(F.regexp_extract(audit, "[IJ]*$", 0)))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, and if wanted ``present``).

    Turns are taken in order of turn (nulls first), then role and text. A turn's first fault counts: blank (no character
    but ASCII white space), duplicate (role and text seen earlier), truncated (its last such character ends no
    sentence). Edits: keep (K, 0), give the role user or assistant (R, 3), delete (D, 4; blank and duplicate turns must
    go), insert a turn without text (I, 3); a truncated turn that stays adds 3. The cheapest edits that leave
    ``(s?(ua)+)?`` as first letters of the roles are done, of equals the first audit in ASCII.

    Returns conv_id, gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated,
    illegal (neighbours that aren't su, ua or au), cost, audit, and ``messages``: the turns after the edits.

    Nulls in role and text are one space; null turns come first and don't count for gaps; null ids are one
    conversation. A role without a letter can't be kept. Rows that tie in all are duplicates. A conversation of which all rows
    have ``present`` false has zeros, an empty audit and no messages; an empty table gives none. Other columns are left
    out. Texts of any length are kept whole. A conversation is one sample, so its turns meet in one row; its fold copies the
    audit at every turn, which takes time with the square of its turns (some seconds at 10,000)."""
    if "present" not in rows.columns:
        rows = rows.withColumn("present", F.lit(True))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    flagged = faults(rows.select("conv_id", "turn", blank("role"), blank("text"), "present"))
    turn = F.when(F.col("present"), F.struct("turn", "role", "text", "fault"))
    count = lambda condition: F.coalesce(F.sum(F.when(F.col("present") & condition, 1).otherwise(0)), F.lit(0)).cast("long")
    whole = flagged.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"),
        *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
    )
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long")
    folded = whole.withColumn("best", _fold(F.col("turns")))
    return folded.select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("best.cost").alias("cost"), F.translate("best.audit", "JS", "IR").alias("audit"),
        _apply(F.col("turns"), F.col("best.audit")).alias("messages"),
    )


def digest(messages: Column) -> Column:
    """SHA-256 of the messages as ``role:text``, joined by newlines."""
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    return F.sha2(F.array_join(lines, "\n"), 256)
