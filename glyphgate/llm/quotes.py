"""Quotation linking: replies are joined to the messages they quote and conversations rebuilt without quotes.

All in DataFrame functions.  Lines are quoted at the level of their leading ``>`` marks.  Runs of lines of one level are
quoted passages; a passage, its paragraphs and its lines are normalised (marks and case dropped, white space
collapsed) and hashed, as are the unquoted text, paragraphs and lines of every message.  Equal hashes link a reply to the
first message with that text: in its own conversation if there is an earlier one, else in a conversation with a smaller id.
Inside a conversation a quote of any length links; across conversations one below ``ACROSS_CHARS`` does not, since "Thanks!"
occurs everywhere and says nothing about its origin.
Only the first message per hash takes part, so a line that everybody writes meets each quote once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphgate.llm.work import Folder, components

QUOTED = r"^[ \t]*>"
MARKS = r"^[ \t]*(?:>[ \t]*)+"
INTRODUCTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió) ?:[ \t]*$"
ACROSS_CHARS = 20        # shorter texts link inside their conversation only
SLICE = 1024             # turns of a conversation that are numbered together


def _lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def own_text(text: Column) -> Column:
    """Unquoted lines, without the lines that introduce a quote; null stays null."""
    lines = _lines(text)
    def unquoted(x, i):
        following = F.coalesce(F.get(lines, i + 1), F.lit(""))
        return ~x.rlike(QUOTED) & ~(x.rlike(INTRODUCTION) & following.rlike(QUOTED))
    return F.regexp_replace(F.array_join(F.filter(lines, unquoted), "\n"), r"^\n+|\n+$", "")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f\x0B]+", " "))


def _units(text: Column) -> Column:
    """Whole text, paragraphs and lines, normalised; blank ones are left out."""
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    return F.array_distinct(F.filter(F.transform(parts, normal), lambda x: x != ""))


def passages(messages: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``level``, ``passage``: each run of lines that are quoted at one level, without its marks."""
    lines = messages.where(F.col("text").rlike(rf"(?m){QUOTED}")).select(
        "conv", "turn", F.xxhash64("text").alias("copy"), F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    lines = lines.distinct().withColumn("level", F.length(F.regexp_replace(marks, "[^>]", "")))
    message = Window.partitionBy("conv", "turn", "copy").orderBy("at")
    new = F.when(F.col("level") == F.lag("level").over(message), 0).otherwise(1)
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(message)).where("level > 0")
    body = F.regexp_replace("line", MARKS, "")
    return runs.groupBy("conv", "turn", "copy", "run", "level").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", body.alias("body")))), lambda x: x["body"]), "\n")
        .alias("passage")).select("conv", "turn", "level", "passage")


def matches(messages: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``level``, ``size``, ``parent_conv``, ``parent_turn``: every original that a message quotes."""
    quoted = (passages(messages).select("conv", "turn", "level", F.explode(_units(F.col("passage"))).alias("unit"))
              .select("conv", "turn", "level", F.length("unit").alias("size"), F.md5(F.encode("unit", "UTF-8")).alias("hash")))
    originals = messages.select("conv", "turn", F.explode(_units(own_text(F.col("text")))).alias("unit")).select(
        "conv", "turn", F.length("unit").alias("size"), F.md5(F.encode("unit", "UTF-8")).alias("hash"))
    here = originals.groupBy("hash", "conv").agg(F.min("turn").alias("here_turn"), F.first("size").alias("chars"))
    first = here.where(F.col("chars") >= ACROSS_CHARS).groupBy("hash").agg(F.min(F.struct("conv", "here_turn")).alias("first"))
    found = quoted.join(here.drop("chars"), ["hash", "conv"], "left").join(first, "hash", "left")
    inside = F.col("here_turn") < F.col("turn")
    outside = F.col("first.conv") < F.col("conv")
    found = found.select(
        "conv", "turn", "level", "size",
        F.when(inside, F.col("conv")).when(outside, F.col("first.conv")).alias("parent_conv"),
        F.when(inside, F.col("here_turn")).when(outside, F.col("first.here_turn")).alias("parent_turn"))
    return found.where("parent_conv IS NOT NULL").distinct()


def links(found: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``level``, ``parent_conv``, ``parent_turn``: the message that each quoting one answers.

    Of a message's matches the outermost level counts, then the longest matched text, then the first original.
    """
    best = F.min(F.struct("level", (-F.col("size")).alias("s"), "parent_conv", "parent_turn")).alias("b")
    return found.groupBy("conv", "turn").agg(best).select(
        "conv", "turn", "b.level", "b.parent_conv", "b.parent_turn")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` (unquoted), ``thread``, ``position``, ``parent_conv``, ``parent_turn``, ``level``.

    A thread joins conversations that quote one another, by every match and not the parents' alone, and is named by the smallest; positions number its
    messages from 0 by conversation and turn.  What is quoted comes from an earlier turn or a smaller conversation, so every
    reply follows what it answers.  Without a quote the parent is null: the message follows the one before it.
    Null and empty texts have no quote and are nobody's original.  Rows without conversation or turn make no links and come first.
    Repeated rows stay repeated, with positions of their own.
    """
    folder = Folder(messages.sparkSession)
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                           F.col(text_col).alias("text"))
    found = folder.kept(matches(rows.where("conv IS NOT NULL AND turn IS NOT NULL")))
    linked = links(found)
    across = found.where("conv <> parent_conv").select(F.col("conv").alias("a"), F.col("parent_conv").alias("b")).distinct()
    threads = components(across, folder) if not across.isEmpty() else across.select(F.col("a").alias("node"), F.col("b").alias("component"))
    narrow = rows.select("conv", "turn", "role", own_text(F.col("text")).alias("text"))
    named = (narrow.join(threads.withColumnRenamed("node", "conv"), "conv", "left")
             .join(linked, ["conv", "turn"], "left")
             .withColumn("thread", F.coalesce("component", "conv")).withColumn("slice", F.expr(f"turn div {SLICE}")))
    sizes = named.groupBy("thread", "conv", "slice").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("thread").orderBy("conv", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("thread").alias("t"), F.col("conv").alias("c"), F.col("slice").alias("s"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("thread", "conv", "slice").orderBy("turn", "role", "text")
    same = F.col("thread").eqNullSafe(F.col("t")) & F.col("conv").eqNullSafe(F.col("c")) & F.col("slice").eqNullSafe(F.col("s"))
    return named.join(offsets, same).select(
        "conv", "turn", "role", "text", "thread", (F.col("offset") + F.row_number().over(inside) - 1).alias("position"),
        "parent_conv", "parent_turn", "level")
