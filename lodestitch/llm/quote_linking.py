"""Quotation linking for chats. DataFrame functions only.

A message may quote others in the mail style: lines that start with ``>``, ``>>`` and so on.
Every run of lines of one quote level is a passage. Passages, and each of their lines, are
normalised (quote marks off, white space collapsed, lower case) and hashed; the original
messages' own passages and lines are hashed in the same way; an equi-join within the
conversation finds the original. A message replies to the earlier turn of which it quotes the
most characters at its lowest quote level. Messages that reply hang below their original;
others stand in turn order. The result has every message without its quotes and without the
attribution line above a quote, in reply order.

Scale: messages without a quote are neither split nor hashed unless their conversation holds a
quote. Of equal passages in a conversation only the earliest turn is kept (a partial
aggregate), so a passage or a conversation with very many messages makes no pairs. Paths grow
by doubling: a chain of ``d`` replies takes about log2(d) joins.

Defined results: a null text is empty and quotes nothing; a quote without an earlier original
leaves its message in turn order; a message with a null conversation or turn links with nothing,
but loses its quotes too; repeated rows are kept, and replies to a repeated turn hang below that turn; ties go to the
earliest turn; an empty table gives an empty result; columns other than the named ones are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestitch.plans.materialize import materialize

MARKS = r"^(?:[ \t]{0,3}>)+"
ATTRIBUTION = r"(?i)^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"


def quote_level(line: Column) -> Column:
    """How many quote marks a line starts with."""
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def unquoted(line: Column) -> Column:
    """The line without its quote marks and the one blank after them."""
    return F.regexp_replace(line, MARKS + "[ \t]?", "")


def normalised(text: Column) -> Column:
    """What is hashed: lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(messages: DataFrame) -> DataFrame:
    """conv_id, turn, at, level, body: every line; attribution lines above a quote are left out."""
    split = messages.select("conv_id", "turn", "msg", F.posexplode(F.split(F.col("text"), "\n")).alias("at", "raw"))
    order = Window.partitionBy("conv_id", "turn", "msg").orderBy("at")
    lines = split.select(
        "conv_id",
        "turn",
        "msg",
        "at",
        quote_level(F.col("raw")).alias("level"),
        unquoted(F.col("raw")).alias("body"),
    )
    return lines.withColumn("next", F.lead("level").over(order)).where(
        ~((F.col("level") == 0) & (F.coalesce(F.col("next"), F.lit(0)) > 0) & F.col("body").rlike(ATTRIBUTION))
    )


def _passages(lines: DataFrame) -> DataFrame:
    """conv_id, turn, msg, level, body: runs of lines of one level."""
    order = Window.partitionBy("conv_id", "turn", "msg").orderBy("at")
    starts = (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1))).cast("int")
    runs = lines.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    return runs.groupBy("conv_id", "turn", "msg", "run", "level").agg(
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"])).alias("body")
    )


def _keys(passages: DataFrame) -> DataFrame:
    """conv_id, turn, level, key, chars: of each passage, its paragraphs and its lines."""
    parts = F.array_distinct(
        F.transform(
            F.concat(
                F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")
            ),
            normalised,
        )
    )
    return (
        passages.select("conv_id", "turn", "msg", "level", F.explode(parts).alias("part"))
        .where("part <> ''")
        .select("conv_id", "turn", "msg", "level", F.md5("part").alias("key"), F.length("part").alias("chars"))
    )


def link_quotes(
    messages: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, turn, role, parent_turn, depth, reply_path, n_quotes, content, formatted.

    Sorted by conversation and reply path, which is the turn of the thread's first message, then
    of each reply down to the message itself.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), text.alias("text")
    ).withColumn("msg", F.xxhash64("role", "text"))
    quotes = base.where(F.col("text").rlike(r"(?m)" + MARKS))
    # Repeated rows share their place, so each message is split once; the results join back to all rows.
    split = base.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").unionByName(quotes.where("conv_id is null"))
    lines = materialize(_lines(split.distinct()))
    passages = _passages(lines)
    keys = materialize(_keys(passages))
    originals = (
        keys.where("level = 0 and turn is not null").groupBy("conv_id", "key").agg(F.min("turn").alias("source"))
    )
    linked = (
        keys.where("level > 0")
        .join(originals, ["conv_id", "key"])
        .where("source < turn")
        .groupBy("conv_id", "turn", "msg", "source")
        .agg(F.min("level").alias("level"), F.sum("chars").alias("chars"))
        .groupBy("conv_id", "turn", "msg")
        .agg(F.min(F.struct("level", -F.col("chars"), "source"))["source"].alias("parent_turn"))
    )
    own = (
        passages.groupBy("conv_id", "turn", "msg")
        .agg(
            F.count_if(F.col("level") > 0).alias("n_quotes"),
            F.array_join(
                F.transform(
                    F.filter(F.sort_array(F.collect_list(F.struct("run", "level", "body"))), lambda x: x["level"] == 0),
                    lambda x: x["body"],
                ),
                "\n",
            ).alias("own"),
        )
        .where("n_quotes > 0")
    )
    paths = _reply_paths(linked)
    at = ["conv_id", "turn", "msg"]
    content = F.trim(F.regexp_replace(F.coalesce(F.col("own"), F.col("text")), r"^\s+|\s+$", ""))
    own = own.select(*[F.col(c).alias(f"own_{c}") for c in at], "n_quotes", "own")
    same = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in at]
    return (
        base.join(own, same, "left")
        .join(paths, at, "left")
        .select(
            "conv_id",
            "turn",
            "role",
            "parent_turn",
            F.coalesce(F.size("path") - 1, F.lit(0)).alias("depth"),
            F.coalesce(F.col("path"), F.array("turn")).alias("reply_path"),
            F.coalesce(F.col("n_quotes"), F.lit(0)).alias("n_quotes"),
            content.alias("content"),
            F.concat(F.lit("<|"), F.coalesce(F.col("role"), F.lit("")), F.lit("|>\n"), content).alias("formatted"),
        )
        .orderBy("conv_id", "reply_path", "role", "content")
    )


def _reply_paths(linked: DataFrame) -> DataFrame:
    """conv_id, turn, msg, parent_turn, path: path from the thread's first turn, by pointer doubling.

    ``linked`` has the replies only. Where a turn is repeated, replies to it follow its earliest
    link, so that every turn has one path.
    """
    hop = linked.groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("up"))
    hop = materialize(hop.select("conv_id", "turn", "up", F.array("up", "turn").alias("path"), F.lit(True).alias("open")))
    while hop.where("open").limit(1).count():
        above = hop.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("open").alias("open2"))
        hop = materialize(
            hop.join(above, ["conv_id", "up"], "left").select(
                "conv_id",
                "turn",
                F.coalesce("up2", "up").alias("up"),
                F.when(
                    F.col("open") & F.col("path2").isNotNull(), F.concat("path2", F.slice("path", 2, F.size("path")))
                ).otherwise(F.col("path")).alias("path"),
                (F.col("open") & F.col("path2").isNotNull()).alias("open"),
            )
        )
    return linked.join(hop.select("conv_id", "turn", "path"), ["conv_id", "turn"])
