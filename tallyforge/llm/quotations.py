"""Chat formatting by quotation linking, in SQL functions alone.

A line that starts with ``>`` is quoted, as deeply as it has such marks. Adjacent lines of one depth form passages,
parted by blank lines. A passage and each of its lines is normalised (lower case, white space as one space) and
hashed. A quoted hash is linked to the latest earlier message of the conversation that holds it unquoted, by one sort
of holders and quoters together, which stays linear where a line is very common. A message replies to the message
that most of its first-level quotes come from. Conversations are ordered by thread: a thread is a message that replies
to none with all that reply to it, directly or not, in the order of turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, unused

def drill(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``messages`` with planted quotes: by the first hexadecimal digit of an md5 of conversation and turn, half of the messages begin
    with the first line of the turn before, quoted, and half of those with that of the turn before it too, quoted twice. Rows without conversation or turn stay as they are; of
    several messages of one turn the least line is quoted, and a blank line isn't."""
    line = F.trim(F.substring_index(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n"), "\n", 1))
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    c, t, own, one, two = (unused(messages, n) for n in ("c", "t", "line", "line1", "line2"))
    first = messages.select(conv.alias(c), turn.alias(t), line.alias(own)).filter(F.col(c).isNotNull() & F.col(t).isNotNull() & (F.col(own) != "")).groupBy(c, t).agg(F.min(own).alias(own))
    rows = messages.withColumn(c, conv).withColumn(t, turn)
    for back, name in ((1, one), (2, two)):
        rows = rows.join(first.select(c, (F.col(t) + back).alias(t), F.col(own).alias(name)), [c, t], "left")
    digit = F.substring(F.md5(F.concat_ws("|", F.col(c).cast("string"), F.col(t).cast("string")).cast("binary")), 1, 1)
    quotes = F.concat(F.when(F.col(two).isNotNull() & (digit < "4"), F.concat(F.lit(">> "), two, F.lit("\n"))).otherwise(""), F.when(F.col(one).isNotNull() & (digit < "8"), F.concat(F.lit("> "), one, F.lit("\n"))).otherwise(""))
    rows = rows.withColumn(text_col, F.when(quotes == "", F.col(text_col)).otherwise(F.concat(quotes, F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))))
    return rows.select(*messages.columns)


MARK = r"^\s*(?:>\s?)+"


def parsed(messages: DataFrame) -> DataFrame:
    """Adds lines (an array of depth and text), clean (the text without quotes) and quote_levels."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    line = F.transform(lines, lambda s: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(s, MARK, 0), "[^>]", "")).alias("depth"),
        F.regexp_replace(s, MARK, "").alias("text")))
    out = messages.withColumn("lines", line)
    clean = F.array_join(F.transform(F.filter("lines", lambda x: x["depth"] == 0), lambda x: x["text"]), "\n")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\n[ \t]*(?:\n[ \t]*)+\n?", "\n\n"), r"^\s+|\s+$", "")
    plain = F.when(F.exists("lines", lambda x: x["depth"] > 0), clean).otherwise(F.coalesce("text", F.lit("")))
    return out.withColumn("clean", plain).withColumn("quote_levels", F.coalesce(F.array_max(F.transform("lines", lambda x: x["depth"])), F.lit(0)))


def normal(text) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(lines: DataFrame) -> DataFrame:
    """(key columns, depth, passage): each line, and each run of lines of one depth without a blank line."""
    own = F.transform("lines", lambda x, i: F.struct(x["depth"].alias("depth"), normal(x["text"]).alias("text"), i.alias("i")))
    out = lines.withColumn("own", own)
    # the start of a line's run: the last line before it that is blank or of another depth
    breaks = F.filter("own", lambda x: (x["text"] == "") | (x["i"] == 0) | (F.element_at("own", F.greatest(x["i"], F.lit(1)))["depth"] != x["depth"]) | (F.element_at("own", F.greatest(x["i"], F.lit(1)))["text"] == ""))
    starts = F.transform(breaks, lambda x: x["i"])
    out = out.withColumn("starts", starts).withColumn("own_lines", F.filter("own", lambda x: x["text"] != ""))
    runs = F.transform("starts", lambda s, j: F.slice("own", s + 1, F.coalesce(F.try_element_at("starts", j + 2), F.size("own")) - s))
    whole = F.transform(runs, lambda r: F.struct(F.element_at(r, 1)["depth"].alias("depth"), F.array_join(F.filter(F.transform(r, lambda x: x["text"]), lambda t: t != ""), " ").alias("text")))
    single = F.transform("own_lines", lambda x: F.struct(x["depth"].alias("depth"), x["text"].alias("text")))
    every = F.array_distinct(F.concat(F.filter(whole, lambda x: x["text"] != ""), single))
    return out.select("conv_id", "turn", F.explode(every).alias("p")).select("conv_id", "turn", F.col("p.depth").alias("depth"), F.unhex(F.md5("p.text")).alias("passage"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, depth, source_turn, passages): how many quoted passages of a depth come from which message, or from none.

    What is dealt out is hashes, by conversation and passage, once; no text is.
    """
    every = passages(messages).repartition("conv_id", "passage").distinct()
    before = Window.partitionBy("conv_id", "passage").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    source = F.max(F.when(F.col("depth") == 0, F.col("turn"))).over(before)
    return every.withColumn("source_turn", source).filter("depth > 0").groupBy("conv_id", "turn", "depth", "source_turn").agg(F.count("*").alias("passages"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn) of messages that reply, by pointer jumping: the depth halves with each step."""
    at = cut(replies.select("conv_id", "turn", F.col("reply_to").alias("root_turn")))
    while at.head(1):
        up = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"))
        step = cut(at.join(up, ["conv_id", "root_turn"], "left"))
        at = step.select("conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"))
        if not step.filter("next is not null").head(1):
            break
    return at


def link_conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, position, turn, role, reply_to, root_turn, quote_levels, n_quoted, n_linked, text, formatted): a row
    for each message, in reply order by position (from 1), its text without quotes.

    formatted is the text between chat marks that name the role. n_quoted counts quoted lines and passages that
    differ, n_linked those found in an earlier message. A message without a linked first-level quote starts a thread. Null text counts as empty, a null
    role as ``unknown``. Rows with a null conversation or turn keep their text, quote nothing and are quoted by none;
    null turns come last. Messages that repeat a turn are one turn for links, and stand beside each other in the order
    of role and text. Messages stay rows: a conversation of any length is never gathered in one.
    """
    picked = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.col(text_col).cast("string").alias("text"))
    known = parsed(picked.filter("conv_id is not null and turn is not null"))
    found = cut(links(known.select("conv_id", "turn", "lines")))
    there = F.col("source_turn").isNotNull()
    linked = found.groupBy("conv_id", "turn").agg(F.sum("passages").alias("n_quoted"), F.sum(F.when(there, F.col("passages"))).alias("n_linked"), F.max(F.when(there & (F.col("depth") == 1), F.struct("passages", "source_turn")))["source_turn"].alias("reply_to"))
    root = threads(linked.filter("reply_to is not null"))
    facts = linked.join(root, ["conv_id", "turn"], "left")
    out = picked.join(facts, ["conv_id", "turn"], "left").withColumn("root_turn", F.coalesce("root_turn", "turn"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("root_turn"), F.asc_nulls_last("turn"), "role", F.coalesce("text", F.lit("")))
    # texts are parsed again after they were dealt out and sorted, as their parts would be as large as they are
    out = parsed(out.withColumn("position", F.row_number().over(order).cast("long")))
    zero = F.lit(0).cast("long")
    return out.select("conv_id", "position", "turn", "role", "reply_to", "root_turn", F.col("quote_levels").cast("long").alias("quote_levels"), F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"), F.col("clean").alias("text"), F.concat(F.lit("<|"), "role", F.lit("|>\n"), "clean", F.lit("\n<|end|>\n")).alias("formatted"))
