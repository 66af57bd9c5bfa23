"""Quotation linking for chats: quoted passages are found, joined to the messages they come from, and taken out.

A line is quoted as deep as it has ">" marks at its start.  Neighbouring lines of one depth are a passage.
Passages are normalised (lower case, letters and digits only) and hashed; a passage belongs to the latest
earlier message of its conversation that holds the same text as its own words.  Where there is none, each
of its lines and paragraphs names the latest earlier message that holds it, and the message that most of
them name is taken, the latest on ties; so a quotation that was shortened, edited or wrapped anew is found
again.  Conversations are rebuilt without quotes, every message after the one it replies to.

Everything is DataFrame functions.  Looking up the latest earlier message is two-level: messages are
grouped by blocks of BLOCK_TURNS turns, blocks carry their latest message on, so one conversation or one
passage that holds most rows is spread over tasks.

Defined results: a null text is an empty message; rows with a null conversation or turn are kept without
links, positions and replies; rows that repeat conversation and turn share a position's block and are
numbered by role and text; a passage without letters or digits links to nothing; rows of equal text in a
turn are equal sources; very long messages are single rows like others; an empty table gives no rows; other
columns are not read, so they cannot clash.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgate.llm.store import saved

BLOCK_TURNS = 512
#: Messages of one formatted piece of a conversation.
PIECE_MESSAGES = 256
_MARKS = r"^((?:[ \t]*>)+)"
#: A line that only announces a quotation.
_ANNOUNCED = r"^[^>].*:\s*$"


def normalised(text):
    """Lower case, words of letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _key(text):
    """Hash of a normalised text; null where nothing is left of it."""
    return F.when(text != "", F.md5(text.cast("binary")))


def parsed(messages):
    """conv_id, turn, role, message (hash of the text), lines array<struct<depth, body>>, own text."""
    line = F.transform(
        F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), r"[^>]", "")).alias("depth"),
            F.regexp_replace(x, _MARKS + r"[ \t]?", "").alias("body")))
    rows = messages.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("message"), line.alias("lines"))
    n = F.size("lines")
    own = F.filter(
        F.transform("lines", lambda x, i: F.struct(
            x["depth"].alias("depth"), x["body"].alias("body"),
            (x["body"].rlike(_ANNOUNCED) & (F.try_element_at("lines", F.least(i + 2, n))["depth"] > 0)).alias("announces"))),
        lambda x: (x["depth"] == 0) & ~x["announces"])
    text = F.array_join(F.transform(own, lambda x: x["body"]), "\n")
    quoted = F.exists("lines", lambda x: x["depth"] > 0)
    return rows.select("*", F.when(quoted, F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")).otherwise(text).alias("own"), quoted.alias("quotes"))


def passages(rows):
    """One row per quoted passage: conv_id, turn, message, passage number, depth, key of the whole and keys of its lines and paragraphs."""
    quoting = rows.where("quotes and conv_id is not null and turn is not null").select("conv_id", "turn", "message", "lines").distinct()
    marked = quoting.select("conv_id", "turn", "message", F.transform("lines", lambda x, i: F.struct(
        i.alias("i"), x["depth"].alias("depth"), x["body"].alias("body"),
        (F.coalesce(F.try_element_at("lines", F.greatest(i, F.lit(1)))["depth"], F.lit(-1)) != x["depth"]).alias("new"))).alias("lines"))
    lines = marked.select("conv_id", "turn", "message", F.inline("lines"))
    by_message = Window.partitionBy("conv_id", "turn", "message").orderBy("i")  # the lines of one message
    numbered = lines.withColumn("passage", F.sum((F.col("new") | (F.col("i") == 0)).cast("int")).over(by_message)).where("depth > 0")
    numbered = numbered.withColumn("plain", normalised(F.col("body")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("i", "plain"))), lambda x: x["plain"])
    grouped = numbered.groupBy("conv_id", "turn", "message", "passage", "depth").agg(said.alias("said"))
    return grouped.select(
        "conv_id", "turn", "message", "passage", "depth", _key(normalised(F.array_join("said", " "))).alias("whole"),
        _keys(F.concat("said", F.split(F.array_join("said", "\n"), r"\n{2,}", -1))).alias("parts"))


def _keys(texts):
    """Distinct keys of texts, without those of which nothing is left."""
    return F.array_distinct(F.array_compact(F.transform(texts, lambda x: _key(normalised(x)))))


def sources(rows, quoting):
    """conv_id, turn, key: the whole own text, every own line and paragraph of messages in conversations that quote."""
    own = rows.where("conv_id is not null and turn is not null").join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    texts = F.array_append(F.concat(F.split("own", "\n", -1), F.split("own", r"\n\s*\n", -1)), F.col("own"))
    return own.select("conv_id", "turn", F.explode(_keys(texts)).alias("key")).distinct()


def latest_before(asks, known):
    """For (conv_id, turn, key) rows, ``source``: the latest turn of an equal key that is earlier, or null."""
    both = asks.select("conv_id", "turn", "key", F.lit(True).alias("ask")).distinct().unionByName(
        known.select("conv_id", "turn", "key", F.lit(False).alias("ask")))
    both = both.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    tops = both.where("not ask").groupBy("conv_id", "key", "block").agg(F.max("turn").alias("top"))
    blocks = both.where("ask").select("conv_id", "key", "block").distinct().join(tops, ["conv_id", "key", "block"], "full")
    carried = blocks.select("conv_id", "key", "block", F.max("top").over(
        Window.partitionBy("conv_id", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("conv_id", "key", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.max(F.when(~F.col("ask"), F.col("turn"))).over(inside)).where("ask")
    return found.join(carried, ["conv_id", "key", "block"], "left").select(
        "conv_id", "turn", "key", F.coalesce("near", "carried").alias("source"))


def numbered(rows):
    """Gapless position of each message in its conversation, and the turn of the message before it."""
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "message")
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.max("last").over(earlier).alias("last"))
    near = F.max("turn").over(Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("place", F.row_number().over(inside)).withColumn("near", near).join(starts, ["conv_id", "block"])
    return placed.withColumn("position", F.col("before") + F.col("place") - 1).withColumn(
        "previous", F.coalesce("near", "last")).drop("block", "place", "near", "before", "last")


def linked(messages):
    """One row per message in reply order: conv_id, turn, role, position, reply_to, n_passages, n_linked, depth, own text.

    ``reply_to`` is the latest message that an outer quotation comes from, or else the turn before.
    """
    rows = saved(parsed(messages), "messages")
    quoted = saved(passages(rows), "passages")
    known = sources(rows, quoted)
    keys = F.array_distinct(F.array_compact(F.array_append("parts", F.col("whole"))))
    asks = quoted.select("conv_id", "turn", F.explode(keys).alias("key"))
    origin = saved(latest_before(asks, known).where("source is not null"), "origins")
    passage = ["conv_id", "turn", "message", "passage"]
    named = quoted.select(*passage, F.explode("parts").alias("key")).join(origin, ["conv_id", "turn", "key"]).groupBy(*passage, "source").agg(
        F.count("*").alias("n"))
    voted = named.groupBy(*passage).agg(F.max_by("source", F.struct("n", "source")).alias("voted"))
    whole = origin.select("conv_id", "turn", F.col("key").alias("whole"), F.col("source").alias("whole_source"))
    found = quoted.join(whole, ["conv_id", "turn", "whole"], "left").join(voted, passage, "left")
    found = found.withColumn("source", F.coalesce("whole_source", "voted"))
    links = found.groupBy("conv_id", "turn", "message").agg(
        F.count("*").alias("n_passages"), F.count("source").alias("n_linked"), F.max("depth").alias("depth"),
        F.max(F.when(F.col("depth") == 1, F.col("source"))).alias("outer_source"))
    placed = numbered(rows.where("conv_id is not null and turn is not null").drop("lines", "quotes"))
    loose = rows.where("conv_id is null or turn is null").drop("lines", "quotes")
    merged = placed.join(links, ["conv_id", "turn", "message"], "left").unionByName(loose, allowMissingColumns=True)
    return merged.select(
        "conv_id", "turn", "role", F.col("position").cast("long").alias("position"),
        F.coalesce("outer_source", "previous").cast("long").alias("reply_to"),
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.col("own").alias("text"))


def formatted(messages, pattern="<|%s|>\n%s\n"):
    """conv_id, piece, chat: conversations without quotes, PIECE_MESSAGES messages a row, in reply order."""
    rows = linked(messages).where("position is not null")
    turn = F.format_string(pattern, F.coalesce("role", F.lit("")), "text")
    piece = rows.select("conv_id", F.floor(F.col("position") / PIECE_MESSAGES).alias("piece"), "position", turn.alias("chat"))
    return piece.groupBy("conv_id", "piece").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "chat"))), lambda x: x["chat"]), "").alias("chat"))
