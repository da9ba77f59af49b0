"""Chat formatting with a grammar round trip, with DataFrame functions only.

Grammar: a conversation is a run of turns, a turn is ``<s>[INST]role[/INST]text</s>``, or with
``[INST!]`` where role and text are escaped; neither may hold a control string.  Rendering starts
plain.  The output is parsed again and compared with the source; where it differs, turns that hold a
control string are escaped, then all turns, until the recovered turns are identical.  Escaping is a
backslash before the second character of a control string and before every backslash, so it is undone by dropping
one backslash before each character.

Defined results: null role or text is empty; rows are ordered by turn, role and text, null turns first;
rows of a null conv_id are one conversation.  A conversation is one value, as its digest needs it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[INST!]", "[/INST]")
_CONTROL = r"</?s>|\[INST!?\]|\[/INST\]"
_TURN = r"(?s)^<s>\[INST(!?)\](.*?)\[/INST\](.*)$"
LEVELS = 3


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column, level: int) -> Column:
    """The whole conversation; level 0 escapes nothing, 1 what conflicts, 2 every turn."""

    def one(turn: Column) -> Column:
        role, text = turn["role"], turn["text"]
        plain = F.concat(F.lit("<s>[INST]"), role, F.lit("[/INST]"), text, F.lit("</s>"))
        safe = F.concat(F.lit("<s>[INST!]"), escape(role), F.lit("[/INST]"), escape(text), F.lit("</s>"))
        if level == 0:
            return plain
        return safe if level == 2 else F.when(role.rlike(_CONTROL) | text.rlike(_CONTROL), safe).otherwise(plain)

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; null where it does not follow the grammar."""
    pieces = F.split(formatted, "</s>")
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def one(piece: Column) -> Column:
        safe = F.regexp_extract(piece, _TURN, 1) == "!"
        role, text = F.regexp_extract(piece, _TURN, 2), F.regexp_extract(piece, _TURN, 3)
        sound = piece.rlike(_TURN) & ~role.rlike(_CONTROL) & ~text.rlike(_CONTROL)
        pick = lambda x: F.when(safe, unescape(x)).otherwise(x)
        return F.when(sound, F.struct(pick(role).alias("role"), pick(text).alias("text")))

    found = F.transform(turns, one)
    whole = (F.element_at(pieces, -1) == "") & ~F.exists(found, lambda t: t.isNull())
    return F.when(whole, found)


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, the formatted text, the level it took and the turns read back from it.

    A conversation that no level brings back identical stops the query; escaping is exact, so none can.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    chats = chats.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    out, tried = chats.withColumn("formatted", F.lit(None).cast("string")).withColumn("level", F.lit(None).cast("int")), "formatted"
    for level in range(LEVELS):
        out = out.withColumn("trial", F.when(F.col(tried).isNull(), render(F.col("turns"), level)))
        same = F.col("trial").isNotNull() & F.coalesce(parse(F.col("trial")) == F.col("turns"), F.lit(False))
        out = out.withColumn("same", same)
        out = out.withColumn("level", F.when(F.col("same"), F.lit(level)).otherwise(F.col("level")))
        out = out.withColumn("formatted", F.when(F.col("same"), F.col("trial")).otherwise(F.col("formatted")))
    failed = F.raise_error(F.concat(F.lit("conversation cannot be read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    out = out.withColumn("formatted", F.when(F.col("formatted").isNotNull(), F.col("formatted")).otherwise(failed.cast("string")))
    return out.select("conv_id", "formatted", "level", parse(F.col("formatted")).alias("turns"))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: the assistant's, unescaped, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("turns"))
    return chats.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
