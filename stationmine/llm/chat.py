"""Chat formatting with Spark expressions only (operator 1).

A conversation becomes one string:

    <s>[INST]hello[/INST]hi</s>[ROLE]tool[SEP]42[/ROLE]

Blocks are runs of turns of one role, merged; turns inside a block are parted by ``[TURN]``. User, system
and assistant have marks of their own, any other role is written out. Control strings inside
texts and roles get a backslash behind their first character, and those that have backslashes there already one more,
so that nothing a text holds can pass for a mark and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
TURN = "[TURN]"
#: role → marks before and after its block.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ASST]", "</s>")}
OTHER = ("[ROLE]", "[SEP]", "[/ROLE]")
_TAILS = r"(s>|/s>|/?INST\]|/?SYS\]|ASST\]|TURN\]|/?ROLE\]|SEP\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_TAILS}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_TAILS}", r"$1$2$3")


def _segments(block: Column) -> Column:
    """A block as segments (text, loss): marks and other roles carry no loss."""
    role = block["role"]
    before, after = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (left, right) in MARKS.items():
        before = F.when(role == name, F.lit(left)).otherwise(before)
        after = F.when(role == name, F.lit(right)).otherwise(after)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    inner = F.transform(
        block["texts"],
        lambda t, i: F.array(
            segment(F.when(i > 0, F.lit(TURN)).otherwise(F.lit("")), F.lit(False)),
            segment(escape(t), role == "assistant"),
        ),
    )
    return F.concat(F.array(segment(before, F.lit(False))), F.flatten(inner), F.array(segment(after, F.lit(False))))


def _merged(turns: Column) -> Column:
    """Runs of one role. Where runs begin is gathered by an array aggregation; slices then cut them out,
    so texts are not copied once per turn."""
    begins = F.aggregate(
        F.sequence(F.lit(1), F.size(turns)),
        F.array().cast("array<int>"),
        lambda held, i: F.when(
            (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
            F.concat(held, F.array(i)),
        ).otherwise(held),
    )
    ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(turns) + 1))
    return F.zip_with(
        begins,
        ends,
        lambda b, e: F.struct(
            F.element_at(turns, b)["role"].alias("role"),
            F.transform(F.slice(turns, b, e - b), lambda t: t["text"]).alias("texts"),
        ),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conv_id: ``formatted``, and ``segments`` (text, loss), whose texts make up ``formatted``.

    The loss mask covers exactly the texts of assistant turns. Rows are ordered by turn, then role,
    then text; null turns come first. Null role or text: empty. Repeated rows are turns of their
    own. A null conv_id is one conversation. Only conv_id, turn, role and text are read. No rows:
    no rows. A conversation is one row of the result, so it has to fit into a row.
    """
    ordered = F.sort_array(
        F.collect_list(
            F.struct(
                F.col("turn").cast("long").alias("turn"),
                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            )
        )
    )
    return (
        turns.groupBy("conv_id")
        .agg(ordered.alias("turns"))
        .select("conv_id", _merged(F.col("turns")).alias("blocks"))
        .select("conv_id", F.flatten(F.transform("blocks", _segments)).alias("segments"))
        .select(
            "conv_id",
            F.concat(F.lit(BEGIN), F.array_join(F.transform("segments", lambda s: s["text"]), "")).alias("formatted"),
            "segments",
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    ends = "|".join([r"\[/SYS\]", r"\[/INST\]", "</s>", r"\[/ROLE\]"])
    blocks = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), ends, -1)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def block(b: Column) -> Column:
        cut = F.split(b, r"^\[ROLE\]|\[SEP\]", 3)
        role = F.when(b.startswith(OTHER[0]), unescape(F.element_at(cut, 2)))
        body = F.when(b.startswith(OTHER[0]), F.element_at(cut, 3))
        for name, (left, _) in MARKS.items():
            role = F.when(b.startswith(left), F.lit(name)).otherwise(role)
            body = F.when(b.startswith(left), F.substring(b, len(left) + 1, 2**31 - 1)).otherwise(body)
        return F.transform(
            F.split(body, r"\[TURN\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, block))


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")
