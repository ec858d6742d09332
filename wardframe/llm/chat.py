r"""Chat formatting that is proved by reading it back.

A conversation's turns, in order, become one text in which every turn stands
between the marks of its role:

    user [INST] .. [/INST]   assistant <s>..</s>   system <<SYS>>..<</SYS>>
    any other role [ROLE hex-of-role] .. [/ROLE]

The grammar is regular, so one pattern parses a text deterministically.  A
block of turns is first rendered as it is and parsed again; if the turns that
come back differ from the source, its control strings are escaped and the
comparison repeated; a block that is not identical then fails the job.  The
escape puts one backslash after the first character
of every control string, however many stand there already; reading removes
one.  Only DataFrame and SQL functions are used.

Defined results: a null text or role is empty; turns are ordered by (turn,
role, text), null turns first; rows that repeat a turn are turns of their own;
a null conv_id is a conversation.  Turns are rendered in blocks of
``BLOCK_TURNS``, so a large conversation is shared out among tasks until its
finished blocks are put together to the one row it has in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 32
#: The block of turns without a number, before every other one.
FIRST_BLOCK = -(2**62)

#: What follows the first character of a control string.
CONTROL = r"(?=/?INST\]|/?s>|</?SYS>>|/?ROLE)"
ESCAPE = (r"([\[<])(\\*)" + CONTROL, r"$1\\$2")
UNESCAPE = (r"([\[<])\\(\\*)" + CONTROL, r"$1$2")
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE [0-9A-F]*\] .*? \[/ROLE\]"

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER_END = " [/ROLE]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _render(turn: Column, escape: bool) -> Column:
    text = escaped(turn["text"]) if escape else turn["text"]
    other = F.concat(F.lit("[ROLE "), F.hex(F.encode(turn["role"], "UTF-8")), F.lit("] "), text, F.lit(OTHER_END))
    out = None
    for role, (begin, end) in MARKS.items():
        marked = F.concat(F.lit(begin), text, F.lit(end))
        is_role = turn["role"] == role
        out = F.when(is_role, marked) if out is None else out.when(is_role, marked)
    return out.otherwise(other)


def render(turns: Column, escape: bool) -> Column:
    return F.array_join(F.transform(turns, lambda t: _render(t, escape)), "")


def marks(found: Column) -> Column:
    """Role, begin and end mark lengths of one parsed turn."""
    out = None
    for role, (begin, end) in MARKS.items():
        value = F.struct(F.lit(role).alias("role"), F.lit(len(begin)).alias("begin"), F.lit(len(end)).alias("end"))
        starts = F.startswith(found, F.lit(begin))
        out = F.when(starts, value) if out is None else out.when(starts, value)
    code = F.regexp_extract(found, r"^\[ROLE ([0-9A-F]*)\] ", 1)
    return out.otherwise(
        F.struct(
            F.decode(F.unhex(code), "UTF-8").alias("role"),
            (F.length(code) + F.lit(len("[ROLE ] "))).alias("begin"),
            F.lit(len(OTHER_END)).alias("end"),
        )
    )


def _turn(found: Column) -> Column:
    bound = F.transform(F.array(marks(found)), lambda m: F.struct(
        m["role"].alias("role"),
        unescaped(F.substring(found, m["begin"] + 1, F.length(found) - m["begin"] - m["end"])).alias("text"),
    ))
    return bound[0]


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text as they stand there."""
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns read back from a formatted text."""
    return F.transform(pieces(formatted), _turn)


def _let(value: Column, function) -> Column:
    """``function`` of a value that is computed once."""
    return F.transform(F.array(value), function)[0]


def _until_identical(turns: Column) -> Column:
    """struct(text, escaped, identical) for a block of turns."""

    def attempt(escape: bool, otherwise) -> Column:
        def judged(text: Column) -> Column:
            whole = F.length(F.array_join(pieces(text), "")) == F.length(text)
            same = whole & (parse(text) == turns)
            result = F.struct(text.alias("text"), F.lit(escape).alias("escaped"), same.alias("identical"))
            return result if otherwise is None else F.when(same, result).otherwise(otherwise)

        return _let(render(turns, escape), judged)

    return attempt(False, attempt(True, None))


def format_chats(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_col, formatted, escaped, identical, mask): ``mask`` has, per turn,
    the characters before, under and after the loss mask; only assistant texts
    are under it."""
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv_col).alias("conv"),
        F.coalesce(F.floor(F.col(turn_col).cast("long") / BLOCK_TURNS), F.lit(FIRST_BLOCK)).alias("block"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col), empty).alias("role"),
            F.coalesce(F.col(text_col), empty).alias("text"),
        ).alias("t"),
    )
    blocks = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shaped = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    done = blocks.select("conv", "block", _let(shaped, _until_identical).alias("b"))
    whole = done.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("block", "b.text"))).alias("blocks"),
        F.max("b.escaped").alias("escaped"),
        F.min("b.identical").alias("identical"),
    )
    joined = F.array_join(F.transform("blocks", lambda b: b["text"]), "")
    proved = F.when(F.col("identical"), joined).otherwise(F.raise_error(F.lit("a conversation did not come back from its text")))
    text = whole.select(F.col("conv").alias(conv_col), proved.alias("formatted"), "escaped", "identical")

    def masked(found: Column) -> Column:
        def parts(m: Column) -> Column:
            body = F.length(found) - m["begin"] - m["end"]
            own = m["role"] == "assistant"
            return F.struct(
                F.when(own, m["begin"]).otherwise(F.length(found)).alias("before"),
                F.when(own, body).otherwise(0).alias("under"),
                F.when(own, m["end"]).otherwise(0).alias("after"),
            )

        return _let(marks(found), parts)

    return text.withColumn("mask", F.transform(pieces(F.col("formatted")), masked))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The runs of a formatted text that lie under its loss mask, unescaped.
    The mask's lengths have to cover the text turn by turn."""
    def cut(found: Column, m: Column) -> Column:
        whole = F.length(found) == m["before"] + m["under"] + m["after"]
        run = unescaped(F.substring(found, m["before"] + 1, m["under"]))
        return F.when(whole, run).otherwise(F.raise_error(F.lit("a loss mask does not cover its text")))

    return F.zip_with(pieces(formatted), mask, cut)


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests of the turns that a formatted text gives back, and of
    what its loss mask cuts out of it."""
    read = formatted.select(
        conv_col, "formatted", parse(F.col("formatted")).alias("turns"),
        F.array_join(under_mask(F.col("formatted"), F.col("mask")), "").alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    texts = read.select(
        conv_col, "formatted", F.size("turns").cast("long").alias("n_turns"), F.array_join(lines, "").alias("all"), "loss",
    )
    return texts.select(
        conv_col, "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
