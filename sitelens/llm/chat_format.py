"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template, one block a turn::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Grammar of the escapes: in a text every ``<``, run of backslashes, ``|`` carries
one backslash more than in the source, so no control string can occur in it; a
role also has its backslashes doubled and its line feeds written ``\\n``.  The
parser always undoes this, which is reversible for every string.

A conversation is first rendered as it is.  A deterministic parser reads the
rendered text back and its turns are compared with the source; if they differ,
the conflicting texts are escaped and the round is repeated.  One round is enough
by the grammar; a conversation that still differs raises an error rather than
being written wrong.

The loss mask covers the texts (not the markers) of the trained roles, as spans
``(block, start, length)``: the turn's number and code points of the formatted string.

Rows of a conversation are gathered by one aggregation on ``conv_id``; a
conversation is one output string, so its turns have to meet.  Everything else is
row by row and linear in the conversation's length.

Defined cases: null text or role is empty; turns are ordered by ``turn`` (null
first), then role, then text, and repeated rows stay; a null ``conv_id`` is a
conversation of its own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of the template.
START, END = "<|im_start|>", "<|im_end|>"

OPEN = r"<(\\*)\|"  # what a control string or an escaped one begins with
ESCAPED = r"<\\(\\*)\|"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, OPEN, r"<\\$1|")


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, r"<$1|")


def escape_role(c: Column) -> Column:
    doubled = F.replace(escape_text(c), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    parts = F.split(c, r"\\\\", -1)  # at every pair of backslashes, left to right
    return unescape_text(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"))


def render(turns: Column) -> Column:
    """``turns``: array of (role, text) already fit for the template."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), ""
    )


def blocks(formatted: Column) -> Column:
    """The parser's first step: what stands between the start markers."""
    return F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != "")


def parse(formatted: Column) -> Column:
    """Array of (role, text) that the grammar reads in a formatted string.

    A block without its line feed or end marker yields a turn no source has, so a
    malformed string never compares equal by accident.
    """

    def turn(b: Column) -> Column:
        cut = F.instr(b, "\n")
        body = F.substring(b, cut + 1, F.length(b))
        tail = len(END) + 1
        text = F.when(
            (cut > 0) & body.endswith(END + "\n") & ~F.contains(F.substring(body, F.lit(1), F.length(body) - tail), F.lit(END)),
            F.substring(body, F.lit(1), F.length(body) - tail),
        )
        return F.struct(
            F.coalesce(unescape_role(F.substring(b, F.lit(1), cut - 1)), F.lit("")).alias("role"),
            F.coalesce(unescape_text(text), F.concat(F.lit(START), b)).alias("text"),
        )

    return F.transform(blocks(formatted), turn)


def gather(conversations: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id`` and its ``turns`` (role, text) in order."""
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    return rows.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def format_chats(conversations: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss_spans, escaped`` for every conversation.

    ``escaped`` tells whether the first round failed and texts were escaped.
    """
    convs = gather(conversations)
    first = convs.withColumn("plain", render(F.col("turns")))
    first = first.withColumn("escaped", parse(F.col("plain")) != F.col("turns"))
    fit = first.withColumn(
        "fit",
        F.when(
            F.col("escaped"),
            F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape_text(t["text"]).alias("text"))),
        ).otherwise(F.col("turns")),
    )
    second = fit.withColumn("formatted", F.when(F.col("escaped"), render(F.col("fit"))).otherwise(F.col("plain")))
    checked = second.withColumn(
        "formatted",
        F.when(~F.col("escaped") | (parse(F.col("formatted")) == F.col("turns")), F.col("formatted")).otherwise(
            F.raise_error(F.concat(F.lit("conversation does not survive the round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
        ),
    )
    sized = checked.withColumn("sizes", F.transform("fit", _block_chars))
    # starts are sums of the sizes before; integers only, nothing is copied
    starts = F.transform(
        F.sequence(F.lit(1), F.size("sizes")),
        lambda i: F.aggregate(F.slice("sizes", F.lit(1), i - 1), F.lit(0).cast("bigint"), lambda acc, n: acc + n),
    )
    spans = F.transform(
        F.arrays_zip(F.col("fit"), F.col("starts"), F.sequence(F.lit(0), F.size("fit") - 1).alias("nr")),
        lambda z: F.struct(
            z["nr"].alias("block"),
            (z["starts"] + F.length(z["fit"]["role"]) + len(START) + 1).alias("start"),
            F.length(z["fit"]["text"]).cast("bigint").alias("length"),
            unescape_role(z["fit"]["role"]).alias("role"),
        ),
    )
    trained = F.array(*[F.lit(r) for r in trained_roles])
    return sized.withColumn("starts", starts).select(
        "conv_id",
        "formatted",
        F.transform(
            F.filter(spans, lambda z: F.array_contains(trained, z["role"])),
            lambda z: F.struct(z["block"].alias("block"), z["start"].alias("start"), z["length"].alias("length")),
        ).alias("loss_spans"),
        "escaped",
    )


def _block_chars(t: Column) -> Column:
    markers = len(START) + 1 + len(END) + 1
    return (F.length(t["role"]) + F.length(t["text"]) + markers).cast("bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Recover from formatted rows their ``turns`` and the ``loss_text`` (array).

    The text of a span is taken from its block, so reading stays linear in the
    length of the formatted string however many spans there are.
    """
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    return parsed.withColumn(
        "loss_text", F.transform("loss_spans", lambda s: F.get(F.col("turns"), s["block"])["text"])
    )
