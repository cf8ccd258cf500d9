r"""Chat formatting that is proven to read back.

A conversation becomes one text of turns ``### role: text</turn>`` and a line end. The grammar's
control strings are ``### `` and ``</turn>``. A deterministic parser cuts a text at every control
string, so it reads ``n`` turns only from exactly ``n`` marked turns. A conversation is rendered as it
is and parsed; if the turns that come back differ from the source, it is rendered again with more
escaping, first of the texts, then of the roles as well, until they are identical. Escaping puts a
backslash behind the first character of a control string (``<\/turn>``), or one more where there are
backslashes already (``<\\/turn>``), and the parser takes one off; so escaping is reversible whatever a
text holds, and the last level always reads back. If it ever did not, the query would fail.

All of it is DataFrame expressions. A conversation is one row, since its format is one text: its turns
meet in one task, which is the size of that text and no more.

Defined results: a null text or role is an empty one; turns are ordered by ``turn``, then role, then
text, a null ``turn`` first; repeated rows are turns like any other; rows with a null ``conv_id`` are one
conversation. Very long texts are whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's fixed strings.
TURN_START, ROLE_END, TURN_END, BETWEEN = "### ", ": ", "</turn>", "\n"

_CUT = "### |</turn>"
_RAW = r"([#<])(\\*(?:## |/turn>))"
_ESCAPED = r"([#<])\\(\\*(?:## |/turn>))"
_RAW_ROLE_END = r"(:)(\\* )"
_ESCAPED_ROLE_END = r"(:)\\(\\* )"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _escape_role(role: Column) -> Column:
    return escape(F.regexp_replace(role, _RAW_ROLE_END, r"$1\\$2"))


def _unescape_role(role: Column) -> Column:
    return F.regexp_replace(unescape(role), _ESCAPED_ROLE_END, "$1$2")


def _written(turns: Column, level: int) -> Column:
    """The turns' header and body as they stand in the text; 0: as they are, 1: texts escaped, 2: roles too."""
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(TURN_START), _escape_role(t.role) if level > 1 else t.role, F.lit(ROLE_END)).alias("head"),
            (escape(t.text) if level else t.text).alias("body"),
            (t.role == "assistant").alias("learn"),
        ),
    )


def _joined(written: Column) -> Column:
    return F.array_join(F.transform(written, lambda w: F.concat(w["head"], w["body"], F.lit(TURN_END + BETWEEN))), "")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; a turn without a role has null for it."""
    bodies = F.filter(F.split(formatted, _CUT), lambda _, i: i % 2 == 1)
    return F.transform(
        bodies,
        lambda b: F.struct(
            F.when(F.locate(ROLE_END, b) > 0, _unescape_role(F.substring_index(b, ROLE_END, 1))).alias("role"),
            unescape(b.substr(F.locate(ROLE_END, b) + len(ROLE_END), F.length(b))).alias("text"),
        ),
    )


def _loss_spans(written: Column) -> Column:
    """(start, length) of each assistant body in the formatted text, in code points."""
    tail = len(TURN_END + BETWEEN)
    begin = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")
    )

    def add(acc: Column, w: Column) -> Column:
        start = acc["at"] + F.length(w["head"])
        span = F.struct(start.alias("start"), F.length(w["body"]).cast("long").alias("length"))
        return F.struct(
            (start + F.length(w["body"]) + tail).alias("at"),
            F.when(w["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(written, begin, add, lambda acc: acc["spans"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (the source), formatted, loss_spans and escape_level of each conversation of (conv_id, turn, role, text)."""
    row = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    plain = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_rows")).select(
        "conv_id", F.transform("_rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("turns")
    )

    def reads_back(level: int) -> Column:
        return parse(_joined(_written(F.col("turns"), level))) == F.col("turns")

    level = F.when(reads_back(0), 0).when(reads_back(1), 1).when(reads_back(2), 2)
    levelled = plain.withColumn("escape_level", F.coalesce(level, F.raise_error("a conversation does not read back").cast("int")))
    at = F.col("escape_level")
    written = F.when(at == 0, _written(F.col("turns"), 0)).when(at == 1, _written(F.col("turns"), 1))
    drawn = levelled.withColumn("_written", written.otherwise(_written(F.col("turns"), 2)))
    return drawn.select(
        "conv_id", "turns", _joined(F.col("_written")).alias("formatted"),
        _loss_spans(F.col("_written")).alias("loss_spans"), "escape_level",
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")
