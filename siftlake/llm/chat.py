"""Chat formatting with a grammar that round-trips.

    conversation := turn*
    turn         := "### " role ": " content " </turn>" LF

Inside roles and contents, a backslash before "###", "</turn>" or a backslash (in roles also before
":") takes away its meaning; the parser always undoes that, and takes no content in which a control
string stands without one. A conversation is rendered as it is, parsed again and compared to its
source; if they differ, the turns in conflict are escaped, and then all turns, until they agree.
All of it is DataFrame expressions; rows of one conversation meet in one group, which is its record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm._shared import let, stage

OPEN, CLOSE = "### ", " </turn>\n"
_CONTROL = r"(\\|###|</turn>)"
_ESCAPED = r"\\(\\|###|</turn>)"
_ROLE_CONTROL = r"(\\|###|</turn>|:|\n)"
_ROLE_ESCAPED = r"\\(\\|###|</turn>|:|\n)"
_TURN = r"(?s)\A### ((?:[^\\:]|\\(?:\\|###|</turn>|:|\n))*+): (.*)\z"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def in_conflict(text: Column) -> Column:
    """Whether the parser would read an unescaped text differently, or not at all."""
    return text.contains("\\\\") | text.contains("###") | text.contains("</turn>")


def render(turns: Column, level: int) -> Column:
    """Text of an array of (role, text). level 0: as it is; 1: texts in conflict escaped; 2: all."""

    def one(t: Column) -> Column:
        role = F.regexp_replace(t["role"], _ROLE_CONTROL, r"\\$1")
        text = t["text"] if level == 0 else escape(t["text"]) if level == 2 else F.when(in_conflict(t["text"]), escape(t["text"])).otherwise(t["text"])
        return F.concat(F.lit(OPEN), role, F.lit(": "), text, F.lit(CLOSE))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a formatted text; null if it isn't in the grammar."""
    pieces = F.split(formatted, r" </turn>\n", -1)

    def bad(p: Column) -> Column:
        content = F.regexp_extract(p, _TURN, 2)
        bare = F.regexp_replace(content, _ESCAPED, "")
        return ~p.rlike(_TURN) | bare.contains("###") | bare.contains("</turn>")

    def read(ps: Column) -> Column:
        turns = F.slice(ps, F.lit(1), F.size(ps) - 1)
        good = (F.element_at(ps, -1) == "") & ~F.exists(turns, bad)
        parsed = F.transform(
            turns,
            lambda p: F.struct(
                F.regexp_replace(F.regexp_extract(p, _TURN, 1), _ROLE_ESCAPED, "$1").alias("role"),
                unescape(F.regexp_extract(p, _TURN, 2)).alias("text"),
            ),
        )
        return F.when(good, parsed)

    return let(pieces, read)


def format_conversations(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: conv_id, formatted, escape_level, turns (parsed from formatted again),
    round_trip (they equal the source) and loss_spans (start and length in code points of formatted,
    for the contents of turns of loss_roles).

    Turns go by number, null first; of equal numbers, by role and text; repeated rows are turns each.
    Null roles and texts are empty. Rows with a null id are one conversation. Other columns aren't
    read; an empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), role, text)
    convs = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("all"))
    convs = convs.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))

    def attempt(level: int) -> Column:
        def tried(f: Column) -> Column:
            return let(parse(f), lambda t: F.struct(F.lit(level).alias("escape_level"), f.alias("formatted"), t.alias("turns"), F.coalesce(t == F.col("source"), F.lit(False)).alias("round_trip")))

        return let(render(F.col("source"), level), tried)

    first = let(attempt(0), lambda a: F.when(a["round_trip"], a).otherwise(let(attempt(1), lambda b: F.when(b["round_trip"], b).otherwise(attempt(2)))))
    out = stage(convs, r=first).select("conv_id", "r.*")
    # a turn's content begins after its mark, role and colon, and ends before its close
    def spans(pieces: Column) -> Column:
        return F.aggregate(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("found")),
            lambda a, p: F.struct(
                (a["at"] + F.length(p) + len(CLOSE)).alias("at"),
                F.when(
                    F.regexp_replace(F.regexp_extract(p, _TURN, 1), _ROLE_ESCAPED, "$1").isin(*loss_roles),
                    F.array_append(a["found"], F.struct((a["at"] + F.length(p) - F.length(F.regexp_extract(p, _TURN, 2))).alias("start"), F.length(F.regexp_extract(p, _TURN, 2)).alias("length"))),
                ).otherwise(a["found"]).alias("found"),
            ),
            lambda a: a["found"],
        )

    return stage(out, loss_spans=let(F.split("formatted", r" </turn>\n", -1), spans))


def digests(formatted: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read from the formatted text."""
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return stage(formatted, loss=loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("escape_level").cast("long").alias("escape_level"),
        "round_trip",
    )
