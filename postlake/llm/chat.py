r"""Chat formatting as a grammar with a round trip, in DataFrame functions only.

A formatted conversation is a word of this grammar::

    conversation = turn*
    turn         = "<|im_start|>" role "\n" text "<|im_end|>\n"

``role`` and ``text`` hold neither control string, and a role holds no line end. The grammar can be
read in one way only: the terminator cuts turns, the first line end cuts the role. Inside roles and
texts a run of backslashes between ``<`` and ``|`` stands for one backslash less, and ``<|nl|>`` in
a role stands for a line end.

Formatting is a round trip. Each turn is rendered as it is, read back with that parser, and compared
with its source. Turns that differ are rendered again with their conflicting strings escaped, and
again with every ``<|`` escaped, until what is read back is identical. The whole conversation is
read back once more after it is put together.

The loss mask is a list of runs (code points, whether they count), in the order of the output. So it
is as long as the conversation has turns, and nothing is searched for in the text to apply it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import text_of

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Roles whose texts are learned.
LEARNED = ("assistant",)
#: Ways to render a turn, in the order in which they are tried.
PLAIN, CONFLICTS, ALL = range(3)
_TURN = "struct<turn:bigint,role:string,text:string,level:int>"


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once, however often ``make`` names it."""
    return F.transform(F.array(value), make)[0]


def escaped(text: Column, level: int, names: str = "im_start|im_end") -> Column:
    """The text with a backslash more in its conflicting strings (or in all that start like one)."""
    if level == PLAIN:
        return text
    if level == ALL:
        return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")
    known = F.regexp_replace(text, r"<(\\+)\|", r"<$1\\|")
    return F.regexp_replace(known, rf"<\|({names})\|>", r"<\\|$1|>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def role_out(role: Column, level: int) -> Column:
    """A role as it is written: escaped, with its line ends as a control string unless it is plain."""
    if level == PLAIN:
        return role
    return F.replace(escaped(role, level, "im_start|im_end|nl"), F.lit("\n"), F.lit(LINE))


def role_in(written: Column) -> Column:
    return unescaped(F.replace(written, F.lit(LINE), F.lit("\n")))


def _at_level(level: Column, make: Callable[[int], Column]) -> Column:
    return F.when(level == PLAIN, make(PLAIN)).when(level == CONFLICTS, make(CONFLICTS)).otherwise(make(ALL))


def rendered(role: Column, text: Column, level: int) -> Column:
    """One turn of the grammar."""
    return F.concat(F.lit(START), role_out(role, level), F.lit("\n"), escaped(text, level), F.lit(END + "\n"))


def cut(formatted: Column) -> Column:
    """The turns of a formatted conversation without their terminators; null if it is no word of the grammar."""

    def wrong(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(START) + 1))
        stray = F.contains(inner, F.lit(START)) | F.contains(inner, F.lit(END))
        return ~F.startswith(piece, F.lit(START)) | ~F.contains(piece, F.lit("\n")) | stray

    def turns(pieces: Column) -> Column:
        before = F.slice(pieces, 1, F.size(pieces) - 1)
        return F.when((F.element_at(pieces, -1) == "") & ~F.exists(before, wrong), before)

    return _let(F.split(formatted, r"<\|im_end\|>\n", -1), turns)


def parsed(piece: Column) -> Column:
    """Role and text of one piece of ``cut``."""
    inner = F.substr(piece, F.lit(len(START) + 1))
    role = F.substring_index(inner, "\n", 1)
    return F.struct(
        role_in(role).alias("role"), unescaped(F.substr(inner, F.length(role) + 2)).alias("text")
    )


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; null if it is no word of the grammar."""
    return F.transform(cut(formatted), parsed)


def _returns(role: Column, text: Column, level: int) -> Column:
    """Whether one turn comes back as it was."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    return F.coalesce(parse(rendered(role, text, level)) == source, F.lit(False))


def level_of(role: Column, text: Column) -> Column:
    """The first way of rendering under which the turn comes back as it was.

    Only a turn that holds the beginning of a control string, or an odd role, can differ, so only
    those are tried.
    """
    odd = F.rlike(text, F.lit(r"<\\*\|")) | F.rlike(role, F.lit(r"<\\*\||\n"))
    tried = F.when(_returns(role, text, PLAIN), PLAIN).when(_returns(role, text, CONFLICTS), CONFLICTS)
    return F.when(~odd, PLAIN).otherwise(tried.otherwise(ALL))


def conversations(
    df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``key``, its turns, and their formatted text with its loss mask.

    Columns: key, turns (array of turn, role, text, level; in the order of turn, then role and text,
    nulls first), formatted, mask (array of chars, learned), read (the turns parsed from formatted:
    array of role, text), identical (whether they are the source's).

    A null role or text is the empty one; repeated rows are turns of their own; rows with a null key
    are one conversation; an empty table gives an empty table. Other columns are left out, whatever
    their names. A conversation becomes one string, so its turns meet in one task: that is what the
    format is.
    """
    rows = df.select(
        F.col(key), F.col(turn).cast("long").alias("_turn"), text_of(role).alias("_role"), text_of(text).alias("_text")
    )
    item = F.struct(
        F.col("_turn").alias("turn"),
        F.col("_role").alias("role"),
        F.col("_text").alias("text"),
        F.col("_level").alias("level"),
    )
    held = (
        rows.withColumn("_level", level_of(F.col("_role"), F.col("_text")))
        .groupBy(F.col(key))
        .agg(F.sort_array(F.collect_list(item)).cast(f"array<{_TURN}>").alias("turns"))
    )
    written = held.withColumn(
        "_written",
        F.transform(
            "turns",
            lambda t: F.struct(
                _at_level(t["level"], lambda n: role_out(t["role"], n)).alias("role"),
                _at_level(t["level"], lambda n: escaped(t["text"], n)).alias("text"),
                t["role"].isin(*LEARNED).alias("learned"),
            ),
        ),
    )
    piece = F.transform(
        "_written", lambda w: F.concat(F.lit(START), w["role"], F.lit("\n"), w["text"], F.lit(END + "\n"))
    )
    runs = F.transform("_written", lambda w: mask_runs(w["role"], w["text"], w["learned"]))
    put = written.select(key, "turns", F.array_join(piece, "").alias("formatted"), F.flatten(runs).alias("mask"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return put.withColumn("read", parse(F.col("formatted"))).withColumn(
        "identical", F.coalesce(F.col("read") == source, F.lit(False))
    )


def mask_runs(written_role: Column, written_text: Column, learned: Column) -> Column:
    """The loss mask of one turn: its head, its text and its terminator."""

    def run(chars: Column, counts: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), counts.alias("learned"))

    head = F.length(written_role) + F.lit(len(START) + 1)
    return F.array(run(head, F.lit(False)), run(F.length(written_text), learned), run(F.lit(len(END) + 1), F.lit(False)))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, one per learned turn.

    The mask has three runs a turn, so run 3i + 1 is the text of piece i, and its offset in the piece
    is run 3i: each text is found within its own piece.
    """
    texts = F.transform(
        cut(formatted),
        lambda piece, i: F.when(
            F.get(mask, i * 3 + 1)["learned"],
            F.substr(piece, (F.get(mask, i * 3)["chars"] + 1).cast("int"), F.get(mask, i * 3 + 1)["chars"].cast("int")),
        ),
    )
    return F.transform(F.array_compact(texts), unescaped)


def with_probe(
    df: DataFrame, probe: Sequence[tuple[str, str]], number: int = -1,
    key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """The rows (key, turn, role, text) and those of one more conversation, turn by turn."""
    rows = df.select(*(df[c] for c in (key, turn, role, text)))
    added = df.sparkSession.createDataFrame([(number, i, *row) for i, row in enumerate(probe)], rows.schema)
    return rows.unionByName(added)
