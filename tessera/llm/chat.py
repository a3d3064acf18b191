"""Chat formatting with DataFrame expressions only: turns become one marked text that can be read back exactly.

A conversation's text is a run of blocks ``### Role: `` text ``</turn>`` newline. Adjacent turns of one role share a
block, with ``<next/>`` between their texts. Control strings inside texts and roles are escaped by a backslash code,
so that an unescaped one always is a mark.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, STOP, NEXT = "### ", "</turn>\n", "<next/>"
#: (string inside a text, its code); the backslash comes first.
CODES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"), ("<next/>", "\\x"))
ROLE_CODES = (*CODES, (":", "\\c"), ("\n", "\\n"))


def _put(text: Column, codes) -> Column:
    return reduce(lambda c, code: F.replace(c, F.lit(code[0]), F.lit(code[1])), codes, text)


def _take(text: Column, codes) -> Column:
    """Undoes _put(): between two escaped backslashes a backslash only begins another code."""
    part = lambda p: reduce(lambda c, code: F.replace(c, F.lit(code[1]), F.lit(code[0])), codes[1:], p)
    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def escape(text: Column) -> Column:
    return _put(text, CODES)


def unescape(text: Column) -> Column:
    return _take(text, CODES)


#: Code points of a piece of formatted text, as reading a place of a string takes time in proportion to the place.
PIECE = 4096
#: Array entries that are added up one after the other, as each sum copies those before it.
RUN = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where an inner function of ``use`` does not work ``value`` out for each of its calls."""
    return F.transform(F.array(value), use)[0]


def _sums(lengths: Column) -> Column:
    """The sums of the entries before each entry, and of all."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def _running(lengths: Column, gap: Column) -> Column:
    """The sum of the entries, each with ``gap``, before each entry: within runs of RUN entries, then over the runs."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / RUN).cast("int") - 1, F.lit(0))), lambda r: _sums(F.transform(F.slice(lengths, r * RUN + 1, RUN), lambda x: x + gap)))
    shifted = lambda rs: F.zip_with(_sums(F.transform(rs, lambda r: F.element_at(r, -1))), rs, lambda base, r: F.transform(F.slice(r, 1, F.size(r) - 1), lambda x: x + base))
    # the sum of all runs has no run of its own
    return F.flatten(F.filter(_bound(runs, shifted), lambda x: x.isNotNull()))


def format_conversations(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss: array<struct<start, length>>, n_blocks) from rows (conv_id, turn, role, text).

    ``loss`` has a stretch of ``formatted``, in code points from 0, for each text of a learned role. Turns are sorted by
    turn, role and text, nulls first; a null text or role is empty; repeated rows are turns of their own; a null
    conv_id is a conversation of its own; an empty table gives no rows; other columns are not read. A conversation is
    one string, so its turns meet in one row.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), escape(text).alias("text")))).alias("t"))
    # where blocks begin, and each block's turns
    firsts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    blocks = F.transform("firsts", lambda first, k: F.slice("t", first + 1, F.coalesce(F.get("firsts", k + 1), F.size("t")) - first))
    said = F.transform("blocks", lambda b: F.struct(F.get(b, F.lit(0))["role"].alias("role"), F.transform(b, lambda x: x["text"]).alias("texts")))
    head = lambda b: F.concat(F.lit(HEAD), _put(b["role"], ROLE_CODES), F.lit(": "))
    body = F.transform("said", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(STOP)))
    # running positions: of a block in the text, then of a turn in its block
    begins = _running(F.transform("body", F.length), F.lit(0))
    loss = F.flatten(
        F.zip_with(
            "said",
            "begins",
            lambda b, begin: F.when(
                b["role"].isin(*learned),
                F.zip_with(
                    _running(F.transform(b["texts"], F.length), F.lit(len(NEXT))),
                    b["texts"],
                    lambda at, x: F.struct((begin + F.length(head(b)) + at).alias("start"), F.length(x).alias("length")),
                ),
            ).otherwise(F.array().cast("array<struct<start:int,length:int>>")),
        )
    )
    out = sorted_turns.withColumn("firsts", firsts).withColumn("blocks", blocks).withColumn("said", said).withColumn("body", body).withColumn("begins", begins)
    return out.select("conv_id", F.array_join("body", "").alias("formatted"), loss.alias("loss"), F.size("body").alias("n_blocks"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns: array<struct<role, text>>, loss_text) from the output of format_conversations() alone."""
    blocks = F.filter(F.split("formatted", "</turn>\n"), lambda b: b != "")
    role = lambda b: F.substring_index(F.substring(b, len(HEAD) + 1, 1 << 30), ": ", 1)
    rest = lambda b: F.substr(b, F.length(role(b)) + len(HEAD) + 3)
    turns = F.flatten(F.transform(blocks, lambda b: _bound(_take(role(b), ROLE_CODES), lambda r: F.transform(F.split(rest(b), NEXT), lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("formatted") / PIECE).cast("int")), lambda k: F.substr("formatted", k * PIECE + 1, F.lit(PIECE)))
    first = lambda m: F.floor(m["start"] / PIECE).cast("int")
    last = lambda m: F.floor((m["start"] + m["length"]) / PIECE).cast("int")
    under = lambda ps: F.transform("loss", lambda m: unescape(F.substr(F.array_join(F.slice(ps, first(m) + 1, last(m) - first(m) + 1), ""), m["start"] % PIECE + 1, m["length"])))
    masked = F.array_join(_bound(pieces, under), "")
    return formatted.select("conv_id", turns.alias("turns"), masked.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks), read back from the output."""
    back = read_back(format_conversations(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", F.col("n_blocks").cast("long").alias("n_blocks"))


#: The conversation that op5 adds: a user, then an assistant row, both saying the same control strings.
PLANTED = (-7, "\\### Assistant: </turn> ok")


def with_planted(turns: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    extra = spark.range(2).select(F.lit(PLANTED[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED[1]).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e'), '<next/>', '\x')) AS escaped,
         length(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), '<next/>', '\x'), ':', '\c'), chr(10), '\n')) AS escaped_role,
         CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) THEN 0 ELSE 1 END AS first
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + CASE WHEN first = 1 THEN 4 + escaped_role + 2 + 8 ELSE 7 END)::BIGINT AS formatted_chars,
       sum(first)::BIGINT AS n_blocks
FROM e GROUP BY conv_id
"""
