"""Places of pattern matches and pieces of long texts, with DataFrame functions only.

Everything here takes time in proportion to the text: rows are gathered in
groups, and a piece of a text is cut from the blocks that hold it, not found
from the text's start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.llm.common import let

#: Ends exclusive, in code points.
MATCH = "struct<start:int,end:int,value:string>"
MATCHES = f"array<{MATCH}>"
#: Items that are folded before what they gave is put with the rest.
GROUP = 128
#: Code points in a block of a text.
BLOCK = 4096


def none() -> Column:
    return F.array().cast(MATCHES)


def running(items: Column, start: Column, row: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The rows of type ``row`` that a walk over ``items`` gives, in order.

    ``step(state, item)`` returns the next state and the item's row.  The rows
    so far are copied once for each group of items, not once for each item.
    """

    def fold(items: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / GROUP).cast("int")), lambda k: F.slice(items, k * GROUP + 1, GROUP))

        def one(state: Column, item: Column) -> Column:
            after, made = step(state["s"], item)
            return F.struct(after.alias("s"), F.concat(state["out"], F.array(made.cast(row))).alias("out"))

        def many(state: Column, group: Column) -> Column:
            done = F.aggregate(group, F.struct(state["s"].alias("s"), F.array().cast(f"array<{row}>").alias("out")), one)
            return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(state["out"], F.array(d["out"])).alias("out")))

        whole = F.aggregate(groups, F.struct(start.alias("s"), F.array().cast(f"array<array<{row}>>").alias("out")), many, lambda s: s["out"])
        return F.when(F.size(items) == 0, F.array().cast(f"array<{row}>")).otherwise(F.flatten(whole))

    return let(items, fold)


def find_all(text: Column, pattern: str | Column) -> Column:
    """Every leftmost, non-overlapping match of ``pattern`` in ``text`` with its place, in order.

    What stands between the matches comes from ``split`` and the matches from
    ``regexp_extract_all``; a match's place is the sum of the lengths before it.
    """
    expr = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.call_function("split", text, expr, F.lit(-1)).alias("gaps"), F.regexp_extract_all(text, expr, F.lit(0)).alias("found"))

    def step(at: Column, item: Column) -> tuple[Column, Column]:
        start = at + item["gap"]
        return start + F.length(item["value"]), F.struct(start.alias("start"), (start + F.length(item["value"])).alias("end"), item["value"].alias("value"))

    def placed(both: Column) -> Column:
        items = F.transform(both["found"], lambda m, k: F.struct(F.length(F.get(both["gaps"], k)).alias("gap"), m.alias("value")))
        return F.when(F.size(both["found"]) == 0, none()).otherwise(running(items, F.lit(0), MATCH, step))

    return let(both, placed)


def blocks(text: Column) -> Column:
    """``text`` in blocks of ``BLOCK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(held: Column, start: Column, length: Column) -> Column:
    """``length`` code points from place ``start`` (from 0) of the text whose blocks are ``held``; less at its end."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((start + length - 1) / BLOCK).cast("int")
    return F.when(length <= 0, "").otherwise(F.substring(F.array_join(F.slice(held, first + 1, F.greatest(last - first + 1, F.lit(0))), ""), start - first * BLOCK + 1, length))
