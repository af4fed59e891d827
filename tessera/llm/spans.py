"""Regular-expression spans with positions, as DataFrame expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"

#: Matches whose positions are summed up in one go; the sums of such groups are added up once more.
GROUP = 128


@dataclass(frozen=True)
class Rule:
    """A kind of span: a pattern for Java's engine, linear in the text, and what a match must fulfil."""

    name: str
    pattern: str
    version: int = 1
    keep: object = None  # a function from the match (Column) to a boolean Column


def _running(lengths: Column) -> Column:
    """Sums of all elements before each one."""
    def sums(part: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("at"))
        return F.aggregate(part, start, lambda s, n: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), (s["at"] + n).alias("at")))

    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / F.lit(GROUP)).cast("int")), lambda g: sums(F.slice(lengths, g * GROUP + 1, F.lit(GROUP))))
    bases = sums(F.transform(groups, lambda g: g["at"]))["out"]
    return F.flatten(F.zip_with(groups, bases, lambda g, b: F.transform(g["out"], lambda x: x + b)))


def spans(text: Column, pattern: str, keep=None, *, context: int = 0) -> Column:  # noqa: ANN001
    """All leftmost non-overlapping matches as structs (start, end, value, left, right).

    Positions are code points, the end exclusive. ``left`` and ``right`` are up
    to ``context`` characters between the match and its neighbours. A null text
    has none.
    """
    empty = F.array().cast(SPAN)
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def place(p: Column) -> Column:
        gaps, hits = p["gaps"], p["hits"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))

        def at(before: Column, i: Column) -> Column:
            gap, hit = F.get(gaps, i), F.get(hits, i)
            start = before + F.length(gap)
            left = F.when(F.length(gap) > context, F.substring(gap, -context, context)).otherwise(gap) if context else F.lit("")
            right = F.substring(F.get(gaps, i + 1), 1, context) if context else F.lit("")
            return F.struct(start.cast("long").alias("start"), (start + F.length(hit)).cast("long").alias("end"), hit.alias("value"), left.alias("left"), right.alias("right"))

        return F.transform(_running(steps), at)

    found = F.transform(F.array(parts), place)[0]
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["value"]))
    return F.when(text.rlike(pattern), found.cast(SPAN)).otherwise(empty)


def tagged(found: Column, kind: str, order: int) -> Column:
    """Spans as (start, order, end, kind), which sort by start and then by the kinds' order."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(tags: Column) -> Column:
    """Tagged spans as the text kind:start:end,..."""
    return F.array_join(F.transform(F.array_sort(tags), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
