"""Spans of regular expressions as columns, without Python.

Spark has no function that gives the places of all matches. The pieces between matches and the matches
themselves come from two scans of the same expression; their running lengths are the places, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string>>"
#: Values of one block of a running aggregate, and code points of one piece of a text that contexts are cut from.
BLOCK = 256
PIECE = 4096
#: Pairs of spans up to which overlaps are looked for pair by pair.
FEW = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever loop the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` carried along an array, from an int to the next: for each element the result over it and all before it.

    An array that grows by one is copied each time, so blocks are run apart and joined: n values cost n times the block plus (n / block) squared.
    """
    def grown(over: Column, first: Column, carry: Callable[[Column, Column], Column]) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))

        def one(acc: Column, x: Column) -> Column:
            return let(carry(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))

        return F.aggregate(over, begin, one, lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        count = F.ceil(F.size(v) / F.lit(float(BLOCK))).cast("int")
        numbers = F.slice(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), F.lit(1), count)
        parts = F.transform(numbers, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return let(parts, joined_blocks)

    def joined_blocks(parts: Column) -> Column:
        upto = grown(parts, F.lit(start), lambda at, part: F.aggregate(part, at, step))
        return let(upto, lambda ends: F.flatten(F.transform(parts, lambda part, i: grown(part, F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(start)), step))))

    return let(values, blocks)


def find_spans(text: Column, pattern: str, when: Column) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, hit); none where ``when`` is false.

    ``when`` is a cheap necessary condition, so that most texts are never scanned. Use a pattern that
    never matches an empty string. The cost is in proportion to the text and nearly so to the number of matches.
    """
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(pieces, hits, lambda p, h: F.struct((F.length(p) + F.length(h)).alias("step"), F.length(h).alias("size"), h.alias("hit"))), lambda x: x["hit"].isNotNull())

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda x: x["step"]), 0, lambda a, x: a + x)
        return F.zip_with(found, ends, lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("end"), x["hit"].alias("hit")))

    return F.when(when, let(pairs, placed)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def cut(text: Column, wanted: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, for ``between``; none where ``wanted`` is false. One pass, unlike places counted from its start."""
    return F.when(wanted, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end`` (exclusive), at most a piece long, from the pieces of ``cut``; what lies outside the text is left out."""
    begin = F.greatest(start, F.lit(0))
    first = F.floor(begin / F.lit(float(PIECE))).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, first + 1), F.lit("")))
    return F.substring(two, begin - first * PIECE + 1, F.greatest(end - begin, F.lit(0)))


def first_come(spans: Column) -> Column:
    """Spans in order of their starts, without those that start inside one that was taken before them."""
    ends = running(spans, 0, lambda a, x: F.when(x["start"] >= a, x["end"]).otherwise(a))
    return let(ends, lambda e: F.filter(spans, lambda s, i: F.coalesce(F.get(e, i - 1), F.lit(0)) <= s["start"]))


def apart_from(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of ``taken``, in order of their starts.

    Many are put in one order with the taken ones: the largest end of a taken span before, and the next start of one after, tell.
    """
    def in_order(both: Column) -> Column:
        before = running(F.transform(both, lambda x: F.when(x["taken"], x["end"]).otherwise(F.lit(-1))), -1, lambda a, x: F.greatest(a, x))
        back = running(F.transform(F.reverse(both), lambda x: F.when(x["taken"], x["start"]).otherwise(F.lit(2**31 - 1))), 2**31 - 1, lambda a, x: F.least(a, x))
        both = F.zip_with(F.zip_with(both, before, lambda x, b: F.struct(x.alias("x"), b.alias("b"))), F.reverse(back), lambda y, n: F.struct(y["x"].alias("x"), y["b"].alias("b"), n.alias("n")))
        free = F.filter(both, lambda y: ~y["x"]["taken"] & (y["b"] <= y["x"]["start"]) & (y["n"] >= y["x"]["end"]))
        return F.transform(free, lambda y: y["x"]["span"])

    def marked(a: Column, flag: bool, span: Callable[[Column], Column]) -> Column:
        return F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(flag).alias("taken"), span(s).alias("span")))

    example = F.get(spans, F.lit(0))
    both = F.array_sort(F.concat(marked(spans, False, lambda s: s), marked(taken, True, lambda s: F.when(F.lit(False), example))))
    few = F.size(spans).cast("long") * F.size(taken) <= FEW
    return F.when(few, F.filter(spans, lambda s: ~overlaps(taken, s["start"], s["end"]))).otherwise(let(both, in_order))


def labelled(spans: Column, rank: int, kind: str) -> Column:
    """Structs (rank, kind, start, end) of spans of one kind."""
    return F.transform(spans, lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def joined(marks: Column, by: tuple[str, ...]) -> Column:
    """``kind:start:end`` of labelled spans, comma-joined in the order of the fields ``by``."""
    keyed = F.transform(marks, lambda m: F.struct(*[m[k].alias(f"k{i}") for i, k in enumerate(by)], m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return F.concat_ws(",", F.transform(F.array_sort(keyed), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))))


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start))
