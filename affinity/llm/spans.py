"""Spans of regular-expression matches, by DataFrame functions alone.

A span is a struct (kind, start, end, value): code points, end exclusive. The
matches and the gaps between them come from the same expression, so the running
sums of their lengths are every match's place. Nothing is folded into a growing
array: n spans of one text cost n log n steps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinity.llm.common import let, running

SPAN = "struct<kind:string,start:int,end:int,value:string>"
NO_SPANS = f"array<{SPAN}>"
#: Code points of a piece of text: a place is found within its piece, not from the text's start.
PIECE = 1024


def none() -> Column:
    """No spans."""
    return F.array().cast(NO_SPANS)


def larger(a: Column, b: Column) -> Column:
    """The larger of two values."""
    return F.greatest(a, b)


def any_case(word: str) -> str:
    """A pattern for a word of ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """The spans of all leftmost non-overlapping matches, in order. The pattern matches no empty string."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda gap, x: F.length(gap) + F.length(x))
        span = lambda end, x: F.struct(F.lit(kind).alias("kind"), (end - F.length(x)).alias("start"), end.alias("end"), x.alias("value"))
        return F.zip_with(running(steps, lambda a, b: a + b), found, span)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none())


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans: Column, kinds: list[str], kind_first: bool) -> Column:
    """Spans by start and then kind, or by kind and then start; kinds in the order given."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    first = (lambda s: (rank(s), s["start"])) if kind_first else (lambda s: (s["start"], rank(s)))
    keyed = F.transform(spans, lambda s: F.struct(first(s)[0].cast("long").alias("a"), first(s)[1].cast("long").alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def untouched(spans: Column, others: Column) -> Column:
    """The spans that share no character with any of others.

    Starts of others and ends of spans are sorted together; at its end, a span
    is touched if one of the others that start before it reaches past its start.
    """
    event = lambda at, last, reach, s: F.struct(at.alias("at"), F.lit(last).alias("last"), reach.alias("reach"), s.alias("s"))
    no_span = F.lit(None).cast(SPAN)
    events = F.concat(F.transform(others, lambda o: event(o["start"], 1, o["end"], no_span)), F.transform(spans, lambda s: event(s["end"], 0, F.lit(-1), s)))

    def free(e: Column) -> Column:
        reaches = running(F.transform(e, lambda x: x["reach"]), larger)
        both = F.zip_with(e, reaches, lambda x, reach: F.struct(x["s"].alias("s"), reach.alias("reach")))
        return F.transform(F.filter(both, lambda x: x["s"].isNotNull() & (x["reach"] <= x["s"]["start"])), lambda x: x["s"])

    return F.when((F.size(others) == 0) | (F.size(spans) == 0), spans).otherwise(let(F.array_sort(events), free))


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pieces(text: Column) -> Column:
    """A text cut into pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """The text from start to end (exclusive; past the text's end there is none), from its pieces."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((F.greatest(end, start + 1) - 1) / PIECE).cast("int")
    own = F.when(first == last, F.coalesce(F.get(cut, first), F.lit(""))).otherwise(F.array_join(F.slice(cut, first + 1, last - first + 1), ""))
    return F.substring(own, start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with each span replaced by ``mark(span)``; where spans overlap, they count as the first of them."""
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s"))))

    def filled(cut: Column, keys: Column, reach: Column) -> Column:
        starts = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"), F.coalesce(k["a"] >= F.get(reach, i - 1), F.lit(True)).alias("head")))
        heads = F.filter(starts, lambda x: x["head"])

        def written(h: Column) -> Column:
            ended = F.transform(h, lambda x, i: F.struct(x["k"].alias("k"), F.get(reach, x["i"] - 1).alias("from")))
            each = F.transform(ended, lambda x: F.concat(part(cut, F.coalesce(x["from"], F.lit(0)), x["k"]["a"]), mark(x["k"]["s"])))
            return F.concat(F.array_join(each, ""), part(cut, F.element_at(reach, -1), F.length(text)))

        return let(heads, written)

    whole = let(pieces(text), lambda cut: let(in_order, lambda keys: let(running(F.transform(keys, lambda k: k["b"]), larger), lambda reach: filled(cut, keys, reach))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
