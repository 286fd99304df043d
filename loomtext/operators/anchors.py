"""Anchors: URLs, dates, times, versions, percentages and numbers that must survive a change of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# The patterns, in order of priority.
KINDS = {
    "urls": r"https?://[^\s)]+",
    "dates": r"\b\d{4}-\d{2}-\d{2}\b",
    "times": r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
    "versions": r"(?i)\bv?\d+(?:\.\d+){1,3}\b",
    "percentages": r"\d+(?:\.\d+)?%",
    "numbers": r"\b\d{2,}(?:,\d{3})*(?:\.\d+)?\b",
}


def rejoin_urls(x: Column | str) -> Column:
    """URLs broken by white space, glued to what follows, up to three times (also to a following word)."""
    out = T.text_of(x)
    for _ in range(3):
        out = T.sub(out, r"(https?://\S+)\s+([A-Za-z0-9./?=&_%#-]+)", "$1$2")
    return out


def extract(x: Column | str, most: int = 8) -> Column:
    """struct of an array for each kind, and ``ordered``: at most ``most`` anchors by kind, then as first seen.

    A number inside an anchor of another kind is none.
    """
    def by_kind(source: Column) -> Column:
        return F.struct(*[F.array_distinct(F.filter(F.transform(T.found(source, p), T.strip), lambda a: a != "")).alias(k) for k, p in KINDS.items()])

    def own_numbers(a: Column) -> Column:
        higher = F.concat(*[a[k] for k in KINDS if k != "numbers"])
        numbers = T.let(higher, lambda hs: F.filter(a["numbers"], lambda n: ~F.exists(hs, lambda h: F.contains(h, n))))
        return F.struct(*[(numbers if k == "numbers" else a[k]).alias(k) for k in KINDS])

    def limited(a: Column) -> Column:
        ordered = F.slice(F.concat(*[a[k] for k in KINDS]), 1, most)
        return T.let(ordered, lambda o: F.struct(*[F.filter(a[k], lambda v: F.array_contains(o, v)).alias(k) for k in KINDS], o.alias("ordered")))

    return T.let(rejoin_urls(x), lambda s: T.let(by_kind(s), lambda a: T.let(own_numbers(a), limited)))


def missing(anchors: Column, result: Column | str) -> Column:
    """The ordered anchors that a result lacks; numbers are compared without commas."""
    r = T.text_of(result)
    bare = F.replace(r, F.lit(","), F.lit(""))
    gone = lambda v, t: ~F.when(F.array_contains(anchors["numbers"], v), F.contains(t["bare"], F.replace(v, F.lit(","), F.lit("")))).otherwise(F.contains(t["r"], v))
    return T.let(F.struct(r.alias("r"), bare.alias("bare")), lambda t: F.filter(anchors["ordered"], lambda v: gone(v, t)))


def lost(ordered: list[str], numbers: list[str], result: str) -> list[str]:
    """missing() for one result in a worker."""
    bare = result.replace(",", "")
    return [a for a in ordered if (a.replace(",", "") not in bare if a in numbers else a not in result)]


def prompt_context(anchors: Column) -> Column:
    """The anchors as a list to be preserved, or the empty text."""
    head = "## Semantic Anchors\n\nKeep these anchors exactly as they are where they appear in this chunk.\n\n"
    return F.when(F.size(anchors["ordered"]) > 0, F.concat(F.lit(head), F.array_join(F.transform(anchors["ordered"], lambda a: F.concat(F.lit("- "), a)), "\n"))).otherwise("")
