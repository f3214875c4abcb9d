"""Column builders for spans of text: extraction with offsets, merging, choosing winners, splicing.

Everything stays in built-in functions. Offsets count code points, as Spark's
length() and substring() do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a recognizer finds; merged counts the spans that became this one, beaten those it won against.
SPAN = "struct<start:int,end:int,value:string,label:string,confidence:float,source:string,pattern:string,merged:int,beaten:int>"
SPANS = f"array<{SPAN}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(df: DataFrame, columns: Sequence[str], array: Column | str, name: str) -> DataFrame:
    """``columns`` with one row per element of ``array``.

    The outer explode keeps Catalyst from inferring a filter on the array's
    size, which it would push down by computing the whole array once more.
    """
    return df.select(*columns, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def empty_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, value: Column, label: Column, confidence: Column, source: Column, pattern: Column, merged: Column | None = None, beaten: Column | None = None) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        value.alias("value"),
        label.alias("label"),
        confidence.cast("float").alias("confidence"),
        source.alias("source"),
        pattern.alias("pattern"),
        (F.lit(1) if merged is None else F.coalesce(merged, F.lit(1))).cast("int").alias("merged"),
        (F.lit(0) if beaten is None else F.coalesce(beaten, F.lit(0))).cast("int").alias("beaten"),
    )


#: Elements that one step of a running fold copies at most: arrays are folded in chunks of so many, then the chunks.
CHUNK = 128


def chunks(array: Column, size: int = CHUNK) -> Column:
    """``array`` (a column or lambda variable that costs nothing to name) cut into arrays of ``size`` elements; empty for an empty one."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda at: F.slice(array, at, F.lit(size)))


def running(values: Column, kind: str, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of ``values`` (of type ``kind``) what ``join`` makes of ``zero`` and all elements before it; ``join`` is associative.

    A fold that appends to an array copies it at each step. Here chunks are
    folded apart, then their totals, so the work grows with the length and not
    with its square.
    """

    def folded(array: Column, value: Callable[[Column], Column]) -> Column:
        start = F.struct(zero.cast(kind).alias("all"), F.array().cast(f"array<{kind}>").alias("before"))
        step = lambda acc, x: F.struct(join(acc["all"], value(x)).cast(kind).alias("all"), F.concat(acc["before"], F.array(acc["all"])).alias("before"))
        return F.aggregate(array, start, step)

    def whole(array: Column) -> Column:
        parts = F.transform(chunks(array), lambda c: folded(c, lambda x: x))
        return let(parts, lambda p: F.flatten(F.zip_with(p, folded(p, lambda c: c["all"])["before"], lambda c, base: F.transform(c["before"], lambda x: join(base, x).cast(kind)))))

    return let(values, lambda v: F.when(F.size(v) <= CHUNK, folded(v, lambda x: x)["before"]).otherwise(whole(v)))


def runs(array: Column, fresh: Column) -> Column:
    """``array`` cut before each element for which the array ``fresh`` says so; its first element is always fresh. Both are lambda variables or columns."""
    at = F.filter(F.transform(fresh, lambda f, i: F.when(f, i + 1)), lambda i: i.isNotNull())
    return let(at, lambda s: F.transform(s, lambda x, k: F.slice(array, x, F.coalesce(F.try_element_at(s, k + 2), F.size(array) + 1) - x)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,value>> of the matches of ``pattern``, which has no capturing group and never matches nothing.

    The gaps between matches come from split(), so a match starts after all
    gaps and matches before it.
    """
    empty = F.array().cast("array<struct<start:int,value:string>>")

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            sizes = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda h, g: F.length(g) + F.length(h))
            ends = running(sizes, "int", F.lit(0), lambda a, x: a + x)
            return let(ends, lambda e: F.transform(found, lambda h, i: F.struct((F.element_at(e, i + 1) + F.length(F.element_at(gaps, i + 1))).alias("start"), h.alias("value"))))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), with_gaps)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def by_position(a: Column, b: Column) -> Column:
    """Order by start, then longer first, then higher confidence, then label."""
    return (
        F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["end"] != b["end"], b["end"] - a["end"])
        .when(a["confidence"] != b["confidence"], F.when(a["confidence"] > b["confidence"], -1).otherwise(1))
        .when(a["label"] != b["label"], F.when(a["label"] < b["label"], -1).otherwise(1))
        .otherwise(0)
    )


def by_strength(a: Column, b: Column) -> Column:
    """Order by confidence, then length (both falling), then start, then label: a total order of what may win."""
    la, lb = a["end"] - a["start"], b["end"] - b["start"]
    return (
        F.when(a["confidence"] != b["confidence"], F.when(a["confidence"] > b["confidence"], -1).otherwise(1))
        .when(la != lb, lb - la)
        .when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["label"] != b["label"], F.when(a["label"] < b["label"], -1).otherwise(1))
        .otherwise(0)
    )


def by_label(a: Column, b: Column) -> Column:
    return F.when(a["label"] != b["label"], F.when(a["label"] < b["label"], -1).otherwise(1)).otherwise(by_position(a, b))


REACH = "struct<label:string,end:int>"


def islands(spans: Column, by_label: bool) -> Column:
    """Spans in order (a lambda variable) as arrays of those that overlap in a chain, of one label only if ``by_label``. Touching spans don't overlap."""
    label = (lambda x: x["label"]) if by_label else (lambda x: F.lit(""))
    # labels only grow in this order, so the largest (label, end) so far has the furthest end of the label
    ends = F.transform(spans, lambda x: F.struct(label(x).alias("label"), x["end"].alias("end")))
    reach = running(ends, REACH, F.lit(None), lambda a, x: F.coalesce(F.greatest(a, x), a, x))
    fresh = F.zip_with(spans, reach, lambda x, r: r.isNull() | (r["label"] != label(x)) | (x["start"] >= r["end"]))
    return let(fresh, lambda f: runs(spans, f))


def _spread(spans: Column, order: Callable[[Column, Column], Column], by_label: bool, one: Callable[[Column], Column]) -> Column:
    """``spans`` sorted by ``order``, with what ``one`` makes of each island (a lambda variable) of more than one span in place of it."""
    single = lambda s: F.flatten(F.transform(islands(s, by_label), lambda x: F.when(F.size(x) > 1, one(x)).otherwise(x)))
    return let(spans, lambda given: F.when(F.size(given) > 1, let(F.array_sort(given, order), single)).otherwise(given))


def merge_same_label(text: Column, spans: Column) -> Column:
    """Overlapping spans of one label become one, with the largest confidence and its source. Touching spans don't merge."""

    def joined(island: Column) -> Column:
        best = F.aggregate(island, F.element_at(island, 1), lambda a, x: F.when(x["confidence"] > a["confidence"], x).otherwise(a))
        start, end = F.element_at(island, 1)["start"], F.array_max(F.transform(island, lambda x: x["end"]))
        merged = F.aggregate(island, F.lit(0), lambda a, x: a + x["merged"])
        return let(best, lambda b: F.array(span(start, end, F.substring(text, start + 1, end - start), b["label"], b["confidence"], b["source"], b["pattern"], merged)))

    return _spread(spans, by_label, True, joined)


def resolve_overlaps(text: Column, spans: Column, policy: str = "winner") -> Column:
    """Of overlapping spans with different labels the strongest stays.

    ``winner`` keeps its own bounds, so a loser's uncovered rest stays readable;
    ``union`` widens it to all that overlaps in a chain, which fails closed.
    Spans that overlap in a chain are compared with each other only.
    """

    def greedy(island: Column) -> Column:
        def meets(x: Column, y: Column) -> Column:
            return (x["start"] < y["end"]) & (y["start"] < x["end"])

        def won(y: Column, x: Column) -> Column:
            more = y["beaten"] + F.when(meets(x, y), 1).otherwise(0)
            return span(y["start"], y["end"], y["value"], y["label"], y["confidence"], y["source"], y["pattern"], y["merged"], more)

        def keep(acc: Column, x: Column) -> Column:
            return F.when(F.exists(acc, lambda y: meets(x, y)), F.transform(acc, lambda y: won(y, x))).otherwise(F.concat(acc, F.array(x)))

        return F.array_sort(F.aggregate(F.array_sort(island, by_strength), empty_spans(), keep), by_position)

    def chain(island: Column) -> Column:
        best = F.aggregate(island, F.element_at(island, 1), lambda a, x: F.when(by_strength(x, a) < 0, x).otherwise(a))
        start, end = F.element_at(island, 1)["start"], F.array_max(F.transform(island, lambda x: x["end"]))
        beaten = F.aggregate(island, F.lit(-1), lambda a, x: a + x["beaten"] + 1)
        return let(best, lambda b: F.array(span(start, end, F.substring(text, start + 1, end - start), b["label"], b["confidence"], b["source"], b["pattern"], b["merged"], beaten)))

    return _spread(spans, by_position, False, greedy if policy == "winner" else chain)


def without_excluded(spans: Column, excluded: Column) -> Column:
    """``spans`` that overlap none of ``excluded`` (array<struct<start,end,..>>); null excludes nothing."""
    hit = lambda x: F.exists(excluded, lambda e: (x["start"] < e["end"]) & (e["start"] < x["end"]))
    return F.when(excluded.isNull(), spans).otherwise(F.filter(spans, lambda x: ~F.coalesce(hit(x), F.lit(False))))


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """``text`` with each span (sorted, disjoint) replaced; a null replacement leaves nothing of it.

    Counting characters starts at the front of a text, so the text is first cut
    into stretches of ``CHUNK`` spans, and each stretch spliced by itself.
    """

    def stretch(part: Column, base: Column, own: Column) -> Column:
        """``part``, which starts at ``base``, with its spans replaced, up to the last one's end."""
        before = lambda k: F.coalesce(F.try_element_at(own, k)["end"], base)
        pieces = F.transform(own, lambda x, i: F.concat(F.substring(part, F.when(i == 0, 1).otherwise(before(F.greatest(i, F.lit(1))) - base + 1), x["start"] - F.when(i == 0, base).otherwise(before(F.greatest(i, F.lit(1))))), F.coalesce(replacement(x), F.lit(""))))
        return F.array_join(pieces, "")

    def whole(parts: Column) -> Column:
        def one(own: Column, k: Column) -> Column:
            base = F.when(k == 0, 0).otherwise(F.element_at(F.element_at(parts, F.greatest(k, F.lit(1))), -1)["end"])
            end = F.element_at(own, -1)["end"]
            return let(F.struct(base.alias("base"), F.substring(text, base + 1, end - base).alias("part")), lambda z: stretch(z["part"], z["base"], own))

        last = F.element_at(F.element_at(parts, -1), -1)["end"]
        return F.concat(F.array_join(F.transform(parts, one), ""), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(spans, lambda s: let(chunks(s), whole))).otherwise(text)


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.call_function("luhn_check", digits)


def mod97(value: Column) -> Column:
    """Whether an IBAN's check digits hold: moved to the end, letters as numbers, it leaves 1 modulo 97."""
    plain = F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, F.pmod(acc * 100 + code - 55, F.lit(97))).otherwise(F.pmod(acc * 10 + code - 48, F.lit(97)))

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1
