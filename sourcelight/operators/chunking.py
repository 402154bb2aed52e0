"""Overlapping passages of a text, with character, byte and line offsets.

A text is cut by one regular expression into runs of 425 words (the stride). A passage is one run plus
the first 75 words of the next, so each word is read twice at most and the cost is linear in the text.
Everything happens inside the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelight import constants as K
from sourcelight.functions.text import WHITE, col, let, newlines

_RUN = r"(?U)(?:\S++\s*+){1,%d}+"
_START = "struct<chars:bigint,bytes:bigint,lines:bigint>"


def _runs(text) -> Column:
    text = col(text)
    runs = F.regexp_extract_all(text, F.lit(_RUN % K.STRIDE_TOKENS), F.lit(0))
    return F.struct(runs.alias("runs"), F.regexp_extract(text, r"(?U)\A\s*+", 0).alias("lead"))


def chunk_array(text) -> Column:
    """Array of passage structs for one text."""
    return let(_runs(text), _passages)


def _passages(t: Column) -> Column:
    runs, lead = t["runs"], t["lead"]
    last_words = F.size(F.regexp_extract_all(F.element_at(runs, -1), F.lit(r"(?U)\S++"), F.lit(0)))
    total = F.when(F.size(runs) > 0, (F.size(runs) - 1) * K.STRIDE_TOKENS + last_words).otherwise(0).cast("bigint")
    zero = F.struct(
        F.char_length(lead).cast("bigint").alias("chars"),
        F.octet_length(lead).cast("bigint").alias("bytes"),
        newlines(lead).alias("lines"),
    )

    def advance(acc: Column, run: Column) -> Column:
        here = acc["here"]
        after = F.struct(
            (here["chars"] + F.char_length(run)).cast("bigint").alias("chars"),
            (here["bytes"] + F.octet_length(run)).cast("bigint").alias("bytes"),
            (here["lines"] + newlines(run)).cast("bigint").alias("lines"),
        )
        return F.struct(F.concat(acc["starts"], F.array(here)).alias("starts"), after.alias("here"))

    starts = F.aggregate(
        runs,
        F.struct(F.array().cast(f"array<{_START}>").alias("starts"), zero.alias("here")),
        advance,
        lambda acc: acc["starts"],
    )

    def cut(n: Column) -> Column:
        over = F.greatest(n - K.CHUNK_TOKENS, F.lit(0))
        count = F.when(n > 0, 1 + F.ceil(over / K.STRIDE_TOKENS)).otherwise(0).cast("int")
        pairs = F.slice(F.arrays_zip(runs.alias("run"), starts.alias("start")), F.lit(1), count)
        return F.transform(pairs, lambda z, i: _passage(z, i, runs, n))

    return let(total, cut)


def _passage(z: Column, i: Column, runs: Column, total: Column) -> Column:
    following = F.regexp_extract(F.coalesce(F.get(runs, i + 1), F.lit("")), _RUN % K.OVERLAP_TOKENS, 0)
    body = F.rtrim(F.concat(z["run"], following), F.lit(WHITE))
    return let(
        body,
        lambda b: F.struct(
            i.cast("bigint").alias("ordinal"),
            b.alias("body"),
            z["start"]["chars"].alias("char_start"),
            (z["start"]["chars"] + F.char_length(b)).alias("char_end"),
            z["start"]["bytes"].alias("byte_start"),
            (z["start"]["bytes"] + F.octet_length(b)).alias("byte_end"),
            (z["start"]["lines"] + 1).alias("line_start"),
            (z["start"]["lines"] + 1 + newlines(b)).alias("line_end"),
            F.least(F.lit(K.CHUNK_TOKENS), total - i * K.STRIDE_TOKENS).cast("bigint").alias("token_count"),
        ),
    )


_GROUP = 256


def prefix_sums(values: Column) -> Column:
    """For each place of an array of numbers the sum of all earlier ones.

    Two levels: groups of bounded length are folded one by one, and their totals shift them. A single fold would copy
    its growing result at each step.
    """
    def fold(part: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("sum"))
        step = lambda acc, v: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + v).cast("bigint").alias("sum"))
        return F.aggregate(part, start, step)

    def of(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / _GROUP).cast("int")
        groups = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda g: fold(F.slice(values, g * _GROUP + 1, F.lit(_GROUP))))
        return let(groups, lambda parts: let(fold(F.transform(parts, lambda p: p["sum"]))["out"], lambda shifts: F.flatten(
            F.transform(parts, lambda p, j: F.transform(p["out"], lambda x: x + F.get(shifts, j))))))

    return let(values, of)


def headings_before(runs: Column) -> Column:
    """For each run of words the nearest heading that begins in an earlier run, cut where the run starts; NULL if it is
    empty or there is none.

    A heading is a line that starts with ``#`` after white space. Every run is read once for its own last heading; the
    runs that have one form a sorted list, and running counts of them lead each run to its place in that list. A line
    that goes on over several runs is put together again from them.
    """
    last = r"(?sU)\A(?:.*\n)?[^\S\n]*+(#.*)\z"

    def tail(run: Column, i: Column) -> Column:
        opens = (i == 0) | F.rlike(F.reverse(F.get(runs, i - 1)), F.lit(r"(?U)\A[^\S\n]*+\n"))
        return F.when(F.contains(run, F.lit("#")), F.regexp_extract(F.concat(F.when(opens, "").otherwise("x"), run), last, 1)).otherwise("")

    def seen(head: Column, i: Column) -> Column:
        more = F.array_join(F.slice(runs, head["at"] + 2, F.greatest(i - 1 - head["at"], F.lit(0))), "")
        line = F.substring_index(F.when(F.contains(head["tail"], F.lit("\n")), head["tail"]).otherwise(F.concat(head["tail"], more)), "\n", 1)
        text = F.regexp_replace(line, r"(?U)\A#++\s*+|\s++\z", "")
        return let(F.regexp_replace(text, r"(?U)\A\s++|\s++\z", ""), lambda t: F.when(t != "", t))

    def of(tails: Column) -> Column:
        heads = F.filter(F.transform(tails, lambda t, i: F.struct(i.alias("at"), t.alias("tail"))), lambda h: h["tail"] != "")
        known = F.struct(heads.alias("heads"), prefix_sums(F.transform(tails, lambda t: (t != "").cast("bigint"))).alias("before"))
        return let(known, lambda k: F.transform(k["before"], lambda n, i: F.when(n > 0, let(F.get(k["heads"], (n - 1).cast("int")), lambda h: seen(h, i)))))

    none = F.transform(runs, lambda r: F.lit(None).cast("string"))
    return F.when(F.exists(runs, lambda r: F.contains(r, F.lit("#"))), let(F.transform(runs, tail), of)).otherwise(none)


def chunk_text(df: DataFrame, text: str = "text", headings: bool = False) -> DataFrame:
    """One row per passage; the columns of ``df`` other than ``text`` are kept."""
    kept = [F.col(c) for c in df.columns if c != text]
    if not headings:
        rows = df.select(*kept, F.explode(chunk_array(text)).alias("c"))
        return rows.select(*[c for c in df.columns if c != text], "c.*")
    named = let(_runs(text), lambda t: let(F.struct(_passages(t).alias("chunks"), headings_before(t["runs"]).alias("heads")), lambda x: F.transform(
        x["chunks"], lambda c, i: F.struct(c.alias("c"), F.get(x["heads"], i).alias("heading")))))
    rows = df.select(*kept, F.explode(named).alias("x"))
    return rows.select(*[c for c in df.columns if c != text], "x.c.*", F.col("x.heading").alias("heading"))


def chunk_pages(df: DataFrame, text: str = "text") -> DataFrame:
    """Passages of each form-feed separated page, page numbers from 1 (empty pages count).

    ``ordinal`` runs on over the pages of a text, ``page_ordinal`` starts anew on each. Still one row, no shuffle.
    """
    kept = [c for c in df.columns if c != text]
    per_page = F.transform(
        F.split(F.col(text), "\f"),
        lambda page, i: F.transform(chunk_array(page), lambda c: F.struct((i + 1).cast("bigint").alias("page"), c.alias("c"))),
    )
    rows = df.select(*kept, F.posexplode(F.flatten(per_page)).alias("__pos", "__x"))
    parts = ["body", "char_start", "char_end", "byte_start", "byte_end", "line_start", "line_end", "token_count"]
    return rows.select(
        *kept, F.col("__pos").cast("bigint").alias("ordinal"), "__x.page", F.col("__x.c.ordinal").alias("page_ordinal"),
        *[F.col(f"__x.c.{c}").alias(c) for c in parts],
    )


def page_text_coverage(df: DataFrame, text: str = "text") -> DataFrame:
    """Page counts per text: pages, blank pages, whether any text is embedded, whether there are too many."""
    kept = [c for c in df.columns if c != text]
    pages = F.split(F.col(text), "\f")
    pages = F.when((F.size(pages) > 1) & (F.element_at(pages, -1) == ""),
                   F.slice(pages, F.lit(1), F.size(pages) - 1)).otherwise(pages)
    blank = F.size(F.filter(pages, lambda p: ~p.rlike(r"(?U)\S")))
    count = F.size(pages)
    return df.select(
        *kept,
        count.cast("bigint").alias("pages"),
        blank.cast("bigint").alias("blank_pages"),
        (blank < count).alias("has_embedded_text"),
        (count > K.MAX_PAGES).alias("over_limit"),
    )
