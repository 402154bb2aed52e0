"""License scans: ordered signature rules over word sequences, DataFrame functions only.

A text becomes lower-case words with one blank between them. The keywords it holds choose the rules that are tried on
it; each match is an interval of words. Detections that lie inside another one of a better or equal priority are
suppressed: inside one text they are put in the order of start, end (longest first), priority and rule, and one running
maximum of the ends for each priority tells whether an earlier one reaches as far.

The rules are one constant array inside the plan, whatever the size of the input. Detections, never texts, are shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcelight.functions.text import ascii_lower, let
from sourcelight.llm import common
from sourcelight.llm.op13_rules import KINDS, Rule, rules

#: Fixed by the contract of the query: phrases whose places are counted, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"  # no word holds them
_HIT = "struct<first:int,last:int,priority:int,rule:int,label:string,weight:double>"
_NO_HITS = lambda: F.array().cast(f"array<{_HIT}>")


def word_text(text: Column) -> Column:
    """`` w1 w2 w3 ``: the words of a text with one blank around each; one blank if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), _GAPS, " ")


def _whole_words(pattern: Column) -> Column:
    return F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))


def places(words: Column, pattern: Column) -> Column:
    """Intervals (first, last; words from 0) of a pattern's matches, from left to right, in one pass over the words."""
    marked = F.split(F.regexp_replace(words, _whole_words(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), " ")

    def numbered(test) -> Column:
        def of(parts: Column) -> Column:
            return F.filter(F.transform(parts, lambda w, i: F.when(test(w), i - 1)), lambda i: i.isNotNull())
        return of

    return let(marked, lambda parts: F.zip_with(
        numbered(lambda w: w.startswith(_OPEN))(parts), numbered(lambda w: w.endswith(_CLOSE))(parts),
        lambda a, b: F.struct(a.alias("first"), b.alias("last"))))


def _constant(table: list[Rule]) -> Column:
    rows = [{"keyword": r.keyword, "pattern": r.pattern, "priority": r.priority, "rule": r.number, "label": r.label, "weight": r.weight} for r in table]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<keyword:string,pattern:string,priority:int,rule:int,label:string,weight:double>>")


def _hits(words: Column, keys: Column, table: list[Rule]) -> Column:
    def tried(rule: Column) -> Column:
        return F.array_contains(keys, rule["keyword"]) & F.rlike(words, _whole_words(rule["pattern"]))

    def found(rule: Column) -> Column:
        return F.transform(places(words, rule["pattern"]), lambda p: F.struct(p["first"], p["last"], rule["priority"], rule["rule"], rule["label"], rule["weight"]).cast(_HIT))

    return F.when(F.size(keys) > 0, F.flatten(F.transform(F.filter(_constant(table), tried), found))).otherwise(_NO_HITS())


def _phrases(words: Column, keys: Column, phrases: dict[str, str]) -> Column:
    def found(phrase: str, label: str) -> Column:
        at = F.transform(places(words, F.lit(phrase)), lambda p: F.struct(p["first"], p["last"], F.lit(label).alias("label")))
        return F.when(F.array_contains(keys, phrase.split()[0]), at).otherwise(F.array().cast("array<struct<first:int,last:int,label:string>>"))

    return F.concat(*[found(phrase, label) for phrase, label in phrases.items()])


def scan(df: DataFrame, key: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Licenses in every whole text: ``key``, ``n_words``, ``phrases`` and ``licenses``.

    ``phrases``: every place (``first`` and ``last`` word, from 0, ``label``) of the given fixed phrases, whatever else is
    found. ``licenses``: the detections that no other one suppresses (``first``, ``last``, ``priority``, ``rule``, ``label``,
    ``weight``), ordered by place; a detection is suppressed by one that holds its interval and has a better priority, or
    the same priority and either more words or the same words and an earlier rule.

    One row per input row: repeated and null keys included, each on its own. A null or empty text, and one without
    words, has 0 words and empty lists. Matches of one rule do not overlap each other. Columns other than ``key`` and
    ``text_col`` are not read. Both lists are bounded by the words of the text.
    """
    table = rules() if table is None else table
    phrases = PHRASES if phrases is None else phrases
    keywords = sorted({r.keyword for r in table} | {p.split()[0] for p in phrases})
    known = F.from_json(F.lit(json.dumps(keywords)), "array<string>")

    def of(words: Column) -> Column:
        return let(F.split(words, " "), lambda parts: let(F.array_intersect(parts, known), lambda keys: F.struct(
            (F.size(parts) - 2).cast("bigint").alias("n_words"), _phrases(words, keys, phrases).alias("phrases"), _hits(words, keys, table).alias("hits"))))

    row = common.fresh("row")
    rows = df.select(df[key].alias("key"), let(word_text(df[text_col]), of).alias("found"), F.monotonically_increasing_id().alias(row))
    hits = rows.select(row, "key", "found.n_words", "found.phrases", F.posexplode_outer("found.hits").alias("at", "hit"))
    # The input's row goes with its first detection only, so that a long list of places is not copied.
    first = F.coalesce("at", F.lit(0)) == 0
    hits = hits.select(row, "hit", F.when(first, F.struct("key", "n_words", "phrases")).alias("input"))
    order = Window.partitionBy(row).orderBy("hit.first", F.desc("hit.last"), "hit.priority", "hit.rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = len(KINDS)
    reach = [F.max(F.when(F.col("hit.priority") <= p, F.col("hit.last"))).over(order) for p in range(levels)]
    ends = hits.select(row, "hit", "input", F.array(*reach).alias("reach"))
    over = F.coalesce(F.get("reach", F.col("hit.priority")) >= F.col("hit.last"), F.lit(False))
    merged = ends.groupBy(row).agg(F.max_by("input", F.col("input").isNotNull()).alias("input"), F.array_sort(F.collect_list(F.when(~over, F.col("hit")))).alias("licenses"))
    return merged.select(F.col("input.key").alias(key), "input.n_words", "input.phrases", "licenses")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns, then ``n_found`` (detections that are not suppressed)."""
    found = scan(common.table(spark, sf_dir, "documents"))
    base = F.transform("phrases", lambda p: p["label"])
    more = F.transform("licenses", lambda d: d["label"])
    listed = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("bigint").alias("n_base"),
        F.array_min(F.transform("phrases", lambda p: p["first"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("phrases", lambda p: p["first"])).cast("bigint").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
        F.size("licenses").cast("bigint").alias("n_found"))
