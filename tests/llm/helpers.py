"""Small tables and plain versions of the operators' rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
    # names that operators use inside
    ("id", T.StringType()), ("key", T.StringType()), ("token", T.StringType()), ("n", T.LongType()), ("score", T.DoubleType()))])


def table(spark, rows: list[tuple], parts: int = 3):
    """Rows (doc_id, text[, lang, source]) with further columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", None, "t", 1, 0.5) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(rng: random.Random) -> list[tuple]:
    """Nulls, empty and long texts, repeated rows, ties."""
    long = sentence(rng, 6000)
    return [(None, "Text without a key, of some words, long enough to count as a line of its own"), (1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long), (6, "One"), (6, "One"),
            (7, "Ünïcödé ﬀ 日本語 🙂 ▁▁ a  b"), (8, "same id, other text"), (8, "same id, text"), (-3, "negative key"), (2**40, "great key")]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
