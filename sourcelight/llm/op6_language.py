"""Language identification: script ranges narrow the candidates, character trigrams score every word, and a Viterbi
pass with a switching penalty labels spans, so that texts of several languages are told apart word by word.

The model is a table of log-likelihoods of hashed trigrams per language. It is fitted on at most ``per_language``
labelled rows of each language (those with the smallest hash of their key), and the counting runs on Spark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight.llm import common

BUCKETS = 1 << 16
PER_LANGUAGE = 400
PENALTY = 12.0
CHUNK = 1 << 20
UNSEEN_SCORE = 0.01  # of a text whose letters are of no learned script
UNKNOWN = "und"

# First code points of Unicode blocks that hold the letters of one script each.
SCRIPTS = [
    ("latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("indic", [(0x900, 0xDFF)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)]),
    ("kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)]),
]
OTHER_SCRIPT = len(SCRIPTS) + 1


@lru_cache(maxsize=1)
def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its script (0: no letter) and its lower case (one code point)."""
    script = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x32000):
        ch = chr(code)
        if unicodedata.category(ch)[0] == "L":
            script[code] = OTHER_SCRIPT
            low = ch.lower()
            if len(low) == 1:
                lower[code] = ord(low)
    for number, (_, ranges) in enumerate(SCRIPTS, 1):
        for first, last in ranges:
            part = script[first:last + 1]
            part[part > 0] = number
    return script, lower


@dataclass
class Words:
    """Words of a chunk of texts: places of their letters, trigram buckets, and where each text's words begin."""

    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    first_gram: np.ndarray


def split_words(values: list[str]) -> Words:
    """Runs of letters of one chunk of texts, lower-cased, with the trigrams of `` word `` for each word."""
    script_of, lower = char_tables()
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in values]
    gap = np.full(1, 0x20, np.uint32)
    joined = np.concatenate([x for c in codes for x in (c, gap)]) if codes else gap
    ends = np.cumsum([len(c) + 1 for c in codes])
    scripts = script_of[joined]
    letter = scripts > 0
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = stop - start
    chars = np.where(letter, lower[joined], 0x20).astype(np.uint64)
    left = np.concatenate([[np.uint64(0x20)], chars[:-1]])
    right = np.concatenate([chars[1:], [np.uint64(0x20)]])
    grams = common.mixed((left * np.uint64(0x9E3779B1)) ^ (chars << np.uint64(20)) ^ (right * np.uint64(0x85EBCA77C2B2AE63)))
    grams = (grams[letter] >> np.uint64(48)).astype(np.int64)
    first = np.cumsum(size) - size
    return Words(start, size, np.searchsorted(ends, start, side="right"), scripts[start], grams, first)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # [bucket, language], log-likelihood against the mean of the languages
    scripts: np.ndarray  # [script, language], whether the language is written in it
    penalty: float


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best label per word under word scores and a penalty for each switch; ties keep the smaller label."""
    n, k = scores.shape
    total = scores.sum(axis=0)
    best = int(total.argmax())
    # A path of s spans has s - 1 switches, at least half of s. If no span of another label gains more than half the
    # penalty, one label is best.
    gain = np.cumsum(scores - scores[:, [best]], axis=0)
    floor = np.minimum.accumulate(np.vstack([np.zeros((1, k)), gain[:-1]]), axis=0)
    if (gain - floor).max() <= penalty / 2:
        return np.full(n, best, np.int64)
    back = np.empty((n, k), np.min_scalar_type(k))
    now = scores[0].tolist()
    rows = scores.tolist()
    labels = range(k)
    for i in range(1, n):
        top = max(now)
        source = now.index(top)
        top -= penalty
        row = rows[i]
        step = [0] * k
        for j in labels:
            if now[j] >= top:
                step[j] = j
                now[j] += row[j]
            else:
                step[j] = source
                now[j] = top + row[j]
        back[i] = step
    path = np.empty(n, np.int64)
    path[-1] = now.index(max(now))
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def word_scores(model: Model, words: Words) -> np.ndarray:
    """Scores [word, language]; languages that are not written in a word's script are out for that word."""
    if not len(words.size):
        return np.zeros((0, len(model.languages)))
    scores = np.add.reduceat(model.scores[words.grams], words.first_gram, axis=0).astype(np.float64)
    allowed = model.scripts[words.script]
    known = allowed.any(axis=1)
    scores[known[:, None] & ~allowed] = -60.0
    scores[~known] = 0.0
    return scores


def label_texts(model: Model, values: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Per text: language with most letters, its share of the letters (0 to 1), and spans (start, end, language)."""
    words = split_words(values)
    scores = word_scores(model, words)
    bounds = np.searchsorted(words.text, np.arange(len(values) + 1))
    begins = np.cumsum([0] + [len(v) + 1 for v in values])
    known = model.scripts[words.script].any(axis=1)
    out = []
    for i in range(len(values)):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if a == b or not model.languages:
            out.append((UNKNOWN, 0.0, []))
            continue
        if not known[a:b].any():  # letters, but of no learned script: the trigrams alone have to tell
            grams = words.grams[words.first_gram[a]:words.first_gram[b] if b < len(words.first_gram) else len(words.grams)]
            out.append((model.languages[int(model.scores[grams].sum(axis=0).argmax())], UNSEEN_SCORE, []))
            continue
        path = viterbi(scores[a:b], model.penalty)
        letters = np.bincount(path, weights=words.size[a:b] * known[a:b], minlength=len(model.languages))
        best = int(letters.argmax())
        cut = np.flatnonzero(np.diff(path)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [b - a]]) - 1
        base = int(begins[i])
        spans = [(int(words.start[a + f] - base), int(words.start[a + e] + words.size[a + e] - base), model.languages[path[f]]) for f, e in zip(first, last, strict=True)]
        out.append((model.languages[best], float(letters[best] / words.size[a:b].sum()), spans))
    return out


def _count(languages: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        seen = np.zeros((len(languages), OTHER_SCRIPT + 1), np.int64)
        for batch in common.chunks(batches, "text", CHUNK):
            values, langs = common.texts(batch, "text"), batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for text, lang in zip(values, langs, strict=True):
                words = split_words([text])
                counts[number[lang]] += np.bincount(words.grams, minlength=BUCKETS)
                seen[number[lang]] += np.bincount(words.script, weights=words.size, minlength=OTHER_SCRIPT + 1).astype(np.int64)
        for table, offset in ((counts, 0), (seen, BUCKETS)):
            lang, bucket = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array((bucket + offset).astype(np.int32)), pa.array(table[lang, bucket])], ["lang", "bucket", "n"])

    return run


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
        penalty: float = PENALTY) -> Model:
    """Fit on at most ``per_language`` rows of each language, those with the smallest hash of the key.

    Rows without text, key or language are not used. A table without any gives a model that answers ``und``.
    The driver gets one number per (language, trigram bucket) seen.
    """
    from pyspark.sql.window import Window

    named = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("id is not null and text is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    chosen = named.select("id", "lang").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_language).select("id").distinct()
    sample = common.stored(named.join(chosen, "id", "left_semi").select("lang", "text"))
    languages = [r.lang for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((OTHER_SCRIPT + 1, 0), bool), penalty)
    counted = sample.mapInArrow(_count(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((BUCKETS + OTHER_SCRIPT + 1, len(languages)))
    table[counted["bucket"], counted["lang"]] = counted["n"]
    grams, seen = table[:BUCKETS], table[BUCKETS:]
    logp = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    scores = np.clip(logp - logp.mean(axis=1, keepdims=True), -4.0, 4.0)
    scripts = seen > 0.001 * np.maximum(seen.sum(axis=0), 1)
    return Model(languages, scores.astype(np.float32), scripts, penalty)


def _label(model: Model, spans: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text", CHUNK):
            found = label_texts(model, common.texts(batch, "text"))
            arrays = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            names = ["key", "lang_pred", "score"]
            if spans:
                arrays.append(pa.array([[{"start": s, "end": e, "lang": n} for s, e, n in f[2]] for f in found], span_type))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def identify(df: DataFrame, model: Model, key: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """Language of every whole text: ``key``, ``lang_pred``, ``score`` and, if asked for, ``spans`` (start, end, lang).

    ``score`` is the share of the text's letters in spans of ``lang_pred``. Texts that are null or without letters get ``und``
    and 0; texts with letters only in scripts that no learned language uses get the language of their trigrams, no spans
    and a score of ``UNSEEN_SCORE``. Equal letters go to the language first in order.
    One row per input row; only key and text are read; no shuffle. ``key`` may be a struct that carries a row.
    """
    fields = [T.StructField("key", df.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
        fields.append(T.StructField("spans", T.ArrayType(span)))
    rows = df.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_label(model, spans), T.StructType(fields)).withColumnRenamed("key", key)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    remainder = common.fold(F.col("doc_id"), 3)
    model = fit(docs.filter(remainder != 1))
    found = identify(docs, model, spans=False)
    return found.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
