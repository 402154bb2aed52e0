"""Toxicity: a learned lexicon as a trie, met by Levenshtein automata, and scores of the words around each hit.

The lexicon holds words and word stems that labelled toxic rows use and clean ones do not. The trie and the
Levenshtein automata of its entries are intersected once into one deterministic automaton, so texts are read letter
by letter without listing misspellings: an entry of at least ``FUZZY_LENGTH`` letters is met with one letter added,
lost or changed, a shorter one only as it stands. A window of words around each hit tells quotation from abuse:
a hit inside quotation marks weighs as much as labelled rows say quoted hits do.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sourcelight.llm import common
from sourcelight.llm.op6_language import char_tables

PER_LABEL = 4000
MAX_ENTRIES = 300
FUZZY_LENGTH = 5
STEM_LENGTHS = range(4, 13)
CHANCE = 0.1
WINDOW = 8
THRESHOLD = 0.3
CHUNK = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = {"“": "”", "„": "“", "«": "»", "»": "«", "‘": "’", "”": "”"}


@dataclass
class Entry:
    text: str
    stem: bool
    exact: float
    fuzzy: float

    @property
    def edits(self) -> int:
        return 1 if len(self.text) >= FUZZY_LENGTH + self.stem else 0


@dataclass
class Automaton:
    """``step[state, class]``: next state, 0 is dead and 1 the start; ``entry`` and ``edits`` of accepting states."""

    classes: np.ndarray
    step: np.ndarray
    entry: np.ndarray
    edits: np.ndarray


def automaton(entries: list[Entry]) -> Automaton:
    """Intersect the trie of the entries with the Levenshtein automata of at most one edit, by subset construction."""
    children: list[dict[str, int]] = [{}]
    ends: list[list[int]] = [[]]
    most = [0]  # edits that some entry below a node allows
    for number, e in enumerate(entries):
        node = 0
        most[0] = max(most[0], e.edits)
        for ch in e.text:
            node = children[node].setdefault(ch, len(children))
            if node == len(children):
                children.append({})
                ends.append([])
                most.append(0)
            most[node] = max(most[node], e.edits)
        ends[node].append(number)
    letters = sorted({ch for e in entries for ch in e.text})
    classes = np.zeros(0x110000, np.uint8 if len(letters) < 255 else np.uint16)
    for i, ch in enumerate(letters, 1):
        classes[ord(ch)] = i

    def closed(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With letters of an entry left out, and stems that are complete (as ``(~entry, edits)``, for good)."""
        todo, seen = list(states), set(states)
        while todo:
            node, k = todo.pop()
            more = []
            if node >= 0:
                if k < most[node]:
                    more += [(c, k + 1) for c in children[node].values() if most[c] > k]
                more += [(~e, k) for e in ends[node] if entries[e].stem and k <= entries[e].edits]
            for s in more:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if s[1] == 0 or (s[0], 0) not in seen)

    start = closed({(0, 0)})
    number = {frozenset(): 0, start: 1}
    queue, rows = [start], [[0] * (len(letters) + 1)]
    while queue:
        state = queue.pop(0)
        row = []
        for ch in [None, *letters]:
            after: set[tuple[int, int]] = set()
            for node, k in state:
                if node < 0:
                    after.add((node, k))
                    continue
                for c, child in children[node].items():
                    if c == ch:
                        after.add((child, k))
                    elif k < most[child]:
                        after.add((child, k + 1))
                if k < most[node]:
                    after.add((node, k + 1))
            reached = closed(after)
            if reached not in number:
                number[reached] = len(number)
                queue.append(reached)
            row.append(number[reached])
        rows.append(row)
    entry, edits = np.full(len(number), -1, np.int32), np.zeros(len(number), np.int8)
    for state, i in number.items():
        found = [(k, -entries[e].exact, e) for node, k in state for e in ([~node] if node < 0 else ends[node]) if k <= entries[e].edits]
        if found:
            k, _, e = min(found)
            entry[i], edits[i] = e, k
    return Automaton(classes, np.array(rows, np.int32), entry, edits)


def scan(machine: Automaton, values: list[str]) -> tuple[np.ndarray, ...]:
    """All hits of a chunk of texts: text number, entry, edits, first and one-past-last character in the text."""
    script_of, lower = char_tables()
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in values]
    gap = np.full(1, 0x20, np.uint32)
    joined = np.concatenate([x for c in codes for x in (c, gap)]) if codes else gap
    begins = np.cumsum([0] + [len(c) + 1 for c in codes])
    letter = script_of[joined] > 0
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    classes = machine.classes[lower[joined]]
    size = stop - start
    state = np.ones(len(start), np.int32)
    live = np.arange(len(start))
    offset = 0
    while len(live):
        live = live[size[live] > offset]
        state[live] = machine.step[state[live], classes[start[live] + offset]]
        live = live[state[live] > 0]
        offset += 1
    hit = np.flatnonzero(machine.entry[state] >= 0)
    text = np.searchsorted(begins, start[hit], side="right") - 1
    return text, machine.entry[state[hit]], machine.edits[state[hit]], start[hit] - begins[text], stop[hit] - begins[text]


def quoted(text: str, first: int, last: int, window: int = WINDOW) -> bool:
    """Whether a hit stands inside quotation marks that open and close within ``window`` words around it."""
    line = text.rfind("\n", 0, first) + 1
    left, right = text[max(line, first - 24 * window):first], text[last:last + 24 * window].split("\n", 1)[0]
    left = " ".join(left.split(" ")[-window - 1:])
    right = " ".join(right.split(" ")[:window + 1])
    if left.count('"') % 2 == 1 and '"' in right:
        return True
    for opening, closing in _QUOTES.items():
        at = left.rfind(opening)
        if at >= 0 and closing not in left[at + 1:] and closing in right:
            return True
    return False


@dataclass
class Model:
    entries: list[Entry]
    machine: Automaton | None
    prior: float
    quoted: float  # factor of a hit inside quotation marks
    alone: float  # factor of a misspelt hit without another hit in its window
    clean: frozenset[str] = field(default_factory=frozenset)  # near misses that clean rows use about as often as toxic ones


def hits(model: Model, values: list[str]) -> list[list[tuple[int, int, int, int, bool]]]:
    """Per text: (entry, edits, first, last, quoted) of every hit that is not a known clean word."""
    out: list[list[tuple[int, int, int, int, bool]]] = [[] for _ in values]
    if model.machine is None:
        return out
    for text, entry, edits, first, last in zip(*(a.tolist() for a in scan(model.machine, values)), strict=True):
        if edits and values[text][first:last].lower() in model.clean:
            continue
        out[text].append((entry, edits, first, last, quoted(values[text], first, last)))
    return out


def logit(model: Model, text: str, found: list[tuple[int, int, int, int, bool]]) -> float:
    """Prior plus the best weight of each entry met; quoted hits and lonely misspellings count less."""
    best: dict[int, float] = {}
    for i, (entry, edits, first, last, quote) in enumerate(found):
        e = model.entries[entry]
        weight = e.fuzzy if edits else e.exact
        if quote:
            weight *= model.quoted
        if edits:
            near = [other for j in (i - 1, i + 1) if 0 <= j < len(found) for other in [found[j]]]
            close = any(len(text[min(last, o[3]):max(first, o[2])].split()) <= WINDOW for o in near)
            weight *= 1.0 if close else model.alone
        best[entry] = max(best.get(entry, 0.0), weight)
    return max(-12.0, min(12.0, model.prior + sum(best.values())))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words (ending in ``$``) and stems of each text with its label, counted per task."""
    from collections import Counter

    counts: Counter = Counter()
    for batch in batches:
        for text, label in zip(common.texts(batch, "text"), batch.column(batch.schema.get_field_index("label")).to_pylist(), strict=True):
            seen = set()
            for w in set(_WORD.findall(text.lower())):
                seen.add(w + "$")
                seen.update(w[:k] for k in STEM_LENGTHS if k <= len(w))
            counts.update((s, label) for s in seen)
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["term", "label", "n"])


def log_tail(a: int, b: int, share: float) -> float:
    """Logarithm of the chance that at least ``a`` of ``a + b`` rows are toxic where ``share`` of all rows are."""
    n = a + b
    term = math.lgamma(n + 1) - math.lgamma(a + 1) - math.lgamma(b + 1) + a * math.log(share) + b * math.log1p(-share)
    total, ratio = 1.0, 1.0
    for k in range(a, n):
        ratio *= (n - k) / (k + 1) * share / (1 - share)
        total += ratio
    return term + math.log(total)


def choose(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> list[Entry]:
    """Lexicon from (term, toxic rows, clean rows): the longest form of each stem that keeps nine tenths of its rows,
    without forms that a shorter entry already covers; a form that is a whole word in nine of ten rows is a word."""
    ratio = lambda a, b: math.log((a + 1) / (toxic + 50)) - math.log((b + 0.5) / (clean + 50))
    stems = {t: (a, b) for t, a, b in rows if not t.endswith("$")}
    words = {t[:-1]: (a, b) for t, a, b in rows if t.endswith("$")}
    longest = {}
    for t, (a, _) in stems.items():
        longest[t[:-1]] = max(longest.get(t[:-1], 0), a)
    kept: dict[str, Entry] = {}
    for t, (a, b) in stems.items():
        if longest.get(t, 0) < 0.9 * a or t in words and words[t][0] >= 0.9 * a:
            whole = t in words and words[t][0] >= 0.9 * a
            wa, wb = words[t] if whole else (a, b)
            kept[t] = Entry(t, not whole, ratio(wa, wb), 0.0)
    short = {t: Entry(t, False, ratio(a, b), 0.0) for t, (a, b) in words.items() if len(t) < min(STEM_LENGTHS)}
    covered = lambda t: any(t[:k] in kept and kept[t[:k]].stem for k in range(min(STEM_LENGTHS), len(t)))
    found = [e for t, e in (kept | short).items() if not covered(t)]
    return sorted(found, key=lambda e: (-e.exact, e.text))[:MAX_ENTRIES]


def _near(machine_entries: list[Entry]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    machine = automaton(machine_entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text", CHUNK):
            values, labels = common.texts(batch, "text"), batch.column(batch.schema.get_field_index("label")).to_pylist()
            rows = set()
            for text, entry, edits, first, last in zip(*(a.tolist() for a in scan(machine, values)), strict=True):
                word = values[text][first:last].lower()
                rows.add((text, labels[text], entry, edits, word if edits else "", quoted(values[text], first, last)))
            table = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(table, types, strict=True)], ["row", "label", "entry", "edits", "word", "quoted"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Learn the lexicon and its weights from at most ``per_label`` labelled rows of each label (smallest hash first).

    The prior is the ratio of the labels over all rows with key, text and label, however many of them are in the
    sample; rows without key, text or label are not used. At most ``MAX_ENTRIES`` entries are kept, those with the greatest
    log-ratio. Without labelled rows of both kinds every text gets the same score.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.col("id").cast("string")), "id")
    chosen = named.distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_label).drop("r")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    usable = texts.select("id").join(named.distinct(), "id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = {r.label: r.n for r in usable.collect()}
    prior = math.log((every.get(1, 0) + 0.5) / (every.get(0, 0) + 0.5)) if every else -2.0
    sample = common.stored(texts.join(F.broadcast(chosen), "id").select("text", "label"))
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model([], None, prior, 0.3, 0.8)
    counts = sample.mapInArrow(_candidates, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    least = max(3, math.ceil(0.004 * toxic))
    counts = common.stored(counts.filter(F.col("a") >= least))
    tried = max(1, counts.count())
    strong = counts.filter(F.col("a") * clean >= 12.0 * toxic * (F.col("b") + 0.5))
    rows = strong.orderBy(F.desc("a"), "term").limit(20_000).collect()
    # Of all the terms that were looked at, less than one may get in by chance.
    sure = [(r.term, r.a, r.b) for r in rows if log_tail(r.a, r.b, toxic / (toxic + clean)) + math.log(tried) < math.log(CHANCE)]
    entries = choose(sure, toxic, clean)
    if not entries:
        return Model([], None, prior, 0.3, 0.8)
    near = sample.mapInArrow(_near(entries), "row long, label int, entry int, edits int, word string, quoted boolean")
    found = common.stored(near.groupBy("label", "entry", "edits", "word", "quoted").agg(F.count(F.lit(1)).alias("n")))
    # A spelling is known as clean unless a toxic row is twice as likely to use it, unquoted, as a clean one.
    rows_of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    spellings = found.filter("edits > 0 and not quoted").groupBy("word").agg(rows_of(1).alias("a"), rows_of(0).alias("b"))
    harmless = spellings.filter((F.col("b") > 0) & (F.col("a") * clean < 2.0 * toxic * (F.col("b") + 0.5)))
    known_clean = frozenset(r.word for r in harmless.select("word").collect())
    # A spelling that scoring meets and the sample does not hold is judged by the different spellings near its entry, each
    # counted once: those that clean rows use, and those that toxic rows alone use.
    spelt = found.filter("edits > 0").groupBy("word").agg(F.min("entry").alias("entry"), F.min("label").alias("label"))
    fuzzy = {(r.entry, r.label): r.n for r in spelt.groupBy("entry", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotes = {0: 1.0, 1: 1.0}
    for r in found.filter("quoted").groupBy("label").agg(F.sum("n").alias("n")).collect():
        quotes[r.label] += r.n
    for i, e in enumerate(entries):
        e.fuzzy = max(0.0, math.log((fuzzy.get((i, 1), 0) + 1) / (toxic + 50)) - math.log((fuzzy.get((i, 0), 0) + 0.5) / (clean + 50)))
    share = (quotes[1] / (toxic + 2)) / (quotes[1] / (toxic + 2) + quotes[0] / (clean + 2))
    return Model(entries, automaton(entries), prior, min(1.0, 0.1 + 0.3 * share), 0.9, known_clean)


def _score(model: Model, detail: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    hit_type = pa.list_(pa.struct([("entry", pa.string()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("quoted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text", CHUNK):
            values = common.texts(batch, "text")
            found = hits(model, values)
            scores = [1.0 / (1.0 + math.exp(-logit(model, t, f))) for t, f in zip(values, found, strict=True)]
            arrays, names = [batch.column(0), pa.array(scores, pa.float64())], ["key", "score"]
            if detail:
                arrays.append(pa.array([[{"entry": model.entries[e].text, "edits": k, "start": a, "end": b, "quoted": q} for e, k, a, b, q in f] for f in found], hit_type))
                names.append("hits")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def score(df: DataFrame, model: Model, key: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, detail: bool = True) -> DataFrame:
    """Score every whole text: ``key``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and, if asked for,
    ``hits`` (entry, edits, start, end, quoted).

    One row per input row; null and empty texts get the prior. Only key and text are read. No shuffle.
    """
    fields = [T.StructField("key", df.schema[key].dataType), T.StructField("score", T.DoubleType())]
    if detail:
        hit = [("entry", T.StringType()), ("edits", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("quoted", T.BooleanType())]
        fields.append(T.StructField("hits", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in hit]))))
    rows = df.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInArrow(_score(model, detail), T.StructType(fields))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("key", key)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    remainder = common.fold(F.col("doc_id"), 4)
    model = fit(docs, labels.filter(remainder != 2))
    return score(docs, model, detail=False).select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "score", "predicted")
