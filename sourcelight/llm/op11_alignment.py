"""Cross-tokenizer alignment: where the tokens of two vocabularies end at the same byte, and which ids so meet.

Texts are handled in blocks of bounded bytes, and a block is a handful of Arrow columns: the lists of ids are flattened
beside their parent indices, byte lengths become end offsets by segmented cumulative sums, and a hash join on (document,
end) finds the offsets where tokens of both sides end. Running counts of these cut both sides into the same groups; a
second hash join on the group gives the linked id pairs, and grouped counts say how many documents of the block hold a
pair. Spark merges these partial counts over all blocks.

A block's documents name their pairs by the pair's place in the block, so the corpus-wide counts travel back once for
each pair and block, not once for each document.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sourcelight.llm import common, op1_tokens

BLOCK_BYTES = 1 << 20
JOINED_ROWS = 1_000_000  # rows of one join of groups; larger joins run piece by piece
_WIDE = np.int64(1) << 32


def _byte_level() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> pa.Array:
    """The bytes of every id."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        table, known = _byte_level(), dict(read["model"]["vocab"])
        plain = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        out = [b""] * (1 + max([*known.values(), *plain.values()]))
        for token, i in known.items():
            out[i] = bytes(table[c] for c in token) if token not in plain else token.encode()
        for token, i in plain.items():
            out[i] = token.encode()
        return pa.array(out, pa.binary())
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    return pa.array([bytes([int(p[3:-1], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces], pa.binary())


#: Fixed value: how byte-level vocabularies cut a text before they merge bytes.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(path: str) -> Callable[[list[str]], list[list[int]]] | None:
    """Encoding by ranks, where a vocabulary file says nothing else: bytes cut into words, no normalisation, and ids in the
    order of the merges. It gives the ids of the file's own library in a third of its time; None for other files."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    model, cutter = read["model"], read.get("pre_tokenizer") or {}
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges") or []]
    if not plain or read.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges") or not merged or merged != list(range(256, 256 + len(merged))):
        return None
    import tiktoken

    known, special = _byte_level(), {t["content"] for t in read.get("added_tokens", [])}
    ranks = {bytes(known[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding(os.path.basename(path), pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
    return lambda parts: encoding.encode_ordinary_batch(parts, num_threads=1)


def _read(path: str) -> Callable[[list[str]], list[list[int]]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda parts: [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of whole texts, without special tokens; long texts are cut where no token crosses and put together again.

    Byte-level vocabularies (.json) read a blank and the text, the others add the blank themselves.
    """
    if path.endswith(".json"):
        run = _ranked(path) or _read(path)
        cut, keep, lead = op1_tokens._LETTER_CUT, True, " "
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        run = lambda parts: model.encode(parts, num_threads=1)
        cut, keep, lead = op1_tokens.counter(path)[1], False, ""

    def encode(texts: list[str]) -> list[list[int]]:
        parts, owners = [], []
        for i, text in enumerate(texts):
            cuts = op1_tokens.parts(lead + text, cut, keep) if cut else [lead + text]
            parts += cuts
            owners += [i] * len(cuts)
        out: list[list[int]] = [[] for _ in texts]
        for i, ids in zip(owners, run(parts) if parts else [], strict=True):
            out[i] = out[i] + ids if out[i] else ids
        return out

    return encode


class Side:
    """Token ids of a block's documents as flat Arrow columns: parent document, id and end offset."""

    def __init__(self, ids: list[list[int]], path: str):
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(offsets[-1]))
        self.lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        self.path = path

    def joined(self) -> pa.Array:
        """The bytes of each document's tokens, one after another."""
        tokens = vocabulary(self.path).take(self.lists.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(self.lists.offsets, tokens), b"")

    def only(self, kept: np.ndarray) -> Side:
        """The same documents, those that are not kept without tokens."""
        counts = np.where(kept, self.lists.value_lengths().to_numpy(), 0)
        parents = pc.list_parent_indices(self.lists).to_numpy()
        out = Side.__new__(Side)
        out.path = self.path
        out.lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pc.list_flatten(self.lists).filter(pa.array(kept[parents])))
        return out

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parent document, id and end offset in the document of every token."""
        ids = pc.list_flatten(self.lists)
        parents = pc.list_parent_indices(self.lists).to_numpy()
        lengths = pc.binary_length(vocabulary(self.path)).take(ids)
        total = pc.cumulative_sum(lengths.cast(pa.int64())).to_numpy()
        starts = self.lists.offsets.to_numpy()[:-1]
        before = np.r_[0, total][starts]
        return parents, ids.to_numpy(), total - before[parents]


def _grouped(group: np.ndarray, ids: np.ndarray, name: str) -> pa.Table:
    return pa.table({"group": group, name: ids}).group_by(["group", name], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", name, f"n_{name}"])


def linked(a: tuple, b: tuple, group_a: np.ndarray, group_b: np.ndarray, doc_of: np.ndarray, rows: int = JOINED_ROWS) -> pa.Table:
    """(``doc``, ``a``, ``b``, ``links``): the id pairs that share a group and how many token pairs they stand for."""
    # Most groups are one token of each side: those are pairs as they stand, side by side in the order of groups.
    alone = (np.bincount(group_a, minlength=len(doc_of)) == 1) & (np.bincount(group_b, minlength=len(doc_of)) == 1)
    one_a, one_b = alone[group_a], alone[group_b]
    parts = [pa.table({"doc": doc_of[alone], "a": a[1][one_a], "b": b[1][one_b], "links": np.ones(int(alone.sum()), np.int64)})]
    left, right = _grouped(group_a[~one_a], a[1][~one_a], "a").sort_by("group"), _grouped(group_b[~one_b], b[1][~one_b], "b")
    partners = np.bincount(right.column("group").to_numpy(), minlength=len(doc_of))[left.column("group").to_numpy()]
    piece = np.cumsum(partners) // rows
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), left.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        met = left.slice(start, end - start).join(right, "group", join_type="inner", use_threads=False)
        links = pc.multiply(met.column("n_a"), met.column("n_b"))
        docs = pa.array(doc_of[met.column("group").to_numpy()])
        parts.append(pa.table({"doc": docs, "a": met.column("a"), "b": met.column("b"), "links": links}))
        if sum(t.num_rows for t in parts) > 2 * rows or end == left.num_rows:
            parts = [pa.concat_tables(parts).group_by(["doc", "a", "b"], use_threads=False).aggregate([("links", "sum")]).rename_columns(["doc", "a", "b", "links"])]
    return parts[0]


def _written(a: Side, b: Side, ends_a: np.ndarray, ends_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
    """Per document ``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    def side(s: Side, ends: np.ndarray) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends + 1].astype(np.int32)), s.lists.flatten().cast(pa.string())), ",")

    groups = pc.binary_join_element_wise(side(a, ends_a), side(b, ends_b), "|")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_groups)].astype(np.int32)), groups), ";").to_pylist()


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the segments between bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def align(texts: list[str], path_a: str, path_b: str, rows: int = JOINED_ROWS) -> dict:
    """Tokens, groups and links of a block of texts: per document ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (as
    :func:`_written`) and, as slices of ``slot`` and ``links`` between ``bounds``, its pairs; per pair ``a``, ``b`` and ``docs``."""
    sides = [Side(encoder(p)(texts), p) for p in (path_a, path_b)]
    whole = pa.array([b" " + t.encode() for t in texts], pa.binary())
    kept = np.asarray([t != "" for t in texts], bool)
    for s in sides:
        kept &= pc.equal(s.joined(), whole).to_numpy(zero_copy_only=False)
    sa, sb = (s.only(kept) for s in sides)
    a, b = sa.flat(), sb.flat()
    ends = [pa.table({"end": x[0] * _WIDE + x[2], name: np.arange(len(x[0]))}) for x, name in ((a, "i"), (b, "j"))]  # keyed by document and end
    both = ends[0].join(ends[1], "end", join_type="inner", use_threads=False)
    i, j = np.sort(both.column("i").to_numpy()), np.sort(both.column("j").to_numpy())
    groups = []
    for x, at in ((a, i), (b, j)):
        last = np.zeros(len(x[0]), np.int64)
        last[at] = 1
        groups.append(np.cumsum(last) - last)
    n = len(texts)
    doc_of = a[0][i].astype(np.int64)
    n_groups = np.bincount(doc_of, minlength=n)
    pairs = linked(a, b, *groups, doc_of, rows).sort_by("doc")
    each = pairs.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
    code = lambda t: t.column("a").to_numpy().astype(np.int64) * _WIDE + t.column("b").to_numpy()
    known, mine = code(each), code(pairs)
    order = np.argsort(known)
    links, doc = pairs.column("links").to_numpy(), pairs.column("doc").to_numpy()
    bounds = np.searchsorted(doc, np.arange(n + 1))
    return {"n_a": np.bincount(a[0], minlength=n), "n_b": np.bincount(b[0], minlength=n), "n_groups": n_groups, "n_links": _sums(links, bounds), "groups": _written(sa, sb, i, j, n_groups),
            "bounds": bounds, "slot": order[np.searchsorted(known[order], mine)].astype(np.int32), "links": links,
            "a": each.column("a").to_numpy(), "b": each.column("b").to_numpy(), "docs": each.column("count_all").to_numpy()}


def _blocks(path_a: str, path_b: str, block_bytes: int, joined_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in common.chunks(batches, "text", block_bytes):
            found = align(common.texts(batch, "text"), path_a, path_b, joined_rows)
            n, m = batch.num_rows, len(found["a"])
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(found["bounds"].astype(np.int32)), pa.array(values, kind))
            per_doc = [np.asarray(found[c], np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")]
            digests = [common.hex_sha256(g.encode()) if g else "" for g in found["groups"]]
            none = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number)), batch.column(0), *map(pa.array, per_doc), pa.array(digests, pa.string()), lists(found["slot"], pa.int32()), lists(found["links"], pa.int64()),
                 *[none(n, pa.int32())] * 3, none(n, pa.int64())], _NAMES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, number)), none(m, batch.column(0).type), *[none(m, pa.int64())] * 4, none(m, pa.string()), none(m, pa.list_(pa.int32())), none(m, pa.list_(pa.int64())),
                 pa.array(np.arange(m, dtype=np.int32)), pa.array(found["a"], pa.int32()), pa.array(found["b"], pa.int32()), pa.array(found["docs"], pa.int64())], _NAMES)
            number += 1

    return run


_NAMES = ["block", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "links", "slot", "a", "b", "docs"]
_PER_DOC = _NAMES[2:7]


def _counted(id_type: T.DataType, id_col: str) -> tuple[Callable[[pa.Table, pa.Table], pa.Table], T.StructType]:
    """Sums over the links of each document of a block, from the counts of the block's pairs."""
    fields = [T.StructField(id_col, id_type), *(T.StructField(c, T.StringType() if c == "groups_sha256" else T.LongType()) for c in _PER_DOC), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        slot = pairs.column("slot").to_numpy()
        count, best = (np.zeros(len(slot), np.int64) for _ in range(2))
        count[slot], best[slot] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        slots, links = (docs.column(c).combine_chunks() for c in ("slots", "links"))
        at, many = (x.flatten().to_numpy() for x in (slots, links))
        bounds = np.r_[0, np.cumsum(slots.value_lengths().to_numpy())]
        columns = [docs.column("key"), *(docs.column(c) for c in _PER_DOC), pa.array(_sums(many * best[at], bounds)), pa.array(_sums(many * count[at], bounds))]
        return pa.table(columns, names=[f.name for f in fields])

    return run, T.StructType(fields)


def blocks(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, joined_rows: int = JOINED_ROWS) -> DataFrame:
    """Aligned blocks, written to the shared folder: rows with a ``key`` are documents, rows with a ``slot`` are pairs."""
    rows = df.select(df[id_col].alias("key"), df[text_col].alias("text"))
    kinds = {"block": T.LongType(), "key": rows.schema["key"].dataType, "groups_sha256": T.StringType(), "slots": T.ArrayType(T.IntegerType()), "links": T.ArrayType(T.LongType()), "slot": T.IntegerType(), "a": T.IntegerType(), "b": T.IntegerType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in _NAMES])
    return common.stored(rows.mapInArrow(_blocks(path_a, path_b, block_bytes, joined_rows), schema))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``count``, ``best``): documents that hold the pair linked, and whether no other ``b`` has more of this ``a``."""
    pairs = aligned.filter("slot is not null").groupBy("a", "b").agg(F.sum("docs").alias("count"))
    most = F.max("count").over(Window.partitionBy("a"))  # as many rows as the other vocabulary has ids, at most
    return pairs.withColumn("best", (F.col("count") == most).cast("long"))


def alignment(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, joined_rows: int = JOINED_ROWS) -> DataFrame:
    """Per input row ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best``, ``count_sum``.

    Offsets where a token of A and one of B both end cut the tokens of a text into groups; every A token is linked with
    every B token of its group. ``n_best`` counts the links whose id pair is held by as many rows as the best pair of its A
    id, ``count_sum`` adds up the rows that hold the pair, over all links. ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2``.

    A text that is null or empty, or that either vocabulary does not give back byte for byte, has no tokens: zeros and ''.
    Rows count one by one, so repeated rows and rows without id count as often as they occur. Sizes of blocks and joins
    never change the result.
    """
    aligned = blocks(df, path_a, path_b, id_col, text_col, block_bytes, joined_rows)
    counts = aligned.filter("slot is not null").select("block", "slot", "a", "b").join(pair_counts(aligned), ["a", "b"]).select(F.col("block").alias("within"), "slot", "count", "best")
    run, schema = _counted(aligned.schema["key"].dataType, id_col)
    docs = aligned.filter("slot is null").select("block", "key", *_PER_DOC, "slots", "links")
    return docs.groupBy("block").cogroup(counts.groupBy("within")).applyInArrow(run, schema)


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
