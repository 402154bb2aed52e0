"""N-gram Jaccard join by T-occurrence search.

Texts become sets of hashed word shingles. Two sets of sizes m and n reach similarity t only if they share
``T = ceil(t / (1 + t) * (m + n))`` shingles. Candidates come from inverted lists over the rarest part of each set, and
a T-occurrence search (DivideSkip) decides: of the inverted lists of a query's shingles the long ones are set aside,
the short ones are merged and keep what reaches ``T`` less the number of long lists, and the long ones are probed by
binary search for those only.

How the work is spread:

1. Shingles that tasks meet in several texts are counted; the most frequent ones come last in the order of shingles.
   Any such choice gives the same links, it only keeps common passages out of the inverted lists.
2. Every distinct set sends the first shingles of that order to their inverted lists. Two sets that reach the overlap
   must meet in one of them (see :func:`head_sizes`). A set goes by its name, so equal texts are one member of a list.
3. Members of a list of at most ``PAIRED`` are paired, and pairs whose sketches already differ too much are dropped (see
   :func:`sketch`). A longer list gives a row for each member. Its sketches are compared list by list, in tiles of bounded
   size, and at most as many pairs as it has members are kept: those that join what was apart. Lists with the same
   members are one list. So rows go with the number of postings, whatever the lists' lengths.
4. The groups that all these pairs connect are placed as blocks: each text goes to its group's block, and the sets of a
   block are searched for in its inverted lists, unless all of the block is linked to the set already. A group too large
   for one block is cut into parts and every two parts are a block. The work in a group of texts that are almost alike,
   but not linked, goes with its square, as they can only be told apart by looking; what is sent goes with its size
   times its number of parts.
5. A block sends at most as many links as it has sets, and the links are contracted to components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.llm import common
from sourcelight.llm.components import components

SHORT = 64  # shingles with more sets come last in the order where they were met often enough
PAIRED = 8  # members of longer lists are rows, not pairs
LIST_HELD = 100_000  # members of a list that are looked at as a whole
PAIRS_HELD = 200_000  # pairs that are made distinct at a time
MOST_FREQUENT = 1_000_000  # so many of them are known to all tasks (8 bytes each)
TILE = 1_000_000  # shingles of a block of sets that are searched at a time
SKETCHES = 4_000  # sketches that are compared with each other at a time
PAIR_LIST = 512  # sets of a list up to which all of its pairs are looked at at once
BLOCK_ROWS = 10_000  # rows of blocks that are held before they are compared
PAIR_BYTES = 16_000_000  # bytes of sketches that are compared at a time
LONG_WORD = 64  # bytes
HASHED_BYTES = 1 << 18  # bytes of texts that are hashed at a time
SENT_IDS = 1_000_000  # ids of 8 bytes that may be sent to all tasks


_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_OF_BYTE = common.mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse, as many as were needed


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, np.uint64(base))
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors)
    return _POWERS


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of lower-cased bytes: a polynomial of their bytes, read off running sums; words of
    over ``LONG_WORD`` bytes are hashed as they are."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(~_SPACE[raw], prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = (x[:len(raw)] for x in _powers(len(raw)))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[raw] * power)])
        hashes = (sums[ends] - sums[starts]) * inverse[starts]
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k]:ends[k]])
    return starts, hashes


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of all runs of ``width`` words; of all words if there are fewer; none
    without words. Texts are hashed some at a time."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append(text.encode("utf-8", "surrogatepass").lower())
        size += len(group[-1])
        if size > HASHED_BYTES:
            yield from _sets(group, width)
            group, size = [], 0
    yield from _sets(group, width)


def _sets(group: list[bytes], width: int) -> Iterator[np.ndarray]:
    if not group:
        return
    starts, words = _word_hashes(b"\n".join(group))
    ends = np.cumsum([len(x) + 1 for x in group])
    at = np.concatenate([[0], np.searchsorted(starts, ends)]).tolist()
    runs = _runs(words, width) if len(words) >= width else words[:0]
    for start, end in zip(at[:-1], at[1:], strict=True):
        n = end - start
        out = np.sort(runs[start:end - width + 1] if n >= width else _runs(words[start:end], n))
        yield out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    if not len(words):
        return words
    count = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(count, np.uint64(width))
        for k in range(width):
            out = common.mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + count])
    return out


def overlap_needed(m: np.ndarray | int, n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least intersection with ``100 * i >= percent * (m + n - i)``, in whole numbers."""
    return -((-percent * (m + n)) // (100 + percent))


def head_sizes(n: int, percent: int) -> tuple[int, int, int]:
    """For a set of ``n``: shingles that may be missing in a partner plus one (p), first shingles to look at (2 p),
    and how many a set sends that is rich in frequent shingles.

    A partner shares at least ``ceil(percent / 100 * n)``. If both sets have p rare shingles among their first 2 p, they
    meet in one of the first p rare ones. If one has not, it sends all of a longer head, in which the other's first
    common rare shingle lies: before it come at most p frequent shingles that both hold and at most p - 1 others.
    If neither has, their first p of all meet.
    """
    p = n - -(-percent * n // 100) + 1
    return p, 2 * p, min(n, p + -(-100 * p // percent) + 2)


def signature(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Places (in hash order) of the shingles that a set sends to their inverted lists."""
    n = len(tokens)
    p, look, rich = head_sizes(n, percent)
    head = tokens[:max(look, rich)]
    if not len(frequent):
        return np.arange(min(p, n))
    at = np.searchsorted(frequent, head)
    at[at == len(frequent)] = 0
    rare = np.flatnonzero(frequent[at] != head)
    if (rare < look).sum() >= p:
        return rare[:p]
    return np.arange(rich)


class Index:
    """Inverted lists of a block of sets."""

    def __init__(self, members: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(m) for m in members], np.int64)
        joined = np.concatenate(members) if members else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.owner = np.repeat(np.arange(len(members)), self.sizes)[order]
        self.tokens, self.start, self.length = np.unique(joined[order], return_index=True, return_counts=True)

    def search(self, query: np.ndarray) -> np.ndarray:
        """Members that share enough with the query (DivideSkip)."""
        n = len(self.sizes)
        if not n or not len(query):
            return np.zeros(0, np.int64)
        needed = overlap_needed(len(query), self.sizes, self.percent)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        length, start = self.length[at], self.start[at]
        # Long lists: those over half of the block, longest first, at most T / (1 + log2 of the block) of them, so that
        # the merge of the short ones leaves few members to probe for.
        order = np.argsort(-length, kind="stable")
        n_long = int(min((length > max(4, n // 2)).sum(), (needed.min() - 1) // (1 + math.log2(n))))
        long, short = order[:n_long], order[n_long:]
        total = int(length[short].sum())
        places = np.arange(total) + np.repeat(start[short] - (np.cumsum(length[short]) - length[short]), length[short])
        counts = np.bincount(self.owner[places], minlength=n)  # the short lists merged
        alive = np.flatnonzero((counts >= needed - n_long) & (needed <= np.minimum(self.sizes, len(query))))
        found = counts[alive]
        for i, k in enumerate(long.tolist()):
            if not len(alive):
                break
            postings = self.owner[start[k]:start[k] + length[k]]
            probe = np.minimum(np.searchsorted(postings, alive), len(postings) - 1)  # the long ones probed
            found = found + (postings[probe] == alive)
            still = found + (n_long - i - 1) >= needed[alive]
            alive, found = alive[still], found[still]
        return alive[found >= needed[alive]]


def sketch(tokens: np.ndarray, percent: int) -> bytes:
    """Parities of the shingles in hashed cells. Two sketches differ in at most as many cells as the sets in shingles,
    and sets of similar size that share little differ in about half of all cells. The number of cells is a power of
    two some eight times the difference that the similarity allows."""
    allowed = max(8, len(tokens) * 2 * (100 - percent) // (100 + percent))
    cells = 1 << max(7, math.ceil(math.log2(6 * allowed)))
    odd = np.bincount((common.mixed(tokens) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of a block of sets (id, size, sketch) as one matrix for each length."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        by: dict[int, list[int]] = {}
        for i, row in enumerate(rows):
            by.setdefault(len(row[2]), []).append(i)
        sizes = np.array([r[1] for r in rows], np.int64)
        self.parts = {k: (np.array(at), sizes[at], np.frombuffer(b"".join(rows[i][2] for i in at), np.uint8).reshape(len(at), k)) for k, at in by.items()}

    def near(self, n: int, raw: bytes, percent: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Places of the sets (of those that are ``wanted``) that a set of size ``n`` with this sketch may be similar to."""
        query = np.frombuffer(raw, np.uint8)
        out = [np.zeros(0, np.int64)]
        for length, (places, sizes, matrix) in self.parts.items():
            needed = overlap_needed(n, sizes, percent)
            fits = needed <= np.minimum(sizes, n)
            if wanted is not None:
                fits &= wanted[places]
            if not fits.any():
                continue
            width = min(length, len(query))
            differ = np.bitwise_count(folded(matrix[fits], width).view(np.uint64) ^ folded(query[None], width).view(np.uint64)).sum(axis=1, dtype=np.int64)
            out.append(places[fits][differ <= n + sizes[fits] - 2 * needed[fits]])
        return np.concatenate(out)


def folded(matrix: np.ndarray, width: int) -> np.ndarray:
    """Sketches (one per row) with fewer cells: the parities of joined cells."""
    while matrix.shape[1] > width:
        half = matrix.shape[1] // 2
        matrix = matrix[:, :half] ^ matrix[:, half:]
    return np.ascontiguousarray(matrix)


def near(a: bytes, b: bytes, m: int, n: int, percent: int) -> bool:
    """Whether the sketches of two sets of sizes m and n leave the similarity possible."""
    return len(Sketches([(0, n, b)]).near(m, a, percent)) > 0


class Forest:
    """Links that join what was apart, between the rows of a block: ``labels`` tells which rows are joined."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.links = ids, []
        self.labels = np.unique(ids, return_inverse=True)[1]  # rows of one id are joined

    def add(self, row: int, found: np.ndarray) -> None:
        """Link a row to the rows ``found``."""
        labels = self.labels
        for other in found[labels[found] != labels[row]].tolist():
            if labels[other] != labels[row]:
                self.links.append((int(self.ids[row]), int(self.ids[other])))
                labels[labels == labels[other]] = labels[row]


_FACTS = "id long, n long, name binary, node long, sketch binary, token long, met long"


def _node(name: bytes) -> int:
    """What a set goes by in postings and pairs."""
    return int.from_bytes(name[:8], "little", signed=True)


def _lone(n: int, percent: int) -> bool:
    """Whether a set of ``n`` is so small that only equal sets reach the similarity."""
    return overlap_needed(n, n + 1, percent) > n and overlap_needed(n, n - 1, percent) > n - 1


def _looked(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row the size, name and sketch of its set; then the shingles that the heads of several different sets of the
    task hold, with the number of those sets (``token`` and ``met``)."""
    names = ["id", "n", "name", "node", "sketch", "token", "met"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        tokens, n = tokens[n > 1].view(np.int64), n[n > 1].astype(np.int64)
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(n), t) for t in types[:5]), pa.array(tokens), pa.array(n)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in common.chunks(batches, "text"):
            sizes, sets, nodes, sketches = [], [], [], []
            for tokens in shingle_sets(common.texts(batch, "text"), width):
                n = len(tokens)
                name = xxhash.xxh3_128_digest(tokens.tobytes())
                sizes.append(n)
                sets.append(name if n else None)
                nodes.append(_node(name) if n else None)
                lone = not n or _lone(n, percent)
                sketches.append(None if lone else sketch(tokens, percent))
                if lone or name in seen:
                    continue
                seen.add(name)
                _, look, rich = head_sizes(n, percent)
                held.append(tokens[:max(look, rich)].copy())
                size += len(held[-1])
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip((sizes, sets, nodes, sketches), types[1:5], strict=True)), pa.nulls(rows, types[5]), pa.nulls(rows, types[6])], names)
            if size > 8_000_000:
                yield counted(held)
                held, size, seen = [], 0, set()
        yield counted(held)

    return run


def _postings(width: int, percent: int, frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The shingles that each set sends, once per task and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in common.chunks(batches, "text"):
            sent, owners, sizes = [np.zeros(0, np.uint64)], [], []
            for tokens in shingle_sets(common.texts(batch, "text"), width):
                n = len(tokens)
                name = xxhash.xxh3_128_digest(tokens.tobytes())
                if not n or name in seen or _lone(n, percent):
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                sent.append(tokens[signature(tokens, frequent, percent)])
                owners.append(_node(name))
                sizes.append(n)
            counts = [len(x) for x in sent[1:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sent).view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int64), counts))],
                ["token", "node", "n"])

    return run


def _paired(percent: int, most: int, held: int = LIST_HELD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings in the order of shingle and node. Lists of at most ``most`` give the pairs of their members that fit in
    size, longer ones a row for each member with the name of the list: that of its members, or for a list that does not
    end within ``held`` of them, its shingle."""

    def pairs(nodes: np.ndarray, sizes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        out = []
        for length in np.unique(lengths).tolist():
            rows = starts[lengths == length][:, None] + np.arange(length)
            i, j = np.triu_indices(length, 1)
            a, b = nodes[rows][:, i].ravel(), nodes[rows][:, j].ravel()  # in order, as nodes are
            m, n = sizes[rows][:, i].ravel(), sizes[rows][:, j].ravel()
            fits = overlap_needed(m, n, percent) <= np.minimum(m, n)
            out.append(np.stack([a[fits], b[fits]]))
        return out

    def batch(found: list[np.ndarray], lists: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        a, b = a[new], b[new]
        member, name = np.concatenate([np.zeros((2, 0), np.int64), *lists], axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([a, member])), pa.concat_arrays([pa.array(b), pa.nulls(len(member), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(name)])], ["a", "b", "list"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        going: int | None = None  # shingle of a list that was sent in part
        found: list[np.ndarray] = []
        lists: list[np.ndarray] = []

        def take(last: bool) -> None:
            nonlocal rest, going
            token, nodes, sizes = rest
            if not len(token):
                return
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (nodes[1:] != nodes[:-1])])  # a set once, whatever tasks sent it
            token, nodes, sizes = token[new], nodes[new], sizes[new]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            lengths = np.diff(np.append(starts, len(token)))
            end = len(token)
            if not last and lengths[-1] <= held and going != token[-1]:  # the last list may go on
                end = int(starts[-1])
                starts, lengths = starts[:-1], lengths[:-1]
            part = (starts + lengths == len(token)) & (not last)
            if len(starts) and going == token[0]:
                part[0] = True
            short = (lengths > 1) & (lengths <= most) & ~part
            found.extend(pairs(nodes, sizes, starts[short], lengths[short]))
            for k in np.flatnonzero((lengths > most) | part).tolist():
                s, n = int(starts[k]), int(lengths[k])
                name = int(token[s]) if part[k] else xxhash.xxh3_64_intdigest(nodes[s:s + n].tobytes()) - (1 << 63)
                lists.append(np.stack([nodes[s:s + n], np.full(n, name)]))
            going = int(token[-1]) if not last and end == len(token) else None
            rest = [x[end:] for x in (token, nodes, sizes)]

        for part in batches:
            rest = [np.concatenate([old, part.column(k).to_numpy()]) for k, old in enumerate(rest)]
            take(False)
            if sum(x.shape[1] for x in found) + sum(x.shape[1] for x in lists) > PAIRS_HELD:
                yield batch(found, lists)
                found, lists = [], []
        take(True)
        yield batch(found, lists)

    return run


def _possible(sketches: pa.Array, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of rows ``a`` and ``b`` have sketches that leave the similarity possible; those with sketches
    of the same two lengths at once."""
    keep = np.zeros(len(a), bool)
    needed = overlap_needed(sizes[a], sizes[b], percent)
    fits = np.flatnonzero(needed <= np.minimum(sizes[a], sizes[b]))
    length = pc.binary_length(sketches).to_numpy().astype(np.int64)
    ends = np.cumsum(length)
    raw = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8)
    kind = length[a[fits]] * (1 << 32) + length[b[fits]]
    for k in np.unique(kind).tolist():
        x, y = k >> 32, k & 0xFFFFFFFF
        every, step = fits[kind == k], max(1, PAIR_BYTES // (x + y))
        for at in (every[i:i + step] for i in range(0, len(every), step)):
            left, right = (folded(raw[(ends - length)[rows[at]][:, None] + np.arange(w)], min(x, y)) for rows, w in ((a, x), (b, y)))
            differ = np.bitwise_count(left.view(np.uint64) ^ right.view(np.uint64)).sum(axis=1, dtype=np.int64)
            keep[at] = differ <= sizes[a[at]] + sizes[b[at]] - 2 * needed[at]
    return keep


def _filtered(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose sketches leave the similarity possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "sa"):
            both = pa.concat_arrays([batch.column("sa"), batch.column("sb")])
            sizes = np.concatenate([batch.column("na").to_numpy(), batch.column("nb").to_numpy()])
            n = np.arange(batch.num_rows)
            keep = pa.array(_possible(both, sizes, n, n + batch.num_rows, percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])

    return run


def _blockwise(batches: Iterator[pa.RecordBatch], read: Callable[[dict], object], solve: Callable[[list, list, bool], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, alone, id, ...) in the order of block and part: what ``solve`` finds between the parts of each
    block, or inside part 0 if it is ``alone``."""
    at, parts, alone = None, ([], []), False
    for batch in batches:
        found: list[tuple[int, int]] = []
        for row in batch.to_pylist():
            if row["block"] != at:
                found += solve(*parts, alone) if at is not None else []
                at, parts, alone = row["block"], ([], []), row["alone"]
            parts[row["part"]].append(read(row))
        yield _linked(found)
    yield _linked(solve(*parts, alone) if at is not None else [])


def _searched(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between the sets of each block's texts, at most one per set."""

    def solve(queries: list, others: list, alone: bool) -> list[tuple[int, int]]:
        members, first = (queries, 0) if alone else (others, len(queries))
        index, forest = Index([t for _, t in members], percent), Forest(np.array([i for i, _ in (queries if alone else queries + others)], np.int64))
        for q, (_, tokens) in enumerate(queries):
            if (forest.labels[first:] != forest.labels[q]).any():
                forest.add(q, first + index.search(tokens))
        return forest.links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blockwise(common.chunks(batches, "text"), lambda r: (r["id"], next(shingle_sets([r["text"] or ""], width))), solve)

    return run


def _sketched(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between sets of a block whose sketches leave the similarity possible, at most one per set."""

    def large(rows: list[dict]) -> list[tuple[int, int]]:
        parts = [[(r["id"], r["n"], r["sketch"]) for r in rows if r["part"] == k] for k in (0, 1)]
        queries, others = (parts[0], parts[0]) if rows[0]["alone"] else parts
        members, first = Sketches(others), 0 if rows[0]["alone"] else len(queries)
        forest = Forest(np.array([r[0] for r in (queries if rows[0]["alone"] else queries + others)], np.int64))
        for q, (_, n, raw) in enumerate(queries):
            apart = forest.labels[first:] != forest.labels[q]
            if apart.any():
                forest.add(q, first + members.near(n, raw, percent, apart))
        return forest.links

    def small(rows: pa.RecordBatch, starts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        """All pairs of many blocks; of those that are possible, what joins each block's rows."""
        ids, sizes = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        pairs = [np.zeros((2, 0), np.int64)]
        for length in np.unique(lengths).tolist():
            first = starts[lengths == length][:, None]
            pairs.append(np.stack([(first + x).ravel() for x in np.triu_indices(length, 1)]))
        a, b = np.concatenate(pairs, axis=1)
        keep = _possible(rows.column("sketch"), sizes, a, b, percent)
        a, b = a[keep], b[keep]
        root, before = np.arange(len(ids)), None
        while before is None or (root != before).any():  # the least row that can be reached, block by block
            before = root.copy()
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[root[far]]), pa.array(ids[far])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block = rows.column("block").dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            end = rows.num_rows if last else int(starts[-1])
            held[:] = [] if last else [rows.slice(end)]
            lengths = np.diff(np.append(starts, rows.num_rows))
            whole = starts < end
            starts, lengths = starts[whole], lengths[whole]
            few = (lengths <= PAIR_LIST) & rows.column("alone").to_numpy(zero_copy_only=False)[starts]
            pairs = np.cumsum(np.where(few, lengths * (lengths - 1) // 2, 0))
            for k in range(int(pairs[-1]) // PAIRS_HELD + 1 if len(pairs) else 0):
                now = few & (pairs // PAIRS_HELD == k)
                if now.any():
                    low, high = starts[now][0], starts[now][-1] + lengths[now][-1]
                    yield small(rows.slice(low, high - low), starts[now] - low, lengths[now])
            for s, n in zip(starts[~few].tolist(), lengths[~few].tolist(), strict=True):
                yield _linked(large(rows.slice(s, n).to_pylist()))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) > BLOCK_ROWS:
                yield from solved(False)
        if held:
            yield from solved(True)

    return run


def _linked(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def frequent_shingles(facts: DataFrame, short: int, most: int = MOST_FREQUENT) -> np.ndarray:
    """The shingles met in more than ``short`` sets, at most ``most`` (the most frequent), sorted."""
    counts = facts.filter("token is not null").groupBy("token").agg(F.sum("met").alias("n")).filter(F.col("n") > short)
    found = counts.orderBy(F.desc("n"), "token").limit(most).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def placed(members: DataFrame, limit: int) -> DataFrame:
    """Where the rows of ``members`` (id, component, weight) are compared: (``id``, ``block``, ``part``, ``alone``).

    Groups that weigh more than ``limit`` are cut into parts, and each two parts are a block.
    """
    tiles = members.groupBy("component").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("tiles"))
    tiled = members.join(tiles, "component").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    spread = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    name = F.concat_ws(":", F.col("component").cast("string"), F.least("tile", "other").cast("string"), F.greatest("tile", "other").cast("string"))
    return spread.select("id", name.alias("block"), (F.col("tile") > F.col("other")).cast("int").alias("part"), (F.col("tile") == F.col("other")).alias("alone"))


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block", "part", "id")


def candidates(rows: DataFrame, facts: DataFrame, width: int, percent: int, short: int, sketches_at_once: int) -> DataFrame:
    """Pairs (``a``, ``b``) of nodes that connect all sets which can be similar, by what their sketches say."""
    frequent = frequent_shingles(facts, short)
    postings = rows.filter("id is not null").mapInArrow(_postings(width, percent, frequent), "token long, node long, n long")
    met = postings.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_paired(percent, min(short, PAIRED)), "a long, b long, list long")
    met = common.stored(met.distinct())  # most pairs meet in many lists
    sketches = common.stored(facts.filter("sketch is not null and id is not null").select("node", "sketch", "n").distinct())
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    pairs = met.filter("list is null").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb")
    members = met.filter("list is not null").select(F.col("a").alias("id"), F.col("list").alias("component"), F.lit(1).alias("weight"))
    spread = placed(members, sketches_at_once).join(sketches.withColumnRenamed("node", "id"), "id").select("block", "part", "alone", "id", "n", "sketch")
    far = _by_block(spread).mapInArrow(_sketched(percent), "a long, b long")
    return pairs.mapInArrow(_filtered(percent), "a long, b long").union(far)


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
            short: int = SHORT, tile: int = TILE, sketches_at_once: int = SKETCHES) -> DataFrame:
    """Groups of texts that are linked by shingle similarity: ``id_col``, ``n_shingles``, ``component_id``.

    Two texts are linked when ``100 * |intersection| >= percent * |union|`` of their shingle sets; a text of fewer than
    ``width`` words has all of them as its only shingle, one without words has none and no links. ``component_id`` is
    the least id reachable by links, itself included. One row per input row; ids are whole numbers. Rows that share an
    id are one node with the links of all of them. A row without id has no links and a null component.
    """
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    facts = common.stored(rows.mapInArrow(_looked(width, percent), _FACTS))
    docs = facts.filter("token is null").select("id", "n", "name", "node")
    named = docs.filter("id is not null and name is not null")
    first = named.groupBy("name").agg(F.min("id").alias("first"), F.min("node").alias("node"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    same = common.stored(named.join(first.filter("copies > 1").select("name", "first"), "name").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    groups = components(candidates(rows, facts, width, percent, short, sketches_at_once)).withColumnRenamed("id", "node")
    # The first text of a set stands for it.
    placed_texts = groups.join(first.select("node", F.col("first").alias("id"), "n"), "node").groupBy("id", "component").agg(F.max("n").alias("weight"))
    blocks = common.stored(placed(placed_texts, tile))
    texts = rows.join(blocks, "id").select("block", "part", "alone", "id", "text")
    links = _by_block(texts).mapInArrow(_searched(width, percent), "a long, b long")
    found = components(links.union(same))
    joined = docs.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left")
    return joined.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.coalesce("component", "id").cast(kind).alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one row of each group of similar texts, the one with the least id (of rows that share it, all).

    The ids to leave out are sent to all tasks if they are at most ``SENT_IDS``, else both sides are placed by id.
    """
    gone = common.fresh("gone")
    groups = similar(df, id_col, text_col, **options).filter(F.col(id_col) != F.col("component_id"))
    groups = common.stored(groups.select(F.col(id_col).alias(gone)).distinct())
    few = groups.count() <= SENT_IDS
    return df.join(F.broadcast(groups) if few else groups, F.col(id_col) == F.col(gone), "left_anti").select(*df.columns)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(common.table(spark, sf_dir, "documents"), width=3, percent=90)
