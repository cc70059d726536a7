"""SimHash near-duplicates by a binary trie self-join (operator 1).

A document's fingerprint is the 64-bit majority of the XXH64 hashes (seed 42) of its 3-word shingles,
repeats included.  Fingerprints that differ in at most three bits are linked, and the components of
the links are the groups of near-duplicates.

The distinct fingerprints form a binary trie.  Its top is cut, by counting prefixes, into leaves of
at most ``CAP`` fingerprints (or a 2,048th of all, if that is more).  Pairs of top leaves are found
by descending the trie on both sides together, adding a bit whenever the sides part and dropping a
pair of nodes once more than three bits differ.  Each surviving pair of leaves is a unit of work: its
fingerprints meet in one group, where the descent of node pairs goes on below the leaves.  A unit
gives its links as a forest (each fingerprint with the least one it is connected to in the unit), so
dense groups don't emit all pairs.  Exact copies share a fingerprint and count once.

Defined results: null and word-free texts have fingerprint zero, which links like any other; equal
rows are kept; a component's id is its least non-null doc_id, null if there is none; an empty table
gives an empty table; extra columns are ignored or passed through (one that is called like the result as ``_<name>``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import worker_memory
from .components import connected_components
from .tables import cut_lineage, own_name, with_result

BUDGET = 3
#: Fingerprints of a leaf of the top trie, at most, while that gives no more than some thousands of leaves.
CAP = 4096
#: The top trie goes at least this deep, so that the units of any table are many and small.
LEAST_DEPTH = 6
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 3:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        begins = ends - lens
        digest = xxhash.xxh64_intdigest
        spans = zip(begins[:-2].tolist(), ends[2:].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
@worker_memory.tidied
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    worker_memory.enter("simhash")
    for texts in batches:
        yield pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


def with_fingerprints(docs: DataFrame, *, text: str = "text", into: str = "fp") -> DataFrame:
    """``docs`` with its fingerprints as signed longs (the same 64 bits)."""
    return with_result(docs, into, _fingerprints.asNondeterministic()(docs[text]))  # so that no filter runs it again


def in_hex(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- the top of the trie ---------------------------------------------------------------------


def top_leaves(fps: DataFrame, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """Cut the trie of the distinct fingerprints (column fp) into leaves: (first value, depth) of each.

    Counts come eight bits at a time, below the first eight only for nodes above the cap, of which
    there are at most 2,048; so a bounded number of counts reaches the driver in each of at most eight rounds.
    """
    counts = {int(r["p"]): int(r["n"]) for r in _prefix_counts(fps, 8).collect()}
    total = sum(counts.values())
    cap = max(cap, total // 2048)
    leaves: list[tuple[int, int]] = []
    crowded: list[int] = []

    def cut(prefix: int, depth: int, base: int, below: dict[int, int]) -> None:
        """Descend from a node to the leaves; ``below`` counts prefixes of ``base`` bits."""
        low, high = prefix << (base - depth), (prefix + 1) << (base - depth)
        n = sum(below.get(p, 0) for p in range(low, high))
        if not n:
            return
        if n <= cap and depth >= LEAST_DEPTH or depth == 64:
            leaves.append((prefix << (64 - depth), depth))
        elif depth == base:
            crowded.append(prefix)
        else:
            cut(prefix * 2, depth + 1, base, below)
            cut(prefix * 2 + 1, depth + 1, base, below)

    cut(0, 0, 8, counts)
    for depth in range(8, 64, 8):
        if not crowded:
            break
        shift = F.shiftrightunsigned("fp", 64 - depth)
        inside = _prefix_counts(fps.where(shift.isin(crowded)), depth + 8)
        deeper = {int(r["p"]) % (1 << 64): int(r["n"]) for r in inside.collect()}
        nodes, crowded = crowded, []
        for p in nodes:
            cut(p, depth, depth + 8, deeper)
    leaves.sort()
    return np.array([x for x, _ in leaves], np.uint64), np.array([d for _, d in leaves], np.int64)


def _prefix_counts(fps: DataFrame, bits: int) -> DataFrame:
    prefix = F.shiftrightunsigned("fp", 64 - bits) if bits < 64 else F.col("fp")
    return fps.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"))


def partner_leaves(starts: np.ndarray, depths: np.ndarray, leaf: int, budget: int = BUDGET) -> list[int]:
    """The leaves that can hold a fingerprint within the budget of one in ``leaf``: descend both together."""
    own, own_depth = int(starts[leaf]), int(depths[leaf])
    found: list[int] = []
    stack = [(0, len(starts), 0, 0)]
    while stack:
        low, high, depth, differ = stack.pop()
        if differ > budget or low == high:
            continue
        if high - low == 1:
            common = min(own_depth, int(depths[low]))
            if ((own ^ int(starts[low])) >> (64 - common)).bit_count() <= budget if common else True:
                found.append(low)
            continue
        bit = 1 << (63 - depth)
        middle = int(starts[low]) >> (64 - depth) << (64 - depth) | bit
        split = low + int(np.searchsorted(starts[low:high], np.uint64(middle)))
        both = depth < own_depth
        stack.append((low, split, depth + 1, differ + (both and bool(own & bit))))
        stack.append((split, high, depth + 1, differ + (both and not own & bit)))
    return found


def _units(starts: np.ndarray, depths: np.ndarray, budget: int):
    """For mapInArrow: the fingerprints of a batch once for every unit (pair of leaves) that they take part in.

    Fingerprints of one leaf are packed in one row per unit and batch.
    """

    @worker_memory.tidied
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partners: dict[int, np.ndarray] = {}
        for batch in batches:
            fp = np.sort(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            leaf = np.searchsorted(starts, fp, "right") - 1
            cut = np.flatnonzero(np.diff(leaf, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(fp)], strict=True):
                own = int(leaf[a])
                if own not in partners:
                    partners[own] = np.array(partner_leaves(starts, depths, own, budget), np.int32)
                with_leaf = partners[own]
                values = pa.array(np.tile(fp[a:b], len(with_leaf)).view(np.int64))
                offsets = pa.array(np.arange(len(with_leaf) + 1, dtype=np.int32) * np.int32(b - a))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.minimum(own, with_leaf).astype(np.int32)),
                        pa.array(np.maximum(own, with_leaf).astype(np.int32)),
                        pa.ListArray.from_arrays(offsets, values),
                    ],
                    ["a", "b", "fps"],
                )

    return emit


# --- below the leaves ------------------------------------------------------------------------


def near_pairs(a: np.ndarray, b: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with a[i] and b[j] within the budget; if ``a is b``, only i < j.

    ``a`` and ``b`` are sorted and distinct; a trie node is a range of them.  Pairs of nodes descend
    together, level by level; a pair is dropped when its differing bits exceed the budget, and small
    pairs are compared value by value.
    """
    if not len(a) or not len(b):
        return
    same = a is b
    one = np.array
    stack = [(one([0]), one([len(a)]), one([0]), one([len(b)]), one([0]), 0)]
    while stack:
        al, ah, bl, bh, differ, depth = stack.pop()
        area = (ah - al) * (bh - bl)
        small = area <= 64 if depth < 64 else np.ones(len(al), bool)
        if small.any():
            begin, area, width = al[small], area[small], (bh - bl)[small]
            for lo, hi in _runs(area, 2_000_000):
                n = area[lo:hi]
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = np.repeat(width[lo:hi], n)
                i = np.repeat(begin[lo:hi], n) + k // w
                j = np.repeat(bl[small][lo:hi], n) + k % w
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same:
                    near &= i < j
                yield i[near], j[near]
        big = ~small
        al, ah, bl, bh, differ = al[big], ah[big], bl[big], bh[big], differ[big]
        if not len(al):
            continue
        if len(al) > 200_000:
            half = len(al) // 2
            stack.append((al[half:], ah[half:], bl[half:], bh[half:], differ[half:], depth))
            al, ah, bl, bh, differ = al[:half], ah[:half], bl[:half], bh[:half], differ[:half]
        bit = np.uint64(1 << (63 - depth))
        above = ~(bit | np.uint64((1 << (63 - depth)) - 1))
        am = np.searchsorted(a, a[al] & above | bit)
        bm = np.searchsorted(b, b[bl] & above | bit)
        children = [(al, am, bl, bm, differ), (am, ah, bm, bh, differ), (al, am, bm, bh, differ + 1)]
        other = (am, ah, bl, bm, differ + 1)
        if same:  # a node with itself: one of the two mixed pairs is enough
            apart = al != bl
            other = tuple(x[apart] for x in other)
        children.append(other)
        al, ah, bl, bh, differ = (np.concatenate(x) for x in zip(*children, strict=True))
        keep = (ah > al) & (bh > bl) & (differ <= budget)
        if keep.any():
            stack.append((al[keep], ah[keep], bl[keep], bh[keep], differ[keep], depth + 1))


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    upto, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        base = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, base + most, "right")))
        yield begin, end
        begin = end


class Forest:
    """Union of indices by least label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def _join_unit(starts: np.ndarray, budget: int):
    def join(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        values = np.unique(rows.column("fps").combine_chunks().flatten().to_numpy().view(np.uint64))
        first, second = key[0].as_py(), key[1].as_py()
        if first == second:
            a = b = values
        else:
            at = np.searchsorted(values, starts[second])
            a, b = values[:at], values[at:]
        forest = Forest(len(values))
        shift = 0 if a is b else len(a)
        for i, j in near_pairs(a, b, budget):
            forest.union(i, j + shift)
        linked = np.flatnonzero(forest.label != np.arange(len(values)))
        return pa.table(
            {
                "u": pa.array(values[linked].view(np.int64), pa.int64()),
                "v": pa.array(values[forest.label[linked]].view(np.int64), pa.int64()),
            }
        )

    return join


def fingerprint_links(fps: DataFrame, *, budget: int = BUDGET, cap: int = CAP) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints of column fp as all near pairs would."""
    starts, depths = top_leaves(fps, cap)
    units = fps.select("fp").mapInArrow(_units(starts, depths, budget), "a int, b int, fps array<long>")
    return units.groupBy("a", "b").applyInArrow(_join_unit(starts, budget), "u long, v long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) per row; ``mark`` is a hash of the text, ``root`` the group's least fingerprint."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    rows = cut_lineage(with_fingerprints(slim).drop("text"))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(classes, budget=budget))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = cut_lineage(rooted)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    members = rooted.join(ids, rooted.root == ids.r).select(F.col("fp").alias("k"), "root", "component_id")
    return rows.join(members, rows.fp == members.k).select("doc_id", "mark", "fp", "root", "component_id")


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but the least doc_id of each group of near-duplicates."""
    found = near_duplicates(docs, doc_id=doc_id, text=text)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "mark")).alias("s"))
    best = best.select(F.xxhash64("s.doc_id", "s.mark").alias("k"), F.col("s.mark").alias("m"))
    key, mark = own_name(docs, "_key"), own_name(docs, "_mark")
    marked = docs.withColumn(mark, F.xxhash64(docs[text])).withColumn(key, F.xxhash64(docs[doc_id], F.col(mark)))
    kept = marked.join(best, (marked[key] == best["k"]) & (marked[mark] == best["m"]), "left_semi")
    return kept.dropDuplicates([key, mark]).drop(key, mark)  # dealt by the same keys: texts are shuffled once
