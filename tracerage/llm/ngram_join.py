"""N-gram Jaccard join by signature trees (operator 5)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, lean, long_lists, lower_ascii, materialise, mix64, split_rows, text_chunks, word_hashes, worker_cache
from .components import components
from .heavy import heavy_hitters

SHINGLE = 5
#: A pair links when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bits of a leaf's bitmap for each element of the largest set in its tree.
LEAF_BITS = 32
#: Bits for each element of a set that a node one level up has, times this for each level more: as a
#: node has FAN_OUT times the elements, chance overlaps of two nodes stay a small share of a set.
NODE_BITS, LEVEL_FACTOR = 128, 16
#: The most bits of a bitmap, and the height above which nodes are too full to tell anything.
MOST_BITS, HEIGHT = 1 << 22, 3
#: Least hashes of a set by which most links are found, before all of its keys are looked at.
HEAD = 4
#: Leaders of a slice: its most typical members, which meet all other slices of their block.
LEADERS = 4
#: Sets and elements that one slice of a block holds; slices of a larger block meet each other.
SLICE, SLICE_ELEMENTS = 2048, 1 << 21
#: Sets of up to so many elements are their own first part, of others it is one part in so many.
WHOLE, PART = 32, 3
#: Rows of 64-bit numbers that may be sent to all tasks (32 MB of keys).
MOST_SENT = 1 << 22
#: Shingles that may be told to be frequent (ordered last, which never changes a result).
FREQUENT = 1 << 14
FAN_OUT = 4

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The set of each row of a chunk: distinct 64-bit hashes of its 5-word shingles, ascending.

    A row of fewer words has one hash of them all; one without words has none. Shingles are told
    apart by 64 bits.
    """
    words, counts = word_hashes(lower_ascii(data), offsets)
    grams = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        grams += words[j : j + len(grams)] * _ODD[j]
    grams = mix64(grams)
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(grams[at : at + n - SHINGLE + 1]))
        elif n:
            short = words[at : at + n] * np.array(_ODD[:n])
            out.append(mix64(short.sum(keepdims=True) + np.array([n], np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        else:
            out.append(words[:0])
        at += n
    return out


def needed(a: int, b: int) -> int:
    """Least overlap of linked sets of sizes a and b."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_size(n: int) -> int:
    """Linked sets share one of so many first elements of each, in any order that all sets follow."""
    return n - -(-PERCENT * n // 100) + 1


def node_of(found: np.ndarray) -> int:
    """64 bits that stand for a set: equal sets are one node."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([np.add.reduce(mix64(found)) + np.uint64(len(found)) * _ODD[1]], np.uint64)).view(np.int64)[0])


def size_class(sizes: np.ndarray) -> np.ndarray:
    """Linked sets are of the same class or of neighbouring ones."""
    return np.floor(np.log(sizes) / SIZE_STEP).astype(np.int64)


#: Logarithm of the ratio of sizes that a class spans, a little above the greatest of linked sets.
SIZE_STEP = math.log(100 / PERCENT + 1e-6)


def bitmap(members: list[np.ndarray], bits: int) -> np.ndarray:
    """The OR of the members' bitmaps: a bit for each value of an element's low bits, in 64-bit words."""
    flags = np.zeros(bits, bool)
    for m in members:
        flags[(m & np.uint64(bits - 1)).view(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def by_similarity(sets: list[np.ndarray], sizes: np.ndarray | None = None) -> list[int]:
    """An order in which similar sets stand side by side: by three independent least hashes, within narrow ranges of sizes if given."""
    keys = [[int(mix64(s ^ salt).min()) for s in sets] for salt in _ODD[2::-1]]
    if sizes is not None:
        keys.append(np.floor(np.log(sizes) / math.log(1.03)).tolist())
    return np.lexsort(keys).tolist() if sets else []


def candidate_pairs(sets: list[np.ndarray], groups: np.ndarray, sizes: np.ndarray | None = None, sides: np.ndarray | None = None, least: int | None = None) -> Iterator[tuple[int, int]]:
    """Pairs of members that may link and aren't in one group: a tree for each class of sizes.

    It holds the sets of that class and of the next: all pairs in which one set is of the class
    itself. With ``sizes``, members are parts of sets of these sizes; with ``sides``, pairs within a
    side are left out; with ``least``, other classes are.
    """
    full = np.array([len(s) for s in sets], np.int64) if sizes is None else sizes
    classes = size_class(full)
    for c in np.unique(classes).tolist() if least is None else [least]:
        here = np.flatnonzero((classes == c) | (classes == c + 1))
        if len(here) < 2 or not (classes[here] == c).any():
            continue
        here = here[by_similarity([sets[k] for k in here.tolist()], None if sizes is None else full[here])]
        tree = Tree([sets[k] for k in here.tolist()], groups[here], classes[here] == c, full[here], None if sides is None else sides[here])
        a, b = tree.pairs()
        yield from zip(here[a].tolist(), here[b].tolist(), strict=True)


class Groups:
    """Union-find over the members of one tree."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Tree:
    """Members in clusters of FAN_OUT, clusters in clusters, up to HEIGHT.

    A node has the OR of its members' bitmaps, the range of their sizes, the most elements that a
    member has beyond its bits (elements that share a bit) and that it lacks (members may be first
    parts of their sets), and its members' group and side if they have one. The higher a node, the
    wider its bitmap: it is as sparse as a leaf's.
    """

    def __init__(self, sets: list[np.ndarray], groups: np.ndarray, own: np.ndarray, sizes: np.ndarray | None = None, sides: np.ndarray | None = None):
        held = np.array([len(s) for s in sets], np.int64)
        sizes = held if sizes is None else sizes
        sides = np.full(len(sets), -1) if sides is None else sides
        most = int(held.max())
        leaf = self.bits(LEAF_BITS * most)
        maps = np.stack([bitmap([s], leaf) for s in sets])
        low, high, slack, gone = sizes, sizes, held - np.bitwise_count(maps).sum(1).astype(np.int64), sizes - held
        self.met: list[tuple[int, int]] = []  # pairs of nodes looked at and kept, from the top
        self.levels = [(maps, low, high, slack, gone, groups, own, sides)]
        for level in range(1, HEIGHT + 1):
            if len(low) <= 1:
                break
            starts, each = np.arange(0, len(low), FAN_OUT), FAN_OUT**level
            bits = self.bits(NODE_BITS * LEVEL_FACTOR ** (level - 1) * most)
            maps = np.stack([bitmap(sets[i : i + each], bits) for i in range(0, len(sets), each)])
            low, high, slack, gone = np.minimum.reduceat(low, starts), *(np.maximum.reduceat(x, starts) for x in (high, slack, gone))
            groups, sides = self.same(groups, starts), self.same(sides, starts)
            own = np.logical_or.reduceat(own, starts)
            self.levels.append((maps, low, high, slack, gone, groups, own, sides))

    @staticmethod
    def bits(n: int) -> int:
        return min(max(1 << (n - 1).bit_length(), 64), MOST_BITS)

    @staticmethod
    def same(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        first, last = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        return np.where(first == last, first, -1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Members i < j that may link, aren't in one group or side, and of which one is ``own``, by dual traversal.

        A pair of nodes goes if its sizes can't link, if both are of one group or side, if neither
        has an own member, or if the most overlap that its bitmaps allow is less than its least
        sizes need. Elements that share a leaf's low bits bound those that share a wider map's.
        """
        n = len(self.levels[-1][1])
        a, b = np.triu_indices(n)
        self.met = []
        for level in range(len(self.levels) - 1, -1, -1):
            maps, low, high, slack, gone, groups, own, sides = self.levels[level]
            if level < len(self.levels) - 1:
                n = len(low)
                step = np.arange(FAN_OUT)
                a = np.repeat((a[:, None] * FAN_OUT + step).ravel(), FAN_OUT)
                b = np.tile((b[:, None] * FAN_OUT + step)[:, None, :], (1, FAN_OUT, 1)).ravel()
                keep = (a < n) & (b < n) & (a <= b)
                a, b = a[keep], b[keep]
            looked = len(a)
            keep = (100 * high[a] >= PERCENT * low[b]) & (100 * high[b] >= PERCENT * low[a])
            keep &= (groups[a] != groups[b]) | (groups[a] < 0)
            keep &= ((sides[a] != sides[b]) | (sides[a] < 0)) & (own[a] | own[b])
            if not level:
                keep &= a < b
            a, b = a[keep], b[keep]
            parts, each = [], max(1, (1 << 21) // maps.shape[1])
            for lo in range(0, len(a), each):
                x, y = a[lo : lo + each], b[lo : lo + each]
                shared = np.bitwise_count(maps[x] & maps[y]).sum(1, dtype=np.int64) + np.minimum(slack[x], slack[y])
                # Of linked sets' overlap a first part may lack as much as it lacks of its set.
                most = np.minimum(shared, np.minimum(high[x], high[y])) + np.maximum(gone[x], gone[y])
                # A node beside itself has all overlaps; its members are looked at one level down.
                parts.append((x == y) | ((100 + PERCENT) * most >= PERCENT * (low[x] + low[y])))
            keep = np.concatenate(parts) if parts else np.zeros(0, bool)
            a, b = a[keep], b[keep]
            self.met.append((looked, len(a)))
        return a, b


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    need = needed(len(a), len(b))
    return need <= min(len(a), len(b)) and overlap(a, b) >= need


def spanning(sets: list[np.ndarray], meet: Callable[[int, int], bool], known: np.ndarray | None = None, sizes: np.ndarray | None = None, sides: np.ndarray | None = None, least: int | None = None) -> list[tuple[int, int]]:
    """Pairs of members that ``meet`` and span the groups that all such pairs make (all, not a sample).

    ``known`` are groups that are one already. Neighbours in the order of similarity are tried
    first, so that most members are in their group before the traversal, which then leaves pairs
    within a group alone. The other arguments are as in candidate_pairs().
    """
    groups, out = Groups(len(sets)), []
    if known is not None:
        first: dict[int, int] = {}
        for i, g in enumerate(known.tolist()):
            groups.join(first.setdefault(g, i), i)

    def tried(i: int, j: int) -> None:
        if (sides is None or sides[i] != sides[j]) and groups.find(i) != groups.find(j) and meet(i, j):
            groups.join(i, j)
            out.append((i, j))

    if len(sets) <= FAN_OUT:  # one node: its members are compared as they are
        for j in range(len(sets)):
            for i in range(j):
                tried(i, j)
        return out
    order = by_similarity(sets)
    for i, j in zip(order, order[1:], strict=False):
        tried(i, j)
    found = np.array([groups.find(i) for i in range(len(sets))], np.int64)
    if not (found == found[0]).all():
        for i, j in candidate_pairs(sets, found, sizes, sides, least):
            tried(i, j)
    return out


def tree_links(sets: list[np.ndarray], known: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between members that span the components of all links among them."""
    return spanning(sets, lambda i, j: linked(sets[i], sets[j]), known, None, sides)


def part_size(n: int) -> int:
    """How many of a set's elements, first in the order that all sets follow, go to its tiles."""
    return n if n <= WHOLE else n // PART + 1


def part_candidates(parts: list[np.ndarray], sizes: np.ndarray, known: np.ndarray, sides: np.ndarray | None, least: int) -> list[tuple[int, int]]:
    """Pairs of sets that may link by their first parts (elements may be cut to low bits), spanning the groups that all of them make.

    Linked sets of sizes a and b share needed(a, b) elements; a part lacks the last ones of its set,
    so parts share at least what is left of that when the larger lack is taken off.
    """
    unique = [np.unique(p) for p in parts]
    twice = np.array([len(p) - len(u) for p, u in zip(parts, unique, strict=True)])
    lacks = sizes - np.array([len(p) for p in parts])

    def may_link(i: int, j: int) -> bool:
        need = needed(int(sizes[i]), int(sizes[j]))
        return need <= min(sizes[i], sizes[j]) and overlap(unique[i], unique[j]) + min(twice[i], twice[j]) >= need - max(lacks[i], lacks[j])

    return spanning(parts, may_link, known, sizes, sides, least)


def sketch(found: np.ndarray) -> bytes:
    """Whether an odd number of elements has each value of the low bits: a bit for each, one to two bits an element.

    Sets differ in as many elements as their sketches in bits, at least.
    """
    bits = 1 << max(6, (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """A row of 64-bit words for each sketch, all as wide as the narrowest: a sketch's parts make a narrower one by exclusive or."""
    width = min(map(len, sketches))
    same = [x if len(x) == width else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width)).tobytes() for x in sketches]
    return np.frombuffer(b"".join(same), np.uint64).reshape(len(same), -1)


def sketch_candidates(sketches: list[bytes], sizes: np.ndarray, known: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets that may link by their sketches, spanning the groups that all of them make.

    Linked sets of sizes a and b differ in a + b - 2 needed(a, b) elements at most. ``known`` are groups
    that are one already; with ``sides``, pairs within a side are left out.
    """
    groups, out = Groups(len(sketches)), []
    label = np.arange(len(sketches))
    if known is not None:
        _, first, of = np.unique(known, return_index=True, return_inverse=True)
        label = first[of]
        groups.up = label.tolist()
    maps = folded(sketches)
    each = max(1, (1 << 20) // max(1, maps.size))
    for lo in range(0, len(maps), each):
        if (label == label[0]).all():
            break
        rows = slice(lo, lo + each)
        apart = np.bitwise_count(maps[rows, None] ^ maps[None, lo:]).sum(2, dtype=np.int64)
        both = sizes[rows, None] + sizes[None, lo:]
        need = -(-PERCENT * both // (100 + PERCENT))
        keep = (apart <= both - 2 * need) & (need <= np.minimum(sizes[rows, None], sizes[None, lo:])) & (label[rows, None] != label[None, lo:])
        if sides is not None:
            keep &= sides[rows, None] != sides[None, lo:]
        a, b = np.nonzero(np.triu(keep, 1))
        before = len(out)
        for i, j in zip((a + lo).tolist(), (b + lo).tolist(), strict=True):
            if groups.join(i, j):
                out.append((i, j))
        if len(out) > before:
            label = np.array([groups.find(i) for i in range(len(maps))])
    return out


def by_tile(batches: Iterator[pa.RecordBatch], work: Callable[[list[pa.RecordBatch]], tuple[list, list]]) -> Iterator[pa.RecordBatch]:
    """Work on each run of rows with the same first column ``tile``; a run may span batches."""
    held: list[pa.RecordBatch] = []

    def done(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        tiles = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
        a, b = [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != tiles[lo]:
                x, y = work(held)
                a += x
                b += y
                held = []
            held.append(batch.slice(lo, hi - lo))
        yield done(a, b)
    if held:
        yield done(*work(held))


def _numpy(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])


def _head_work(parts: list[pa.RecordBatch]) -> tuple[list, list]:
    nodes, sets, seen = [], [], set()
    for p in parts:
        for node, found in zip(p.column("node").to_pylist(), p.column("found"), strict=True):
            if node not in seen:
                seen.add(node)
                nodes.append(node)
                sets.append(np.frombuffer(found.as_buffer(), np.uint64))
    got = tree_links(sets) if len(sets) > 1 else []
    return [nodes[i] for i, _ in got], [nodes[j] for _, j in got]


def _groups_and_sides(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Components, each member's number of its own, and sides: with two slices (sides 1 and 2) pairs within one are another tile's."""
    comps, sides = _numpy(parts, "comp"), _numpy(parts, "side")
    return comps, np.unique(comps, return_inverse=True)[1].astype(np.int64), sides if (sides == 2).any() else None


def _cluster_work(parts: list[pa.RecordBatch]) -> tuple[list, list]:
    """Sets that may link with others of their tile: the name of their cluster (the same wherever the same sets meet) and their node."""
    nodes, sizes = _numpy(parts, "node"), _numpy(parts, "n")
    sketches = [x for p in parts for x in p.column("sketch").to_pylist()]
    groups, classes = Groups(len(nodes)), size_class(sizes)
    for c in np.unique(classes).tolist():
        here = np.flatnonzero((classes == c) | (classes == c + 1))
        if len(here) > 1:
            known = np.array([groups.find(k) for k in here.tolist()])
            for i, j in sketch_candidates([sketches[k] for k in here.tolist()], sizes[here], known):
                groups.join(int(here[i]), int(here[j]))
    of = np.array([groups.find(k) for k in range(len(nodes))])
    names, members = [], []
    for root in np.flatnonzero(np.bincount(of) > 1).tolist():
        mine = nodes[of == root]
        names += [node_of(mine.view(np.uint64))] * len(mine)
        members += mine.tolist()
    return names, members


def _near_work(parts: list[pa.RecordBatch]) -> tuple[list, list]:
    """Pairs of components with sets that may link."""
    comps, known, sides = _groups_and_sides(parts)
    sketches = [x for p in parts for x in p.column("sketch").to_pylist()]
    got = sketch_candidates(sketches, _numpy(parts, "n"), known, sides) if len(sketches) > 1 else []
    return [int(comps[i]) for i, _ in got], [int(comps[j]) for _, j in got]


def _family_work(parts: list[pa.RecordBatch]) -> tuple[list, list]:
    """Links between components."""
    comps, known, sides = _groups_and_sides(parts)
    sets = [np.frombuffer(m.as_buffer(), np.uint64) for p in parts for m in p.column("found")]
    got = tree_links(sets, known, sides) if len(sets) > 1 else []
    return [int(comps[i]) for i, _ in got], [int(comps[j]) for _, j in got]


def _sized(table: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row: sent to all tasks if it has at most MOST_SENT rows, joined by shuffle beyond."""
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def _keyed(df: DataFrame, keys: DataFrame, on: str, how: str = "leftsemi") -> DataFrame:
    """Join with a table of distinct keys, stored first."""
    return df.join(_sized(materialise(keys, "keys")), on, how)


def _hashes(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n, node`` of every row, and the frequent shingles, ascending. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            sizes, nodes = [], []
            for _, _, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(data, offsets)
                sizes += [len(s) for s in sets]
                nodes += [node_of(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], ["doc_id", "n", "node"])

    def keys_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for _, _, data, offsets in text_chunks(batch.column("text"), 1 << 21):
            every = np.concatenate([*shingle_sets(data, offsets), np.zeros(0, np.uint64)])
            keys, counts = np.unique(every, return_counts=True)
            many = counts > 1
            yield dict(zip(keys[many].view(np.int64).tolist(), counts[many].tolist(), strict=True))

    frequent = heavy_hitters(docs.select("text"), keys_of, "long", FREQUENT)
    rows = materialise(docs.mapInArrow(lean(run), "doc_id long, n long, node long"), "ngram-nodes")
    return rows, np.sort(np.array([k for k, _ in frequent], np.int64).view(np.uint64))


def in_order(found: np.ndarray, late: np.ndarray) -> np.ndarray:
    """A set in the order that all sets follow: ascending, frequent elements last."""
    if not len(late):
        return found
    hot = late[np.minimum(np.searchsorted(late, found), len(late) - 1)] == found
    return np.concatenate([found[~hot], found[hot]]) if hot.any() else found


def _told_apart(rows: DataFrame) -> bool:
    """Whether doc_ids tell documents apart: none is null and none comes twice."""
    return not (rows.where("doc_id is null").limit(1).count() or rows.groupBy("doc_id").count().where("count > 1").limit(1).count())


def _profiles(docs: DataFrame, rows: DataFrame, frequent: np.ndarray, apart: bool) -> DataFrame:
    """``node, n, head, keys, sketch`` of every distinct set: its least hashes, its prefix and its sketch.

    Where doc_ids tell documents apart, copies are left out by their ids and no profile is shuffled.
    """
    if apart:
        known = rows.where("node is not null")
        first = known.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        docs = _keyed(docs, known.join(first.select("node", "first"), "node").where("doc_id <> first").select("doc_id"), "doc_id", "leftanti")
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        late = sent.value
        for batch in batches:
            nodes, sizes, heads, keys, sketches = [], [], [], [], []
            for _, _, data, offsets in text_chunks(batch.column("text")):
                for s in shingle_sets(data, offsets):
                    if not len(s):
                        continue
                    first = in_order(s, late)[: prefix_size(len(s))]
                    nodes.append(node_of(s))
                    sizes.append(len(s))
                    heads.append(s[:HEAD])
                    keys.append(first)
                    sketches.append(sketch(s))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), long_lists(heads), long_lists(keys), pa.array(sketches, pa.binary())], ["node", "n", "head", "keys", "sketch"])

    made = docs.select("text").mapInArrow(lean(run), "node long, n long, head array<long>, keys array<long>, sketch binary")
    return made if apart else made.dropDuplicates(["node"])


def _sets_of(docs: DataFrame, rows: DataFrame, nodes: DataFrame, apart: bool) -> DataFrame:
    """``node, found``: the whole sets of the given nodes, hashed again from one document.

    Nothing but the documents' ids is shuffled where these tell documents apart.
    """
    wanted = materialise(_keyed(rows.where("node is not null"), nodes.distinct(), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                sets = [s for s in shingle_sets(data, offsets) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "found"])

    found = _keyed(docs.where("doc_id is not null"), wanted.select("doc_id").distinct(), "doc_id").select("text").mapInArrow(lean(run), "node long, found binary")
    if apart:
        return found
    if wanted.where("doc_id is null").limit(1).count():
        found = found.unionByName(docs.where("doc_id is null").select("text").mapInArrow(lean(run), "node long, found binary"))
    # Two texts may share a doc_id, so others than the wanted come too, and some twice.
    return _keyed(found, wanted.select("node"), "node").dropDuplicates(["node"])


def _leader_work(parts: list[pa.RecordBatch]) -> tuple[list, list]:
    """The most typical members: those with the most elements that half of the tile has, less their others."""
    nodes, sets = [], []
    for p in parts:
        nodes += p.column("node").to_pylist()
        sets += [np.frombuffer(found.as_buffer(), np.uint64) for found in p.column("found")]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    common = values[2 * counts >= len(sets)]
    score = [2 * len(np.intersect1d(s, common, assume_unique=True)) - len(s) for s in sets]
    best = sorted(range(len(nodes)), key=lambda i: (-score[i], nodes[i]))[:LEADERS]
    return [nodes[i] for i in best], [parts[0].column("tile")[0].as_py()] * len(best)


def _in_tiles(members: DataFrame, sets: DataFrame, work: Callable) -> DataFrame:
    """``work`` on each tile of ``members`` (tile, node) with its sets: rows ``a, b``."""
    tiles = members.join(sets, "node").select("tile", "node", "found")
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(lean(lambda batches: by_tile(batches, work)), "a long, b long")


def _head_links(docs: DataFrame, rows: DataFrame, profiles: DataFrame, apart: bool) -> DataFrame:
    """Links among sets that share one of their least hashes.

    Sketches meet in tiles first; only sets that may link go whole to a tile of their cluster. Blocks are cut in slices, which are trees of their own. The leaders of all slices of a block
    then meet each of its slices: copies of one text link to it wherever it stands. What is missed
    here is found by the prefixes.
    """
    keyed = profiles.select("node", F.explode("head").alias("key"))
    sign = [F.count("*").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x")]
    blocks = keyed.groupBy("key").agg(*sign).where("c > 1")
    # Near copies meet under several keys in the same company: one block of each company is enough.
    blocks = materialise(blocks.groupBy("c", "lo", "hi", "x").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("c") / SLICE).alias("slices")), "head-blocks")
    members = keyed.join(blocks, "key").withColumn("slice", F.pmod(F.xxhash64("node", "key"), F.col("slices")))
    members = materialise(members.select("key", "slices", F.xxhash64("key", "slice").alias("tile"), "node"), "head-members")
    sketched = members.select("tile", "node").join(profiles.select("node", "n", "sketch"), "node").select("tile", "node", "n", "sketch")
    near = sketched.repartition("tile").sortWithinPartitions("tile").mapInArrow(lean(lambda batches: by_tile(batches, _cluster_work)), "a long, b long")
    near = materialise(near.select(F.col("a").alias("tile"), F.col("b").alias("node")).distinct(), "head-clusters")
    links = _in_tiles(_sized(near), _sets_of(docs, rows, near.select("node"), apart), _head_work)
    large = members.where("slices > 1")
    if large.limit(1).count() == 0:
        return links
    sets = materialise(_sets_of(docs, rows, large.select("node"), apart), "large-sets")
    leaders = _in_tiles(large.select("tile", "node"), sets, _leader_work).select(F.col("a").alias("node"), F.col("b").alias("tile"))
    slices = large.select("key", "tile").distinct()
    everywhere = leaders.join(slices, "tile").select("key", "node").distinct().join(slices, "key").select("tile", "node")
    again = _in_tiles(large.select("tile", "node").unionByName(everywhere), sets, _head_work)
    return links.unionByName(again)


def _other_links(docs: DataFrame, rows: DataFrame, profiles: DataFrame, comps: DataFrame, apart: bool) -> DataFrame:
    """Links (``a, b``: nodes, by which their components are named) between components among sets that share a prefix key.

    Sketches of sets tell which components may link; those that do, directly or by others, are
    a family. Each set of a family then goes whole to the tiles of its family, which are few.
    """
    members, marked = _other_tiles(profiles, comps)
    dealt = members.join(marked.select("node", "comp", "n", "sketch"), "node").select("tile", "comp", "n", "side", "sketch")
    near = materialise(_by_tiles(dealt, _near_work), "near-components")
    if near.limit(1).count() == 0:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    families = components(near).select(F.col("node").alias("comp"), F.col("comp").alias("family"))
    known = members.select("node").distinct().join(marked.select("node", "comp", "n"), "node").join(families, "comp")
    tiles = materialise(_dealt(materialise(known, "families"), ["family"]), "family-tiles")
    sets = materialise(_sets_of(docs, rows, tiles.select("node"), apart), "family-sets")
    return _by_tiles(tiles.join(sets, "node").select("tile", "comp", "side", "found"), _family_work)


def _by_tiles(rows: DataFrame, work: Callable) -> DataFrame:
    """``work`` on each tile of ``rows``: distinct pairs ``a, b``."""
    pairs = rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(lean(lambda batches: by_tile(batches, work)), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _other_tiles(profiles: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tile, node, side`` of sets that share a prefix key and may link across components, and the profiles with ``comp``.

    Blocks are of a key and a class of sizes: sets of the class and of the next one. Only blocks
    in which components still meet are looked at, and one of those with the same company. A block
    that is no more than a slice is a tile, others are dealt over several.
    """
    marked = materialise(profiles.drop("head").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "marked")
    keyed = marked.select("node", "comp", "n", F.explode("keys").alias("key"))
    open_keys = keyed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rows = _keyed(keyed, open_keys, "key").withColumn("own", F.floor(F.log("n") / F.lit(SIZE_STEP)))
    rows = materialise(rows.withColumn("class", F.explode(F.array(F.col("own"), F.col("own") - 1))), "open-rows")
    sign = [F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x")]
    open_ = rows.groupBy("key", "class").agg(*sign, F.min("comp").alias("one"), F.max("comp").alias("other"), F.count_if(F.col("own") == F.col("class")).alias("owns")).where("one <> other and owns > 0")
    # Sets of a class and the next have at most so many elements.
    slight = (F.col("c") <= SLICE) & (F.col("c") * F.exp((F.col("class") + 2) * SIZE_STEP) <= SLICE_ELEMENTS)
    once = materialise(open_.groupBy("c", "x", "class").agg(F.min("key").alias("key")).select("key", "class", slight.alias("slight")), "blocks")
    met = rows.drop("own").join(_sized(once), ["key", "class"])
    tiles = met.where("slight").select(F.xxhash64("key", "class").alias("tile"), "node", F.lit(1).alias("side"))
    if once.where("not slight").limit(1).count():
        large = materialise(met.where("not slight").drop("slight"), "block-rows")
        tiles = tiles.unionByName(_dealt(large, ["key", "class"]).select("tile", "node", "side"))
    return materialise(tiles, "tiles"), marked


def _dealt(rows: DataFrame, block: list[str]) -> DataFrame:
    """Rows (``node, comp, n``) of blocks with ``tile, side``: a block's sets in slices, which meet in tiles.

    Each slice of the largest component meets every slice of the others, its first one (side 0)
    where a slice of the others meets itself; slices of the others meet each other. No tile holds
    more than two slices, or three where one is of the largest component.
    """
    each = rows.groupBy(*block, "comp").agg(F.count("*").alias("count"), F.sum("n").alias("sum"))
    sums = each.groupBy(*block).agg(F.max(F.struct("count", "comp", "sum")).alias("m"), F.sum("count").alias("c"), F.sum("sum").alias("elements"))
    cut = lambda n, elements: F.ceil(F.greatest(n / SLICE, elements / SLICE_ELEMENTS)).cast("int")
    blocks = sums.select(*block, F.col("m.comp").alias("main"), cut(F.col("m.count"), F.col("m.sum")).alias("mains"), cut(F.col("c") - F.col("m.count"), F.col("elements") - F.col("m.sum")).alias("slices"))
    members = rows.join(blocks, block)
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("slices"))).cast("int")
    others = F.sequence(F.lit(0), F.col("slices") - 1)
    first, side = own == 0, F.when(own == 0, 0).otherwise(1)
    tiles = F.when(is_main, F.transform(others, lambda i: F.struct(F.when(first, i).otherwise(-own).alias("i"), i.alias("j"), side.alias("side"))))
    met = F.transform(others, lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j"), F.when(own <= i, 1).otherwise(2).alias("side")))
    later = F.filter(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: m > 0)
    tiles = tiles.otherwise(F.concat(met, F.transform(later, lambda m: F.struct((-m).alias("i"), own.alias("j"), F.lit(2).alias("side")))))
    return members.withColumn("t", F.explode(tiles)).select(*rows.columns, F.xxhash64(*block, "t.i", "t.j").alias("tile"), "t.side")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document: components of links of Jaccard 0.8 or more.

    Exact up to 64-bit hashes of shingles and sets. Equal sets are one node. Linked sets share an
    element of their prefixes (a fifth of a set, frequent elements last), so blocks of sets by
    prefix element hold all links. A block's sets stand in a signature tree whose dual traversal
    prunes pairs of nodes by sizes, by the most overlap that OR-combined bitmaps allow, and by
    component: first by a few keys, where near copies become one component; then by all keys and
    classes of sizes, but only where components still meet. Both times sketches of whole sets meet
    first, which bound from below in how many elements sets differ, and only those that may link
    are then compared whole.

    Words, shingles and the empty case are as the contract has them: a null text is empty, has no
    shingles and is its own component. Repeated rows get equal results, a row each; among equal
    sets with null doc_ids the least other id names the component (null if there is none). An
    empty table gives an empty table; other columns are ignored.
    """
    docs = doc_columns(docs, "doc_id", "text")
    rows, frequent = _hashes(docs)
    apart = _told_apart(rows)
    profiles = materialise(_profiles(docs, rows, frequent, apart), "profiles")
    near = materialise(_head_links(docs, rows, profiles, apart), "head-links")
    comps = components(near)
    rest = materialise(_other_links(docs, rows, profiles, comps, apart), "other-links")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    if rest.limit(1).count():  # links between components
        further = components(rest).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
        nodes = nodes.join(further, "comp", "left").withColumn("comp", F.coalesce("whole", "comp")).drop("whole")
    names = nodes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "comp").select("node", "component_id")
    out = rows.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, of each component the document whose doc_id names it.

    Rows of one doc_id that stay are one for each distinct text. Rows without a doc_id can't be
    told apart and stay.
    """
    comps = materialise(jaccard_components(docs), "ngram-components")
    keep = comps.where("doc_id = component_id").select("doc_id")
    again = materialise(keep.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = _keyed(docs, keep.distinct(), "doc_id").unionByName(docs.where("doc_id is null"))
    if again.limit(1).count() == 0:
        return kept
    twice = _keyed(kept, again, "doc_id").withColumn("__text", F.sha2("text", 256)).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return _keyed(kept, again, "doc_id", "leftanti").unionByName(twice)
