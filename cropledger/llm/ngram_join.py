"""Exact n-gram Jaccard join with signature trees.

A document is the set of its hashed word n-grams; documents with equal sets are one class. Two sets of the wanted similarity
differ in few elements, so when the elements are dealt into a quarter more parts than that, at least that quarter is equal.
Classes that share as many parts as they must are candidates, and connected candidates form a block. Parts that many
classes share (of a common passage, or of a group of near copies) are not paired; they only count for classes that would not
have enough other parts in common. In every block the sets are the leaves of a
signature tree, whose nodes hold OR-combined bitmaps of elements and ranges of sizes. A dual traversal from the root leaves
out each pair of nodes whose largest possible overlap, or whose sizes, cannot reach the similarity, and compares the sets
of the leaf pairs that remain. Pairs that are already known to be connected need not be compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropledger.llm.common import release, text_of
from cropledger.llm.components import components
from cropledger.session import materialize, maybe_broadcast

FANOUT = 8
#: A part that more classes share is wide: its classes are not paired with each other.
WIDE_PART = 8
#: Blocks of more classes are first compared with about HUBS of their classes, in ROUNDS, each in chunks of CHUNK_ROWS.
BLOCK_ROWS = 400
CHUNK_ROWS = 200
HUBS = 24
ROUNDS = 1
#: Passes in which near copies of low similarity are posted: their sets have many parts, and the postings of one pass lie on disk at once.
SLICES = 3
#: Classes that one task compares at a time, in blocks put together.
TASK_ROWS = 600

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of fewer words the whole sequence; of none nothing."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = min(n, len(h))
    acc = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        acc = _mix(acc * _M3 + h[j:len(h) - n + 1 + j])
    return np.unique(acc)


class Levels:
    """Size bands, and the parts into which sets are dealt so that similar ones of neighbouring bands meet.

    Similar means q * |x & y| >= p * |x | y|. Sizes that can be similar lie in one band or in two neighbouring ones.
    """

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.low = [1]

    def band(self, n: int) -> int:
        while self.low[-1] <= n * self.q // self.p:
            self.low.append(self.low[-1] * self.q * self.q // (self.p * self.p) + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def keys(self, grams: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(level, spare, keys) at each level: hashes of (level, part, elements in the part). Of the parts of this set, similar
        sets that meet it there have at least `spare` in common."""
        n, out = len(grams), []
        if not n:
            return out
        band = self.band(n)
        for level in (band, band + 1):
            if level > band and n * self.q // self.p < self.low[level]:
                continue
            while len(self.low) < level + 2:
                self.low.append(self.low[-1] * self.q * self.q // (self.p * self.p) + 1)
            differ = 2 * (self.low[level + 1] - 1) * (self.q - self.p) // (self.q + self.p)
            if not differ:
                continue  # only equal sets are similar
            parts = differ + 2 + differ // 4
            part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # rises with the sorted hashes
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
            keys = _mix(np.add.reduceat(_mix(grams ^ salt), first) + _mix(part[first] + salt))
            if len(first) <= differ:  # so many parts are empty that an equal one may be: those count as well
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
                keys = np.concatenate([keys, _mix(_mix(empty + salt))])
            out.append((level, len(first) - differ, keys))
        return out


def similar(x: np.ndarray, y: np.ndarray, p: int, q: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return q * both >= p * (len(x) + len(y) - both)


class SignatureTree:
    """Levels of nodes from the leaves (one set each) to the root; sets of like sizes and small hashes lie together."""

    def __init__(self, sets: list[np.ndarray], group: np.ndarray):
        sizes = np.array([len(s) for s in sets])
        self.order = np.lexsort(([int(s[0]) for s in sets], sizes))
        bits = 64
        while bits < 4 * sizes.max() and bits < 1 << 17:
            bits *= 2
        maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for row, i in enumerate(self.order):
            at = (sets[i] % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(maps[row], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        size = sizes[self.order]
        # A set has so many elements more than bits.
        self.levels = [(maps, size, size, size - np.bitwise_count(maps).sum(1).astype(np.int64), group[self.order])]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, more, same = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            g_low, g_high = np.minimum.reduceat(same, at), np.maximum.reduceat(same, at)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(more, at), np.where(g_low == g_high, g_low, -1)))

    def candidate_pairs(self, p: int, q: int) -> Iterator[tuple[int, int]]:
        """Leaf pairs of different groups that may be similar: node pairs are followed down while their largest possible
        overlap suffices. A node is of one group or of several (-1)."""
        a = b = np.zeros(1, dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            maps, low, high, more, same = self.levels[depth]
            if depth < len(self.levels) - 1:
                step = np.arange(FANOUT)
                ca = (a[:, None, None] * FANOUT + step[None, :, None]).repeat(FANOUT, 2).ravel()
                cb = (b[:, None, None] * FANOUT + step[None, None, :]).repeat(FANOUT, 1).ravel()
                fit = (ca <= cb) & (ca < len(maps)) & (cb < len(maps))
                a, b = ca[fit], cb[fit]
            fit = (a != b) if depth == 0 else np.ones(len(a), dtype=bool)
            fit &= ((same[a] != same[b]) | (same[a] < 0)) & (high[a] * q >= low[b] * p) & (high[b] * q >= low[a] * p)
            a, b = a[fit], b[fit]
            fit = np.ones(len(a), dtype=bool)
            for i in range(0, len(a), 4096):
                x, y = a[i:i + 4096], b[i:i + 4096]
                most = np.bitwise_count(maps[x] & maps[y]).sum(1).astype(np.int64) + np.minimum(more[x], more[y])
                most = np.minimum(most, np.minimum(high[x], high[y]))
                fit[i:i + 4096] = most * (p + q) >= p * (low[x] + low[y])
            a, b = a[fit], b[fit]
        yield from zip(self.order[a], self.order[b])


def _links(ids: list[int], group: np.ndarray, sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Links that connect all similar sets; sets of one group count as connected."""
    parent: dict[int, int] = {}

    def root(g: int) -> int:
        while parent.get(g, g) != g:
            g = parent[g] = parent.get(parent[g], parent[g])
        return g

    out = []
    for i, j in SignatureTree(sets, group).candidate_pairs(p, q):
        gi, gj = root(int(group[i])), root(int(group[j]))
        if gi != gj and similar(sets[i], sets[j], p, q):
            parent[gi] = gj
            out.append((ids[i], ids[j]))
    return out


def _class_of(grams: np.ndarray) -> int | None:
    return int(_mix(_mix(grams).sum(keepdims=True) + np.uint64(len(grams))).view(np.int64)[0]) if len(grams) else None


def _meetings(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """(x, y, level, spare of x, wide) from postings (key, cls, level and spare in one) sorted by key and class: all pairs x < y of a key, or, for a wide key, every
    class x and the first one y. No more than `most` classes of a key are held at a time."""
    key, last, wide, seen, out = None, None, False, [], []

    def close() -> None:
        out.extend((a[0], b[0], a[1], a[2], False) for i, a in enumerate(seen) for b in seen[i + 1:])

    def flush() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["x", "y", "level", "spare", "wide"])
        out.clear()
        return made.astype({"x": "int64", "y": "int64", "level": "int32", "spare": "int32", "wide": "bool"})

    for b in batches:
        if not len(b):
            continue
        k, c, own = (b[x].to_numpy() for x in ("key", "cls", "own"))
        level, spare = own >> 32, own & 0xFFFFFFFF
        more = np.r_[True, k[1:] == k[:-1]]  # keys that stand alone within the batch are passed over
        at = np.flatnonzero(more | np.r_[more[1:], True])
        for key_i, c_i, level_i, spare_i in zip(k[at].tolist(), c[at].tolist(), level[at].tolist(), spare[at].tolist()):
            if key_i != key:
                close()
                key, last, wide, seen = key_i, None, False, []
            if c_i == last:
                continue
            last = c_i
            if not wide:
                seen.append((c_i, level_i, spare_i))
                if len(seen) > most:
                    wide, hub = True, seen[0][0]
                    out.extend((m[0], hub, m[1], m[2], True) for m in seen)
                    seen = []
            else:
                out.append((c_i, hub, level_i, spare_i, True))
        if out:
            yield flush()
    close()
    if out:
        yield flush()


def _candidates(source: DataFrame, n: int, p: int, q: int, slices: int = 1) -> DataFrame:
    """(cls, hub, wide): edges that connect all classes which may be similar. Pairs that may be similar are edges themselves, but for
    pairs of two classes that both have wide edges. A key is posted in one of ``slices`` passes, all its classes in the same one.

    Of x's parts, similar classes share `spare` at least; of those that are not wide, `spare` less the number of x's wide parts.
    Where that is one or more, the pair meets in parts that are paired, and pairs with fewer meetings go. Where it is none,
    for both, x and y share a wide part, and their edges to its first class connect them.
    """

    def post(batches: Iterator[pd.DataFrame], number: int) -> Iterator[pd.DataFrame]:
        levels, done = Levels(p, q), set()
        for b in batches:
            made = []
            for text in b["text"]:
                g = gram_set(text, n)
                cls = _class_of(g)
                if cls is None or cls in done:
                    continue  # equal sets are posted once by a task
                done.add(cls)
                made += [(cls, level, spare, keys[keys % np.uint64(slices) == number] if slices > 1 else keys) for level, spare, keys in levels.keys(g)]
            for i in range(0, len(made), 256):
                some = made[i:i + 256]
                size = [len(m[3]) for m in some]
                yield pd.DataFrame({"key": np.concatenate([m[3] for m in some]).view(np.int64), "cls": np.repeat([m[0] for m in some], size),
                                    "own": np.repeat([m[1] << 32 | m[2] for m in some], size)})

    most, passes = WIDE_PART, []
    for number in range(slices):
        posted = source.select("text").mapInPandas(lambda batches, number=number: post(batches, number), "key bigint, cls bigint, own bigint")
        met = posted.repartition("key").sortWithinPartitions("key", "cls").mapInPandas(lambda batches: _meetings(batches, most), "x bigint, y bigint, level int, spare int, wide boolean")
        passes.append(materialize(met, "meetings"))
    met = reduce(DataFrame.union, passes)
    wide = materialize(met.where("wide").groupBy("x", "level").agg(F.count("*").alias("n_wide")), "wide-parts")
    pairs = met.where("not wide").groupBy("x", "y", "level").agg(F.count("*").alias("n"), F.min("spare").alias("spare")).join(wide, ["x", "level"], "left")
    pairs = pairs.where(F.col("n") >= F.greatest(F.lit(1), F.col("spare") - F.coalesce("n_wide", F.lit(0)))).select(F.col("y").alias("cls"), F.col("x").alias("hub"), F.lit(False).alias("wide"))
    hubs = met.where("wide and x <> y").join(wide, ["x", "level"]).where("spare <= n_wide").select(F.col("x").alias("cls"), F.col("y").alias("hub"), F.lit(True).alias("wide"))
    edges = materialize(pairs.union(hubs).distinct(), "candidates")
    for met in passes:
        release(met)
    return edges


def similarity_classes(docs: DataFrame, n: int, p: int, q: int, slices: int = 1) -> DataFrame:
    """doc_id, th (hash of the text), n_grams, cls and root of every row: equal sets have one cls, linked ones one root.

    Rows without words have cls and root null. Null doc_ids and repeated rows are rows like others.
    """
    source = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), text_of().alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [gram_set(text, n) for text in b["text"]]
            yield b[["doc_id", "th"]].assign(n_grams=[len(g) for g in sets], cls=pd.array([_class_of(g) for g in sets], dtype="Int64"))

    kind = dict(docs.dtypes)["doc_id"]
    rows = materialize(source.mapInPandas(read, f"doc_id {kind}, th bigint, n_grams bigint, cls bigint"), "gram-sets")
    edges = _candidates(source, n, p, q, slices)
    blocks = components(edges.select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    links, used = _block_links(source, rows, edges, blocks, n, p, q)
    links = materialize(links, "links")
    for done in (edges, *used):
        release(done)
    found = components(links).select(F.col("node").alias("cls"), "root")
    return rows.select("doc_id", "th", "n_grams", "cls").join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _block_links(source: DataFrame, rows: DataFrame, edges: DataFrame, blocks: DataFrame, n: int, p: int, q: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links between classes that connect all similar classes of every block. With them the tables of sets that they read."""
    one = rows.join(blocks.select(F.col("node").alias("cls"), F.col("root").alias("block")), "cls")
    one = materialize(one.groupBy("cls", "block").agg(F.min(F.struct("doc_id", "th")).alias("m")).select("cls", "block", "m.*"), "members")
    kept = maybe_broadcast(one.select("cls", "block", F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    texts = source.join(kept, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("cls", "block", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["cls", "block"]].assign(grams=[gram_set(t, n).view(np.int64) for t in b["text"]])

    # A row that is repeated word for word brings its set more than once; that changes nothing below.
    members = materialize(texts.mapInPandas(sets, "cls bigint, block bigint, grams array<bigint>"), "member-sets")
    sizes = blocks.groupBy(F.col("root").alias("block")).agg(F.count("*").alias("n_block"))
    large = materialize(sizes.where(F.col("n_block") > BLOCK_ROWS), "large-blocks")
    some_large = large.limit(1).count() > 0
    small = members.join(large.select("block"), "block", "left_anti") if some_large else members
    tasks = max(1, -(-members.count() // TASK_ROWS))
    small = small.select(F.pmod(F.xxhash64("block"), F.lit(tasks)).alias("task"), "block", "cls", F.col("cls").alias("grp"), "grams")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.drop_duplicates(["block", "cls"]).groupby("block", sort=False):
            if len(g) > 1:
                out += _links(g["cls"].tolist(), g["grp"].to_numpy(), [np.asarray(x).view(np.uint64) for x in g["grams"]], p, q)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = small.groupBy("task").applyInPandas(compare, "a bigint, b bigint")
    if not some_large:
        return links, [members]
    more, used = _large_block_links(members, edges, large, compare, p, q)
    return links.union(more), [members, *used]


def _large_block_links(members: DataFrame, edges: DataFrame, large: DataFrame, compare, p: int, q: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links in blocks too large for one tree, and the tables of sets that they read.

    Each class is first compared with some hubs of its block. What is connected then is a group, and a group is never compared
    with itself. Of the candidate pairs only those between two groups are compared; then, among classes with wide parts alone,
    chunks of different groups meet. So a group of copies costs work in proportion.
    """
    own = members.join(large, "block").select("block", "cls", "grams", "n_block").dropDuplicates(["cls"])
    own = materialize(own, "large-sets")
    sure = None
    for number in range(ROUNDS):
        groups = components(sure.select("a", "b")) if sure is not None else None
        found = materialize(_hub_links(own, groups, number, p, q), "hub-links")
        sure = found if sure is None else materialize(sure.union(found), "sure-links")
    groups = components(sure)
    pairs = _open_pairs(edges.where("not wide and cls <> hub"), own, groups)
    pairs = pairs.join(own.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a").join(own.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    pairs = pairs.where(both * q >= p * (F.size("x") + F.size("y") - both)).select("a", "b")
    sure = materialize(sure.union(pairs), "sure-links")
    wide = edges.where("wide").select(F.explode(F.array("cls", "hub")).alias("cls")).distinct()
    rows = own.join(components(sure).withColumnRenamed("node", "cls"), "cls", "left").withColumn("grp", F.coalesce("root", "cls"))
    rows = materialize(rows.join(wide, "cls", "left_semi").select("block", "cls", "grp", "grams"), "grouped")
    per = rows.groupBy("block", "grp").agg(F.count("*").alias("n"))
    open_ = per.groupBy("block").agg(F.count("*").alias("groups")).where("groups > 1").select("block")  # the others are of one group
    per = per.join(open_, "block", "left_semi")
    mixed = per.where(F.col("n") <= CHUNK_ROWS).groupBy("block").agg(F.sum("n").alias("n_mixed"))
    per = per.join(mixed, "block", "left")
    chunk = F.when(F.col("n") > CHUNK_ROWS, F.xxhash64("grp", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / CHUNK_ROWS))))
    chunk = F.coalesce(chunk, F.xxhash64("block", F.lit("mixed"), F.pmod(F.xxhash64("grp"), F.ceil(F.col("n_mixed") / CHUNK_ROWS))))
    whole = F.when(F.col("n") > CHUNK_ROWS, F.col("grp"))  # the group of a chunk that is of one group
    placed = rows.join(per, ["block", "grp"]).select("block", "cls", "grp", "grams", chunk.alias("chunk"), whole.alias("whole"))
    placed = materialize(placed, "chunks")
    chunks = materialize(placed.select("block", "chunk", "whole").distinct(), "chunk-list")
    left, right = chunks.toDF("block", "c1", "w1"), chunks.toDF("block", "c2", "w2")
    pairs = left.join(right, "block").where((F.col("c1") < F.col("c2")) | ((F.col("c1") == F.col("c2")) & F.col("w1").isNull()))
    pairs = pairs.where(F.col("w1").isNull() | F.col("w2").isNull() | (F.col("w1") != F.col("w2"))).select("c1", "c2")
    ends = pairs.select(F.explode(F.array_distinct(F.array("c1", "c2"))).alias("chunk"), F.xxhash64("c1", "c2").alias("task"))
    met = placed.join(ends, "chunk").select("task", F.col("task").alias("block"), "cls", "grp", "grams")
    out = met.groupBy("task").applyInPandas(compare, "a bigint, b bigint")
    release(rows)
    return out.union(sure.select("a", "b")), [own, placed]


def _hub_links(own: DataFrame, groups: DataFrame | None, number: int, p: int, q: int) -> DataFrame:
    """(a, b): each class and the hubs that it is similar to. Hubs are about HUBS classes of each block, of different groups and
    drawn by hash; classes in the group of a hub are not compared with it."""
    if groups is None:
        rows = own.withColumn("grp", F.col("cls"))
    else:
        rows = own.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("grp", F.coalesce("root", "cls")).drop("root")
        rows = materialize(rows, "round")
    tops = rows.where("cls = grp")
    share = tops.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / HUBS)).alias("one_of"))
    tops = tops.join(share, "block").where(F.pmod(F.xxhash64("cls", F.lit(number)), F.col("one_of")) == 0)
    n_chunks = F.greatest(F.lit(1), F.ceil(F.col("n_block") / CHUNK_ROWS))
    to = tops.select("block", "cls", "grp", "grams", F.explode(F.sequence(F.lit(0), (n_chunks - 1).cast("int"))).alias("no"), F.lit(True).alias("is_hub"))
    every = rows.select("block", "cls", "grp", "grams", F.pmod(F.xxhash64("cls", F.lit("chunk")), n_chunks).cast("int").alias("no"), F.lit(False).alias("is_hub"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(x).view(np.uint64) for x in pdf["grams"]]
        cls, grp, hub = pdf["cls"].tolist(), pdf["grp"].tolist(), pdf["is_hub"].tolist()
        hubs, out = [i for i, h in enumerate(hub) if h], []
        for i in range(len(cls)):
            if not hub[i]:
                out += [(cls[i], cls[j]) for j in hubs if grp[i] != grp[j] and _sizes_fit(len(sets[i]), len(sets[j]), p, q) and similar(sets[i], sets[j], p, q)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return every.union(to).groupBy("block", "no").applyInPandas(compare, "a bigint, b bigint")


def _sizes_fit(m: int, n: int, p: int, q: int) -> bool:
    return min(m, n) * q >= max(m, n) * p


def _open_pairs(pairs: DataFrame, own: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): candidate pairs of large blocks whose classes are of two groups."""
    label = own.select("cls").join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("grp"))
    label = materialize(label, "group-labels")
    out = pairs.join(label, "cls").join(label.select(F.col("cls").alias("hub"), F.col("grp").alias("hub_grp")), "hub").where("grp <> hub_grp")
    return materialize(out.select(F.col("cls").alias("a"), F.col("hub").alias("b")), "open-pairs")


def op2_jaccard(docs: DataFrame, n: int = 3, p: int = 90, q: int = 100) -> DataFrame:
    """Per document: size of its set, and the smallest doc_id that it reaches by links (equal sets are linked).

    Null, empty and blank texts have no set: size 0, component their own doc_id. Long texts count whole. Repeated rows each get
    their result; a null doc_id is never the smallest but where all of a component are null. An empty table gives an empty result.
    """
    rows = materialize(similarity_classes(docs, n, p, q), "classes")
    least = materialize(rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    out = rows.join(least, "root", "left")
    return out.select("doc_id", F.col("n_grams").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, p: int = 8, q: int = 10, slices: int = SLICES) -> DataFrame:
    """One document of each group of linked ones, that of the smallest doc_id (then text hash), with its columns as they
    are. Of rows repeated with id and text one stays. Documents without words all stay."""
    rows = materialize(similarity_classes(docs, n, p, q, slices).where(F.col("root").isNotNull()), "classes")
    first = materialize(rows.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("first")), "first")
    gone = rows.join(first, "root").where(~F.struct("doc_id", "th").eqNullSafe(F.col("first")))
    gone = materialize(gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "gone")
    th = F.xxhash64(text_of(docs["text"]))
    kept = docs.join(maybe_broadcast(gone), (th == F.col("_th")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti")
    repeated = rows.join(first, "root").where(F.struct("doc_id", "th").eqNullSafe(F.col("first"))).groupBy("root").count().where("count > 1")
    if not repeated.limit(1).count():
        return kept
    # Rows without words are kept as they are, of the others one row for each id and text.
    worded = F.length(F.regexp_replace(text_of(), r"[\x20\x09-\x0D]+", "")) > 0
    return kept.where(worded).dropDuplicates(["doc_id", "text"]).union(kept.where(~worded))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM
        (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM g GROUP BY ALL),
pairs AS (SELECT x.r AS a, y.r AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.r < y.r GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (WITH RECURSIVE t AS (SELECT r AS a, r AS b FROM n UNION SELECT t.a, l.b FROM t JOIN both_ways l ON l.a = t.b) SELECT * FROM t)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r
LEFT JOIN (SELECT a, min(doc_id) AS c FROM reach JOIN d ON d.r = reach.b GROUP BY a) m ON m.a = d.r
"""
