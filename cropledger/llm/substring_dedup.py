"""Repeated word passages, by matching statistics on compressed FM-indexes.

Every window of `length` words has one anchor: the word gram of least hash in it. The windows of one anchor are consecutive, so
a text falls into slices, each with the windows of one anchor, and equal windows lie in slices of equal anchors. Slices whose
anchor occurs in more than one text are dealt into shards by it. A shard indexes each of its different slices once, with
the least document that has it, as an FM-index: a Burrows-Wheeler transform of words in a Huffman-shaped wavelet tree. The
slices then stream through the index from their last word backward, all side by side: every step extends the interval of
suffixes that begin with the words read, and shortens it to `length` words. Where the matching statistic reaches `length`,
the least document of the interval tells from which document on the window is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropledger.llm.common import release, text_of
from cropledger.session import materialize, maybe_broadcast

LENGTH = 13
GRAM = 5
#: Words of one shard's index, about.
SHARD_WORDS = 300_000
#: The slices of an anchor with more different slices than this are dealt window by window, by the hash of the window.
HOT_SLICES = 2_000
#: 64-bit words of the bitmap of common anchors that is broadcast; it only saves shuffling, the join after it is exact.
FILTER_WORDS = 1 << 18
#: Texts that a Python worker gets at a time.
BATCH_TEXTS = 2_000

_GROUP_WORDS = 200_000  # words that are hashed at a time
_PIECE = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words as they come; forgotten when there are very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, from running minima of blocks of w."""
    blocks = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:len(v)] = v
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:len(v) - w + 1], ahead[w - 1:len(v)])


def cut_slices(h: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Slices of texts whose word hashes stand one after the other, text i before ends[i]: (text, first word in h, windows,
    anchor, hash of the slice's words) as arrays."""
    gram = min(gram, length)
    none = np.empty(0, dtype=np.int64)
    if len(h) < length:
        return none, none, none, none, none
    if len(h) > _PIECE + length - 1:  # windows of a piece begin in it
        parts = [cut_slices(h[at:at + _PIECE + length - 1], np.clip(ends - at, 0, _PIECE + length - 1), length, gram) for at in range(0, len(h), _PIECE)]
        parts = [(x[0], x[1] + at, *x[2:]) for at, x in zip(range(0, len(h), _PIECE), parts)]
        return tuple(np.concatenate([x[i] for x in parts]) for i in range(5))
    acc = np.full(len(h) - gram + 1, gram, dtype=np.uint64)
    for j in range(gram):
        acc = _mix(acc * np.uint64(_BASE) + h[j:len(h) - gram + 1 + j])
    packed = (acc & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(acc), dtype=np.uint64)
    place = (_least(packed, length - gram + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(place)), side="right")
    inside = np.flatnonzero(np.arange(len(place)) + length <= ends[text])
    if not len(inside):
        return none, none, none, none, none
    own = place[inside]
    new = np.flatnonzero(np.r_[True, (inside[1:] != inside[:-1] + 1) | (own[1:] != own[:-1]) | (text[inside[1:]] != text[inside[:-1]])])
    first, windows = inside[new], np.diff(np.r_[new, len(inside)])
    rise = np.full(len(h), np.uint64(_BASE), dtype=np.uint64)
    fall = np.full(len(h), np.uint64(pow(_BASE, -1, 2**64)), dtype=np.uint64)
    rise[0] = fall[0] = 1
    rise, fall = np.multiply.accumulate(rise), np.multiply.accumulate(fall)
    sums = np.r_[np.uint64(0), np.cumsum(_mix(h) * rise)]
    whole = _mix((sums[first + windows + length - 1] - sums[first]) * fall[first] + windows.astype(np.uint64))
    return text[first], first, windows, acc[own[new]].view(np.int64), whole.view(np.int64)


# Index of a shard

def huffman_lengths(count: np.ndarray) -> np.ndarray:
    """Code lengths of symbols by their counts; a symbol that stands alone has one bit."""
    if len(count) == 1:
        return np.ones(1, dtype=np.int64)
    # Nodes are made by rising weight, so the two least are always at the heads of two queues.
    order = np.argsort(count, kind="stable")
    weight, n = count[order].tolist(), len(count)
    parent, leaf, made = [0] * (2 * n - 1), 0, n
    for top in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (made >= top or weight[leaf] <= weight[made]):
                total, parent[leaf], leaf = total + weight[leaf], top, leaf + 1
            else:
                total, parent[made], made = total + weight[made], top, made + 1
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    out = np.empty(n, dtype=np.int64)
    out[order] = depth[:n]
    return out


class WaveletTree:
    """Ranks in a sequence of symbols 0..n-1, in a Huffman-shaped wavelet tree stored level by level: as many bits as the
    sequence's entropy asks for, and a running count for every 64 bits."""

    def __init__(self, seq: np.ndarray, symbols: int):
        count = np.bincount(seq, minlength=symbols)
        self.len = np.zeros(symbols, dtype=np.int64)
        self.len[count > 0] = huffman_lengths(count[count > 0])
        self.depth = int(self.len.max())
        order = np.lexsort((np.arange(symbols), self.len))
        order = order[self.len[order] > 0]
        self.code = np.zeros(symbols, dtype=np.int64)  # canonical, aligned to the left of `depth` bits
        room = np.int64(1) << (self.depth - self.len[order])
        self.code[order] = np.cumsum(room) - room
        self.start = np.zeros((self.depth + 1, symbols), dtype=np.int64)  # of the symbol's node on each level
        for level in range(self.depth + 1):
            held = np.where(self.len[order] > level, count[order], 0)
            node = self.code[order] >> (self.depth - level)
            before = np.cumsum(held) - held
            self.start[level, order] = before[np.searchsorted(node, node)]
        self.bits, self.sums = [], []
        self.before = np.zeros((self.depth, symbols), dtype=np.int64)  # ones before the node
        for level in range(self.depth):
            bit = (self.code[seq] >> (self.depth - 1 - level)) & 1
            packed = np.zeros((len(seq) // 64 + 1) * 64, dtype=np.uint8)
            packed[:len(seq)] = bit
            self.bits.append(np.packbits(packed, bitorder="little").view(np.uint64))
            self.sums.append(np.r_[0, np.cumsum(np.bitwise_count(self.bits[-1]).astype(np.int64))])
            self.before[level] = self._ones(level, np.minimum(self.start[level], len(seq)))
            ones = np.cumsum(bit) - bit - self.before[level, seq]
            rank = np.where(bit == 1, ones, np.arange(len(seq)) - self.start[level, seq] - ones)
            keep = self.len[seq] > level + 1
            below = np.empty(int(keep.sum()), dtype=seq.dtype)
            below[(self.start[level + 1, seq] + rank)[keep]] = seq[keep]
            seq = below

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.sums[level][word] + np.bitwise_count(self.bits[level][word] & low)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place, one by one."""
        out = at.copy()
        on = np.arange(len(symbol))
        for level in range(self.depth):
            on = on[self.len[symbol[on]] > level]
            s, here = symbol[on], out[on]
            ones = self._ones(level, self.start[level, s] + here) - self.before[level, s]
            out[on] = np.where((self.code[s] >> (self.depth - 1 - level)) & 1, ones, here - ones)
        return out


def suffix_order(seq: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes sorted by `depth` symbols at least, and the ranks by 1, 2, 4, ... symbols on the way."""
    n, rank, done = len(seq), seq.astype(np.uint64), 1
    bits, width = int(seq.max()).bit_length() + 1, n.bit_length()
    ranks = [(1, seq.astype(np.int64))]
    while True:
        later = np.zeros(n, dtype=np.uint64)
        later[:max(0, n - done)] = rank[done:] + np.uint64(1)
        key = (rank << np.uint64(bits)) | later
        if 2 * bits + width <= 64:  # key and place as one number
            both = np.sort((key << np.uint64(width)) | np.arange(n, dtype=np.uint64))
            order, key = (both & np.uint64((1 << width) - 1)).astype(np.int64), both >> np.uint64(width)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.uint64)
        bits, done = width + 1, 2 * done
        ranks.append((done, rank.astype(np.int64)))
        if done >= depth:
            return order, ranks


class FMIndex:
    """Compressed index of word sequences, each of one document: answers how long a match ends where, and in which least
    document. Matches are followed to `length` words and never cross from one sequence to the next."""

    def __init__(self, sequences: list[np.ndarray], docs: np.ndarray, length: int):
        self.length = length
        sizes = np.array([len(s) for s in sequences])
        flat = np.concatenate(sequences)
        self.vocabulary, dense = np.unique(flat, return_inverse=True)
        seq = np.zeros(len(flat) + len(sizes), dtype=np.int64)  # 0 ends every sequence
        at = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
        seq[at] = dense + 1
        order, ranks = suffix_order(seq, length + 1)
        self.tree = WaveletTree(seq[order - 1], len(self.vocabulary) + 1)
        self.first = np.r_[0, np.cumsum(np.bincount(seq, minlength=len(self.vocabulary) + 1))]
        p, q, n = order[:-1], order[1:], len(seq)
        same = np.zeros(n - 1, dtype=np.int64)
        for m, rank in reversed(ranks):
            if m <= length:
                padded = np.r_[rank, np.full(2 * length + 1, -1)]
                padded[n:] -= np.arange(2 * length + 1)
                same += m * (padded[p + same] == padded[q + same])
        self.common = np.r_[-1, same, -1]  # prefix shared with the suffix before
        owner = np.repeat(docs, sizes + 1)[order]
        low = np.flatnonzero(self.common[:-1] < length)
        self.least = np.repeat(np.minimum.reduceat(owner, low), np.diff(np.r_[low, n]))
        self._groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _group(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the interval of suffixes that share so many symbols with each suffix."""
        if length not in self._groups:
            low = np.flatnonzero(self.common[:-1] < length)
            width = np.diff(np.r_[low, len(self.common) - 1])
            self._groups[length] = np.repeat(low, width), np.repeat(low + width, width)
        return self._groups[length]

    def _step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.tree.rank(np.r_[c, c], np.r_[low, high]) + np.r_[self.first[c], self.first[c]]
        return both[:len(c)], both[len(c):]

    def statistics(self, streams: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For every word of every stream: how many words from it on occur in the index (at most `length`), and the least
        document of those places where `length` words do (the largest whole number elsewhere)."""
        sizes = np.array([len(s) for s in streams])
        flat = np.concatenate(streams) if len(streams) else np.empty(0, dtype=np.uint64)
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        word = np.where(self.vocabulary[at] == flat, at + 1, 0)
        ends, longest = np.cumsum(sizes), np.argsort(-sizes, kind="stable")
        found, least = np.zeros(len(flat), dtype=np.int64), np.full(len(flat), np.iinfo(np.int64).max)
        low, high, size = np.zeros(len(sizes), dtype=np.int64), np.full(len(sizes), self.first[-1]), np.zeros(len(sizes), dtype=np.int64)
        start, end = self._group(self.length)
        for step in range(int(sizes.max(initial=0))):
            on = longest[:int((sizes > step).sum())]
            place = ends[on] - 1 - step
            c = word[place]
            size[on[c == 0]] = 0
            low[on[c == 0]], high[on[c == 0]] = 0, self.first[-1]
            on, place, c = on[c > 0], place[c > 0], c[c > 0]
            a, b = self._step(c, low[on], high[on])
            miss = np.flatnonzero(a >= b)
            while len(miss):  # let go of the last words until the next one fits
                x = on[miss]
                size[x] -= 1
                for n in np.unique(size[x]).tolist():
                    y = x[size[x] == n]
                    g = self._group(n)
                    low[y], high[y] = g[0][low[y]], g[1][low[y]]
                a[miss], b[miss] = self._step(c[miss], low[x], high[x])
                miss = miss[a[miss] >= b[miss]]
            size[on] += 1
            low[on], high[on] = a, b
            full = on[size[on] > self.length]
            size[full], high[full] = self.length, end[low[full]]
            low[full] = start[low[full]]
            found[place] = size[on]
            full = size[on] == self.length
            least[place[full]] = self.least[low[on[full]]]
        cuts = ends[:-1]
        return np.split(found, cuts), np.split(least, cuts)


def least_documents(slices: list[np.ndarray], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For every window of every slice the least document of the shard that has it."""
    _, least = FMIndex(slices, docs, length).statistics(slices)
    return [x[:len(x) - length + 1] for x in least]


# On Spark

def _sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (tid, doc, text): of every text the first document, and those without an id; and (tid, first_doc) of the texts that
    more than one row has."""
    rows = docs.select(F.xxhash64(text_of()).alias("tid"), F.col("doc_id").cast("bigint").alias("doc"), text_of().alias("text"))
    each = rows.where("doc is not null").groupBy("tid", "doc").agg(F.count("*").alias("rows"))
    copies = each.groupBy("tid").agg(F.min(F.struct("doc", "rows")).alias("first"), F.sum("rows").alias("n")).where("n > 1")
    copies = materialize(copies.select("tid", F.col("first.doc").alias("first_doc"), F.col("first.rows").alias("rows")), "copied-texts")
    firsts = rows.join(maybe_broadcast(copies), "tid", "left").where("doc is null or first_doc is null or doc = first_doc")
    if copies.where("rows > 1").limit(1).count():  # rows repeated with their id
        again = firsts.where("doc is not null and rows > 1").dropDuplicates(["tid"])
        firsts = firsts.where("doc is null or rows is null or rows = 1").union(again)
    return firsts.select("tid", "doc", "text"), copies.select("tid", "first_doc")


def _slices(source: DataFrame, length: int, gram: int) -> DataFrame:
    """Flat rows: of every text one with n_words and sha (of its words joined by one space), and one for every slice, `once`
    where its anchor stands in the text for the first time. A text without id has no slices."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, done = WordHashes(), set()

        def close(held: list[tuple]) -> pd.DataFrame:
            sizes = np.array([len(x[4]) for x in held])
            ends = np.cumsum(sizes)
            text, first, windows, anchor, kind = cut_slices(np.concatenate([x[4] for x in held]), ends, length, gram)
            once = np.zeros(len(text), dtype=bool)
            once[np.unique(_mix(anchor.view(np.uint64) + text.astype(np.uint64)), return_index=True)[1]] = True
            tid, doc = (np.array([x[i] for x in held], dtype=np.int64) for i in (0, 1))
            n, none = len(held), len(text)

            def nullable(values: np.ndarray | list, of_texts: bool) -> pd.array:  # whole numbers stay exact
                out, known = np.zeros(n + none, dtype=np.int64), np.zeros(n + none, dtype=bool)
                own = slice(0, n) if of_texts else slice(n, None)
                out[own], known[own] = values, True
                return pd.arrays.IntegerArray(out, ~known)

            return pd.DataFrame({
                "tid": np.r_[tid, tid[text]], "doc": np.r_[doc, doc[text]], "n_words": nullable([x[2] for x in held], True), "sha": [x[3] for x in held] + [None] * none,
                "anchor": nullable(anchor, False), "kind": nullable(kind, False), "first": nullable(first - (ends - sizes)[text], False).astype("Int32"),
                "windows": nullable(windows, False).astype("Int32"), "once": np.r_[np.zeros(n, dtype=bool), once]})

        for b in batches:
            held, n = [], 0
            for tid, doc, without, text in zip(b["tid"].tolist(), b["doc"].tolist(), b["without"].tolist(), b["text"]):
                if (tid, without) in done:
                    continue  # rows repeated word for word
                done.add((tid, without))
                words = words_of(text)
                digest = hashlib.sha256(b" ".join(words)).hexdigest()
                held.append((tid, doc, len(words), digest, cache.of([] if without else words)))
                n += len(words)
                if n >= _GROUP_WORDS:
                    yield close(held)
                    held, n = [], 0
            del b  # so that no two batches of texts are held
            if held:
                yield close(held)

    numbered = source.select("tid", F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNull().alias("without"), "text")
    return numbered.mapInPandas(read, "tid bigint, doc bigint, n_words bigint, sha string, anchor bigint, kind bigint, first int, windows int, once boolean")


def _wanted(slices: DataFrame) -> DataFrame:
    """(tid, doc, anchor, kind, first, windows) of the slices whose anchor more than one text has."""
    common = materialize(slices.where("once").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "common-anchors")
    cell = F.pmod("anchor", F.lit(FILTER_WORDS)).cast("int").alias("cell")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(anchor, 24), 64) as int))")
    bitmap = materialize(common.select(cell, bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")), "anchor-bits")
    some = slices.where("anchor is not null").withColumn("cell", cell).join(F.broadcast(bitmap), "cell").where(F.col("bits").bitwiseAND(bit) != 0)
    return some.select("tid", "doc", "anchor", "kind", "first", "windows").join(common, "anchor")


def _shard_rows(source: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """(anchor, kind, doc, uses, ofs, window, words) of every kind: whole, or window by window where the anchor is hot (with the
    window's hash). Words are hashes of eight bytes; uses are the slices of the kind."""
    columns = ["anchor", "kind", "doc", "uses", "ofs", "window", "words"]
    fields = ["anchor", "kind", "doc", "uses", "first", "windows", "hot"]
    per_text = kinds.groupBy("tid").agg(F.collect_list(F.struct(*fields)).alias("slices"))
    per_text = per_text.select("tid", *[F.col(f"slices.{c}").alias(c) for c in fields])
    texts = source.where("doc is not null").join(maybe_broadcast(kinds.select(F.col("tid").alias("_tid")).distinct()), F.col("tid") == F.col("_tid"), "left_semi")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()

        def frame(out: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame([x[:5] + x[6:] for x in out], columns=columns[:5] + columns[6:])
            return made.assign(window=pd.array([x[5] for x in out], dtype="Int64"))[columns]

        for b in batches:
            out = []
            for text, *slices in zip(*(b[c] for c in ("text", *fields))):
                h = cache.of(words_of(text)).view(np.int64)
                for anchor, kind, doc, uses, at, n, hot in zip(*(x.tolist() for x in slices)):
                    if not hot:
                        out.append((anchor, kind, doc, uses, 0, None, h[at:at + n + length - 1].tobytes()))
                    else:
                        windows = [h[i:i + length].tobytes() for i in range(at, at + n)]
                        out += [(anchor, kind, doc, uses, i, xxhash.xxh3_64_intdigest(w) >> 1, w) for i, w in enumerate(windows)]
                if len(out) > 20_000:
                    yield frame(out)
                    out = []
            del b
            yield frame(out)

    cut_kind = "anchor bigint, kind bigint, doc bigint, uses bigint, ofs int, window bigint, words binary"
    return texts.select("tid", "text").join(per_text, "tid").select("text", *fields).mapInPandas(cut, cut_kind)


def _search(rows: DataFrame, words: int, length: int) -> DataFrame:
    """(anchor, kind, ofs, n, least): of every kind the runs of windows that have one least document. rows: (anchor, kind, doc,
    words); equal anchors meet in a shard."""
    shards = max(1, -(-int(words) // SHARD_WORDS))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["anchor", "kind"])
        least = least_documents([np.frombuffer(x, dtype=np.uint64) for x in pdf["words"]], pdf["doc"].to_numpy(), length)
        sizes = np.array([len(x) for x in least])
        flat, row = np.concatenate(least), np.repeat(np.arange(len(sizes)), sizes)
        new = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])])
        ofs = new - (np.cumsum(sizes) - sizes)[row[new]]
        return pd.DataFrame({"anchor": pdf["anchor"].to_numpy()[row[new]], "kind": pdf["kind"].to_numpy()[row[new]], "ofs": ofs.astype(np.int32),
                             "n": np.diff(np.r_[new, len(flat)]).astype(np.int32), "least": flat[new]})

    dealt = rows.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "kind", "doc", "words")
    return dealt.groupBy("shard").applyInPandas(search, "anchor bigint, kind bigint, ofs int, n int, least bigint")


def _repeats(source: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, kind, ofs, n, least) of all kinds of slices."""
    kinds = wanted.groupBy("anchor", "kind").agg(F.min(F.struct("doc", "tid", "first")).alias("m"), F.max("windows").alias("windows"), F.count("*").alias("uses"))
    kinds = materialize(kinds.select("anchor", "kind", "windows", "uses", "m.*"), "kinds")
    hot = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SLICES).select("anchor"), "hot-anchors")
    any_hot = hot.limit(1).count() > 0
    flagged = kinds.join(maybe_broadcast(hot.withColumn("hot", F.lit(True))), "anchor", "left") if any_hot else kinds.withColumn("hot", F.lit(False))
    flagged = flagged.withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = _shard_rows(source, flagged, length)
    if not any_hot:
        words = kinds.agg(F.sum(F.col("windows") + length - 1)).first()[0] or 0
        return _search(rows, words, length)
    rows = materialize(rows, "shard-rows")
    cold, each = rows.where("window is null"), rows.where("window is not null")
    shared = each.groupBy("window").agg(F.min("doc").alias("doc"), F.first("words").alias("words"), F.sum("uses").alias("uses")).where("uses > 1")
    shared = materialize(shared.select(F.col("window").alias("anchor"), F.lit(0).cast("bigint").alias("kind"), "doc", "words"), "hot-windows")
    total = cold.select("words").union(shared.select("words")).agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    found = materialize(_search(cold.select("anchor", "kind", "doc", "words").union(shared), total, length), "shard-runs")
    back = each.select("anchor", "kind", "ofs", F.col("window").alias("w")).join(found.select(F.col("anchor").alias("w"), "n", "least"), "w")
    return found.union(back.select("anchor", "kind", "ofs", "n", "least"))


def _spans(firsts: list[int], numbers: list[int], length: int) -> list[int]:
    """Runs of windows (first, number) as maximal word runs [first, end), one after the other."""
    out: list[int] = []
    for a, n in sorted(zip(firsts, numbers)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], a + n + length - 1)
        else:
            out += [a, a + n + length - 1]
    return out


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside hand texts to Python in batches of so many rows, for the memory of workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def passage_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four tables: (tid, doc, text) of the first document of every text, (tid, n_words, sha) of every text, (tid, first_doc) of the
    texts that several rows have, and (tid, firsts, numbers) of the texts whose first document loses words. A text is told by its hash;
    firsts and numbers are runs of windows that are repeats."""
    source, copies = _sources(docs)
    with _batches_of(docs.sparkSession, BATCH_TEXTS):
        flat = materialize(_slices(source, length, gram), "passage-slices")
    info = materialize(flat.where("sha is not null").select("tid", "n_words", "sha").dropDuplicates(["tid"]), "passage-texts")
    wanted = materialize(_wanted(flat), "wanted-slices")
    release(flat)
    with _batches_of(docs.sparkSession, BATCH_TEXTS):
        found = materialize(_repeats(source, wanted, length), "passage-runs")
    gone = wanted.join(found, ["anchor", "kind"]).where("least < doc").select("tid", (F.col("first") + F.col("ofs")).alias("first"), "n")
    gone = gone.groupBy("tid").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    gone = materialize(gone.select("tid", F.col("runs.first").alias("firsts"), F.col("runs.n").alias("numbers")), "passage-spans")
    release(wanted)
    return source, info, copies, gone


def kept_words(text: str, spans: list[int]) -> bytes:
    """The words outside the spans, joined by one space."""
    words, out, at = words_of(text), [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out += words[at:a]
        at = b
    return b" ".join(out + words[at:])


def _by_row(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc_id, tid, copy) of every row: whether a document of smaller id has the same text."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("tid")).join(maybe_broadcast(copies), "tid", "left")
    return rows.select("doc_id", "tid", F.coalesce(F.col("doc_id").cast("bigint") > F.col("first_doc"), F.lit(False)).alias("copy"))


def remove_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text (the words that stay, joined by one space) and spans (word runs [first, end) removed) of every row.

    A null text has no words. A row without doc_id is no source and keeps all its words; rows that repeat a doc_id are not
    earlier than each other. Ids are whole numbers. An empty table gives an empty result.
    """
    _, _, copies, gone = passage_runs(docs, length, gram)
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("tid"), text_of().alias("text"), F.col("doc_id").cast("bigint").alias("doc"))
    rows = rows.join(maybe_broadcast(copies), "tid", "left").join(gone, "tid", "left")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, firsts, numbers, copy, null in zip(b["text"], b["firsts"], b["numbers"], b["copy"], b["null"]):
                n = len(words_of(text))
                spans = [] if null else [0, n] if copy and n >= length else [] if copy or firsts is None else _spans(firsts.tolist(), numbers.tolist(), length)
                out.append((kept_words(text, spans).decode("utf-8", "surrogatepass"), spans))
            yield b[["doc_id"]].assign(text=[x[0] for x in out], spans=[x[1] for x in out])

    rows = rows.select("doc_id", "text", "firsts", "numbers", F.coalesce(F.col("doc") > F.col("first_doc"), F.lit(False)).alias("copy"), F.col("doc").isNull().alias("null"))
    return rows.mapInPandas(strip, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, spans array<int>")


def op12_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: words, words removed, and the hash of the words that stay. Nulls, repeats and empty tables as in
    remove_passages."""
    source, info, copies, gone = passage_runs(docs, length)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [_spans(f.tolist(), n.tolist(), length) for f, n in zip(b["firsts"], b["numbers"])]
            made = b[["tid"]].assign(removed=[sum(s[1::2]) - sum(s[::2]) for s in spans], kept=[hashlib.sha256(kept_words(t, s)).hexdigest() for t, s in zip(b["text"], spans)])
            del b
            yield made

    touched = source.where("doc is not null").select("tid", "text")
    touched = touched.join(maybe_broadcast(gone.select(F.col("tid").alias("_tid"))), F.col("tid") == F.col("_tid"), "left_semi").join(gone, "tid")
    with _batches_of(docs.sparkSession, BATCH_TEXTS):  # one Python step, so a task has one worker
        cut = materialize(touched.mapInPandas(digest, "tid bigint, removed bigint, kept string").dropDuplicates(["tid"]), "cut-texts")
    whole = F.col("copy") & (F.col("n_words") >= length)
    own = ~F.col("copy") & F.col("doc_id").isNotNull()
    out = _by_row(docs, copies).join(info, "tid").join(cut, "tid", "left")
    return out.select("doc_id", "n_words",
                      F.when(whole, F.col("n_words")).when(own, F.coalesce("removed", F.lit(0))).otherwise(0).cast("bigint").alias("n_removed"),
                      F.when(whole, F.sha2(F.lit(""), 256)).when(own, F.coalesce("kept", "sha")).otherwise(F.col("sha")).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM
        (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT r, list(DISTINCT i + k) AS hits FROM win JOIN firsts USING (s), range(0, 13) t(k) WHERE least < doc_id GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(hits), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN hits IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(hits, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
