"""Repeated byte strings across a corpus, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every window of `length` bytes has one anchor: the gram of least hash in it (the first of several). The windows of one
anchor are consecutive, so a text falls into slices, each with the windows of one anchor. Equal windows have equal anchors,
so only slices whose anchor occurs more than once can hold repeated windows. Slices equal throughout are counted. Different
slices of one anchor are brought together, and the transform of their bytes is extended backward, breadth first: patterns
of one byte, of two, and so on; the suffix boundary behind each pattern's interval has a common prefix as long as the number
of steps so far. Expansion stops at `length`: boundaries not reached by then lie between suffixes that share that many bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropledger.llm.common import text_of
from cropledger.session import materialize, maybe_broadcast

LENGTH = 400
#: Slices whose bytes one task transforms, about.
TASK_SLICES = 2_500
#: An anchor with more different slices than this has its windows counted one by one instead, by hash.
HOT_SLICES = 1_500

_PIECE = 1 << 20  # windows that are looked through at a time
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _PIECE + 4096), _powers(_INVERSE, _PIECE + 4096)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every gram, wherever it stands, from running sums of byte * base ** place."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _DOWN[:len(data) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values: running minima of blocks of w, from either end."""
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - w + 1], forward[w - 1:n])


def slices_of(data: bytes, length: int) -> list[tuple[int, int, int, int, int]]:
    """(anchor hash, two hashes of the slice, first window, windows) of every slice."""
    gram = max(1, min(64, length // 4))
    w, out = length - gram + 1, []
    for at in range(0, len(data) - length + 1, _PIECE):
        piece = np.frombuffer(data, dtype=np.uint8)[at:at + _PIECE + length - 1]
        h = _gram_hashes(piece, gram)
        packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        place = (_least(packed, w) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        for s, e, p in zip(first.tolist(), [*first[1:].tolist(), len(place)], place[first].tolist()):
            whole = xxhash.xxh3_128_intdigest((p - s).to_bytes(4, "little") + data[at + s:at + e - 1 + length])
            out.append((_signed(xxhash.xxh3_64_intdigest(data[at + p:at + p + gram])), _signed(whole >> 64), _signed(whole & (2**64 - 1)), at + s, e - s))
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _sorted_by(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of so many bits, and where a key differs from the one before. Key and place are sorted as one number
    where both fit into 64 bits, which is much faster."""
    n = len(key)
    width = max(1, n - 1).bit_length()
    if bits + width <= 64:
        both = np.sort((key << np.uint64(width)) | np.arange(n, dtype=np.uint64))
        order, key = (both & np.uint64((1 << width) - 1)).astype(np.int64), both >> np.uint64(width)
    else:
        order = np.argsort(key)
        key = key[order]
    return order, np.r_[False, key[1:] != key[:-1]]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` bytes at least (prefix doubling from a few bytes on)."""
    n = len(text)
    width = max(1, n).bit_length()
    done = max(1, min(7, (64 - width) // 8))
    padded = np.concatenate([text, np.zeros(done, dtype=np.uint8)]).astype(np.uint64)
    key, bits = np.zeros(n, dtype=np.uint64), 8 * done
    for j in range(done):
        key = (key << np.uint64(8)) | padded[j:n + j]
    while True:
        order, step = _sorted_by(key, bits)
        if done >= depth or step.sum() == n - 1:
            return order
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(step).astype(np.uint64)
        later = np.zeros(n, dtype=np.uint64)
        if done < n:
            later[:n - done] = rank[done:] + np.uint64(1)
        key, bits = (rank << np.uint64(width)) | later, 2 * width
        done *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For every boundary between neighbours of the suffix order the length of their common prefix, -1 for `length` or more."""
    n = len(text)
    before = text[order - 1]  # the transform; the first suffix is preceded by the last byte
    extended = np.empty(n, dtype=np.int64)  # where the suffix one byte longer stands
    by_byte = np.argsort(before, kind="stable")
    extended[by_byte] = np.arange(n)
    prefix = np.full(n + 1, -1, dtype=np.int32)
    prefix[0] = prefix[n] = 0
    low, high = np.zeros(1, dtype=np.int64), np.full(1, n, dtype=np.int64)
    for steps in range(length):
        if not len(low):
            break
        width = high - low
        which = np.repeat(np.arange(len(low)), width)
        at = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        to = extended[at]
        sort, _ = _sorted_by(to.astype(np.uint64), n.bit_length())
        to, which, byte = to[sort], which[sort], before[at[sort]]
        first = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (byte[1:] != byte[:-1]) | (to[1:] != to[:-1] + 1)])
        last = np.r_[first[1:], len(to)] - 1
        low, high = to[first], to[last] + 1
        new = prefix[high] < 0
        prefix[high[new]] = steps
        if steps == 0:
            new |= high == n  # the last pattern of one byte ends where the order ends
        low, high = low[new], high[new]
    return prefix


def repeated_windows(slices: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For every slice a mask of its windows: whether the window occurs again in another slice or place."""
    text = np.frombuffer(b"\xff".join(slices) + b"\xff", dtype=np.uint8)
    starts = np.cumsum([0] + [len(s) + 1 for s in slices[:-1]])
    window = np.zeros(len(text), dtype=bool)
    for s, c in zip(starts, counts):
        window[s:s + c] = True
    order = suffix_order(text, length)
    prefix = common_prefixes(text, order, length)
    group = np.flatnonzero(np.r_[True, prefix[1:-1] >= 0])
    own = window[order]
    many = np.add.reduceat(own.astype(np.int64), group) > 1
    again = np.zeros(len(text), dtype=bool)
    again[order] = np.repeat(many, np.diff(np.r_[group, len(text)])) & own
    return [again[s:s + c] for s, c in zip(starts, counts)]


def _runs(mask: np.ndarray) -> list[int]:
    """First and end of every run of true values, one after the other."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge.tolist()


def _spans(starts: list[int], length: int) -> list[int]:
    """Runs of repeated windows as maximal covered byte runs."""
    out: list[int] = []
    for a, b in sorted(zip(starts[::2], starts[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b + length - 1)
        else:
            out += [a, b + length - 1]
    return out


def repeat_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Two tables: every row's (doc_id, tid, n_bytes, sha), and (tid, n_bytes, spans, text) of every text with repeats, one
    row for each text. A text is told by hash and length; spans are [first, end) bytes to remove, one after the other."""
    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", F.xxhash64(text_of()).alias("tid"), F.octet_length(text_of()).cast("bigint").alias("n_bytes"), text_of().alias("text"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            yield b[["doc_id", "tid", "n_bytes"]].assign(sha=[hashlib.sha256(x).hexdigest() for x in data], slices=[[dict(zip(("anchor", "a", "b", "first", "windows"), s)) for s in slices_of(x, length)] for x in data])

    slice_kind = "array<struct<anchor: bigint, a: bigint, b: bigint, first: int, windows: int>>"
    rows = source.mapInPandas(read, f"doc_id {kind}, tid bigint, n_bytes bigint, sha string, slices {slice_kind}")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "slices")
    # Equal texts are one from here on, with their number; the documents come back at the end.
    copies = rows.groupBy("tid", "n_bytes").agg(F.min("row").alias("first_row"), F.count("*").alias("copies")).where("copies > 1")
    copies = maybe_broadcast(materialize(copies, "copied-texts"))
    once = rows.join(copies, ["tid", "n_bytes"], "left").where("first_row is null or row = first_row")
    every = once.select("tid", "n_bytes", F.coalesce("copies", F.lit(1)).alias("copies"), F.explode("slices").alias("s")).select("tid", "n_bytes", "copies", "s.*")
    # Written first, so that the join below is one of plain tables, whose hot anchors Spark can split.
    common = materialize(every.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"), "common-anchors")
    shared = materialize(every.join(common, "anchor"), "shared-slices")
    kinds = shared.groupBy("a", "b").agg(F.min("anchor").alias("anchor"), F.min("windows").alias("windows"), F.sum("copies").alias("m"),
                                         F.min(F.struct("tid", "n_bytes", "first")).alias("one"))
    kinds = materialize(kinds.select("a", "b", "anchor", "windows", "m", "one.*"), "slice-kinds")
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("m").alias("least")).where("kinds > 1 and least = 1")
    unsure = materialize(kinds.join(open_.select("anchor", "kinds"), "anchor"), "unsure-slices")
    wanted = kinds.where("m > 1").select("a", "b").union(unsure.select("a", "b"))
    wanted = shared.join(wanted.distinct(), ["a", "b"], "left_semi").select("tid", "n_bytes").distinct()
    wanted = maybe_broadcast(materialize(wanted, "texts-wanted"))
    texts = source.select("tid", "n_bytes", "text").join(wanted, ["tid", "n_bytes"], "left_semi").dropDuplicates(["tid", "n_bytes"])
    texts = materialize(texts, "texts")
    found = kinds.where("m > 1").select("a", "b", F.array(F.lit(0), F.col("windows")).alias("runs"))
    found = materialize(found.union(_resolve(unsure, texts, length)), "repeated-slices")
    placed = shared.join(found, ["a", "b"]).select("tid", "n_bytes", F.transform("runs", lambda x: x + F.col("first")).alias("runs"))
    placed = placed.groupBy("tid", "n_bytes").agg(F.flatten(F.collect_set("runs")).alias("runs"))

    def join_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["tid", "n_bytes"]].assign(spans=[_spans(list(r), length) for r in b["runs"]])

    spans = placed.mapInPandas(join_runs, "tid bigint, n_bytes bigint, spans array<int>")
    return rows.select("doc_id", "tid", "n_bytes", "sha"), texts.join(spans, ["tid", "n_bytes"])


def _resolve(unsure: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(a, b, runs of repeated windows) of the slices that occur once and whose anchor occurs in other slices too."""
    per_text = unsure.groupBy("tid", "n_bytes").agg(F.collect_list(F.struct("anchor", "a", "b", "first", "windows", "m", "kinds")).alias("slices"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, slices in zip(b["text"], b["slices"]):
                data = text.encode("utf-8", "surrogatepass")
                out += [(s["anchor"], s["a"], s["b"], s["windows"], s["m"], s["kinds"], data[s["first"]:s["first"] + s["windows"] - 1 + length]) for s in slices]
            yield pd.DataFrame(out, columns=["anchor", "a", "b", "windows", "m", "kinds", "data"])

    cut_out = texts.join(per_text, ["tid", "n_bytes"]).select("text", "slices")
    cut_out = materialize(cut_out.mapInPandas(cut, "anchor bigint, a bigint, b bigint, windows int, m bigint, kinds bigint, data binary"), "slice-bytes")
    cold = cut_out.where(F.col("kinds") <= HOT_SLICES)
    tasks = max(1, -(-cold.count() // TASK_SLICES))

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        masks = repeated_windows([bytes(x) for x in pdf["data"]], pdf["windows"].tolist(), length)
        out = [(a, b, _runs(mask)) for a, b, m, mask in zip(pdf["a"], pdf["b"], pdf["m"], masks) if m == 1 and mask.any()]
        return pd.DataFrame(out, columns=["a", "b", "runs"])

    done = cold.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(tasks))).applyInPandas(transform, "a bigint, b bigint, runs array<int>")
    hot = cut_out.where(F.col("kinds") > HOT_SLICES)
    if not hot.limit(1).count():
        return done

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, n, m, data in zip(batch["a"], batch["b"], batch["windows"], batch["m"], batch["data"]):
                h = [xxhash.xxh3_128_intdigest(data[i:i + length]) for i in range(n)]
                yield pd.DataFrame({"h1": [_signed(x >> 64) for x in h], "h2": [_signed(x & (2**64 - 1)) for x in h], "a": a, "b": b, "m": m, "w": np.arange(n, dtype=np.int32)})

    each = materialize(hot.mapInPandas(windows, "h1 bigint, h2 bigint, a bigint, b bigint, m bigint, w int"), "hot-windows")
    again = each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    again = each.where("m = 1").join(again, ["h1", "h2"]).groupBy("a", "b").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return done.union(again.select("a", "b", F.flatten(F.transform("w", lambda w: F.array(w, w + 1))).alias("runs")))


def remove_spans(data: bytes, spans: list[int]) -> bytes:
    at, out = 0, []
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (the bytes that stay) and spans (removed byte runs) of every row. A null text counts as empty; rows
    repeated word for word repeat each other, so all of them lose what is long enough."""
    _, touched = repeat_spans(docs, length)

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id", "spans"]].assign(kept=[remove_spans(t.encode("utf-8", "surrogatepass"), [] if s is None else list(s)) for t, s in zip(b["text"], b["spans"])])

    source = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("tid"), F.octet_length(text_of()).cast("bigint").alias("n_bytes"))
    both = source.join(touched.select("tid", "n_bytes", "spans"), ["tid", "n_bytes"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<int>")).alias("spans"))
    return both.mapInPandas(strip, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<int>, kept binary")


def op4_suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, and the hash of what stays.

    A null text is empty, and loses nothing like all texts shorter than `length`; long texts count whole. Rows repeated word for
    word, ids included or null, repeat each other, so all of them lose what is long enough. An empty table gives an empty result.
    """
    rows, touched = repeat_spans(docs, length)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, s in zip(b["text"], b["spans"]):
                s = list(s)
                out.append((sum(s[1::2]) - sum(s[::2]), len(s) // 2, hashlib.sha256(remove_spans(t.encode("utf-8", "surrogatepass"), s)).hexdigest()))
            yield pd.concat([b[["tid", "n_bytes"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])], axis=1)

    cut = touched.mapInPandas(digest, "tid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept string")
    out = rows.join(cut, ["tid", "n_bytes"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
