"""Benchmark decontamination: Wu-Manber multi-pattern search over the words of every document.

A window is `window` consecutive words of a benchmark item; an item of fewer words is one window. Windows of one length
share a table of shifts by word pairs: a pair that no window holds lets the search jump over all positions that it rules
out; a pair that ends some window leads to the windows filed under it, which are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropledger.llm.common import release, schema_of, text_of
from cropledger.session import materialize

WINDOW = 10
#: So many windows at most are sent to the tasks at once; a larger benchmark is searched for slice by slice.
SLICE_WINDOWS = 200_000

# A-Z become a-z, other ASCII but digits and letters becomes a blank; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def _words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (window, item): the window's words joined by blanks. Null texts have none; a null id counts as ''."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"]):
                w = _words(text)
                rows += [(b" ".join(w[i:i + window]), item) for i in range(max(1, len(w) - window + 1))] if w else []
            yield pd.DataFrame(rows, columns=["window", "item"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInPandas(cut, "window binary, item string").distinct()


class WuManber:
    """Shift and suffix tables of patterns (tuples of words) of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.filed: dict[tuple[bytes, ...], dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = words[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.filed[words[length - self.block:]][words[0]].append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(first position, items) of every occurrence."""
        length, block, far, shift = self.length, self.block, self.far, self.shift
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block:end])
            jump = shift.get(key, far)
            if jump:
                end += jump
                continue
            start = end - length
            for pattern, items in self.filed[key].get(words[start], ()):
                if tuple(words[start:end]) == pattern:
                    yield start, items
            end += 1


def _tables(rows: list[tuple[bytes, str]]) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for window, item in rows:
        words = tuple(bytes(window).split(b" "))
        by_length[len(words)][words].add(item)
    return [WuManber(patterns, length) for length, patterns in sorted(by_length.items())]


def mark_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every document, n_words, hit_spans [first, end) in words (merged) and sorted items.

    Null and empty texts have no words. Repeated rows each get their result. An empty benchmark hits nothing.
    Documents are never shuffled: the windows go to the tasks, in slices of bounded size. Of several slices each is searched
    for and let go of before the next is gathered, so the driver holds one; each is one pass over the documents.
    """
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    windows = materialize(benchmark_windows(benchmark, window), "benchmark-windows")
    n = windows.count()
    before = None
    slices = max(1, -(-n // SLICE_WINDOWS))
    out = docs.select(*keep, F.col("text").alias("_text"), F.array().cast("array<int>").alias("_spans"),
                      F.array().cast("array<string>").alias("_items"))
    schema = schema_of(out, [*keep, "_text", "_spans", "_items"], "_n_words bigint")
    for part in range(slices):
        own = windows if slices == 1 else windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(slices)) == part)
        sent = spark.sparkContext.broadcast([(bytes(r[0]), r[1]) for r in own.collect()])

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            tables = _tables(sent.value)
            for batch in batches:
                spans, items, counts = [], [], []
                for text, old, had in zip(batch["_text"], batch["_spans"], batch["_items"]):
                    words = _words(text)
                    found, names = [(old[i], old[i + 1]) for i in range(0, len(old), 2)], set(had)
                    for t in tables:
                        for start, who in t.search(words):
                            found.append((start, start + t.length))
                            names |= who
                    flat: list[int] = []
                    for a, b in sorted(found):
                        if flat and a <= flat[-1]:
                            flat[-1] = max(flat[-1], b)
                        else:
                            flat += [a, b]
                    spans.append(flat)
                    items.append(sorted(names))
                    counts.append(len(words))
                yield batch.assign(_spans=spans, _items=items, _n_words=counts)

        out = out.drop("_n_words").mapInPandas(scan, schema)
        if slices > 1:
            done = materialize(out, "overlaps")
            sent.unpersist()
            if before is not None:
                release(before)
            before = out = done
    return out.select(*keep, F.col("_text").alias("text") if "text" not in keep else F.lit(0).alias("_"),
                      F.col("_n_words").alias("n_words"), F.col("_spans").alias("hit_spans"),
                      F.col("_items").alias("items")).drop("_")


def op7_decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words inside an occurring window, and the items whose windows occur.

    Null and empty texts have no words; items without words have no window; a null item_id counts as ''. Long texts count whole,
    repeated rows and null doc_ids get their result like others. An empty benchmark hits nothing, an empty table gives none.
    """
    m = mark_overlaps(docs, benchmark, window)
    hit = F.aggregate(F.sequence(F.lit(1), F.expr("greatest(size(hit_spans), 1)"), F.lit(2)), F.lit(0).cast("bigint"),
                      lambda acc, i: acc + F.coalesce(F.get("hit_spans", i) - F.get("hit_spans", i - 1), F.lit(0)))
    m = m.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                 F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return m.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns.

    Documents with a doc_id or any other column null are treated like all others.
    """
    columns = docs.columns
    clean = mark_overlaps(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text"), benchmark, window, ["_row"])
    return clean.where(F.size("hit_spans") == 0).select("_row.*")


OP7_SQL = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spots AS (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), 10) AS n FROM spots),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM lowered),
found AS (SELECT r, i, n, item FROM (SELECT r, i, w, n FROM places, (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(w)) p
          JOIN windows USING (n) WHERE array_to_string(p.w[i:i + n - 1], ' ') = win),
hits AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM found) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
"""
