"""Prefix trie of rebuilt conversations, by composable fingerprints.

A rebuilt conversation is the head of one conversation followed by the rest of another. The fingerprint of a sequence of turns
is an element of a monoid (a polynomial hash and a power of its base), so that of a prefix of a rebuilt conversation follows
from the base's head and the own suffix by arithmetic on figures that every turn carries once; no rebuilt text is made.
Turns are dealt by ranges of the whole order, and the parts of a conversation that spans several are composed by the same law.
Equal fingerprints at a depth are a node. Each keeps references to the stored turns that end it; where references differ, the
turns are read and compared, and with them, depth by depth, the prefixes. Should any differ, the base is changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cropledger.llm.conv_repair import CRC32_SQL
from cropledger.session import materialize, maybe_broadcast

#: Rebuilt conversations of a group of ids take the head of the group's first one; heads have fewer turns than HEADS.
GROUP, HEADS = 20, 4
#: Depths whose sums one window takes at a time.
BLOCK_TURNS = 4_096
_PRIMES = (2147483647, 2147483629)
_KEY = ["depth", "k1", "k2"]


def _bases(attempt: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f"base {attempt} {p}") % (p - 2) + 2 for p in _PRIMES]


def _turn_hashes(role: str, text: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
    return h >> 65, h & (2**63 - 1)


def _times(a: Column, b: Column, p: int) -> Column:
    return F.pmod(a * b, F.lit(p))  # both below 2 ** 31


def stored_turns(conversations: DataFrame) -> DataFrame:
    """(conv, part, i, role, text, words, h1, h2) of every turn, i counted within part; parts follow one another in the order of
    a conversation: by turn (null first), role, text. Turns without conv_id belong to no conversation and are left out."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64))
    dealt = dealt.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text").select("conv", "role", "text")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, i = TaskContext.get().partitionId(), None, 0
        for b in batches:
            nos, hashes, words = [], [], []
            for conv, role, text in zip(b["conv"].tolist(), b["role"], b["text"]):
                last, i = conv, i + 1 if conv == last else 1
                nos.append(i)
                hashes.append(_turn_hashes(role, text))
                words.append(len(text.encode("utf-8", "surrogatepass").split()))
            yield b.assign(part=part, i=nos, words=words, h1=[x[0] for x in hashes], h2=[x[1] for x in hashes])

    return materialize(dealt.mapInPandas(number, "conv bigint, role string, text string, part int, i bigint, words bigint, h1 bigint, h2 bigint"), "stored-turns")


def _placed(turns: DataFrame, bases: list[int]) -> DataFrame:
    """(conv, part, i, j, words, t1, t2, p1, p2, w1, w2): place j in the conversation, fingerprint (p, w) of its first j turns."""
    local = turns.select("conv", "part", "i", "words", "h1", "h2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, [0, 0, 1, 1]
        for b in batches:
            out = []
            for conv, part, i, h1, h2 in zip(*(b[c].tolist() for c in ("conv", "part", "i", "h1", "h2"))):
                t1, t2 = (h1 + h2 * bases[1]) % _PRIMES[0], (h1 * bases[0] + h2) % _PRIMES[1]
                p1, p2, w1, w2 = state if (conv, part, i - 1) == at else (0, 0, 1, 1)
                at = (conv, part, i)
                state = [(p1 * bases[0] + t1) % _PRIMES[0], (p2 * bases[1] + t2) % _PRIMES[1], w1 * bases[0] % _PRIMES[0], w2 * bases[1] % _PRIMES[1]]
                out.append((t1, t2, *state))
            figures = pd.DataFrame(out, columns=["t1", "t2", "p1", "p2", "w1", "w2"], dtype="int64")
            yield pd.concat([b[["conv", "part", "i", "words"]].reset_index(drop=True), figures], axis=1)

    kind = "conv bigint, part int, i bigint, words bigint, t1 bigint, t2 bigint, p1 bigint, p2 bigint, w1 bigint, w2 bigint"
    local = local.repartition("conv", "part").sortWithinPartitions("conv", "part", "i").mapInPandas(run, kind)
    local = materialize(local, "local-prints")
    ends = local.groupBy("conv", "part").agg(F.max_by(F.struct("i", "p1", "p2", "w1", "w2"), "i").alias("e")).select("conv", "part", "e.*")
    many = ends.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:  # a conversation has no more rows here than there are parts
        n, p, w, out = 0, [0, 0], [1, 1], []
        for r in pdf.sort_values("part").itertuples():
            out.append((r.conv, r.part, n, *p, *w))
            n += r.i
            p = [(x * y + z) % m for x, y, z, m in zip(p, (r.w1, r.w2), (r.p1, r.p2), _PRIMES)]
            w = [x * y % m for x, y, m in zip(w, (r.w1, r.w2), _PRIMES)]
        return pd.DataFrame(out, columns=["conv", "part", "n0", "a1", "a2", "b1", "b2"])

    ahead = ends.join(many, "conv").groupBy("conv").applyInPandas(compose, "conv bigint, part int, n0 bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    ahead = materialize(ahead, "parts-ahead")
    out = local.join(maybe_broadcast(ahead), ["conv", "part"], "left").fillna({"n0": 0, "a1": 0, "a2": 0, "b1": 1, "b2": 1})
    prints = [F.pmod(F.col(f"a{x}") * F.col(f"w{x}") + F.col(f"p{x}"), F.lit(p)).alias(f"p{x}") for x, p in zip((1, 2), _PRIMES)]
    powers = [_times(F.col(f"b{x}"), F.col(f"w{x}"), p).alias(f"w{x}") for x, p in zip((1, 2), _PRIMES)]
    return materialize(out.select("conv", "part", "i", (F.col("n0") + F.col("i")).alias("j"), "words", "t1", "t2", *prints, *powers), "prints")


def _plans(placed: DataFrame, group: int, heads: int) -> DataFrame:
    """(conv, h, hb, total, base, head, d1, d2) of every conversation: own turns passed over, turns of the base's head, turns in
    all, the head's turns, and the difference between the fingerprints of the base's head and of the own one."""
    head = F.sort_array(F.collect_list(F.when(F.col("j") < heads, F.struct("j", "p1", "p2", "t1", "t2", "words", "part", "i")))).alias("head")
    convs = materialize(placed.groupBy("conv").agg(F.max("j").alias("n"), head), "conversation-heads")
    own = convs.withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).cast("int"))
    own = own.withColumn("base", F.col("conv") - F.col("conv") % group)
    other = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"), F.col("head").alias("base_head"))
    both = own.join(other, "base", "left").withColumn("hb", F.least("h", F.coalesce("n_base", F.lit(0))).cast("int"))
    both = both.withColumn("base_head", F.slice(F.coalesce("base_head", F.array().cast(convs.schema["head"].dataType)), F.lit(1), F.col("hb")))
    own_head = F.get("head", F.least("h", "n").cast("int") - 1)
    new_head = F.get("base_head", F.col("hb") - 1)
    diff = [F.pmod(F.coalesce(new_head[f"p{x}"], F.lit(0)) - F.coalesce(own_head[f"p{x}"], F.lit(0)), F.lit(p)).alias(f"d{x}") for x, p in zip((1, 2), _PRIMES)]
    total = F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return materialize(both.select("conv", "h", "hb", total.alias("total"), "base", F.col("base_head").alias("head"), *diff), "rebuilding")


def _rows(placed: DataFrame, plans: DataFrame, bases: list[int], heads: int) -> DataFrame:
    """(conv, depth, k1, k2, parent keys u1, u2, words, ref, last) of every turn of every rebuilt conversation; last: it is the
    conversation's last."""
    inverse = [pow(b, -1, p) for b, p in zip(bases, _PRIMES)]
    top = plans.select("conv", "total", "base", F.explode("head").alias("s"))
    top = top.select("conv", F.col("s.j").alias("depth"), F.col("s.p1").alias("k1"), F.col("s.p2").alias("k2"), F.col("s.t1").alias("t1"), F.col("s.t2").alias("t2"),
                     F.col("s.words").alias("words"), F.struct(F.col("base").alias("conv"), F.col("s.part").alias("part"), F.col("s.i").alias("i")).alias("ref"), (F.col("s.j") == F.col("total")).alias("last"))
    rest = placed.join(plans.select("conv", "h", "hb", "total", "d1", "d2"), "conv").where("j > h")
    depth = (F.col("j") - F.col("h") + F.col("hb")).cast("bigint")

    def own_key(x: int) -> Column:
        p, back = _PRIMES[x - 1], F.array(*[F.lit(pow(inverse[x - 1], h, _PRIMES[x - 1])).cast("bigint") for h in range(heads)])
        return F.pmod(_times(F.col(f"d{x}"), _times(F.col(f"w{x}"), F.get(back, F.col("h")), p), p) + F.col(f"p{x}"), F.lit(p)).alias(f"k{x}")

    rest = rest.select("conv", depth.alias("depth"), own_key(1), own_key(2), "t1", "t2", "words", F.struct("conv", "part", "i").alias("ref"), (depth == F.col("total")).alias("last"))
    above = [_times(F.pmod(F.col(f"k{x}") - F.col(f"t{x}"), F.lit(p)), F.lit(i), p).alias(f"u{x}") for x, p, i in zip((1, 2), _PRIMES, inverse)]
    return materialize(top.union(rest).select("conv", "depth", "k1", "k2", *above, "words", "ref", "last"), "rebuilt-turns")


def _nodes(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy(*_KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("u1").alias("u1"), F.min("u2").alias("u2"),
        F.sum(F.col("last").cast("bigint")).alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv"))).alias("first_end"),
        F.min("ref").alias("ref"), F.max("ref").alias("other_ref")), "trie-nodes")


def _collide(rows: DataFrame, nodes: DataFrame, turns: DataFrame) -> bool:
    """Whether any node ends in different turns. If none does, equal fingerprints are equal prefixes, depth by depth."""
    unsure = nodes.where("ref <> other_ref").select(*_KEY)
    refs = materialize(rows.join(unsure, _KEY).select(*_KEY, "ref.*").distinct(), "turn-references")
    said = refs.join(turns.select("conv", "part", "i", F.struct("role", "text").alias("turn")), ["conv", "part", "i"])
    return said.groupBy(*_KEY).agg(F.min("turn").alias("a"), F.max("turn").alias("b")).where("a <> b").limit(1).count() > 0


def _end_digests(ends: DataFrame) -> DataFrame:
    """Key and sha of the ascending ids of the conversations that end in each node, taken one by one as they come."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha, out = None, None, []
        for b in batches:
            for conv, *k in zip(*(b[c].tolist() for c in ("conv", *_KEY))):
                if k != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha, comma = k, hashlib.sha256(), ""
                sha.update(f"{comma}{conv}".encode())
                comma = ","
            yield pd.DataFrame(out, columns=[*_KEY, "sha"])
            out = []
        if key is not None:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=[*_KEY, "sha"])

    return ends.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv").select("conv", *_KEY).mapInPandas(digest, "depth bigint, k1 bigint, k2 bigint, sha string")


def _subtrees(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Key, leaves and saved of the nodes of more than one conversation.

    A node's figure is counted with its smallest member, which is a member of every node above: so a subtree's sum is the sum
    over the node's members of what is counted with them from that depth on.
    """
    saves = (F.col("n_convs") - 1) * F.col("words")
    shared = nodes.where("n_convs > 1").select(*_KEY, F.col("conv_id").alias("least"), saves.alias("saves"))
    on = materialize(rows.select("conv", *_KEY).join(shared, _KEY).select("conv", *_KEY, F.when(F.col("conv") == F.col("least"), F.col("saves")).otherwise(0).alias("saves")), "shared-turns")
    block = F.floor(F.col("depth") / BLOCK_TURNS).alias("block")
    sums = on.groupBy("conv", block).agg(F.sum("saves").alias("whole"))
    later = F.sum("whole").over(_window("conv", F.col("block").desc())) - F.col("whole")
    later = materialize(sums.select("conv", "block", later.alias("later")).where("later > 0"), "later-blocks")
    on = on.withColumn("block", block).withColumn("below", F.sum("saves").over(_window("conv", "block", F.col("depth").desc())))
    leaf = nodes.where("n_children = 0").select(F.col("conv_id").alias("conv"), F.lit(1).alias("leaf"))
    on = on.join(maybe_broadcast(later), ["conv", "block"], "left").join(leaf, "conv", "left")
    return on.groupBy(*_KEY).agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("leaves"), F.sum(F.col("below") + F.coalesce("later", F.lit(0))).alias("saved"))


def _window(*columns: str | Column) -> WindowSpec:
    return Window.partitionBy(*columns[:-1]).orderBy(columns[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes below the root (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    ref, the stored turn that ends the prefix), its root in the same columns, and nothing else is made whole.

    Null roles and texts are empty; turns without conv_id are left out; turns of one number go by role, then text, repeated
    rows are turns like others. An empty table has neither root nor nodes.
    """
    turns = stored_turns(conversations)
    attempt = 0
    while True:
        bases = _bases(attempt)
        placed = _placed(turns, bases)
        plans = _plans(placed, group, heads)
        rows = _rows(placed, plans, bases, heads)
        nodes = _nodes(rows)
        if not _collide(rows, nodes, turns):
            break
        attempt += 1
    empty = F.sha2(F.lit(""), 256)
    root_ends = _end_digests(plans.where("total = 0").select("conv", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2")))
    root = plans.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    kids = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    several = nodes.where("n_ends > 1").select(*_KEY)
    ends = _end_digests(rows.where("last").select("conv", *_KEY).join(several, _KEY))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    first = root.select("conv_id").first()
    parent = F.when(F.col("depth") == 1, F.lit(first[0] if first else None).cast("bigint")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id")
    out = nodes.join(above, ["depth", "u1", "u2"], "left").join(_subtrees(rows, nodes), _KEY, "left").join(ends, _KEY, "left")
    sha = F.when(F.col("n_ends") == 0, empty).when(F.col("n_ends") == 1, F.sha2(F.col("first_end").cast("string"), 256)).otherwise(F.col("sha"))
    out = out.select("conv_id", "depth", parent, "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
                     F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved_tokens"), sha.alias("ends_sha256"), "ref")
    sums = nodes.agg(F.sum((F.col("depth") == 1).cast("bigint")).alias("n_children"), F.sum((F.col("n_children") == 0).cast("bigint")).alias("n_leaves"),
                     F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    root = reduce(lambda a, b: a.join(b, how="left"), [root, sums, root_ends.select("sha")])
    root = root.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs",
                       F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
                       F.coalesce("sha", empty).alias("ends_sha256"), F.lit(None).cast(out.schema["ref"].dataType).alias("ref"))
    return out, root


def op13_prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for every node of the trie of rebuilt conversations, root included. Nulls, ties, repeats and empty tables as in
    prefix_trie()."""
    nodes, root = prefix_trie(conversations)
    return nodes.drop("ref").union(root.drop("ref"))


OP13_SQL = f"""
WITH src AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j
        FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, count(*) AS n, {CRC32_SQL.format("c::VARCHAR")} % 4 AS h FROM src GROUP BY c),
built AS (SELECT k.c, b.j AS d, b.role, b.text FROM convs k JOIN src b ON b.c = k.c - k.c % 20 WHERE b.j <= k.h
    UNION ALL SELECT k.c, s.j - k.h + least(k.h, coalesce(o.n, 0)), s.role, s.text
    FROM convs k JOIN src s ON s.c = k.c LEFT JOIN convs o ON o.c = k.c - k.c % 20 WHERE s.j > k.h),
path AS (SELECT c, d, text, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS p FROM built
    UNION ALL SELECT c, 0, '', '' FROM convs),
sized AS (SELECT *, max(d) OVER (PARTITION BY c) AS n FROM path),
node AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS words,
        coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM sized GROUP BY d, p),
up AS (SELECT y.d, y.p, x.d AS ud, x.p AS upp FROM node y JOIN path x ON x.c = y.conv_id AND x.d <= y.d),
kids AS (SELECT ud AS d, upp AS p, count(*) AS n_children FROM up WHERE ud = d - 1 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, p)),
sums AS (SELECT u.ud AS d, u.upp AS p, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens, sum((n.n_children = 0)::INT)::BIGINT AS n_leaves
    FROM up u JOIN full_node n USING (d, p) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_node n JOIN sums s USING (d, p) LEFT JOIN up u ON u.d = n.d AND u.p = n.p AND u.ud = n.d - 1
LEFT JOIN node a ON a.d = u.ud AND a.p = u.upp
"""
