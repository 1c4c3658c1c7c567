"""Least-cost repair of conversation structure, by min-plus matrices over Re-Pair grammars.

A conversation is a sequence of symbols, each the initial of a turn's role and its fault. Sequences are cut into chunks, and
equal chunks are one. In a task the chunks get one Re-Pair grammar: the most frequent pair of symbols becomes a rule, again and
again. Every symbol has a transfer matrix over the states of the role pattern `(s?(ua)+)?`: the least cost of coming from
one state to another across the symbol, and the edits' initials as a rope. The matrix of a rule is the min-plus product of
those of its two symbols, evaluated once, bottom-up, for all conversations that the rule occurs in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropledger.session import materialize, maybe_broadcast

#: Turns of a conversation that one chunk holds at most, and different chunks that share a grammar, about.
CHUNK_TURNS = 512
TASK_CHUNKS = 4_096
#: Pairs that occur less often get no rule.
LEAST_USES = 2

ROLES = "suao"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: States of the pattern: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where an inserted or given role leads: a user's turn, but after a user's turn an assistant's.
_GIVEN = (USER, USER, ASSISTANT, USER)
#: Inserts after the last turn until the pattern is complete.
_CLOSE = (0, 2, 1, 0)
_PRIME, _RADIX = (1 << 61) - 1, 1_000_003


def symbol(role: int, fault: int) -> str:
    return chr(65 + 4 * role + fault)


class Rope:
    """A string as a tree of pieces that ropes share; its hash lets comparison skip equal parts."""

    __slots__ = ("size", "hash", "power", "left", "right", "piece")

    def __init__(self, piece: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.piece, self.left, self.right = piece, left, right
        if piece is None:
            self.size = left.size + right.size
            self.hash = (left.hash * right.power + right.hash) % _PRIME
            self.power = left.power * right.power % _PRIME
        else:
            self.size, self.hash, self.power = len(piece), 0, 1
            for c in piece:
                self.hash = (self.hash * _RADIX + ord(c)) % _PRIME
                self.power = self.power * _RADIX % _PRIME

    def __add__(self, other: Rope) -> Rope:
        return other if not self.size else self if not other.size else Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        mine, its = [self], [other]
        while mine and its:
            x, y = mine.pop(), its.pop()
            if x.size == y.size and x.hash == y.hash:
                continue
            if x.piece is None and (x.size >= y.size or y.piece is not None):
                mine += [x.right, x.left]
                its.append(y)
            elif y.piece is None:
                its += [y.right, y.left]
                mine.append(x)
            else:
                n = min(x.size, y.size)
                if x.piece[:n] != y.piece[:n]:
                    return x.piece[:n] < y.piece[:n]
                if x.size > n:
                    mine.append(Rope(x.piece[n:]))
                if y.size > n:
                    its.append(Rope(y.piece[n:]))
        return bool(its) and not mine

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.piece is None:
                todo += [x.right, x.left]
            else:
                out.append(x.piece)
        return "".join(out)


Entry = tuple[int, Rope]
Matrix = dict[tuple[int, int], Entry]
EMPTY = Rope("")


def better(x: Entry | None, y: Entry) -> Entry:
    """The cheaper one; of equal costs the one whose edits come first. Edits of equal cost over the same turns never begin
    one another, so what follows does not change the choice."""
    return y if x is None or y[0] < x[0] or (y[0] == x[0] and y[1] < x[1]) else x


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (p, m), (c1, r1) in a.items():
        for q in range(STATES):
            if (m, q) in b:
                c2, r2 = b[m, q]
                have = out.get((p, q))
                if have is None or c1 + c2 <= have[0]:
                    out[p, q] = better(have, (c1 + c2, r1 + r2))
    return out


def symbol_matrix(char: str) -> Matrix:
    """Any inserts, then one edit of the turn."""
    role, fault = ROLES[(ord(char) - 65) // 4], (ord(char) - 65) % 4
    more = int(fault == TRUNCATED)
    out: Matrix = {}
    for p in range(STATES):
        at, cost, inserts = p, 0, ""
        for _ in range(3):
            edits = [(at, DELETE, "D")]
            if fault in (NONE, TRUNCATED):
                edits.append((_GIVEN[at], REROLE + more, "R"))
                if (at, role) in _NEXT:
                    edits.append((_NEXT[at, role], KEEP + more, "K"))
            for q, c, initial in edits:
                out[p, q] = better(out.get((p, q)), (cost + c, Rope(inserts + initial)))
            at, cost, inserts = _GIVEN[at], cost + INSERT, inserts + "I"
    return out


def finish(row: dict[int, Entry]) -> Entry:
    """The best of the states that a conversation ends in, with the inserts that complete the pattern."""
    best = None
    for q, (cost, rope) in row.items():
        best = better(best, (cost + INSERT * _CLOSE[q], rope + Rope("I" * _CLOSE[q])))
    return best


def re_pair(sequences: list[str], least_uses: int | None = None) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules (left, right), each of symbols before it (characters below 128, then rules in order), and the coded sequences."""
    least = max(2, least_uses or LEAST_USES)
    sizes = np.array([len(s) for s in sequences])
    flat = np.full(int(sizes.sum()) + len(sizes), -1, dtype=np.int64)  # -1 ends every sequence
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
    flat[at] = np.frombuffer("".join(sequences).encode("ascii"), dtype=np.uint8)
    rules: list[tuple[int, int]] = []
    while len(flat) > 1:
        pair = np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] << 32 | flat[1:], -1)
        keys, count = np.unique(pair[pair >= 0], return_counts=True)
        if not len(keys) or count.max() < least:
            break
        key = int(keys[count.argmax()])
        where = np.flatnonzero(pair == key)
        if key >> 32 == key & 0xFFFFFFFF:  # of overlapping pairs every other one
            run = np.flatnonzero(np.r_[True, where[1:] != where[:-1] + 1])
            where = where[(np.arange(len(where)) - np.repeat(run, np.diff(np.r_[run, len(where)]))) % 2 == 0]
        flat[where] = 128 + len(rules)
        rules.append((key >> 32, key & 0xFFFFFFFF))
        flat = np.delete(flat, where + 1)
    ends = np.flatnonzero(flat < 0)
    return rules, [flat[a:b] for a, b in zip(np.r_[0, ends[:-1] + 1], ends)]


def sequence_matrices(sequences: list[str]) -> list[Matrix]:
    """The matrix of every sequence, by one grammar of all."""
    rules, coded = re_pair(sequences)
    matrix: dict[int, Matrix] = {ord(c): symbol_matrix(c) for c in sorted(set("".join(sequences)))}
    for i, (left, right) in enumerate(rules):
        matrix[128 + i] = product(matrix[left], matrix[right])
    out = []
    for code in coded:
        total = matrix[int(code[0])]
        for c in code[1:].tolist():
            total = product(total, matrix[c])
        out.append(total)
    return out


def tally(seq: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and neighbours whose initials may not follow one another."""
    codes = [ord(c) - 65 for c in seq]
    faults = [sum(c % 4 == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]
    illegal = sum(ROLES[x // 4] + ROLES[y // 4] not in ("su", "ua", "au") for x, y in zip(codes, codes[1:]))
    return *faults, illegal


# On Spark

_SPACE = r"[\x20\x09-\x0D]"


def _key(column: str = "conv_id") -> Column:
    """The conversation as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")).alias("key")


def turns_of(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text; a null role or text is one space."""
    return conversations.select(_key(), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with the faults that crc32 of `conv_id:turn` (a null is one space) picks: dropped, emptied, without ends of
    sentences, twice, or of the user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    rows = rows.select("*", copies)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _symbols(turns: DataFrame) -> DataFrame:
    """(key, part, no, seq): the chunks of every conversation, in order of part and no. Turns are dealt by ranges of the whole
    order, so that a conversation can lie in many tasks."""
    same = turns.select("key", "role", F.md5(F.col("text").cast("binary")).alias("h"), F.struct(F.col("turn").isNotNull(), "turn").alias("at"))
    again = same.groupBy("key", "role", "h").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = materialize(again, "said-again").select(F.col("key").alias("k"), F.col("role").alias("r"), "h", "first")
    late = F.coalesce(F.struct(F.col("turn").isNotNull(), F.col("turn")) > F.col("first"), F.lit(False))
    bare = F.regexp_replace("text", _SPACE, "")
    role = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    own = turns.withColumn("own", F.md5(F.col("text").cast("binary")))
    rows = own.join(maybe_broadcast(again), (F.col("key") == F.col("k")) & (F.col("role") == F.col("r")) & (F.col("own") == F.col("h")), "left")
    rows = rows.select("key", "turn", "role", "text", late.alias("late"), role.alias("initial"), fault.alias("fault"))
    dealt = rows.repartitionByRange(F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64))
    dealt = dealt.sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text")

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, no, key, before, seq, out = TaskContext.get().partitionId(), 0, None, None, [], []
        for b in batches:
            for k, turn, r, text, late, initial, fault in zip(*(b[c].tolist() for c in ("key", "turn", "role", "text", "late", "initial", "fault"))):
                if k != key or len(seq) == CHUNK_TURNS:
                    if seq:
                        out.append((key, part, no, "".join(seq)))
                    no, before, key, seq = (0, None, k, []) if k != key else (no + 1, before, key, [])
                this = (None if turn != turn else turn, r, text)
                seq.append(symbol(initial, DUPLICATE if fault != BLANK and (late or this == before) else fault))
                before = this
            if out:
                yield pd.DataFrame(out, columns=["key", "part", "no", "seq"])
                out = []
        if seq:
            yield pd.DataFrame([(key, part, no, "".join(seq))], columns=["key", "part", "no", "seq"])

    return dealt.mapInPandas(chunk, "key string, part int, no int, seq string")


def _solve(chunks: DataFrame) -> DataFrame:
    """Of every different chunk: its counts, the best edits if it is a whole conversation, and its matrix (from, to, cost,
    edits) if it is a part of one. chunks: (seq, many)."""
    different = materialize(chunks.groupBy("seq").agg(F.max("many").alias("many")), "chunk-kinds")
    tasks = max(1, -(-different.count() // TASK_CHUNKS))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for seq, many, m in zip(pdf["seq"], pdf["many"], sequence_matrices(pdf["seq"].tolist())):
            cost, rope = finish({q: e for (p, q), e in m.items() if p == START})
            cells = [{"p": p, "q": q, "cost": c, "edits": str(r)} for (p, q), (c, r) in m.items()] if many else []
            out.append((seq, *tally(seq), cost, str(rope), cells))
        return pd.DataFrame(out, columns=["seq", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "matrix"])

    cell = "array<struct<p: int, q: int, cost: bigint, edits: string>>"
    dealt = different.select(F.pmod(F.xxhash64("seq"), F.lit(tasks)).alias("task"), "seq", "many")
    return dealt.groupBy("task").applyInPandas(solve, f"seq string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, matrix {cell}")


_FIGURES = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _fold(parts: DataFrame) -> DataFrame:
    """Figures of conversations of several chunks: the vector of the states after each chunk, one chunk after the other."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counts, last, row = None, None, "", {}

        def close() -> pd.DataFrame:
            cost, rope = finish(row)
            return pd.DataFrame([(key, *counts, cost, str(rope))], columns=["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

        for b in batches:
            for k, seq, cells, *own in zip(*(b[c].tolist() for c in ("key", "seq", "matrix", "blank", "duplicate", "truncated", "illegal"))):
                if k != key:
                    if key is not None:
                        yield close()
                    key, counts, last, row = k, [0, 0, 0, 0], "", {START: (0, EMPTY)}
                counts = [x + y for x, y in zip(counts, own)]
                counts[3] += tally(last + seq[0])[3] if last else 0
                last, new = seq[-1], {}
                for e in cells:
                    if e["p"] in row:
                        cost, rope = row[e["p"]]
                        new[e["q"]] = better(new.get(e["q"]), (cost + e["cost"], rope + Rope(e["edits"])))
                row = new
        if key is not None:
            yield close()

    return parts.repartition("key").sortWithinPartitions("key", "part", "no").mapInPandas(fold, f"key string, {_FIGURES}")


def diagnose(turns: DataFrame) -> DataFrame:
    """key and figures (faults, illegal neighbours, cost and audit of the cheapest repair) of every conversation with turns.

    turns: as turns_of() gives them, best from a written table, as they are read several times.
    """
    chunks = materialize(_symbols(turns), "chunks")
    many = materialize(chunks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("many")), "long-conversations")
    chunks = chunks.join(maybe_broadcast(many), "key", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    solved = materialize(_solve(chunks.select("seq", "many")), "chunk-repairs")
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = chunks.where("not many").join(maybe_broadcast(solved.drop("matrix"), 20_000), "seq").select("key", *names)
    if not many.limit(1).count():
        return whole
    return whole.union(_fold(chunks.where("many").join(solved.drop("cost", "audit"), "seq")).select("key", *names))


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(key, seq, edit, turn, role, text) of the repaired conversations, in order within a task: the turns that stay, with
    their new roles, and the inserted ones. A conversation passes through one task, row by row."""
    said = turns.select("key", F.lit(1).alias("kind"), "turn", "role", "text")
    plan = audits.select("key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    order = ["key", "kind", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = said.union(plan).repartition("key").sortWithinPartitions(*order).select("key", "kind", F.col("turn").cast("string").alias("turn"), "role", "text")
    given = {USER: "user", ASSISTANT: "assistant"}

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, at, state, seq = "", 0, START, 0
        for b in batches:
            out = []
            for key, kind, turn, role, text in zip(*(b[c].tolist() for c in ("key", "kind", "turn", "role", "text"))):
                begun = kind == 0  # the plan of a conversation comes first; only inserts precede its first turn
                if begun:
                    audit, at, state, seq = text, 0, START, 0
                while at < len(audit) and (audit[at] == "I" or not begun):
                    edit = audit[at]
                    at += 1
                    if edit == "D":
                        begun = True
                        continue
                    if edit == "K":
                        state = _NEXT[state, role[0]]
                    else:
                        state = _GIVEN[state]
                    own = edit != "I"
                    begun = begun or own
                    out.append((key, seq, edit, turn if own else None, role if edit == "K" else given[state], text if own else ""))
                    seq += 1
            yield pd.DataFrame(out, columns=["key", "seq", "edit", "turn", "role", "text"])

    made = dealt.mapInPandas(apply, "key string, seq bigint, edit string, turn string, role string, text string")
    return made.withColumn("turn", F.col("turn").cast("bigint"))


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, edit, turn, role, text): the cheapest repair of every conversation that has turns.

    Turns go by turn (null first), then role, then text; null roles and texts are one space; turns without conv_id are one
    conversation. Repeated rows are duplicates. A conversation whose turns all go has no rows; an empty table gives none.
    """
    turns = materialize(turns_of(conversations), "turns")
    ids = materialize(conversations.select(_key(), "conv_id").distinct(), "conversation-ids")
    rows = repaired_turns(turns, materialize(diagnose(turns), "audits"))
    return rows.join(ids, "key").select("conv_id", "seq", "edit", "turn", "role", "text")


def _digests(rows: DataFrame) -> DataFrame:
    """(key, sha) of the repaired turns as they come, `role:text` and newlines between."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha, out = None, None, []
        for b in batches:
            for k, seq, role, text in zip(*(b[c].tolist() for c in ("key", "seq", "role", "text"))):
                if k != key:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(("\n" * (seq > 0) + role + ":" + text).encode("utf-8", "surrogatepass"))
            if out:
                yield pd.DataFrame(out, columns=["key", "sha"])
                out = []
        if key is not None:
            yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "sha"])

    return rows.select("key", "seq", "role", "text").mapInPandas(digest, "key string, sha string")


def op11_repair(conversations: DataFrame) -> DataFrame:
    """Per original conversation, after damage: gaps, faults, illegal neighbours, cost and audit of the cheapest repair, and the
    hash of the repaired turns. Nulls, ties, repeats and empty tables as in repair(); the conversation without id has the
    id null."""
    ids = materialize(conversations.select(_key(), "conv_id").distinct(), "conversation-ids")
    turns = materialize(turns_of(damage(conversations)), "damaged")
    gaps = turns.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    figures = materialize(diagnose(turns), "audits")
    sha = _digests(repaired_turns(turns, figures))
    out = ids.join(gaps, "key", "left").join(figures, "key", "left").join(sha, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: crc32 of an ASCII string in DuckDB, bit by bit.
CRC32_SQL = """(xor(list_reduce(list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b:
    list_reduce([xor(c, b), 0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295::BIGINT), 4294967295::BIGINT))"""


def _sql() -> str:
    """A vector of the best (cost, audit) of each state as sortable strings, carried from turn to turn."""

    def add(v: str, cost: str | int, initial: str) -> str:
        return f"(lpad((left({v}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({v}, 10) || '{initial}')"

    def given(v: str) -> str:
        return f"CASE WHEN f IN (0, 3) THEN {add(v, '2 + (f = 3)::INT', 'R')} END"

    def kept(v: str, initial: str) -> str:
        return f"CASE WHEN f IN (0, 3) AND r = '{initial}' THEN {add(v, '(f = 3)::INT', 'K')} END"

    return f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {CRC32_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
dmg AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM src, range(0, 2) t(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM dmg),
said AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
        regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS bare FROM placed),
sym AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
        left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM said),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
        count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
        count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM sym GROUP BY conv_id),
walk AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM facts
    UNION ALL
    SELECT conv_id, i + 1, {add('v0', 3, 'D')},
        least({add('v1', 3, 'D')}, {kept('v0', 's')}),
        least({add('e2', 3, 'D')}, {given('v0')}, {given('v1')}, {given('e3')}, {kept('v0', 'u')}, {kept('v1', 'u')}, {kept('e3', 'u')}),
        least({add('e3', 3, 'D')}, {given('e2')}, {kept('e2', 'a')})
    FROM (SELECT w.conv_id, w.i, v0, v1, least(v2, {add('v0', 2, 'I')}, {add('v1', 2, 'I')}, {add('v3', 2, 'I')}) AS e2,
            least(v3, {add('v2', 2, 'I')}, {add('v0', 4, 'II')}, {add('v1', 4, 'II')}) AS e3, f, r
        FROM walk w JOIN sym s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1)),
best AS (SELECT w.conv_id, least(v0, v3, {add('v2', 2, 'I')}, {add('v1', 4, 'II')}) AS v FROM walk w JOIN facts f
        ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n),
plan AS (SELECT conv_id, left(v, 9)::BIGINT AS cost, substr(v, 10) AS audit FROM best),
redo AS (SELECT conv_id, audit, 1::BIGINT AS place, 0::BIGINT AS i, 0 AS state, []::VARCHAR[] AS lines FROM plan
    UNION ALL
    SELECT conv_id, audit, place + 1, i + (e <> 'I')::INT, CASE WHEN e = 'D' THEN state WHEN e = 'K' AND left(role, 1) = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
        CASE WHEN e = 'D' THEN lines ELSE list_append(lines, CASE WHEN e = 'K' THEN role WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' ||
            CASE WHEN e = 'I' THEN '' ELSE text END) END
    FROM (SELECT q.*, substr(audit, place, 1) AS e, s.role, s.text FROM redo q LEFT JOIN sym s
        ON s.conv_id IS NOT DISTINCT FROM q.conv_id AND s.i = q.i + 1 WHERE place <= length(audit))),
done AS (SELECT conv_id, array_to_string(lines, chr(10)) AS text FROM redo WHERE place > length(audit))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(d.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP11_SQL = _sql()
