"""Passages of words, conversation repair and the prefix trie against brute force, with awkward rows: nulls, empty and very
long texts, ties, repeated rows, empty tables, further columns whose names clash."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropledger.llm import conv_repair, prefix_trie, substring_dedup
from cropledger.llm.common import release
from cropledger.session import materialize

WORD, GAP = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 12 passages of words

def brute_passages(rows, length):
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - length + 1):
            if d is not None:
                least[tuple(w[i:i + length])] = min(d, least.get(tuple(w[i:i + length]), d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - length + 1) if d is not None and least[tuple(w[i:i + length])] < d for k in range(length)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def passages_frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for clash in ("tid", "doc", "n", "first", "spans", "anchor", "kind", "words", "copy", "rows"):
        df = df.withColumn(clash, F.lit("x"))
    return df


def passage_rows(rng, n):
    say = lambda k: " ".join(rng.choice(["a", "b", "c", "é", "D"]) + str(rng.randint(0, 9)) for _ in range(k))
    shared = [say(rng.randint(3, 40)) for _ in range(5)]
    rows = [(i, say(rng.randint(0, 30)) + rng.choice([" ", "\n", "\t "]) + rng.choice(shared) + " " + say(rng.randint(0, 20))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "w " * 60), (n + 4, "w " * 30), (None, rows[0][1]), (n + 5, rows[3][1]), (n + 6, rows[3][1]), (7, rows[9][1]), (2, rows[2][1])]
    rows.append((n + 7, say(20_000) + " " + rows[5][1]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot,shard,length", [(2_000, 400_000, 6), (1, 50, 6), (2, 300, 1)])
def test_passages_against_brute_force(spark, monkeypatch, hot, shard, length):
    monkeypatch.setattr(substring_dedup, "HOT_SLICES", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rows = passage_rows(random.Random(hot), 40)
    got = sorted((tuple(r) for r in substring_dedup.op12_passages(passages_frame(spark, rows), length).collect()), key=str)
    assert got == brute_passages(rows, length)
    kept = sorted(((r["doc_id"], sha(r["text"])) for r in substring_dedup.remove_passages(passages_frame(spark, rows), length).collect()), key=str)
    assert kept == sorted(((d, h) for d, _, _, h in got), key=str)


def test_passages_have_one_python_step_in_a_stage(spark):
    # Two steps in a row had two Python workers for each task, and the texts went back to the JVM between them.
    plan = substring_dedup.op12_passages(passages_frame(spark, passage_rows(random.Random(5), 20)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") < 2


def test_tables_are_released_without_python_workers(spark, monkeypatch):
    table = materialize(spark.range(9).select("id", F.array("id").alias("a"), F.lit("x").alias("s")), "released")
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    release(table)
    after = spark.read.parquet(table.inputFiles()[0].rsplit("/", 1)[0])
    assert after.count() == 0 and after.dtypes == table.dtypes


def test_passages_of_no_rows(spark):
    assert substring_dedup.op12_passages(passages_frame(spark, [])).count() == 0
    assert [r["n_removed"] for r in substring_dedup.op12_passages(passages_frame(spark, [(1, "a b"), (2, None)])).collect()] == [0, 0]


def test_pieces_of_a_long_text_keep_all_windows(monkeypatch):
    rng = np.random.default_rng(1)
    h, ends = rng.integers(0, 40, 700).astype(np.uint64), np.array([100, 100, 105, 700])
    want = [(t, i) for t, (a, b) in enumerate(zip([0, 100, 100, 105], ends)) for i in range(a, b - 12)]
    for piece in (1 << 22, 64, 33):
        monkeypatch.setattr(substring_dedup, "_PIECE", piece)
        text, first, windows, *_ = substring_dedup.cut_slices(h, ends, 13, 5)
        assert sorted((t, f + k) for t, f, n in zip(text.tolist(), first.tolist(), windows.tolist()) for k in range(n)) == want


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    for n, k in ((1, 1), (50, 1), (300, 5), (2000, 200)):
        seq = np.minimum(rng.geometric(0.2, n) - 1, k - 1).astype(np.int64)
        symbols = rng.choice(seq, 400)
        at = rng.integers(0, n + 1, 400)
        assert substring_dedup.WaveletTree(seq, k + 2).rank(symbols, at).tolist() == [int((seq[:a] == c).sum()) for c, a in zip(symbols, at)]


def test_matching_statistics_of_any_stream():
    rng = np.random.default_rng(0)
    for _ in range(40):
        length = int(rng.integers(1, 9))
        indexed = [rng.integers(0, 3, rng.integers(length, 30)).astype(np.uint64) for _ in range(8)]
        docs = rng.integers(0, 100, 8)
        streams = [rng.integers(0, 4, rng.integers(0, 40)).astype(np.uint64) for _ in range(6)] + indexed
        for s, found, least in zip(streams, *substring_dedup.FMIndex(indexed, docs, length).statistics(streams)):
            for i in range(len(s)):
                run = [[next((m for m in range(length) if i + m >= len(s) or j + m >= len(q) or s[i + m] != q[j + m]), length) for j in range(len(q))] for q in indexed]
                assert found[i] == max(max(r) for r in run)
                assert least[i] == min([d for r, d in zip(run, docs) if max(r) == length], default=np.iinfo(np.int64).max)


# 11 repair

def least_edits(seq):
    """Dijkstra over (turn, state), strings compared whole."""
    todo, done = [(0, "", 0, "0")], set()
    while True:
        cost, edits, i, at = heapq.heappop(todo)
        if (i, at) in done:
            continue
        done.add((i, at))
        if i == len(seq) and at in "0a":
            return cost, edits
        free = "a" if at == "u" else "u"
        heapq.heappush(todo, (cost + 2, edits + "I", i, free))
        if i < len(seq):
            role, fault = seq[i]
            heapq.heappush(todo, (cost + 3, edits + "D", i + 1, at))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                heapq.heappush(todo, (cost + 2 + more, edits + "R", i + 1, free))
                if at + role in ("0s", "0u", "su", "ua", "au"):
                    heapq.heappush(todo, (cost + more, edits + "K", i + 1, role))


def brute_repair(rows):
    show = lambda x: " " if x is None else str(x)
    out = []
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            kind = zlib.crc32(f"{show(c)}:{show(turn)}".encode()) % 20
            if c == conv and kind != 0:
                text = "" if kind == 1 else re.sub("[.!?]", "", show(text)) if kind == 2 else show(text)
                own += [(turn is not None, turn or 0, "user" if kind == 4 else show(role), text)] * (1 + (kind == 3))
        own.sort()
        turns = [t for has, t, _, _ in own if has]
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = GAP.sub("", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [r[2][:1] for r in own]
        cost, audit = least_edits(list(zip(first, faults)))
        at, todo, lines = "0", iter(own), []
        for e in audit:
            row = next(todo) if e != "I" else None
            if e != "D":
                role = row[2] if e == "K" else "assistant" if at == "u" else "user"
                at = role[0]
                lines.append(f"{role}:{row[3] if row else ''}")
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def talk(rng, convs):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["system" if t == 0 else "user", "user", "assistant", "assistant", "tool", None if rng.random() < 0.2 else "user", ""])
            rows.append((c, None if rng.random() < 0.05 else t + rng.randint(0, 1), role, rng.choice(["Yes.", "No!", "a b", "a b. ", " ", "", None, f"é {t}?", "…"])))
    rows += [(None, 1, "user", "lost."), (None, None, None, None), (500, 3, "user", "x" * 200_000 + "."), rows[0], rows[0], rows[3]]
    rows += [(600, t, rng.choice(["user", "assistant"]), f"line {t}.") for t in range(300)]
    rng.shuffle(rows)
    return rows


def talk_frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for clash in ("key", "kind", "seq", "audit", "conv", "part", "depth", "i", "n", "h"):
        df = df.withColumn(clash, F.lit("x"))
    return df


@pytest.mark.parametrize("chunk,task", [(512, 4096), (3, 5)])
def test_repair_against_brute_force(spark, monkeypatch, chunk, task):
    monkeypatch.setattr(conv_repair, "CHUNK_TURNS", chunk)
    monkeypatch.setattr(conv_repair, "TASK_CHUNKS", task)
    rows = talk(random.Random(chunk), 60)
    got = sorted((tuple(r) for r in conv_repair.op11_repair(talk_frame(spark, rows)).collect()), key=str)
    assert got == brute_repair(rows)


def test_repaired_turns_follow_the_pattern(spark):
    rows = talk(random.Random(5), 30)
    by = {}
    for r in conv_repair.repair(talk_frame(spark, rows)).collect():
        by.setdefault(r["conv_id"], {})[r["seq"]] = r
    for turns in by.values():
        assert sorted(turns) == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(turns[i]["role"][0] for i in sorted(turns)))
        assert all(r["edit"] in "KRI" and (r["edit"] != "I" or r["text"] == "") for r in turns.values())


def test_repair_of_no_rows(spark):
    assert conv_repair.op11_repair(talk_frame(spark, [])).count() == 0
    assert conv_repair.repair(talk_frame(spark, [])).count() == 0


def test_rules_spell_the_sequences_and_matrices_agree():
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ABCDEFGHIJKLMNOP" if rng.random() < 0.3 else "AEIEIEI") for _ in range(rng.randint(1, 30))) for _ in range(200)] + ["E" * 41]
    rules, coded = conv_repair.re_pair(seqs)

    def spell(x):
        return chr(x) if x < 128 else spell(rules[x - 128][0]) + spell(rules[x - 128][1])

    assert ["".join(spell(int(c)) for c in code) for code in coded] == seqs and sum(map(len, coded)) < sum(map(len, seqs)) / 2
    for seq, m in zip(seqs, conv_repair.sequence_matrices(seqs)):
        cost, rope = conv_repair.finish({q: e for (p, q), e in m.items() if p == conv_repair.START})
        codes = [divmod(ord(c) - 65, 4) for c in seq]
        assert (cost, str(rope)) == least_edits([("suao"[r], ["", "blank", "duplicate", "truncated"][f]) for r, f in codes])


def test_ropes_compare_like_strings():
    rng = random.Random(2)
    ropes = [conv_repair.Rope("".join(rng.choice("DI") for _ in range(rng.randint(0, 4)))) for _ in range(20)]
    for _ in range(200):
        ropes.append(rng.choice(ropes) + rng.choice(ropes))
    for _ in range(2000):
        a, b = rng.choice(ropes), rng.choice(ropes)
        assert (a < b) == (str(a) < str(b))


# 13 prefix trie

def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [r[2:] for r in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (*turns.get(c - c % 20, [])[:h], *own[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    sha(",".join(str(c) for c in sorted(m) if built[c] == p))) for p, m in members.items()), key=str)


def trie_rows(rng, convs):
    rows, words = [], ["yes.", "no way", "é\tf", "", None]
    for c in range(convs):
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # no base
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(words)))
    for c in (200, 203, 221):  # long ones with long common beginnings
        rows += [(c, t, "user", f"turn {t % 7}") for t in range(rng.randint(40, 60))]
    rows += [(None, 1, "user", "lost"), (7, None, "user", "first"), (7, 2, "user", "tie b"), (7, 2, "user", "tie a"), (9, 1, "user", "z " * 50_000), rows[1], rows[1]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,primes", [(4_096, None), (3, (2147483647, 2147483629)), (5, (53, 59))])
def test_trie_against_brute_force(spark, monkeypatch, block, primes):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block)
    if primes:
        monkeypatch.setattr(prefix_trie, "_PRIMES", primes)  # small ones collide, until a base does not
    rows = trie_rows(random.Random(block), 25 if primes == (53, 59) else 70)
    got = sorted((tuple(r) for r in prefix_trie.op13_prefix_trie(talk_frame(spark, rows)).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_of_no_rows(spark):
    assert prefix_trie.op13_prefix_trie(talk_frame(spark, [])).count() == 0
    assert prefix_trie.op13_prefix_trie(talk_frame(spark, [(None, 1, "user", "a")])).count() == 0
    one = prefix_trie.op13_prefix_trie(talk_frame(spark, [(3, 1, "user", "a")])).collect()
    assert sorted((tuple(r) for r in one), key=str) == brute_trie([(3, 1, "user", "a")])
