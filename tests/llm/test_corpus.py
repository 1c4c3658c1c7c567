"""Corpus operators against brute force, with awkward rows: nulls, empty and very long texts, ties, repeated rows, empty
tables, further columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropledger.llm import ann, components, decontaminate, html_main, line_dedup, mixture, ngram_join, pii, sharding, suffix_dedup, toxicity

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, ids=None, more=""):
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts)]
    df = spark.createDataFrame(rows, DOC)
    for clash in ("score", "shard", "key", "n", "block", "root", "tid", "anchor", "weight", "p", "_tokens", "label", "h1"):
        df = df.withColumn(clash, F.lit("x"))
    return df


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta omega rho sigma tau phi chi psi eta theta iota".split()) + str(rng.randint(0, 30)) for _ in range(n))


# the driver's plans

def joins_of_written_tables(monkeypatch, module):
    """Of every table that the module writes, the joins of its plan."""
    joins, write = [], module.materialize

    def counted(df, label):
        joins.append(len(re.findall(r"(?m)^[ :+-]*Join ", df._jdf.queryExecution().optimizedPlan().toString())))
        return write(df, label)

    monkeypatch.setattr(module, "materialize", counted)
    return joins


def test_a_round_of_components_joins_twice(spark, monkeypatch):
    joins = joins_of_written_tables(monkeypatch, components)
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (4, 5), (9, 8), (8, 9), (7, 7), (-3, 20), (20, 5)], "a bigint, b bigint")
    assert {tuple(r) for r in components.components(edges).collect()} == {(1, -3), (2, -3), (3, -3), (4, -3), (5, -3), (20, -3), (-3, -3), (8, 8), (9, 8)}
    assert 0 < max(joins) <= 2
    assert components.components(edges.limit(0)).count() == 0


def test_a_step_of_raking_joins_twice(spark, monkeypatch):
    joins = joins_of_written_tables(monkeypatch, mixture)
    cells = spark.createDataFrame([("x", "u", "k", 10), ("x", "v", "l", 30), ("y", "u", "l", 5), ("y", None, "k", 0)], "a string, b string, c string, tokens bigint")
    assert mixture.rake(cells, ["a", "b", "c"], rounds=1).count() == 4
    assert 0 < max(joins) <= 2


# 1 toxicity

def test_toxicity_learns_pairs_and_ignores_order(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(1200):
        words = prose(rng, 30).split()
        kind = i % 4  # toxic only where both words stand
        words += (["grumble"] if kind in (1, 3) else []) + (["folk"] if kind in (2, 3) else [])
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, 0, int(kind == 3)))
    docs = docs_of(spark, texts + ["", None])
    scored = by_id(toxicity.op1_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(scored[i]["held_out"] == (i in set(held)) for i in range(1200))
    assert np.mean([scored[i]["predicted"] == labels[i][2] for i in held]) > 0.95
    assert scored[1200]["score"] == scored[1201]["score"] < 0.3
    assert len(scored) == 1202 and all(0 <= r["score"] <= 1 for r in scored.values())


def test_toxicity_without_labels_or_rows(spark):
    labels = spark.createDataFrame([(0, 0, None), (None, 0, 1), (77, 0, 1)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, ["a b", None])
    assert [r["score"] for r in toxicity.op1_toxicity(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.op1_toxicity(docs.limit(0), labels).count() == 0


# 2 n-gram join

def brute_components(texts, n, p, q):
    sets = []
    for t in texts:
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))]
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and q * both >= p * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def near_texts(rng, groups=12, copies=14, words=60):
    texts = ["", None, " \t\n", "one", "One", "one two", "ÉCOLE un deux trois", "école un deux trois", prose(rng, 9000)]
    for _ in range(groups):
        base = prose(rng, rng.randint(5, words)).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 9)}"
            texts.append(" ".join(own + ["tail"] * rng.randint(0, 1)))
    return texts + texts[9:14]


@pytest.mark.parametrize("n, p, q", [(3, 90, 100), (5, 8, 10), (1, 1, 2)])
def test_jaccard_components_are_those_of_brute_force(spark, n, p, q):
    texts = near_texts(random.Random(n))
    size, comp = brute_components(texts, n, p, q)
    got = by_id(ngram_join.op2_jaccard(docs_of(spark, texts), n, p, q))
    assert [got[i]["n_shingles"] for i in range(len(texts))] == size
    assert [got[i]["component_id"] for i in range(len(texts))] == comp


@pytest.mark.parametrize("wide", [32, 1, 3])
def test_jaccard_large_blocks_by_chunks(spark, monkeypatch, wide):
    monkeypatch.setattr(ngram_join, "WIDE_PART", wide)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 5)
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", 3)
    texts = near_texts(random.Random(8), groups=5, copies=30, words=40)
    _, comp = brute_components(texts, 3, 90, 100)
    got = by_id(ngram_join.op2_jaccard(docs_of(spark, texts), 3, 90, 100))
    assert [got[i]["component_id"] for i in range(len(texts))] == comp


@pytest.mark.parametrize("n, p, q", [(3, 90, 100), (5, 8, 10)])
def test_one_group_of_very_many_near_copies(spark, n, p, q):
    rng = random.Random(n)
    base, texts = prose(rng, 120).split(), near_texts(rng, groups=3, copies=5)
    for _ in range(1200):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    size, comp = brute_components(texts, n, p, q)
    got = by_id(ngram_join.op2_jaccard(docs_of(spark, texts), n, p, q))
    assert [got[i]["component_id"] for i in range(len(texts))] == comp and [got[i]["n_shingles"] for i in range(len(texts))] == size
    assert ngram_join.op2_jaccard(docs_of(spark, texts).limit(0), n, p, q).count() == 0


def test_similar_sets_always_share_a_key():
    rng = np.random.default_rng(1)
    for p, q in ((90, 100), (8, 10), (1, 2)):
        levels = ngram_join.Levels(p, q)
        for _ in range(400):
            x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 400))).astype(np.uint64))
            drop, add = int(rng.integers(0, len(x) // 3 + 1)), int(rng.integers(0, len(x) // 3 + 1))
            y = np.unique(np.r_[rng.permutation(x)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
            if len(y) and ngram_join.similar(x, y, p, q) and not np.array_equal(x, y):
                mine, other = ({level: (spare, set(keys.tolist())) for level, spare, keys in levels.keys(s)} for s in (x, y))
                shared = {level: len(mine[level][1] & other[level][1]) for level in mine if level in other}
                assert any(shared[level] >= max(1, mine[level][0], other[level][0]) for level in shared)


def test_near_copies_post_a_part_of_their_keys_at_a_time(spark, monkeypatch):
    """Passes of fewer postings find the same edges, and what a write shuffled does not stay for the next one."""
    rng = random.Random(11)
    base = [prose(rng, 60) for _ in range(12)]
    docs = docs_of(spark, [b + " tail" * k for b in base for k in range(3)])
    made, write = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, label: made.append((label, write(df, label))) or made[-1][1])
    monkeypatch.setattr(ngram_join, "release", lambda df: None)
    edges = lambda slices: {tuple(r) for r in ngram_join._candidates(docs, 3, 8, 10, slices).collect()}
    whole = edges(1)
    (all_met,) = [t.count() for label, t in made if label == "meetings"]
    assert whole and edges(3) == whole
    parts = [t.count() for label, t in made if label == "meetings"][1:]
    assert len(parts) == 3 and sum(parts) == all_met and max(parts) < 0.6 * all_met
    kept = {}
    for slices in (1, 3):
        kept[slices] = {r["doc_id"] for r in ngram_join.keep_one(docs, 3, 8, 10, slices).collect()}
    assert kept[1] == kept[3] and len(kept[1]) < 36


def test_keep_one_keeps_columns_first_rows_and_wordless_rows(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = docs_of(spark, [long + " 1", long + " 2", long + " 1", "", None, "other words", "other words"], [5, 3, 4, 9, 8, 7, 7])
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8, 9]
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


# 3 line dedup

def brute_lines(rows):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[i + (len(a) == len(b)):] == b[i + 1:]

    first = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first[line] = min(first.get(line, (d, i)), (d, i))
    long = [x for x in first if len(x) >= line_dedup.LEAST_CHARS]
    gone = {b for a in long for b in long if first[a] < first[b] and near(a, b)}
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if not x.strip(" ") or (first[x] == (d, i) and x not in gone)) for d, t in rows}


@pytest.mark.parametrize("wide", [32, 1])
def test_lines_against_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(line_dedup, "WIDE_KEY", wide)
    rng = random.Random(wide)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rows = [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 5000 + "\n" + "x" * 4999 + "y")]
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(s) + 1)
                s[i:i + rng.randint(0, 1)] = rng.choice(["", "c", "d"])
            lines.append("".join(s))
        rows.append((d, "\n".join(lines)))
    got = by_id(line_dedup.dedup_lines(docs_of(spark, [t for _, t in rows], [d for d, _ in rows])))
    want = brute_lines(rows)
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["n_lines"] - r["n_removed"] == (len(r["text"].split("\n")) if r["n_lines"] > r["n_removed"] else 0) for r in got.values())
    assert line_dedup.dedup_lines(docs_of(spark, ["a"]).limit(0)).count() == 0


# 4 suffix dedup

def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(d, cover) if not c)
        out.append((len(d), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1_500, 1])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SLICES", hot)
    rng = random.Random(5)
    base = [prose(rng, 60) + "é" * rng.randint(0, 9) for _ in range(6)]
    texts = ["", None, "short", "a" * 500, "ab" * 300]
    for _ in range(60):
        s = rng.choice(base)
        a = rng.randint(0, 200)
        s = list(s[a:a + rng.randint(1, 300)])
        if rng.random() < 0.6 and s:
            s[rng.randrange(len(s))] = "#"
        texts.append(prose(rng, 5) + "".join(s) + prose(rng, 3))
    texts += [texts[9], texts[10], texts[10]]
    got = by_id(suffix_dedup.op4_suffix_dedup(docs_of(spark, texts), 100))
    assert [tuple(got[i])[1:] for i in range(len(texts))] == brute_repeats(texts, 100)
    kept = by_id(suffix_dedup.remove_repeats(docs_of(spark, texts), 100))
    assert all(hashlib.sha256(bytes(kept[i]["kept"])).hexdigest() == got[i]["kept_sha256"] for i in got)


def test_transform_marks_repeated_windows():
    rng = random.Random(1)
    for _ in range(60):
        length = rng.choice([3, 9, 20])
        base = bytes(rng.choice(b"ab") for _ in range(120))
        cut = [base[a:a + rng.randint(length, 60)] for a in (rng.randint(0, 50) for _ in range(5))]
        counts = [len(c) - length + 1 for c in cut]
        seen = Counter(c[i:i + length] for c, n in zip(cut, counts) for i in range(n))
        for c, mask in zip(cut, suffix_dedup.repeated_windows(cut, counts, length)):
            assert mask.tolist() == [seen[c[i:i + length]] > 1 for i in range(len(mask))]


# 5 main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<div class="cookie-notice"><p>We use cookies to make this site work. Accept all of them now.</p></div>
<div id="nav"><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></div>
<div class="post-content"><h1>A &amp; B&eacute;</h1><p>First   paragraph, with <b>bold</b> text and enough words to count as one.</p>
<p>Second paragraph goes on, with some more sentences. It has commas, and it ends here.</p>
<script>var x = "<p>no</p>";</script><ul><li>an item of the list</li></ul></div>
<div class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li><li><a href="/d">One more</a></li></ul></div>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with this at all, says a reader.</p></div></section>
<div class="site-footer">&copy; 2020 Example. All rights reserved.</div></body></html>"""


def test_main_text_by_learned_trees(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html_main.fit_extractor(pages)
    want = ("A & Bé First paragraph, with bold text and enough words to count as one. Second paragraph goes on, with some more sentences. "
            "It has commas, and it ends here. an item of the list")
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>text"), (5, "u", PAGE), (None, "u", "<" * 50)]
    odd = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html_main.extract(odd, model, ["page_id", "url"]).collect()
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[5]["text"] == want and by[1]["n_chars"] == len(want)
    assert by[2]["text"] == by[3]["text"] == "" and len(got) == 6
    assert html_main.extract(odd.limit(0), model, ["page_id", "url"]).count() == 0
    assert html_main.fit_extractor(odd) is None


def test_long_pages_teach_and_pages_without_landmarks_give_what_they_show(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where(F.lower("html").contains("<article"))
    long = pages.withColumn("html", F.concat("html", F.lit("<!--" + "x" * 60_000 + "-->")))
    model = html_main.fit_extractor(long)
    assert model is not None
    got = html_main.extract(long, model, ["page_id"]).collect()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in got)
    html_main_few = html_main._examples(PAGE.replace('<div class="post-content">', "<article>").replace('</div>\n<div class="sidebar">', '</article>\n<div class="sidebar">'))
    assert len(html_main_few[0]) == len(html_main_few[1]) == len(html_main_few[2]) <= html_main.PAGE_EXAMPLES
    bare = spark.createDataFrame([(1, "u", PAGE)], "page_id bigint, url string, html string")
    assert "Home" in html_main.op5_html_main(bare).first()["text"]
    assert html_main.op5_html_main(bare.limit(0)).count() == 0


def test_decoding_never_contradicts_itself():
    nodes = html_main.nodes_of(html_main.parse("<div><p>a</p><div><p>b</p><p>c</p></div></div>"))
    own = np.array([1.0 if x.tag == "p" else 0.0 for x in nodes])
    rng = np.random.default_rng(2)
    for _ in range(50):
        odds = rng.normal(size=len(nodes)) * 9
        taken = html_main.decode(nodes, odds, own)
        best = max(sum(v for v, t in zip(odds * np.sqrt(own), pick) if t) for pick in (taken, own * 0, own))
        assert best >= -1e-9
        for x in nodes:
            if x.parent is not None and not taken[x.parent.index] and x.tag != "p":
                assert taken[x.index] in (False, True)


# 6 pseudonyms

def test_feistel_is_a_permutation_and_can_be_inverted():
    f = pii.Feistel(b"k")
    for size in (2, 10, 97, 1000):
        assert sorted(f.permute(x, size, "t") for x in range(size)) == list(range(size))
        assert all(f.permute(f.permute(x, size, "t"), size, "t", back=True) == x for x in range(size))


def test_pseudonyms_keep_formats_and_links(spark):
    texts = ["card 4041894974608795 or 4041-8949-7460-8795.", "again 4041 8949 7460 8795", "not 4041894974608796", "call +1 (269) 555-3296 on 2024-02-29", "2023-02-29",
             "a.b9@mail.example.com 10.1.2.3 300.1.1.1", None, "", "9" * 100_000]
    got = by_id(pii.op6_pseudonyms(docs_of(spark, texts)))
    digits = [re.sub(r"\D", "", x) for x in re.findall(r"\d[\d -]{14,}\d", got[0]["text"] + got[1]["text"])]
    assert len(set(digits)) == 1 and digits[0] != "4041894974608795" and pii.luhn_digit(digits[0][:-1]) == int(digits[0][-1])
    assert got[2]["text"] == texts[2] and got[4]["text"] == texts[4] and got[8]["text"] == texts[8]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} on \d{4}-\d\d-\d\d", got[3]["text"]) and got[3]["text"] != texts[3]
    assert re.fullmatch(r"\w\.\w\w@mail\.example\.com \d+\.\d+\.\d+\.\d+ 300\.1\.1\.1", got[5]["text"])
    assert got[6]["text"] == got[7]["text"] == "" and got[3]["n_phone"] == got[3]["n_date"] == got[5]["n_email"] == 1


# 7 decontamination

def brute_hits(text, items, window):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), item or ""))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            win = w[k:k + window]
            for i in range(len(words) - len(win) + 1):
                if words[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("slice_windows", [200_000, 3])
def test_wu_manber_against_brute_force(spark, monkeypatch, slice_windows):
    monkeypatch.setattr(decontaminate, "SLICE_WINDOWS", slice_windows)
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["a", "B", "c", "é", "d-e"]) for _ in range(n))
    items = [(10, some(7)), (9, some(5)), (2, some(3)), (3, "A"), (4, None), (5, "..."), (10, some(7))]
    texts = [some(rng.randint(0, 60)) for _ in range(60)] + [None, "", "..", "Éa a", some(5000)]
    got = by_id(decontaminate.op7_decontaminate(docs_of(spark, texts), spark.createDataFrame(items, "item_id bigint, text string"), 4))
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:] == brute_hits(t, items, 4)


def test_clean_documents_stay(spark):
    bench = spark.createDataFrame([(1, "q w e r t y u i o p a s")], "item_id bigint, text string")
    docs = docs_of(spark, ["x Q w e r t y u i o p z", "q w e r t y u i o x", None])
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 3


# 8 mixture

def test_raking_meets_all_marginals(spark):
    rng = random.Random(6)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", rng.randint(1, 1000)) for a in range(5) for b in range(3) for c in range(4)], "a string, b string, c string, tokens bigint")
    got = mixture.rake(cells, ["a", "b", "c"], rounds=25).toPandas()
    got["m"] = got.tokens * got.weight
    for d in "abc":
        aim = got.groupby(d).tokens.sum() ** 0.5
        have = got.groupby(d).m.sum()
        assert np.allclose(have / have.sum(), aim / aim.sum(), atol=1e-6)
    p = mixture.calibrate(spark.createDataFrame(got[["tokens", "weight"]]), 0.6).toPandas()
    assert p.p.max() <= 1 and abs((p.p * p.tokens).sum() / p.tokens.sum() - 0.6) < 1e-6


def test_mixture_of_odd_rows(spark):
    docs = docs_of(spark, [None, "", "a b", "a | b"] * 50).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise("s"))
    out = mixture.op8_mixture(docs)
    assert out.count() == 200 and out.where("p is null or p < 0 or p > 1 or kept is null").count() == 0
    assert mixture.keep_sampled(docs).columns == docs.columns
    assert mixture.op8_mixture(docs.limit(0)).count() == 0


def test_the_sample_holds_the_targets(spark):
    docs = docs_of(spark, ["w " * n for n in (5, 150, 150, 150, 1200) for _ in range(1500)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "es").otherwise("en"))
    shares = {(r["dimension"], r["value"]): r for r in mixture.op8_shares(docs).collect()}
    assert shares["topic", "note"]["target_share"] > 2.5 * shares["topic", "note"]["once_share"]  # so copies are needed
    for r in shares.values():
        assert abs(r["expected_share"] - r["target_share"]) < 1e-3 and abs(r["sampled_share"] - r["target_share"]) < 0.04
    size = F.size(F.split(F.trim("text"), " "))
    sample = mixture.keep_sampled(docs).select("lang", size.alias("t")).toPandas()
    assert abs(sample.t[sample.t == 5].sum() / sample.t.sum() - shares["topic", "note"]["target_share"]) < 0.005
    assert len(sample) / 7500 < mixture.KEEP + 0.02 and sample.t.sum() / (1655 * 1500) < mixture.KEEP + 0.02
    own = spark.createDataFrame([("es", 1.0), ("en", 1.0)], "value string, share double")
    even = mixture.keep_sampled(docs, targets={"lang": own}).select("lang", size.alias("t")).toPandas()
    assert abs(even.t[even.lang == "es"].sum() / even.t.sum() - 0.5) < 0.04
    with pytest.raises(ValueError):
        mixture.mix(docs, targets={"_lang": own})


# 9 sharding

def test_rendezvous_moves_few_keys_and_slots_have_no_gaps(spark):
    texts = [f"text {i % 7}é" for i in range(3000)] + [None, "", "x", "x"]
    ids = [*range(3000), 5000, 5001, 7, None]
    rows = [r.asDict() for r in sharding.op9_sharding(docs_of(spark, texts, ids), 24).collect()]
    assert len(rows) == 3004
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in rows) and 60 < sum(r["grown_shard"] == 24 for r in rows) < 200
    crc = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert crc == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1
    again = sharding.op9_sharding(docs_of(spark, texts, ids), 25).collect()
    assert {(r["doc_id"], r["shard"]) for r in again} == {(r["doc_id"], r["grown_shard"]) for r in rows}


def test_shard_weights_and_one_hot_record(spark, monkeypatch):
    df = sharding.assign_shards(spark.range(6000).withColumnRenamed("id", "doc_id"), weights=[1, 3, 0, 2])
    n = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    assert 2 not in n and abs(n[1] / 6000 - 0.5) < 0.03 and abs(n[3] / 6000 - 1 / 3) < 0.03
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 7)
    rows = sharding.op9_sharding(docs_of(spark, ["same"] * 50 + ["other"], [1] * 50 + [2])).collect()
    home = next(r["shard"] for r in rows if r["doc_id"] == 1)
    mine = [r for r in rows if r["shard"] == home]
    assert sum(r["doc_id"] == 1 for r in mine) == 50 and sorted(r["slot"] for r in mine) == list(range(len(mine)))
    assert sharding.op9_sharding(docs_of(spark, ["a"]).limit(0)).count() == 0


# 10 nearest neighbours

def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("score", F.lit("x"))


def brute_nearest(rows, q, k=20):
    ok = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    score = sorted(((-float((x * ok[q]).sum()), i) for i, x in ok.items() if i != q))[:k]
    return [(i, -s) for s, i in score]


def test_nearest_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 400)
    monkeypatch.setattr(ann, "RERANK_LEAST", 20)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist(), 0) for i in range(1500)]
    got = {}
    for r in ann.op10_nearest(vectors_of(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = 0
    for q in range(0, 1500, 20):
        best = brute_nearest(rows, q)
        have = sorted(got[q])
        assert [x[0] for x in have] == list(range(1, 21)) and have == sorted(have, key=lambda x: (-x[2], x[1]))
        found += len({i for i, _ in best} & {x[1] for x in have})
    assert found / (75 * 20) >= 0.9


def test_nearest_with_odd_vectors_ties_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0),
            (20, [0.0, 2.0], 0), (40, [3.0, 4.0], 0), (None, [1.0, 1.0], 0), (7, [1.0], 0), (8, [float("inf"), 0.0], 0), (1, [1.0, 0.0], 0)]
    got = ann.op10_nearest(vectors_of(spark, rows)).orderBy("query_id", "rank").collect()
    usable = [r for r in rows if r[0] in (0, 1, 2, 20, 40)]
    for q in (0, 20, 40):
        assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q] == brute_nearest(usable, q)
    assert ann.op10_nearest(vectors_of(spark, rows).limit(0)).count() == 0


# the pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for i, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, sf)
        if i < len(c.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0] and "shard" in docs.columns


def test_keys_of_lines_are_made_once(spark):
    rows = [(k, 100 * k + i) for k in range(1, 6) for i in range(k)]
    keyed = spark.createDataFrame([([k], line) for k, line in rows], "keys array<long>, line long").select(F.explode("keys").alias("key"), "line")
    shared = line_dedup._shared(keyed)
    assert shared._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert {tuple(r) for r in shared.select("key", "line", "n").collect()} == {(k, line, k) for k, line in rows if k > 1}
