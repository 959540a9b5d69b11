"""Exact search, spelling variants and source divergence against brute force, on small tables with odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bazaarlake.llm import divergence, exact_search, runs, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(rows):
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    return dict(got)


def brute_top(vectors, every, top, width):
    whole = {i: [math.floor(64 * x) if abs(x) < 2**40 else int(x) * 64 for x in v] + [0] * (width - len(v)) for i, v in vectors.items()}
    cut = lambda n: min(max(n, -(2**63)), 2**63 - 1)
    out = {}
    for q in whole:
        if q % every == 0:
            scores = sorted((-cut(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)[:top]
            out[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    return {q: found for q, found in out.items() if found}


@pytest.mark.parametrize("kind", ["normal", "clustered", "ties", "large"])
def test_exact_search_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    n, d = 300, 21
    x = rng.normal(size=(n, d))
    if kind == "clustered":
        x = rng.normal(size=(6, d))[rng.integers(0, 6, n)] + 0.05 * x
    if kind == "ties":
        x = rng.integers(-1, 2, size=(n, d)) / 64
    if kind == "large":
        x *= 10.0 ** rng.integers(0, 12, size=(n, 1))
    vectors = {int(i) - 60: [float(v) for v in row[: d if i % 7 else 9]] for i, row in enumerate(x)}
    rows = [(i, v, "text") for i, v in vectors.items()]
    rows += [rows[3], rows[3], (None, [1.0], "z"), (1000, None, "z"), (1020, [float("nan")], "z"), (1040, [1.0, None], "z"), (1060, [float("inf")], "z"), (1080, [], "z")]
    vectors[1080] = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = exact_search.exact_top_k(df, every=20, top=7, settings=exact_search.Settings(block_rows=40, side_rows=6, step=4, growth=2)).collect()
    assert ranked(got) == brute_top(vectors, 20, 7, d)


def test_exact_search_of_few_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert exact_search.exact_top_k(spark.createDataFrame([], kind)).count() == 0
    assert exact_search.exact_top_k(spark.createDataFrame([(20, [1.0])], kind)).count() == 0
    # A repeated id is one row with its smallest vector.
    few = spark.createDataFrame([(20, [1.0]), (20, [0.5]), (3, [2.0]), (1, [2.0])], kind)
    assert ranked(exact_search.exact_top_k(few).collect()) == {20: [(1, 1, 32 * 128), (2, 3, 32 * 128)]}


def brute_words(rows, least_length=5, least_n=3):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}


def edited(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and edited(v, w)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v.encode())) for w, vs in near.items() if vs}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), words[w], len(near[w]), words.get(form.get(w))) for w in words}


@pytest.mark.parametrize("settings", [spelling.Settings(), spelling.Settings(cell_rows=10, sample=60, bucket=2, block_chars=120)])
def test_spelling_variants_equal_brute_force(spark, settings):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abeÿÉ") for _ in range(rng.randint(5, 9))) for _ in range(25)] + ["abcdefg"] * 2
    stems += ["".join(rng.sample("abcdefg", 7)) for _ in range(20)]  # anagrams
    texts = []
    for i in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(stems[: 1 + rng.randrange(len(stems))])
            at = rng.randrange(len(w))
            words.append({0: w, 1: w, 2: w[:at] + w[at + 1 :], 3: w[:at] + "b" + w[at:], 4: w[:at] + "E" + w[at + 1 :]}[rng.randrange(5)])
        texts.append((i if i else None, rng.choice([" ", ",", "1", "\n"]).join(words)))
    texts += [(900, None), (901, ""), (902, "a" * 3000 + " " + "a" * 3001 + " x"), (903, "a" * 3000 + " " + "a" * 3001), (904, "a" * 3000 + " " + "a" * 3001), texts[5], texts[5]]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in texts], "doc_id long, text string, n int, word string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, settings=settings).collect()}
    want = brute_variants(brute_words(texts))
    assert got == want and sum(w[1] != (w[0] or k) for k, w in want.items()) > 0 and "a" * 3001 in got


def test_spelling_of_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_boxes_lose_no_word():
    rng = np.random.default_rng(2)
    v = rng.poisson(0.7, size=(400, 12)).astype(np.int16)
    leaves = []
    root = spelling.grow(v, 5, leaves)
    home = {int(i): leaf.leaf for leaf in leaves for i in leaf.rows}
    assert len(home) == 400
    for more, less in ((1, 1), (1, 0)):
        hits = {(leaf.leaf, int(i)) for leaf, rows in spelling.reached(root, v, more, less) for i in rows}
        for a in range(400):
            gap = v - v[a]
            for b in np.flatnonzero((np.maximum(gap, 0).sum(axis=1) <= more) & (np.maximum(-gap, 0).sum(axis=1) <= less)):
                assert (home[int(b)], a) in hits
        assert len(hits) < 400 * len(leaves) / 3


def test_runs_of_long_texts_are_whole():
    text = "Äpfel und birnen " * 50 + "x" * 100
    assert runs.counted(text, divergence.TERM) == Counter(text.lower().replace("ä", "Ä").split())
    pieces = list(runs.chunks(runs.lowered(text), divergence.TERM, 7))
    assert "".join(pieces) == runs.lowered(text) and sum((Counter(divergence.TERM.findall(p)) for p in pieces), Counter()) == runs.counted(text, divergence.TERM)


def brute_divergence(rows, least):
    named = [tuple("" if x is None else x for x in r) for r in rows]
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in named:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOW))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = sorted(s for g, s in count if g == lang)
        rows_of = {s: {t: count[lang, s][t] for t in kept} for s in groups}
        rows_of[None] = {t: sum(rows_of[s][t] for s in groups) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 2) // (sum(r.values()) + 2 * len(kept)) for t, n in r.items()} for s, r in rows_of.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            terms = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if rows_of[s][t] and p[s][t] > p[None][t])[:10]
            out |= {(lang, s, part, item, -v, k + 1) for part, some in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(some)}
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 30, "block_groups": 3}])
def test_source_divergence_equals_brute_force(spark, limits):
    rng = random.Random(8)
    vocabulary = [f"w{c}é" for c in "abcdefghijklmnopqrstuvwxyz"] + ["Zug", "日本", "it", "zug"]
    rows = []
    for _ in range(500):
        source = rng.choice(["a", "a", "a", "b", "c", "d", "é", "f", None])
        words = rng.choices(vocabulary, k=rng.randint(0, 30)) + ([f"only{source}"] if rng.random() < 0.3 else [])
        rows.append((rng.choice([" ", "1", "\n", "@"]).join(words), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "nothing"), ("one word", "xx", "p"), ("", "xx", "q"), ("", "", ""), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, value int, term string")
    got = {tuple(r) for r in source_rows(divergence.source_divergence(df, least_docs=5, **limits))}
    assert got == brute_divergence(rows, 5)


def source_rows(df):
    return df.select("lang", "source", "part", "item", "value", "rank").collect()


def test_source_divergence_of_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact_for_large_counts():
    n, total, terms = 123_456_789_012_345, 987_654_321_098_765, 10**9
    assert divergence.shares(np.array([n]), np.array([total]), terms)[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)
