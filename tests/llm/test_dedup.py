import hashlib
import itertools
import random

import pyarrow as pa
import pytest

from bazaarlake.llm import substring_dedup
from bazaarlake.llm import words as W
from bazaarlake.llm.components import components
from bazaarlake.llm.exact_dedup import exact_duplicates
from bazaarlake.llm.line_dedup import drop_repeated_lines
from bazaarlake.llm.near_dedup import keep_one_of_each, near_duplicates
from bazaarlake.llm.substring_dedup import drop_repeated_passages, repeated_passages

SCHEMA = "doc_id long, text string, keep_id long, n_lines long, band long"  # with names that operators use


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, 7, 7) for i, t in rows], SCHEMA)



def test_exact_groups(spark):
    rows = [(1, "a"), (5, "a"), (2, None), (3, ""), (4, "b" * 200_000), (6, "b" * 200_000 + "c"), (7, "x"), (7, "x"), (None, "x")] + [(k, "hot") for k in range(100, 1100)]
    got = {(r.doc_id): r for r in exact_duplicates(docs(spark, rows), num_ranges=5).collect()}
    assert len(exact_duplicates(docs(spark, rows)).collect()) == len(rows)
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (5, 2, False) and got[5].kept
    assert (got[2].keep_id, got[2].group_size) == (3, 2) and got[4].group_size == 1 and got[6].group_size == 1
    assert (got[7].group_size, got[None].keep_id, got[None].kept) == (3, 7, False)
    assert all((got[k].keep_id, got[k].group_size) == (1099, 1000) for k in range(100, 1100))
    assert got[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    least = {r.doc_id: r.keep_id for r in exact_duplicates(docs(spark, rows), keep="min", num_ranges=5).collect()}
    assert least[1] == 1 and least[1099] == 100
    assert exact_duplicates(docs(spark, [])).count() == 0


def brute_lines(rows):
    keys = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.encode().strip().lower()
            if i is not None and len(k.decode()) >= 10:
                keys.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(s := keys.get(x.encode().strip().lower(), ())) > 1 and min(s) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    pool = ["A shared line of text", " a shared LINE of text\t", "short", "éèàéèàéèàé", "\x0bline with odd space\x0c", ""] + [f"line number {k} here" for k in range(40)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for k in range(80)] + [(200, None), (201, ""), (5, "line number 3 here"), (None, "line number 3 here")]
    got = drop_repeated_lines(docs(spark, rows))
    assert set(got.columns) == set(SCHEMA.replace(" long", "").replace(" string", "").split(", ")) | {"n_dropped"}
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()), key=str) == brute_lines(rows)
    assert drop_repeated_lines(docs(spark, [])).count() == 0
    tiny = drop_repeated_lines(docs(spark, rows), filter_bits_log2=8)  # several shards, each with a crowded filter
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in tiny.collect()), key=str) == brute_lines(rows)


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 130)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_components_of_long_paths_settle_in_few_rounds(spark, monkeypatch, broadcast):
    monkeypatch.setattr("bazaarlake.llm.components.BROADCAST_NODES", broadcast)
    ids = list(range(1500))
    random.Random(4).shuffle(ids)
    edges = [(ids[k], ids[k + 1]) for k in range(1499) if k != 999]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), max_rounds=16).collect()}
    assert got == {x: min(part) for part in (ids[:1000], ids[1000:]) for x in part}


def near_rows(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 25)):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows + [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One, two!"), (905, "x" * 150_000), (906, rows[0][1])]


def brute_classes(rows, threshold=0.8):
    texts = [t or "" for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = list(itertools.combinations(range(len(rows)), 2))
    parts = [pairs[k : k + 5000] for k in range(0, len(pairs), 5000)]
    sims = [s for part in parts for s in W.weighted_jaccard(pa.array([texts[a] for a, _ in part]), pa.array([texts[b] for _, b in part]))]
    for (a, b), s in zip(pairs, sims):
        if s >= threshold or texts[a] == texts[b]:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {rows[k][0]: rows[find(k)][0] for k in range(len(rows))}


@pytest.mark.parametrize("small_bucket", [12, 2])
def test_near_classes_equal_brute_force(spark, small_bucket):
    rows = near_rows()
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(spark, rows), small_bucket=small_bucket).collect()}
    assert got == brute_classes(rows)
    assert got[904] == 903 and got[900] == got[901] == 900


def test_near_edge_cases(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    kept = keep_one_of_each(docs(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)]))
    assert sorted(kept.select("doc_id").toPandas().doc_id.fillna(-1)) == [-1, 1, 3] and kept.columns == docs(spark, []).columns


def test_weighted_jaccard_by_hand():
    left, right = pa.array(["a b c d e f", "a b c d e", None]), pa.array(["a b c d e f g", "A. B, c-d e", None])
    assert W.weighted_jaccard(left, right).tolist() == [2 / 3, 1.0, 0.0]


def test_passages(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"t{rng.randint(0, 10**7)}" for _ in range(n))
    passages = [say(60) for _ in range(15)]
    rows = [(k, f"{say(40)} {passages[k % 15]} {say(30)}.\n{say(20)}") for k in range(30)] + [(k, say(150)) for k in range(50, 60)]
    rows += [(70, None), (71, ""), (72, say(20)), (73, (lambda p: p + " " + say(9) + " " + p)(say(60))), (74, "y" * 120_000)]
    found = repeated_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in found} == set(range(30))
    texts = dict(rows)
    for r in found:
        inside = set(texts[r.doc_id][r.start : r.end].split()) & set(passages[r.doc_id % 15].split())
        assert len(inside) >= 23  # two words at an end may differ at similarity 0.8
        assert r.kept == (r.doc_id == r.keep_doc_id) and r.keep_doc_id == r.doc_id % 15
    cleaned = {r.doc_id: r.text for r in drop_repeated_passages(docs(spark, rows)).collect()}
    assert all(cleaned[k] == t for k, t in rows if k not in range(15, 30))
    assert all(passages[k % 15] not in cleaned[k] and len(cleaned[k]) < len(texts[k]) for k in range(15, 30))
    assert repeated_passages(docs(spark, [])).count() == 0


def shingle_jaccard(x, y):
    x, y = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (x, y))
    return len(x & y) / len(x | y)


def edited_passages(seed=21):
    """(passage, edited passage) of 44 to 120 words: words changed, put in or left out, evenly spread."""
    rng = random.Random(seed)
    word = lambda: f"t{rng.randint(0, 10**7)}"
    for n in [44, 51, 60, 75, 90, 101, 120] * 6:
        old, kind = [word() for _ in range(n)], rng.choice(["change", "insert", "delete"] if n != 51 else ["change"])
        new, edits = list(old), rng.choice([1, 2, 3, 6])
        for e in range(edits, 0, -1):
            k = e * n // (edits + 1)
            new[k : k + (kind != "insert")] = [word()] * (kind != "delete")
        yield old, new


def test_edited_passages_equal_brute_force(spark):
    rng = random.Random(22)
    say = lambda n: [f"s{rng.randint(0, 10**7)}" for _ in range(n)]
    rows, planted = [], []
    for k, (old, new) in enumerate(edited_passages()):
        rows += [(k, " ".join(say(30) + old + say(25))), (100 + k, " ".join(say(20) + new + say(35)))]
        planted.append((k, new, shingle_jaccard(old, new)))
    found = repeated_passages(docs(spark, rows)).collect()
    texts = dict(rows)
    spans = {(r.keep_doc_id, r.doc_id): texts[r.doc_id][r.start : r.end].split() for r in found if not r.kept}
    near = [(k, new) for k, new, j in planted if j >= 0.8]
    assert 10 < len(near) < len(planted)
    assert all(spans.get((k, 100 + k)) == new for k, new in near)
    # Of the others a part may still be near-equal, but no span is less alike than 0.8.
    for (a, b), span in spans.items():
        assert b == 100 + a and len(span) >= 25
        kept = next(texts[r.doc_id][r.start : r.end].split() for r in found if r.kept and r.doc_id == a)
        assert shingle_jaccard(kept, span) >= 0.8 or sum(r.doc_id == b for r in found) > 1


def test_passages_go_to_their_borders(spark):
    rng = random.Random(23)
    say = lambda n, mark: " ".join(f"{mark}{rng.randint(0, 10**7)}" for _ in range(n))
    passages = [say(n, "p") for n in [25, 26, 40, 51, 60, 100] * 4]
    rows = [(100 * c + k, f"{say(30, 's')}, {p}. {say(20, 's')}") for c in range(3) for k, p in enumerate(passages)]
    # One document holds a passage twice, and another has it first.
    rows += [(98, passages[3]), (99, f"{passages[3]} {say(9, 's')} {passages[3]}")]
    found = repeated_passages(docs(spark, rows)).collect()
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] == passages[3 if r.doc_id in (98, 99) else r.doc_id % 100] for r in found)
    cleaned = {r.doc_id: r.text for r in drop_repeated_passages(docs(spark, rows)).collect()}
    for k, t in rows:
        assert [x for x in t.split() if x[0] == "s"] == [x for x in cleaned[k].split() if x[0] == "s"]
        assert cleaned[k] == t if k < 98 else not any(x[0] == "p" for x in cleaned[k].split())


def held_before(rows, length=25):
    """Word numbers of each document in a run of ``length`` words that an earlier document holds."""
    first, found = {}, {}
    for i, t in sorted(rows):
        ws = t.split()
        for k in range(len(ws) - length + 1):
            if first.setdefault(tuple(ws[k : k + length]), i) != i:
                found.setdefault(i, set()).update(range(k, k + length))
    return found


def removed(spark, table, **options):
    texts, out = dict(table), {}
    for r in repeated_passages(docs(spark, table), **options).where("not kept").collect():
        before = len(texts[r.doc_id][: r.start].split())
        out.setdefault(r.doc_id, set()).update(range(before, before + len(texts[r.doc_id][r.start : r.end].split())))
    return out


def test_no_link_is_lost_to_an_earlier_holder_of_less(spark):
    rng = random.Random(31)
    say = lambda n: [f"s{rng.randint(0, 10**7)}" for _ in range(n)]
    p, q, r = say(26), say(60), say(25)
    rows = [(1, say(20) + p[1:25] + say(20)), (2, say(30) + p + say(9)), (3, say(12) + p + say(30))]
    rows += [(11, sum((say(9) + q[k : k + 22] for k in range(0, 39, 2)), [])), (12, say(9) + q + say(40)), (13, say(30) + q + say(6))]
    rows += [(21, say(9) + r[:24] + say(9)), (22, say(9) + r[1:] + say(9)), (23, say(9) + r + say(9)), (24, say(9) + r + say(9))]
    rows = [(i, " ".join(t)) for i, t in rows]
    want = {3: set(range(12, 38)), 13: set(range(30, 90)), 24: set(range(9, 34))}
    assert held_before(rows) == want
    got = removed(spark, rows)
    assert {i: want[i] - got.get(i, set()) for i in want} == {3: set(), 13: set(), 24: set()} and set(got) == set(want)


def test_edited_copies_are_linked_however_many_hold_their_paragraphs(spark):
    rng = random.Random(33)
    say = lambda n: [f"s{rng.randint(0, 10**7)}" for _ in range(n)]
    a, b, c, d = say(24), say(24), say(22), say(22)
    rows = [(10 * k + i, say(9) + part + say(9)) for k, part in enumerate((a, b, c, d)) for i in range(7)]
    rows += [(50, say(5) + a + ["x"] + b + say(7)), (51, say(11) + a + ["y"] + b + say(7)), (52, say(3) + a + ["u", "v", "w"] + b + say(7))]
    rows += [(60, say(6) + c + d + say(7)), (61, say(8) + c + ["x"] + d + say(7)), (62, say(2) + c + ["y"] + d + say(7)), (63, say(2) + c + ["u", "v"] + d + say(7))]
    got = removed(spark, [(i, " ".join(t)) for i, t in rows])
    assert got == {51: set(range(11, 60)), 61: set(range(8, 53)), 62: set(range(2, 47))}


@pytest.mark.parametrize("period", [1, 2, 3])
def test_runs_of_the_same_words_go_whole(spark, period):
    rng = random.Random(34)
    say = lambda n: [f"s{rng.randint(0, 10**7)}" for _ in range(n)]
    again = lambda n: [f"w{k % period}" for k in range(n)]
    rows = [(k, say(9) + again(n) + say(9)) for k, n in enumerate([31, 134, 90, 40, 300, 29, 61, 200])]
    rows = [(k, " ".join(t)) for k, t in rows]
    want, got = held_before(rows), removed(spark, rows)
    assert {i: want[i] - got.get(i, set()) for i in want} == {i: set() for i in want} and set(got) == set(want)


def test_a_word_said_again_and_again_is_no_edit(spark):
    """Each place of such a run gave a key for each shape, and all of them met at its first one."""
    rows = [(k, " ".join(["w"] * 120)) for k in range(7)] + [(9, " ".join(f"s{k}" for k in range(99)))]
    src, row = docs(spark, rows).select("doc_id", "text"), lambda k: substring_dedup._runs(W.words(pa.array([rows[0][1]])).hashes, 22)[k]
    shared = spark.createDataFrame([(int(row(0).astype("int64")),)], "part long")
    assert substring_dedup._around_edits(src, shared, 22, 0.8, 25).count() == 0


def test_word_said_twice_at_an_edit_is_linked(spark):
    rng = random.Random(35)
    say = lambda n: [f"s{rng.randint(0, 10**7)}" for _ in range(n)]
    for before, after in ((21, 23), (22, 22), (23, 21)):
        a, b = say(before), say(after)
        rows = [(k, say(9) + (a if before > after else b) + say(9)) for k in range(7)]
        rows += [(20, say(5) + a + b + say(7)), (21, say(6) + a + a[-1:] + b + say(7))]
        got = removed(spark, [(i, " ".join(t)) for i, t in rows])
        assert got.get(21, set()) >= set(range(6, 6 + before + after + 1)), (before, after)


def test_shapes_of_links_without_a_long_run():
    shapes = substring_dedup._shapes(0.8, 25)
    assert shapes == [(20, 24, 1), (21, 23, 1), (22, 22, 1), (23, 21, 1), (24, 20, 1), (24, 24, 2)]
    alike = lambda runs, gap: sum(runs) - 4 * len(runs) >= 0.8 * (sum(runs) + gap + 4 * (len(runs) - 2)) - 1e-9
    for m in range(5, 25):
        for n in range(5, 25):
            for gap in range(1, 9):
                assert alike((m, n), gap) == any(m >= x and n >= y and gap <= g for x, y, g in shapes), (m, n, gap)
    assert not substring_dedup._several_edits(0.8, 25) and substring_dedup._several_edits(0.5, 25)


@pytest.mark.parametrize("options", [{}, {"n_bands": 2, "rows": 2, "small": 2}])
def test_unequal_spans_of_many_holders_equal_brute_force(spark, options):
    rng = random.Random(32)
    say = lambda n: [f"s{rng.randint(0, 10**7)}" for _ in range(n)]
    pool = [say(90) for _ in range(12)]
    rows = []
    for i in range(260):
        text = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p, n = rng.choice(pool), rng.choice([20, 22, 24, 25, 26, 30, 60, 90])
            a = rng.randint(0, 90 - n)
            text += p[a : a + n] + say(rng.randint(1, 30))
        rows.append((i, " ".join(text)))
    rows += [(300, rows[5][1]), (301, rows[5][1])]
    want, got, texts = held_before(rows), removed(spark, rows, **options), dict(rows)
    assert len(want) > 60
    for i, places in want.items():
        assert places <= got.get(i, set())
    # Nothing goes from a text that has no five words of an earlier one.
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    assert all(any(grams[i] & grams[j] for j in grams if j < i) for i in got)
    found = repeated_passages(docs(spark, rows), **options).collect()
    sizes = {}
    for r in found:
        assert r.keep_doc_id <= r.doc_id and r.class_size >= 2
        sizes.setdefault(r.class_id, set()).add(r.class_size)
    assert all(len(s) == 1 for s in sizes.values())


def test_words_at_text_borders():
    w = W.words(pa.array(["ab", "cd ef", None, "", "gh"]))
    assert [int(x) for x in w.first] == [0, 1, 3, 3, 3, 4] and list(w.start) == [0, 0, 3, 0]
