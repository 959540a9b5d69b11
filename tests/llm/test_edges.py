"""Clashing names, hot keys, nulls, ties, long texts and empty tables, for each operator and each stage."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bazaarlake.llm import bloom, common, components, near_dedup, neighbours, packing, substring_dedup, toxicity
from bazaarlake.llm import words as W
from bazaarlake.llm.line_dedup import drop_repeated_lines
from bazaarlake.llm.near_dedup import keep_one_of_each, near_duplicates
from bazaarlake.llm.substring_dedup import drop_repeated_passages

P = pytest.importorskip("public_tokenizers")

#: Every name that an operator uses inside, and a few of its results.
NAMES = "_id _lines _new _gone _spans _base _part _len _rank _place _n _salt _salts key low n node label band rep doc h evidence score toxic start end piece length ids".split()
PASSAGE = " ".join(f"passage{k}" for k in range(40))
ROWS = [
    (1, f"you utter snarkle you\nthe very same line here\n{PASSAGE} one two three"),
    (2, f"the very same line here\nanother line that stays\nfour five {PASSAGE} six"),
    (3, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (4, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (5, None),
    (6, ""),
    (6, "seven eight"),
    (None, "the very same line here"),
    (7, "long " * 40_000),
]


def clashing(spark):
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(*r, *[f"{n}-{r[0]}" for n in NAMES]) for r in ROWS], schema)


def values(rows):
    return sorted((str(r.doc_id), tuple(r[n] for n in NAMES)) for r in rows)


OPERATORS = {
    "toxicity": lambda d: toxicity.reject_toxic(d, toxicity.Grammar({"snarkle$": 5.0}, toxicity.Settings(), 0.0, -9.0)),
    "line_dedup": drop_repeated_lines,
    "near_dedup": keep_one_of_each,
    "substring_dedup": drop_repeated_passages,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name_come_back_unchanged(spark, name):
    before = clashing(spark)
    out = OPERATORS[name](before)
    rows = out.collect()
    assert out.columns[: len(before.columns)] == before.columns
    if name == "near_dedup":  # of the rows of id 6, the empty text is a copy of 5
        assert set(values(rows)) == {v for v in values(before.collect()) if v[0] != "4"} and len(rows) == len(ROWS) - 2
    else:
        assert values(rows) == values(before.collect())
    texts = {r.doc_id: r.text for r in rows}
    assert texts[5] is None and len(texts[7]) == 200_000
    if name == "line_dedup":
        assert texts[2].startswith("another line") and texts[1].count("\n") == 2 and texts[None] == "the very same line here"
    if name == "substring_dedup":
        assert "passage3" in texts[1] and "passage3" not in texts[2] and "four five six" in texts[2]


def test_packing_leaves_columns_of_any_name_alone(spark):
    rows = [(k, 0, 1 + k % 7, *[f"{n}-{k}" for n in NAMES if n not in ("piece", "length")]) for k in range(60)]
    names = [n for n in NAMES if n not in ("piece", "length")]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, " + ", ".join(f"{n} string" for n in names))
    out = packing.pack(pieces, capacity=16).collect()
    assert sorted(tuple(r[: len(rows[0])]) for r in out) == sorted(rows)
    assert len({r.sequence_id for r in out}) == -(-sum(r[2] for r in rows) // 16)


def test_scores_under_an_id_column_named_like_a_result(spark):
    table = spark.createDataFrame([("a", None), ("b", "you snarkle")], "score string, text string")
    out = toxicity.score_toxicity(table, toxicity.Grammar({"snarkle$": 5.0}, toxicity.Settings()), id_col="score").collect()
    assert [r[0] for r in out] == ["a", "b"] and out[0][1] < out[1][1]


def test_toxicity_of_nulls_and_long_texts(spark):
    rows = [(k, "you snarkle " * 3 if k % 3 == 0 else f"calm words number {k} here", int(k % 3 == 0)) for k in range(90)] + [(None, "you snarkle", 1), (900, None, 1), (901, "calm " * 50_000, 0), (902, "x", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    learn = toxicity.learning_rows(docs, labels)
    want = {r[0] for r in rows if r[0] is not None and r[1] is not None and r[2] is not None}
    held = {r.doc_id for r in docs.where(common.fold("doc_id", 4) == 2).collect()}
    assert {r.doc_id for r in learn.collect()} == want - held
    assert toxicity.learning_rows(docs, labels.limit(0)).count() == 0
    grammar = toxicity.learn_grammar(learn)
    long = grammar.evidence("calm words. " * 50_000, {})
    assert long == 0 and toxicity.score_toxicity(docs, grammar).count() == len(rows)


def test_whole_pipeline_with_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "en", "web", 0) for r in ROWS + ROWS[:2]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Doc 4 loses its line to doc 3; of the empty texts 4, 5 and 6 the smallest stays.
    assert {r.doc_id for r in out} == {1, 2, 3, 4, 6, 7, None}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_spread_join_equals_a_join(spark):
    left = spark.createDataFrame([(0 if k % 3 else k, f"v{k}") for k in range(9000)] + [(None, "x")], "key long, v string")
    right = spark.createDataFrame([(k, k * k) for k in range(0, 9000, 2)], "key long, w long")
    got = common.spread_join(left, right, "key").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, left.join(right, "key").collect()))
    pair = common.spread_join(left.withColumn("k2", F.lit("a")), right.withColumn("k2", F.lit("a")), ["key", "k2"])
    assert pair.count() == len(got)


def test_components_with_a_hot_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_NODES", 0)
    edges = [(k, 5000) for k in range(3000)] + [(6000, 6001)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(3000)}, 5000: 0, 6000: 6000, 6001: 6000}


def test_filters_miss_nothing():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    one, two = bloom.OnceTwice(1 << 16), bloom.OnceTwice(1 << 16)
    one.add(np.concatenate([hashes[:3000], hashes[:100]]))
    two.add(hashes[2000:])
    once, twice = bytearray(1 << 13), bytearray(1 << 13)
    parts = [dict((k, (a, b)) for k, a, b in x.blocks()) for x in (one, two)]
    for k in parts[0]:
        a, b = bloom.merge([p[k][0] for p in parts], [p[k][1] for p in parts])
        once[k * len(a) : (k + 1) * len(a)], twice[k * len(a) : (k + 1) * len(a)] = a, b
    assert bloom.hits(np.frombuffer(once, np.uint8), hashes, 1 << 16).all()
    found = bloom.hits(np.frombuffer(twice, np.uint8), hashes, 1 << 16)
    assert found[:100].all() and found[2000:3000].all() and found[100:2000].mean() < 0.2


@pytest.mark.parametrize("block_rows", [1000, 60])
def test_one_bucket_of_many_near_copies_equals_brute_force(spark, block_rows):
    rng = random.Random(31)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for k in range(500):  # from very alike to about as alike as the threshold, also among each other
        copy = base[:]
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 30)}"
        rows.append((k, " ".join(copy)))
    pairs = [(a, b) for a in range(500) for b in range(a)]
    sims = np.concatenate([W.weighted_jaccard(pa.array([rows[a][1] for a, _ in part]), pa.array([rows[b][1] for _, b in part])) for part in (pairs[k : k + 5000] for k in range(0, len(pairs), 5000))])
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), s in zip(pairs, sims):
        if s >= 0.8:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=block_rows).collect()}
    assert got == {k: find(k) for k in range(500)} and 1 < len(set(got.values())) < 400


def test_links_in_a_block_equal_all_pairs():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    n = len(texts)
    label = np.array([rng.randrange(5) for _ in range(n)])
    block = np.array([k % 2 for k in range(n)])
    rep = np.arange(n) + 100
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
    sims = W.weighted_jaccard(pa.array([texts[a] for a, _ in pairs]), pa.array([texts[b] for _, b in pairs]))
    want = {frozenset((a, label[b])) for (a, b), s in zip(pairs, sims) if s >= 0.5 and label[a] != label[b]}
    found = [near_dedup.links_between(rep, label, np.zeros(n, int), pa.array(texts), 0.5), near_dedup.links_between(rep, label, block, pa.array(texts), 0.5)]
    for k in (0, 1):
        at = np.flatnonzero(block == k)
        found.append(near_dedup.links_between(rep[at], label[at], block[at], pa.array([texts[i] for i in at]), 0.5))
    alike = {p for p, s in zip(pairs, sims) if s >= 0.5}
    for a, b in zip(*map(np.concatenate, zip(*found))):
        assert (a - 100, b - 100) in alike and label[a - 100] != label[b - 100]
    # A label is linked to another where any of their texts are.
    labels = lambda ps: {frozenset((int(label[a]), int(label[b]))) for a, b in ps if label[a] != label[b]}
    whole = zip(found[0][0] - 100, found[0][1] - 100)
    split = [(a - 100, b - 100) for f in found[1:] for a, b in zip(*f)]
    assert labels(whole) == labels(split) == labels(alike) and len(want) > 0


def test_bands_are_least_hashes_of_every_paragraph():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, most)}" for _ in range(n)) for n, most in [(600, 900), (22, 90), (21, 90), (0, 1), (400, 1), (60, 0)]]
    w = W.words(pa.array(texts))
    grams = substring_dedup._runs(w.hashes, 5)
    for band in (0, 1):
        at, many, key, place = substring_dedup.bands(w, 22, band, 3)
        covered = np.concatenate([np.arange(a, a + m) for a, m in zip(at, many)])
        assert covered.tolist() == [x for t in range(len(texts)) for x in range(w.first[t], w.first[t + 1] - 21)]
        of = dict(zip(covered.tolist(), np.repeat(np.arange(len(at)), many).tolist()))
        least = {x: tuple(W.mix(grams[x : x + 18] ^ W.mix(np.full(1, band * 3 + r + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))).min() for r in range(3)) for x in of}
        assert all((least[x] == least[y]) == (key[of[x]] == key[of[y]]) for x in list(of)[:80] for y in list(of)[::7])
        assert ((place >= at) & (place < at + 18)).all()
        plain = at < 600  # words that seldom repeat: all paragraphs of a run hold its shingle
        assert (place[plain] >= at[plain] + many[plain] - 1).all()


def plain_recall(table, out, every, top):
    y = np.array([r.embedding for r in table], dtype=np.float64)
    ids = np.array([r.vec_id for r in table])
    hit = total = 0
    for q, g in out.groupby("query_id"):
        i = int(np.flatnonzero(ids == q)[0])
        score = y @ y[i]
        score[i] = -np.inf
        want = set(ids[np.lexsort((ids, -score))[:top]])
        hit, total = hit + len(want & set(g.vec_id)), total + top
    return hit / total


def test_routing_visits_few_parts_and_recall_holds(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 32))
    x = centres[rng.integers(0, 200, 20_000)] + 0.7 * rng.normal(size=(20_000, 32))
    table = spark.createDataFrame([(int(k), v.astype(np.float32).tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    vectors = table.select(F.col("vec_id").alias("entry"), F.col("embedding").cast("array<double>").alias("v"))
    router = neighbours.fit_router(vectors, 20_000, 20, neighbours.Settings())
    recall = plain_recall(table.collect(), neighbours.nearest(table, every=100).toPandas(), 100, 20)
    # What queries really rank: the sizes of the parts that they visit.
    size = np.bincount(router.leaves(x, False)[1], minlength=router.parts)
    row, part, _ = router.leaves(x[::100], True)
    ranked = np.bincount(row, size[part]) / len(x)
    print(f"probes {router.probes} of {router.parts} parts, {router.copies} copies, share ranked {ranked.mean():.3f}, recall {recall:.3f}")
    assert router.parts == 33 and ranked.mean() <= 0.25 and abs(router.share - ranked.mean()) < 0.1 and recall >= 0.9


def test_neighbours_of_repeated_ids_short_and_very_common_vectors(spark):
    rows = [(20, [0.5, 1.0]), (20, [1.0]), (20, [0.5, 1.0]), (1, [2.0]), (2, [2.0, 0.0]), (3, [1.0, 3.0]), (40, [2.0])] + [(100 + k, [1.5, 0.0]) for k in range(2000)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), top=5).where("query_id in (20, 40)").collect()
    found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (20, 40)}
    assert found[20] == [(3, 3.5), (1, 1.0), (2, 1.0), (40, 1.0), (100, 0.75)]
    assert found[40] == [(1, 4.0), (2, 4.0), (100, 3.0), (101, 3.0), (102, 3.0)]


def test_two_levels_of_parts(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 6000)] + 0.5 * rng.normal(size=(6000, 16))
    table = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    s = neighbours.Settings(sample=1500, part_rows=100, most_parts=6, block_rows=300)
    vectors = table.select(F.col("vec_id").alias("entry"), F.col("embedding").alias("v"))
    router = neighbours.fit_router(vectors, 6000, 20, s)
    assert len(router.children) == 6 and sum(c.parts for c in router.children) > 20
    row, leaf, turn = router.leaves(x[:50], True)
    assert len(set(zip(row.tolist(), leaf.tolist()))) == len(row) and (np.bincount(row[turn == 0]) == 1).all()
    assert plain_recall(table.collect(), neighbours.nearest(table, settings=s).toPandas(), 20, 20) >= 0.9


def test_neighbours_ignore_other_columns_and_large_vectors(spark):
    rows = [(k, [1e8 * (k % 5 + 1), 1.0, float(k)], k, k, "x") for k in range(60)]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, part long, id long, v string"), top=5).toPandas()
    y = np.array([r[1] for r in rows])
    for q, g in out.groupby("query_id"):
        score = (y * y[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(60), -score)) if i != q][:5]
        assert g.sort_values("rank").vec_id.tolist() == order
