import zlib

import pytest

import corpus_pipeline
from bazaarlake.llm import toxicity
from bazaarlake.llm.common import read_table
from bazaarlake.llm.queries import llm_oracle_sql, llm_queries, tokenizer

from .test_dedup import brute_classes, brute_lines

tokenizers = pytest.importorskip("tokenizers")


def plain_words(text):
    out, word = [], []
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append("".join(word))
            word = []
        else:
            word.append(c.lower() if c.isascii() else c)
    return out


def runs(words, size):
    return [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]


@pytest.fixture
def small(spark, tmp_path):
    """Some 300 documents with all toxic ones, and their labels."""
    source = "/root/testdata/sf0.01"
    labels = read_table(spark, source, "labels")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    toxic = [r.doc_id for r in labels.where("toxic = 1").collect()]
    docs = read_table(spark, source, "documents")
    docs.where((docs.doc_id < 280) | docs.doc_id.isin(toxic)).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_every_stage_equals_a_plain_version(spark, small, tmp_path):
    """Each stage works on what its predecessor kept; its decisions are made again in plain Python."""
    sf_dir = small
    docs, texts, counts = read_table(spark, sf_dir, "documents"), {}, {}
    texts["documents"] = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS and docs.where("n_chars <> length(text)").count() == 0
            texts[name] = {r.doc_id: r.text for r in docs.collect()}
            counts[name] = docs.count()

    grammar = toxicity.learn_grammar(toxicity.learning_rows(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))
    low = {k: t for k, t in texts["documents"].items() if grammar.score(grammar.evidence(t, {})) < 0.3}
    assert texts["toxicity"] == low and 0 < len(low) < len(texts["documents"])

    assert texts["line_dedup"] == {k: t for k, _, _, t in brute_lines(list(low.items()))}

    classes = brute_classes(list(texts["line_dedup"].items()))
    first = {}
    for k in sorted(classes):
        first.setdefault(classes[k], k)
    assert texts["near_dedup"] == {k: texts["line_dedup"][k] for k in first.values()}

    before, after, seen, long_seen, changed = texts["near_dedup"], texts["substring_dedup"], set(), set(), 0
    assert set(before) == set(after)
    for k in sorted(before):
        words = plain_words(before[k])
        if not set(runs(words, 14)) & seen:  # shares no seed with an earlier document
            assert after[k] == before[k]
        assert not set(runs(plain_words(after[k]), 30)) & long_seen
        changed += after[k] != before[k]
        seen |= set(runs(words, 14))
        long_seen |= set(runs(words, 30))
    assert changed > 0

    raw, pieces = tokenizers.Tokenizer.from_file(tokenizer("word_bpe_49k.json")), docs.toPandas()
    for k, mine in pieces.groupby("doc_id"):
        ids = raw.encode(after[k], add_special_tokens=False).ids + [0]
        mine = mine.sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.ids_crc32.tolist() == [zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a : a + 2048])) for a in range(0, len(ids), 2048)]
    assert set(pieces.doc_id) == set(after)
    assert counts["toxicity"] == counts["line_dedup"] >= counts["near_dedup"] == counts["substring_dedup"] > 0


def test_empty_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_names():
    assert set(llm_oracle_sql()) <= set(llm_queries())
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in llm_queries() if k != "pipeline"}
