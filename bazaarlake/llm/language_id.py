"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over every learning text. The weights are
learned with follow-the-regularised-leader and elastic-net penalties on a
bounded sample of labelled rows, and a temperature is fitted on the part of
that sample held back from training. Every text is then scored whole, in
batches, with the broadcast model (a few hundred kilobytes).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, trimmed

_P = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that the weights are fitted on; a rare language adds its share of a quarter of it at most."""

    features_log2: int = 13
    longest: int = 3
    sample: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    seed: int = 7


def _mixed(h: np.ndarray, shift: int) -> np.ndarray:
    h = h * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(shift)


def term_counts(texts: list[str], bits: int, longest: int) -> np.ndarray:
    """Counts of hashed character n-grams (1 to ``longest``) of each text, shape (texts, 2 ** bits).

    Letters are lower-cased; runs of anything else are one space.
    """
    size = 1 << bits
    out = np.zeros((len(texts), size), dtype=np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.where(_letters(code), code, np.uint32(32))
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        code = np.concatenate([[np.uint32(32)], code[keep], [np.uint32(32)]]).astype(np.uint32)
        h = np.zeros(len(code), dtype=np.uint32)
        for n in range(1, longest + 1):
            if len(code) < n:
                break
            h = h[: len(code) - n + 1] * _P + code[n - 1 :] + np.uint32(n)
            out[i] += np.bincount(_mixed(h, 32 - bits), minlength=size)
    return out


_TABLE: list[np.ndarray] = []


def _letters(code: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter or a mark that belongs to one."""
    if not _TABLE:
        import unicodedata

        _TABLE.append(np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)], dtype=bool))
    return _TABLE[0][code]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + ln tf) * idf, each row of length 1."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def document_frequencies(learn: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """(df of each feature, number of texts) over all learning texts; one vector for each task is summed by Spark."""
    size = 1 << s.features_log2

    def count(batches):
        df, n = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for k in range(0, len(texts), 64):
                df += (term_counts(texts[k : k + 64], s.features_log2, s.longest) > 0).sum(axis=0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array(np.concatenate([[n], df]))], ["feature", "df"])

    rows = learn.select("text").mapInArrow(trimmed(count), "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    table = {r.feature: r.df for r in rows}
    return np.array([table.get(k, 0) for k in range(size)], dtype=np.float64), int(table.get(-1, 0))


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with elastic net; one row at a time, only its features move."""

    def __init__(self, features: int, classes: int, s: Settings):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.s = s

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the smallest log loss on rows not trained on."""
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 200))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float
    settings: Settings

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for k in range(0, len(texts), 64):
            part = texts[k : k + 64]
            x = vectors(term_counts([t or "" for t in part], self.settings.features_log2, self.settings.longest), self.idf)
            p = softmax(x @ self.weights / self.heat)
            for text, row in zip(part, p):
                best = int(row.argmax())
                known = has_letter(text)
                names.append(self.languages[best] if known else "und")
                scores.append(float(row[best]) if known else 0.0)
        return names, scores


def by_language(learn: DataFrame, s: Settings) -> DataFrame:
    """About ``s.sample`` rows by their hashed ids, and of a rare language more than its share, so that each is learned."""
    counts = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return learn
    total, least = sum(counts.values()), max(1, s.sample // (4 * len(counts)))
    share = {name: min(1.0, max(s.sample / total, least / n)) for name, n in counts.items()}
    cuts = F.create_map(*[x for name, part in sorted(share.items()) for x in (F.lit(name), F.lit(int(math.ldexp(part, 32))).cast("long"))])
    return learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < cuts[F.col("lang")])


def train(learn: DataFrame, settings: Settings | None = None) -> Model | None:
    """Fit a model on ``learn`` (``doc_id, text, lang``); None if it has no labelled text with a letter."""
    s = settings or Settings()
    learn = learn.where("text is not null and lang is not null")
    df, total = document_frequencies(learn, s)
    if not total:
        return None
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def features(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            idx, val = [], []
            for k in range(0, len(texts), 64):
                x = vectors(term_counts(texts[k : k + 64], s.features_log2, s.longest), idf)
                for row in x:
                    at = np.flatnonzero(row)
                    idx.append(at.astype(np.int32))
                    val.append(row[at].astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["doc_id", "lang", "at", "x"])

    chosen = by_language(learn, s)
    rows = chosen.select("text", "doc_id", "lang").mapInArrow(trimmed(features), "doc_id long, lang string, at array<int>, x array<float>").where(F.size("at") > 0)
    rows = sorted(rows.limit(2 * s.sample).toArrow().to_pylist(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    code = {name: k for k, name in enumerate(languages)}
    order = np.random.default_rng(s.seed).permutation(len(rows))
    held = max(1, len(rows) // 5) if len(rows) > 1 else 0
    parsed = [(np.array(rows[i]["at"]), np.array(rows[i]["x"], dtype=np.float64), code[rows[i]["lang"]]) for i in order]
    machine = Ftrl(1 << s.features_log2, len(languages), s)
    for _ in range(s.epochs):
        for at, x, label in parsed[held:]:
            machine.learn(at, x, label)
    w = machine.weights()
    heat = temperature(np.array([x @ w[at] for at, x, _ in parsed[:held]]), np.array([label for *_, label in parsed[:held]])) if held else 1.0
    return Model(languages, idf, w.astype(np.float32), heat, s)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``lang_pred``, ``score``) of every text.

    ``und`` with score 0 if the text is null, empty or without any letter, and
    for every text if nothing could be learned. One row per input row; an
    empty table gives an empty result; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        m = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = m.predict(texts) if m else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(trimmed(score), f"`{id_col}` {kind}, lang_pred string, score double")


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32 of the id not divisible by five."""
    return docs.where(fold("doc_id", 5) != 0).select("doc_id", "text", "lang")
