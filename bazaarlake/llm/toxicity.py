"""Toxicity scoring with a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, target, threat, negation, report or other. Four
small transducers, each an explicit transition table, read them: *negation* and
*report* hand each symbol on with a smaller weight in their scope; *insult* and
*threat* emit where a pattern is complete: insult + target or target + insult,
insult + insult, threat + target in either order. Their composition is one table that
reads a clause word by word. A text's evidence is the weight of its matched
patterns; a lone insult has a small share of its weight, and lone insults count
by their density over the clauses, so that length alone collects nothing.

The lexicon of the insult transducer is learned: word stems whose document
frequency differs between toxic and other texts, counted by Spark over every
labelled learning text. Closed word classes are fixed lists. The scale of the
score is fitted by logistic regression on a bounded sample of learning rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import fold, sampled, stored, trimmed
from .words import mix, slices

TARGETS = frozenset("you your yours u he she they him her them this that these those du dich dir ihr euch dein er sie tu toi te vous ton ta votre il elle ils tú te ti usted ustedes tu su él ella ellos".split())
NEGATIONS = frozenset("not no never none nor isn't aren't don't nicht kein keine nie niemals pas jamais aucun ni nunca jamás ningún".split())
REPORTS = frozenset("said says say told wrote writes claimed called quoted reported sagte sagt schrieb behauptete nannte dit disait écrit affirme prétend dijo dice escribió llamó afirmó".split())
THREATS = frozenset("kill murder strangle hurt destroy beat stab shoot burn töten umbringen schlagen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split())

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
NEGATION_SCOPE, REPORT_FACTOR, NEGATION_FACTOR = 3, 0.5, 0.3
LONE, THREAT_WEIGHT = 0.15, 3.0
REMEMBERED = 100_000  # words or stems that a task remembers before it starts afresh

SYMBOLS = OTHER, INSULT, TARGET, THREAT, NEGATION, REPORT = tuple(range(6))
#: What the insult transducer emits: nothing, a lone insult, this insult, this and the open one, the open one.
NOTHING, ALONE, THIS, BOTH, OPEN = range(5)

# A transducer: for each state and symbol (next state, output, weight). State 0 is the first.
Table = list[list[tuple[int, object, float]]]


def _scope(states: int, opens: int, factor: float, fades: bool) -> Table:
    """Hands symbols on, with weight ``factor`` for ``states - 1`` words after ``opens``, or for the rest of the clause."""
    down = [max(0, q - 1) if fades else q for q in range(states)]
    return [[(states - 1, OTHER, 1.0) if x == opens else (down[q], x, factor if q else 1.0) for x in SYMBOLS] for q in range(states)]


def _pattern(moves: dict[tuple[int, int], tuple[int, object]], states: int, silent: object) -> Table:
    """A table that stays where it is, and silent, except for ``moves``."""
    return [[(*moves.get((q, x), (q, silent)), 1.0) for x in SYMBOLS] for q in range(states)]


def composed(first: Table, second: Table) -> Table:
    """``second`` reads what ``first`` hands on; weights multiply."""
    n, out = len(second), []
    for row in first:
        for q in range(n):
            steps = [(p, w, second[q][y]) for p, y, w in row]
            out.append([(p * n + r, z, w * v) for p, w, (r, z, v) in steps])
    return out


def side_by_side(first: Table, second: Table) -> Table:
    """Both read the same symbols; outputs are pairs."""
    n = len(second)
    return [[(p * n + r, (y, z), w * v) for (p, y, w), (r, z, v) in zip(a, b)] for a in first for b in second]


NEGATION_TABLE = _scope(NEGATION_SCOPE + 1, NEGATION, NEGATION_FACTOR, True)
REPORT_TABLE = _scope(2, REPORT, REPORT_FACTOR, False)
# States: nothing, target seen, insult open, insult matched.
INSULT_TABLE = _pattern({(0, TARGET): (1, NOTHING), (0, INSULT): (2, ALONE), (1, INSULT): (3, THIS), (2, INSULT): (3, BOTH), (2, TARGET): (3, OPEN), (3, INSULT): (3, THIS)}, 4, NOTHING)
# States: nothing, target seen, threat open.
THREAT_TABLE = _pattern({(0, TARGET): (1, 0.0), (0, THREAT): (2, 0.0), (1, THREAT): (1, THREAT_WEIGHT), (2, TARGET): (1, THREAT_WEIGHT)}, 3, 0.0)
GRAMMAR_TABLE = composed(NEGATION_TABLE, composed(REPORT_TABLE, side_by_side(INSULT_TABLE, THREAT_TABLE)))


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows that the score's scale is fitted on; ``stems`` the learned lexicon (some 20 MB)."""

    shortest: int = 4
    longest: int = 8
    least_texts: int = 4
    least_weight: float = 2.5
    stems: int = 200_000
    sample: int = 6000


def stems(word: str, s: Settings) -> Iterator[str]:
    """The word itself, marked as whole, and its prefixes."""
    yield word + "$"
    for n in range(s.shortest, min(s.longest, len(word)) + 1):
        yield word[:n]


@dataclass(frozen=True)
class Grammar:
    lexicon: dict[str, float]
    settings: Settings
    slope: float = 1.0
    bias: float = -4.0

    def insult(self, word: str) -> float:
        """The insult transducer: the weight of the longest known stem, 0 if there is none."""
        known = self.lexicon.get(word + "$")
        if known is not None:
            return known
        for n in range(min(self.settings.longest, len(word)), self.settings.shortest - 1, -1):
            if (w := self.lexicon.get(word[:n])) is not None:
                return w
        return 0.0

    def symbol(self, word: str) -> tuple[int, float]:
        """The word's symbol and, for an insult, its weight."""
        if word in NEGATIONS:
            return NEGATION, 0.0
        if word in REPORTS:
            return REPORT, 0.0
        if weight := self.insult(word):
            return INSULT, weight
        return (THREAT if word in THREATS else TARGET if word in TARGETS else OTHER), 0.0

    def clause(self, words: list[str], memory: dict[str, tuple[int, float]]) -> tuple[float, float]:
        """Weights of a clause's matched patterns and of its lone insult; the composed table reads it once, left to right."""
        matched, alone, share, state = 0.0, 0.0, 1.0, 0
        for word in words:
            known = memory.get(word)
            if known is None:
                known = memory[word] = self.symbol(word)
            state, (what, threat), factor = GRAMMAR_TABLE[state][known[0]]
            if what:
                weight = known[1] * factor
                if what == ALONE:
                    alone, share = weight, factor
                elif what == OPEN:  # within both scopes counts once
                    matched, alone = matched + alone * min(1.0, factor / share), 0.0
                else:
                    matched += weight
                    if what == BOTH:
                        matched, alone = matched + alone, 0.0
            if threat:
                matched += threat * factor
        return matched, alone

    def evidence(self, text: str | None, memory: dict[str, tuple[int, float]]) -> float:
        """Matched patterns of all clauses of the whole text and its lone insults; 0 for null and empty texts."""
        if not text:
            return 0.0
        found = [self.clause(words, memory) for c in _CLAUSE.split(text.lower()) if (words := _WORD.findall(c))]
        return sum(m for m, _ in found) + LONE * sum(a for _, a in found) / math.sqrt(max(len(found), 1))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(evidence) + self.bias))))


def _first_places(words: list[str], s: Settings) -> dict[str, int]:
    """Each stem of a text with the number of the first word that has it."""
    first: dict[str, int] = {}
    for k, w in enumerate(words):
        first.setdefault(w, k)
    seen: dict[str, int] = {}
    for w, k in first.items():
        for x in stems(w, s):
            seen.setdefault(x, k)
    return seen


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts of all batches by about 100 kB: their stems, as Python strings, take many times that."""
    for batch in batches:
        for a, b in slices(batch.column(0), 100_000):
            yield batch.column(0).slice(a, b - a)


def toxic_contexts(learn: DataFrame, s: Settings) -> DataFrame:
    """(``stem``, ``toxic``): in how many different contexts toxic texts hold each stem, ``least_texts`` or more.

    A text gives each stem one context, the words beside its first occurrence,
    so that copies and near copies of a text count once.
    """

    def emit(batches):
        for column in _small(batches):
            found, contexts = [], []
            for text in filter(None, column.to_pylist()):
                words = ["", *_WORD.findall(text.lower()), ""]
                for x, k in _first_places(words[1:-1], s).items():
                    found.append(x)
                    contexts.append(xxhash.xxh3_64_intdigest(" ".join(words[k : k + 3])) - (1 << 63))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(contexts, pa.int64())], ["stem", "context"])

    rows = learn.where("toxic = 1").select("text").mapInArrow(trimmed(emit), "stem string, context long").distinct()
    return rows.groupBy("stem").agg(F.count(F.lit(1)).alias("toxic")).where(F.col("toxic") >= s.least_texts)


def _stem_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in found), dtype=np.uint64)


def stem_counts(learn: DataFrame, s: Settings) -> DataFrame:
    """(``stem``, ``toxic``, ``clean``): toxic contexts, and clean texts that hold the stem.

    A Bloom filter of the stems that toxic texts have (16 MB at most) keeps
    all other stems of clean texts where they are. Null texts have no stems; a
    repeated text counts once among the toxic and each time among the clean.
    """
    spark = learn.sparkSession
    toxic = stored(toxic_contexts(learn, s), "toxic-contexts")
    bits = bloom.bits_for(toxic.count())
    wanted = spark.sparkContext.broadcast(bloom.gathered(toxic.select("stem"), lambda b: np.unique(_stem_hashes(b.column(0).to_pylist())), bits, twice=False))

    def emit(batches):
        packed = np.frombuffer(wanted.value, np.uint8)
        held: dict[str, bool] = {}
        for batch in batches:
            counts: dict[str, int] = {}
            for text in filter(None, batch.column(0).to_pylist()):
                found = {x for w in set(_WORD.findall(text.lower())) for x in stems(w, s)}
                new = [x for x in found if x not in held]
                held.update(zip(new, bloom.hits(packed, _stem_hashes(new), bits).tolist()))
                for x in found:
                    if held[x]:
                        counts[x] = counts.get(x, 0) + 1
                if len(held) > REMEMBERED:
                    held = {}
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["stem", "n"])

    clean = learn.where("toxic = 0").select("text").mapInArrow(trimmed(emit), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("clean"))
    return toxic.join(clean, "stem", "left").select("stem", "toxic", F.coalesce("clean", F.lit(0)).alias("clean"))


def learn_grammar(learn: DataFrame, settings: Settings | None = None) -> Grammar:
    """Learn from rows (``doc_id``, ``text``, ``toxic``).

    Without toxic or clean rows, or where no stem tells them apart, the lexicon
    is empty and every score low. Null texts and other labels are left out.

    A stem needs so many toxic contexts that chance would give about one such
    stem in all at the share of toxic texts.
    """
    s = settings or Settings()
    learn = learn.where("text is not null and toxic in (0, 1)")
    n = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Grammar({}, s)
    counts = stored(stem_counts(learn.select("text", "toxic"), s), "toxic-stems")
    share = n[1] / (n[0] + n[1])
    kinds = counts.count()
    least = max(s.least_texts, math.ceil(math.log(max(kinds, 10)) / math.log(1 / min(share, 0.5))))
    weight = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    # One standard error below the estimate: few contexts make a light stem.
    doubt = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.where(F.col("toxic") >= least).withColumn("w", weight - doubt).where(F.col("w") >= s.least_weight)
    lexicon = own_evidence({r.stem: r.w for r in best.orderBy(F.desc(F.col("w") * F.sqrt("toxic")), "stem").limit(s.stems).collect()})
    grammar = Grammar(lexicon, s)
    if not lexicon:
        return grammar
    sample = sampled(learn.select("doc_id", "text", F.col("toxic").alias("label")), "doc_id", s.sample, sum(n.values()))
    rows = evidence_of(sample, grammar, "label").limit(2 * s.sample).collect()
    x = np.array([math.log1p(r.evidence) for r in rows])
    y = np.array([float(r.label) for r in rows])
    slope, bias = logistic(x, y)
    return Grammar(lexicon, s, slope, bias)


def own_evidence(lexicon: dict[str, float]) -> dict[str, float]:
    """Without prefixes that owe their weight to one much heavier word, as ``lose`` to ``loser``."""
    heaviest: dict[str, float] = {}
    for stem, w in lexicon.items():
        body = stem.rstrip("$")
        for n in range(1, len(body) + stem.endswith("$")):
            heaviest[body[:n]] = max(w, heaviest.get(body[:n], 0.0))
    return {stem: w for stem, w in lexicon.items() if heaviest.get(stem, 0.0) <= w + 1}


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic regression by Newton's method, lightly penalised."""
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + l2 * 0.1 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + l2 * 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.1)), float(w[1])


def evidence_of(docs: DataFrame, grammar: Grammar, *carry: str) -> DataFrame:
    """(``carry``, ``evidence``, ``score``) of each row's ``text``."""
    held = docs.sparkSession.sparkContext.broadcast(grammar)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def read(batches):
        g, memory = held.value, {}
        for batch in batches:
            if len(memory) > REMEMBERED:
                memory = {}
            found = [g.evidence(t, memory) for t in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(found, pa.float64()), pa.array([g.score(e) for e in found], pa.float64())], [*carry, "evidence", "score"])

    return docs.select(*carry, "text").mapInArrow(trimmed(read), "".join(f"`{c}` {kinds[c]}, " for c in carry) + "evidence double, score double")


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows (``doc_id``, ``text``, ``toxic``) that may be learned from: crc32 of the id mod 4 is not 2.

    Texts are dealt once, and those without a label hardly at all: a Bloom
    filter of the labelled ids lets the others be left where they are. The
    result is a stored table, as it is read several times. Null ids, null
    texts and labels other than 0 and 1 are no learning rows. An id that
    repeats in either table gives a row for each pair of its rows.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = stored(labels.where("toxic in (0, 1)").where(fold("doc_id", 4) != 2), "toxic-labels")
    bits = bloom.bits_for(labels.count())
    labelled = docs.sparkSession.sparkContext.broadcast(bloom.gathered(labels.select("doc_id"), lambda b: np.unique(_id_hashes(b.column(0))), bits, twice=False))

    def keep(batches):
        packed = np.frombuffer(labelled.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(bloom.hits(packed, _id_hashes(batch.column(0)), bits)))

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    found = src.mapInArrow(trimmed(keep), "doc_id long, text string")
    # Dealt in the same way at every size, so that cost grows with the input.
    return stored(found.join(labels.hint("merge"), "doc_id"), "toxic-learning")


def _id_hashes(column: pa.Array) -> np.ndarray:
    return mix(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(1))


def score_toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, ``score``, ``predicted``) of every whole text; ``predicted`` is 1 from ``threshold``.

    Null and empty texts get the score of a text without evidence. One row per
    input row, repeated rows too; an empty table gives an empty result; other
    columns are ignored.
    """
    found = evidence_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), grammar, "id")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """The documents below ``threshold``, all columns as they were, whatever their names.

    Null and empty texts have no evidence and stay. Repeated rows are judged
    alike, rows without an id as all others. An empty table gives an empty
    result.
    """
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def keep(batches):
        g, memory = held.value, {}
        at = names.index("text")
        for batch in batches:
            if len(memory) > REMEMBERED:
                memory = {}
            ok = [g.score(g.evidence(t, memory)) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(trimmed(keep), kinds)
