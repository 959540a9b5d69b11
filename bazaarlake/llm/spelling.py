"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

A vector holds how often each letter occurs in a word. A replaced letter lowers
one count by one and raises another by one, an inserted one raises one count:
the L1 distance is at most two. For words of each length a k-d tree is cut on
a bounded sample; its leaves are the cells that words are dealt to, and a word
visits the cells whose boxes such an edit can reach, among words as long as it
and among those longer by one. In a cell a tree of its own is searched in the
same way, and what it finds is verified by the order of the letters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, spread_join, stored, trimmed
from .runs import counted

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ONE_IN = 97  # of these (document, word) pairs one loses a letter
WIDTH = 256  # counts are kept by code point modulo this, which tells all letters of RUN apart
_HELD = 200_000


@dataclass(frozen=True)
class Settings:
    """``cell_rows``: words of a cell at which it is cut no more, and of a block; ``sample`` bounds the words that cells are cut on."""

    cell_rows: int = 8000
    sample: int = 100_000
    bucket: int = 32
    block_chars: int = 1_000_000


@dataclass
class Node:
    """Words with at most ``at`` of letter ``letter`` are below ``low``, others below ``high``; a leaf has a number.

    ``least`` and ``most`` are the bounds that cuts above have set for that letter.
    """

    leaf: int = -1
    letter: int = 0
    at: int = 0
    least: int = 0
    most: int = 1 << 30
    low: Node | None = None
    high: Node | None = None
    rows: np.ndarray | None = field(default=None, repr=False)


def grow(vectors: np.ndarray, bucket: int, leaves: list[Node]) -> Node:
    """A k-d tree: the letter whose counts vary most is cut at their median, until ``bucket`` rows or equal ones are left."""
    root = Node()
    todo: list[tuple[Node, np.ndarray, dict[int, tuple[int, int]]]] = [(root, np.arange(len(vectors)), {})]
    while todo:
        node, rows, box = todo.pop()
        if len(rows) > bucket:
            here = vectors[rows]
            mean = here.mean(axis=0, dtype=np.float64)
            spread = np.einsum("ij,ij->j", here, here, dtype=np.float64) / len(rows) - mean**2
            letter = int(spread.argmax())
            values = here[:, letter]
            top = int(values.max())
            if values.min() < top:
                at = min(int(np.median(values)), top - 1)
                node.letter, node.at, node.low, node.high = letter, at, Node(), Node()
                node.least, node.most = box.get(letter, (0, 1 << 30))
                todo.append((node.low, rows[values <= at], box | {letter: (node.least, at)}))
                todo.append((node.high, rows[values > at], box | {letter: (at + 1, node.most)}))
                continue
        node.leaf, node.rows = len(leaves), rows
        leaves.append(node)
    return root


def reached(root: Node, vectors: np.ndarray, more: int, less: int):
    """(leaf, rows): which vectors come into a leaf's box when up to ``more`` letters are added and up to ``less`` taken away."""
    n = len(vectors)
    todo = [(root, np.arange(n), np.full(n, more), np.full(n, less))]
    while todo:
        node, rows, up, down = todo.pop()
        if not len(rows):
            continue
        if node.leaf >= 0:
            yield node, rows
            continue
        has = vectors[rows, node.letter].astype(np.int64)
        # What this cut asks for beyond what cuts of the same letter above have taken.
        down_low = down - np.maximum(has - node.at, 0) + np.maximum(has - node.most, 0)
        up_high = up - np.maximum(node.at + 1 - has, 0) + np.maximum(node.least - has, 0)
        low, high = down_low >= 0, up_high >= 0
        todo.append((node.low, rows[low], up[low], down_low[low]))
        todo.append((node.high, rows[high], up_high[high], down[high]))


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, letter counts) of equally long words, a row for each."""
    size = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)
    counts = np.zeros((len(words), WIDTH), dtype=np.int16 if size < 1 << 15 else np.int32)
    np.add.at(counts, (np.repeat(np.arange(len(words)), size), points.ravel() % WIDTH), 1)
    return points, counts


def letter_sets(counts: np.ndarray) -> np.ndarray:
    """A bit for each letter, several letters to a bit: one edit sets at most one and clears at most one."""
    sets = np.zeros(len(counts), dtype=np.uint64)
    for letter in np.flatnonzero(counts.any(axis=0)):
        sets |= (counts[:, letter] > 0).astype(np.uint64) << np.uint64(letter % 64)
    return sets


def by_length(words: list[str]) -> dict[int, np.ndarray]:
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of code points are one replaced code point apart or, where ``long`` is longer by one, one inserted one."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    before = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    after = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + after >= short.shape[1]


def near_pairs(asked: list[str], held: list[str], bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``asked``, place in ``held``) of words one edit apart; ``held`` are equally long, ``asked`` as long or shorter by one."""
    points, counts = letters(held)
    used = np.flatnonzero(counts.any(axis=0))
    sets, leaves = letter_sets(counts), []
    held_counts = counts[:, used]
    root = grow(held_counts, bucket, leaves)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size, rows in by_length(asked).items():
        own_points, own_counts = letters([asked[i] for i in rows])
        longer = points.shape[1] - size
        mine, own_sets = own_counts[:, used], letter_sets(own_counts)
        # Letters that no held word has are all to be taken away.
        strange = own_counts.sum(axis=1) - mine.sum(axis=1)
        fit = np.flatnonzero(strange <= 1 - longer)
        for node, found in reached(root, mine[fit], 1, 1 - longer):
            found = fit[found]
            for a in range(0, len(found), 20_000):
                part = found[a : a + 20_000]
                q, c = np.nonzero(np.bitwise_count(own_sets[part][:, None] ^ sets[node.rows][None, :]) <= 2 - longer)
                q, c = part[q], node.rows[c]
                near = np.abs(mine[q] - held_counts[c]).sum(axis=1) + strange[q] <= 2 - longer
                q, c = q[near], c[near]
                true = np.concatenate([np.zeros(0, bool), *[one_edit(own_points[q[b : b + 20_000]], points[c[b : b + 20_000]]) for b in range(0, len(q), 20_000)]])
                left.append(rows[q[true]])
                right.append(c[true])
    return np.concatenate(left), np.concatenate(right)


def word_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``word, n`` of all runs of letters, one in ``ONE_IN`` of the (document, run) pairs without one of its letters."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                name, text = name.as_py() or "", text.as_py()
                for word, n in counted(text, RUN).items() if text else ():
                    h = crc32(f"{name}:{word}".encode())
                    if h % ONE_IN == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] += n
                if len(held) > _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    found = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(trimmed(count), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _cells(words: DataFrame, s: Settings) -> dict[int, tuple[int, Node | None]]:
    """For each length the number of its first cell and its tree, None where one cell holds all; cells are numbered through."""
    sizes = {r.size: r.n for r in words.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as lengths
    large = [n for n, rows in sizes.items() if rows > s.cell_rows]
    total = sum(sizes[n] for n in large)
    some: dict[int, list[str]] = {n: [] for n in large}
    if large:
        cut = int(math.ldexp(min(1.0, s.sample / total), 32))
        chosen = words.where(F.col("size").isin(large) & (F.pmod(F.xxhash64("word"), F.lit(1 << 32)) < cut)).select("word").toArrow()
        for w in sorted(chosen.column("word").to_pylist()):
            some[len(w)].append(w)
    trees, first = {}, 0
    for size in sorted(sizes):
        leaves: list[Node] = []
        if some.get(size):
            share = len(some[size]) / sizes[size]
            tree = grow(letters(some[size])[1], max(4, int(s.cell_rows * share)), leaves)
            for leaf in leaves:
                leaf.rows = None
            trees[size] = (first, tree)
        else:
            trees[size] = (first, None)
        first += max(1, len(leaves))
    return trees


def near_words(words: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Of each word that has near ones: ``word, n_near, form_n, form``, the near word of largest n, ties to the smallest.

    ``words`` has distinct ``word`` and ``n``; near means exactly one inserted,
    deleted or replaced code point.
    """
    s = settings or Settings()
    spark = words.sparkSession
    words = words.select("word", "n", F.length("word").alias("size"))
    trees = spark.sparkContext.broadcast(_cells(words, s))  # bounded by the sample

    def route(batches):
        """Each word at home in one cell, and as a visitor in all that an edit can reach."""
        for batch in batches:
            words_, out = batch.column(0).to_pylist(), ([], [], [])
            for size, rows in by_length(words_).items() if words_ else ():
                counts = letters([words_[i] for i in rows])[1]
                for longer in (0, 1):
                    if size + longer not in trees.value:
                        continue
                    first, tree = trees.value[size + longer]
                    for visit in (False, True) if not longer else (True,):
                        if tree is None:
                            hits = [(0, np.arange(len(rows)))]
                        else:
                            hits = ((node.leaf, r) for node, r in reached(tree, counts, 1 if visit else 0, 1 - longer if visit else 0))
                        for leaf, r in hits:
                            out[0].append(rows[r])
                            out[1].append(np.full(len(r), first + leaf))
                            out[2].append(np.full(len(r), visit))
            if out[0]:
                row, cell, visit = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row)) for c in (0, 1, 2)], pa.array(cell.astype(np.int32)), pa.array(visit)], ["word", "n", "size", "cell", "visit"])

    routed = stored(words.mapInArrow(trimmed(route), "word string, n long, size int, cell int, visit boolean"), "spelling-cells")
    # A cell of anagrams cannot be cut by counts, and many words may visit one cell: homes and visitors are dealt to blocks, each two of which meet.
    room = F.greatest(F.lit(1), F.least(F.lit(s.cell_rows), F.floor(F.lit(s.block_chars) / F.max("size"))))
    per = routed.groupBy("cell", "visit").agg(F.ceil(F.count(F.lit(1)) / (room * F.when(F.col("visit"), 4).otherwise(1))).cast("int").alias("parts"))
    per = stored(per.groupBy("cell").agg(F.max(F.when(~F.col("visit"), F.col("parts"))).alias("blocks"), F.max(F.when(F.col("visit"), F.col("parts"))).alias("sides")), "spelling-parts")
    per = F.broadcast(per.where("blocks is not null and sides is not null"))  # as many as cells
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = routed.where(~F.col("visit")).join(per, "cell").withColumn("block", own("blocks")).withColumn("side", each("sides")).select("cell", "block", "side", "word", "n")
    visits = routed.where("visit").join(per, "cell").withColumn("side", own("sides")).withColumn("block", each("blocks"))
    visits = visits.select(F.col("cell").alias("of"), F.col("block").alias("at"), F.col("side").alias("by"), F.col("word").alias("asked"), F.col("n").alias("asked_n"))

    def search(left, right):
        asked, held = left.column("asked").to_pylist(), right.column("word").to_pylist()
        found: dict[str, list] = {}
        if asked and held:
            n_asked, n_held = left.column("asked_n").to_pylist(), right.column("n").to_pylist()

            def tell(word: str, other: str, n: int) -> None:
                has = found.setdefault(word, [0, -1, ""])
                has[0] += 1
                if n > has[1] or n == has[1] and other.encode() < has[2].encode():
                    has[1], has[2] = n, other

            for q, c in zip(*(x.tolist() for x in near_pairs(asked, held, s.bucket))):
                tell(asked[q], held[c], n_held[c])
                if len(asked[q]) < len(held[c]):  # words as long as each other visit each other
                    tell(held[c], asked[q], n_asked[q])
            give_back()
        return pa.table({"word": pa.array(found.keys(), pa.string()), **{k: pa.array([v[i] for v in found.values()], t) for i, (k, t) in enumerate((("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())))}})

    met = visits.groupBy("of", "at", "by").cogroup(homes.groupBy("cell", "block", "side")).applyInArrow(search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def follow(links: DataFrame) -> DataFrame:
    """``word, root`` of each word with a form: its forms followed to the last. Each round follows twice as many; a form is at least twice as frequent, so rounds are few."""
    ends = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    done: list[DataFrame] = []
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(spread_join(ends, onward, "root"), "spelling-roots")
        if not moved.limit(1).count():
            break
        still = ends.join(moved.select("word"), "word", "left_anti")
        ends = stored(still.unionByName(moved.select("word", F.col("next").alias("root"))), "spelling-roots")
    return ends


def spelling_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_length: int = 5, least_n: int = 3, ratio: int = 2, settings: Settings | None = None) -> DataFrame:
    """One row for each word of the texts: ``word, form, root, n, n_near, form_n``.

    Words are the runs of letters of whole texts, A-Z lower-cased, of at least
    ``least_length`` code points that occur at least ``least_n`` times; one in
    97 of the (document, run) pairs has lost a letter, by a hash. The form is
    the near word of largest n (ties: the smallest), if that is at least
    ``ratio`` times the word's n, else null; the root is where forms lead, or
    the word itself. Null texts have no words, a null id counts as empty;
    rows are counted as they come, repeated ones too. Other columns are ignored;
    an empty table gives an empty result.
    """
    counts = word_counts(docs, text_col, id_col).where((F.length("word") >= least_length) & (F.col("n") >= least_n))
    words = stored(counts, "spelling-words")
    near = stored(words.join(near_words(words, settings), "word", "left"), "spelling-near")
    formed = F.col("form_n") >= ratio * F.col("n")
    links = near.where(formed).select("word", "form")
    found = near.select("word", F.when(formed, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n"))
    return found.join(follow(links), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
