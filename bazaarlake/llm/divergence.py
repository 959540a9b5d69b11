"""Source divergence audit: how the words of each source differ from those of its peers in the same language.

A group is a (language, source) pair; its row of the matrix holds the share of
each kept term in billionths. Groups are rows, terms are columns, and the rows
are sparse. Rows are accumulated after Gustavson: a group's terms are looked up
in a term-major index, and what each posting found there adds is scattered into
a dense accumulator with a place for each peer; no pair of postings leaves a
task. Terms that a group lacks have a share above zero, its baseline. So the
accumulator is corrected: it starts from both baselines, and gets, for each term
of the group, the difference to its baseline against the peers' baselines.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, stored, trimmed
from .runs import counted

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SHARD_ROWS = 100_000  # postings of a task
BLOCK_GROUPS = 512  # groups whose rows a task accumulates
_HELD = 300_000  # terms of a task before they are passed on
_DOC = 1 << 40  # occurrences and documents of a term are held in one number
_CELLS = 500_000  # of a work array


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exactly: a long division of three steps, so that nothing overflows below 9 * 10^15."""
    rest, below = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * terms
    out = np.ones(np.broadcast(rest, below).shape, dtype=np.int64)
    for scale in (1_000_000, 1000, 1):
        digit, rest = np.divmod(rest * 1000, below)
        out += digit * scale
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); below 2 * 10^9 both, so that the square fits a long."""
    gap = p - q
    return gap * gap // (p + q)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group; all rows of a term of a language are in one partition."""
    names = ["lang", "source", "term", "n", "docs"]

    def count(batches):
        held: dict[tuple[str, str], dict[str, int]] = {}
        size = 0

        def told():
            for (lang, source), both in held.items():
                packed = np.fromiter(both.values(), np.int64, len(both))
                columns = [lang] * len(both), [source] * len(both), list(both), packed % _DOC, packed // _DOC
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names)

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                both = held.setdefault((lang, source), {})
                before, get = len(both), both.get
                for term, n in counted(text, TERM).items() if text else ():
                    both[term] = get(term, 0) + n + _DOC
                size += len(both) - before
                if size > _HELD:
                    yield from told()
                    held, size = {}, 0
        yield from told()

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)])
    found = named.mapInArrow(trimmed(count), "lang string, source string, term string, n long, docs long")
    # Tasks have summed up already; dealt by term, what follows needs no other shuffle.
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def accumulate(group: np.ndarray, term: np.ndarray, p: np.ndarray, p0: np.ndarray, mine: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(group, both, single) of each group of ``mine``: by peer, the correction of terms that both have and that of the group's own terms.

    Postings are parallel arrays of group, term and share; ``p0`` has each group's baseline.
    """
    by_term = np.lexsort((group, term))  # the term-major index
    group, term, p = group[by_term], term[by_term], p[by_term]
    start = np.searchsorted(term, np.arange(term.max() + 2 if len(term) else 1))
    by_group = np.argsort(group, kind="stable")
    first = np.searchsorted(group[by_group], np.arange(len(p0) + 1))
    out = []
    for g in mine.tolist():
        row = by_group[first[g] : first[g + 1]]
        both, single = np.zeros(len(p0), dtype=np.int64), np.zeros(len(p0), dtype=np.int64)
        corner = divergence(p0[g], p0)  # what a term that neither has adds
        # Terms of equal share add the same against a baseline.
        values, times = np.unique(p[row], return_counts=True)
        step = max(1, _CELLS // len(p0))
        for a in range(0, len(values), step):
            single += (times[a : a + step, None] * (divergence(values[a : a + step, None], p0) - corner)).sum(axis=0)
        # Postings after the group's own in each of its terms: pairs are taken once, by their smaller group.
        begin, end = row + 1, start[term[row] + 1]
        for a in range(0, len(row), step):
            n = (end - begin)[a : a + step]
            at = np.repeat(begin[a : a + step] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own, peer = np.repeat(p[row[a : a + step]], n), group[at]
            more = divergence(own, p[at]) - divergence(own, p0[peer]) - divergence(p0[g], p[at]) + corner[peer]
            np.add.at(both, peer, more)
        out.append((g, both, single))
    return out


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10, shard_rows: int = SHARD_ROWS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """``lang, source, part, item, value, rank``: peers and telling terms of each (language, source) group.

    Terms are runs of ASCII letters and all characters beyond ASCII, A-Z
    lower-cased; a language keeps those in at least ``least_docs`` of its
    documents. A group's share of a term is 1 + floor(10^9 (count + 2) / (N +
    2 V)) of its N kept occurrences and the language's V terms. Part ``pair``
    has each other source of the language with the sum of
    floor((p - q)^2 / (p + q)) over all kept terms, part ``term`` the ``top`` terms
    that the group has and uses more than the language. Ranks are by value,
    then by the item's bytes. Null text, language and source count as empty
    ones; a group without terms has shares too. Repeated rows count as often
    as they come; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, text_col, lang_col, source_col).withColumns({"of_docs": F.sum("docs").over(of_term), "of_lang": F.sum("n").over(of_term)})
    postings = stored(counts.where(F.col("of_docs") >= least_docs).select("lang", "source", "term", "n", "of_lang"), "divergence-postings")

    # One row for each group and for each language, small tables: numbers of groups, kept terms and occurrences.
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    held = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    groups = occurring.join(held, ["lang", "source"], "left").na.fill(0, ["total", "rows"])
    groups = groups.withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.sum("total").alias("lang_total"), F.sum("rows").alias("lang_rows"))
    langs = langs.join(postings.groupBy("lang").agg(F.countDistinct("term").alias("terms")), "lang", "left").na.fill(0, ["terms"])
    langs = langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("lang_rows") / shard_rows)).cast("int")).withColumn("blocks", F.ceil(F.col("groups") / block_groups).cast("int"))
    groups = stored(groups.join(langs, "lang"), "divergence-groups")

    # Postings of one term share a shard; each block of groups meets each shard.
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sharded = postings.join(groups.select("lang", "source", "gid", "shards", "blocks"), ["lang", "source"])
    sharded = sharded.withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")).withColumn("block", each("blocks")).select("lang", "shard", "block", "gid", "term", "n", "of_lang")
    peers = groups.withColumn("shard", each("shards")).withColumn("block", each("blocks"))
    peers = peers.select(F.col("lang").alias("in"), F.col("shard").alias("of"), F.col("block").alias("at"), F.col("gid").alias("peer"), "total", "lang_total", "terms")
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    names = ["lang", "part", "one", "other", "term", "value"]

    def audit(key, peers, index):
        """Sums of a shard for its block of groups: (smaller group, larger group, value), and each group's best terms."""
        lang, shard, block = (k.as_py() for k in key)
        columns: list[list] = [[] for _ in kinds]

        def put(*values) -> None:
            for c, v in zip(columns, values):
                c.extend(v)

        total = peers.column("total").to_numpy()[np.argsort(peers.column("peer").to_numpy())]
        kept = int(peers.column("terms")[0].as_py())
        mine = np.arange(block * block_groups, min(len(total), (block + 1) * block_groups))
        coded = pa.concat_arrays([c.cast(pa.string()) for c in index.column("term").chunks] or [pa.array([], pa.string())]).dictionary_encode()
        group, count, code = index.column("gid").to_numpy(), index.column("n").to_numpy(), coded.indices.to_numpy().astype(np.int64)
        p0 = shares(np.zeros(len(total)), total, kept) if kept else np.zeros(len(total), np.int64)
        p = shares(count, total[group], kept) if kept else np.zeros(0, np.int64)
        for g, both, single in accumulate(group, code, p, p0, mine):
            value = both + single
            if kept and not shard:  # the corner of every two groups once, all terms counted as if neither had them
                value[g + 1 :] += kept * divergence(p0[g], p0[g + 1 :])
            peer = np.delete(np.arange(len(total)), g)
            if shard:
                peer = peer[value[peer] != 0]
            put(["pair"] * len(peer), np.minimum(g, peer).tolist(), np.maximum(g, peer).tolist(), [None] * len(peer), value[peer].tolist())
        if len(group):
            q = shares(index.column("of_lang").to_numpy(), peers.column("lang_total")[0].as_py(), kept)
            value = divergence(p, q)
            telling = np.flatnonzero((p > q) & (group >= mine[0]) & (group <= mine[-1]))
            telling = telling[np.lexsort((-value[telling], group[telling]))]
            bounds = np.searchsorted(group[telling], np.arange(mine[0], mine[-1] + 2))
            for g, a, b in zip(mine.tolist(), bounds, bounds[1:]):
                some = telling[a:b]
                if len(some) > top:  # with all that tie with the last
                    some = some[value[some] >= value[some[top - 1]]]
                words = coded.dictionary.take(pa.array(code[some])).to_pylist()
                found = sorted(zip((-value[some]).tolist(), words), key=lambda x: (x[0], x[1].encode()))[:top]
                put(["term"] * len(found), [g] * len(found), [None] * len(found), [t for _, t in found], [-v for v, _ in found])
        give_back()
        return pa.Table.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    kind = "lang string, part string, one int, other int, term string, value long"
    found = stored(peers.groupBy("in", "of", "at").cogroup(sharded.groupBy("lang", "shard", "block")).applyInArrow(audit, kind), "divergence-found")

    named = groups.select("lang", F.col("gid").alias("one"), "source")
    peer = groups.select("lang", F.col("gid").alias("other"), F.col("source").alias("item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "value")).join(peer, ["lang", "other"])
    telling = found.where("part = 'term'").select("lang", "one", F.col("term").alias("item"), "value")
    rows = pairs.select("lang", "one", F.lit("pair").alias("part"), "item", "value").unionByName(telling.withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "one", "part").orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).join(named, ["lang", "one"])
    return rows.select("lang", "source", "part", "item", "value", "rank")
