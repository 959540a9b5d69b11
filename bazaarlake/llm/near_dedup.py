"""Near-duplicate detection with DartMinHash signatures and banded joining.

Each text is a weighted set: its five-word shingles, weighted by how often
they occur. Darts are thrown at the (weight, rank) plane of every shingle, the
same darts in every text; a text keeps the darts that fall under its weights,
and of each signature coordinate the dart of smallest rank. Two texts agree in
a coordinate with the probability of their weighted Jaccard similarity.

Copies are merged first. Texts that agree in a whole band meet in a bucket.
Small buckets give all their pairs. Large ones give a star around their hub.
Pairs are verified exactly. Where the texts around a hub are left in several
components, blocks of them are compared in tasks that write further links
alone. Components of the links are classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, spread_join, stored, trimmed
from .components import components
from .words import mix, slices, units, weighted_jaccard, weighted_sets, words

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of ``n`` weighted sets, shape (n, k), and which sets have any weight.

    An element of weight w owns the unit regions 0 to ceil(w) - 1. In each,
    darts fall as a Poisson process over rank; a dart in the last region counts
    only if its place there is below the remaining weight. Ranks are searched
    up to a bound at which k ln k + 2 k darts are expected for a set; a set
    that still lacks a coordinate is searched again with twice the bound.
    """
    signature = np.zeros((n, k), dtype=np.uint64)
    total = np.bincount(owner, weight, n)
    alive = total > 0
    full = np.ceil(weight).astype(np.int64)
    region_of = np.repeat(np.arange(len(owner)), full)
    layer = np.arange(len(region_of)) - np.repeat(np.cumsum(full) - full, full)
    seed = mix(element[region_of] * _GOLD + layer.astype(np.uint64))
    room = np.minimum(weight[region_of] - layer, 1.0)
    home = owner[region_of]
    todo, bound = alive.copy(), np.zeros(n)
    bound[alive] = (k * np.log(k) + 2 * k) / total[alive]
    while todo.any():
        part = np.flatnonzero(todo[home])
        s, r, o = seed[part], room[part], home[part]
        rank = np.zeros(len(part))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        throw = 0
        while len(s):
            throw += 1
            x = mix(s + np.uint64(throw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            near = rank <= bound[o]
            s, r, o, rank, x = s[near], r[near], o[near], rank[near], x[near]
            y = mix(x ^ _GOLD)
            hit = ((mix(y + _GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53) < r
            slot = ((y >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            found.append((o[hit] * k + slot[hit], rank[hit], y[hit]))
        place, ranks, dart = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(-ranks, kind="stable")
        flat = np.zeros(n * k, dtype=np.uint64)
        filled = np.zeros(n * k, dtype=bool)
        flat[place[order]] = dart[order]  # the last one written has the smallest rank
        filled[place] = True
        done = todo & filled.reshape(n, k).all(axis=1)
        signature[done] = flat.reshape(n, k)[done]
        todo &= ~done
        bound[todo] *= 2
    return signature, alive


def bands_of(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` coordinates, with the band's number mixed in."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    h = np.broadcast_to(mix(np.arange(1, k // rows + 1, dtype=np.uint64)), (n, k // rows)).copy()
    for j in range(rows):
        h = mix(h * _GOLD + parts[:, :, j])
    return h


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def sign(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                owner, element, count = weighted_sets(words(part.column(1)))
                sig, alive = dart_signatures(owner, element, count.astype(np.float64), b - a, bands * rows)
                h = bands_of(sig, rows).astype("<i8")
                packed = pa.array([h[i].tobytes() if alive[i] else None for i in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), packed], ["doc_id", "digest", "bands"])

    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    return src.mapInArrow(trimmed(sign), "doc_id long, digest binary, bands binary")


def _exploded(reps: DataFrame, bands: int) -> DataFrame:
    """(``band``, ``rep``) for each band of each representative with words."""

    def spread(batches):
        for batch in batches:
            packed = batch.column(1).to_pylist()
            flat = np.frombuffer(b"".join(packed), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["band", "rep"])

    return reps.where("bands is not null").select("rep", "bands").mapInArrow(spread, "band long, rep long")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts have at least ``threshold`` weighted Jaccard similarity."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def judge(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                ok = weighted_jaccard(part.column(2), part.column(3)) >= threshold
                yield part.select(["a", "b"]).filter(pa.array(ok))

    # ``a`` is the member of a star and ``b`` its hub, which very many pairs may have.
    joined = spread_join(pairs.join(left, "a"), right, "b", pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ["a"])
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(judge), "a long, b long")


def _overlaps(row: np.ndarray, unit: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many units each of the texts ``left`` shares with each of ``right``; ``row`` and ``unit`` list the units of all ``n`` texts."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    at, to = np.full(n, -1), np.full(n, -1)
    at[left], to[right] = np.arange(len(left)), np.arange(len(right))
    _, unit = np.unique(unit, return_inverse=True)
    order = np.argsort(unit, kind="stable")
    row, unit = row[order], unit[order]
    width = 2048
    for lo in range(0, int(unit[-1]) + 1 if len(unit) else 0, width):
        a, b = np.searchsorted(unit, [lo, lo + width])
        r, u = row[a:b], unit[a:b] - lo
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        mine, theirs = at[r] >= 0, to[r] >= 0
        x[at[r[mine]], u[mine]] = 1
        y[to[r[theirs]], u[theirs]] = 1
        out += x @ y.T
    return out


def links_between(rep: np.ndarray, label: np.ndarray, block: np.ndarray, texts, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of alike texts with different labels, one or two blocks at hand; of a text's links to one label, one is enough.

    Pairs within a block are left to the tile that has this block alone.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(rep) < 2 or (label == label[0]).all():
        return none, none
    row, unit = units(words(texts))
    size = np.bincount(row, minlength=len(rep)).astype(np.float64)
    _, back, often = np.unique(unit, return_inverse=True, return_counts=True)
    row, unit = row[often[back] > 1], unit[often[back] > 1]  # a unit of one text is shared by none
    names, most = np.unique(label, return_counts=True)
    main = label == names[most.argmax()]
    first, alone = block == block.min(), block.min() == block.max()
    sides = [(~main, np.ones(len(rep), bool))] if alone else [(first & ~main, ~first), (first & main, ~first & ~main)]
    a, b = [none], [none]
    for one, other in sides:
        left, right = np.flatnonzero(one), np.flatnonzero(other)
        if len(left) and len(right):
            shared = _overlaps(row, unit, len(rep), left, right).astype(np.float64)
            union = size[left][:, None] + size[right][None, :] - shared
            ok = (shared >= threshold * union * (1 - 1e-12)) & (shared > 0) & (label[left][:, None] != label[right][None, :])
            p, q = np.nonzero(ok)
            ok = np.divide(shared[p, q], union[p, q]) >= threshold
            p, q = p[ok], q[ok]
            once = np.unique(np.stack([p, np.unique(label[right], return_inverse=True)[1][q]]), axis=1, return_index=True)[1] if len(p) else none
            a.append(rep[left[p[once]]])
            b.append(rep[right[q[once]]])
    return np.concatenate(a), np.concatenate(b)


def links_in_groups(members: DataFrame, texts: DataFrame, threshold: float, block_rows: int = 1000, block_bytes: int = 8_000_000) -> DataFrame:
    """Links (``a``, ``b``) between members (``hub``, ``rep``, ``label``) of one group that have different labels.

    A group is cut into blocks of about ``block_rows`` texts and ``block_bytes``
    bytes, and each two blocks meet in a task of their own, which keeps its
    pairs to itself and writes links alone. So a task's memory is bounded
    whatever the group, and rows grow with its size times its blocks.
    """

    def compare(table):
        found = links_between(*(table.column(c).to_numpy() for c in ("rep", "label", "block")), table.column("text"), threshold)
        give_back()
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    held = stored(members.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep"), "near-groups")
    sizes = held.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = sizes.select("hub", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("blocks"))
    placed = spread_join(held, blocks, "hub", sizes.select("hub", "n"), ["rep"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "label", "block", F.coalesce("text", F.lit("")).alias("text"))
    return tiles.groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def linked(met: DataFrame, texts: DataFrame, threshold: float, small_bucket: int, block_rows: int) -> DataFrame:
    """Components (``node``, ``label``) of the verified links among texts that share a bucket.

    ``met`` holds (``band``, ``rep``, ``n``): the buckets of several texts and
    their sizes; ``texts`` holds (``doc_id``, ``text``) of each ``rep``.
    """
    small = met.where(F.col("n") <= small_bucket)
    by_band = small.select("band", F.col("rep").alias("a")).join(small.select("band", F.col("rep").alias("b")), "band").where("a < b").select("a", "b")
    # The hub of a large bucket is the member that meets most others over all bands: the one most copies resemble.
    large = met.where(F.col("n") > small_bucket)
    reach = met.groupBy("rep").agg(F.sum("n").alias("reach"))
    hubs = large.join(reach, "rep").groupBy("band").agg(F.max_by("rep", F.struct("reach", -F.col("rep"))).alias("hub"), F.first("n").alias("n"))
    hubs = stored(hubs, "near-hubs")
    named = spread_join(large.select("band", "rep"), hubs.select("band", "hub"), "band", hubs.select("band", "n"))
    stars = stored(named.select("hub", "rep").distinct(), "near-stars")
    pairs = stored(by_band.unionByName(stars.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))).distinct(), "near-pairs")
    edges = stored(verified(pairs, texts, threshold), "near-edges")
    labels = components(edges)

    # All texts of a bucket have its hub in common. Where a hub's texts are in several components, these may have links that its star missed.
    members = stars.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    members = stored(members, "near-members")
    per_hub = members.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l"), F.max("label").alias("h"))
    mixed = stored(per_hub.where("l < h").select("hub", "n"), "near-mixed")
    if not mixed.limit(1).count():
        return labels
    more = stored(links_in_groups(spread_join(members, mixed.select("hub"), "hub", mixed), texts, threshold, block_rows), "near-rest")
    return components(edges.unionByName(more)) if more.limit(1).count() else labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 25, rows: int = 4, small_bucket: int = 12, block_rows: int = 1000
) -> DataFrame:
    """Classes of near-duplicate documents: one row per document.

    Returns ``doc_id, class_id, class_size, copies, kept``: the class is named
    after its smallest id, which is the document kept; ``copies`` counts the
    documents with the very same text. Similarity is weighted Jaccard over
    five-word shingles and their counts; a text of one to four words is one
    shingle. A pair at 0.8 shares no band with probability (1 - 0.8^4)^25, two
    in a million. Texts without any word are similar to equal texts only. A
    null text counts as empty. Ids are cast to long and should be unique: rows
    that repeat an id are one node, whose smallest text is compared, and rows
    without an id are left out. An empty table gives an empty result. Other
    columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _classes(src, threshold, bands, rows, small_bucket, block_rows).drop("digest")


def _classes(src: DataFrame, threshold: float = 0.8, bands: int = 25, rows: int = 4, small_bucket: int = 12, block_rows: int = 1000) -> DataFrame:
    """The result of ``near_duplicates`` for (``doc_id``, ``text``), and the ``digest`` of each row's text."""
    src = src.where("doc_id is not null")
    signed = stored(_signed(src, bands, rows), "near-signed")
    reps = stored(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "near-reps")

    banded = _exploded(reps, bands)
    crowded = stored(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-crowded")
    met = stored(spread_join(banded, crowded, "band", crowded), "near-buckets")  # (band, rep, n) of buckets with several texts

    needed = met.select(F.col("rep").alias("doc_id")).distinct()
    texts = stored(src.join(needed, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "near-texts")
    labels = linked(met, texts, threshold, small_bucket, block_rows)

    classes = stored(reps.join(labels, F.col("rep") == F.col("node"), "left").select("digest", "copies", F.coalesce("label", "rep").alias("class_id")), "near-classes")
    sizes = stored(classes.groupBy("class_id").agg(F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n")), "near-sizes")
    classes = spread_join(classes, sizes.select("class_id", "class_size"), "class_id", sizes.select("class_id", "n"))
    return (
        spread_join(signed.select("doc_id", "digest"), classes, "digest", reps.select("digest", F.col("copies").alias("n")))
        .select("doc_id", "digest", "class_id", F.col("class_size").cast("long").alias("class_size"), F.col("copies").cast("long").alias("copies"), (F.col("doc_id") == F.col("class_id")).alias("kept"))
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, all columns: the smallest id of each near-duplicate class; rows without an id stay.

    Takes the options of ``near_duplicates``. Of rows that repeat an id, those
    whose own text is a copy go.
    """
    gone, of = fresh(docs.columns, "_gone"), fresh(docs.columns, "_digest")
    found = _classes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), **options)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone), F.col("digest").alias(of))
    text = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return docs.join(dropped, (F.col(id_col).cast("long") == F.col(gone)) & (text == F.col(of)), "left_anti")
