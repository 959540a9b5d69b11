"""Line deduplication: two Bloom filters find suspected repeats, and only those are shuffled.

1. Builders read all lines and fill a once-seen and a twice-seen Bloom filter;
   block by block the filters of all builders are merged.
2. Lines that miss the merged twice-seen filter occur in one document only and
   never move. Suspected lines are shuffled by their full key, which confirms
   real repeats exactly and picks the smallest document id.
3. Documents that lose lines are rebuilt.

One filter for all holds ``2 ** filter_bits_log2 / 8`` lines (16 million by
default). Where there are more, 64-bit hashes of lines, but no lines, are dealt
to shards, each of which has a once-seen and a twice-seen filter of its own, so
that filters grow with the data and none beyond that size. The result is exact
either way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import fresh, partitions, spread_join, stored, trimmed


def line_keys(text: str | None) -> list[bytes]:
    """The key of every line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip().lower() for line in (text or "").encode().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _distinct(text: str | None, least: int) -> list[bytes]:
    """The keys of a document that count, each once."""
    return [key for key in set(line_keys(text)) if long_enough(key, least)]


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64)


def _batch_hashes(least: int):
    def of(batch):
        found = [_hashes(_distinct(t, least)) for t in batch.column("text").to_pylist()]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    return of


def _suspects_by_filter(src: DataFrame, min_chars: int, bits: int) -> DataFrame:
    """(``doc_id``, ``key``) of the lines that one broadcast twice-seen filter of all lines holds."""
    twice = src.sparkSession.sparkContext.broadcast(bloom.gathered(src.select("text"), _batch_hashes(min_chars), bits, twice=True))

    def suspects(batches):
        packed = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _distinct(text, min_chars)
                for k in np.flatnonzero(bloom.hits(packed, _hashes(found), bits)):
                    ids.append(doc_id)
                    keys.append(found[k])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return src.mapInArrow(trimmed(suspects), "doc_id long, key binary")


def _suspects_by_shards(src: DataFrame, min_chars: int, lines: int, bits: int) -> DataFrame:
    """The same where the lines need more filters than one: hashes are dealt to shards, and each shard filters its own."""
    shards = max(partitions(src.sparkSession), -(-8 * lines // bits))
    own = min(bits, bloom.bits_for(-(-lines // shards)))

    def hashed(batches):
        for batch in batches:
            found = [_hashes(_distinct(t, min_chars)) for t in batch.column(1).to_pylist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(flat.view(np.int64))], ["doc_id", "h"])

    def twice_at_most(batches):  # so that no shard gets all copies of a common line
        for batch in batches:
            distinct, counts = np.unique(batch.column(0).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(distinct, np.minimum(counts, 2)))], ["h"])

    def again(batches):
        pair = bloom.OnceTwice(own)
        for batch in batches:
            distinct, counts = np.unique(batch.column(0).to_numpy().view(np.uint64), return_counts=True)
            seen = pair.seen(distinct) | (counts > 1)
            pair.add(np.repeat(distinct, np.minimum(counts, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(distinct[seen].view(np.int64))], ["h"])

    def keys_of(batches):
        for batch in batches:
            ids, keys = [], []
            for doc_id, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found, wanted = _distinct(text, min_chars), set(wanted)
                for key, h in zip(found, _hashes(found).view(np.int64).tolist()):
                    if h in wanted:
                        ids.append(doc_id)
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    met = stored(src.where("doc_id is not null").mapInArrow(trimmed(hashed), "doc_id long, h long"), "lines-hashed")
    repeats = met.select("h").mapInArrow(twice_at_most, "h long").repartition(shards, "h").mapInArrow(trimmed(again), "h long")
    repeats = stored(repeats.distinct(), "lines-repeats")
    wanted = spread_join(met, repeats, "h").groupBy("doc_id").agg(F.collect_set("h").alias("wanted"))
    return src.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(trimmed(keys_of), "doc_id long, key binary")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 10, filter_bits_log2: int = 27) -> DataFrame:
    """(``doc_id``, ``key``) of each key whose lines a document must drop."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chars = F.coalesce(F.col("text"), F.lit(""))
    lines = src.agg(F.sum(F.length(chars) - F.length(F.replace(chars, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    if 8 * lines <= 1 << filter_bits_log2:
        suspects = _suspects_by_filter(src, min_chars, bloom.bits_for(lines, filter_bits_log2))
    else:
        suspects = _suspects_by_shards(src, min_chars, lines, 1 << filter_bits_log2)
    suspected = stored(suspects, "lines-suspected")
    # Smallest and largest id of a key: partial aggregation leaves one row per key and task, however common the key.
    held = suspected.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    held = stored(held.where("low < high").select("key", "low", "n"), "lines-held")
    return spread_join(suspected, held.select("key", "low"), "key", held.select("key", "n"), ["doc_id"]).where("doc_id > low").select("doc_id", "key")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, filter_bits_log2: int = 27) -> DataFrame:
    """Documents without lines whose key stands in a document with a smaller id.

    A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and
    A-Z lower-cased; keys under ``min_chars`` code points never count. Returns
    all input columns with the new ``text_col``, plus ``n_lines`` (before
    dropping) and ``n_dropped``; input columns of these two names are replaced.
    Null and empty texts are one empty line; a null text stays null. Ids may be
    null: such rows hold no lines of others and lose none. Rows that repeat an
    id are the same document and lose the same keys. An empty table gives an
    empty result.
    """
    own, gone, new = (fresh(docs.columns, c) for c in ("_id", "_lines", "_new"))
    drops = repeated_lines(docs, id_col, text_col, min_chars, filter_bits_log2)
    drops = drops.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("key").alias(gone))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*names).join(drops, F.col(id_col) == F.col(own), "left").drop(own)

    text = F.coalesce(F.col(text_col), F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")

    @F.pandas_udf("text string, dropped long")
    def rebuild(texts, drop_keys):
        import pandas as pd

        kept, dropped = [], []
        for t, cut in zip(texts, drop_keys):
            if t is None:
                kept.append(None)
                dropped.append(0)
                continue
            lines, out = t.split("\n"), set(cut)
            left = [x for x, k in zip(lines, line_keys(t)) if k not in out]
            kept.append("\n".join(left))
            dropped.append(len(lines) - len(left))
        return pd.DataFrame({"text": kept, "dropped": dropped})

    lost = F.col(gone).isNotNull()
    done = joined.withColumn(new, rebuild(F.when(lost, text), F.col(gone)))  # texts that lose nothing stay in the JVM
    out = [F.when(lost, F.col(f"{new}.text")).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in names]
    return done.select(*out, n_lines.alias("n_lines"), F.coalesce(F.col(f"{new}.dropped"), F.lit(0)).cast("long").alias("n_dropped"))
