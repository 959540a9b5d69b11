"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The pieces and scores come from a public ``.model`` file. The automaton reads
the text once; at each position its output links give every piece that ends
there, and each relaxes the best score of that position. No piece crosses from
another character into a space mark, so a text is cut before the first mark of
each run of marks, and the best path of the whole is the best paths of the
cuts; those of recent cuts are kept in a bounded memory.

Scores are those of the model file. Where no piece ends, one character is
unknown and is written as its UTF-8 bytes, so decoding gives the text back.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

SPACE = "▁"
_CUT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class PieceCoder:
    """Encoder and decoder of one model; ``limit`` bounds each of two generations of remembered cuts.

    The automaton is built when it is first needed: a worker that decodes has none.
    """

    def __init__(self, path: str, limit: int = 100_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[tuple[str, float, int]] = []
        self.texts: list[bytes] = []
        self.byte_ids = [0] * 256
        lowest = 0.0
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            byte = _BYTE.match(piece)
            if byte:
                self.byte_ids[int(byte[1], 16)] = i
                self.texts.append(bytes([int(byte[1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.texts.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece crosses into a space mark; texts could not be cut there")
                self.texts.append(piece.replace(SPACE, " ").encode())
                self.pieces.append((piece, model.get_score(i), i))
                lowest = min(lowest, model.get_score(i))
        self.unknown = lowest - 10.0
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @cached_property
    def automaton(self):
        import ahocorasick

        built = ahocorasick.Automaton()
        for piece, score, i in self.pieces:
            built.add_word(piece, (len(piece), score, i))
        built.make_automaton()
        return built

    def _viterbi(self, cut: str) -> bytes:
        n = len(cut)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        done = 0
        for end, (length, score, piece) in self.automaton.iter(cut):
            end += 1
            while done < end - 1:  # positions where nothing ended before
                done += 1
                self._unknown(best, back, done)
            total = best[end - length] + score
            if total > best[end]:
                best[end], back[end] = total, (end - length, piece)
        while done < n:
            done += 1
            self._unknown(best, back, done)
        ids: list[int] = []
        while n:
            start, piece = back[n]
            ids.extend([piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(cut[start:n].replace(SPACE, " ").encode())])
            n = start
        return struct.pack(f"<{len(ids)}I", *reversed(ids))

    def _unknown(self, best: list[float], back: list[tuple[int, int]], end: int) -> None:
        """Relax ``end`` by one unknown character; after all pieces that end there."""
        if best[end - 1] + self.unknown > best[end]:
            best[end], back[end] = best[end - 1] + self.unknown, (end - 1, -1)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; none for null or empty text.

        Spaces become marks; a mark in the text itself is written as bytes, so
        that decoding tells them apart.
        """
        if not text:
            return b""
        if SPACE in text:
            own = struct.pack("<3I", *(self.byte_ids[b] for b in SPACE.encode()))
            return own.join(self.encode(part) for part in text.split(SPACE))
        cuts = _CUT.findall(text.replace(" ", SPACE))
        parts = list(map(self.young.get, cuts))
        if None in parts:
            known: dict[str, bytes] = {}
            for cut in {c for c, p in zip(cuts, parts) if p is None}:
                found = self.old.get(cut)
                known[cut] = self._viterbi(cut) if found is None else found
            if len(self.young) + len(known) > self.limit:
                self.old, self.young = self.young, {}
            self.young.update((c, p) for c, p in known.items() if len(c) <= 64)
            parts = [known[c] if p is None else p for c, p in zip(cuts, parts)]
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.texts.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids))).decode()


_coders: dict[str, PieceCoder] = {}


def piece_coder(path: str) -> PieceCoder:
    """One coder for each Python worker."""
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids`` binary: little-endian unsigned 32-bit) of every whole text.

    Null and empty texts have no ids. One row per input row, repeated rows too;
    an empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        coder = piece_coder(model_path)
        for batch in batches:
            found = [coder.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(trimmed(encode), f"`{id_col}` {kind}, ids binary")


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ``text``) of encoded rows; null ids give a null text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def decode(batches):
        coder = piece_coder(model_path)
        for batch in batches:
            texts = [None if b is None else coder.decode(b) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(trimmed(decode), f"`{id_col}` {kind}, text string")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``n_pieces``, ``ids_crc32``, ``decoded_sha256``): the text is encoded, decoded again and digested."""
    encoded = encode_pieces(docs, model_path, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(batches):
        coder = piece_coder(model_path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([zlib.crc32(b) for b in ids], pa.int64()), pa.array([coder.decode(b) for b in ids], pa.string())],
                [id_col, "n_pieces", "ids_crc32", "text"],
            )

    found = encoded.mapInArrow(trimmed(digest), f"`{id_col}` {kind}, n_pieces long, ids_crc32 long, text string")
    return found.select(id_col, "n_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
