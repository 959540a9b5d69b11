"""Token ids of whole texts, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
import struct
import unicodedata

import numpy as np

# str.split() also splits at these four, which the tokenizer takes as ordinary characters.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
# A mark before a comma or full stop is one token with it, so these must not be parted.
_GLUED = re.compile(r"[,.](?<=[^\w\s][,.]|_[,.])")
# Lower-casing before composing matters with combining marks and final sigma.
_MARKS = re.compile("[\u0300-\u036f\u03a3\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_END_OF_WORD = re.compile(r"([,.])(?=\s|$)")


def _byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


def plainer(text: str) -> str:
    """The same ids in fewer distinct words: lower case, and a comma or full stop that ends a word on its own.

    Texts in which that could change an id are returned as they are.
    """
    # "<|" may begin a special token.
    if "<|" in text or _GLUED.search(text) or not text.isascii() and _MARKS.search(text):
        return text
    return _END_OF_WORD.sub(r" \1", text.lower())


class WordEncoder:
    """Encodes with a tokenizer that drops white space, so that words are independent of each other.

    Ids of recent words are kept in two generations of at most ``limit`` words
    each: a full younger one replaces the older, and hits in the older return
    to the younger, so frequent words stay and memory is bounded.
    """

    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for w in words:
            if w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w):
                # One run of lower-case letters: no step before the model changes or splits it.
                letters = w if w.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, w.encode()))
                ids = [t.id for t in self.model.tokenize(letters)]
            else:
                ids = self.tokenizer.encode(w, add_special_tokens=False).ids
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit numbers; none for null or empty text."""
        if not text:
            return np.zeros(0, dtype="<u4")
        if any(c in text for c in _ODD_SPACE):
            return np.frombuffer(self._encode([text])[0], dtype="<u4")
        words = plainer(text).split()
        parts = list(map(self.young.get, words))
        if None in parts:
            missing = list(dict.fromkeys(w for w, p in zip(words, parts) if p is None))
            known = {w: p for w in missing if (p := self.old.get(w)) is not None}
            new = [w for w in missing if w not in known and len(w) <= 64]
            known.update(zip(new, self._encode(new)))
            if len(self.young) + len(known) > self.limit:
                self.old, self.young = self.young, {}
            self.young.update(known)
            long = [w for w in missing if w not in known]
            known.update(zip(long, self._encode(long)))
            parts = [known[w] if p is None else p for w, p in zip(words, parts)]
        return np.frombuffer(b"".join(parts), dtype="<u4")


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that its memory serves all of the worker's tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
