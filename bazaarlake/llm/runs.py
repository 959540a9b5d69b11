"""Runs of letters of whole texts, found in chunks so that a very long text needs no long list."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

#: ASCII capitals to small letters, byte by byte; bytes of other characters stay as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CHUNK = 1 << 20


def lowered(text: str) -> str:
    """``text`` with A-Z, and nothing else, lower-cased."""
    return text.encode().translate(LOWER).decode()


def chunks(text: str, inside: re.Pattern, size: int = CHUNK) -> Iterator[str]:
    """Pieces of about ``size`` characters that cut no run: each ends where ``inside`` no longer matches."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and inside.match(text[end]):
            end += 1
        yield text[at:end]
        at = end


def counted(text: str, run: re.Pattern) -> Counter:
    """How often each lower-cased run of ``text`` occurs; ``run`` matches one or more of the same kinds of characters."""
    found: Counter = Counter()
    for piece in chunks(lowered(text), run):
        found.update(run.findall(piece))
    return found
