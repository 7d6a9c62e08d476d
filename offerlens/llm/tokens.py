"""Token ids of texts by the tokenizers library, with a cache of the parts between spaces.

The byte-level vocabulary's pattern never lets a part cross a space that stands before a non-space: such a space opens
the next part, and what is left of it ends before it. So a text's ids are those of its space-led chunks, one after the
other. Texts in which a space is followed by white space or the end are encoded whole. A run of plain Latin letters is
one part of the pattern, and so are the signs and a line break after one; such parts go straight to the model.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

from .common import worker_cache

#: Latin letters, and chunks that are made of whole parts of the pattern.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_S = r"!-&(-/:-@\[-`{-~"  # ASCII signs but the apostrophe
PLAIN = re.compile(rf"( ?[{_L}]+)([{_S}]*)(?:(\n)([{_L}]+)([{_S}]*))?")

CACHED = 800_000  # chunks and parts that a worker keeps together, at about 300 bytes; the caches start anew when full


def _shown_bytes() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def token_bytes(path: str) -> Callable[[str], bytes]:
    """A function from text to its ids as little-endian unsigned 32-bit integers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    home = worker_cache(f"tokens:{path}")
    if "tokenizer" not in home:
        home["tokenizer"] = Tokenizer.from_file(path)
        home["tokenizer"].encode_special_tokens = True  # their strings in a text are ordinary text
    tokenizer = home["tokenizer"]
    odd = re.compile(r" (?:\s|\Z)")
    as_bytes = lambda ids: array("I", ids).tobytes()
    model, shown = tokenizer.model, home.setdefault("shown", _shown_bytes())

    class Learning(dict):
        """Ids by text, found when first asked for."""

        def __init__(self, find: Callable[[str], bytes]) -> None:
            self.find = find

        def __missing__(self, x: str) -> bytes:
            found = self.find(x)
            if len(parts) + len(chunks) >= CACHED:
                parts.clear()
                chunks.clear()
            self[x] = found
            return found

    def part(x: str) -> bytes:
        """Ids of one part of the pattern."""
        as_shown = "\u0120" + x[1:] if x[0] == " " and x.isascii() else x.encode().decode("latin-1").translate(shown)
        return as_bytes([t.id for t in model.tokenize(as_shown)])

    def chunk(x: str) -> bytes:
        m = PLAIN.fullmatch(x)
        if not m:
            return as_bytes(tokenizer.encode(x, add_special_tokens=False).ids)
        if m.end(1) == len(x):
            return part(x)  # one part, which the cache of chunks keeps
        return b"".join([parts[y] for y in m.groups() if y])

    if "chunks" not in home:
        parts, chunks = home["parts"], home["chunks"] = Learning(part), Learning(chunk)
    parts, chunks = home["parts"], home["chunks"]

    def encode(text: str) -> bytes:
        if "\0" in text or odd.search(text):
            return as_bytes(tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(chunks.__getitem__, text.replace(" ", "\0 ").split("\0")))

    return encode
