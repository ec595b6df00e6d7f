"""Token ids of whole texts as little-endian 32-bit bytes, by the tokenizers library.

The byte-level vocabulary splits text before every single blank that a visible character follows, so a text is cut there
and each distinct piece is encoded by the library once per worker; a text with any other blank pattern before which a cut
could change the split is encoded whole, and so is one that holds an added token such as ``<|endoftext|>``, which the
library finds before it splits. Pieces are kept in a bounded cache.
"""

from __future__ import annotations

import os

import numpy as np

from .common import Generations

CACHE_PIECES = 600_000
#: A cut before a blank is safe when a visible character follows it; a text with any of these takes the whole-text way.
_PAIRS = [" " + c for c in " \t\n\x0b\x0c\r"]
_CONTROL = [chr(c) for c in (0, 0x1C, 0x1D, 0x1E, 0x1F)]
_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]


def unsafe(text: str) -> bool:
    """Whether a text has a blank or other white space at which cutting could change the library's split."""
    return text.endswith(" ") or any(p in text for p in _PAIRS) or any(c in text for c in _CONTROL) or (not text.isascii() and any(c in text for c in _WIDE))


class PieceEncoder:
    """Encode texts to id bytes; one per Python worker and vocabulary file."""

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.led = np.zeros(max(vocabulary.values()) + 1, bool)
        self.led[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # the vocabulary's sign for a blank
        self.cache = Generations(self._encode, cache)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Many pieces, each led by a blank and with no other, are encoded as one text and cut at the tokens of those blanks."""
        raw = self._whole(" " + " ".join(pieces))
        at = (np.flatnonzero(self.led[np.frombuffer(raw, "<u4")]) * 4).tolist()
        if len(at) != len(pieces):
            raise ValueError("a piece was not cut at its blank")
        return [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)])]

    def _whole(self, text: str) -> bytes:
        """The library's ids; its fast form leaves out offsets, which nothing here needs."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if unsafe(text) or any(t in text for t in self.added):
            return self._whole(text)
        first, *led = text.split(" ")
        return (self._whole(first) if first else b"") + b"".join(self.cache.values(led))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder; it outlives tasks, as Spark reuses Python workers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
