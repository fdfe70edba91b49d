"""Exact tokenisation piece by piece, for the byte-level BPE of the public tokenizers.

A text may be cut before every single space with no white space on either side: byte-level pre-tokens hold a space
only as their first character, so that no pre-token crosses such a cut and none looks beyond it. The pieces between
cuts are encoded by the library itself, once for each distinct piece while a worker's bounded cache holds it.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

import numpy as np

BESIDE = re.compile(r"\s (?:\s|\Z)")
CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """Pieces of a text; all but the first are shown without the space they begin with."""
    return text.split(" ") if BESIDE.search(text) is None else CUT.split(text)


class Encoder:
    """Ids of a piece, by the tokenizers library; short cuts give the same ids.

    ``ranks`` names the same vocabulary as a rank file: pieces of letters that all Unicode versions agree on go to
    the faster library, as every token of the vocabulary is what its own bytes encode to (tested), which makes both
    merge orders equal.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, piece: str) -> list[int]:
        if self.fast is not None and piece and max(piece) < "ɐ" and "<|" not in piece:
            return self.fast.encode_ordinary(piece)
        return self.tokenizer.encode(piece, add_special_tokens=False).ids


class Cache(dict):
    """From a piece (without its leading space) to ``value`` of its ids; forgets all misses when ``limit`` is passed."""

    def __init__(self, encoder: Encoder, value: Callable, start: dict | None = None, limit: int = 1_000_000):
        super().__init__(start or {})
        self.encoder, self.value, self.start, self.limit = encoder, value, start or {}, limit

    def __missing__(self, piece: str):
        found = self.value(self.encoder.ids(" " + piece))
        if "\n" not in piece and len(piece) < 64:
            self[piece] = found
        return found

    def all(self, text: str) -> list:
        """The values of all pieces of a text, in order."""
        if not text:
            return []
        if len(self) > self.limit + len(self.start):
            self.clear()
            self.update(self.start)
        head, *rest = pieces(text)
        out = list(map(self.__getitem__, rest))
        if head:
            out.insert(0, self.value(self.encoder.ids(head)))
        return out


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return np.array(ids, dtype="<u4").tobytes()
