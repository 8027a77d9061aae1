"""Token ids of whole texts by a public tokenizer file, for the executors.

Byte-level BPE never merges across its pre-tokens, and a pre-token border always lies before a
space that has something else than white space on one side. So a text is cut at single spaces
and each piece's ids come from a bounded cache; the pieces that a batch adds are encoded
together, with the vocabulary that the tokenizer file holds. Texts with white space on both
sides of a space (the text's end counts) are encoded whole by the tokenizers library, whose ids
all others equal too (tests compare them). A text's ids are kept as little-endian unsigned
32-bit numbers in bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Pieces that a worker keeps; at more, the cache starts anew.
CACHE_PIECES = 600_000

_HARD = re.compile(r"\s (?:\s|\Z)")
# The published pre-token pattern of this kind of byte-level BPE.
_PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as bytes. Names of special tokens count as ordinary text."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._limit = cache_pieces
        self._cache: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters, special = _byte_letters(), {x["content"] for x in described["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        self._fast = tiktoken.Encoding("own", pat_str=_PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self._spaced = np.zeros(max(ranks.values()) + 1, bool)
        self._spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def whole(self, text: str) -> bytes:
        """A text's ids by the tokenizers library."""
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """Each text's ids; null has none."""
        parts = [None if not t or _HARD.search(t) else t.split(" ") for t in texts]
        self._learn(parts)
        cache = self._cache
        return [
            (self.whole(t) if t else b"")
            if p is None
            else self._ids(p[0]) + b"".join([cache[x] for x in p[1:]])
            for t, p in zip(texts, parts, strict=True)
        ]

    def _ids(self, text: str) -> bytes:
        return np.asarray(self._fast.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, parts: list[list[str] | None]) -> None:
        words = set(chain.from_iterable(p[1:] for p in parts if p))
        cache = self._cache
        if len(cache) > self._limit:
            cache.clear()
        joined = []
        for x in words.difference(cache) if len(words) > len(cache) else [x for x in words if x not in cache]:
            if x and not (x[0].isspace() or x[-1].isspace()):
                joined.append(x)
            else:
                cache[x] = self._ids(" " + x)
        for i in range(0, len(joined), 4096):
            some = joined[i : i + 4096]
            ids = np.asarray(self._fast.encode_ordinary(" " + " ".join(some)), "<u4")
            starts = (np.flatnonzero(self._spaced[ids]) * 4).tolist()
            if len(starts) == len(some):
                data, ends = ids.tobytes(), [*starts[1:], 4 * len(ids)]
                cache.update(zip(some, [data[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))
            else:
                cache.update({x: self._ids(" " + x) for x in some})
