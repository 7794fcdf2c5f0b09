"""Token ids by the byte-level BPE vocabulary, with a cache of whole chunks.

A blank followed by a non-blank always begins a token of this vocabulary's
pre-tokeniser, so a text is cut there and each chunk's ids are looked up. Chunks
that are new in a batch of texts are encoded together, and their ids told apart
by the tokens that begin with a blank. Texts in which a blank is followed by a
blank or by nothing, or that hold a special token, are encoded whole. Either way
the ids equal those of encoding the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np

#: Characters of cached chunks at most, and texts encoded together.
CACHE_CHARS, TEXTS = 2_500_000, 128


def vocabulary_paths() -> tuple[str, str]:
    """(path of the ranks, pre-tokeniser pattern) of the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Encoder:
    """Arrays of unsigned 32-bit ids of texts. One for each Python worker."""

    _held: dict[str, Encoder] = {}

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = tuple(special)
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.begins = np.zeros(self.bpe.n_vocab, bool)
        self.begins[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.cache: dict[str, bytes | None] = {}
        self.first: dict[str, bytes] = {}
        self.chars = 0

    @classmethod
    def shared(cls, path: str, pattern: str, special: dict[str, int]) -> Encoder:
        if path not in cls._held:
            cls._held[path] = cls(path, pattern, special)
        return cls._held[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special="all"), np.uint32).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Cache the ids of chunks, each read after a blank. None stands for a chunk that can't be told from its neighbours."""
        fit = []
        for c in new:
            if not c or c[0].isspace():
                self.cache[c] = None
            else:
                fit.append(c)
        if not fit:
            return
        ids = np.array(self.bpe.encode_ordinary(" " + " ".join(fit)), np.uint32)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(fit):
            self.cache.update((c, self._whole(" " + c)) for c in fit)
        else:
            raw, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            self.cache.update((c, raw[at[i] : at[i + 1]]) for i, c in enumerate(fit))
        self.chars += sum(map(len, fit))

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        texts = [t or "" for t in texts]
        out = []
        for lo in range(0, len(texts), TEXTS):
            some = texts[lo : lo + TEXTS]
            if self.chars > CACHE_CHARS:
                self.cache.clear()
                self.first.clear()
                self.chars = 0
            cut = [t.split(" ") for t in some]
            new = set().union(*cut)
            new = new.difference(self.cache)
            self._learn(new)
            for t, chunks in zip(some, cut, strict=True):
                if any(s in t for s in self.special):
                    found = self._whole(t)
                else:
                    head = chunks[0]
                    try:
                        tail = b"".join(map(self.cache.__getitem__, chunks[1:]))
                    except TypeError:  # a None: blanks side by side
                        found = self._whole(t)
                    else:
                        start = self.first.get(head)
                        if start is None:
                            start = self._whole(head) if head else b""
                            if len(head) < 40:
                                self.first[head] = start
                                self.chars += len(head)
                        found = start + tail
                out.append(np.frombuffer(found, np.uint32))
        return out


#: The vocabulary's one special token, as its file gives it.
SPECIAL = {"<|endoftext|>": 50256}
SEPARATOR = 0
