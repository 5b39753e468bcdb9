"""Token ids of whole texts by the tokenizers library."""

from __future__ import annotations

import functools
from array import array
from operator import attrgetter

import numpy as np

#: Pieces that a worker remembers, and the longest of them in bytes; both bound its memory, neither changes ids.
REMEMBERED, LONGEST = 250_000, 48
#: Marks that a byte-level pattern keeps together after a word.
ENDS = ".,;:!?#$%&*|"


ID = attrgetter("id")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one of those
    from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class _Whole(Exception):
    """A text that may not be cut at its spaces."""


class _Pieces(dict):
    """Ids of pieces, as bytes; each piece is encoded by the library once."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: bytes) -> bytes:
        text, parts = piece.decode("utf-8"), self.encoder.parts
        word = text.rstrip(ENDS)
        if word.isalpha():
            ids = parts[self.lead + word] + parts[text[len(word) :]]
        elif (not text and self.lead) or text[-1:].isspace() or (self.lead and text[:1].isspace()):
            raise _Whole
        else:
            above, _, below = text.partition("\n")
            if above and below and not (above[-1].isspace() or below[0].isspace()):
                ids = self[above.encode()] + parts["\n"] + self.encoder.first[below.encode()]
            else:
                ids = self.encoder.library(self.lead + text)
        if len(self) < REMEMBERED and len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class _Parts(dict):
    """Ids of parts that the pattern does not split further: the library's model alone merges them."""

    def __init__(self, encoder: Encoder):
        super().__init__({"": b""})
        self.tokenize, self.dtype = encoder.tokenizer.model.tokenize, encoder.dtype
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, part: str) -> bytes:
        found = self.tokenize(part.encode().decode("latin-1").translate(self.letters))
        ids = array(self.dtype.char, map(ID, found)).tobytes()
        if len(self) < REMEMBERED and len(part) <= LONGEST:
            self[part] = ids
        return ids


class Encoder:
    """Encodes UTF-8 bytes, with the ids that the library gives for the whole text.

    A byte-level BPE splits a text by a pattern before it merges, and where a single space stands between two
    characters that are no white space the pattern always starts a new part at the space. So a text is cut at such
    spaces and each distinct piece is encoded once; letters with marks after them make two parts of the pattern, and a
    single line feed between two characters that are no white space is a part of its own. Texts with other spaces, or
    with a special token's string, are encoded whole."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "u4")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = _Parts(self)
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, text: bytes) -> np.ndarray:
        if not any(s in text for s in self.special):
            head, *rest = text.split(b" ")
            try:
                return np.frombuffer(self.first[head] + b"".join(map(self.later.__getitem__, rest)), self.dtype)
            except _Whole:
                pass
        return np.frombuffer(self.library(text.decode("utf-8")), self.dtype)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
