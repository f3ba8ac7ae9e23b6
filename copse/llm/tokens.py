"""Token ids of whole texts with a public tokenizer, one distinct word at a time."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import lowered, text_bytes

#: Classes of bytes: white space, ASCII letters, digits, the apostrophe, other ASCII, both bytes of Latin letters beyond
#: ASCII (U+00C0 to U+024F without signs, and without one whose small letter has a mark of its own), others beyond ASCII.
SPACE, LETTER, DIGIT, APOSTROPHE, OTHER, LATIN, WIDE = range(7)
KIND = np.full(256, OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[39] = APOSTROPHE
KIND[128:] = WIDE
LATIN_PAIR = np.zeros((256, 256), bool)
for _c in range(0xC0, 0x250):
    if _c not in (0xD7, 0xF7, 0x130):
        LATIN_PAIR[tuple(chr(_c).encode())] = True
#: Between which neighbours a text may be cut: where the tokenizer's own pattern always cuts. Beyond ASCII a byte alone
#: doesn't tell, and after an apostrophe a letter may belong to it.
CUT = np.zeros((7, 7), bool)
CUT[SPACE, :] = CUT[:, SPACE] = True
CUT[LETTER, [DIGIT, APOSTROPHE, OTHER]] = True
CUT[LATIN, [DIGIT, APOSTROPHE, OTHER]] = True
CUT[DIGIT, [LETTER, DIGIT, APOSTROPHE, OTHER, LATIN]] = True
CUT[OTHER, [LETTER, DIGIT, LATIN]] = True
CUT[APOSTROPHE, [DIGIT, LATIN]] = True
#: Distinct words kept for later batches; beyond that, the table begins anew.
KEPT_WORDS = 250_000


def default_tokenizer() -> str:
    """The path of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts without white space, and where those of each text begin, with the end last."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(offsets), np.int64)
    kind = KIND[data]
    wide = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9))
    wide = wide[LATIN_PAIR[data[wide], data[wide + 1]]]
    kind[wide] = kind[wide + 1] = LATIN
    edge = np.ones(len(data), bool)
    edge[1:] = CUT.reshape(-1)[kind[:-1] * np.uint8(7) + kind[1:]]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    solid = kind != SPACE
    edge &= solid
    begin = np.flatnonzero(edge)
    starts = np.searchsorted(begin, offsets)
    kept = np.cumsum(solid)
    cut = np.append(kept[begin] - 1, kept[-1])
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data[solid])), starts


def byte_letters() -> list[str]:
    """The character that stands for each byte in vocabularies on bytes: itself if it can be printed, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordEncoder:
    """Encodes texts by encoding each distinct piece once.

    For tokenizers that split at white space, drop it, and split words from digits and signs, as this one does, the ids
    of a text are those of its pieces, one after another. Words of Latin letters need no pattern, so they go to the
    tokenizer's model directly; any other piece goes through the whole tokenizer, and so does the whole of a text that
    may hold the name of a special token.
    """

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        self.kept = kept
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.used = 0

    def ids_of(self, piece: str) -> list[int]:
        if piece.isascii():
            if piece.isalpha():
                return [x.id for x in self.model.tokenize(piece)]  # already in lower case
        elif piece.isalpha() and max(piece) < "\u0250" and (small := piece.lower()).isalpha():
            # These letters are one character each in every normal form.
            return [x.id for x in self.model.tokenize(small.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def learn(self, pieces: list[str]) -> None:
        if len(self.slot) + len(pieces) > self.kept:
            self.clear()
        new = [w for w in pieces if w not in self.slot]
        if not new:
            return
        got = [self.ids_of(w) for w in new]
        sizes = np.fromiter(map(len, got), np.int32, len(got))
        k, n = len(self.slot), int(sizes.sum())
        self.slot.update(zip(new, range(k, k + len(new)), strict=True))
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + len(new) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.ids[self.used : self.used + n] = np.fromiter(chain.from_iterable(got), np.uint32, n)
        self.begin[k : k + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + len(new)] = sizes
        self.used += n

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by `end`, and where those of each text begin, with the end last."""
        odd = np.flatnonzero(np.asarray(pc.match_substring(texts, "<|")))
        if len(odd):  # in parts: such texts are encoded whole
            ids, sizes, last = [], [], 0
            for i in odd.tolist():
                for part, whole in ((texts.slice(last, i - last), False), (texts.slice(i, 1), True)):
                    if whole:
                        x = np.array([*self.tokenizer.encode(part[0].as_py(), add_special_tokens=False).ids, end], np.uint32)
                        ids.append(x)
                        sizes.append(np.array([len(x)]))
                    elif len(part):
                        x, starts = self.encode(part, end)
                        ids.append(x)
                        sizes.append(np.diff(starts))
                last = i + 1
            if last < len(texts):
                x, starts = self.encode(texts.slice(last), end)
                ids.append(x)
                sizes.append(np.diff(starts))
            return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
        flat, starts = pieces_of(lowered(texts))
        coded = flat.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(pieces)
        slots = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        # One place after the pieces of each text is for the end.
        n_texts = len(starts) - 1
        ends = starts[1:] + np.arange(n_texts)
        at = np.asarray(coded.indices) if len(flat) else np.zeros(0, np.int32)
        size, first = self.size[slots][at], self.begin[slots][at]
        size, first = np.insert(size, starts[1:], 1), np.insert(first, starts[1:], self.used)
        ids = np.append(self.ids[: self.used], np.uint32(end))
        upto = np.cumsum(size, dtype=np.int64)
        # Positions in a slice and in the table fit 32 bits.
        shift = (first - (upto - size)).astype(np.int32)
        out = ids[np.repeat(shift, size) + np.arange(int(upto[-1]) if len(upto) else 0, dtype=np.int32)]
        return out, np.concatenate([[0], upto[ends]]).astype(np.int64)


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, kept: int = KEPT_WORDS) -> WordEncoder:
    """One for each Python worker, which may run many tasks."""
    if (path, kept) not in _ENCODERS:
        _ENCODERS[path, kept] = WordEncoder(path, kept)
    return _ENCODERS[path, kept]
