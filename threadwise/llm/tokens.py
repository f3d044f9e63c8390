"""Ids of whole texts by the tokenizers library, for tokenizers that drop white space.

The word_bpe vocabulary never joins anything across white space, so a text's ids are those of its words
in order. Each distinct word is encoded once in a Python worker, which keeps its table from task to task, and
looked up afterwards. Words of printable
ASCII and Latin-1 letters go to the library's BPE model piece by piece; any other word goes
through the library's whole chain of normalizer, splitter and model.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

PIECE_BYTES = 8 << 20
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# The splitter of the vocabulary, for lower-case words of the characters above.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """``max_words`` and ``max_pieces`` bound the memory of a worker. A full table is begun anew with the words
    met most often; tables change no result."""

    def __init__(self, path: str, max_words: int = 600_000, max_pieces: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.max_words, self.max_pieces = max_words, max_pieces
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._begin()

    def _begin(self) -> None:
        self.at: dict[bytes, int] = {}
        self.flat = np.empty(1 << 20, dtype=np.uint32)
        self.ends = np.zeros(1 << 18, dtype=np.int64)  # of word i: ends[i + 1]
        self.met = np.zeros(0, dtype=np.int64)  # how often word i has been met

    def _renew(self) -> None:
        """Begin anew with at most half a table: the words met most often, and more than once."""
        n, met, words, flat, ends = len(self.at), self.met, list(self.at), self.flat, self.ends
        kept = np.argsort(-met, kind="stable")[: self.max_words // 2]
        kept = kept[met[kept] > 1]
        self._begin()
        size = np.diff(ends[: n + 1])[kept]
        upto = np.concatenate([[0], np.cumsum(size)])
        self.at = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.flat = np.resize(flat[np.repeat(ends[kept] - upto[:-1], size) + np.arange(upto[-1])], max(1 << 20, 2 * int(upto[-1])))
        self.ends = np.concatenate([upto, np.zeros(1 << 18, dtype=np.int64)])
        self.met = met[kept] // 2

    def _spell(self, piece: str) -> tuple[int, ...]:
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return tuple([t.id for t in self.model.tokenize(spelt)])

    def _words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word: pieces are cut for all words first, then each new piece is looked up once."""
        texts = [w.decode("utf-8", "replace") for w in words]
        cuts = list(map(_PIECES.findall, map(str.lower, texts)))
        odd = [i for i, (m, t) in enumerate(zip(map(_PLAIN.fullmatch, texts), texts)) if m is None or "<|" in t]
        for i in odd:
            cuts[i] = []
        pieces, ids = self.pieces, self.tokenizer
        pieces.update((p, self._spell(p)) for p in set(chain.from_iterable(cuts)).difference(pieces))
        found = [pieces[c[0]] if len(c) == 1 else tuple(chain.from_iterable([pieces[p] for p in c])) for c in cuts]
        for i in odd:
            found[i] = tuple(ids.encode(texts[i], add_special_tokens=False).ids)
        return found

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.at)
        found = self._words(words)
        self.at.update(zip(words, range(n, n + len(found))))
        counts, ids = list(map(len, found)), list(chain.from_iterable(found))
        end, more = int(self.ends[n]), n + len(counts) + 1
        if more > len(self.ends):
            self.ends = np.resize(self.ends, 2 * more)
        self.ends[n + 1 : more] = end + np.cumsum(counts, dtype=np.int64)
        if end + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (end + len(ids)))
        self.flat[end : end + len(ids)] = ids

    def _some(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.at) > self.max_words:
            self._renew()
        if len(self.pieces) > self.max_pieces:
            self.pieces = {}
        new = list(set(chain.from_iterable(words)).difference(self.at))
        if new:
            self._learn(new)
        per_text = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n = int(per_text.sum())
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=n)
        met = np.bincount(at, minlength=len(self.at))
        met[: len(self.met)] += self.met
        self.met = met
        start = self.ends[at]
        size = self.ends[at + 1] - start
        upto = np.cumsum(size)
        total = int(upto[-1]) if n else 0
        ids = self.flat[np.repeat(start - (upto - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(bounds)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order as uint32, number of ids of each text)."""
        if sum(map(len, texts)) <= PIECE_BYTES:
            return self._some([t.split() for t in texts])
        ids, counts = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            for part in parts(text, PIECE_BYTES):
                got, _ = self._some([part.split()])
                ids.append(got)
                counts[i] += len(got)
        return np.concatenate(ids), counts


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of this vocabulary, with the words it has met so far; one vocabulary at a time."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def parts(text: bytes, limit: int):
    """Cut a text behind white space into parts of about ``limit`` bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > limit:
        found = re.compile(rb"[ \t-\r]").search(text, at + limit)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]
