"""Tokenizing whole texts with the tokenizers library, word by word.

Both vocabularies here never merge across the space between two words, so a
text's ids are those of its pieces between spaces.  A cache of pieces spares
encoding the same words again, and all new pieces are encoded as one text.
A text with a special token's string, or with a space beside other white
space or at an end, is encoded whole.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

_CACHE_PIECES = 800_000


class _Pieces(dict):
    """Piece -> number; unknown pieces get the next one and are noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


@functools.lru_cache(2)
def cached_encoder(path: str, spaced: bool) -> CachedEncoder:
    """The encoder of this worker: later tasks find its pieces."""
    return CachedEncoder(path, spaced)


class CachedEncoder:
    """``encode`` equals ``Tokenizer.encode(text, add_special_tokens=False)``.

    ``spaced``: ids spell the text's bytes, and a piece carries the space
    before it (byte-level vocabularies); else white space is dropped.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        size = max(vocab.values()) + 1
        if not spaced:
            self.word_end = np.zeros(size, bool)
            self.word_end[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
            self.sign_id = {"": -1} | {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ",."}
        else:
            # one character of a byte-level token stands for one byte
            self.n_bytes = np.zeros(size, np.int64)
            for token, i in vocab.items():
                self.n_bytes[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        self.pieces = _Pieces()
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.odd = np.zeros(1 << 16, bool)
        if not self.spaced:
            self.words = _Pieces()
            self.word_ids = [np.zeros(0, np.uint32)]
            self.word_stop = np.zeros(1, np.int64)

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, and how many each has."""
        if not self.spaced:
            return self._encode_words(pieces)
        # the first of a text has no space before it; the others are one text
        first = [p[1:] for p in pieces if p[:1] == " "]
        counts = np.zeros(len(pieces), np.int64)
        rest = [p for p in pieces if p[:1] != " "]
        done = {}
        for lead, group in (("", first), (" ", rest)):
            if not group:
                done[lead] = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            elif lead:
                ids = self._ids_of(lead + lead.join(group))
                ends = np.cumsum(self.n_bytes[ids])
                want = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in group), np.int64, len(group)))
                at = np.searchsorted(ends, want) + 1
                if len(ends) and (ends[-1] != want[-1] or not np.array_equal(ends[at - 1], want)):
                    raise AssertionError("a token reaches over a space")
                done[lead] = (ids, np.diff(at, prepend=0))
            else:
                got = [e.ids for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                n = np.fromiter(map(len, got), np.int64, len(got))
                done[lead] = (np.fromiter((i for x in got for i in x), np.uint32, int(n.sum())), n)
        is_first = np.fromiter((p[:1] == " " for p in pieces), bool, len(pieces))
        counts[is_first], counts[~is_first] = done[""][1], done[" "][1]
        which = np.repeat(is_first, counts)
        out = np.zeros(int(counts.sum()), np.uint32)
        out[which], out[~which] = done[""][0], done[" "][0]
        return out, counts

    def _ids_of(self, text: str) -> np.ndarray:
        # the batch call keeps no offsets, which takes a third of the time
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`_encode_new` without spaces: a piece of Latin-1 letters, and
        one sign after it, is its word in lower case and the sign."""
        word: list[int] = []
        sign: list[str] = []
        other: list[str] = []
        number = self.words.__getitem__
        for p in pieces:
            tail = p[-1] if p[-1] in ",." else ""
            w = p[:-1] if tail else p
            if w.isalpha() and max(w) <= "\xff":
                word.append(number(w.lower()))
                sign.append(tail)
            else:
                word.append(-1)
                sign.append("")
                other.append(p)
        if self.words.new:
            ids = self._ids_of(" ".join(self.words.new))
            stop = np.flatnonzero(self.word_end[ids]) + 1
            if len(stop) != len(self.words.new) or stop[-1] != len(ids):
                raise AssertionError("a word has more than one end")
            self.word_ids.append(ids)
            self.word_stop = np.concatenate([self.word_stop, self.word_stop[-1] + stop])
            self.words.new = []
        if len(self.word_ids) > 1:
            self.word_ids = [np.concatenate(self.word_ids)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        w = np.array(word, np.int64)
        is_word, signs = w >= 0, np.array([self.sign_id[x] for x in sign], np.int64)
        counts = np.zeros(len(pieces), np.int64)
        counts[~is_word] = np.fromiter(map(len, got), np.int64, len(got))
        start = self.word_stop[w[is_word]]
        bare = self.word_stop[w[is_word] + 1] - start
        counts[is_word] = bare + (signs[is_word] >= 0)
        out = np.zeros(int(counts.sum()), np.uint32)
        ends = np.cumsum(counts)
        at = (ends - counts)[is_word]
        step = np.arange(int(bare.sum())) - np.repeat(np.cumsum(bare) - bare, bare)
        out[np.repeat(at, bare) + step] = self.word_ids[0][np.repeat(start, bare) + step]
        out[ends[signs >= 0] - 1] = signs[signs >= 0]
        out[np.repeat(~is_word, counts)] = np.fromiter((i for x in got for i in x), np.uint32)
        return out, counts

    def _learn(self, pieces: list[str], known: int) -> None:
        # a piece with white space at an end doesn't stand alone
        odd = np.fromiter((not p or p != p.strip() for p in (x[1:] if x[:1] == " " else x for x in pieces)), bool, len(pieces))
        plain = pieces if not odd.any() else [p for p, o in zip(pieces, odd.tolist(), strict=True) if not o]
        ids, n_plain = self._encode_new(plain)
        n = np.zeros(len(pieces), np.int64)
        n[~odd] = n_plain
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while known + len(pieces) > len(self.start):
            self.start, self.length, self.odd = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length, self.odd))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[known : known + len(pieces)] = self.used + np.cumsum(n) - n
        self.length[known : known + len(pieces)] = n
        self.odd[known : known + len(pieces)] = odd
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if len(self.pieces) > _CACHE_PIECES:
            self._reset()
        known = len(self.pieces)
        numbers: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        whole = np.zeros(len(texts), bool)
        get = self.pieces.__getitem__
        for i, t in enumerate(texts):
            if not t:
                continue
            if "<|" in t:
                whole[i] = True
                continue
            if self.spaced:
                words = t.split(" ")
                words[0] = " " + words[0]  # the mark of a text's first piece
            else:
                words = t.split()
            numbers += map(get, words)
            counts[i] = len(words)
        if self.pieces.new:
            self._learn(self.pieces.new, known)
            self.pieces.new = []
        p = np.array(numbers, np.int64)
        n = self.length[p]
        at = np.concatenate([[0], np.cumsum(counts)])
        odd = np.concatenate([[0], np.cumsum(self.odd[p])])
        whole |= odd[at[1:]] > odd[at[:-1]]
        if whole.any():
            n[np.repeat(whole, counts)] = 0
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[p] - (ends - n), n) + np.arange(int(n.sum()))]
        edge = np.concatenate([[0], ends])
        lengths = edge[at[1:]] - edge[at[:-1]]
        if not whole.any():
            return ids, lengths
        which = np.flatnonzero(whole).tolist()
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        got = self.tokenizer.encode_batch([texts[i] for i in which], add_special_tokens=False)
        parts, last = [], 0
        for i, e in zip(which, got, strict=True):
            parts += [ids[bounds[last] : bounds[i]], np.array(e.ids, np.uint32)]
            lengths[i] = len(e.ids)
            last = i
        parts.append(ids[bounds[last] :])
        return np.concatenate(parts), lengths
