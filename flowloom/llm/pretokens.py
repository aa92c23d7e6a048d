"""Pre-tokens of byte-level tokenizers for whole Arrow batches, and their pieces.

The split is the one of the tokenizer's own pattern (contractions; an optional space before letters, digits or other
signs; white space up to the last one before a word), found from runs of character classes instead of a regular
expression per text. Added special tokens inside a text stand alone, as the library does by default.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pandas as pd

from .words import U, mix, powers

_STEP = U(0xA0761D6478BD642F)
# fixed values of the pattern
_SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, DIGIT, WHITE = range(4)
_TRIED = 1024  # unknown code points tried at once
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that a byte-level model writes as their own sign
_SIGNS = np.zeros(256, np.uint32)  # the others get the signs from 256 on
_SIGNS[_SHOWN] = _SHOWN
_SIGNS[_SIGNS == 0] = np.arange(256, 512 - len(_SHOWN))


class Pieces:
    """A tokenizer file; ``encode`` takes pre-tokens and returns their ids and how many each has."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.classes = self._class_table()
        own = self.tokenizer.pre_tokenizer
        #: the model takes a pre-token's bytes as they are
        self.bare = self.tokenizer.normalizer is None and type(own).__name__ == "ByteLevel" and not own.add_prefix_space

    def _class_table(self) -> np.ndarray:
        """Letter, digit, white space or other for each code point; unknown ones are tried on the library's own split.

        A block of unknown ones that stays one piece beside a letter and beside a digit is of the class other; the code
        points of a block that doesn't are tried one by one. So the library never splits a long text here.
        """
        first = {"L": LETTER, "N": DIGIT}
        names = [unicodedata.category(chr(c)) for c in range(0x110000)]
        table = np.fromiter((first.get(x[0], OTHER) for x in names), np.uint8, len(names))
        table[_WHITE] = WHITE
        unsure = [c for c in range(0x40000) if names[c] == "Cn"]
        pieces_of = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for at in range(0, len(unsure), _TRIED):
            block = unsure[at:at + _TRIED]
            run = "".join(map(chr, block))
            if all([span for _, span in pieces_of(x + run)] == [(0, 1), (1, 1 + len(run))] for x in "a1"):
                table[block] = OTHER
                continue
            begins = {a for _, (a, _) in pieces_of("".join(f"a{chr(c)}\n1{chr(c)}\n" for c in block))}
            for i, c in enumerate(block):
                table[c] = LETTER if 6 * i + 1 not in begins else DIGIT if 6 * i + 4 not in begins else OTHER
        return table

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        fixed = [i for i, w in enumerate(words) if w in self.special]
        if fixed:
            ids, size = self.encode([w for w in words if w not in self.special])
            at = np.array(fixed) - np.arange(len(fixed))
            edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
            return np.insert(ids, edge[at], [self.special[words[i]] for i in fixed]), np.insert(size, at, 1)
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.bare:  # the library's model alone: no search for pre-tokens in what is one, no offsets
            tokenize, ids, size = self.tokenizer.model.tokenize, [], []
            for word in _signs(words):
                found = tokenize(word)
                size.append(len(found))
                ids += [t.id for t in found]
            return np.array(ids, np.uint32), np.array(size, np.int64)
        found = self.tokenizer.encode_batch([words], is_pretokenized=True, add_special_tokens=False)[0]
        return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))


def _signs(words: list[str]) -> list[str]:
    """Pre-tokens as a byte-level model reads them: a sign for each byte."""
    data = np.frombuffer("".join(words).encode("utf-8"), np.uint8)
    begin = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    edge = begin[np.cumsum([0, *map(len, words)])].tolist()
    text = _SIGNS[data].astype("<u4").tobytes().decode("utf-32-le")
    return [text[a:z] for a, z in zip(edge, edge[1:])]


_open: dict[str, Pieces] = {}  # by path


def pieces(path: str) -> Pieces:
    """One loaded tokenizer for each worker process."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def split(data: np.ndarray, bounds: np.ndarray, tool: Pieces) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The decoded texts, start, end and hash of each pre-token, and the first pre-token of each text (and the total).

    ``bounds`` are byte offsets of the texts; starts and ends count code points of all texts together.
    """
    text = data.tobytes().decode("utf-8")
    lead = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    at = lead[bounds]
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(cp)
    if n == 0:
        none = np.zeros(0, np.int64)
        return text, none, none, np.zeros(0, U), np.zeros(len(bounds), np.int64)
    cuts, inside = at[:-1], np.zeros(0, np.int64)
    for mark in tool.special:
        where, place = [], text.find(mark)
        while place >= 0:
            if np.searchsorted(at, place, "right") == np.searchsorted(at, place + len(mark), "left"):
                where.append(place)
                place = text.find(mark, place + len(mark))
            else:
                place = text.find(mark, place + 1)
        if where:
            where = np.array(where)
            cuts = np.concatenate([cuts, where, where + len(mark)])
            inside = np.concatenate([inside, (where[:, None] + np.arange(1, len(mark))).ravel()])
    cut = np.zeros(n + 1, bool)
    cut[cuts] = True
    cut[n] = True
    cls = tool.classes[cp]
    run = cut[:-1].copy()
    run[1:] |= cls[1:] != cls[:-1]
    s = np.flatnonzero(run)
    e = np.append(s[1:], n)
    kind = cls[s]
    start = run.copy()
    word = kind != WHITE
    glued = word & (s > 0) & ~cut[s] & (cp[np.maximum(s - 1, 0)] == 0x20)
    start[s[glued]] = False
    start[s[glued] - 1] = True
    blank = ~word & ~cut[e]  # a word follows in the same text
    start[e[blank] - 1] = True
    tick = np.flatnonzero((kind == OTHER) & (e - s == 1) & (cp[s] == 0x27) & ~glued & ~cut[e])
    tick = tick[kind[np.minimum(tick + 1, len(kind) - 1)] == LETTER]
    left = np.ones(len(tick), bool)
    for suffix in _SUFFIXES:
        fits = left & (e[tick + 1] - s[tick + 1] >= len(suffix)) if len(tick) else left
        for i, c in enumerate(suffix):
            fits = fits & (cp[np.minimum(s[tick] + 1 + i, n - 1)] == ord(c))
        hit = tick[fits]
        start[s[hit] + 1] = False
        after = s[hit] + 1 + len(suffix)
        start[after[after < e[hit + 1]]] = True
        left &= ~fits
    start[inside] = False
    st = np.flatnonzero(start)
    en = np.append(st[1:], n)
    up, down = powers(_STEP, n + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(cp.astype(U)) * up[:-1], dtype=U)])
    return text, st, en, mix((total[en] - total[st]) * down[st] + (en - st).astype(U)), np.searchsorted(st, at)


class Ids:
    """Token ids of whole texts, each distinct pre-token encoded once while it stays in a bounded cache."""

    def __init__(self, path: str, most: int = 500_000):
        self.tool, self.most = pieces(path), most
        self._reset()

    def _reset(self):
        self.known: dict[int, int] = {}
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the first id of each text (and the total)."""
        text, st, en, h, first = split(data, bounds, self.tool)
        back, u = pd.factorize(h)  # in the order of their first places
        at = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1))
        if len(self.known) > self.most:
            self._reset()
        known = self.known
        entry = np.array([known.get(x, -1) for x in u.tolist()], np.int64)
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            where = at[fresh]
            ids, size = self.tool.encode([text[a:b] for a, b in zip(st[where].tolist(), en[where].tolist())])
            entry[fresh] = len(self.begin) + np.arange(len(fresh))
            known.update(zip(u[fresh].tolist(), entry[fresh].tolist()))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
        entry = entry[back]
        size = self.size[entry]
        edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        place = np.arange(edge[-1]) + np.repeat(self.begin[entry] - edge[:-1], size)
        return self.ids[place], edge[first]


_kept: dict[str, Ids] = {}  # by path


def kept_ids(path: str) -> Ids:
    """One bounded cache of ids for each worker process, which goes on with the next task."""
    if path not in _kept:
        _kept[path] = Ids(path)
    return _kept[path]
