"""Byte-level BPE with word ends, from a public tokenizer file: shared parts of operators 6 and 8.

The vocabulary file is read where the code runs; its path is a parameter.
"""

from __future__ import annotations

import functools
import gc
import json
import re
from collections import defaultdict

import numpy as np

NONE = np.iinfo(np.int32).max
#: White space of the tokenizer's \\s; str.split also cuts at 1C to 1F.
NOT_SPACE = "[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"

BEYOND_LATIN = re.compile("[^\x00-\u02ff\u2010-\u2027\u2030-\u205e\u20a0-\u20b9]").search
CONTROLS = re.compile("[\x1c-\x1f]").search


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges, byte symbols and special strings of one tokenizer file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._table(keys)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.name = [""] * (max([self.size - 1, *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.name[i] = token
        self.number = [str(i) for i in range(len(self.name))]
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces_and_breaks = regex.compile(split["pattern"]["Regex"].replace("\\s", NOT_SPACE[2:-2]) + "|\n").findall
        self.words = regex.compile(NOT_SPACE).findall
        letter_byte = self.letter_byte = {c: b for b, c in enumerate(letters)}
        self.inside = np.zeros((256, 256), bool)
        for token in vocab:
            own = [letter_byte[c] for c in token.removesuffix(self.suffix)] if self.suffix else [letter_byte[c] for c in token]
            self.inside[own[:-1], own[1:]] = True

    def _table(self, keys: np.ndarray) -> None:
        """A hash table of the merge pairs: slots of four, so that one lookup is four compares at most."""
        self.bits, rank = 17, np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        place = np.arange(len(keys)) - np.searchsorted(slot[order], slot[order])
        self.depth = int(place.max()) + 1
        self.keys = np.full((self.depth, 1 << self.bits), -1, np.int64)
        self.ranks = np.full((self.depth, 1 << self.bits), NONE, np.int32)
        self.keys[place, slot[order]] = keys[order]
        self.ranks[place, slot[order]] = rank[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.size + b
        slot, out = self._slot(keys), np.full(len(keys), NONE, np.int32)
        for keys_at, ranks_at in zip(self.keys, self.ranks, strict=True):
            np.copyto(out, ranks_at[slot], where=keys_at[slot] == keys)
        return out

    def lower(self, word: str) -> str:
        """Each letter on its own: no final form of sigma."""
        return "".join(c.lower() for c in word) if "Σ" in word else word.lower()

    def segments(self, text: str) -> list[str | int]:
        """The text between special strings, and the ids of those."""
        if not any(s in text for s in self.special):
            return [text]
        return [self.special.get(x, x) for x in self.splitter.split(text) if x]

    def split_words(self, text: str) -> list[str]:
        """Words between white space; no piece of the pre-tokenizer crosses that.

        Text beyond the Latin letters is normalised by the tokenizer library, whose Unicode tables
        differ from Python's by version; Latin text is in normal form as it stands.
        """
        if not text.isascii() and BEYOND_LATIN(text):
            return self.library.normalizer.normalize_str(text).split(" ")
        return self.words(text) if CONTROLS(text) else text.split()

    def pre_tokens(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all words, one after another, and how many each word has.

        One pass over the words joined by newlines; a word beyond the Latin letters is the library's to cut.
        """
        plain = [w if w.isascii() or not BEYOND_LATIN(w) else "" for w in words]
        joined = "\n".join(plain)
        found = self.pieces_and_breaks(self.lower(joined))
        breaks = np.fromiter((i for i, x in enumerate(found) if x == "\n"), np.int64, len(words) - 1)
        sizes = np.diff(np.r_[-1, breaks, len(found)]) - 1
        if "" not in plain:
            return [x for x in found if x != "\n"], sizes
        out, at, sizes = [], 0, sizes.tolist()
        for i, word in enumerate(words):
            if plain[i] or not word:
                own = found[at : at + sizes[i]]
            else:
                own = [bytes(map(self.letter_byte.__getitem__, x)).decode() for x, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]
            at += sizes[i] + 1
            sizes[i] = len(own)
            out += own
        return out, np.array(sizes, np.int64)

    def symbols(self, parts: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts as one array of byte symbols, and their lengths; ends: parts that end their word."""
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer(b"".join(parts), np.uint8)
        sym, stop = self.inner[raw], (np.cumsum(lens) - 1)[ends]
        sym[stop] = self.last[raw[stop]]
        return sym, lens


def numbered(items: list) -> tuple[list, np.ndarray]:
    """The distinct items in order of appearance, and the number of each item."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    at = np.fromiter(map(ids.__getitem__, items), np.int64, len(items))
    return list(ids), at


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    gc.set_threshold(200_000)  # the word caches hold many objects and no cycles
    return Vocabulary(path)


def merge_ranks(vocab: Vocabulary, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BPE of many sequences at once; each round merges, in every sequence, all pairs of its lowest rank.

    sym holds the sequences one after another, lens (all over 0) their lengths. Returns the surviving
    symbols, in the same order, and their numbers. A pair that overlaps itself is merged from the left.
    Sequences without a pair left leave the working arrays.
    """
    n = len(lens)
    out_lens, done = np.zeros(n, np.int64), []
    who = np.arange(n)
    lens = lens.astype(np.int64)
    rank = np.full(len(sym), NONE, np.int32)
    if len(sym) > 1:
        rank[:-1] = vocab.rank_of(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NONE
    while len(who):
        starts = np.cumsum(lens) - lens
        least = np.minimum.reduceat(rank, starts)
        live = least != NONE
        if not live.all():
            gone = np.repeat(~live, lens)
            out_lens[who[~live]] = lens[~live]
            done.append((who[~live], lens[~live], sym[gone]))
            sym, rank = sym[~gone], rank[~gone]
            who, lens, least = who[live], lens[live], least[live]
            if not len(who):
                break
        at = np.flatnonzero(rank == np.repeat(least, lens))
        if len(at) > 1 and (np.diff(at) == 1).any():
            first = np.r_[True, np.diff(at) != 1]
            run = np.cumsum(first) - 1
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[run]) % 2 == 0]
        owner = np.repeat(np.arange(len(who)), lens)
        sym[at] = vocab.made[rank[at]]
        rank[at] = rank[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new_at = at - np.arange(len(at))
        lens = lens - np.bincount(owner[at], minlength=len(who))
        sym, rank = sym[keep], rank[keep]
        starts = np.cumsum(lens) - lens
        is_start, is_stop = np.zeros(len(sym), bool), np.zeros(len(sym), bool)
        is_start[starts], is_stop[starts + lens - 1] = True, True
        left = new_at[~is_start[new_at]] - 1
        right = new_at[~is_stop[new_at]]
        rank[new_at[is_stop[new_at]]] = NONE
        redo = np.concatenate([left, right])
        if len(redo):
            rank[redo] = vocab.rank_of(sym[redo], sym[redo + 1])
    if not done:
        return sym[:0], out_lens
    owner = np.concatenate([np.repeat(w, k) for w, k, _ in done])
    flat = np.concatenate([s for _, _, s in done])
    return flat[np.argsort(owner, kind="stable")], out_lens
