"""Byte-level BPE token ids with the tokenizers library, a word at a time.

The tokenizer splits a text into words before any merge, and encodes each word by itself.
So a word's ids are computed once per worker and kept; texts with characters for which the
splitting pattern here might differ from the library's are given to the library whole.

Most texts have no apostrophes and single blanks or line ends only.  Their words are runs of
letters, digits or other characters, each with the blank before it: they are found in the
bytes of many texts at once, told apart by their bytes as numbers, and looked up in sorted arrays.
Other texts are split by the pattern.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from pairwright.llm.common import KEPT

LATIN = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMERIC = "0-9²³¹¼-¾"
#: The byte-level splitting pattern over the characters that PLAIN admits.
WORDS = re.compile(rf" ?[{LATIN}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMERIC}]+| ?[^\s{LATIN}{NUMERIC}]+|\s+(?!\S)|\s+")
#: A character or a special token's start for which the library gets the whole text.
NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ſ]|<\|")
#: Where one of these is in a text, it is split by the pattern.
LOOSE = ("'", "  ", "\n\n", " \n", "\n ", "\t", "\r", "\0")
#: Words of each of the two generations that a worker remembers as strings, and words that it remembers as
#: numbers (a speed matter only).  When the young generation is full it becomes the old one, from which
#: words still in use are taken over; numbers start anew.
KEEP_WORDS, KEEP_NUMBERS = 100_000, 1_000_000
#: Bytes of a word that are compared as numbers; longer words are looked up as strings.
SHORT = 24
#: Classes of bytes: letter, digit, other, blank, line end, end of a text; 0: the second byte of a character.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = 1
_CLASS[48:58] = 2
_CLASS[32], _CLASS[10], _CLASS[0] = 4, 5, 6
_CLASS[0x80:0xC0] = 0
#: Classes of the characters whose first byte is 0xC2, by the second one.
_SECOND = np.full(256, 3, np.uint8)
_SECOND[[0xAA, 0xB5, 0xBA]] = 1
_SECOND[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

_LOADED: dict[str, "WordEncoder"] = {}


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def is_plain(text: str) -> bool:
    """Whether the pattern here splits the text as the library does; ASCII texts are told quickly."""
    if text.isascii() and text.replace("\n", " ").isprintable():
        return "<|" not in text
    return not NOT_PLAIN.search(text)


def is_tight(text: str) -> bool:
    """Whether a plain text has no apostrophes, and single blanks and line ends inside only."""
    return text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in LOOSE)


def word_starts(data: np.ndarray) -> np.ndarray:
    """Where words of tight texts begin; texts are ended by NUL, which is a word of its own."""
    kind = _CLASS[data]
    second = np.flatnonzero(kind == 0)
    if len(second):
        lead = second - 1
        kind[lead] = np.where(data[lead] == 0xC2, _SECOND[data[second]], np.where((data[lead] == 0xC3) & ((data[second] == 0x97) | (data[second] == 0xB7)), 3, kind[lead]))
        kind[second] = kind[lead]
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] >= 4) | ((kind[1:] != kind[:-1]) & (kind[:-1] != 4))
    return np.flatnonzero(new)


class WordTable:
    """Words of up to SHORT bytes by their bytes as three numbers, and the ids of all words one after the other."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.hashes = np.empty(0, np.uint64)  # ascending
        self.place = np.empty(0, np.int64)  # of each hash: its row below
        self.size = self.used = 0
        self.keys = np.empty((3, 1024), np.uint64)
        self.first, self.count = np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.ids = np.empty(4096, np.uint32)
        self.long: dict[bytes, int] = {}

    def _room(self, rows: int, ids: int) -> None:
        if self.size + rows > len(self.first):
            n = 2 * (self.size + rows)
            self.keys = np.concatenate((self.keys[:, : self.size], np.empty((3, n - self.size), np.uint64)), axis=1)
            self.first, self.count = (np.concatenate((x[: self.size], np.empty(n - self.size, np.int64))) for x in (self.first, self.count))
        if self.used + ids > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.empty(self.used + 2 * ids, np.uint32)))

    def add(self, words: list[bytes], keys: np.ndarray | None, hashes: np.ndarray | None) -> np.ndarray:
        """Rows of new words, given their ids (four bytes each) and, of short ones, numbers and hashes."""
        ids = np.frombuffer(b"".join(words), np.uint32)
        self._room(len(words), len(ids))
        count = np.array([len(w) // 4 for w in words], np.int64)
        rows = np.arange(self.size, self.size + len(words))
        self.count[rows], self.first[rows] = count, self.used + np.cumsum(count) - count
        self.ids[self.used : self.used + len(ids)] = ids
        self.size, self.used = self.size + len(words), self.used + len(ids)
        if keys is not None:
            self.keys[:, rows] = keys
            at = np.searchsorted(self.hashes, hashes)
            self.hashes, self.place = np.insert(self.hashes, at, hashes), np.insert(self.place, at, rows)
        return rows

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of hashes (ascending), -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.hashes, hashes).clip(max=len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.place[at], -1)


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.table = WordTable()

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in out]

    def _ids(self, word: str) -> bytes:
        # a word has white space at its start only, or is nothing else: byte letters spell ASCII ones as they are
        if word.isascii() and word[-1] > " ":
            spelled = "Ġ" + word[1:] if word[0] == " " else word
        else:
            spelled = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _learn(self, parts: list[str]) -> None:
        """Bring the ids of all these words into the young generation."""
        new = set(parts).difference(self.words)
        if len(self.words) + len(new) > KEEP_WORDS:
            self.old, self.words, new = self.words, {}, set(parts)
        words, old = self.words, self.old
        for w in new:
            ids = old.get(w)
            words[w] = self._ids(w) if ids is None else ids

    def _tight(self, texts: list[str]) -> list[bytes] | None:
        """The ids of tight texts, all at once; None if two words had one hash, which is told by their bytes."""
        joint = "\0".join([*texts, ""]).encode()
        data = np.frombuffer(joint, np.uint8)
        start = word_starts(data)
        length = np.diff(start, append=len(data))
        # eight bytes from every place, past the end zeros
        eight = np.ndarray((len(data) + 16,), "<u8", joint + bytes(24), strides=(1,))
        row = np.empty(len(start), np.int64)
        short = np.flatnonzero(length <= SHORT)
        at, size = start[short], length[short]
        keys = np.array([eight[at + 8 * i] & _MASKS[(size - 8 * i).clip(0, 8)] for i in range(3)])
        mixed = keys[0] * _MIX[0] ^ (keys[1] + np.uint64(1)) * _MIX[1] ^ (keys[2] + np.uint64(1)) * _MIX[2]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[0]
        hashes, sample, which = np.unique(mixed ^ (mixed >> np.uint64(32)), return_index=True, return_inverse=True)
        mine = keys[:, sample]
        if (mine[:, which] != keys).any():
            return None
        if self.table.size + len(hashes) > KEEP_NUMBERS:
            self.table.clear()
        rows = self.table.find(hashes)
        known = rows >= 0
        if (self.table.keys[:, rows[known]] != mine[:, known]).any():
            return None
        new = np.flatnonzero(~known)
        if len(new):
            places = zip(at[sample[new]].tolist(), size[sample[new]].tolist(), strict=True)
            ids = [self._ids(w) if (w := joint[a : a + n].decode()) != "\0" else b"" for a, n in places]
            rows[new] = self.table.add(ids, mine[:, new], hashes[new])
        row[short] = rows[which]
        others = np.flatnonzero(length > SHORT)
        if len(others):
            long = [joint[a : a + n] for a, n in zip(start[others].tolist(), length[others].tolist(), strict=True)]
            fresh = list(set(long).difference(self.table.long))
            self.table.long |= zip(fresh, self.table.add([self._ids(w.decode()) for w in fresh], None, None).tolist(), strict=True)
            row[others] = [self.table.long[w] for w in long]
        count = self.table.count[row]
        ends = np.cumsum(count)
        flat = self.table.ids[np.repeat(self.table.first[row] - ends + count, count) + np.arange(ends[-1])]
        stops = 4 * ends[data[start] == 0]
        out, first = flat.tobytes(), 0
        found = []
        for stop in stops.tolist():
            found.append(out[first:stop])
            first = stop
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        found: list[bytes] = [b""] * len(texts)
        odd, tight, other = [], [], []
        for i, text in enumerate(texts):
            if text:
                (odd if not is_plain(text) else tight if is_tight(text) else other).append(i)
        for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
            found[i] = ids
        if tight:
            done = self._tight([texts[i] for i in tight])
            if done is None:
                other += tight
            else:
                for i, ids in zip(tight, done, strict=True):
                    found[i] = ids
        for i in other:
            parts = WORDS.findall(texts[i])
            try:
                found[i] = b"".join(map(self.words.__getitem__, parts))
            except KeyError:
                self._learn(parts)
                found[i] = b"".join(map(self.words.__getitem__, parts))
        return found


def _free() -> bool:
    some = bool(_LOADED)
    _LOADED.clear()
    return some


KEPT["tokens"] = _free


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
