"""Dictionary coding of text for byte-level tokenizers: each distinct piece is tokenized once.

Texts are cut where one space stands between two characters that are no white space. The
split pattern of byte-level BPE always has a boundary there and never looks across it, so a
piece (with its leading space) has the same ids wherever it stands. For ``PATTERN`` itself texts are
also cut around white space and where letters, digits and marks meet, see ``word_cuts``: nearly every
piece is one word of the pattern then, with its marks apart. Texts with white space beyond ASCII are
cut into the words of the pattern itself.

Pieces of a whole batch are hashed at once to 128 bits and looked up in a table of open addresses;
only what a worker has not met goes through the tokenizer, and through the pattern unless its bytes
tell that it is one word.
"""

import re

import numpy as np
import regex

#: The split pattern of byte-level BPE as the vocabulary files use it (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = 1 << 19  # distinct pieces that one worker remembers
BYTES = 1_000_000  # text that is coded together, on average
BLOCK = 1 << 18  # bytes that are hashed together
LONG = 512  # bytes of a piece that is not remembered

_random = np.random.default_rng(7)
_LETTERS = _random.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _random.integers(0, 1 << 61, 2, np.uint64) * np.uint64(8) + np.uint64(5)
_POWERS = [np.cumprod(np.full(LONG + 1, s)) for s in _STEPS]
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of eight

#: White space that a cut between bytes cannot see, and characters that only some tables call white space.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII characters that are no letter, digit, space or apostrophe

_LETTER, _DIGIT, _MARK, _BLANK = 1, 2, 3, 4
_KINDS = np.zeros(256, np.uint8)  # by byte; 0: controls, and bytes of characters beyond ASCII
_KINDS[[b for b in range(33, 127)]] = [_LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK for b in range(33, 127)]
_KINDS[[32, *range(9, 14)]] = _BLANK


def word_cuts(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of ``PATTERN`` begin for certain, and bytes whose piece may hold several words.

    ``first`` are the starts of texts, none of them empty. A word never goes on from letters to digits or marks
    or between any two of these, but for an apostrophe and what follows (``'s``); it never goes
    on from another character to white space; of several white characters before another one,
    the last stands apart, with the word behind if it is a space. Latin-1 letters count as letters.
    """
    kind = _KINDS[data]
    pairs = np.flatnonzero(data == 0xC3)
    pairs = pairs[(data[pairs + 1] & 0xDF) != 0x97]  # all but the signs of multiplication and division
    kind[pairs] = kind[pairs + 1] = _LETTER
    inner = (kind - np.uint8(1)) < 3
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & inner[1:] & inner[:-1]
    apostrophe = data == 39
    cut[1:] &= ~apostrophe[:-1]
    cut[first] = True
    blank = kind == _BLANK
    cut[1:] |= blank[1:] & ~blank[:-1]
    is_first = np.zeros(len(data), bool)
    is_first[first] = True
    after = np.flatnonzero(blank[:-1] & ~blank[1:] & ~is_first[1:]) + 1
    cut[after - 1] = True
    cut[after[data[after - 1] != 32]] = True
    return cut, (kind == 0) | apostrophe


def hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each piece: its bytes and its size, mixed, up to 16 bytes, sums over all bytes
    beyond. Pieces over ``LONG`` bytes are told by their beginning only."""
    eight = np.ndarray(len(data) + 9, "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
    low = eight[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]
    high = eight[starts + 8] & _FIRST_BYTES[np.clip(sizes - 8, 0, 8)]
    low += high * _STEPS[0]
    low ^= low >> np.uint64(32)
    low *= np.uint64(0x9E3779B97F4A7C15)
    low ^= low >> np.uint64(29)
    low *= _STEPS[1]
    high ^= sizes.astype(np.uint64) * _LETTERS[0, 0]
    more = np.flatnonzero((sizes > 16) & (sizes <= LONG))
    if len(more):
        own = sizes[more]
        ends = np.cumsum(own)
        at = np.repeat(starts[more] - (ends - own), own)
        at += np.arange(len(at))
        low[more], high[more] = _summed(data[at], ends - own, own)
    return low, high


def _summed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each piece of up to ``LONG`` bytes; pieces lie one behind the other in ``data``."""
    out = np.empty((2, len(starts)), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        first, last = int(starts[at]), int(starts[to - 1] + sizes[to - 1])
        letters, own = data[first:last], starts[at:to] - first
        inside = np.arange(last - first, dtype=np.int32) - np.repeat(own.astype(np.int32), sizes[at:to])
        for i in (0, 1):
            out[i, at:to] = np.add.reduceat(_LETTERS[i][letters] * _POWERS[i][inside], own)
        at = to
    out[0] ^= out[0] >> np.uint64(31)
    return out[0] * np.uint64(0x9E3779B97F4A7C15), out[1] ^ sizes.astype(np.uint64)


class Table:
    """Numbers of arrays of ids by 128-bit keys, and the arrays in a row."""

    def __init__(self, limit: int, dtype):
        self.bits = max(4, (2 * limit - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.marks = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.full(1 << self.bits, -1, np.int32)
        self.first, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, dtype)
        self.n = self.used = 0

    def _slots(self, keys):
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 for none."""
        slot = self._slots(keys)
        entry = self.entry[slot]
        wrong = (entry >= 0) & ((self.keys[slot] != keys) | (self.marks[slot] != marks))
        open_ = np.flatnonzero(wrong)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.entry) - 1)
            here = slot[open_]
            found = self.entry[here]
            entry[open_] = found
            open_ = open_[(found >= 0) & ((self.keys[here] != keys[open_]) | (self.marks[here] != marks[open_]))]
        return entry

    def add(self, keys: np.ndarray, marks: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """New entries for keys that are distinct and not there yet."""
        n, used = self.n + len(keys), self.used + len(ids)
        while n > len(self.first):
            self.first, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.sizes))
        while used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        entries = np.arange(self.n, n, dtype=np.int32)
        self.first[self.n : n], self.sizes[self.n : n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : used] = ids
        self.n, self.used = n, used
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):  # the first of those that want a free slot gets it, all others go on
            here = slot[left]
            _, first = np.unique(here, return_index=True)
            first = first[self.entry[here[first]] < 0]
            won = left[first]
            self.keys[slot[won]], self.marks[slot[won]], self.entry[slot[won]] = keys[won], marks[won], entries[won]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left = left[rest]
            slot[left] = (slot[left] + 1) & (len(self.entry) - 1)
        return entries

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries in a row, and how many each has."""
        sizes = self.sizes[entries].astype(np.int64)
        at = np.repeat(self.first[entries] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.ids[at], sizes


def _distinct(keys, marks):
    """Positions of the first of each (key, mark), and for each position which of them it is."""
    order = np.lexsort((marks, keys))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (marks[order][1:] != marks[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


class PieceCoder:
    """``encode(texts)`` gives the ids of each text as bytes of ``dtype``.

    ``pattern`` splits text into words, ``encode_words(list of words)`` gives the ids of all in a row
    and how many each has. Memory is bounded: pieces are remembered in two halves of ``limit``; when the newer one
    is full the older one goes, and what is met again moves to the newer one.
    """

    def __init__(self, pattern: str, encode_words, dtype="<u4", limit: int = PIECES):
        self.find, self.by_word = regex.compile(pattern).findall, pattern == PATTERN
        self.encode_words, self.dtype, self.half = encode_words, np.dtype(dtype), max(1, limit // 2)
        self.newer = self.older = None
        self._renew()

    def _renew(self):
        self.older, self.newer = self.newer, Table(self.half * 2, self.dtype)

    def _split(self, piece: str) -> list[str]:
        """Words of the pattern; those of plain words with marks around are told without it."""
        space = piece[:1] == " "
        bare = piece[1:] if space else piece
        core = bare.strip(_MARKS)
        if core.isalpha():
            if core == bare:
                return [piece]
            at = bare.find(core)
            ahead, behind = bare[:at], bare[at + len(core) :]
            if not ahead:
                return [" " + core, behind] if space else [core, behind]
            words = [" " + ahead if space else ahead, core]
            return [*words, behind] if behind else words
        return self.find(piece)

    def _entries(self, data, starts, sizes, learn) -> np.ndarray:
        """Entries of pieces; ``learn(positions)`` gives the ids of those that are not known, as one
        array and the number of each."""
        keys, marks = hashed(data, starts, sizes)
        entries = self.newer.find(keys, marks)
        entries[sizes > LONG] = -2
        missing = np.flatnonzero(entries == -1)
        if len(missing):
            first, number = _distinct(keys[missing], marks[missing])
            new = missing[first]
            found = np.full(len(new), -1, np.int32)
            if self.older is not None:
                old = self.older.find(keys[new], marks[new])
                known = np.flatnonzero(old >= 0)
                if len(known):
                    found[known] = self.newer.add(keys[new[known]], marks[new[known]], *self.older.gather(old[known]))
            left = np.flatnonzero(found < 0)
            if len(left):
                ids, counts = learn(new[left])
                # words that were learned on the way may be among them
                again = self.newer.find(keys[new[left]], marks[new[left]])
                fresh = np.flatnonzero(again < 0)
                if len(fresh) < len(left):
                    keep = np.repeat(again < 0, counts)
                    ids, counts = ids[keep], counts[fresh]
                found[left] = again
                found[left[fresh]] = self.newer.add(keys[new[left[fresh]]], marks[new[left[fresh]]], ids, counts)
            entries[missing] = found[number]
        return entries

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)

        def learn(at):
            return self.encode_words([words[i] for i in at.tolist()])

        return self._gather(self._entries(data, np.cumsum(sizes) - sizes, sizes, learn), learn)

    def _gather(self, entries, learn) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries; long pieces (-2) are learned each time."""
        long = entries == -2
        if not long.any():
            return self.newer.gather(entries)
        return self._merged(long, learn(np.flatnonzero(long)), self.newer.gather(entries[~long]))

    def _merged(self, chosen, some, rest) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of all pieces, from those of the ``chosen`` ones and of the rest."""
        every = np.empty(len(chosen), np.int64)
        every[chosen], every[~chosen] = some[1], rest[1]
        where = np.repeat(chosen, every)
        out = np.empty(len(where), self.dtype)
        out[where], out[~where] = some[0], rest[0]
        return out, every

    def encode(self, texts) -> list[bytes]:
        if self.newer.n > self.half:
            self._renew()
        raw, own = [], {}
        for i, t in enumerate(texts):
            t = t or ""
            if _ODD_SPACE.search(t):
                own[i] = np.fromiter([len(w.encode()) for w in self.find(t)], np.int64)
            raw.append(t.encode())
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(lengths) - lengths
        if self.by_word:
            cut, odd = word_cuts(data, first[lengths > 0])
        else:
            blank = (data == 32) | ((data >= 9) & (data <= 13))
            cut = data == 32
            cut[1:] &= ~blank[:-1]
            cut[:-1] &= ~blank[1:]
            # no cut at the ends of a text
            ends = np.concatenate([first, first + lengths - 1])
            cut[ends[(ends >= 0) & (ends < len(data))]] = False
            cut[first[lengths > 0]] = True
        # the words of the pattern for some
        for i, sizes in own.items():
            cut[first[i] : first[i] + lengths[i]] = False
            cut[first[i] + np.cumsum(sizes) - sizes] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(data)))
        whole = data.tobytes()

        def pieces(at):
            return [whole[a : a + n].decode() for a, n in zip(starts[at].tolist(), sizes[at].tolist())]

        def split(at):
            parts = list(map(self._split, pieces(at)))
            ids, counts = self._words([w for p in parts for w in p])
            per = np.fromiter(map(len, parts), np.int64, len(parts))
            return ids, np.add.reduceat(counts, np.cumsum(per) - per)

        if self.by_word:
            several = np.logical_or.reduceat(odd, starts) if len(starts) else odd

            def learn(at):
                apart = several[at]
                if not apart.any():
                    return self.encode_words(pieces(at))
                if apart.all():
                    return split(at)
                return self._merged(apart, split(at[apart]), self.encode_words(pieces(at[~apart])))
        else:
            learn = split

        entries = self._entries(data, starts, sizes, learn)
        ids, counts = self._gather(entries, learn)
        per = np.searchsorted(starts, first + lengths) - np.searchsorted(starts, first)
        total = np.concatenate([[0], np.cumsum(counts)])
        ends = total[np.cumsum(per)] * self.dtype.itemsize
        blob = ids.tobytes()
        return [blob[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def byte_letters() -> dict[int, str]:
    """Character that stands for each byte value in the vocabulary files: itself where it is
    printable, otherwise the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
