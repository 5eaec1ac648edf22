"""Whole texts to token ids, each distinct word encoded once.

Texts of a batch are cut where no token and no rule of the tokenizer can reach
across: before a space, between an ASCII letter and what is no letter, after a
single line feed. Each piece is looked up by a 64-bit hash in a table of pieces seen;
new ones are encoded. Put back in place, the pieces looked up must give the very bytes
of the texts, which is compared, and their ids are then the ids of the uncut texts. A
piece that is one plain word goes to the tokenizer's model, any other through all its
rules.

With `added`, strings of added tokens such as <|endoftext|> become the ids of these
tokens, as the library does unless told otherwise: texts are cut at both ends of such a
string, where the library parts them too, and nowhere inside. Without, they are text.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
CACHE_BYTES = 48 << 20  # that words and ids of a Python worker may take; emptied when full, which changes no result
_PER_WORD = 240  # bytes of the objects that hold a word, its ids and its hash, besides their contents
_WORD = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+\\z"  # RE2
_SPACE, _LETTER, _OTHER, _HIGH = 0, 1, 2, 3


def _classes() -> np.ndarray:
    of = np.full(256, _OTHER, np.uint8)
    of[:33], of[128:] = _SPACE, _HIGH
    of[65:91] = of[97:123] = _LETTER
    return of


_CLASS = _classes()


def _byte_letters() -> dict[int, str]:
    """The printable characters that byte-level vocabularies use for bytes: printable
    Latin-1 bytes stand for themselves, the others for the characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def pieces(data: np.ndarray, offsets: np.ndarray, uncut: Sequence[tuple[int, int]] = ()) -> np.ndarray:
    """Places where to cut UTF-8 texts that lie one after another, with all their ends,
    and with both ends but no place inside of the stretches `uncut`."""
    kind = _CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 3:
        before, here = kind[2:-1], kind[3:]
        plain = (before == _LETTER) | (before == _OTHER)
        accented = (before == _HIGH) & ((data[1:-2] & 0xFC) == 0xC0) & (data[1:-2] >= 0xC3)
        space = (data[3:] == 32) & (plain | accented)
        ends_word = (before == _LETTER) & (here == _OTHER)
        new_line = (data[2:-1] == 10) & (here == _LETTER) & ((kind[1:-2] == _LETTER) | (kind[1:-2] == _OTHER))
        cut[3:-1] = space | ends_word | new_line
    for begin, end in uncut:
        cut[begin : end + 1] = False
        cut[[begin, end]] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    """Made anew for each chunk, so that nothing stays with the worker."""
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, out=steps)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each stretch, equal wherever the bytes are equal."""
    sums = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        powers = _powers(_BASE, len(data))
        powers *= data + np.uint64(1)
        np.cumsum(powers, out=sums[1:])
        del powers
    found = (sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)[starts]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(29))


class Encoder:
    """Ids of texts by one tokenizer file, as 16-bit little-endian streams.

    Words seen are kept while it is entered, up to `CACHE_BYTES`; a worker that has left
    a partition keeps none."""

    def __init__(self, path: str, added: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not added
        self.added = self._added() if added else None
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.model = self.whole.model
        # Lower case is part of the rules where words have an end mark.
        self.word_ends = bool(getattr(self.model, "end_of_word_suffix", None))
        self.forget()

    def _added(self) -> re.Pattern[bytes] | None:
        """Finds the strings of added tokens, the longest of those that start together."""
        tokens = self.whole.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in tokens):
            raise ValueError("added tokens of this vocabulary depend on the text around them")
        words = sorted((t.content.encode() for t in tokens), key=len, reverse=True)
        return re.compile(b"|".join(map(re.escape, words))) if words else None

    def _stretches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens stand; a string that runs on into the next text is none."""
        found: list[tuple[int, int]] = []
        if self.added is None:
            return found
        text, at = data.tobytes(), 0
        while hit := self.added.search(text, at):
            end = int(offsets[np.searchsorted(offsets, hit.start(), "right")])
            if hit.end() <= end:
                found.append(hit.span())
                at = hit.end()
            else:
                at = hit.start() + 1
        return found

    def __enter__(self) -> Encoder:
        return self

    def __exit__(self, *_) -> None:
        self.forget()
        pa.default_memory_pool().release_unused()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.words: list[bytes] = []
        self.coded: list[bytes] = []
        self.held = 0

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        listed = pa.array(words, pa.binary())
        plain = pc.match_substring_regex(listed.cast(pa.string()), _WORD)
        # The byte FF is in no UTF-8 text, so it can part the words meanwhile.
        easy = b"\xff".join(listed.filter(plain).to_pylist())
        if self.word_ends:
            kept = easy.decode(errors="surrogateescape").replace(" ", "").lower()
            easy = kept.encode(errors="surrogateescape")
        tokenize = self.model.tokenize
        letters = easy.decode("latin-1").translate(_LETTERS).split("\xff")
        done = iter([array("H", [t.id for t in tokenize(w)]).tobytes() for w in letters])
        odd = listed.filter(pc.invert(plain)).to_pylist()
        rest: list[bytes] = []
        for at in range(0, len(odd), 5000):
            part = [w.decode() for w in odd[at : at + 5000]]
            rest += [array("H", e.ids).tobytes() for e in self.whole.encode_batch_fast(part, add_special_tokens=False)]
        others = iter(rest)
        return [next(done) if easily else next(others) for easily in plain.to_pylist()]

    def _slots(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The place in the table of every piece."""
        which, distinct = pd.factorize(hashes(data, cuts[:-1], cuts[1:]))
        if self.held > CACHE_BYTES:
            self.forget()
        found = [self.place.get(h, -1) for h in distinct.tolist()]
        slots = np.array(found, np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            at = np.full(len(distinct), len(which), np.int64)
            at[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            text = data.tobytes()
            words = [text[b:e] for b, e in zip(cuts[at[new]].tolist(), cuts[at[new] + 1].tolist(), strict=True)]
            slots[new] = np.arange(len(self.words), len(self.words) + len(new))
            self.place.update(zip(distinct[new].tolist(), slots[new].tolist(), strict=True))
            coded = self._encoded(words)
            self.words += words
            self.coded += coded
            self.held += sum(map(len, words)) + sum(map(len, coded)) + _PER_WORD * len(words)
        return slots[which]

    def _looked_up(self, data: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """The ids of every piece, as binary values."""
        slots = self._slots(data, cuts)
        used, which = _used(slots, len(self.words))
        which = pa.array(which, pa.int64())
        words = pa.array([self.words[s] for s in used], pa.large_binary()).take(which)
        if np.array_equal(np.frombuffer(words.buffers()[2], np.uint8)[: len(data)], data) and words.nbytes >= len(data):
            ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
            if np.array_equal(ends, cuts):
                return pa.array([self.coded[s] for s in used], pa.large_binary()).take(which)
        # Two pieces share a hash: tell them apart by their bytes.
        cut = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        return pa.array(self._encoded(cut.dictionary.to_pylist()), pa.large_binary()).take(cut.indices)

    def stream(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts one after another, and where each text begins and ends."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        first, last = int(offsets[0]), int(offsets[-1])
        if first == last:
            return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
        offsets = offsets - first
        cuts = pieces(data, offsets, self._stretches(data, offsets))
        coded = self._looked_up(data, cuts)
        ends = np.frombuffer(coded.buffers()[1], np.int64, len(coded) + 1) // 2
        ids = np.frombuffer(coded.buffers()[2], np.uint16, int(ends[-1]))
        return ids, ends[np.searchsorted(cuts, offsets)]

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, one past the last, ids, bounds) over parts of bounded size."""
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        at = 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "left"))
            to = min(max(to, at + 1), len(texts))
            yield at, to, *self.stream(texts.slice(at, to - at))
            at = to


def _used(slots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots that occur, and for each entry its place among them."""
    seen = np.zeros(n, bool)
    seen[slots] = True
    used = np.flatnonzero(seen)
    rank = np.zeros(n, np.int64)
    rank[used] = np.arange(len(used))
    return used, rank[slots]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added: bool = False) -> Encoder:
    """One encoder per Python worker, file and reading of added tokens."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = Encoder(path, added)
    return _ENCODERS[path, added]


def crc32_of_ids(wide: np.ndarray, begin: int, end: int, crc: int = 0) -> int:
    """CRC of ids begin to end of an array of little-endian unsigned 32-bit integers."""
    return zlib.crc32(memoryview(wide)[begin:end], crc)
