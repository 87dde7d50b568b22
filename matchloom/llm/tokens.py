"""Token ids of whole texts by a public tokenizer, with a bounded memory of words.

Byte-level BPE splits a text into pieces before it merges, and a single space
or newline between two other characters always starts a new piece.  So a text
is cut there, what lies between is split by the same rule as the tokenizer's,
and the tokenizers library's model merges each piece once, for as long as the
piece is remembered.  Words and pieces stay in Arrow and numpy arrays, from the
texts to the ids: only a piece that is new becomes a Python string.  Texts that
this rule doesn't cover, and those that hold the string of an added token, go to
the library as a whole.
"""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import kept_in_worker

#: Longer words and pieces aren't remembered.
LONGEST = 64
#: The pieces of byte-level BPE.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Beyond Latin letters, versions of Unicode may differ on what a letter is; on control characters, on what a space is.
_BEYOND = re.compile("[^\t\n\r -~\xa1-ɏ]")

#: The same characters, and the apostrophe, which may begin a piece within a run of signs.
_ODD = r"'|[^\t\n\r -~\x{a1}-\x{24f}]"
#: What a character of the others is to the rule, by its number: the space that a piece may begin with, then letters, digits, signs, other spaces.
_KINDS = np.array([0 if c == " " else 4 if c.isspace() else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in map(chr, range(0x250))], np.uint8)

#: Words with a space (any that Python knows) at an end, and empty ones.
_SPACES = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EDGE = rf"^$|^{_SPACES}|{_SPACES}\z"


def _byte_letters() -> str:
    """Byte-level BPE writes each byte as one printable character; others are numbered from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))


_LETTERS = _byte_letters()


class _Memory(dict):
    """Ids by text, as far as ``make`` puts them in; what isn't used for a whole generation is forgotten."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            return self.make(text)
        self[text] = ids
        return ids

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.older = dict(self)
            self.clear()


def _places(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the values of all runs stand, run by run."""
    at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return at


def _data(texts: pa.Array) -> bytes:
    """All texts' bytes, one after the other."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return texts.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if len(texts) else b""


class _Table:
    """Ids by text in arrays, for many texts at a time; ``make`` gives the ids and their numbers for texts that are new.

    When there are more than ``2 * most``, those ``most`` stay that were asked for last.
    """

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], most: int):
        self.make, self.most, self.turn = make, most, 0
        self.texts, self.ids = pa.array([], pa.large_string()), np.empty(0, "<u4")
        self.begin, self.sizes, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each of these (different) texts has its own: first place and number."""
        found = pc.index_in(texts, value_set=self.texts)
        new = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        self.turn += 1
        self.used[at[~new]] = self.turn
        if not new.any():
            return self.ids, self.begin[at], self.sizes[at]
        missing = texts.filter(pa.array(new))
        ids, sizes = self.make(missing)
        first = np.cumsum(sizes) - sizes
        begin, number = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        begin[~new], number[~new] = self.begin[at[~new]], self.sizes[at[~new]]
        begin[new], number[new] = first + len(self.ids), sizes
        every = np.concatenate((self.ids, ids))
        short = pc.less_equal(pc.binary_length(missing), LONGEST).to_numpy(zero_copy_only=False)
        if not short.all():
            missing, ids, sizes = missing.filter(pa.array(short)), ids[_places(first[short], sizes[short])], sizes[short]
            first = np.cumsum(sizes) - sizes
        self.begin, self.sizes = np.append(self.begin, first + len(self.ids)), np.append(self.sizes, sizes)
        self.texts, self.ids = pa.concat_arrays([self.texts, missing]), np.append(self.ids, ids)
        self.used = np.append(self.used, np.full(len(missing), self.turn))
        if len(self.texts) > 2 * self.most:
            self._forget()
        return every, begin, number

    def _forget(self) -> None:
        stay = np.sort(np.argpartition(self.used, -self.most)[-self.most :])
        self.texts = self.texts.take(pa.array(stay))
        self.ids = self.ids[_places(self.begin[stay], self.sizes[stay])]
        self.sizes, self.used = self.sizes[stay], self.used[stay]
        self.begin = np.cumsum(self.sizes) - self.sizes


class Encoder:
    """Encodes texts as the tokenizers library does with ``add_special_tokens=False``.

    A tokenizer whose pieces don't follow byte-level BPE's rule (``by_piece``
    false) encodes whole texts.  ``remembered`` words are kept, and as many of
    the generation before them.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        kind = type(self.tokenizer.pre_tokenizer).__name__ if self.tokenizer.pre_tokenizer else ""
        self.by_piece = kind == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)).search if added else lambda text: None
        self.remembered = remembered
        #: By piece, one at a time and many; by what stands between two spaces, for the run with the space before it.
        self.pieces, self.many, self.words = _Memory(self._piece), _Table(self._pieces, remembered), _Table(self._words, remembered)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _merge(self, letters: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it, and their numbers."""
        odd = pc.match_substring_regex(words, _ODD).to_numpy(zero_copy_only=False)
        ids, sizes = self._plain(words.filter(pa.array(~odd)))
        if not odd.any():
            return ids, sizes
        other = [self._run(f" {word}") for word in words.filter(pa.array(odd)).to_pylist()]
        number = np.empty(len(words), np.int64)
        number[~odd], number[odd] = sizes, [len(x) // 4 for x in other]
        begin = np.empty(len(words), np.int64)
        begin[~odd], begin[odd] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum(number[odd]) - number[odd]
        return np.concatenate((ids, np.frombuffer(b"".join(other), "<u4")))[_places(begin, number)], number

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of characters in ``_KINDS`` without an apostrophe, and with no space at an end."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        data = _data(pc.binary_join_element_wise(none, words, space))
        text = data.decode()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = _KINDS[points]
        begins = np.ones(len(kind), bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        # Of several spaces before another character, the last stands alone.
        begins[1:-1] |= (kind[1:-1] == 4) & (kind[:-2] == 4) & (kind[2:] != 4)
        bounds = np.append((np.cumsum(1 + (points >= 0x80)) - 1 - (points >= 0x80))[begins], len(data))
        pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        codes = pieces.indices.to_numpy()
        ids, begin, sizes = self.many.find(pieces.dictionary)
        begin, sizes = begin[codes], sizes[codes]
        first = np.flatnonzero(kind[begins] == 0)
        return ids[_places(begin, sizes)], np.add.reduceat(sizes, first)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and their numbers."""
        sizes = pc.binary_length(pieces).to_numpy()
        ends = np.cumsum(sizes)
        letters = codecs.charmap_decode(_data(pieces), "strict", _LETTERS)[0]
        ids, number = [], []
        # A part at a time: as Python objects, ids take many times their bytes.
        for at in range(0, len(pieces), 1 << 15):
            part = slice(at, at + (1 << 15))
            found = [self._merge(letters[i:j]) for i, j in zip((ends - sizes)[part].tolist(), ends[part].tolist())]
            ids.append(np.fromiter(chain.from_iterable(found), "<u4"))
            number.append(np.fromiter(map(len, found), np.int64, len(found)))
        return np.concatenate(ids), np.concatenate(number)

    def _run(self, text: str) -> bytes:
        """A text without a cut before it."""
        if _BEYOND.search(text):
            return self._whole(text).tobytes()
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def _piece(self, text: str) -> bytes:
        ids = np.array(self._merge(codecs.charmap_decode(text.encode(), "strict", _LETTERS)[0]), "<u4").tobytes()
        if len(text) <= LONGEST:
            self.pieces[text] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_rows(self, texts: list[str], at_once: int = 1 << 23) -> Iterator[np.ndarray]:
        """The same for any number of texts, about ``at_once`` characters at a time."""
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= at_once:
                yield from self.encode_all(group)
                group, held = [], 0
        yield from self.encode_all(group)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; equal words of all texts are looked up once."""
        if not texts:
            return []
        whole = np.array([not self.by_piece or self.added(t) is not None for t in texts])
        split = pc.split_pattern(pa.array(["" if w else t for w, t in zip(whole.tolist(), texts)], pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        codes, first = words.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()[:-1]
        starts = words.dictionary.take(words.indices.take(pa.array(first))).to_pylist()
        # A cut is only one between characters that are no space.
        spaced = pc.match_substring_regex(words.dictionary, _EDGE).to_numpy(zero_copy_only=False)
        unsure = spaced[codes]
        unsure[first] = [x[-1:].isspace() for x in starts]
        unsure = np.add.reduceat(unsure, first) > 0
        codes[first] = len(spaced) + np.arange(len(first))
        used = np.bincount(codes, minlength=len(spaced))[: len(spaced)] > 0
        sure = np.flatnonzero(used & ~spaced)
        ids, begin, sizes = np.empty(0, "<u4"), np.zeros(len(spaced) + len(first), np.int64), np.zeros(len(spaced) + len(first), np.int64)
        if len(sure):
            ids, begin[sure], sizes[sure] = self.words.find(words.dictionary.take(pa.array(sure)))
        entries = [b"" if u else self._run(x) for u, x in zip((unsure | whole).tolist(), starts)]
        self.pieces.turn(self.remembered)

        sizes[len(spaced) :] = [len(x) // 4 for x in entries]
        begin[len(spaced) :] = len(ids) + np.cumsum(sizes[len(spaced) :]) - sizes[len(spaced) :]
        ids = np.concatenate((ids, np.frombuffer(b"".join(entries), "<u4")))
        own = sizes[codes]
        out = np.split(ids[_places(begin[codes], own)], np.cumsum(np.add.reduceat(own, first))[:-1])
        for i in np.flatnonzero(unsure | whole).tolist():
            text = texts[i]
            out[i] = self._whole(text) if whole[i] or _BEYOND.search(text) else np.frombuffer(self._run(text), "<u4")
        return out


def encoder(path: str) -> Encoder:
    """One for each path in a Python worker, for as long as the worker encodes."""
    return kept_in_worker(f"encoder {path}", lambda: Encoder(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
