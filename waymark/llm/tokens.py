"""Token ids of whole texts, from a tokenizer file and a bounded cache of the ids of their chunks."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: The characters with the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Ways to cut a text so that the ids of the whole are those of the pieces, one after the other.
#: WORDS: tokenizers that drop white space. BYTES: byte-level ones, where one space opens the next word
#: and of several the last does. WHOLE: any other tokenizer.
WORDS, BYTES, WHOLE = "words", "bytes", "whole"
#: A word of Latin letters that a mark, white space or the end follows: every tokenizer with a cut ends a word there.
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_ENDED = f"{_LATIN}(?![^.,;:!?{SPACES}])"
CUTS = {
    WORDS: re.compile(f"{_ENDED}|[^{SPACES}]+"),
    BYTES: re.compile(f" ?(?:{_ENDED}|[^{SPACES}]+)|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"),
}
_PLAIN = re.compile(f" ?{_LATIN}")
#: Chunks in each of the cache's two generations, and the longest chunk that it holds.
CACHE, LONGEST = 300_000, 64
#: Characters of the texts that are encoded together.
STRETCH = 8 << 20
#: First bytes of the white space beyond ASCII in UTF-8: of two bytes, of three.
_TWO, _THREE = [0xC2], [0xE1, 0xE2, 0xE3]
#: What a byte of UTF-8 is: a part of a longer character, white space, a letter, a mark, or anything else of ASCII.
_WIDE, _WHITE, _LETTER, _MARK, _OTHER = range(5)
_KINDS = np.array(
    [
        _WIDE if byte >= 128 else _WHITE if byte == 32 or 9 <= byte <= 13 else _LETTER if chr(byte).isalpha() else _MARK if chr(byte) in string.punctuation else _OTHER
        for byte in range(256)
    ],
    np.uint8,
)


def _byte_letters() -> dict[int, str]:
    """The public alphabet of byte-level tokenizers: printable bytes stand for themselves, others for code points from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (byte for byte in range(256) if byte not in printable)
    return {byte: chr(256 + n) for n, byte in enumerate(others)}


_ALPHABET = _byte_letters()


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 that no token of a byte-level tokenizer spans.

    They lie in front of white space of ASCII that follows another character, after it where it is one character but a
    space, and between a Latin letter and a mark of ASCII. A letter that shares its first byte with white space gives no
    place: the piece is longer then.
    """
    kind = _KINDS[data]
    at = np.flatnonzero(kind[1:] == _WHITE) + 1
    at = at[kind[at - 1] != _WHITE]
    wide = np.flatnonzero(kind[at - 1] == _WIDE)  # the last byte of a longer character, whose first one lies before
    spaces = np.isin(data[at[wide] - 2], _TWO) | np.isin(data[np.maximum(at[wide] - 3, 0)], _THREE)
    at = np.delete(at, wide[spaces])
    after = at[(data[at] != 32) & (at + 1 < len(data))] + 1
    after = after[(kind[after] == _LETTER) | (kind[after] == _MARK)]
    marks = np.flatnonzero(kind[1:] == _MARK) + 1
    return np.concatenate([at, after, marks[kind[marks - 1] == _LETTER]])


def _stretches(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in lists of about STRETCH characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


class Encoder(dict):
    """chunk -> its ids as little-endian 32-bit bytes. Ids come from the tokenizer alone; the cache repeats them."""

    def __init__(self, path: str, cut: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.cut, self.lower = CUTS.get(cut), cut == WORDS
        self.older: dict[str, bytes] = {}
        #: The model alone, for words in the alphabet of its bytes, and the id that is put between them.
        self.letters, self.between = Tokenizer(self.model), self.model.token_to_id(_ALPHABET[10]) if cut == BYTES else None

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one word of Latin letters, straight from the tokenizer's model."""
        letters = word.lower() if self.lower else word
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_ALPHABET)
        elif letters[0] == " ":
            letters = _ALPHABET[32] + letters[1:]
        ids = [token.id for token in self.model.tokenize(letters)]
        return pack(f"<{len(ids)}I", *ids)

    def words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of many words of Latin letters, in one call of the model."""
        letters = [
            _ALPHABET[32] + word[1:] if word[0] == " " and word.isascii() else word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET)
            for word in words
        ]
        apart = [part for word in letters for part in (word, _ALPHABET[10])]
        ids = np.array(self.letters.encode_batch_fast([apart], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(ids == self.between)).tolist()
        found = ids.tobytes()
        for first, last in zip([0, *(end + 4 for end in ends)], ends):
            yield found[first:last]

    def pieces(self, pieces: np.ndarray) -> list[bytes]:
        """Ids of each of these pieces."""
        found = list(map(self.get, pieces))
        plain = []
        for at in [at for at, ids in enumerate(found) if ids is None]:
            piece, ids = pieces[at], self.older.get(pieces[at])
            if ids is None and _PLAIN.fullmatch(piece):
                plain.append(at)
            else:
                found[at] = self.keep(piece, self.parts(piece) if ids is None else ids)
        for at, ids in zip(plain, self.words([pieces[at] for at in plain]) if plain else (), strict=True):
            found[at] = self.keep(pieces[at], ids)
        return found

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= LONGEST:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def parts(self, piece: str) -> bytes:
        """Ids of a piece of one chunk or more."""
        chunks = self.cut.findall(piece)
        return self.ids(piece) if chunks == [piece] else b"".join(map(self.__getitem__, chunks))

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.word(chunk) if _PLAIN.fullmatch(chunk) else self.parts(chunk)
        return self.keep(chunk, found)

    def encode(self, text: str) -> bytes:
        if self.cut is None:
            return self.ids(text)
        return b"".join(map(self.__getitem__, self.cut.findall(text)))

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text. With a byte-level tokenizer, of all equal pieces of a stretch one is encoded."""
        for stretch in _stretches(texts):
            if self.between is None or not any(stretch):
                yield from (np.frombuffer(self.encode(text), "<u4") for text in stretch)
                continue
            whole = pa.array(stretch, pa.string())
            starts = np.frombuffer(whole.buffers()[1], "<i4", len(stretch) + 1)
            border = np.zeros(starts[-1] + 1, bool)
            border[starts] = True
            border[_cuts(np.frombuffer(whole.buffers()[2], np.uint8, starts[-1]))] = True
            borders = np.flatnonzero(border).astype("<i4")
            pieces = pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), whole.buffers()[2]).dictionary_encode()
            known = self.pieces(pieces.dictionary.to_numpy(zero_copy_only=False))
            lengths, own = np.fromiter(map(len, known), np.int32, len(known)) // 4, pieces.indices.to_numpy()
            sizes = lengths[own]  # a stretch has fewer ids than bytes, and Arrow counts these in 32 bits
            before = np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))
            shift = (np.cumsum(lengths, dtype=np.int32) - lengths)[own] - before[:-1]
            ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(shift, sizes) + np.arange(before[-1], dtype=np.int32)]
            ends = before[np.searchsorted(borders, starts)]
            yield from (ids[first:last] for first, last in zip(ends[:-1], ends[1:], strict=True))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, cut: str) -> Encoder:
    """One encoder per Python worker, so that its cache serves all tasks of the worker."""
    if (path, cut) not in _ENCODERS:
        _ENCODERS[path, cut] = Encoder(path, cut)
    return _ENCODERS[path, cut]
