"""Token ids of whole texts by a tokenizer file, with the ids of recent words kept."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Characters that Python counts as white space and Unicode's White_Space property does not.
_PYTHON_ONLY = "\x1c\x1d\x1e\x1f"
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: ASCII signs that may end a word, as one run.
_TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def chunks(text: str) -> list[str]:
    """Runs of a text between white space."""
    if any(c in text for c in _PYTHON_ONLY):
        return [c for c in _SPACES.split(text) if c]
    return text.split()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


def simple_word(chunk: str) -> tuple[str, str] | None:
    """(word, signs after it), lower case, of a chunk that is one run of common letters and one run of ASCII
    signs, either of which may be empty: nothing to compose, one letter for each letter. None for others."""
    word = chunk.rstrip(_TAIL)
    if word and not (word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word))):
        return None
    return word.lower(), chunk[len(word) :]


class Remembered(dict):
    """A dictionary that is filled by ``make`` and emptied when it holds ``most`` entries or long keys come."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self.make(key)
        if len(key) <= 64:
            self[key] = out
        return out


class ChunkEncoder:
    """Ids of texts by the runs between white space, which a tokenizer's words never cross. What recent
    runs and words gave is remembered, in bounded memory. Subclasses give ``word_ids`` and ``odd_ids``."""

    def __init__(self, runs: int = 1_000_000, words: int = 300_000):
        self.runs = Remembered(self._run, runs)
        self.words = Remembered(self.word_ids, words)

    def word_ids(self, word: str) -> bytes:
        """Ids of one lower-case word, or of one run of signs."""
        raise NotImplementedError

    def odd_ids(self, chunk: str) -> bytes:
        """Ids of any other run."""
        raise NotImplementedError

    def _run(self, chunk: str) -> bytes:
        parts = simple_word(chunk)
        if parts is None:
            return self.odd_ids(chunk)
        word, tail = parts
        if not tail:
            return self.words[word] if word else b""
        return self.words[word] + self.words[tail] if word else self.words[tail]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.runs.__getitem__, chunks(text)))


class LibraryEncoder(ChunkEncoder):
    """Ids by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.pieces = self.whole.model.tokenize
        self.shown = dict(enumerate(byte_alphabet()))
        super().__init__()

    def word_ids(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.shown)
        return b"".join([x.id.to_bytes(4, "little") for x in self.pieces(word)])

    def odd_ids(self, chunk: str) -> bytes:
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()


_loaded: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One per Python worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = LibraryEncoder(path)
    return _loaded[path]
