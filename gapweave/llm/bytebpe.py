"""Byte-level BPE by the tokenizers library, built from a file of ranks, over Arrow batches.

A file of ranks lists byte strings; the library wants characters and merges. Every byte is written as one printable
character, and a token's merge is what its own bytes are merged to before the last step. A word that is itself
a token is taken whole, as the rank rule does. Texts are cut where no word can cross, and equal runs of a worker are
encoded once. Offsets are counted in characters of the text: tokens that hold parts of
one character all span it. Decoding turns the characters back into bytes by the reversed table; a character whose
bytes lie in several tokens appears with the token that completes it.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import keep_types, slices
from gapweave.llm.tokens import byte_alphabet

#: Characters that the library gets at once, and of a run that may be cut further.
PART = 1 << 16
#: Recent runs whose tokens are kept, and the longest of them in characters.
RUNS, KEPT = 500_000, 64
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs that no match of the word pattern crosses: white space with ASCII letters up to ASCII signs or digits, or with
#: all up to the next white space.
_RUN = re.compile(f"[{_WHITE}]*[A-Za-z]+(?=[!-@\\[-`{{-~])|[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: Other places that none crosses: ASCII letters or digits before ASCII characters of another kind, CJK and Hangul
#: before their punctuation.
_SAFE = re.compile(
    r"(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])"
    "|(?<=[ぁ-ゔァ-ヺ一-龥가-힣])(?=[、。！，？])"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks: lines of a base64 text and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the bytes of a token are merged to, lowest rank first and leftmost first, without the token itself."""
    parts = [token[k : k + 1] for k in range(len(token))]
    none = float("inf")
    while len(parts) > 2:
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        least = min(pairs)
        if least == none:
            break
        k = pairs.index(least)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def runs(text: str, most: int = PART) -> list[str]:
    """The text cut before white space, and in longer runs than ``most`` at the first safe place after so many characters."""
    found = _RUN.findall(text)
    if max(map(len, found), default=0) <= most:
        return found
    out = []
    for run in found:
        at = 0
        while len(run) - at > most and (place := _SAFE.search(run, at + most)):
            out.append(run[at : place.start()])
            at = place.start()
        out.append(run[at:])
    return out


class ByteBpe:
    """Encoder and decoder for one file of ranks and one word pattern."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        alphabet = byte_alphabet()
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the file has no token for the bytes {missing}")
        shown = {t: "".join([alphabet[b] for b in t]) for t in ranks}
        merges = [last_merge(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        model = models.BPE({shown[t]: i for t, i in ranks.items()}, [tuple(shown[x] for x in m) for m in merges if len(m) == 2], ignore_merges=True)
        self.library = Tokenizer(model)
        words = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.library.pre_tokenizer = pre_tokenizers.Sequence([words, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        values = {c: b for b, c in enumerate(alphabet)}
        self.bytes = {i: bytes([values[c] for c in shown[t]]) for t, i in ranks.items()}
        self.recent: dict[bool, dict[str, tuple[bytes, bytes]]] = {False: {}, True: {}}

    def encode(self, texts: list[str], offsets: bool = True, most: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(ids, offsets) of each text; offsets are (start, end) rows in characters. A run goes to the library once as
        long as it is remembered; a call gets about ``most`` characters."""
        recent = self.recent[offsets]
        for text in texts:
            cut = runs(text, most)
            if len(recent) > RUNS:
                recent.clear()
            new, once = [r for r in dict.fromkeys(cut) if r not in recent], {}
            ends = np.cumsum([len(r) for r in new], dtype=np.int64) // most
            edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(new)]
            for i, j in zip(edges, edges[1:], strict=False):
                for run, e in zip(new[i:j], self.library.encode_batch(new[i:j], add_special_tokens=False), strict=True):
                    done = np.array(e.ids, "<u4").tobytes(), np.array(e.offsets, np.int32).tobytes() if offsets else b""
                    (recent if len(run) <= KEPT else once)[run] = done
            found = [recent.get(r) or once[r] for r in cut]
            ids = np.frombuffer(b"".join([f[0] for f in found]), "<u4")
            yield ids, self._offsets(cut, found) if offsets else None

    @staticmethod
    def _offsets(cut: list[str], found: list[tuple[bytes, bytes]]) -> np.ndarray:
        begin = np.cumsum([0, *(len(r) for r in cut)], dtype=np.int64)[:-1]
        own = np.frombuffer(b"".join([f[1] for f in found]), np.int32).reshape(-1, 2)
        return own + np.repeat(begin, [len(f[0]) // 4 for f in found])[:, None]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def decode_tokens(self, ids: np.ndarray) -> list[str]:
        """The text that each token adds: nothing until a character is complete, U+FFFD for bytes that make none."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        out = [state.decode(self.bytes[i]) for i in ids.tolist()]
        if out:
            out[-1] += state.decode(b"", True)
        return out


_loaded: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One per Python worker, kept between tasks."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """The id, ids (little-endian unsigned 32-bit), starts and ends (arrays of character offsets) of every whole text.

    A null or empty text has no tokens; special tokens are not known, their strings are ordinary text. Repeated rows
    and null ids are kept, other columns are not read, no rows give none. ``offsets=False`` leaves starts and ends
    out. One scan, no shuffle: a lost executor costs its running tasks only. A task holds the tokens of a few texts
    and, of a text without any white space or change of script, one run whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in slices(batches, 64):
            done = list(bpe.encode([t or "" for t in batch.column(1).to_pylist()], offsets))
            columns = [batch.column(0), pa.array([ids.tobytes() for ids, _ in done], pa.binary())]
            if offsets:
                columns += [pa.array([at[:, k] for _, at in done], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "ids", "starts", "ends"] if offsets else ["id", "ids"]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = ", ids binary, starts array<long>, ends array<long>" if offsets else ", ids binary"
    return source.mapInArrow(run, keep_types(source, "id") + kinds).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with decoded, the bytes that ids stand for: bytes, as a sequence cut anywhere may end within a character.

    Null ids decode to null; an id that the file does not have raises; an existing column named decoded raises.
    """
    if "decoded" in rows.columns:
        raise ValueError("the column decoded would be overwritten")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks, pattern)
        for batch in slices(batches, 64):
            at = batch.schema.names.index(ids_col)
            texts = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{keep_types(rows, *rows.columns)}, decoded binary")
