"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a state machine.

The transducer reads a word symbol by symbol and emits a token as soon as no later symbol can change it.
How many symbols suffice is computed from the merge list: when a merge (u, v) takes place in one reading and
not in another, the last place where both agree moves back over u. For it to move on, a later merge must have
a right part that begins with u. The heaviest such chain of merges is the lookahead. A boundary that stands
is never crossed by a merge, so what follows it is encoded on its own: only the unstable rest stays in memory.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import keep_types, slices
from gapweave.llm.tokens import ChunkEncoder, byte_alphabet


def lookahead(merges: list[tuple[str, str]], end: str = "") -> int:
    """Symbols after a boundary that suffice to know it for good; ``end`` is the mark of a word's end."""
    reach: dict[str, int] = {}
    most = 0

    def bare(x: str) -> str:
        return x.removesuffix(end) if end else x

    for u, v in reversed(merges):
        u, v = bare(u), bare(v)
        here = len(u) + reach.get(u, 0)
        most = max(most, here)
        for k in range(1, len(v) + 1):
            if reach.get(v[:k], 0) < here:
                reach[v[:k]] = here
    return most


class Transducer(ChunkEncoder):
    """Encoder of a byte-level BPE file whose words never cross white space."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model["end_of_word_suffix"] or ""
        self.rules = {self.vocab[u] << 20 | self.vocab[v]: rank for rank, (u, v) in enumerate(merges)}
        self.made = [self.vocab[u + v] for u, v in merges]
        self.ahead = lookahead(merges, self.end)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in self.alphabet]
        self.last = [self.vocab[c + self.end] for c in self.alphabet]
        parts = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if len(parts) != 1 or kinds != ["NFC", "Replace", "Lowercase"] or model.get("unk_token"):
            raise ValueError("a byte-level file with NFC, lower case and one word pattern is expected")
        self.pattern = regex.compile(parts[0])
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        super().__init__()

    def merge(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """Ids of single symbols -> tokens and the symbols in each: lowest rank first, leftmost first."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get, none = self.rules.get, len(self.made)
        ids, width = ids[:], [1] * len(ids)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            ids[k] = self.made[least]
            width[k] += width[k + 1]
            del ids[k + 1], width[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 20 | ids[k], none)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 20 | ids[k + 1], none)
        return ids, width

    def _merge_long(self, ids: list[int]) -> tuple[list[int], list[int]]:
        """The same with a heap of places and a linked list."""
        rules, n = self.rules, len(ids)
        ids, after, before = ids[:], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rules[p], k, p) for k in range(n - 1) if (p := ids[k] << 20 | ids[k + 1]) in rules]
        heapq.heapify(heap)
        while heap:
            rank, k, pair = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right >= n or ids[k] << 20 | ids[right] != pair:
                continue
            ids[k], ids[right] = self.made[rank], -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (p := ids[a] << 20 | ids[b]) in rules:
                    heapq.heappush(heap, (rules[p], a, p))
        left = [k for k in range(n) if ids[k] >= 0]
        return [ids[k] for k in left], [after[k] - k for k in left]

    def stream(self, symbols: Iterable[tuple[int, bool]], block: int = 1024) -> Iterator[int]:
        """Tokens of one word given as (byte, is the last), each emitted once it is stable. At most
        ``block`` symbols beyond the lookahead and one unstable token are held."""
        held: list[int] = []
        for byte, is_last in symbols:
            held.append(self.last[byte] if is_last else self.inner[byte])
            if is_last or len(held) >= self.ahead + block:
                stable, done = len(held) if is_last else len(held) - self.ahead, 0
                for token, width in zip(*self.merge(held), strict=True):
                    if done + width > stable:
                        break
                    yield token
                    done += width
                del held[:done]

    def word_ids(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        if len(raw) <= self.ahead:  # the whole word lies within the lookahead
            ids = [self.inner[b] for b in raw]
            ids[-1] = self.last[raw[-1]]
            return b"".join([t.to_bytes(4, "little") for t in self.merge(ids)[0]])
        end = len(raw) - 1
        return np.fromiter(self.stream((b, k == end) for k, b in enumerate(raw)), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # sigma: no final form
        return b"".join([self.words[found[0]] for found in self.pattern.finditer(text.lower())])

    def odd_ids(self, chunk: str) -> bytes:
        """Ids of a run without white space, special tokens included."""
        if not self.marks or not self.marks.search(chunk):
            return self._plain(chunk)
        out, at = [], 0
        for mark in self.marks.finditer(chunk):
            out += [self._plain(chunk[at : mark.start()]), self.special[mark[0]].to_bytes(4, "little")]
            at = mark.end()
        return b"".join([*out, self._plain(chunk[at:])])


class TextState:
    """Incremental decoder. Byte-level decoders hold back the bytes of an unfinished character; a file
    without a decoder joins its tokens by one space, where the state is whether any came before."""

    def __init__(self, of: Transducer):
        self.joins = of.decoder is None
        self.names = of.names
        if not self.joins:
            values = {c: b for b, c in enumerate(of.alphabet)}
            self.bytes = {i: (t.encode() if t in of.special else bytes(values[c] for c in t)) for i, t in of.names.items()}
            self.half = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        if not self.joins:
            return self.half.decode(b"".join([self.bytes[i] for i in ids]))
        text = " ".join([self.names[i] for i in ids])
        if self.begun and ids:
            text = " " + text
        self.begun = self.begun or bool(ids)
        return text

    def end(self) -> str:
        return "" if self.joins else self.half.decode(b"", True)


def decode(of: Transducer, ids: bytes, block: int = 8192) -> str:
    state, values = TextState(of), np.frombuffer(ids, "<u4")
    return "".join([*(state.feed(values[k : k + block].tolist()) for k in range(0, len(values), block)), state.end()])


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per Python worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: the id, ids (little-endian unsigned 32-bit), decoded.

    A null text is an empty one: no ids, empty text. Repeated rows and null ids are kept; other columns
    are not read. One scan, no shuffle: a lost executor costs its running tasks only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(tokenizer)
        for batch in slices(batches, 64):
            ids = [t.encode(x or "") for x in batch.column(1).to_pylist()]
            texts = [decode(t, x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, keep_types(source, "id") + ", ids binary, decoded string").withColumnRenamed("id", id_col)
