"""Toxicity classifier: positive-unlabelled learning on the words of a text.

Features are a text's distinct words and their first four and six letters. Only those whose rates in
confirmed toxic and in unlabelled texts differ clearly are kept, so that the many other words of a long
text add no noise.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column, DataFrame

from gapweave.llm import pu

_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_HEADS = (4, 6)


def _numbers(chunk: str) -> list[int]:
    word = chunk.strip(_SIGNS).lower()
    if not word:
        return []
    return [crc32(f"w{word}".encode("utf-8", "replace")), *(crc32(f"{k}{word[:k]}".encode("utf-8", "replace")) for k in _HEADS if len(word) > k)]


def features(text: str) -> set[int]:
    """Feature numbers of a whole text; an empty text has none."""
    return {f for chunk in set(text.split()) for f in _numbers(chunk)}


def scorer(model: pu.Model, most: int = 500_000) -> Callable[[str], float]:
    """Scores by the kept features; those of recent chunks are remembered, in bounded memory."""
    kept: dict[str, tuple[int, ...]] = {}

    def of(text: str) -> float:
        found: set[int] = set()
        for chunk in set(text.split()):
            if (hit := kept.get(chunk)) is None:
                if len(kept) >= most:
                    kept.clear()
                hit = kept[chunk] = tuple(f for f in _numbers(chunk) if f in model.weights)
            if hit:
                found.update(hit)
        return model.score(found)

    return of


def train(docs: DataFrame, labels: DataFrame, learn: Callable[[str], Column], **more) -> pu.Model:
    """Fit on confirmed toxic texts (toxic 1) and unlabelled ones; see pu.train for odd rows and bounds."""
    return pu.train(docs, labels, "toxic", learn, features, **more)
