"""Quality classifier: positive-unlabelled learning on how a text is built.

Features are bins of shares (words in capitals, words that repeat the one before, words that end in
runs of signs, table bars, numbers, repeated lines and word triples, ...), alone and with the bin of
the text's length. They say nothing about topic, so that clean documents of any subject score alike.
"""

from __future__ import annotations

import operator
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from gapweave.llm import pu

_SHARES = (0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.97)
_LENGTHS = (1.5, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 9.0, 11.0, 15.0, 30.0)
_COUNTS = (0, 1, 2, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 5120)


def features(text: str) -> set[int]:
    """Feature numbers of a whole text; an empty text has the features of zero words."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    size = bisect_left(_COUNTS, n)
    m = max(n, 1)
    ends = [w for w in words if not w[-1].isalnum()]
    runs = sum(1 for w in ends if len(w) > 1 and w[-2] == w[-1])
    distinct = len(set(words))
    shares = (
        sum(map(str.isupper, words)) / m,
        sum(map(operator.eq, words, words[1:])) / m,
        distinct / m,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(n - 2, 1),
        len(ends) / m,
        runs / m,
        sum(1 for w in ends if len(w) == 1) / m,
        sum(map(str.isalpha, words)) / m,
        sum(map(str.istitle, words)) / m,
        sum(1 for w in words if not w.isalpha() and any(map(str.isdigit, w))) / m,
        1 - len(set(lines)) / max(len(lines), 1),
        min(1.0, len(lines) / m * 4),
        text.count(".") / m,
        text.count(",") / m,
        sum(1 for w in words if len(w) > 12) / m,
        sum(1 for w in words if len(w) < 3) / m,
    )
    bins = [bisect_left(_SHARES, x) for x in shares]
    bins.append(bisect_left(_LENGTHS, sum(map(len, words)) / m))
    out = {1_000 + size}
    for k, b in enumerate(bins):
        out.add(10_000 + 100 * k + b)
        out.add(100_000 + 10_000 * k + 100 * min(size // 2, 5) + b)
    return out


def scorer(model: pu.Model) -> Callable[[str], float]:
    return lambda text: model.score(features(text))


def train(docs: DataFrame, labels: DataFrame, learn: Callable[[str], Column], **more) -> pu.Model:
    """Fit on trusted positives (quality 1) and unlabelled texts; see pu.train for odd rows and bounds."""
    return pu.train(docs, labels, "quality", learn, features, **more)
