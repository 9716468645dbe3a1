"""Spelling variants against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gapweave.llm import variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words, times=2):
    out = []
    for w, n in words.items():
        near = sorted((x for x in words if one_edit(w, x)), key=lambda x: (-words[x], x))
        strong = bool(near) and words[near[0]] >= times * n
        out.append((w, near[0] if strong else None, n, len(near), words[near[0]] if strong else None))
    forms = {o[0]: o[1] for o in out}

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return sorted((w, f, root(w), n, m, k) for w, f, n, m, k in out)


def made(seed, letters, count, longest):
    random.seed(seed)
    base = ["".join(random.choice(letters) for _ in range(random.randint(5, longest))) for _ in range(count)]
    for w in list(base):
        k = random.randrange(len(w))
        base += [w[:k] + w[k + 1 :], w[:k] + random.choice(letters) + w[k:], w[:k] + random.choice(letters) + w[k + 1 :]]
    return {w: random.choice([3, 4, 8, 9, 20, 50, 400]) for w in base if len(w) >= 5}


@pytest.mark.parametrize("symbols,letters,longest", [(8, "abcdefghéü", 9), (2, "abcxyz", 7), (1, "ab", 6), (90, "aàáâãÿ", 12)])
def test_groups(spark, symbols, letters, longest):
    words = made(symbols, letters, 60, longest)
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    assert sorted(tuple(r) for r in variants.group(df, 2, symbols).select("word", "form", "root", "n", "n_near", "form_n").collect()) == brute(words)


def test_chains_are_followed_to_the_end(spark):
    words = {"a" * 5 + "b" * k: 3 * 2**k for k in range(12)}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    got = {r["word"]: r["root"] for r in variants.group(df).collect()}
    assert set(got.values()) == {"a" * 5 + "b" * 11}


def test_edges(spark):
    assert variants.group(spark.createDataFrame([], "word string, n long")).collect() == []
    with pytest.raises(ValueError):
        variants.group(spark.createDataFrame([], "word string, n long"), 1)
    long = "x" * 30_000
    df = spark.createDataFrame([(long, 9), (long + "x", 4), (long[:-1] + "y", 40)], "word string, n long")
    got = {len(r["word"]): (r["n_near"], r["form_n"]) for r in variants.group(df).filter("word not like '%y'").collect()}
    assert got == {30_000: (2, 40), 30_001: (1, 9)}


@pytest.mark.parametrize("cells", [1 << 18, 6])
def test_below_holds_each_neighbour_once(cells):
    words = [variants.reduce(w, 4) for w in ("aaaaa", "hello", "zéro", "z", "noon", "héllo", "")]
    place, keys = variants.below(words, 4, cells)
    for at, r in enumerate(words):
        want = {tuple(r)} | {tuple(np.delete(r, k)) for k in range(len(r))}
        want |= {(*r[:k], s, *r[k + 1 :]) for k in range(len(r)) for s in range(r[k])}
        mine = keys[place == at].tolist()
        assert len(set(mine)) == len(mine)
        assert set(mine) == {variants.key(np.array(x, np.uint8)) for x in want}


TEXTS = [None, "", "Größe größe GRÖßE", "Colour colour color COLOR color. colours", "x" * 40 + " ÉTÉÉÉ étééé étÉÉÉ", "a×b÷cdefg hijkl_mnopq rst1uvwxy"] + [
    " ".join(random.Random(k).choice(["Colour", "colour", "color", "größe", "walking", "walkin", "vörde"]) for _ in range(200)) for k in range(30)
]


def counted(rows, every):
    out = Counter()
    for i, t in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        run = ""
        for c in lower + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                k = h % len(run)
                out[run if h % every else run[:k] + run[k + 1 :]] += 1
                run = ""
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("every,held,long", [(97, 100_000, 1 << 20), (3, 2, 5)])
def test_vocabulary(spark, monkeypatch, every, held, long):
    monkeypatch.setattr(variants, "HELD", held)
    monkeypatch.setattr(variants, "LONG", long)
    rows = [*enumerate(TEXTS), (None, "colour " * 5), (3, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    got = variants.vocabulary(docs, change=variants.letter_lost(every))
    assert {r["word"]: r["n"] for r in got.collect()} == counted(rows, every)
    assert variants.vocabulary(docs.limit(0)).collect() == []
