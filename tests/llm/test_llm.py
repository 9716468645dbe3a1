"""Training-data operators against brute force on small tables with odd rows."""

import importlib.util
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import brown, common, egojoin, jaccard, licenses, packing, pu, quality, suffix, topk, toxicity, transducer
from gapweave.llm.components import components

random.seed(5)
WORDS = ["the", "of", "river", "Stone", "blue,", "ran.", "über", "été", "don't", "x1", "!!", "wolke"]
BASE = " ".join(random.choice(WORDS) + str(random.randint(0, 40)) for _ in range(150))
TEXTS = [
    None, "", "one", "two words", BASE, BASE, BASE.replace("the", "tha", 1), BASE + " more", "x" * 5000, "ab" * 300 + BASE[:400],
    BASE[100:500] + " All Rights Reserved. " + BASE[30:90], "Licensed under CC BY-NC 4.0.", "This is GNU General Public License, cc-by", " ".join(BASE.split()[::-1]),
] + [" ".join(random.choice(WORDS) for _ in range(n)) for n in (3, 20, 300, 2600)]
ROWS = [(i, t, "z", 1.5) for i, t in enumerate(TEXTS)] + [(None, BASE, "null id", None), (3, "two words", "again", 2.0)]
SCHEMA = "doc_id long, text string, id string, n double"  # id and n clash with names that operators use


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    if importlib.util.find_spec("public_tokenizers") is None:
        pytest.skip("no tokenizer files here")
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def library_ids(tokenizer, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).encode(text or "", add_special_tokens=False).ids


def test_packing(docs, none, tokenizer):
    rows = packing.pack(packing.pieces(docs, tokenizer, with_ids=True)).collect()
    whole = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        whole.setdefault(r["doc_id"], {})[r["start"]] = r["ids"]
    for i, t in enumerate(TEXTS):
        ids = np.array([*library_ids(tokenizer, t), 0], "<u4").tobytes()
        assert b"".join(whole[i][k] for k in sorted(whole[i])) == ids
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(none, tokenizer)).collect() == []


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 8, 7, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 7)]


def test_packing_refuses_long_items(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 3000)], "k int, length long"))


def brute_spans(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for b in raws:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("length,memory,hot", [(200, 1 << 26, 2000), (200, 1 << 10, 1), (40, 1 << 12, 5), (20, 1 << 12, 2000)])
def test_suffix_dedup(docs, length, memory, hot):
    want = brute_spans([r[1] for r in ROWS], length)
    got = suffix.dedup(docs, length, memory=memory, hot=hot).collect()
    key = lambda i, t, d: (i is None, i, t or "", d)
    assert sorted(key(r["doc_id"], r["text"], bytes(r["kept"])) for r in got) == sorted(key(r[0], r[1], k) for r, k in zip(ROWS, want))
    for r in got:
        assert len(r["raw"]) - sum(s["b"] - s["a"] for s in r["spans"]) == len(r["kept"])


def test_suffix_dedup_edges(none, docs):
    assert suffix.dedup(none).collect() == []
    with pytest.raises(ValueError):
        suffix.dedup(docs.withColumn("spans", F.lit(1)))


def test_a_line_repeated_in_a_text_is_one_row_of_it():
    line = bytes(np.random.default_rng(3).integers(97, 123, 60).astype(np.uint8))
    rows = suffix.anchors(np.frombuffer(line * 50 + b"end of it" * 10, np.uint8), 40)
    some, places, times = suffix.alike(rows)
    assert len(some) < len(rows) / 5 and times.sum() == len(places) == len(rows)
    back = np.repeat(some, times, axis=0)
    back[:, 2] = places
    assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, rows.tolist()))
    assert [len(a) for a in suffix.alike(rows[:0])] == [0, 0, 0]


def test_queue_on_disk_sorts_and_carries_prefixes():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 99, 12).astype(np.uint8)) for _ in range(300)]
    flat, starts = np.frombuffer(b"".join(words), np.uint8), np.arange(300) * 12
    marks = suffix.repeated_windows(flat, starts, np.full(300, 4), np.full(300, 5), 8, memory=64)
    seen = {}
    for w in words:
        for k in range(5):
            seen[k, w[k : k + 8]] = seen.get((k, w[k : k + 8]), 0) + 1
    assert [[int(seen[k, w[k : k + 8]] > 1) for k in range(5)] for w in words] == np.asarray(marks).tolist()


def labelled(spark, n=600):
    random.seed(1)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        words = [random.choice(["river", "stone", "cloud", "house", "walks", "green"]) for _ in range(random.randint(20, 90))]
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words.insert(5, "grumblefoo")
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (4, None, None), (1, 1, 0)]
    return spark.createDataFrame([*docs, (n, None), (n + 1, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    docs, labels = labelled(spark)
    all_rows = lambda c: F.lit(True)
    for module, right in ((quality, lambda i: i % 5 != 0), (toxicity, lambda i: i % 7 == 0)):
        model = module.train(docs, labels, all_rows)
        got = {r["doc_id"]: r["score"] for r in pu.score(docs, model, module.scorer).collect()}
        assert len(got) == 602 and all(0 <= s <= 1 for s in got.values()) and got[600] == got[601]
        even = [i for i in range(0, 600, 2)]  # no label was given for these
        assert np.mean([(got[i] >= 0.5) == right(i) for i in even]) > 0.98


def test_classifier_without_rows(spark):
    docs, labels = labelled(spark, 10)
    model = toxicity.train(docs, labels.limit(0), lambda c: F.lit(True))
    assert {r["score"] for r in pu.score(docs, model, toxicity.scorer).collect()} == {0.5}
    assert pu.score(docs.limit(0), model, toxicity.scorer).collect() == []


def test_non_negative_risk_uses_the_prior():
    rng = np.random.default_rng(0)
    make = lambda n, p: [np.flatnonzero(rng.random(4) < p).astype(np.uint32) for _ in range(n)]
    positive, negative = (0.9, 0.9, 0.1, 0.5), (0.1, 0.2, 0.8, 0.5)
    model = pu.fit(make(800, positive), make(240, positive) + make(560, negative), 0.3)
    assert np.mean([model.score(x) > 0.5 for x in make(400, positive)]) > 0.8
    assert np.mean([model.score(x) < 0.5 for x in make(400, negative)]) > 0.8


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        v = rng.normal(size=6)
        rows.append((i, [float(x) for x in v], int(i % 3)))
        if i % 4 == 0:
            rows.append((1000 + i, [float(x) for x in v + rng.normal(size=6) * 0.25], int(i % 3)))
        if i % 10 == 0:
            rows.append((2000 + i, [float(x) for x in v], int(i % 3)))
    rows += [(5000, None, 1), (5001, [0.0] * 6, 1), (5002, [float("nan")] * 6, 1), (5003, [1.0, None], 1), (5004, [1.0, 2.0], None), (5005, [1.0, 2.0], 1), (5006, [2.0, 4.0], 1), (5007, [], 1)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")


def test_ego_join(spark, monkeypatch):
    rows, df = vectors(spark)
    monkeypatch.setattr(egojoin, "BLOCK", 7)
    monkeypatch.setattr(egojoin, "FAN", 2)
    ok = {i: np.array(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: c for i, _, c in rows}
    near = {i: {i} for i, *_ in rows}
    for a in ok:
        for b in ok:
            if a != b and label[a] is not None and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.93:
                near[a].add(b)
    root = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += near[k]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in egojoin.near_duplicates(df).collect()}
    assert got == {i: (len(near[i]) - 1, root[i], root[i] == i) for i in near}
    assert egojoin.near_duplicates(df.limit(0)).collect() == []


def test_threshold_search(spark, monkeypatch):
    rows, df = vectors(spark)
    monkeypatch.setattr(topk, "SHARD", 30)
    monkeypatch.setattr(topk, "FIRST_STEP", 2)
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:10])]
    got = topk.search(df, df.filter("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(df.limit(0), df.limit(0)).collect() == []


def test_threshold_search_stops_early():
    rng = np.random.default_rng(0)
    x = rng.integers(-9, 9, (4000, 3))
    lists = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
    ids, best = topk.threshold_search(x, np.arange(4000), lists, np.array([5, -3, 0]), 7, 4)
    order = sorted((-(x[k] @ np.array([5, -3, 0])), k) for k in range(4000) if k != 7)[:4]
    assert [(-s, k) for s, k in zip(best.tolist(), ids.tolist())] == order


def test_round_trip(docs, none, tokenizer):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    got = transducer.round_trip(docs, tokenizer).collect()
    assert len(got) == len(ROWS)
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(ROWS, key=lambda r: (r[0] is None, r[0]))):
        ids = library_ids(tokenizer, t)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == whole.decode(ids, skip_special_tokens=False)
    assert transducer.round_trip(none, tokenizer).collect() == []


@pytest.mark.parametrize("text", ["ΣΑΣ", "x<|endoftext|>Y", "İ I'LL don't É é", "a\x1cb c", "123４ 日本", "a" * 4000, "abc" * 1500 + "!", "it's'S !'s", "ŉ ª ǅ"])
def test_transducer_odd_texts(text, tokenizer):
    from gapweave.llm.tokens import library_encoder

    ids = library_ids(tokenizer, text)
    t = transducer.transducer(tokenizer)
    assert np.frombuffer(t.encode(text), "<u4").tolist() == ids
    assert np.frombuffer(library_encoder(tokenizer).encode(text), "<u4").tolist() == ids


def test_stream_emits_before_the_end_and_holds_little(tokenizer):
    t = transducer.transducer(tokenizer)
    raw, read = (b"thering" * 900)[:6000], 0

    def symbols():
        nonlocal read
        for k, b in enumerate(raw):
            read += 1
            yield b, k == len(raw) - 1

    stream = t.stream(symbols())
    first = next(stream)
    assert read <= t.ahead + 1024 < len(raw)
    assert [first, *stream] == library_ids(tokenizer, raw.decode())


def test_lookahead():
    assert transducer.lookahead([("a", "b")]) == 1
    assert transducer.lookahead([("b", "c"), ("a", "b")]) == 2  # c or not decides b, which decides a


def test_language_model(spark, docs, none):
    train = docs.filter("doc_id % 2 = 0")
    model = brown.fit(train)
    texts = [t for i, t, *_ in ROWS if i is not None and i % 2 == 0]
    counts = {}
    for t in texts:
        for w in [*brown.tokens(t), None]:
            counts[w] = counts.get(w, 0) + 1
    assert (model.tokens, model.distinct) == (sum(counts.values()), len(counts))
    got = sorted(brown.score(docs, model).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"]))
    for r, (i, t, *_) in zip(got, sorted(ROWS, key=lambda r: (r[0] is None, r[0], len(brown.tokens(r[1]))))):
        seq = [*brown.tokens(t), None]
        assert r["n_tokens"] == len(seq) and r["n_known"] == sum(w in counts for w in seq)
        assert r["base"] == pytest.approx(sum(np.log10(counts.get(w, 0) + 1) for w in seq))
        assert r["score"] <= 0
    assert brown.score(none, model).collect() == []
    assert brown.fit(none).tokens == 0


def test_rare_words_are_joined(docs, monkeypatch):
    whole = {r["doc_id"]: tuple(r)[1:] for r in brown.score(docs, brown.fit(docs)).collect()}
    monkeypatch.setattr(brown, "BROADCAST_WORDS", 12)
    model = brown.fit(docs)
    assert 0 < len(model.frequent) <= 12
    for r in brown.score(docs, model).collect():
        assert (r["n_tokens"], r["n_known"], r["base"]) == pytest.approx(whole[r["doc_id"]][:3])


def test_class_bigrams_sum_to_one_and_exchange_helps(docs):
    model = brown.fit(docs)
    assert np.allclose((10**model.step).sum(axis=1), 1)
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 4, 40)
    pairs = np.zeros((41, 41))
    for _ in range(20000):
        a = rng.integers(40)
        b = rng.choice(np.flatnonzero(kind == (kind[a] + 1) % 4))
        pairs[a, b] += 1
    classes = brown.exchange(pairs, k=4)
    assert all(len(set(classes[:40][kind == c])) == 1 for c in range(4))


@pytest.mark.parametrize("n,least,block", [(3, Fraction(9, 10), 256), (3, Fraction(1, 2), 3), (5, Fraction(4, 5), 2), (1, Fraction(3, 5), 4)])
def test_jaccard_join(spark, n, least, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEAST_PARTS", 5)  # several fragments
    random.seed(int(least * 100))
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None]
    for i in range(40):
        words = BASE.split()
        for _ in range(random.randint(0, 12)):
            words[random.randrange(len(words))] = "new"
        rows.append((100 + i, " ".join(words[: random.randint(100, 150)])))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    near = {i: {j for j in sets if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])} | {i} for i in sets}
    root = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += near[k]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, k string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, n, least).collect()}
    assert got == {(i, len(sets[i]), root[i]) for i in sets}
    assert jaccard.join(df.limit(0), n, least).collect() == []


def test_wanted_keys_are_marked_in_a_table_of_fixed_size(spark, docs, monkeypatch):
    rows = spark.range(40_000).select(F.when(F.col("id") >= 0, F.unhex(F.md5(F.col("id").cast("string")))).alias("key"), "id")
    rows = rows.union(spark.createDataFrame([(None, -1)], "key binary, id long"))
    got = {r["id"] for r in common.likely(rows, "key", rows.filter("id % 20 = 0 or id < 0")).collect()}
    assert set(range(0, 40_000, 20)) <= got and len(got) < 2_100 and -1 not in got
    assert common.likely(rows, "key", rows.limit(0)).collect() == []
    sent = []
    own = F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append((df.columns, df.count())) or own(df))
    assert jaccard.join(docs, 3, Fraction(1, 2)).count() == suffix.dedup(docs, 40).count() == docs.count()
    assert [c for c, _ in sent] == [["_row", "_marks"]] * 2 and all(n <= common.MARKS // common.MARKS_ROW for _, n in sent)


def test_shared_grams_of_a_fragment():
    # key 7 comes twice, as from two tasks: its n-grams are no others' for that
    keys, sizes, grams = np.array([7, 3, 7, 9]), np.array([3, 2, 3, 2], np.uint32), np.array([1, 2, 5, 2, 4, 1, 2, 5, 2, 5], np.uint32)
    wholes = np.array([30, 20, 30, 90], np.uint32)
    got = [x.tolist() for x in jaccard.shared_grams(keys, wholes, sizes, grams)]
    assert got == [[3, 7, 9], [20, 30, 90], [1, 2, 2], [2, 2, 5, 2, 5], [3, 3, 2, 3, 2]]
    assert [len(x) for x in jaccard.shared_grams(keys[:1], wholes[:1], sizes[:1], grams[:3])] == [0] * 5


def test_rarest_of_a_bucket():
    def pack(x, kind):
        return np.array(x, kind).tobytes()

    # set 5 (of 4) shares 3 n-grams, all needed but one; set 6 (of 9) shares too few
    held = {"fragment": [0, 1], "ks": [pack([5, 6], np.int64), pack([5], np.int64)], "wholes": [pack([4, 9], np.uint32), pack([4], np.uint32)],
            "sizes": [pack([2, 1], np.uint32), pack([1], np.uint32)], "grams": [pack([8, 9, 9], np.uint32), pack([8], np.uint32)], "counts": [pack([200, 3, 3], np.uint8), pack([2], np.uint8)]}
    s, k = jaccard.rarest(held, Fraction(1, 2))
    assert sorted(zip(s.tolist(), k.tolist())) == [(9, 5), (8 + 2**32, 5)]


def test_license_scan(docs, none):
    import re

    got = {(r["doc_id"], r["n_words"]): r for r in licenses.summary(licenses.scan(docs)).collect()}
    for i, t, *_ in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        places = {b.label: [k for k in range(len(w)) if w[k : k + len(b.words.split())] == b.words.split()] for b in licenses.BASE}
        every = sorted(k for p in places.values() for k in p)
        r = got[i, len(w)]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(every), min(every, default=None), max(every, default=None))
        assert r["base_labels"] == ",".join(sorted(b for b, p in places.items() if p)) and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}
        assert 0 <= r["score"] <= 1
    assert got[11, 7]["labels"] == "cc-by,cc-by-nc"
    assert licenses.scan(none).collect() == []


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 300)
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    random.seed(9)
    kinds = ["river", "stone", "cloud", "house", "walks", "green"]
    same, other = (" ".join(random.choice(kinds) for _ in range(60)) for _ in range(2))
    extra = [(9000, same), (9001, same), (9002, same + " river"), (None, other)]
    docs = docs.union(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in extra], docs.schema))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert tuple(now.columns) == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"] for r in now.collect()})
    assert kept[0] >= {i for i in range(300) if i % 5} | {9000, None}
    # as in test_classifiers: short texts that are also toxic are rare here, and some of them pass as good
    assert np.mean([(i in kept[0]) == (i % 5 != 0) for i in range(300)]) > 0.98
    assert not kept[1] & {i for i in range(300) if i % 7 == 0}
    assert {9000, 9001, 9002} & kept[2] == {9000} and None in kept[2]
    if importlib.util.find_spec("public_tokenizers"):
        last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert {r["doc_id"] for r in last} >= {9000, None}
