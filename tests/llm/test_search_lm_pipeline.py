import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from steleworks.llm import logbilinear, maxscore
from steleworks.llm.queries import ORACLES, QUERIES

from ..compare import oracle, rows
from .helpers import awkward, empty, prose

SMALL = "/root/testdata/sf0.001"


def test_maxscore_matches_sql(spark):
    got = QUERIES["op8_maxscore"](spark, SMALL).toPandas()
    assert rows(got) == rows(oracle(ORACLES["op8_maxscore"], SMALL))


@pytest.mark.parametrize("scale", [64, 1 << 28])
def test_maxscore_against_brute_force(spark, scale):
    r = random.Random(3)
    vectors = [(i, [r.choice([0.0, 0.25, -0.5, r.uniform(-1, 1)]) for _ in range(8)]) for i in range(300)]
    vectors += [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [float("inf")] + [0.0] * 7), (304, vectors[5][1]), (305, vectors[5][1]), (7, vectors[7][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    q = maxscore.quantized(df, "vec_id", "embedding", scale)
    got = {}
    for x in maxscore.top_k(q.filter("vec_id % 20 = 0"), q, 5, shard=40, most=4).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    good = [(i, [math.floor(c * scale) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    for i, v in good:
        if i % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i))[:5]
            assert sorted(got[i]) == [(k, j, -s) for k, (s, j) in enumerate(scores, 1)]


def test_maxscore_prunes():
    r = np.random.default_rng(0)
    x = (r.normal(size=(5000, 16)) * np.linspace(1, 60, 16)).astype(np.int64)
    best = maxscore.Best(5)
    assert maxscore.search(x[0], 0, maxscore.Shard(np.arange(5000), x), best) < 5000
    assert len(best.ids) == 5


def test_maxscore_on_an_empty_table(spark):
    q = maxscore.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>, score int"), "vec_id", "embedding", 64)
    assert maxscore.top_k(q, q, 5).count() == 0


def _keys(text):
    return [*map(logbilinear.key_of, (text or "").encode().lower().split()), logbilinear.END]


def _base(texts, train):
    c = Counter(t for x in train for t in _keys(x))
    n, v = sum(c.values()), len(c)
    out = []
    for x in texts:
        ts = _keys(x)
        out.append((len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)))
    return out


def _brute(model, counts, text):
    """log10 P(text), place by place, with sums over all clusters, members and other tokens written out."""
    voc, line = model.voc, [logbilinear.END] * logbilinear.ORDER + _keys(text)
    total = 0.0
    for i in range(logbilinear.ORDER, len(line)):
        u = sum(model.place[j - 1] * model.before[voc.rows([line[i - j]])[0]] for j in range(1, logbilinear.ORDER + 1)).astype(float)
        row = voc.rows([line[i]])[0]
        k = int(np.searchsorted(voc.start, row, "right")) - 1
        outer = model.outer @ u + model.outer_bias
        own = range(voc.start[k], voc.start[k + 1])
        inner = {r: float(model.after[r] @ u + model.bias[r]) for r in own}
        total += outer[k] - math.log(np.exp(outer).sum()) + inner[row] - math.log(sum(map(math.exp, inner.values())))
        if row == voc.start[k + 1] - 1:
            rest = [w for w in counts if voc.held.get(w, (0, -1))[1] < 0 and voc.others([w])[0] == k]
            total += math.log((counts.get(line[i], 0) + 1) / (sum(counts[w] + 1 for w in rest) + 1))
    return total / math.log(10)


@pytest.mark.parametrize("held", [200_000, 5])
def test_scores_on_awkward_documents(spark, held):
    docs = awkward(spark, 3000).drop("held_out", "score").selectExpr("*", "doc_id % 2 = 1 AS held_out", "7.5D AS score")
    long_ = spark.createDataFrame([(20, "a " + "x" * 500 + " " + "X" * 500, False), (21, "y" * 500 + " b " + "x" * 500, True)], "doc_id long, text string, held_out boolean")
    docs = docs.unionByName(long_, allowMissingColumns=True)
    model, seen = logbilinear.learned(docs.filter("NOT held_out"), held, widen=1)
    got = logbilinear.score(docs, model, seen).collect()
    raw = docs.collect()
    want = _base([r["text"] for r in raw], [r["text"] for r in raw if r["held_out"] is False])
    counts = {bytes(r["token"]): r["n"] for r in seen.collect()}
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6))
    a = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    b = sorted(((r["doc_id"], *w, r["text"]) for r, w in zip(raw, want, strict=True)), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:4] == y[:4] and abs(x[4] - y[4]) < 1e-6 * max(1, abs(y[4]))
        if x[1] < 60:
            assert abs(x[5] - _brute(model, counts, y[5])) < 1e-3 * max(1, x[1])
    assert all(r["score"] < 0 for r in got)


def test_token_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c of the", False), (2, "b d e f off then", False)], "doc_id long, text string, held_out boolean")
    model, seen = logbilinear.learned(docs, widen=1)
    voc = model.voc
    rows = np.arange(len(model.cluster))
    for context in (0, 1, len(rows) - 1):
        line = np.full((len(rows), logbilinear.ORDER + 1), context)
        line[:, -1] = rows
        asked = np.arange(logbilinear.ORDER, line.size, logbilinear.ORDER + 1)
        assert abs(np.exp(model.log_probabilities(line.ravel(), asked)).sum() - 1) < 1e-5
    counts = {bytes(r["token"]): r["n"] for r in seen.collect()}
    mass = np.ones(len(voc.mass))  # an unseen token in each cluster
    for w, n in counts.items():
        if voc.held[w][1] < 0:
            mass[voc.others([w])[0]] += n + 1
    assert (mass == voc.mass).all() and any(r < 0 for _, r in voc.held.values())


def test_model_learns_from_all_its_positions(spark):
    # What follows m is told by the word two before, what follows n by that three before.
    lines = [" ".join(r.choice([f"{x} m {y}{x}", f"{x} {y} n {x}{y}{x}"]) for _ in range(60) for x, y in [r.choice([("aa", "b"), ("cc", "d"), ("ee", "f")])]) for r in map(random.Random, range(300))]
    docs = spark.createDataFrame([(i, x, i % 5 == 0) for i, x in enumerate(lines)], "doc_id long, text string, held_out boolean")
    model, seen = logbilinear.learned(docs.filter("NOT held_out").coalesce(1), share=1.0)
    got = logbilinear.score(docs.filter("held_out"), model, seen).agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert got[1] / got[2] > got[0] / got[2] + 0.25
    swap = spark.createDataFrame([(1, "aa m baa", True), (2, "aa m dcc", True), (3, "aa b n aabaa", True), (4, "aa b n ccdcc", True)], "doc_id long, text string, held_out boolean")
    s = {r["doc_id"]: r["score"] for r in logbilinear.score(swap, model, seen).collect()}
    assert s[1] > s[2] + 0.3 and s[3] > s[4] + 0.3


def test_lm_splits_words_as_python_does():
    texts = ["".join(map(chr, range(1, 300))), " a\tB\x0bc\x0c\r\nD  ", "", "\x1cx\x85y", "É\u2003z"]
    own, codes, at = logbilinear.words(pa.array([*texts, None]))
    for k, text in enumerate([*texts, ""]):
        assert [own[c] for c in codes[at[k] : at[k + 1]]] == list(map(logbilinear.key_of, text.encode().lower().split()))


def test_lm_sums_by_row_are_right_and_quick():
    r = np.random.default_rng(5)
    weights = 1 / np.arange(1, 9001)
    for rows in (r.choice(9000, 24_576, p=weights / weights.sum()), r.choice([3, 70_000], 500), np.arange(40)[::-1], np.zeros(33, np.int64)):
        values = r.normal(size=(len(rows), 33)).astype(np.float32)
        want = np.zeros((rows.max() + 1, 33))
        np.add.at(want, rows, values)
        got, sums = logbilinear._by_row(rows, values)
        assert (got == np.unique(rows)).all() and np.abs(sums - want[got]).max() < 1e-3

    def runs(rows, values):
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        return np.add.reduceat(values[order], np.flatnonzero(np.diff(rows[order], prepend=-1)), axis=0)

    def least(f, *args):
        took = []
        for _ in range(9):
            t = time.thread_time()
            f(*args)
            took.append(time.thread_time() - t)
        return min(took)

    args = r.choice(9000, 24_576, p=weights / weights.sum()), r.normal(size=(24_576, 33)).astype(np.float32)
    assert least(logbilinear._by_row, *args) < 0.85 * least(runs, *args)


def test_lm_finds_held_tokens_quickly(spark):
    r = random.Random(6)
    some = sorted({prose(r, 1).encode() + str(i % 9000).encode() for i in range(30_000)} | {logbilinear.key_of(b"q" * 99), logbilinear.END})
    held = {w: (i + 1, i // 2 if i % 2 else ~(i // 2)) for i, w in enumerate(some[::2])}
    voc = logbilinear.Vocabulary(held, logbilinear.centroids(some[:50], np.ones(50), 4), np.arange(0, 5 * 9000, 9000), np.ones(4), np.ones(36_000), 9, 9)
    lookup, keys = logbilinear.Lookup(voc), pa.array(some, pa.binary())
    found = lookup.find(keys)
    for i, w in enumerate(some):
        count, row = held.get(w, (0, None))
        assert (found.known[i], found.member[i], found.count[i]) == (w in held, row is not None and row >= 0, count)
        assert row is None or found.row[i] == max(row, ~row)
    assert (found.row[1::2] == voc.start[voc.others(some[1::2]) + 1] - 1).all()
    many = some[::2] * 8
    keys = pa.array(many, pa.binary())

    def one_by_one():
        f = [held.get(w) for w in logbilinear.byte_strings(keys)]
        return [np.fromiter((g(x) for x in f), np.int64, len(f)) for g in (lambda x: x is not None, lambda x: x[1] >= 0, lambda x: x[0], lambda x: max(x[1], ~x[1]))]

    took = []
    for f in (lambda: lookup.find(keys), one_by_one):
        own = []
        for _ in range(5):
            t = time.thread_time()
            f()
            own.append(time.thread_time() - t)
        took.append(min(own))
    assert took[0] < 0.6 * took[1]


def test_lm_trains_on_every_window(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, prose(r, 60)) for i in range(40)], "doc_id long, text string").coalesce(1)
    default, whole, part = (logbilinear.learned(docs, widen=1, **k)[0].values for k in ({}, {"share": 1.0}, {"share": 0.25}))
    assert np.array_equal(default, whole) and not np.array_equal(default, part)


def test_lm_on_an_empty_table(spark):
    docs = empty(spark).drop("held_out").selectExpr("*", "false AS held_out")
    model, seen = logbilinear.learned(docs)
    assert logbilinear.score(docs, model, seen).count() == 0
    one = spark.createDataFrame([(1, "x y", True)], "doc_id long, text string, held_out boolean")
    row = logbilinear.score(one, model, seen).first()
    assert row["n_known"] == 0 and row["n_tokens"] == 3 and row["base_score"] == 0.0


def test_held_out_rule(spark):
    got = {r["doc_id"]: r["held_out"] for r in QUERIES["op10_lm_scoring"](spark, SMALL).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 7 == 2) for i, h in got.items())


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline
    from steleworks.llm import langid, packing, simhash, suffixes, surrogates

    from .helpers import brute_components, brute_spans

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "suffix_dedup", "pii_surrogates", "best_fit_packing"]
    got = corpus_pipeline.run(spark, SMALL).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if len(langid.grams(t)[0])]
    group = brute_components([i for i, _ in docs], [simhash.fingerprint(t) for _, t in docs])
    docs = [(i, t) for (i, t), g in zip(docs, group, strict=True) if i == g]
    raw = [t.encode() for _, t in docs]
    left = []
    for (i, _), t, spans in zip(docs, raw, brute_spans(raw), strict=True):
        rest = suffixes.kept(t, [tuple(s) for s in spans]).decode("utf-8", "ignore")
        if not spans or rest.strip():
            left.append((i, rest, bool(spans)))
    coder, want = packing.encoder()(), Counter()
    for i, t, touched in left:
        data = coder.encode([surrogates.replaced(t, surrogates.entities(t))])[0] + b"\x01\0\0\0"
        for k in range(0, len(data), 4 * 4096):
            part = data[k : k + 4 * 4096]
            want[i, k // 4, len(part) // 4, 0 if touched else zlib.crc32(part)] += 1
    touched = {i for i, _, t in left if t}
    have = Counter((r["doc_id"], r["start"], r["length"], 0 if r["doc_id"] in touched else r["ids_crc32"]) for r in got)
    loose = lambda c: Counter(k for k in c if k[0] not in touched)
    assert loose(have) == loose(want)
    assert {k[0] for k in have} == {k[0] for k in want}
