import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from steleworks.functions import text as t
from steleworks.operators import sequences
from steleworks.operators.cleaning import clean_corpus, require, target_column
from steleworks.operators.scores import _moves, edits
from steleworks.operators.sequences import text_windows, vote
from steleworks.plans.registry import QUERIES


def one(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"s {kind}").coalesce(1).select(f(F.col("s"))).collect()]


def test_clean_golden_rows(spark):
    got = one(spark, lambda c: t.flatten(t.clean(c)), ["(판독불가)府尹嚴相公善政碑□ 123 abc。", "全文 公諱鼎耉\n  字重叔", "▩▨◆", "한글 only text 123", None, "price $5 ^ ok", "　觀察使　閔公致序　 永世不忘碑　"])
    assert got == ["▨府尹嚴相公善政碑▨ 。", "公諱鼎耉 字重叔", "▨▨", "", "", "$ ^", "觀察使 閔公致序 永世不忘碑"]


def test_clean_is_idempotent(spark):
    clean = lambda c: t.flatten(t.clean(c))
    once = one(spark, clean, ["府尹 □ 碑\n 全文", "a ▨ $ ^"])
    assert one(spark, clean, once) == once


def test_min_length_is_inclusive(spark):
    df = spark.createDataFrame([("碑" * 20,), ("碑" * 19,), (None,)], "transcript string")
    assert clean_corpus(df).count() == 1


def test_column_resolution(spark):
    df = spark.createDataFrame([("x", 1)], "a string, b int")
    assert target_column(df, "b") == "b" and target_column(df, "zz") == "a"
    with pytest.raises(ValueError):
        require(df, "preprocess")


def test_scalars(spark):
    assert one(spark, t.final_translation, ["[음독]: 가\n[최종 번역]:  부윤의 비.\n끝", "[최종 번역] 비", "없음", "[최종 번역]: "]) == ["부윤의 비.", "비", "없음", ""]
    assert one(spark, t.url_suffix, ["http://h/a/b.png?x=1.2", "http://h/a", "http://h"]) == [".png", ".jpg", ".jpg"]
    assert one(spark, t.noun_candidates, ["부윤(府尹) 엄 abc 상공"]) == ["부윤 엄 상공"]


@pytest.mark.parametrize(("n", "starts"), [(0, []), (1, [0]), (400, [0]), (401, [0, 300]), (700, [0, 300]), (701, [0, 300, 600]), (1000, [0, 300, 600])])
def test_window_starts(spark, n, starts):
    df = spark.createDataFrame([(1, "x" * n)], "id int, s string")
    assert sorted(r["start"] for r in text_windows(df, "id", "s").collect()) == starts


def test_vote_ties_to_the_earliest_window(spark):
    df = spark.createDataFrame([(1, 0, "B"), (1, 1, "A"), (2, 0, "O"), (2, 1, "A"), (3, 0, "O")], "pos int, window int, label string")
    assert {r["pos"]: r["label"] for r in vote(df, "pos").collect()} == {1: "B", 2: "A"}


def test_edit_counts():
    r = random.Random(5)
    for _ in range(100):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        s, d, i = edits(a, b)
        assert d - i == len(a) - len(b)
    import numpy as np

    x, y = np.arange(300) % 7, np.arange(280) % 5
    import steleworks.operators.scores as scores

    old, scores.CELLS = scores.CELLS, 500
    try:
        a, b = ("".join(map(chr, 97 + v)) for v in (x, y))
        assert sum(edits(a, b)) == sum(_moves(x, y))
    finally:
        scores.CELLS = old


def test_image_kernels_on_ties_and_flat_images(spark):
    from steleworks.functions import pixels as p

    rows = [[0, 0, 255, 255], [9, 9, 9], [10, 20, 20, 200], None]
    assert one(spark, p.otsu, rows, "array<int>") == [0, 9, 20, None]
    assert one(spark, p.equalized, rows, "array<int>") == [[0, 0, 255, 255], [9, 9, 9], [0, 170, 170, 255], None]
    assert one(spark, p.rescale, rows, "array<int>") == [[0, 0, 255, 255], [0, 0, 0], [0, 13, 13, 255], None]


def test_restored_items(spark):
    from steleworks.operators.restore import restored

    image = [[1, 2], [3, 4]]
    items = [("a", image, "MASK2", [0.0, 0.0, 2.0, 1.0]), ("b", image, "MASK1", [0.0, 0.0, 2.0, 1.0]), ("c", image, "MASK2", [1.0, 0.0, 1.9, 2.0]), ("d", image, "MASK2", [5.0, 0.0, 7.0, 2.0]), ("e", None, "MASK2", [0.0, 0.0, 2.0, 1.0]), ("f", image, "MASK2", None)]
    df = spark.createDataFrame(items, "id string, image array<array<int>>, type string, box array<double>")
    got = restored(df, ["id"], lambda c: F.flatten(c), 1).collect()
    assert [(r["id"], r["rank"], r["class"]) for r in got] == [("a", 1, 1)] and abs(got[0]["probability"] - 0.731059) < 1e-6


def test_stitch_against_brute_force(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(sequences, "BLOCK", 7)
    names, puncs = ["O", "B-0", "B-1"], {"B-0": ", ", "B-1": "。 "}
    for size, overlap in ((5, 2), (4, 3), (6, 0), (40, 10)):
        for texts in (["abcdefghijklmnopqrstuvwxyz"], ["é漢🎉 x"], ["a"], ["hello world", "x" * 17, "🎉b"]):
            table = [[r.choice([0, 0, 1, 2]) for _ in range(60)] for _ in range(60)]
            predict = lambda w, start, piece: np.array(table[w][start : start + len(piece) - w % 2], int)  # noqa: B023, E731
            votes = {}
            for text in texts:
                for w in range(max(0, -(-(len(text) - size) // (size - overlap))) + 1):
                    start = w * (size - overlap)
                    for i, k in enumerate(predict(w, start, text[start : start + size])):
                        if k:
                            n, first = votes.get((start + i, k), (0, w))
                            votes[start + i, k] = (n + 1, min(first, w))
            want = ""
            for p, c in sorted((p, c) for text in texts for p, c in enumerate(text)):
                found = max(((n, -first, k) for (at, k), (n, first) in votes.items() if at == p), default=(0, 0, 0))
                want += c + (puncs[names[found[2]]] if found[2] else "")
            assert sequences.stitch(texts, predict, names, puncs, size, overlap) == want


def test_punct_stitch_shuffles_texts_only(spark, tmp_path):
    """A row for each character in shuffles was more than the disk holds; repeated ids are one text, null ones have no labels."""
    docs = spark.createDataFrame([(1, "ab  " * 300), (2, "x" * 900), (2, "yz" * 350), (None, " no id " * 90), (3, None), (4, "")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["punct_stitch"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    rows = {x["doc_id"]: x["sentence_md5"] for x in got.collect()}
    assert set(rows) == {1, 2, None} and rows[None] == hashlib.md5((" no id " * 90).strip().encode()).hexdigest()
    # Position by position with the characters of both rows, and the votes of both.
    label, want = QUERIES["punct_stitch"].__globals__["_labels"], []
    for p in range(900):
        votes = {}
        for n, text in ((900, "x"), (700, "yz")):
            for w in range(max(0, -(-(n - 400) // 300)) + 1):
                if w * 300 <= p < min(w * 300 + 400, n) and (k := int(label(w, w * 300, "." * 400)[p - w * 300])):
                    votes.setdefault(k, []).append(w)
        k = max(votes, key=lambda k: (len(votes[k]), -min(votes[k])), default=0)
        behind = ["", ", ", "。 "][k]
        want += ["x" + behind] + (["yz"[p % 2] + behind] if p < 700 else [])
    assert rows[2] == hashlib.md5("".join(want).strip("\t\n\f\r ").encode()).hexdigest()
