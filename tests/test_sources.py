import io
import time

import numpy as np
from pyspark.sql import functions as F

from steleworks import schemas
from steleworks.operators import catalog
from steleworks.sources import readers, writers
from steleworks.streaming.status import run_status


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x\n"y"'), ("b", None)], schemas.TRANSCRIPTS)
    writers.csv(df.coalesce(1), f"{tmp_path}/c")
    text = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfdoc_id")
    assert {tuple(r) for r in readers.csv(spark, f"{tmp_path}/c").collect()} == {("a", 'x\n"y"'), ("b", None)}


def test_missing_input_is_empty(spark, tmp_path):
    assert readers.csv(spark, f"{tmp_path}/none").count() == 0
    assert readers.ids(spark, f"{tmp_path}/none").count() == 0


def test_status_log(spark, tmp_path):
    (tmp_path / "log.csv").write_text("filename,status\na.png,KEEP\n\nbroken\nb.png,ERROR:X,y\na.png,SKIP\n")
    assert {tuple(r) for r in readers.status_log(spark, f"{tmp_path}/log.csv").collect()} == {("a.png", "SKIP"), ("b.png", "ERROR:X,y")}


def test_ids_and_joined_text(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" 1 \n\n2\n1\n")
    assert {r[0] for r in readers.ids(spark, f"{tmp_path}/ids.txt").collect()} == {"1", "2"}
    assert readers.joined_text(spark, f"{tmp_path}/ids.txt").first()["value"] == "121"


def test_json_and_config(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": {"text": "q"}, "n": 2}')
    assert readers.json_documents(spark, f"{tmp_path}/x.json").select(F.variant_get("document", "$.a.text", "string")).first()[0] == "q"
    assert readers.config(spark, f"{tmp_path}/x.json", {"n": 1, "m": 5}) == {"a": {"text": "q"}, "n": 2, "m": 5}
    assert readers.config(spark, f"{tmp_path}/none.json", {"n": 1}) == {"n": 1}


def test_images_and_shards(spark, tmp_path):
    (tmp_path / "b.png").write_bytes(b"\x89PNG" + b"0" * 300)
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0" + b"0" * 300)
    (tmp_path / "small.png").write_bytes(b"\x89PNG")
    (tmp_path / "html.png").write_bytes(b"<html>" + b"0" * 300)
    assert [r["path"][-5:] for r in readers.images(spark, str(tmp_path)).collect()] == ["a.jpg", "b.png"]
    data = io.BytesIO()
    np.savez(data, images=np.zeros((3, 2, 2), np.uint8), labels=np.arange(3))
    (tmp_path / "s1.npz").write_bytes(data.getvalue())
    (tmp_path / "s2.npz").write_bytes(b"broken")
    assert [(r["label"], r["pixels"]) for r in readers.shards(spark, str(tmp_path)).orderBy("row").collect()] == [(0, [0] * 4), (1, [0] * 4), (2, [0] * 4)]


def test_writers(spark, tmp_path):
    empty = spark.createDataFrame([], "filename string, status string")
    assert not writers.results(empty, f"{tmp_path}/r")
    log = spark.createDataFrame([("a", "KEEP")], "filename string, status string")
    writers.append_log(log, f"{tmp_path}/log")
    writers.append_log(log, f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").count() == 2
    writers.texts(spark.createDataFrame([("d", "transcript", "ab"), ("d", "other", "c"), ("d", "other", "")], "doc_id string, text_type string, content string"), f"{tmp_path}/t")
    assert {(r["folder"], r["char_count"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("transcriptions", 2), ("texts", 1)}


def test_catalog(spark):
    docs = catalog.with_defaults(spark.createDataFrame([("a", None)], "doc_id string, status string"))
    row = docs.first()
    assert row["status"] == "pending" and row["retries"] == 0 and row["scraped_at"] is not None


def test_stream_resumes(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    at = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    spark.createDataFrame([(1, at(1), 7, "view"), (2, at(2), 7, "click")], schema).write.parquet(f"{tmp_path}/in")
    assert [tuple(r) for r in run_status(spark, f"{tmp_path}/in", f"{tmp_path}/s").collect()] == [(7, "click", 2)]
    spark.createDataFrame([(3, at(3), 7, "error"), (4, at(1), 8, "view")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # nothing is counted twice
        assert {tuple(r) for r in run_status(spark, f"{tmp_path}/in", f"{tmp_path}/s").collect()} == {(7, "error", 3), (8, "view", 1)}


def test_paged_list(spark, tmp_path):
    from steleworks.sources.paged import PagedList, until_empty

    for page, ids in {1: "ab", 2: "bc", 3: "", 4: "z"}.items():
        (tmp_path / f"{page}.html").write_text("".join(f"<a onclick=\"fnSearchDetailClick('{i}')\">" for i in ids))
    spark.dataSource.register(PagedList)
    rows = spark.read.format("paged_list").option("template", f"file://{tmp_path}/{{page}}.html").option("pages", "5").load()
    assert {(r["page"], r["item"], r["error"]) for r in rows.collect()} == {(1, "a", None), (1, "b", None), (2, "b", None), (2, "c", None), (3, None, None), (4, "z", None), (5, None, "URLError")}
    assert sorted(r["item"] for r in until_empty(rows).collect()) == ["a", "b", "c"]


def test_until_empty_stops_at_the_first_empty_page_and_passes_errors(spark):
    from steleworks.sources.paged import until_empty

    schema = "page int, ordinal int, item string, error string"
    some = lambda *rows: sorted(r["item"] for r in until_empty(spark.createDataFrame(list(rows), schema)).collect())
    assert some((1, None, None, None), (2, 0, "b", None), (3, 0, "c", None)) == []
    assert some((1, 0, "a", None), (2, None, None, "URLError"), (3, 0, "c", None), (4, None, None, None), (5, 0, "e", None)) == ["a", "c"]
    assert some((1, None, None, "URLError"), (2, 0, "b", None)) == ["b"]
    assert some() == []


def test_tree_and_paged_documents(spark, tmp_path):
    for name in ("b.txt", "a/z.txt", "a/c/y.txt", ".git/x", "d.txt"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text("x")
    assert [r["path"] for r in readers.tree(spark, str(tmp_path / "t")).collect()] == ["a", "a/c", "a/c/y.txt", "a/z.txt", "b.txt", "d.txt"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text('{"pages": [{"blocks": [{"type": 0, "lines": [{"spans": [{"text": " a ", "bbox": [0, 0, 1, 1], "size": 9}, {"text": " "}]}]}, {"type": 1, "bbox": [1, 2, 3, 4]}]}]}')
    (tmp_path / "p" / "2.json").write_text("broken")
    got = {(r["path"][-6:], r["kind"], r["text"], r["error"]) for r in readers.paged_documents(spark, str(tmp_path / "p")).collect()}
    assert got == {("1.json", "text", "a", None), ("1.json", "image", None, None), ("2.json", None, None, "ValueError")}


def test_status_log_in_blocks(spark, tmp_path):
    (tmp_path / "log.csv").write_text("".join(f"f{i % 7}.png,S{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {r["filename"]: r["status"] for r in readers.status_log(spark, f"{tmp_path}/log.csv").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {f"f{i % 7}.png": f"S{i}" for i in range(4993, 5000)}


def test_steps_are_isolated():
    from steleworks.plans.runner import run_steps

    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError

    got = run_steps({"a": lambda: 1 / 0, "b": flaky, "c": lambda: None}, ["a", "b"], attempts=3, wait=0.5, sleep=waits.append)
    assert got == {"a": "ERROR:ZeroDivisionError", "b": "ok", "c": "skipped"} and waits == [0.5, 1.0, 0.5, 1.0]


def test_json_texts_of_deep_documents(spark):
    from steleworks.operators.html import register_udtfs

    spark.udtf.register("json_texts", register_udtfs()["JsonTexts"])
    deep = "[" * 900 + '{"b": [{"text": "y"}], "text": "x", "a": {"text": "z"}}' + "]" * 900
    assert [r["text"] for r in spark.sql("SELECT h.text FROM (SELECT '" + deep + "' AS j), LATERAL json_texts(j) AS h ORDER BY h.ordinal").collect()] == ["x", "y", "z"]


def test_items_are_throttled():
    from steleworks.plans.runner import throttled

    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    got = []
    for x in throttled("abc", 2.0, clock=lambda: now[0], sleep=sleep):
        got.append(x)
        now[0] += 0.5 if x == "a" else 3.0
    assert got == ["a", "b", "c"] and waits == [1.5]


def test_connectors_and_settings(spark):
    from steleworks.plans.runner import connectors, settings

    names = ["steleworks.sources.paged:PagedList", "steleworks.sources.absent:X", "steleworks.sources.paged:Absent"]
    assert list(connectors(spark, names).values()) == ["ok", "missing", "missing"]
    spark.conf.set("spark.steleworks.margin", "9")
    try:
        assert settings(spark, {"margin": "5", "size": "256"}) == {"margin": "9", "size": "256"}
    finally:
        spark.conf.unset("spark.steleworks.margin")


def test_progress_of_a_stream(spark, tmp_path):
    from steleworks.streaming.progress import Progress

    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = Progress()
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        stream.awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        deadline = time.monotonic() + 10
        while not sum(seen.rows.values()) and time.monotonic() < deadline:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert list(seen.rows.values()) == [7]
