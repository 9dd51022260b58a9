"""Every registered query on a folder of awkward tables, against a plain version of its contract."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from steleworks.llm.queries import QUERIES

from .helpers import awkward, brute_components, brute_spans, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")

COLUMNS = {
    "op1_matroska": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_suffixes": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op7_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op8_maxscore": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op9_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}

PAGES = [
    """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href="/">Home</a></header>
    <main><article class="post"><h1>Old stones found near the river</h1><p>The survey team found three inscribed stones near the river, and the largest of
    them bears a date that nobody expected.</p><ul><li>The first stone is grey granite &amp; weighs four tonnes.</li></ul></article>
    <section id="comments"><div class="comment"><p>Great article, thanks for sharing this with all of us here!</p></div></section></main>
    <aside class="sidebar"><ul><li><a href="#">Ten bridges to see</a></li></ul></aside><div class="cookie-notice">We use cookies to improve your experience.</div>
    <form action="/s"><label>Subscribe to our newsletter</label><input></form><footer><p>Copyright. All rights reserved.</p></footer><script>var x=1</script></body></html>""",
    """<html><body><div class="nav"><ul><li><a href=1>Start</a></li></ul></div><div class="content"><h2>Baking bread at home</h2><div>Mix flour and water, and leave
    the dough alone for an hour so that it can rest.</div><blockquote>Good bread takes time, and most of that time is waiting.</blockquote></div>
    <div class="ad-banner">Buy the best oven now, only 99 dollars, free delivery!</div><div class="footer">Imprint | Contact</div></body></html>""",
    None,
    "",
]
TEXTS = [
    "Old stones found near the river\nThe survey team found three inscribed stones near the river, and the largest of them bears a date that nobody expected.\nThe first stone is grey granite & weighs four tonnes.",
    "Baking bread at home\nMix flour and water, and leave the dough alone for an hour so that it can rest.\nGood bread takes time, and most of that time is waiting.",
    "",
    "",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    awkward(spark).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(k, "u", p) for k, p in enumerate(PAGES)], "page_id long, url string, html string").write.parquet(f"{to}/pages.parquet")
    vectors = [(k, [((k * 7 + j * 3) % 11) / 8.0 for j in range(8)], 1) for k in range(60)] + [(60, None, 1), (80, [float("nan")] * 8, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{to}/embeddings.parquet")
    return to


@pytest.fixture(scope="module")
def documents(spark, folder):
    return [(r["doc_id"], r["text"] or "", r["text"] is None) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def rows(spark, folder, name):
    """The rows of a query, after a look at its columns."""
    df = QUERIES[name](spark, folder)
    wanted = [c.split() for c in COLUMNS[name].split(", ")]
    assert [[f.name, f.dataType.simpleString()] for f in df.schema.fields][: len(wanted)] == wanted
    return [tuple(r)[: len(wanted)] for r in df.collect()]


def held(doc, modulus):
    return doc is not None and zlib.crc32(str(doc).encode()) % modulus == 2


def test_payloads(spark, folder, documents):
    want = []
    for doc, text, _ in documents:
        data = text.encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        want.append((doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    got = rows(spark, folder, "op1_matroska")
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert len({r[3] for r in got}) == len({r[3:] for r in got}) and all(r[5] > r[2] for r in got)


def test_languages(spark, folder, documents):
    got = rows(spark, folder, "op4_language_id")
    assert sorted((r[:2] for r in got), key=repr) == sorted(((d, held(d, 4)) for d, _, _ in documents), key=repr)
    letters = Counter((d, any(c.isalpha() for c in t)) for d, t, _ in documents)
    assert Counter((r[0], r[2] != "und") for r in got) == letters
    assert all(0 <= r[3] <= 1 and r[2] in ("de", "en", "es", "fr", "und") for r in got)


def test_near_duplicates(spark, folder, documents):
    prints = []
    for _, text, _ in documents:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    ids = [d for d, _, _ in documents]
    want = list(zip(ids, [f"{p:016x}" for p in prints], brute_components(ids, prints), strict=True))
    assert sorted(rows(spark, folder, "op5_simhash"), key=repr) == sorted(want, key=repr)


def test_repeated_strings(spark, folder, documents):
    data = [t.encode() for _, t, _ in documents]
    want = []
    for (doc, _, _), d, spans in zip(documents, data, brute_spans(data), strict=True):
        inside = {p for s, e in spans for p in range(s, e)}
        kept = bytes(x for p, x in enumerate(d) if p not in inside)
        want.append((doc, len(d), len(inside), len(spans), hashlib.sha256(kept).hexdigest()))
    assert sorted(rows(spark, folder, "op6_suffixes"), key=repr) == sorted(want, key=repr)


def test_hand_written_pages(spark, folder):
    got = sorted(rows(spark, folder, "op7_main_text"))
    assert [r[2] for r in got] == TEXTS and [r[3] for r in got] == [len(t) for t in TEXTS]


def test_exact_search(spark, folder):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    whole = {k: [math.floor(64 * x) for x in v] for k, v in vectors.items() if v is not None and all(math.isfinite(x) for x in v)}
    want = []
    for q in (k for k in whole if k % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), k) for k, v in whole.items() if k != q)[:20]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    assert sorted(rows(spark, folder, "op8_maxscore")) == sorted(want)


def test_packed_pieces(spark, folder, documents):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = Counter()
    for doc, text, _ in documents:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            piece = ids[k : k + 4096]
            want[doc, k // 4096, k, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))] += 1
    got = rows(spark, folder, "op9_packing")
    assert Counter(r[:5] for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r[5]].append((r[6], r[3]))
    for parts in placed.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(placed) == -(-sum(r[3] for r in got) // 4096)


def test_base_scores(spark, folder, documents):
    tokens = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for _, t, _ in documents]
    counts = Counter(x for (d, _, _), ts in zip(documents, tokens, strict=True) if not held(d, 7) for x in ts)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(((d, held(d, 7), len(ts), sum(counts[x] > 0 for x in ts), total), round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in ts), 4)) for (d, _, _), ts in zip(documents, tokens, strict=True) if d is not None)
    got = rows(spark, folder, "op10_lm_scoring")
    assert sorted((r[:5], round(r[5], 4)) for r in got if r[0] is not None) == want
    assert len(got) == len(documents) and all(r[6] < 0 for r in got)


def test_no_name_or_address_of_a_text_is_left(spark, folder, tmp_path):
    text = "Mail Maria Gonzalez at maria.gonzalez@mail.example.org or call +1 415 555 2671. " + prose(random.Random(1), 20)
    spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "plain words only")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op2_surrogates"](spark, str(tmp_path))
    got = {r["doc_id"]: r["text"] for r in df.collect()}
    assert got[1] == got[2] and got[5] == "plain words only" and not got[4]
    assert not re.search("Maria|Gonzalez|maria|415 555 2671", got[1]) and re.search(r"\S+@\S+\.\w+", got[1]) and re.search(r"\+\d", got[1])
    assert got[1].endswith(text[-40:])
