"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. An n-gram of three letters is bound as
roll(roll(a)) * roll(b) ... = P2(a) * P1(b) * c, a text is the sum (bundle) of its
n-gram vectors, and a language's prototype is the bundle of its labelled texts.
A text gets the language whose centred prototype has the largest cosine with the
text's centred bundle.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_is, slices, table

#: Length of the vectors and random seed.
DIMENSIONS, SEED = 512, 20240607
UNKNOWN = "und"
#: Bits of a code point in an n-gram's code; 0 is what separates words.
POINT = 21


@cache
def _letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for those that are no letters."""
    out = np.zeros(0x110000, np.uint32)
    alpha = np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)
    for cp in np.flatnonzero(alpha).tolist():
        out[cp] = ord(chr(cp).lower()[0])
    return out


def vectors(points: np.ndarray) -> np.ndarray:
    """The bipolar vectors of code points, each from a seeded hash of its own; int8."""
    words = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    x = (points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + words + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the text's distinct n-grams, ascending, and how often each occurs.

    Runs of characters that aren't letters count as one word separator; a text
    without letters has no n-gram.
    """
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    codes = np.concatenate([[0], _letters()[points], [0]]).astype(np.int64)
    codes = codes[(codes != 0) | (np.concatenate([[1], codes[:-1]]) != 0)]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique((codes[:-2] << 2 * POINT) | (codes[1:-1] << POINT) | codes[2:], return_counts=True)


_known: dict[int, int] = {}
_tables: list[np.ndarray] = []


def _places(points: np.ndarray) -> np.ndarray:
    """Where the vectors of the points are in the tables of all letters that the process has met: once, twice and never rolled."""
    found, own = np.unique(points, return_inverse=True)
    new = [p for p in found.tolist() if p not in _known]
    if new or not _tables:
        _known.update({p: len(_known) + k for k, p in enumerate(new)})
        letters = vectors(np.fromiter(_known, np.int64, len(_known)))
        _tables[:] = [np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters]
    return np.fromiter((_known[p] for p in found.tolist()), np.int64, len(found))[own]


def bundle(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the n-grams' vectors, whole numbers in float64."""
    out, mask = np.zeros(DIMENSIONS), (1 << POINT) - 1
    for at in range(0, len(found), 2048):
        f = found[at : at + 2048]
        a, b, c = np.split(_places(np.concatenate([f >> 2 * POINT, f >> POINT & mask, f & mask])), 3)
        bound = _tables[0][a] * _tables[1][b] * _tables[2][c]
        out += counts[at : at + 2048].astype(np.float64) @ bound.astype(np.float64) if counts.max() > 4096 else counts[at : at + 2048].astype(np.float32) @ bound.astype(np.float32)
    return out


class Model(NamedTuple):
    """languages, the mean direction of their profiles and the centred unit prototypes."""

    languages: list[str]
    centre: np.ndarray
    prototypes: np.ndarray


def train(labelled: DataFrame) -> Model:
    """Prototypes from every row of (text, lang); rows with a null lang are left out.

    A task adds up one bundle for each language, its n-grams counted batch by batch; bundles
    are summed by dimension. The driver gets DIMENSIONS numbers for each language.
    """

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for b in slices(batches, 256):
            parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).append(grams(text))
            for lang, own in parts.items():
                found, at = np.unique(np.concatenate([f for f, _ in own]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([n for _, n in own]), len(found))
                totals.setdefault(lang, np.zeros(DIMENSIONS))
                if len(found):
                    totals[lang] += bundle(found, counts)
        for lang, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(np.rint(total).astype(np.int64))], ["lang", "dim", "value"])

    rows = labelled.filter("lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = rows.mapInArrow(run, "lang string, dim int, value long").groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas()
    languages = sorted(sums["lang"].unique())
    if not languages:
        return Model([], np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)))
    raw = np.zeros((len(languages), DIMENSIONS))
    for k, lang in enumerate(languages):
        own = sums[sums["lang"] == lang]
        raw[k, own["dim"]] = own["value"]
    unit = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
    centre = unit.mean(0) if len(languages) > 1 else np.zeros(DIMENSIONS)
    centred = unit - centre
    return Model(languages, centre, centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is (1 + cosine) / 2, and 0 for `und`."""
    langs, scores = [], []
    for text in texts:
        found, counts = grams(text)
        if not len(found) or not model.languages:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        own = bundle(found, counts)
        own = own / max(np.linalg.norm(own), 1e-12) - model.centre
        cosines = model.prototypes @ (own / max(np.linalg.norm(own), 1e-12))
        best = int(np.argmax(cosines))
        langs.append(model.languages[best])
        scores.append(float(min(1.0, max(0.0, (1 + cosines[best]) / 2))))
    return langs, scores


def identify(docs: DataFrame, model: Model, keep=None, languages: str = "lang_pred", scores: str = "score") -> DataFrame:
    """docs with two more columns, the predicted language and its score.

    keep: a pyarrow-free test of (language, score); rows that fail it are left out.
    A null text, an empty one and one without letters give `und` with score 0, as
    does every text when no language was learned. Ties go to the first language in
    order of name. A column of docs named as an added one is replaced. Repeated rows give
    repeated results; very long texts are counted whole, one at a time; an empty table gives none.
    """
    rest = docs.drop(languages, scores)
    at = rest.columns.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields] + [f"`{languages}` string", f"`{scores}` double"])

    def run(batches):
        for b in slices(batches, 256):
            got, score = predict(model, b.column(at).to_pylist())
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, languages, scores])
            yield out if keep is None else out.filter(pa.array([keep(x, y) for x, y in zip(got, score, strict=True)], pa.bool_()))

    return rest.mapInArrow(run, schema)


def held_out_split(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", crc_is(F.col("doc_id"), 4, 2))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~crc_is(F.col("doc_id"), 4, 2)))
    found = identify(docs.select("doc_id", "text", crc_is(F.col("doc_id"), 4, 2).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: leaves out documents in which no language is found (`und`).

    The prototypes come from the labelled documents of its own input.
    """
    model = train(docs.filter(~crc_is(F.col("doc_id"), 4, 2)))
    # Nothing could be learned without labels; then every text with letters stays.
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return identify(docs, model, lambda lang, score: lang != UNKNOWN, "__lang_pred", "__score").select(*docs.columns)
