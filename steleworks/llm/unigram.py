"""SentencePiece encoding and decoding of giant documents by a max-plus parallel scan.

A segmentation's score is the sum of its pieces' scores, so the best one is a path in
the (max, +) semiring. A text is cut into chunks at fixed places. The state at a cut
is how many characters the piece that crosses it reaches over. For a chunk,
T[a, b] is the best score from state a at its start to state b at its end; these
transfer matrices are combined associatively, the states at all cuts are read off
the products, and every chunk is traced back on its own between its two states.

Between two characters that are neighbours in no piece there is one state only. At
such cuts, word starts above all, a chunk falls apart; the parts are solved once and
remembered, and only the ends of a chunk need its matrix.

Vocabularies that hold merge ranks have no log probabilities. There a piece of rank
r scores -log2(r + 2), in whole units of 1/64 as every score here: sums of whole
numbers are exact, and so the scan gives the same result however it is grouped.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, table

VOCABULARY, CHUNK, UNIT, SPACE = "piece_bpe_32k.model", 65_536, 64, "▁"
#: Chunks whose matrices are multiplied in one task; words whose segmentation a worker remembers, and the longest of them.
SPAN, WORDS, REMEMBERED = 64, 500_000, 64
#: What no path reaches.
NEVER = -(1 << 60)


class Pieces:
    """A vocabulary for segmentation: pieces with whole-number scores, and byte pieces for what they don't cover."""

    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: dict[int, int], names: list[str], longest: int, unknown: int):
        self.pieces, self.byte_ids, self.names, self.longest, self.unknown = pieces, byte_ids, names, longest, unknown
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # Scores of pieces, and None for what only pieces start with: a lookup that fails ends the search.
        self.starts: dict[str, int | None] = {p[:n]: None for p in pieces for n in range(1, len(p))}
        self.starts |= {p: score for p, (_, score) in pieces.items()}
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.spaced = all(p == SPACE + SPACE for p in self.pairs if p[1] == SPACE)
        self.bytes_of = [n.encode() for n in names]
        for b, k in byte_ids.items():
            self.bytes_of[k] = bytes([b])
        # A character in bytes scores once, with its first byte.
        self.scores = np.zeros(len(names), np.int64)
        for k, score in pieces.values():
            self.scores[k] = score
        for b, k in byte_ids.items():
            self.scores[k] = 0 if b & 0xC0 == 0x80 else unknown

    def ids(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        return np.array([found[0]] if found else [self.byte_ids[b] for b in piece.encode()], "<u4").tobytes()


@cache
def load(vocabulary: str = VOCABULARY) -> Pieces:
    """The pieces of a SentencePiece model file, given by path or by a public tokenizer's name."""
    import os

    from sentencepiece import sentencepiece_model_pb2

    if not os.path.exists(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(vocabulary, "rb") as f:
        proto.ParseFromString(f.read())
    ranked = proto.trainer_spec.model_type == 2
    pieces, byte_ids = {}, {}
    for k, p in enumerate(proto.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = k
        elif p.type == 1:
            # A rank below -1e8 marks pieces that no merge gives; they come last.
            rank = min(-p.score, float(len(proto.pieces)))
            pieces[p.piece] = (k, round(UNIT * (-math.log2(rank + 2) if ranked else p.score)))
    names = [p.piece for p in proto.pieces]
    unknown = min(s for _, s in pieces.values()) - 10 * UNIT
    return Pieces(pieces, byte_ids, names, max(map(len, pieces)), unknown)


def normalized(text: str | None) -> str:
    """As the model's own normaliser: a space in front, and spaces as marks. An empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def forward(v: Pieces, text: str, body: int, seeds: list[int]) -> tuple[list[int], list[int]]:
    """Best scores, from seeds[a] at each position a on, of every position, and the start of the last piece (-1: a seed).

    Pieces start before `body`, but may reach over it. A character that is no piece
    stands for its bytes. Of equal scores the one whose last piece is longest wins,
    as its start is met first; a seed comes from a start that is still before.
    """
    n, get, unknown = len(text), v.starts.get, v.unknown
    best = seeds[: n + 1] + [NEVER] * (n + 1 - len(seeds))
    back = [-1] * (n + 1)
    for at in range(body):
        here = best[at]
        if here <= NEVER:
            continue
        end = at + 1
        found = get(text[at:end], False)
        score = here + (found or unknown)
        if score > best[end]:
            best[end], back[end] = score, at
        while found is not False and end < n:
            end += 1
            found = get(text[at:end], False)
            if found:
                score = here + found
                if score > best[end]:
                    best[end], back[end] = score, at
    return best, back


def trace(v: Pieces, text: str, back: list[int], end: int) -> tuple[int, bytes]:
    """Where the path to `end` was seeded, and its ids."""
    out, known = [], v.parts
    while (start := back[end]) >= 0:
        piece = text[start:end]
        found = known.get(piece)
        if found is None:
            found = v.ids(piece)
            if len(known) < WORDS:
                known[piece] = found
        out.append(found)
        end = start
    return end, b"".join(out[::-1])


def solve(v: Pieces, word: str) -> bytes:
    """Ids of a text between two cuts."""
    found = v.words.get(word)
    if found is None:
        inner = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in v.pairs]
        if inner:
            marks = [0, *inner, len(word)]
            found = b"".join([solve(v, word[a:b]) for a, b in zip(marks, marks[1:], strict=False)])
        else:
            _, back = forward(v, word, len(word), [0])
            found = trace(v, word, back, len(word))[1]
        if len(word) <= REMEMBERED and len(v.words) < WORDS:
            v.words[word] = found
    return found


def score_of(v: Pieces, ids: bytes) -> int:
    return int(v.scores[np.frombuffer(ids, "<u4")].sum())


def cuts(v: Pieces, text: str, start: int, end: int) -> list[int]:
    """Positions in text[start:end] that no piece crosses."""
    return [i for i in range(max(1, start), end) if text[i - 1 : i + 1] not in v.pairs]


def encode(v: Pieces, text: str) -> bytes:
    """Ids of a normalised text, by itself, as little-endian 32-bit numbers."""
    if v.spaced and SPACE + SPACE not in text:
        words = [SPACE + w for w in text.split(SPACE)]
        words = words[1:] if text[:1] == SPACE else [words[0][1:], *words[1:]]
        known = v.words.get
        return b"".join([known(w) or solve(v, w) for w in words if w])
    marks = [0, *cuts(v, text, 0, len(text)), len(text)]
    return b"".join([solve(v, text[a:b]) for a, b in zip(marks, marks[1:], strict=False)])


def ends(v: Pieces, text: str, body: int) -> tuple[int, int] | None:
    """The first cut that every state at the chunk's start reaches, and the last cut in the chunk; None if they aren't in this order."""
    first = next((i for i in range(v.longest, body) if text[i - 1 : i + 1] not in v.pairs), body)
    last = next((i for i in range(body - 1, first, -1) if text[i - 1 : i + 1] not in v.pairs), 0)
    return (first, last) if first < last else None


def matrix(v: Pieces, text: str, body: int, last: bool) -> np.ndarray:
    """The transfer matrix of chunk text[:body]; text goes on with what the next chunk starts with.

    Rows: how far the piece before reaches into the chunk; columns: how far a piece
    reaches over its end. States beyond a chunk that is shorter pass through it.
    """
    states, found = v.longest, ends(v, text, body)
    out = np.full((states, states), NEVER, np.int64)
    if not found:
        for a in range(states):
            if a >= body:
                out[a, a - body] = 0
                continue
            best, _ = forward(v, text, body, [NEVER] * a + [0])
            for b in range(states):
                if body + b <= len(text) and not (last and b):
                    out[a, b] = best[body + b]
        return out
    # Every path meets both cuts: the matrix is a sum of two vectors and the score between them.
    x, y = found
    tail, _ = forward(v, text[y:], body - y, [0])
    after = np.array([tail[body - y + b] if body + b <= len(text) and not (last and b) else NEVER for b in range(states)], np.int64)
    before = np.array([forward(v, text[:x], x, [NEVER] * a + [0])[0][x] for a in range(states)], np.int64)
    return np.maximum(before[:, None] + score_of(v, encode(v, text[x:y])) + after[None, :], NEVER)


def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The (max, +) product; it is associative."""
    return np.maximum((x[:, :, None] + y[None, :, :]).max(1), NEVER)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The (max, +) product of matrices in a row, by pairs."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def prefixes(matrices: list[np.ndarray], first: np.ndarray | None = None) -> list[np.ndarray]:
    """The best score of each state at every cut, from the start of the text on; first: those at the first cut."""
    out = [np.where(np.arange(len(matrices[0])) == 0, 0, NEVER) if first is None else first]
    for m in matrices:
        out.append(np.maximum((out[-1][:, None] + m).max(0), NEVER))
    return out


def entries(v: Pieces, text: str, body: int, prefix: list[int]) -> list[int]:
    """For each state at the chunk's end, the state at its start from which the best path comes.

    Which of several best paths is taken depends on the state at the end, so these
    maps, composed from the last chunk to the first, give the states at all cuts.
    """
    if found := ends(v, text, body):
        first = found[0]
        _, back = forward(v, text[:first], first, prefix[: first + 1])
        return [trace(v, text, back, first)[0]] * v.longest
    best, back = forward(v, text, body, prefix)
    return [trace(v, text, back, body + b)[0] if body + b <= len(text) and best[body + b] > NEVER else 0 for b in range(v.longest)]


def composed(maps: list[list[int]]) -> list[int]:
    """The map over several chunks in a row."""
    out = list(range(len(maps[0])))
    for m in reversed(maps):
        out = [m[x] for x in out]
    return out


def boundary_states(maps: list[list[int]], last: int = 0) -> list[int]:
    """The state at every cut: `last` at the end, and then as the chunks' maps say."""
    out = [last]
    for m in reversed(maps):
        out.append(m[out[-1]])
    return out[::-1]


def trace_chunk(v: Pieces, text: str, body: int, entry: int, leave: int) -> bytes:
    """Ids of a chunk between its two states; the piece that crosses its end is its own."""
    if entry >= body:
        return b""
    if found := ends(v, text, body):
        x, y = found
        head, rest = text[entry:x], text[y:]
        return b"".join([trace(v, head, forward(v, head, x - entry, [0])[1], x - entry)[1], encode(v, text[x:y]), trace(v, rest, forward(v, rest, body - y, [0])[1], body + leave - y)[1]])
    rest = text[entry:]
    return trace(v, rest, forward(v, rest, body - entry, [0])[1], body + leave - entry)[1]


def decode(v: Pieces, ids: list[int]) -> str:
    """The text of ids, without the space in front; bytes that aren't UTF-8 are replaced.

    A space mark that stood in the text itself comes back as a space, as with any
    vocabulary of this kind; every other text is the same again.
    """
    out = b"".join(map(v.bytes_of.__getitem__, ids))
    text = out.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


def scan_encode(v: Pieces, text: str, chunk: int) -> bytes:
    """The whole scan in one process, as the query runs it over rows."""
    parts = [(text[at : at + chunk + v.longest - 1], min(chunk, len(text) - at), at + chunk >= len(text)) for at in range(0, len(text), chunk)]
    if not parts:
        return b""
    before = prefixes([matrix(v, *p) for p in parts])
    states = boundary_states([entries(v, t, n, p.tolist()) for (t, n, _), p in zip(parts, before, strict=False)])
    return b"".join([trace_chunk(v, t, n, a, b) for (t, n, _), a, b in zip(parts, states, states[1:], strict=False)])


CODED = "doc_id long, n_tokens long, score long, ids binary, chunks int"


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, score, ids, chunks) of each text; ids are little-endian 32-bit numbers.

    Texts of up to `chunk` characters are one chunk. Longer ones are dealt out by
    chunk, wherever they come from: their matrices, some hundred numbers a chunk, are
    multiplied by blocks of SPAN chunks and the products by document; scores and states go
    back the same way. Null and empty texts have no ids, an empty table no rows. Repeated
    rows are coded each for itself. Other columns don't matter.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "n_tokens", "score", "ids", "chunks"]

    def short(batches):
        v = load(vocabulary)
        for b in slices(batches, 512):
            got = [encode(v, normalized(t)) for t in b.column(1).to_pylist()]
            cols = [pa.array([len(i) // 4 for i in got], pa.int64()), pa.array([score_of(v, i) for i in got], pa.int64()), pa.array(got, pa.binary()), pa.array([1] * len(got), pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    size = F.length("text") + 1  # with the space in front
    one = rows.filter(size <= chunk).mapInArrow(short, CODED)
    # A number for each long row, stored with its chunks before anything else looks at it.
    longs = rows.filter(size > chunk).withColumn("row", F.monotonically_increasing_id())
    marked = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    longest = load(vocabulary).longest
    parts = longs.select("row", "doc_id", size.alias("n"), marked.alias("t"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int"))).alias("k"))
    parts = parts.select("row", "doc_id", "k", F.least(F.lit(chunk), F.col("n") - F.col("k") * chunk).alias("body"), (F.col("n") <= (F.col("k") + 1) * chunk).alias("last"), F.substring("t", F.col("k") * chunk + 1, F.lit(chunk + longest - 1)).alias("t"))
    parts = cut(parts)

    def transfer(batches):
        v = load(vocabulary)
        for b in slices(batches, 64):
            row, _, k, body, last, t = (c.to_pylist() for c in b.columns)
            made = [matrix(v, x, n, z).astype("<i8").tobytes() for x, n, z in zip(t, body, last, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(k, pa.int32()), pa.array(made, pa.binary())], ["row", "k", "m"])

    matrix_of = lambda x: np.frombuffer(x, "<i8").reshape(longest, longest)
    ordered = lambda xs, key: sorted(xs, key=lambda x: x[key])

    def multiply(batches):
        for b in slices(batches, 16):
            made = [product([matrix_of(x["m"]) for x in ordered(ms, "k")]).astype("<i8").tobytes() for ms in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["row", "block", "m"])

    def scan(batches):
        for b in slices(batches, 16):
            for row, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ms = ordered(ms, "block")
                found = prefixes([matrix_of(x["m"]) for x in ms])[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(ms), pa.int64()), pa.array([x["block"] for x in ms], pa.int32()), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], ["row", "block", "first"])

    def spread_out(batches):
        for b in slices(batches, 16):
            for row, ms, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ms = ordered(ms, "k")
                found = prefixes([matrix_of(x["m"]) for x in ms], np.array(first, np.int64))[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(ms), pa.int64()), pa.array([x["k"] for x in ms], pa.int32()), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], ["row", "k", "prefix"])

    def choose(batches):
        v = load(vocabulary)
        for b in slices(batches, 64):
            row, k, body, t, prefix = (c.to_pylist() for c in b.columns)
            maps = [entries(v, x, n, p) for x, n, p in zip(t, body, prefix, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(k, pa.int32()), pa.array(maps, pa.list_(pa.int32()))], ["row", "k", "map"])

    def compose(batches):
        for b in slices(batches, 16):
            made = [composed([x["map"] for x in ordered(ms, "k")]) for ms in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int32()))], ["row", "block", "map"])

    def leave(batches):
        for b in slices(batches, 16):
            for row, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ms = ordered(ms, "block")
                s = boundary_states([x["map"] for x in ms])
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(ms), pa.int64()), pa.array([x["block"] for x in ms], pa.int32()), pa.array(s[1:], pa.int32())], ["row", "block", "last"])

    def states(batches):
        for b in slices(batches, 16):
            for row, ms, last in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ms = ordered(ms, "k")
                s = boundary_states([x["map"] for x in ms], last)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(ms), pa.int64()), pa.array([x["k"] for x in ms], pa.int32()), pa.array(s[:-1], pa.int32()), pa.array(s[1:], pa.int32())], ["row", "k", "entry", "leave"])

    def back(batches):
        v = load(vocabulary)
        for b in slices(batches, 64):
            row, doc, k, body, t, entry, leave = (c.to_pylist() for c in b.columns)
            got = [trace_chunk(v, x, n, a, z) for x, n, a, z in zip(t, body, entry, leave, strict=True)]
            cols = [pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array([score_of(v, i) for i in got], pa.int64()), pa.array(got, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "k", "score", "ids"])

    def joined(batches):
        for b in slices(batches, 16):
            ids = [b"".join([x["ids"] for x in ordered(all_, "k")]) for all_ in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), b.column(1), pa.array(ids, pa.binary()), b.column(3)], names)

    # Up: chunks' matrices are multiplied by blocks, blocks' products give the scores at the blocks' starts; down: those at all cuts.
    block = F.floor(F.col("k") / SPAN).cast("int").alias("block")
    by_block = lambda df, *cols: df.groupBy("row", block).agg(F.collect_list(F.struct(*cols)).alias("xs"))
    by_row = lambda df, *cols: df.groupBy("row").agg(F.collect_list(F.struct(*cols)).alias("xs"))
    spread = parts.repartition(parts.sparkSession.sparkContext.defaultParallelism * 4, "row", "k")
    matrices = cut(spread.mapInArrow(transfer, "row long, k int, m binary"))
    starts = by_row(by_block(matrices, "k", "m").mapInArrow(multiply, "row long, block int, m binary"), "block", "m").mapInArrow(scan, "row long, block int, first array<long>")
    before = by_block(matrices, "k", "m").join(starts, ["row", "block"]).select("row", "xs", "first").mapInArrow(spread_out, "row long, k int, prefix array<long>")
    # The same from the end for the states that paths go through.
    maps = cut(parts.join(before, ["row", "k"]).select("row", "k", "body", "t", "prefix").mapInArrow(choose, "row long, k int, map array<int>"))
    lasts = by_row(by_block(maps, "k", "map").mapInArrow(compose, "row long, block int, map array<int>"), "block", "map").mapInArrow(leave, "row long, block int, last int")
    at = by_block(maps, "k", "map").join(lasts, ["row", "block"]).select("row", "xs", "last").mapInArrow(states, "row long, k int, entry int, leave int")
    traced = parts.join(at, ["row", "k"]).select("row", "doc_id", "k", "body", "t", "entry", "leave").mapInArrow(back, "row long, doc_id long, k int, score long, ids binary")
    whole = traced.groupBy("row", "doc_id").agg(F.sum("score").alias("score"), F.collect_list(F.struct("k", "ids")).alias("all"), F.count("*").cast("int").alias("chunks"))
    many = whole.select("doc_id", "score", "all", "chunks").mapInArrow(joined, CODED)
    return one.unionByName(many)


def decoded(codes: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of ids as encoded() gives them."""

    def run(batches):
        v = load(vocabulary)
        for b in slices(batches, 512):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(v, np.frombuffer(x, "<u4").tolist()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return codes.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_unigram(spark, sf_dir: str) -> DataFrame:
    """Ids of every text and, from these, the decoded text's digest."""

    def run(batches):
        v = load()
        for b in slices(batches, 512):
            ids = b.column(3).to_pylist()
            texts = [decode(v, np.frombuffer(x, "<u4").tolist()).encode() for x in ids]
            cols = [*b.columns[:3], b.column(4), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in texts], pa.int64()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "score", "chunks", "ids_crc32", "text_crc32", "n_bytes"])

    return encoded(table(spark, sf_dir, "documents")).mapInArrow(run, "doc_id long, n_tokens long, score long, chunks int, ids_crc32 long, text_crc32 long, n_bytes long")
