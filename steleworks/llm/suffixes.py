"""Removal of repeated byte strings, by a hash-compared suffix sort of anchored windows.

A window is a string of WINDOW bytes. Its anchor is its GRAM-byte piece with the
smallest hash, so equal windows have equal anchors at equal places, and windows in
a row mostly share theirs: a run. Work shrinks step by step, and every step keeps
all windows that may occur twice:

1. Runs with the same bytes (two 64-bit prefix hashes) are counted. A run that
   occurs twice is covered; a run whose anchor has no other run is clean.
2. The rest is cut into cells of CELL windows on a grid around the anchor. Windows
   of a cell share a core of bytes; a cell whose core occurs once is clean, one
   whose bytes occur twice is covered.
3. Different cells with the same core are sorted: suffixes that start at the same
   window of a core are merge-sorted, compared by the length of their common prefix,
   found by binary search over prefix polynomial hashes. Neighbours with WINDOW
   common bytes, compared byte by byte after that, are repeats.
4. Cores with more than LIMIT different cells are not gathered: their windows are
   counted by hash, pre-aggregated like every count above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parallelism, release, slices, table, unused

WINDOW, GRAM, CELL, LIMIT = 400, 32, 32, 128
#: Bytes that are hashed at a time, and the low bits of a key that hold a place in them.
BUFFER, PLACE = 1 << 19, 24

_rng = np.random.default_rng(400)
_BYTES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers_to(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base, its powers and those of its inverse modulo 2^64, up to n."""
    if not _powers or len(_powers[0][0]) <= n:
        size = max(n + 1, 2 * BUFFER)
        _powers.clear()
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 2**64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
            _powers.append((both[0], both[1]))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Prefix polynomial hashes of a buffer: of any piece, two hashes in constant time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.powers = _powers_to(len(data))
        self.sums = []
        for (up, _), values in zip(self.powers, _BYTES, strict=True):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * up[: len(data)], out=total[1:])
            self.sums.append(total)

    def of(self, start: np.ndarray, length, which: int = 0) -> np.ndarray:
        total = self.sums[which]
        return (total[start + length] - total[start]) * self.powers[which][1][start]

    def both(self, start, length, *salts) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the piece and of the salts."""
        out = []
        for which in range(2):
            h = mix(self.of(start, length, which) + np.uint64(which))
            for s in (*salts, length):
                h = mix(h ^ (np.asarray(s).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
            out.append(h.view(np.int64))
        return out[0], out[1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` values in a row."""
    pad = -len(x) % width
    b = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(b, 1).ravel()
    behind = np.minimum.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def buffers(texts: list[bytes], window: int = WINDOW, size: int = BUFFER):
    """(text number, offset in the text, start in the buffer, bytes) pieces with all windows, a list for each buffer."""
    now, used = [], 0
    for k, text in enumerate(texts):
        for base in range(0, max(1, len(text) - window + 1), size):
            piece = text[base : base + size + window - 1]
            if len(piece) < window:
                continue
            if used and used + len(piece) > size:
                yield now
                now, used = [], 0
            now.append((k, base, used, piece))
            used += len(piece)
    if now:
        yield now


def runs(pieces) -> dict[str, np.ndarray]:
    """The runs of windows with one anchor in a buffer: text, first and last window, anchor, its hash, and the run's hashes."""
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    prefix = Prefix(data)
    n = len(data) - WINDOW + 1
    grams = mix(prefix.of(np.arange(len(data) - GRAM + 1), GRAM))
    low = np.uint64((1 << PLACE) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(keys, WINDOW - GRAM + 1) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), [len(p[3]) for p in pieces])
    valid = owner[:n] == owner[WINDOW - 1 :]
    change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:n] != owner[: n - 1]) | (valid[1:] != valid[:-1])]))
    last = np.append(change[1:], n) - 1
    keep = valid[change]
    first, last = change[keep], last[keep]
    at, own = anchor[first], owner[first]
    c1, c2 = prefix.both(first, last - first + WINDOW, at - first)
    base = np.array([p[1] - p[2] for p in pieces])[own]
    return {"text": np.array([p[0] for p in pieces])[own], "first": first + base, "last": last + base, "anchor": at + base, "gram": grams[at].view(np.int64), "c1": c1, "c2": c2}


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and 128 bits (k1, k2) that name the pair: rows that repeat share them, others don't."""
    d, t = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(d.alias("doc_id"), t.alias("text"))
    return plain.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2"), "doc_id", "text")


_LONG = pa.int64()


def _batch(names: list[str], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.asarray(c, np.int64)) for c in columns], names)


def anchors(rows: DataFrame) -> DataFrame:
    """The runs of all texts: k1, k2, first, last, anchor, gram, c1, c2."""
    names = ["k1", "k2", "first", "last", "anchor", "gram", "c1", "c2"]

    def run(batches):
        for b in slices(batches, 1024):
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for pieces in buffers([t.encode() for t in b.column(2).to_pylist()]):
                r = runs(pieces)
                if len(r["text"]):
                    yield _batch(names, [k1[r["text"]], k2[r["text"]], *(r[k] for k in names[2:])])

    return rows.filter(F.octet_length("text") >= WINDOW).select("k1", "k2", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def contents(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of one occurrence of each wanted run: c1, c2, n, above (anchor - first), below (anchor - last), bytes."""
    names = ["c1", "c2", "n", "above", "below", "bytes"]
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "anchor", "c1", "c2", "n")).alias("asked"))

    def run(batches):
        for b in slices(batches, 128):
            cols = [[] for _ in names]
            for text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode()
                for w in want:
                    row = (w["c1"], w["c2"], w["n"], w["anchor"] - w["first"], w["anchor"] - w["last"], data[w["first"] : w["last"] + WINDOW])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            if cols[0]:
                yield _batch(names, [*cols[:5], pa.array(cols[5], pa.binary())])

    joined = rows.select("k1", "k2", "text").join(asked, ["k1", "k2"]).select("text", "asked")
    return joined.mapInArrow(run, "c1 long, c2 long, n long, above long, below long, bytes binary")


def cells(found: DataFrame) -> DataFrame:
    """The cells of each run: c1, c2, n, above, high and low (its windows, as distances of the anchor), core r1, r2 and own bytes x1, x2."""
    names = ["c1", "c2", "n", "above", "high", "low", "r1", "r2", "x1", "x2"]

    def run(batches):
        for b in slices(batches, 1024):
            c1, c2, n, above, below = (b.column(k).to_numpy() for k in range(5))
            raw = b.column(5).to_pylist()
            starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])[:-1].astype(np.int64)
            prefix = Prefix(np.frombuffer(b"".join(raw), np.uint8))
            many = above // CELL - below // CELL + 1
            row = np.repeat(np.arange(len(raw)), many)
            cell = (below // CELL)[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            high, low = np.minimum(above[row], cell * CELL + CELL - 1), np.maximum(below[row], cell * CELL)
            r1, r2 = prefix.both(starts[row] + above[row] - cell * CELL, np.full(len(row), WINDOW - CELL + 1), cell)
            x1, x2 = prefix.both(starts[row] + above[row] - high, high - low + WINDOW, high)
            yield _batch(names, [c1[row], c2[row], n[row], above[row], high, low, r1, r2, x1, x2])

    return found.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def common_prefix(prefix: Prefix, x: np.ndarray, y: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """How many bytes, at most `most`, agree from x and from y on: binary search over prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = prefix.of(x, mid) == prefix.of(y, mid)
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)
    return lo


def merge_sort(prefix: Prefix, starts: np.ndarray, kinds: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """An order of the suffixes by (kind, first `most` bytes): bottom-up mergesort, all runs of a width at once.

    A suffix finds its place in the neighbouring run by binary search; each
    comparison takes a logarithmic number of hash comparisons.
    """
    order = np.argsort(kinds, kind="stable")
    sorted_kinds = kinds[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_kinds[1:] != sorted_kinds[:-1]])) if len(order) else np.empty(0, np.int64)
    size = np.diff(np.append(begin, len(order)))
    begin, size = np.repeat(begin, size), np.repeat(size, size)
    width = 1
    while (act := np.flatnonzero(size > width)).size:
        index = act - begin[act]
        block = index // width
        other = (block ^ 1) * width
        lo = np.minimum(other, size[act])
        first, hi = lo.copy(), np.minimum(other + width, size[act])
        right = (block & 1).astype(bool)
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) >> 1
            x, y = starts[order[act[todo]]], starts[order[begin[act[todo]] + mid]]
            n = common_prefix(prefix, x, y, most)
            equal = n == most
            far = np.minimum(n, most - 1)
            less = np.where(equal, right[todo], prefix.data[y + far] < prefix.data[x + far])  # the other one goes first
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
        place = begin[act] + (block & ~1) * width + (index - block * width) + (lo - first)
        after = order.copy()
        after[place] = order[act]
        order, width = after, 2 * width
    return order


def repeated_windows(prefix: Prefix, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which of the suffixes share WINDOW bytes with another of their kind; hash matches are verified on the bytes."""
    order = merge_sort(prefix, starts, kinds)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(kinds[a] == kinds[b])
    near = near[common_prefix(prefix, starts[a[near]], starts[b[near]]) == WINDOW]
    out, reach = np.zeros(len(starts), bool), np.arange(WINDOW)
    for at in range(0, len(near), 4096):
        i, j = a[near[at : at + 4096]], b[near[at : at + 4096]]
        same = (prefix.data[starts[i][:, None] + reach] == prefix.data[starts[j][:, None] + reach]).all(1)
        out[i[same]] = out[j[same]] = True
    return out


def _window_rows(raw: list[bytes], high: np.ndarray, low: np.ndarray):
    """Prefix hashes of the cells' bytes; the cell of each window, its start in them and its distance from the anchor."""
    begin = np.concatenate([[0], np.cumsum([len(x) for x in raw])])[:-1].astype(np.int64)
    many = high - low + 1
    row = np.repeat(np.arange(len(raw)), many)
    step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    return Prefix(np.frombuffer(b"".join(raw), np.uint8)), row, begin[row] + step, high[row] - step


def _ranges(row: np.ndarray, distance: np.ndarray):
    """Maximal runs of falling distances within a row, as (row, high, low)."""
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (distance[1:] != distance[:-1] - 1)])) if len(row) else np.empty(0, np.int64)
    last = np.append(first[1:], len(row)) - 1
    return row[first], distance[first], distance[last[: len(first)]]


_COVERED = "c1 long, c2 long, high long, low long"


def sorted_cores(rows: DataFrame) -> DataFrame:
    """Repeated windows (c1, c2, high, low) of cells r1, r2, c1, c2, high, low, occ, bytes whose cores have at most LIMIT cells."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table):
            r1, r2, c1, c2, high, low, occ = (t.column(k).to_numpy() for k in range(7))
            prefix, row, start, distance = _window_rows(t.column(7).to_pylist(), high, low)
            core = np.cumsum(np.concatenate([[0], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])])).astype(np.int64)
            hit = repeated_windows(prefix, start, core[row] * 65_536 + distance) & (occ[row] == 1)
            k, h, lo = _ranges(row[hit], distance[hit])
            return _batch(["c1", "c2", "high", "low"], [c1[k], c2[k], h, lo])

        for b in slices(batches, 1024):
            # Rows come sorted by core: what is held ends where the last core begins.
            a1, a2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            start = int(np.argmax((a1 == a1[-1]) & (a2 == a2[-1])))
            if start:
                yield work(pa.Table.from_batches([*held, b.slice(0, start)]).combine_chunks())
                held = []
            elif held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (a1[0], a2[0]):
                yield work(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(b.slice(start))
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    n = parallelism(rows.sparkSession)
    return rows.repartition(n, "r1", "r2").sortWithinPartitions("r1", "r2").mapInArrow(run, _COVERED)


def counted_windows(rows: DataFrame) -> DataFrame:
    """The same for cores with more cells: each window is counted by its hashes."""
    names = ["w1", "w2", "c1", "c2", "high", "occ"]

    def run(batches):
        for b in slices(batches, 512):
            _, _, c1, c2, high, low, occ = (b.column(k).to_numpy() for k in range(7))
            prefix, row, start, distance = _window_rows(b.column(7).to_pylist(), high, low)
            w1, w2 = prefix.both(start, np.full(len(start), WINDOW))
            yield _batch(names, [w1, w2, c1[row], c2[row], distance, occ[row]])

    found = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    twice = found.groupBy("w1", "w2").agg(F.count("*").alias("times")).filter("times > 1")
    return found.filter("occ = 1").join(twice, ["w1", "w2"], "left_semi").select("c1", "c2", "high", F.col("high").alias("low"))


def merged(spans: DataFrame) -> DataFrame:
    """The maximal spans of (k1, k2, start, end), those that overlap or touch as one; a task holds one batch, however many spans a text has."""
    names = ["k1", "k2", "start", "end"]

    def run(batches):
        last: tuple[int, int, int, int] | None = None
        for b in batches:
            k1, k2, start, end = (b.column(i).to_numpy() for i in range(4))
            if last is not None:  # the span that is still open comes first
                k1, k2, start, end = (np.concatenate([[x], c]) for x, c in zip(last, (k1, k2, start, end), strict=True))
            if not len(k1):
                continue
            text = np.cumsum(np.concatenate([[0], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            # Ends so far, by text: places in a text are below 2^40.
            reach = np.maximum.accumulate((text << 40) + end)
            first = np.flatnonzero(np.concatenate([[True], (text << 40)[1:] + start[1:] > reach[:-1]]))
            stop = (reach & ((1 << 40) - 1))[np.append(first[1:], len(k1)) - 1]
            cols = [k1[first], k2[first], start[first], stop]
            last = tuple(int(c[-1]) for c in cols)
            yield _batch(names, [c[:-1] for c in cols])
        if last is not None:
            yield _batch(names, [[x] for x in last])

    return spans.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "start").mapInArrow(run, "k1 long, k2 long, start long, end long")


def covered(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(k1, k2, spans): for each text with a repeated window, the byte spans (start, end) that such windows cover."""
    runs_ = cut(anchors(rows))
    own = runs_.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "last", "anchor")).alias("at"))
    own = cut(own.select("gram", "c1", "c2", "n", "at.*"))
    several = own.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram")
    open_ = own.join(several, "gram", "left_semi").select("k1", "k2", "first", "last", "anchor", "c1", "c2", "n")
    raw = cut(contents(rows, open_))
    parts = cut(cells(raw))
    kinds = parts.groupBy("r1", "r2", "x1", "x2").agg(F.sum("n").alias("occ"), F.min(F.struct("c1", "c2", "above", "high", "low")).alias("at"))
    kinds = cut(kinds.select("r1", "r2", "x1", "x2", "occ", "at.*"))
    cores = kinds.groupBy("r1", "r2").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    rest = kinds.join(cores, ["r1", "r2"]).join(raw.select("c1", "c2", "bytes"), ["c1", "c2"])
    piece = F.expr("substring(bytes, cast(above - high + 1 as int), cast(high - low as int) + %d)" % WINDOW)
    rest = cut(rest.select("r1", "r2", "c1", "c2", "high", "low", "occ", piece.alias("bytes"), "kinds"))
    release(raw)
    again = kinds.filter("occ > 1").select("r1", "r2", "x1", "x2")
    whole = parts.filter("n = 1").join(again, ["r1", "r2", "x1", "x2"], "left_semi").select("c1", "c2", "high", "low")
    hit = sorted_cores(rest.filter(F.col("kinds") <= limit).drop("kinds")).unionByName(counted_windows(rest.filter(F.col("kinds") > limit).drop("kinds"))).unionByName(whole)
    # Runs that occur twice are covered from end to end; the others where their cells are.
    of_run = own.filter("n > 1").select("c1", "c2", (F.col("anchor") - F.col("first")).alias("high"), (F.col("anchor") - F.col("last")).alias("low")).unionByName(hit)
    spans = runs_.select("k1", "k2", "anchor", "c1", "c2").join(of_run, ["c1", "c2"])
    spans = spans.select("k1", "k2", (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + WINDOW).alias("end"))
    out = cut(merged(spans).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    release(runs_, own, parts, kinds, rest)
    return out


def maximal(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in spans:
        parts.append(data[at:s])
        at = e
    return b"".join([*parts, data[at:]])


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PASSAGES = ", n_passages long, n_passage_bytes long"


def digest(docs: DataFrame, words: int | None = None) -> DataFrame:
    """What is removed from each document (see DIGEST).

    With `words`, also the maximal spans, and their bytes, that strings of so many words
    cover which start elsewhere too, however few bytes they have; these are told, not removed.

    Null texts are empty; texts below WINDOW bytes stay whole. A row that repeats is
    another place where its strings start, so both go. Other columns don't matter.
    """
    rows = keyed(docs)
    found = covered(rows)
    if words:
        from .passages import covered as passages

        found = found.join(passages(rows, words).withColumnRenamed("spans", "passages"), ["k1", "k2"], "full")
    schema = DIGEST + PASSAGES if words else DIGEST
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in slices(batches, 512):
            out = []
            for doc, text, spans, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, spans = text.encode(), maximal(spans)
                rest = kept(data, spans)
                told = [x for m in map(maximal, more) for x in (len(m), sum(e - s for s, e in m))]
                out.append((doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), *told))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "kept_sha256" else _LONG) for c, n in zip(zip(*out, strict=True), names, strict=True)], names)

    return rows.join(found, ["k1", "k2"], "left").select("doc_id", "text", *found.columns[2:]).mapInArrow(run, schema)


def op6_suffixes(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), words=51)


def stage(spark, docs: DataFrame, sf_dir: str, words: int | None = None) -> DataFrame:
    """Pipeline stage: repeated strings go from the texts; a text of which nothing but white space is left goes whole.

    With `words`, strings of so many words that repeat go as well, however few bytes they have.
    Where a span ends inside a character, the whole character stays. Null and short texts
    stay as they are; other columns are kept, whatever their names.
    """
    k1, k2, cover = unused(docs.columns, "k1_", "k2_", "spans_")
    rows = keyed(docs)
    found = covered(rows)
    if words:
        from .passages import covered as passages

        found = found.unionByName(passages(rows, words)).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    at = [c for c in docs.columns if c != "text"]
    both = docs.withColumns({k1: F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))), k2: F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1), F.col("doc_id").cast("long"))})
    joined = both.join(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(cover)), [k1, k2], "left")

    def whole(data: bytes, s: int, e: int) -> tuple[int, int]:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        return s, e

    def run(batches):
        for b in slices(batches, 256):
            names = b.schema.names
            texts, spans = b.column(names.index("text")).to_pylist(), b.column(names.index(cover)).to_pylist()
            out, stays = [], []
            for text, s in zip(texts, spans, strict=True):
                if s:
                    data = text.encode()
                    text = kept(data, [whole(data, *x) for x in maximal(s)]).decode()
                out.append(text)
                stays.append(not s or bool(text.strip()))
            cols = [pa.array(out, pa.string()) if n == "text" else b.column(k) for k, n in enumerate(names) if n != cover]
            yield pa.RecordBatch.from_arrays(cols, [n for n in names if n != cover]).filter(pa.array(stays, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = joined.select(*docs.columns, cover).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in at else out
