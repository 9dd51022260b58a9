"""Scoring by a log-bilinear language model trained with noise-contrastive estimation.

The ORDER words before a place predict its token: u = sum over j of c_j * r(word j before),
with weights c_j of each position. The vocabulary is decomposed into clusters of tokens that
are spelled alike, so every token, an unseen one too, has a cluster, and

    P(w | h) = P(cluster | u) * P(member | cluster, u) [* P(w | the cluster's other tokens)].

The first two are log-bilinear, s = u . q + b, normalised by matrix products over all
clusters and over all members of the cluster. Members are the most frequent tokens, whose
number grows with the vocabulary, and one for the cluster's other tokens; among these the
add-one share of exact counts decides, in which an unseen token has the share of count 0.

Every task trains on its own documents, in minibatches of all its windows with drawn noise,
from one and the same start; the tasks' parameters are averaged row by row, weighted by how
often a row was trained (parameter mixing). Counts are exact and cover all training texts.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, crc_is, cut, table

#: Words before a place that predict it; length of the representations; members are WIDEN times the root of the vocabulary's size.
ORDER, WIDTH, WIDEN = 3, 32, 8
#: Tokens whose counts the workers hold; those of other tokens are joined.
HELD = 200_000
#: Windows in a minibatch, noise for clusters and for members, size of the steps.
BATCH, NOISE, INNER, RATE, SEED = 8192, 32, 16, 0.1, 1
#: Spelling: letter trigrams fall into so many slots, each with a random vector of so many numbers.
SLOTS, SPELLED, TURNS = 4096, 32, 10
#: A longer token is known by a digest, which no other token equals as it is longer than this, too.
LONGEST = 64
#: Values of a row that are added one after another.
PIECE = 16
#: Places that are sorted by cluster and those that are scored at a time, bytes of text that are laid out at a time, and rows of the parameters that travel together.
PLACES, STRIP, TEXT, BLOCK = 32_768, 4096, 4 << 20, 2048
#: The token that ends a text; no word is empty.
END = b""


def key_of(word: bytes) -> bytes:
    """What stands for a word: itself, or LONGEST + 1 bytes with its digest."""
    return word if len(word) <= LONGEST else bytes(LONGEST - 31) + hashlib.blake2b(word, digest_size=32).digest()


def byte_strings(strings: pa.StringArray | pa.BinaryArray) -> list[bytes]:
    """The strings as UTF-8; to_pylist() takes several times as long."""
    _, offsets, data = strings.buffers()
    if not len(strings):
        return []
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    whole = data.to_pybytes() if data is not None else b""
    return [whole[s:e] for s, e in zip(at, at[1:])]  # noqa: B905


def coded(texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """The distinct keys of the texts' words, A-Z in lower case; each word's place among them; where each text's words begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten().dictionary_encode()
    own, codes = found.dictionary.cast(pa.binary()), found.indices.to_numpy(zero_copy_only=False)
    at, sizes = lists.offsets.to_numpy().astype(np.int64), pc.binary_length(own).to_numpy(zero_copy_only=False)
    if len(none := np.flatnonzero(sizes == 0)):  # before white space at the start and behind that at the end
        real = codes != none[0]
        at, codes = np.concatenate([[0], np.cumsum(real)])[at - at[0]], codes[real]
    if (long_ := sizes > LONGEST).any():
        own = pc.replace_with_mask(own, pa.array(long_), pa.array([key_of(w) for w in own.filter(pa.array(long_)).to_pylist()], pa.binary()))
    return own, codes.astype(np.int64), at - at[0]


def words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """coded(), the keys as bytes."""
    own, codes, at = coded(texts)
    return byte_strings(own), codes, at


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over all rows of (text), the ends included; tokens are keys."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

        for b in (part for batch in batches for part in by_bytes(batch, 0, TEXT)):
            own, codes, _ = words(b.column(0))
            for word, n in zip(own, np.bincount(codes, minlength=len(own)).tolist(), strict=True):
                if n:
                    counts[word] += n
            counts[END] += b.num_rows
            if len(counts) > 250_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def spelled(tokens: list[bytes]) -> np.ndarray:
    """Unit vectors of tokens from their trigrams, the ends marked; zeros for END."""
    slots = np.random.default_rng(SEED).normal(size=(SLOTS, SPELLED)).astype(np.float32)
    data = np.frombuffer(b"\x02" + b"\x03\x02".join(tokens) + b"\x03", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    h = data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)
    h = ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(16) & np.uint32(SLOTS - 1)
    begin = np.cumsum(sizes + 2) - sizes - 2
    out, order = np.zeros((len(tokens), SPELLED), np.float32), np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), 8192):
        part = order[at : at + 8192]
        total = np.zeros((len(part), SPELLED), np.float32)
        for k in range(int(sizes[part[0]])):  # the k-th trigram of all that have one, the longest tokens first
            some = part[: np.searchsorted(-sizes[part], -k, "left")]
            total[: len(some)] += slots[h[begin[some] + k]]
        out[part] = total
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def centroids(tokens: list[bytes], weights: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means over the tokens' spelling."""
    x, rng = spelled(tokens), np.random.default_rng(SEED)
    out = x[rng.choice(len(x), count, replace=False, p=weights / weights.sum())]
    for _ in range(TURNS):
        own = (x @ out.T).argmax(1)
        order = np.argsort(own, kind="stable")
        found, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat((x * weights[:, None].astype(np.float32))[order], first)
        out[found] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    return out


class Vocabulary(NamedTuple):
    """held: key to (count, row), the row's complement where the token is no member; rows are those of members, cluster by cluster, the other tokens' last.

    start: first row of each cluster and the end; mass: each cluster's sum of count + 1 over its other tokens, an
    unseen one included; weight: each row's count; tokens, types: of the training texts.
    """

    held: dict[bytes, tuple[int, int]]
    centroids: np.ndarray
    start: np.ndarray
    mass: np.ndarray
    weight: np.ndarray
    tokens: int
    types: int

    @property
    def total(self) -> int:
        """The denominator of the add-one unigram."""
        return self.tokens + self.types + 1

    @property
    def cluster(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def others(self, tokens: list[bytes]) -> np.ndarray:
        """The clusters of tokens that are no members."""
        return (spelled(tokens) @ self.centroids.T).argmax(1) if tokens else np.zeros(0, np.int64)

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        """Each token's row: its own, or that of its cluster's other tokens."""
        return Lookup(self).find(pa.array(tokens, pa.binary())).row


class Found(NamedTuple):
    """For each of some keys: whether it is held, whether it is a member, its count (0, if not held) and its row."""

    known: np.ndarray
    member: np.ndarray
    count: np.ndarray
    row: np.ndarray


class Lookup:
    """The held tokens in Arrow's arrays, in which many keys are looked up at a time; voc: the vocabulary without them, to be sent to workers."""

    def __init__(self, voc: Vocabulary):
        self.voc, self.keys = voc._replace(held={}), pa.array(list(voc.held), pa.binary())
        self.count, self.row = np.array(list(voc.held.values()), np.int64).T.copy()

    def find(self, keys: pa.BinaryArray) -> Found:
        at = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy(zero_copy_only=False)
        known, row = at >= 0, self.row[at]
        member, count, row = known & (row >= 0), np.where(known, self.count[at], 0), np.maximum(row, ~row)
        new = np.flatnonzero(~known)
        row[new] = self.voc.start[self.voc.others(byte_strings(keys.take(pa.array(new)))) + 1] - 1
        return Found(known, member, count, row)


def vocabulary(seen: DataFrame, held: int = HELD, widen: int = WIDEN) -> Vocabulary:
    """The vocabulary of the counts `seen` (token, n). The driver gets the most frequent tokens and two sums a cluster."""
    n, types = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    members = max(1, min(types, widen * math.isqrt(types)))
    top = seen.orderBy(F.desc("n"), "token").limit(max(held, members)).toArrow()
    tokens, counts = top.column("token").to_pylist() or [END], top.column("n").to_numpy().astype(np.int64) if len(top) else np.zeros(1, np.int64)
    own, clusters = tokens[:members], math.isqrt(members)
    centre = centroids(own, np.sqrt(counts[:members] + 1.0), clusters)
    cluster = (spelled(own) @ centre.T).argmax(1)
    # A cluster's members are in a row; each cluster before has one row more.
    order = np.argsort(cluster, kind="stable")
    row = np.empty(members, np.int64)
    row[order] = np.arange(members) + cluster[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(cluster, minlength=clusters) + 1)])
    beside = ~(start[(spelled(tokens[members:]) @ centre.T).argmax(1) + 1] - 1) if tokens[members:] else row[:0]
    known = {t: (c, r) for t, c, r in zip(tokens, counts.tolist(), [*row.tolist(), *beside.tolist()], strict=True)}
    inside = set(own)

    def others(batches):
        sums = np.zeros((clusters, 2), np.int64)
        for b in batches:
            rest = [i for i, t in enumerate(b.column(0).to_pylist()) if t not in inside]
            tokens = b.column(0).take(pa.array(rest, pa.int64())).to_pylist()
            times = b.column(1).to_numpy()[rest]
            if rest:
                k = (spelled(tokens) @ centre.T).argmax(1)
                np.add.at(sums, k, np.stack([times + 1, times], 1))
        yield pa.RecordBatch.from_arrays([pa.array(range(clusters), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["cluster", "mass", "n"])

    mass, weight = np.ones(clusters), np.zeros(int(start[-1]))
    weight[row] = counts[:members]
    for k, m, c in seen.mapInArrow(others, "cluster int, mass long, n long").groupBy("cluster").agg(F.sum("mass"), F.sum("n")).collect():
        mass[k] += m
        weight[start[k + 1] - 1] = c
    return Vocabulary(known, centre, start, mass, weight, int(n), int(types))


def laid_out(texts: pa.Array) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts in a row, each with ORDER ends before it and one behind.

    The distinct keys, END the last; each place's key; which places are predicted; the
    number of the text of each of these.
    """
    own, codes, at = coded(texts)
    sizes, many = np.diff(at), len(at) - 1
    line = np.full(len(codes) + (ORDER + 1) * many, len(own), np.int64)
    owner = np.repeat(np.arange(many), sizes)
    line[np.arange(len(codes)) + (ORDER + 1) * owner + ORDER] = codes
    asked = np.ones(len(line), bool)
    begin = at[:-1] + (ORDER + 1) * np.arange(many)
    asked[(begin[:, None] + np.arange(ORDER)).ravel()] = False
    return pa.concat_arrays([own, pa.array([END], pa.binary())]), line, np.flatnonzero(asked), np.repeat(np.arange(many), sizes + 1)


class Parameters:
    """One matrix of representations and biases: rows as contexts, rows as targets, clusters, positions."""

    def __init__(self, voc: Vocabulary, values: np.ndarray | None = None):
        self.voc, self.cluster = voc, voc.cluster
        n, k = len(self.cluster), len(voc.start) - 1
        first = np.bincount(self.cluster, voc.weight, k) + 1
        self.noise = first / first.sum()
        inner = voc.weight + 0.5
        self.within = inner / np.add.reduceat(inner, voc.start[:-1])[self.cluster]
        self.log_noise, self.log_within = np.log(self.noise).astype(np.float32), np.log(self.within).astype(np.float32)
        if values is None:
            values = np.random.default_rng(SEED).normal(0, 0.1, (2 * n + k + ORDER, WIDTH + 1)).astype(np.float32)
            values[:, -1] = np.concatenate([np.zeros(n), self.log_within, self.log_noise, np.zeros(ORDER)])
            values[2 * n + k :, :-1] = (1 / np.arange(1, ORDER + 1))[:, None]
        self.values, self.n, self.k = values, n, k
        self.before, self.after, self.outer, self.place = values[:n, :-1], values[n : 2 * n, :-1], values[2 * n : 2 * n + k, :-1], values[2 * n + k :, :-1]
        self.bias, self.outer_bias = values[n : 2 * n, -1], values[2 * n : 2 * n + k, -1]

    def groups(self, clusters: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(cluster, first, end) of the runs of ascending clusters."""
        first = np.flatnonzero(np.concatenate([[True], clusters[1:] != clusters[:-1]])) if len(clusters) else np.zeros(0, np.int64)
        yield from zip(clusters[first].tolist(), first.tolist(), [*first[1:].tolist(), len(clusters)], strict=True)

    def log_probabilities(self, line: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """ln P(row | the ORDER rows before) at each asked place of a line of rows, normalised over the clusters and over the members of the row's cluster."""
        out = np.empty(len(asked))
        # With their last columns: that of the first position is 1 here, which adds the biases.
        moved = list(self.values[: self.n] * self.values[2 * self.n + self.k :, None])
        moved[0][:, -1] = 1
        outer, after = np.ascontiguousarray(self.values[2 * self.n : 2 * self.n + self.k].T), self.values[self.n : 2 * self.n]
        for at in range(0, len(asked), PLACES):
            places = asked[at : at + PLACES]
            order = _order(line[places])
            places = places[order]
            r = line[places]
            u = moved[0].take(line[places - 1], 0)
            for j in range(1, ORDER):
                u += moved[j].take(line[places - j - 1], 0)
            a = self.cluster[r]
            value = np.empty(len(r))
            for s in range(0, len(r), STRIP):  # what is small stays in the cache
                value[s : s + STRIP] = _log_share(u[s : s + STRIP] @ outer, a[s : s + STRIP])
            for k, s, e in self.groups(a):
                own = slice(self.voc.start[k], self.voc.start[k + 1])
                value[s:e] += _log_share(u[s:e] @ after[own].T, r[s:e] - own.start)
            out[at + order] = value
        return out


def _log_share(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of s[i, at[i]]'s share of its row; s is overwritten."""
    if (top := s.max()) > 60:
        s -= top
        np.maximum(s, -100, out=s)
    own = s[np.arange(len(s)), at]
    np.exp(s, out=s)
    return own - np.log(s @ np.ones(s.shape[1], s.dtype))


def _odds(s: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(s)); s is overwritten."""
    np.clip(s, -30, 30, out=s)
    np.exp(s, out=s)
    s += 1
    return np.divide(np.float32(1), s, out=s)


def _starts(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))


def _order(rows: np.ndarray) -> np.ndarray:
    """The stable order of the rows; numbers of 16 bits are sorted by radix."""
    return np.argsort(rows.astype(np.uint16) if len(rows) and rows.max() < 65_536 else rows, kind="stable")


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, ascending, and the sums of their values."""
    order = _order(rows)
    ordered = rows[order]
    first = _starts(ordered)
    size = np.diff(np.append(first, len(rows)))
    # A row's values are added in pieces of PIECE at the most, the k-th of all pieces that have one at once, the longest pieces first.
    many = -(-size // PIECE)
    run, at = np.repeat(np.arange(len(first)), many), np.cumsum(many) - many
    begin = first[run] + PIECE * (np.arange(len(run)) - at[run])
    long_ = np.minimum(PIECE, first[run] + size[run] - begin)
    down = _order(PIECE - long_)
    begin, longer = begin[down], len(down) - np.cumsum(np.bincount(long_, minlength=PIECE + 1))
    sums = values.take(order[begin], 0)
    for k in range(1, int(long_.max())):
        sums[: longer[k]] += values.take(order[begin[: longer[k]] + k], 0)
    pieces = np.empty_like(sums)
    pieces[down] = sums
    out, several = pieces.take(at, 0), np.flatnonzero(many > 1)
    if len(several):
        part = np.flatnonzero((many > 1)[run])
        out[several] = np.add.reduceat(pieces.take(part, 0), _starts(run[part]), axis=0)
    return ordered[first], out


class Trainer:
    """Noise-contrastive estimation by AdaGrad, with one step size for a row; trained: how often each row was.

    The data's log odds against k draws of the noise q are s - ln(k q). The noise is drawn
    for a minibatch: clusters by their counts, and for each cluster members by theirs.
    """

    def __init__(self, model: Parameters, seed: int):
        self.m, self.rng = model, np.random.default_rng([SEED, seed])
        self.squares = np.full(len(model.values), 1e-8, np.float32)
        self.trained = np.zeros(len(model.values), np.float32)
        self.upto = np.cumsum(model.within)
        self.shift = model.log_noise + np.float32(math.log(NOISE))
        self.shift_within = model.log_within + np.float32(math.log(INNER))

    def _update(self, rows: np.ndarray, slope: np.ndarray, rate: float) -> None:
        self.squares[rows] += np.einsum("bw,bw->b", slope[:, :-1], slope[:, :-1]) / np.float32(WIDTH)
        slope *= (rate / np.sqrt(self.squares[rows]))[:, None]
        slope[:, -1] *= 0.1
        self.m.values[rows] = self.m.values.take(rows, 0) - slope
        self.trained[rows] += 1

    def step(self, contexts: np.ndarray, rows: np.ndarray, rate: float) -> None:
        """All rows of parameters are taken with their last column: u has a 1 there, which adds the biases and sums their slopes; contexts and positions have 0."""
        m, rng, start = self.m, self.rng, self.m.voc.start
        order = _order(rows)
        rows, contexts = rows.take(order), contexts.take(order, 1)
        a, x = m.cluster[rows], m.values.take(contexts.ravel(), 0).reshape(ORDER, len(rows), WIDTH + 1)
        place = m.values[2 * m.n + m.k :]
        u = np.einsum("jbw,jw->bw", x, place)
        u[:, -1] = 1
        # Rows are sorted, and so are their clusters. What a run of a cluster is compared with, the cluster itself among it, is one matrix.
        groups = list(m.groups(a))
        own = np.array([k for k, _, _ in groups])
        lo, hi = start[own], start[own + 1]
        base = np.where(lo > 0, self.upto[lo - 1], 0.0)
        drawn = np.broadcast_to(rng.choice(m.k, NOISE, p=m.noise), (len(own), NOISE))
        asked = base[:, None] + rng.random((len(own), INNER)) * (self.upto[hi - 1] - base)[:, None]
        inner = np.clip(np.searchsorted(self.upto, asked), lo[:, None], hi[:, None] - 1)
        outer = np.concatenate([drawn, own[:, None]], 1)
        noise = m.values.take(np.concatenate([2 * m.n + outer, m.n + inner], 1), 0)
        shifted = -noise
        shifted[:, :, -1] += np.concatenate([self.shift[outer], self.shift_within[inner]], 1)
        bad, added = np.empty((len(rows), noise.shape[1]), np.float32), np.empty_like(noise)
        for (_, s, e), q in zip(groups, shifted, strict=True):
            np.matmul(u[s:e], q.T, out=bad[s:e])
        _odds(bad)
        bad[:, NOISE] -= 1
        true = m.values.take(m.n + rows, 0)
        good = _odds(self.shift_within[rows] - np.einsum("bw,bw->b", u, true)) - 1
        several = hi - lo > 1
        if not several.all():  # one member has probability 1
            alone = ~np.repeat(several, [e - s for _, s, e in groups])
            good[alone] = bad[alone, NOISE + 1 :] = 0
        back = np.empty_like(u)
        for (_, s, e), q, out in zip(groups, noise, added, strict=True):
            np.matmul(bad[s:e], q, out=back[s:e])
            np.matmul(bad[s:e].T, u[s:e], out=out)
        true *= good[:, None]
        back += true
        u *= good[:, None]
        changed = [(2 * m.n + np.concatenate([own, drawn[0]]), np.concatenate([added[:, NOISE], added[:, :NOISE].sum(0)]))]
        if several.all():
            changed.append((m.n + np.concatenate([rows, inner.ravel()]), np.concatenate([u, added[:, NOISE + 1 :].reshape(-1, WIDTH + 1)])))
        elif several.any():
            changed.append((m.n + np.concatenate([rows[~alone], inner[several].ravel()]), np.concatenate([u[~alone], added[several, NOISE + 1 :].reshape(-1, WIDTH + 1)])))
        changed.append((contexts.ravel(), (place[:, None, :] * back).reshape(-1, WIDTH + 1)))
        moved = np.einsum("bw,jbw->jw", back, x)
        for part in changed:
            self._update(*_by_row(*part), rate)
        self._update(2 * m.n + m.k + np.arange(ORDER), moved, 0.1 * rate)


MIXED = "block int, pid int, weights binary, data binary"


def train(texts: DataFrame, voc: Vocabulary, share: float = 1.0) -> Parameters:
    """The parameters for all rows of (text). Each task sends as many numbers as the model has; the driver gets their means."""
    lookup = Lookup(voc)

    def run(batches):
        model, pid = Parameters(lookup.voc), TaskContext.get().partitionId()
        trainer, held = Trainer(model, pid), []

        def learn(final: bool):
            """Minibatches of what is held, in a drawn order; what is too little for one waits."""
            windows = np.concatenate(held, 1)
            held.clear()
            windows = windows.take(trainer.rng.permutation(windows.shape[1]), 1)
            for at in range(0, windows.shape[1], BATCH):
                some = windows[:, at : at + BATCH]
                if some.shape[1] < BATCH and not final:
                    held.append(some)
                else:
                    trainer.step(some[1:], some[0], RATE)

        for b in (part for batch in batches for part in by_bytes(batch, 0, TEXT)):
            own, line, asked, _ = laid_out(b.column(0))
            row = lookup.find(own).row[line]
            if share < 1:
                asked = asked[trainer.rng.random(len(asked)) < share]
            for at in range(0, len(asked), 16 * BATCH):
                some = asked[at : at + 16 * BATCH]
                held.append(np.stack([row[some - j] for j in range(ORDER + 1)]))
                if sum(h.shape[1] for h in held) >= 16 * BATCH:
                    learn(False)
        if held:
            learn(True)
        if trainer.trained.any():
            for at in range(0, len(model.values), BLOCK):
                w, v = trainer.trained[at : at + BLOCK], model.values[at : at + BLOCK]
                some = np.flatnonzero(w).astype("<u2")
                if len(some):  # rows that this task didn't train stay here
                    yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([pid], pa.int32()), pa.array([some.tobytes() + w[some].tobytes()], pa.binary()), pa.array([v[some].tobytes()], pa.binary())], ["block", "pid", "weights", "data"])

    def mean(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for block, _, weights, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(weights) // 6
                some, w = np.frombuffer(weights, "<u2", n), np.frombuffer(weights, "<f4", n, 2 * n).astype(np.float64)
                total = sums.setdefault(block, [np.zeros((BLOCK, WIDTH + 1)), np.zeros(BLOCK)])
                total[0][some] += w[:, None] * np.frombuffer(data, "<f4").reshape(-1, WIDTH + 1)
                total[1][some] += w
        for block, (values, w) in sums.items():
            some = np.flatnonzero(w).astype("<u2")
            data = (values[some] / w[some, None]).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([some.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["block", "pid", "weights", "data"])

    made = texts.select(F.col("text").cast("string")).mapInArrow(run, MIXED)
    # In order of the tasks, so that sums come out the same each time.
    means = made.repartition("block").sortWithinPartitions("block", "pid").mapInArrow(mean, MIXED).toArrow()
    values = Parameters(voc).values
    for block, _, some, data in zip(*(c.to_pylist() for c in means.columns), strict=True):
        values[block * BLOCK + np.frombuffer(some, "<u2")] = np.frombuffer(data, "<f4").reshape(-1, WIDTH + 1)
    return Parameters(voc, values)


EVENT = "struct<token:binary,times:int>"
PARTIAL = f"pid int, seq long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, events array<{EVENT}>"


def score(docs: DataFrame, model: Parameters, seen: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of (doc_id, held_out, text).

    Counts of tokens that the workers don't hold are joined. Null and empty texts consist
    of their end. Repeated rows are scored each for itself. Other columns don't matter.
    """
    lookup, values = Lookup(model.voc), model.values
    kinds = pa.struct([("token", pa.binary()), ("times", pa.int32())])

    def run(batches):
        pid, seq, voc = TaskContext.get().partitionId(), 0, lookup.voc
        model = Parameters(voc, values)
        mass = np.log10(voc.mass)
        for b in (part for batch in batches for part in by_bytes(batch, 2, TEXT)):
            own, line, asked, owner = laid_out(b.column(2))
            known, member, count, rows = lookup.find(own)
            # What a token adds to both scores; a count that isn't held is joined as log10(count + 1).
            base = np.log10(count + 1) - math.log10(voc.total)
            inner = np.where(member, 0.0, np.log10(count + 1) - mass[model.cluster[rows]])
            code, row = line[asked], rows[line]
            value = model.log_probabilities(row, asked) / math.log(10) + inner[code]
            many = b.num_rows
            sums = [np.bincount(owner, w, many) for w in (base[code], value)]
            odd = np.flatnonzero(~known[code])
            pairs, times = np.unique(owner[odd] * len(own) + code[odd], return_counts=True)
            of_pair = pa.StructArray.from_arrays([own.take(pa.array(pairs % len(own))), pa.array(times.astype(np.int32))], fields=list(kinds))
            events = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(many + 1) * len(own)).astype(np.int32)), of_pair)
            cols = [
                pa.array([pid] * many, pa.int32()), pa.array(range(seq, seq + many), pa.int64()), b.column(0), b.column(1), pa.array(np.bincount(owner, minlength=many)),
                pa.array(np.bincount(owner, known[code] & (count[code] > 0), many).astype(np.int64)), *map(pa.array, sums), events,
            ]
            seq += many
            yield pa.RecordBatch.from_arrays(cols, ["pid", "seq", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "events"])

    part = cut(docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(run, PARTIAL))
    events = part.select("pid", "seq", F.explode("events").alias("e")).select("pid", "seq", "e.*").join(seen, "token")
    added = events.groupBy("pid", "seq").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return part.drop("events").join(added, ["pid", "seq"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("more_known")).alias("n_known"),
        F.lit(lookup.voc.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more")).alias("base_score"),
        (F.col("score") + zero("more")).alias("score"),
    )


def learned(texts: DataFrame, held: int = HELD, widen: int = WIDEN, share: float = 1.0) -> tuple[Parameters, DataFrame]:
    """The model of all rows of (text), and the exact counts (token, n) of their tokens."""
    seen = cut(token_counts(texts))
    return train(texts, vocabulary(seen, held, widen), share), seen


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", crc_is(F.col("doc_id"), 7, 2).alias("held_out"))
    model, seen = learned(docs.filter(~F.col("held_out")))
    return score(docs, model, seen)
