"""Passages of many words that repeat: suffixes counts strings by bytes, this by words.

A window is a string of so many words, whatever white space lies between them. Its
anchor is its piece of GRAM words with the smallest hash, and windows in a row with
one anchor are a run, as in suffixes. Runs are counted by 128-bit hashes: one that
occurs twice is covered from end to end, one whose anchor has no other run is clean.
Of the rest, one of each kind, the windows are counted by their hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, slices
from .suffixes import BUFFER, PLACE, Prefix, _batch, _powers_to, merged, mix, sliding_min

GRAM = 8
_SPACE = np.isin(np.arange(256), [*b" \t\n\x0b\x0c\r"])


class Words(Prefix):
    """The words of a buffer, where they begin and end in it, and hashes of any strings of them."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(~_SPACE[raw], prepend=False, append=False))
        self.start, self.end = edges[::2], edges[1::2]
        self.own = np.empty((2, len(self.start)), np.uint64)
        at = 0
        while at < len(self.start):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + BUFFER, "right")))
            s, e = self.start[at:to], self.end[at:to]
            if e[-1] - s[0] > BUFFER:  # one very long word
                self.own[:, at] = np.frombuffer(hashlib.blake2b(data[s[0] : e[0]], digest_size=16).digest(), np.uint64)
            else:
                for row, h in zip(self.own, Prefix(raw[s[0] : e[-1]]).both(s - s[0], e - s), strict=True):
                    row[at:to] = h.view(np.uint64)
            at = to

    def part(self, at: int, to: int) -> None:
        """From now on places are counted from word `at`, up to word `to`."""
        self.powers, self.sums = _powers_to(to - at), []
        for (up, _), values in zip(self.powers, self.own[:, at:to], strict=True):
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: to - at], dtype=np.uint64)]))


def groups(texts: list[bytes]):
    """(numbers of texts, where each begins, their bytes with a line feed between them), of BUFFER bytes or one text."""
    now: list[int] = []
    used = 0
    for k in [*range(len(texts)), None]:
        size = 0 if k is None else len(texts[k]) + 1
        if now and (k is None or used + size > BUFFER):
            sizes = [len(texts[i]) + 1 for i in now]
            yield np.array(now), np.cumsum(sizes) - sizes, b"\n".join(texts[i] for i in now)
            now, used = [], 0
        if k is not None:
            now.append(k)
            used += size


def runs(texts: list[bytes], words: int):
    """The runs of windows with one anchor, by group: text, first and last (word of the text), start and end (byte of it), anchor's hash, the run's hashes."""
    gram, low = min(GRAM, words), np.uint64((1 << PLACE) - 1)
    for numbers, begin, data in groups(texts):
        all_ = Words(data)
        owner = np.searchsorted(begin, all_.start, "right") - 1
        before = np.searchsorted(all_.start, begin)  # words before each text
        for at in range(0, len(owner) - words + 1, BUFFER):
            to = min(len(owner), at + BUFFER + words - 1)
            all_.part(at, to)
            n = to - at - words + 1
            grams = mix(all_.of(np.arange(n + words - gram), gram))
            anchor = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), words - gram + 1) & low).astype(np.int64)
            own = owner[at:to]
            valid = own[:n] == own[words - 1 :]
            change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:n] != own[: n - 1]) | (valid[1:] != valid[:-1])]))
            last = np.append(change[1:], n) - 1
            first, last = change[valid[change]], last[valid[change]]
            c1, c2 = all_.both(first, last - first + words, anchor[first] - first)
            k = own[first]
            yield {
                "text": numbers[k], "first": first + at - before[k], "last": last + at - before[k], "gram": grams[anchor[first]].view(np.int64), "c1": c1, "c2": c2,
                "start": all_.start[first + at] - begin[k], "end": all_.end[last + at + words - 1] - begin[k],
            }


_RUN = ["k1", "k2", "first", "last", "start", "end", "gram", "c1", "c2"]
_WINDOW = ["w1", "w2", "k1", "k2", "start", "end", "n"]


def _longs(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def anchors(rows: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for b in slices(batches, 1024):
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for r in runs([t.encode() for t in b.column(2).to_pylist()], words):
                if len(r["text"]):
                    yield _batch(_RUN, [k1[r["text"]], k2[r["text"]], *(r[k] for k in _RUN[2:])])

    return rows.filter(F.octet_length("text") >= 2 * words - 1).select("k1", "k2", "text").mapInArrow(run, _longs(_RUN))


def windows(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The windows of the wanted runs (k1, k2, first, last, n), with their hashes and bytes."""
    asked = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last", "n")).alias("asked"))

    def run(batches):
        for b in slices(batches, 128):
            for k1, k2, text, want in zip(*(c.to_pylist() for c in b.columns), strict=True):
                all_ = Words(text.encode())
                first, last, n = (np.array([w[k] for w in want]) for k in ("first", "last", "n"))
                order = np.argsort(first)
                first, last, n = first[order], last[order], n[order]
                for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first // BUFFER)) + 1):
                    at = int(first[part[0]])
                    all_.part(at, int(last[part].max()) + words)
                    many = last[part] - first[part] + 1
                    place = np.repeat(first[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    w1, w2 = all_.both(place - at, np.full(len(place), words))
                    yield _batch(_WINDOW, [w1, w2, np.full(len(place), k1), np.full(len(place), k2), all_.start[place], all_.end[place + words - 1], np.repeat(n[part], many)])

    return rows.select("k1", "k2", "text").join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked").mapInArrow(run, _longs(_WINDOW))


def covered(rows: DataFrame, words: int) -> DataFrame:
    """(k1, k2, spans): for each text of suffixes.keyed(), the byte spans that windows of so many words cover that also start elsewhere."""
    runs_ = cut(anchors(rows, words))
    own = runs_.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "last")).alias("at"))
    own = cut(own.select("gram", "c1", "c2", "n", "at.*"))
    several = own.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("gram")
    found = cut(windows(rows, own.join(several, "gram", "left_semi"), words))
    # A window is once in a run, and a run of a kind is here once.
    twice = found.groupBy("w1", "w2").agg(F.count("*").alias("times")).filter("times > 1")
    hit = found.filter("n = 1").join(twice, ["w1", "w2"], "left_semi").select("k1", "k2", "start", "end")
    whole = runs_.join(own.filter("n > 1").select("c1", "c2"), ["c1", "c2"], "left_semi").select("k1", "k2", "start", "end")
    out = cut(merged(whole.unionByName(hit)).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    release(runs_, own, found)
    return out
