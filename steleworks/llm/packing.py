"""Best-fit packing of tokenized documents, planned on the histogram of lengths.

Documents longer than a sequence are cut into pieces. Best fit decreasing runs over
the counts of the at most WINDOW lengths, not over documents: bins that look alike
are one range of sequence ids, and a length fills a whole range at a time. The plan
has a few entries for each length; a piece finds its place by its rank among the
pieces of its length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, cut, table

WINDOW, END, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Bytes of the words and their ids that a worker remembers, and what an entry takes besides.
REMEMBERED, ENTRY = 96 << 20, 230
#: Letters that every Unicode version classes alike and that no normaliser changes but to lower case, and a mark behind them: one pre-token or two.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")


def _byte_letters() -> dict[int, int]:
    """Bytes above ASCII as the letters that stand for them in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = [b for b in range(256) if b not in plain]
    return {b: 0x100 + k for k, b in enumerate(odd)}


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit bytes, from a tokenizer that never joins over white space.

    Texts are split at ASCII white space and chunks are looked up, each distinct one of a
    batch once. A new chunk of plain letters, or of these and one mark, goes to the
    tokenizer's model at once, in the form that its normaliser and pre-tokenizer would
    give it; any other goes through the whole tokenizer. Tokenizers that differ in what
    they do before the model are told by a trial and get no short cut.
    """

    MARKS = ".,;:!?"
    TRIAL = "Ünïted STATES, a; façade! Zz? él. o: ÿþð"

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.plain = _PLAIN
        self.marks = dict(zip(self.MARKS, self._encode(list(self.MARKS)), strict=True)) | {"": b""}
        if b"".join(map(self._chunk, self.TRIAL.split())) != self._encode([self.TRIAL])[0]:
            self.plain = re.compile("(?!)")
        self.known, self.size, self.most = {}, 0, most

    def _encode(self, texts: list[str]) -> list[bytes]:
        # Encodings are large beside their ids, so only some are there at a time.
        some = (texts[at : at + 2000] for at in range(0, len(texts), 2000))
        return [np.array(e.ids, "<u4").tobytes() for part in some for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a plain chunk; None for another one."""
        found = self.plain.fullmatch(chunk)
        if not found:
            return None
        word = found[1].lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes() + self.marks[found[2]]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        known = self.known
        found = [known.get(c) for c in chunks]
        new = [i for i, ids in enumerate(found) if ids is None]
        other = []
        for i in new:
            found[i] = self._chunk(chunks[i])
            if found[i] is None:
                other.append(i)
        for i, ids in zip(other, self._encode([chunks[i] for i in other]), strict=True):
            found[i] = ids
        # What came first stays, as frequent words do.
        for i in new:
            more = len(chunks[i]) + len(found[i]) + ENTRY
            if self.size + more > self.most:
                break
            known[chunks[i]] = found[i]
            self.size += more
        return found

    def encode_array(self, texts: pa.StringArray) -> tuple[memoryview, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last one's end, in bytes."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks = lists.flatten().dictionary_encode()
        ids = pa.array(self._ids(chunks.dictionary.to_pylist()), pa.large_binary())
        joined = ids.take(chunks.indices)
        if not len(joined):
            return memoryview(b""), np.zeros(len(texts) + 1, np.int64)
        # Taken values lie one after the other.
        ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        return memoryview(joined.buffers()[2] or b""), ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def encode(self, texts: list[str]) -> list[bytes]:
        data, at = self.encode_array(pa.array(texts, pa.string()))
        return [bytes(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encoder(vocabulary: str = VOCABULARY) -> Callable[[], WordEncoder]:
    """A maker of one encoder for each worker; vocabulary: a name of the public tokenizers or a path."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = WordEncoder.__dict__.get("_made") or {}
        if vocabulary not in cache:
            path = vocabulary
            if not os.path.exists(path):
                import public_tokenizers

                path = public_tokenizers.path(vocabulary)
            cache[vocabulary] = WordEncoder(path)
            WordEncoder._made = cache
        return cache[vocabulary]

    return make


class Entry(NamedTuple):
    """Pieces of one length with ranks from first on: `each` of them go to every sequence from sequence on, at offset."""

    length: int
    first: int
    each: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[Entry], int]:
    """Best fit decreasing over the counts of lengths; the entries, and how many sequences they fill."""
    entries: list[Entry] = []
    rooms: list[int] = []  # the free spaces that open sequences have, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # free space: ranges (first sequence, how many)
    total = 0

    def add(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, first, many = window, total, -(-left // (window // length))
                total += many
            each = min(room // length, left)
            used = min(many, left // each)
            entries.append(Entry(length, rank, each, first, window - room))
            add(room, first + used, many - used)
            add(room - each * length, first, used)
            rank, left = rank + used * each, left - used * each
    return entries, total


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long"


def pieces(docs: DataFrame, make: Callable[[], WordEncoder], window: int = WINDOW, end: int = END) -> DataFrame:
    """The pieces of every document, with their rank among those of their length in a task (pid)."""

    def run(batches):
        coder, pid, last = make(), TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        seen = np.zeros(window + 1, np.int64)
        for b in (part for batch in batches for part in by_bytes(batch, 1)):
            rows = []
            data, at = coder.encode_array(b.column(1))
            for doc, begin, stop in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for k, x in enumerate(range(begin, stop + 4, 4 * window)):
                    part = bytes(data[x : min(x + 4 * window, stop)])
                    part = part if len(part) == 4 * window else part + last
                    n = len(part) // 4
                    rows.append((doc, k, (x - begin) // 4, n, zlib.crc32(part), pid, int(seen[n])))
                    seen[n] += 1
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, make: Callable[[], WordEncoder] | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece with its sequence and offset.

    Null and empty texts are the end id alone. Repeated rows are packed each for
    itself. The driver gets one count for each length, at most `window` numbers.
    """
    made = cut(pieces(docs, make or encoder(), window, end))
    sizes = made.groupBy("length", "pid").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    entries, _ = plan(histogram, window)
    entries.sort()
    keys = np.array([(e.length << 44) + e.first for e in entries], np.int64)
    each, sequence, offset, first = (np.array([getattr(e, k) for e in entries], np.int64) for k in ("each", "sequence", "offset", "first"))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("length", "place"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            i = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence[at] + i // each[at]), pa.array(offset[at] + i % each[at] * length)], [*b.schema.names[:5], "sequence_id", "offset"]
            )

    ranked = made.join(bases, ["length", "pid"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("place"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents that are left."""
    return pack(docs)
