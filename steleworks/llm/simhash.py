"""SimHash near-duplicates with covering locality-sensitive hashing.

Each of the 64 bits gets a random non-zero vector of RADIUS + 1 bits. For every
non-zero v of that length, table v keeps the bits whose vector has an odd inner
product with v. RADIUS vectors never span RADIUS + 1 dimensions, so for any set of
RADIUS differing bits some v is orthogonal to all of them: the pair agrees on all
bits of table v. Every pair within the radius collides, without exception.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, slices, table, unused
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Fingerprints of one bucket that are compared at once; a larger bucket is covered anew by its other bits.
BUCKET = 20_000
#: So many times; by then a bucket's members agree in all but a few bits.
LEVELS = 5


def covering_masks(level: int, bits: int = BITS, radius: int = RADIUS) -> np.ndarray:
    """The 2^(radius + 1) - 1 masks of a level, as unsigned 64-bit numbers."""
    rng = np.random.default_rng(7_919 + level)
    every = 1 << radius + 1
    own = np.resize(np.arange(1, every), bits)  # each vector about as often
    rng.shuffle(own)
    odd = [[bin(int(m) & v).count("1") & 1 for m in own] for v in range(1, every)]
    return np.array([sum(bit << i for i, bit in enumerate(row)) for row in odd], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text's word shingles; 0 where there is no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return hash_(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    found = np.fromiter([hash_(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        part = np.unpackbits(found[at : at + 65_536].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
        votes += part.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist()))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_hash): fp is the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in slices(batches, 1024):
            got = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got), b.column(2)], ["doc_id", "fp", "text_hash"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def spanning_edges(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (parent, child) of a spanning forest of the links within radius among distinct fps."""
    rest, out = np.sort(fps.astype(np.uint64)), []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                queue += list(rest[near])
                out += [(int(root), int(x)) for x in rest[near]]
                rest = rest[~near]
    return out


def _links(small: DataFrame) -> DataFrame:
    """(u, v): links found in the buckets of small (fp, mask, key), which have at most BUCKET members each."""

    def run(batches):
        def out(edges):
            return pa.RecordBatch.from_arrays(list(np.concatenate(edges).view(np.int64).T), ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(parts):
            fp, mask, key = (np.concatenate([p[i] for p in parts]) for i in range(3))
            starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
            sizes, found = np.diff(np.append(starts, len(fp))), []
            for k in np.flatnonzero(sizes > 1).tolist():
                edges = spanning_edges(fp[starts[k] : starts[k] + sizes[k]].view(np.uint64))
                if edges:
                    found.append(np.array(edges, np.uint64))
            if found:
                yield out(found)

        for b in batches:
            if not b.num_rows:
                continue
            fp, mask, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            # The last bucket may go on in the next batch.
            open_ = int(np.argmax((mask == mask[-1]) & (key == key[-1])))
            if open_ == 0 and held and (held[-1][1][-1] != mask[0] or held[-1][2][-1] != key[0]):
                yield from flush(held)
                held = []
            if open_:
                yield from flush([*held, (fp[:open_], mask[:open_], key[:open_])])
                held = []
            held.append((fp[open_:], mask[open_:], key[open_:]))
        if held:
            yield from flush(held)

    return small.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "u long, v long")


def link_edges(distinct: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(u, v) that connect all distinct fingerprints fp exactly as the links within the radius do.

    A bucket gives a spanning forest of its links, not its pairs. Buckets are counted first,
    with partial counts before the shuffle; a bucket above the limit is never gathered: its
    members are told by a join with its key and covered again by another family of masks,
    over the bits that they don't share yet. Any pair within the radius also collides there,
    so nothing is lost. At the last level the members of a bucket agree in all but a few
    bits, and their number is bounded by these.
    """
    found, keyed = None, distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(LEVELS):
        masks = [int(np.uint64(m).view(np.int64)) for m in covering_masks(level)]
        grown = keyed.select("fp", F.explode(F.array(*[F.col("mask").bitwiseOR(F.lit(m)) for m in masks])).alias("mask"))
        grown = (grown.distinct() if level else grown).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).select("fp", "mask", "key")
        large = None
        if level < LEVELS - 1:
            large = cut(grown.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("mask", "key"))
            if large.isEmpty():
                release(large)
                large = None
        edges = cut(_links(grown if large is None else grown.join(large, ["mask", "key"], "left_anti").select("fp", "mask", "key")))
        found = edges if found is None else found.unionByName(edges)
        if large is None:
            break
        keyed = cut(grown.join(large, ["mask", "key"], "left_semi").select("fp", "mask"))
    return found


def groups(docs: DataFrame, width: int = SHINGLE, texts: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) for each document; texts: (doc_id, text_hash, component, component_id), component a group's smallest fingerprint.

    component_id is the smallest doc_id reachable over links of RADIUS bits or fewer.
    Null and empty texts have no word, so fingerprint 0, and are linked like any
    others. Rows with a null doc_id take part but name a component only where no
    other row does (component_id is then null). Repeated rows give repeated results.
    """
    prints = cut(fingerprints(docs, width))
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = components(link_edges(first.select("fp")))
    linked = nodes.join(first, nodes["node"] == first["fp"]).select("fp", "component", "first")
    named = linked.join(linked.groupBy("component").agg(F.min("first").alias("smallest")), "component").select("fp", "component", "smallest")
    named = cut(first.join(named, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.least("smallest", "first").alias("component_id")))
    both = prints.join(named, "fp")
    return both.select("doc_id", "text_hash", "component", "component_id") if texts else both.select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: keeps, of each group, the document with the smallest doc_id.

    Rows that share their doc_id and have different texts are different documents of one
    group if their texts are near, so one of them stays, that with the smallest hash of its
    text; if they aren't, each stays. Rows that repeat altogether stay once. Rows without a
    doc_id can't be told apart; they stay as they are and take part in no group. Other
    columns are kept, whatever their names.
    """
    named = docs.filter("doc_id IS NOT NULL")
    id_, hash_, group = unused(docs.columns, "id_", "hash_", "group_")
    found = groups(named, texts=True).filter("doc_id = component_id").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("component").alias(group))
    keep = found.groupBy(id_, group).agg(F.min(hash_).alias(hash_)).select(id_, hash_)
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    kept = named.join(keep, (F.col("doc_id") == F.col(id_)) & (own == F.col(hash_)), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
