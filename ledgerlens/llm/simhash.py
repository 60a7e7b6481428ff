r"""Near copies by SimHash: pigeonhole blocks, then exact Hamming distances.

Fingerprint: A-Z lower-cased, words `[^\x20\x09-\x0D]+`, shingles of k words with repeats, each
hashed by XXH64 (seed 42); a bit is 1 if it is set in over half of the hashes.

Links: the 64 bits are split into 6 blocks. Two fingerprints that differ in at
most 3 bits agree in 3 whole blocks, so for each of the 20 choices of 3 blocks
(about 32 bits) the distinct fingerprints are brought together by those blocks and
checked for their true distance. Equal fingerprints are one item from the
start. A bucket does not give its pairs but a spanning forest of them: the
components inside the bucket, each fingerprint with its component's least. Small buckets
compare all their fingerprints in numpy tiles; a bucket beyond TILE_LIMIT
looks up, in its sorted fingerprints, each of the 5,488 or so patterns of up to 3 bits outside the shared
blocks, so its cost grows with the bucket's size and not with its square. No
link is dropped either way.

Components: alternating large-star and small-star rounds over the forest's edges,
each written to the checkpoint folder, until nothing changes.

Defined results: null and empty texts have fingerprint zero and link like any other;
equal rows are one group; a null id never becomes a component_id unless all of its
group are null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, by_bytes, cut, keyed_text, read, texts_of

SEED = 42
DISTANCE = 3
BLOCKS = 6
#: Fingerprints up to which a bucket is compared pair by pair within a task.
TILE_LIMIT = 1 << 15


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """For each choice of blocks that must agree, the mask of their bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(bits, blocks - distance)]


MASKS = block_masks()


def shingle_hashes(text: bytes, k: int) -> list[int]:
    words = text.translate(LOWER).split()  # bytes.split cuts at exactly the white space named above
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def fingerprints_of(texts: list[bytes], k: int) -> np.ndarray:
    """uint64 fingerprints; hashes of very long texts are counted in parts."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes = np.array(shingle_hashes(text, k), np.uint64)
        if not len(hashes):
            continue
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * ones > len(hashes)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (its 64 bits as a long) of every row; one pass, no shuffle."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints_of(texts_of(batch), k).view(np.int64), pa.int64())], names=["id", "fp"])

    return keyed_text(docs, id_col, text_col).mapInArrow(hashed, "id long, fp long")


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the components of a[i] and b[i], by least index; vectorised rounds."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)
    return parent


def link_tiles(fps: np.ndarray, distance: int = DISTANCE, tile: int = 2048) -> np.ndarray:
    """Component (least index) of each of the sorted distinct fingerprints, all compared in tiles."""
    parent = np.arange(len(fps))
    for i in range(0, len(fps), tile):
        for j in range(i, len(fps), tile):
            a, b = np.nonzero(np.bitwise_count(fps[i : i + tile, None] ^ fps[None, j : j + tile]) <= distance)
            parent = _join(parent, a + i, b + j)
    return parent


def link_masks(fps: np.ndarray, mask: int, distance: int = DISTANCE) -> np.ndarray:
    """The same by looking up every change of up to `distance` bits outside `mask`."""
    parent = np.arange(len(fps))
    free = [np.uint64(1 << b) for b in range(64) if not mask >> b & 1]
    for n in range(1, distance + 1):
        for bits in combinations(free, n):
            other = fps ^ np.bitwise_or.reduce(np.array(bits, np.uint64))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            hit = np.flatnonzero((fps[at] == other) & (other > fps))
            parent = _join(parent, hit, at[hit])
    return parent


def bucket_edges(fps: np.ndarray, mask: int, limit: int = TILE_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of one bucket: (fingerprint, least of its component) where they differ."""
    fps = np.unique(fps)
    parent = link_tiles(fps) if len(fps) <= limit else link_masks(fps, mask)
    some = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[some], fps[parent[some]]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): edges of spanning forests of every bucket, over the distinct fp of `distinct`."""
    choices = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("table"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long")).alias("block")) for i, m in enumerate(MASKS)])
    rows = distinct.select("fp", F.inline(choices)).repartition("table", "block").sortWithinPartitions("table", "block", "fp")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: np.ndarray, block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edge = np.append(True, (block[1:] != block[:-1]) | (table[1:] != table[:-1]))
            start = np.flatnonzero(edge)
            long = np.diff(np.append(start, len(fp)))
            two = start[long == 2]  # most shared buckets hold two
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= DISTANCE
            a, b = [fp[two[near]]], [fp[two[near] + 1]]
            for s, n in zip(start[long > 2].tolist(), long[long > 2].tolist(), strict=True):
                x, y = bucket_edges(fp[s : s + n], MASKS[table[s]])
                a.append(x)
                b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []  # the last bucket may go on in the next batch
        for batch in batches:
            now = (batch.column("table").to_numpy(), batch.column("block").to_numpy(), batch.column("fp").to_numpy().view(np.uint64))
            if not len(now[0]):
                continue
            held.append(now)
            if (held[0][0][0], held[0][1][0]) == (now[0][-1], now[1][-1]):  # still one bucket
                continue
            table, block, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = _last_run(table, block)
            if last:
                yield done(table[:last], block[:last], fp[:last])
            held = [(table[last:], block[last:], fp[last:])]
        if held:
            yield done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.mapInArrow(forest, "a long, b long")


def _last_run(table: np.ndarray, block: np.ndarray) -> int:
    """Where the last bucket begins."""
    other = np.flatnonzero((table != table[-1]) | (block != block[-1]))
    return int(other[-1]) + 1 if len(other) else 0


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each one's component, for every node with an edge.

    Each round points larger neighbours to the least of the neighbourhood (large
    star), then smaller neighbours too (small star). Only edges and per-node minima move.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    total = None
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        # A fixed point has each node once, and no root that is itself below another.
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == total:
            break
        total = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())


def near_copies(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row: components of fingerprints within 3 bits."""
    hashed = cut(fingerprints(docs, k, id_col, text_col))
    distinct = hashed.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(links(distinct.select("fp")))
    # One row a distinct fingerprint: the least id of its component.
    by_fp = distinct.join(root, distinct.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    named = by_fp.join(by_root, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(read(spark, sf_dir, "documents"), k=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
