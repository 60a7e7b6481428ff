"""Near-dedup of whole documents at a Jaccard similarity of SIMILARITY over 5-word shingles.

The pigeonhole blocks of `simhash.links` propose the pairs whose fingerprints differ in at most 3 bits. Those are
texts that are all but equal: texts at similarity 0.8 differ in about 15 % of the bits of their fingerprints, and no choice of a few
whole blocks of bits agrees often enough to be a key. So the rest of the pairs come from bands: 24 of 5 minima of hashed shingles
(a pair at 0.8 shares a band with probability 0.99993). A 128-bit SimHash
drops pairs beyond MOST_BITS differing bits (over three deviations from what 0.8 gives) where both have
FEW_SHINGLES shingles or more, and the share of equal minima drops pairs far below 0.8; the true Jaccard similarity of the whole texts decides every link.

Equal texts are one item from the start. A band of up to ALL_PAIRS items gives all its pairs. In a larger one every item first
meets the band's hub alone: the item that shares its bands with the most others, which in a group of copies is their original.
Bands whose items are then in one component are done, since more links can't change the groups. The items of the others go through
an exact similarity join: two texts at 0.8 must share one of their rarest shingles (the first n - ceil(0.8 n) + 1 of n, by
a common order), so only texts that a chain of such shingles joins are compared, in tiles. A passage that many texts share is
frequent, comes last in that order, and brings no texts together. The order is by a table of ORDER_BUCKETS counts, of one size for any
corpus; it affects the number of pairs and not the result. So no pair of a band is left out for the band's size. What is left
of the square of a group's size is the cost of texts that share rare shingles and yet are not linked.

Defined results: null and empty texts are equal texts; a text of fewer than 5 words is one shingle; very long texts count
whole; of equal rows one stays; the row with the least id (null first), then text digest, of each group stays; an empty table
stays empty; all columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_bytes, cut, free_shuffles, shared_table, texts_of
from ledgerlens.llm.simhash import components, links, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
MOST_BITS = 33
#: Texts of fewer shingles are not judged by bits: a pair of 4 and 5 at 0.8 is beyond MOST_BITS with probability 0.019, and one of 30 or more with at most 0.001.
FEW_SHINGLES = 30
#: Of the 120 minima, 96 agree in a pair at 0.8, with a deviation of 4.4; fewer than this with a probability of about 1e-8.
LEAST_MARKS = 70
ALL_PAIRS = 24
ORDER_BUCKETS = 1 << 18
#: Items on a side of a tile.
TILE = 512

_RNG = np.random.default_rng(5)
MULTIPLIERS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIXERS = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashed shingles, ascending; a text without words has one of its own."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE) or [0], np.uint64))


def sketch(text: bytes) -> tuple[np.ndarray, bytes]:
    """The band keys of a text; and its 128-bit SimHash, its number of shingles, and a byte of each minimum."""
    h = shingles(text)
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    ones = np.zeros(128, np.int64)
    for at in range(0, len(h), 1 << 12):
        part = h[at : at + (1 << 12)]
        np.minimum(least, (part[None, :] * MULTIPLIERS[:, None]).min(axis=1), out=least)
        wide = np.stack([part, (part ^ (part >> np.uint64(31))) * MULTIPLIERS[0]], axis=1)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), 16), axis=1).sum(axis=0, dtype=np.int64)
    keys = ((least >> np.uint64(8)).reshape(BANDS, ROWS) * MIXERS).sum(axis=1, dtype=np.uint64)
    keys = (keys ^ (keys >> np.uint64(29))) * MULTIPLIERS[:BANDS]  # bands don't share keys
    marks = (least >> np.uint64(24)).astype(np.uint8).tobytes()
    return keys.view(np.int64), np.packbits(2 * ones > len(h)).tobytes() + np.uint64(len(h)).tobytes() + marks


@lru_cache(maxsize=64)
def _known_shingles(text: bytes) -> np.ndarray:
    return shingles(text)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = _known_shingles(a), _known_shingles(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def sketches(items: DataFrame) -> DataFrame:
    """(item, text) -> (item, s0, s1, k, marks, keys): two halves of the SimHash, the number of shingles, bytes of the minima, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            keys, sims = zip(*map(sketch, texts_of(batch)), strict=True)
            s = np.frombuffer(b"".join(x[:24] for x in sims), np.int64).reshape(-1, 3)
            marks = pa.array([x[24:] for x in sims], pa.binary())
            bands = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(keys)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item"), *(pa.array(np.ascontiguousarray(s[:, i])) for i in range(3)), marks, bands], names=["item", "s0", "s1", "k", "marks", "keys"])

    return items.mapInArrow(run, "item binary, s0 long, s1 long, k long, marks binary, keys array<long>")


def may_be_near(a: str, b: str) -> Column:
    """Whether the numbers of shingles and the bits let a pair of texts be similar, or one has too few shingles to tell by bits."""
    of = lambda side, c: F.col(f"{side}.{c}")
    least, most = F.least(of(a, "k"), of(b, "k")), F.greatest(of(a, "k"), of(b, "k"))
    bits = F.bit_count(of(a, "s0").bitwiseXOR(of(b, "s0"))) + F.bit_count(of(a, "s1").bitwiseXOR(of(b, "s1")))
    return (least >= F.floor(most * SIMILARITY)) & ((bits <= MOST_BITS) | (least < FEW_SHINGLES))


def ordered(a: str, b: str) -> list[Column]:
    x, y = F.col(f"{a}.item"), F.col(f"{b}.item")
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def block_pairs(sketched: DataFrame) -> DataFrame:
    """(a, b): pairs that pigeonhole blocks of the fingerprints link: each fingerprint's first item with its others, and with the next fingerprint's."""
    first = sketched.groupBy(F.col("s0").alias("fp")).agg(F.min("item").alias("item"))
    same = sketched.alias("x").join(first.alias("y"), (F.col("x.s0") == F.col("y.fp")) & (F.col("x.item") != F.col("y.item")))
    edges = links(first.select("fp"))
    other = edges.join(first.select(F.col("fp").alias("a"), F.col("item").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("item").alias("y")), "b")
    return same.select(*ordered("x", "y")).union(other.select(F.least("x", "y"), F.greatest("x", "y")))


def shared_bands(sketched: DataFrame) -> DataFrame:
    """(key, item, s0, s1, k, n) of the bands that n > 1 items share."""
    rows = sketched.select("item", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, "key").join(sketched.drop("keys", "marks"), "item")


def band_pairs(bands: DataFrame) -> DataFrame:
    """(a, b): all pairs of bands of up to ALL_PAIRS items that may be near."""
    small = bands.where(F.col("n") <= ALL_PAIRS)
    both = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.item") < F.col("y.item")) & may_be_near("x", "y"))
    return both.select(*ordered("x", "y"))


def hub_pairs(bands: DataFrame) -> DataFrame:
    """(a, b): each item of a larger band with the band's hub, if they may be near."""
    large = bands.where(F.col("n") > ALL_PAIRS)
    fame = bands.groupBy(F.col("item").alias("whose")).agg(F.sum("n").alias("fame"))
    hubs = large.join(fame, F.col("item") == F.col("whose")).groupBy("key").agg(F.max(F.struct("fame", "item", "s0", "s1", "k")).alias("hub")).select("key", "hub.*")
    both = large.alias("x").join(hubs.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.item") != F.col("y.item")) & may_be_near("x", "y"))
    return both.select(*ordered("x", "y"))


def open_items(bands: DataFrame, root: DataFrame) -> DataFrame:
    """(item, s0, s1, k, root, outside) of larger bands with several components; outside: not always in the band's largest."""
    large = bands.where(F.col("n") > ALL_PAIRS)
    grouped = large.join(root, F.col("item") == F.col("node"), "left").select("key", "item", "s0", "s1", "k", F.coalesce("root", "item").alias("root"))
    main = grouped.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("parts"))
    some = grouped.join(main.where("parts > 1"), "key")
    return some.groupBy("item").agg(*[F.first(c).alias(c) for c in ("s0", "s1", "k", "root")], F.max(F.col("root") != F.col("main.root")).alias("outside"))


def clusters(texts: DataFrame) -> DataFrame:
    """(node, root) of the members (item, text) that a chain of shared rare shingles joins: only these can hold pairs at SIMILARITY."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in by_bytes(batches):
            for text in texts_of(batch):
                found += np.bincount((shingles(text) % np.uint64(ORDER_BUCKETS)).astype(np.int64), minlength=ORDER_BUCKETS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some])], names=["bucket", "n"])

    times = np.zeros(ORDER_BUCKETS, np.int64)
    sums = texts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    times[np.asarray(sums["bucket"])] = np.asarray(sums["n"])
    shared = texts.sparkSession.sparkContext.broadcast(times)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            keys, number = [], []
            for text in texts_of(batch):
                h = shingles(text)
                order = np.lexsort((h, shared.value[(h % np.uint64(ORDER_BUCKETS)).astype(np.int64)]))
                keys.append(h[order[: len(h) - math.ceil(SIMILARITY * len(h)) + 1]])
                number.append(len(keys[-1]))
            owner = pa.array(np.repeat(np.arange(len(keys)), number))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(owner), pa.array(np.concatenate(keys).view(np.int64))], names=["item", "shingle"])

    rows = cut(texts.mapInArrow(rarest, "item binary, shingle long"))
    first = rows.groupBy("shingle").agg(F.min("item").alias("first"), F.count("*").alias("n")).where("n > 1")
    return components(rows.join(first, "shingle").select("item", "first").distinct(), "item", "first")


def joined(members: DataFrame, cluster: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the similar pairs of members of one cluster and of different components, one of them outside.

    The outside items of a cluster meet all its items, in tiles of about TILE by TILE; a tile gives its links alone.
    """
    grouped = members.join(cluster, F.col("item") == F.col("node")).select("item", "s0", "s1", "k", members["root"].alias("part"), "outside", cluster["root"].alias("cluster"))
    sizes = grouped.groupBy("cluster").agg(F.ceil(F.count_if("outside") / TILE).alias("down"), F.ceil(F.count("*") / TILE).alias("across"), F.count_distinct("part").alias("parts"))
    rows = grouped.join(sizes.where("down > 0 AND parts > 1"), "cluster").withColumn("at", F.xxhash64("item"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod("at", F.col(n))
    rest = ["item", "s0", "s1", "k", "part", "outside"]
    left = rows.where("outside").select("cluster", own("down").alias("row"), every("across").alias("column"), *rest, F.lit(True).alias("left"))
    right = rows.select("cluster", every("down").alias("row"), own("across").alias("column"), *rest, F.lit(False).alias("left"))
    tile = ["cluster", "row", "column"]
    dealt = left.unionByName(right).join(texts, "item").select(*tile, *rest, "left", "text").repartition(*tile).sortWithinPartitions(*tile)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in by_bytes(batches):
            for *to, item, s0, s1, k, part, outside, side, text in zip(*(batch.column(c).to_pylist() for c in (*tile, *rest, "left")), texts_of(batch), strict=True):
                if to != now:
                    yield links_of(held)
                    now, held = to, []
                held.append((item, s0, s1, k, part, outside, side, shingles(text)))
        yield links_of(held)

    return dealt.mapInArrow(compared, "a binary, b binary").distinct()


def links_of(held: list[tuple]) -> pa.RecordBatch:
    """The similar pairs of a tile's left and right items."""
    left, right = ([x for x in held if x[6] == side] for side in (True, False))
    found: list[tuple[bytes, bytes]] = []
    if left and right:
        sims = np.array([x[1:3] for x in right], np.int64).view(np.uint64)
        k, outside = np.array([x[3] for x in right]), np.array([x[5] for x in right])
        number = {part: i for i, part in enumerate({x[4] for x in held})}
        part, order = np.array([number[x[4]] for x in right]), {item: i for i, item in enumerate(sorted({x[0] for x in held}))}
        place = np.array([order[x[0]] for x in right])
        for item, s0, s1, n, own, _, _, h in left:
            bits = np.bitwise_count(sims ^ np.array([s0, s1], np.int64).view(np.uint64)).sum(axis=1)
            fits = (np.minimum(k, n) >= np.floor(SIMILARITY * np.maximum(k, n))) & ((bits <= MOST_BITS) | (np.minimum(k, n) < FEW_SHINGLES))
            # Two outside items meet twice; the pair is taken once.
            some = np.flatnonzero(fits & (part != number[own]) & (~outside | (place > order[item])))
            if len(some):
                both = overlaps(h, [right[i][7] for i in some])
                near = some[both >= SIMILARITY * (n + k[some] - both)]
                found.extend(tuple(sorted((item, right[i][0]))) for i in near)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])


def overlaps(h: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the others shares with h (all ascending and distinct)."""
    flat, lengths = np.concatenate(others), np.fromiter(map(len, others), np.int64, len(others))
    at = np.minimum(np.searchsorted(h, flat), len(h) - 1)
    return np.add.reduceat((h[at] == flat).astype(np.int64), np.cumsum(lengths) - lengths)


def marked(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs whose minima agree often enough."""
    marks = lambda side: sketched.select(F.col("item").alias(side), F.col("marks").alias(f"marks_{side}"))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(f"marks_{side}").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for side in "ab")
            yield batch.filter(pa.array((x == y).sum(axis=1) >= LEAST_MARKS)).select(["a", "b"])

    return pairs.join(marks("a"), "a").join(marks("b"), "b").select("a", "b", "marks_a", "marks_b").mapInArrow(agree, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts (one row an item) are similar enough, each once."""
    pairs = cut(marked(pairs.distinct(), sketched))
    both = pairs.join(texts.select(F.col("item").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("item").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text_a"):
            kept = [jaccard(x, y) >= SIMILARITY for x, y in zip(texts_of(batch, "text_a"), texts_of(batch, "text_b"), strict=True)]
            yield batch.filter(pa.array(kept)).select(["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a binary, b binary")


def groups(items: DataFrame) -> DataFrame:
    """(node, root) of the items (item, text; equal rows allowed) that are linked to another."""
    spark = items.sparkSession
    sketched = cut(sketches(items).dropDuplicates(["item"]))
    bands = cut(shared_bands(sketched))
    blocks = cut(block_pairs(sketched).distinct())
    # Texts are dealt out once, and only those that share a band or a block with another.
    some = bands.select("item").union(blocks.select("a")).union(blocks.select("b")).distinct()
    texts = shared_table(items.join(some, "item", "left_semi").dropDuplicates(["item"]))
    free_shuffles(spark)
    near = cut(verified(blocks.union(band_pairs(bands)).union(hub_pairs(bands)), texts, sketched))
    free_shuffles(spark)
    root = cut(components(near))
    members = cut(open_items(bands, root))
    free_shuffles(spark)
    if members.isEmpty():
        return root
    own = shared_table(texts.join(members.select("item"), "item", "left_semi"))
    cluster = cut(clusters(own))
    free_shuffles(spark)
    more = cut(joined(members, cluster, own))
    return root if more.isEmpty() else cut(components(near.union(more)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal or similar texts."""
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    # One item a text, with the id that would stay.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("item"))
    least = cut(rows.groupBy("item").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"))).alias("first")))
    root = groups(docs.select(digest.alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    group = least.join(root, least.item == root.node, "left").select("item", "first", F.coalesce("root", "item").alias("root"))
    kept = group.groupBy("root").agg(F.min(F.struct("first", "item")).alias("best")).select("best.item", "best.first.known", "best.first.id")
    # The user's columns travel as one struct, so that none can clash.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest.alias("item"), F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"))
    return marked.join(kept, ["item", "known", "id"], "left_semi").dropDuplicates(["item", "known", "id"]).select("row.*")
