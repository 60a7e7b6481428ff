"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every document of the fit fold, labels unseen, is
the unlabelled set; the class prior is the share of toxic among labelled rows of the fit fold.
A linear model over words and word beginnings minimises the non-negative risk
    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))
with the logistic loss, in numpy. Where the second term falls below
zero, a step goes back up its gradient, which keeps the model from fitting unlabelled
positives as negatives.

Features: distinct words (lower-cased, of letters and digits), and their beginnings
of 4 to 7 bytes, hashed. Features that few positives have, or that unlabelled text has
too often for the class prior, are left out; the L1 step sets most others to zero. The minimiser of the
logistic risk is the probability itself, so the score needs no other scale.

How it is spread: the positives are a sample of at most MOST_POSITIVE labelled rows, so their features and the list of
features to look for are bounded. Passes over all unlabelled texts give (1) the groups of near copies that
hold a HEAVY share of all texts, which then weigh as one text (there can be few such groups), (2) how much
unlabelled text has each feature, (3) each text's chosen features. Texts with the same features are one row with a weight.
The rows are dealt by hash to slices of about SLICE_ROWS; in each of ROUNDS, every slice goes on from the shared weights with
its own part of the unlabelled risk, and the slices' weights are averaged. A small corpus is one slice, which is the
plain full-batch fit. The model doesn't depend on the partitions, and the driver holds the positives and the model only.

Defined results: empty and null texts score as texts without features; very long texts count whole, each of their words
once; labels that are null count as unlabelled; a document with several label rows is toxic if any says so; a score of
exactly the threshold is toxic; without positives every score is the prior (0 without labels); repeated rows each get a
score; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_bytes, cut, keyed_text, read
from ledgerlens.llm.decontamination import TO_WORDS
from ledgerlens.llm.linear import Adam, Rows, bounded_ids, fold, from_binary, sigmoid, texts_for, without_copies

#: Labelled toxic documents to fit on, and labelled documents to take the class prior from, at most.
MOST_POSITIVE, MOST_LABELLED = 2500, 5000
DIMENSIONS = 1 << 20
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.7
#: A feature is kept if at least this share of those who have it are toxic, and clearly more positives have it than
#: chance would give: by so many standard deviations and so many more.
PURITY, SURENESS, LEAST = 0.5, 4, 6
FOLDS, HELD_OUT = 3, 1
#: Near copies weigh as one text where they are more than this share of all texts. Min-hash tables to find them by.
HEAVY, LEAST_HEAVY = 0.002, 20
TABLES, WIDTH = 6, 4
ROUNDS, STEPS, SLICE_ROWS = 2, 300, 50_000
#: Words whose features a task keeps.
KEPT_WORDS = 200_000


def words_of(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(TO_WORDS).split())


def word_features(word: bytes) -> list[int]:
    """The word itself, and its beginnings (which differ from the whole word's feature)."""
    mask = DIMENSIONS - 1
    return [crc32(b"=" + word) & mask, *(crc32(b"^" + word[:n]) & mask for n in BEGINNINGS if n <= len(word))]


class Features(dict):
    """Features of each word, kept up to a bound."""

    def __missing__(self, word: bytes) -> list[int]:
        found = word_features(word)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        return np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, words_of(text))), np.int32))


def extract(rows: DataFrame, columns: str) -> DataFrame:
    """rows with `text` replaced by its features, as int32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in by_bytes(batches):
            found = [features.of(t or "").astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found, pa.binary())], names=[*rest, "features"])

    return rows.mapInArrow(run, f"{columns}, features binary")


@dataclass
class ToxicModel:
    """Weights of the few features that matter, and the bias."""

    weights: dict[int, float]
    bias: float
    #: Words seen that have none of the features, by task.
    plain: set = field(default_factory=set)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            some: set[int] = set()
            for word in words_of(text) - self.plain:
                found = [f for f in word_features(word) if f in self.weights]
                if found:
                    some.update(found)
                elif len(self.plain) < 500_000:
                    self.plain.add(word)
            out[i] += sum(self.weights[f] for f in sorted(some))
        return sigmoid(out)


def fit_nnpu(positive: Rows, unlabelled: Rows, weight: np.ndarray, prior: float, n: int, start: np.ndarray | None = None, l1: float = 1e-4, steps: int = 2 * STEPS, rate: float = 0.05, gamma: float = 1.0) -> np.ndarray:
    """Full-batch non-negative PU risk with the logistic loss: weights, then the bias. `weight`: of each unlabelled row."""
    x = np.append(np.zeros(n), np.log(prior / (1 - prior))) if start is None else start.copy()
    adam, n_p, share = Adam(n + 1, rate), max(len(positive), 1), weight / max(float(weight.sum()), 1e-9)
    for _ in range(steps):
        zp, zu = positive.logits(x[:-1], x[-1]), unlabelled.logits(x[:-1], x[-1])
        errors_p, errors_u = nnpu_errors(zp, zu, share, prior, n_p, gamma)
        gradient = positive.gradient(errors_p, n) + unlabelled.gradient(errors_u, n)
        x = adam.step(x, np.append(gradient, errors_p.sum() + errors_u.sum()), l1)
    return x


def nnpu_errors(zp: np.ndarray, zu: np.ndarray, share: np.ndarray, prior: float, n_p: int, gamma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the step's objective by the logits of both sets."""
    negative_part = float(share @ np.logaddexp(0, zu)) - prior * np.logaddexp(0, zp).sum() / n_p
    eu, ep_minus = share * sigmoid(zu), prior * sigmoid(zp) / n_p
    if negative_part >= 0:
        return -prior * sigmoid(-zp) / n_p - ep_minus, eu
    return gamma * ep_minus, -gamma * eu


class Signatures:
    """Keys of near copies: in each table, the minima of WIDTH hashes of a text's words."""

    def __init__(self):
        rng = np.random.default_rng(17)
        self.multipliers = rng.integers(0, 2**63, TABLES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, text: str) -> np.ndarray:
        words = np.fromiter(map(crc32, words_of(text) or {b""}), np.uint64)
        least = (words[None, :] * self.multipliers[:, None] >> np.uint64(16)).min(axis=1).reshape(TABLES, WIDTH)
        keys = (least * self.multipliers[:WIDTH]).sum(axis=1, dtype=np.uint64) * np.uint64(TABLES) + np.arange(TABLES, dtype=np.uint64)
        return keys.view(np.int64)


def heavy_copies(texts: DataFrame) -> dict[int, int]:
    """Key -> texts, of the keys that more than a HEAVY share of all texts have: at most TABLES / HEAVY of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures()
        for batch in by_bytes(batches):
            keys = [signatures.of(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["key"])

    n = texts.count()
    times = texts.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n"))
    return {r["key"]: r["n"] for r in times.where(F.col("n") > max(HEAVY * n, LEAST_HEAVY)).collect()}


def weigher(heavy: dict[int, int]):
    """text -> its weight: 1, or a share of 1 in a heavy group of near copies."""
    signatures = Signatures()
    return lambda text: 1 / max(heavy.get(k, 1) for k in signatures.of(text).tolist()) if heavy else 1.0


def class_prior(docs: DataFrame, known: DataFrame, heavy: dict[int, int], most: int = MOST_LABELLED) -> float:
    """Share of toxic among the labelled texts, by the weights that texts have in the unlabelled set; from a bounded sample of labelled rows."""
    sample = bounded_ids(known.select("id"), most).join(known, "id")
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weigher(shared.value)
        for batch in by_bytes(batches):
            found = [weight(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.float64())], names=["toxic", "w"])

    toxic, total = texts_for(docs, sample.select("id", "toxic")).mapInArrow(run, "toxic int, w double").agg(F.sum(F.when(F.col("toxic") == 1, F.col("w"))), F.sum("w")).first()
    return (toxic or 0.0) / total if total else 0.0


def unlabelled_counts(texts: DataFrame, wanted: np.ndarray, heavy: dict[int, int]) -> tuple[np.ndarray, float]:
    """Weight of the texts that have each of the wanted features (a bounded list), and of all texts."""
    shared = texts.sparkSession.sparkContext.broadcast((wanted, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, heavy = shared.value
        place = np.full(DIMENSIONS, len(wanted), np.int32)
        place[wanted] = np.arange(len(wanted))
        sums, features, weight = np.zeros(len(wanted) + 2), Features(), weigher(heavy)
        for batch in by_bytes(batches):
            for text in batch.column("text").to_pylist():
                w = weight(text)
                sums[place[features.of(text)]] += w  # a text's features are distinct, or go to the unwanted one's place
                sums[-1] += w
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], names=["f", "w"])

    sums = np.zeros(len(wanted) + 2)
    for r in texts.mapInArrow(run, "f int, w double").groupBy("f").agg(F.sum("w").alias("w")).collect():
        sums[r["f"]] = r["w"]
    return sums[:-2], float(sums[-1])


def patterns(texts: DataFrame, kept: np.ndarray, heavy: dict[int, int]) -> DataFrame:
    """(features, w): the kept features of the texts (as int32 bytes of their numbers), and the weight of the texts with just these."""
    shared = texts.sparkSession.sparkContext.broadcast((kept, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, heavy = shared.value
        place = np.full(DIMENSIONS, -1, np.int32)
        place[kept] = np.arange(len(kept))
        features, weight = Features(), weigher(heavy)
        for batch in by_bytes(batches):
            sums: dict[bytes, float] = {}
            for text in batch.column("text").to_pylist():
                own = place[features.of(text)]
                key = np.sort(own[own >= 0]).astype("<i4").tobytes()
                sums[key] = sums.get(key, 0.0) + weight(text)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.float64())], names=["features", "w"])

    return texts.mapInArrow(run, "features binary, w double").groupBy("features").agg(F.sum("w").alias("w"))


def fit_slices(rows: DataFrame, positive: Rows, prior: float, n: int, slice_rows: int = SLICE_ROWS) -> np.ndarray:
    """Weights and bias from all rows (features, w), by rounds over slices."""
    n_slices = max(1, -(-rows.count() // slice_rows))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("features"), F.lit(n_slices)))
    def fitted(start: np.ndarray | None):
        shared = rows.sparkSession.sparkContext.broadcast((positive.ids, positive.lengths, start))

        def fit(table: pa.Table) -> pa.Table:
            ids, lengths, start = shared.value
            table = table.sort_by("features")
            weight = np.asarray(table["w"])
            found = fit_nnpu(Rows(ids, lengths), from_binary(table["features"]), weight, prior, n, start, steps=STEPS)
            return pa.table({"f": pa.array(np.arange(n + 1), pa.int32()), "x": found * weight.sum(), "w": np.full(n + 1, weight.sum())})

        return fit

    x = None
    for _ in range(ROUNDS):
        means = dealt.groupBy("slice").applyInArrow(fitted(x), "f int, x double, w double").groupBy("f").agg((F.sum("x") / F.sum("w")).alias("x"))
        x = np.zeros(n + 1)
        for r in means.collect():  # a row a feature of the model
            x[r["f"]] = r["x"]
    return x


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE) -> ToxicModel:
    """docs: (id, text), no text null. labels: (id, toxic). Both are cut to the fit fold here."""
    fit = fold("id", FOLDS) != HELD_OUT
    known = labels.where(fit & F.col("toxic").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.sum(F.expr("bigint(toxic = 1)"))).first()
    if not n or not n_toxic:
        return ToxicModel({}, -40.0 if not n else float(np.log(0.5 / (n + 0.5))))
    texts = docs.where(fit).select("text")
    heavy = heavy_copies(texts)
    prior = class_prior(docs, known, heavy) or n_toxic / n
    prior = min(max(prior, 1e-3), 0.9)
    nothing = ToxicModel({}, float(np.log(prior / (1 - prior))))
    sample = bounded_ids(known.where("toxic = 1").select("id"), most_positive)
    positive = from_binary(extract(texts_for(docs, sample), "id long").toArrow().sort_by("id")["features"])
    positive = positive.take(without_copies(positive))
    in_p = positive.counts(DIMENSIONS)
    wanted = np.flatnonzero(in_p >= LEAST)
    if not len(positive):
        return nothing
    in_u, n_u = unlabelled_counts(texts, wanted, heavy)
    if not n_u:
        return nothing
    in_p = in_p[wanted]
    # The share of toxic among the texts that have a feature, as far as P and U tell, must be at least PURITY.
    purity = prior * (in_p / len(positive)) / ((in_u + 1) / n_u)
    chance = (in_u + 1) * len(positive) / n_u  # positives that would have it if it said nothing
    kept = wanted[(in_p >= chance + SURENESS * np.sqrt(chance) + LEAST) & (purity >= PURITY)]
    place = np.full(DIMENSIONS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    x = fit_slices(cut(patterns(texts, kept, heavy)), positive.keep(place), prior, len(kept))
    some = np.flatnonzero(np.abs(x[:-1]) > 1e-6)
    return ToxicModel(dict(zip(kept[some].tolist(), x[some].tolist(), strict=True)), float(x[-1]))


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(id, text) -> (doc_id, score); one pass. The model is bounded by the fit sample."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicModel(*shared.value)
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.score([t or "" for t in batch.column("text").to_pylist()]))], names=["doc_id", "score"])

    return docs.mapInArrow(scored, "doc_id long, score double")


def label_rows(labels: DataFrame, column: str) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("id"), F.col(column).cast("int").alias(column))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay."""
    model = fit_toxicity(keyed_text(docs, "doc_id", "text"), label_rows(labels, "toxic"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicModel(*shared.value)
        for batch in by_bytes(batches):
            yield batch.filter(pa.array(own.score([t or "" for t in batch.column("text").to_pylist()]) < threshold))

    return docs.mapInArrow(kept, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed_text(read(spark, sf_dir, "documents"), "doc_id", "text")
    model = fit_toxicity(docs, label_rows(read(spark, sf_dir, "labels"), "toxic"))
    return score_toxicity(docs, model).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", F.expr(f"int(score >= {THRESHOLD})").alias("predicted")
    )
