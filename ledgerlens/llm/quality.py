"""Quality by co-training of a text-content view and a page-metadata view.

Content view: the text's words (hashed, lower-cased), the shapes of its tokens (letters, capitals, digits and marks, runs
made one), which shapes make up much of the text, and how varied its words
are. Metadata view: language, source, length, and the page's layout (lines, their
lengths). Neither view sees the other's features.

Rounds: each view's logistic model, fitted on its own labelled set, scores every document of the fit fold, labels unseen;
of those that it is SURE of, HANDED (split in the classes' proportion, the first by a hash of their features, equal ones once) go to
the other view's labelled set. In the end each view's logits are
calibrated on labelled rows that no fit used, and the score is a logistic combination of both.

Bounds: at most MOST_LABELLED labelled documents are sampled to fit on, and HANDED pseudo-labels go over in a round, as in the
published method. The pool is all documents of the fold (leaving out the labelled ones would deal out all texts by id): one pass over the text makes a table of their features, and each round reads that.
Features are those that a LEAST_SHARE of the labelled documents have and that tell the classes apart. Scoring covers every row and its whole text.

Defined results: null and empty texts have the features of an empty text; very long texts count whole; null language or source, or no
such column, is a value of its own; null labels are unlabelled; a document with several labels has the least; repeated rows
each get a score, and one sampled id has its least row; a score of exactly the threshold is good;
with labels of one class only every score is that class's smoothed share; an
empty table gives an empty result; further columns are ignored (or kept, by `keep_good`).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_bytes, cut, read
from ledgerlens.llm.linear import Rows, bounded_ids, fit_logistic, fit_scale, fold, from_binary, sigmoid

MOST_LABELLED = 6000
ROUNDS = 4
#: Documents that a view hands over in a round, and how sure it must be.
HANDED, SURE = 300, 0.97
DIMENSIONS = 1 << 18
#: A feature is kept if this share of the labelled documents, and so many, have it.
LEAST_SHARE, LEAST_SEEN = 0.01, 3
#: And it must tell the classes apart by so many standard deviations.
SURENESS = 6.0
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5

LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
REPEATS = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    token = LETTERS.sub(lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "x", token)
    return REPEATS.sub(r"\1", DIGITS.sub("9", token))


def bucket(name: str) -> int:
    return crc32(name.encode()) % DIMENSIONS


class Tokens(dict):
    """Shape and word feature (-1: not among the wanted ones) of each token, kept up to a bound."""

    def __init__(self, wanted: set[int] | None = None):
        self.wanted = wanted

    def __missing__(self, token: str) -> tuple[str, int]:
        word = bucket("word " + token.lower())
        found = shape(token), word if self.wanted is None or word in self.wanted else -1
        if len(self) < 200_000:
            self[token] = found
        return found


def text_features(text: str, known: Tokens) -> set[int]:
    tokens = Counter(text.split())
    n, shapes, out = tokens.total(), Counter(), set()
    for token, c in tokens.items():
        s, word = known[token]
        shapes[s] += c
        out.add(word)
    out.discard(-1)
    out |= {bucket(f"has {s}") for s in shapes}
    out |= {bucket(f"much {s} {int(5 * c / n)}") for s, c in shapes.items() if 5 * c >= n}
    out.add(bucket(f"varied {int(10 * len(tokens) / n) if n else 'none'} {min(int(math.log2(n + 1)) // 3, 4)}"))
    return out


def page_features(text: str, lang: str | None, source: str | None) -> set[int]:
    lines = text.count("\n") + 1
    level = lambda x: int(2 * math.log2(x + 1))
    return {
        bucket(x) for x in (f"lang {lang}", f"source {source}", f"lang and source {lang} {source}", f"chars {level(len(text))}", f"lines {level(lines)}", f"line length {level(len(text) / lines)}")
    }


def view_columns(docs: DataFrame) -> DataFrame:
    """id, text, lang, source under names of their own; null text is empty."""
    has = set(docs.columns)
    return docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[(F.col(c).cast("string") if c in has else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")],
    )


def both_views(batch: pa.RecordBatch, known: Tokens) -> Iterator[tuple[set[int], set[int]]]:
    has = set(batch.schema.names)
    lang, source = (batch.column(c).to_pylist() if c in has else [None] * batch.num_rows for c in ("lang", "source"))
    for i, text in enumerate(batch.column("text").to_pylist()):
        yield text_features(text or "", known), page_features(text or "", lang[i], source[i])


@dataclass
class QualityModel:
    """Weights (by feature) and bias of both views, and how their logits combine; without weights, the bias alone."""

    views: list[tuple[dict[int, float], float]]
    slopes: np.ndarray
    bias: float
    known: Tokens = field(init=False)

    def __post_init__(self):
        self.known = Tokens(set(self.views[0][0]) if self.views else set())

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        z = np.full(batch.num_rows, self.bias)
        if self.views:
            for i, views in enumerate(both_views(batch, self.known)):
                z[i] += sum(s * (sum(w[f] for f in sorted(w.keys() & features)) + b) for s, (w, b), features in zip(self.slopes, self.views, views, strict=True))
        return sigmoid(z)


def view_table(docs: DataFrame, columns: str, kept: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """docs as `view_columns` gives them -> the named columns of docs, and a, b: the features of both views as int32 bytes; of kept ones, their numbers."""
    names = [c.split()[0] for c in columns.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        known = Tokens(None if kept is None else set(kept[0].tolist()))
        for batch in by_bytes(batches):
            found = [[np.array(sorted(f), np.int32) for f in views] for views in both_views(batch, known)]
            if kept is not None:
                found = [[at(k, f) for k, f in zip(kept, views, strict=True)] for views in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([f[i].astype("<i4").tobytes() for f in found], pa.binary()) for i in (0, 1))], names=[*names, "a", "b"])

    return docs.mapInArrow(features, f"{columns}, a binary, b binary")


def at(kept: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Places of the features that are in `kept`."""
    place = np.minimum(np.searchsorted(kept, features), len(kept) - 1)
    return place[kept[place] == features]


def sure_of(pool: DataFrame, models: list[tuple[np.ndarray, float]], share: float, turn: int) -> list[tuple[int, int, bytes]]:
    """(view, class, the other view's features) of the pool rows that each view hands over: chosen over the whole pool."""
    most = {1: max(1, round(HANDED * share)), 0: max(1, round(HANDED * (1 - share)))}
    shared = pool.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], dict[int, bytes]] = {(v, c): {} for v in (0, 1) for c in (0, 1)}
        for batch in batches:
            views = [batch.column(c).to_pylist() for c in "ab"]
            h = [crc32(b"%d " % turn + x + b"|" + y) for x, y in zip(*views, strict=True)]
            for v, (w, bias) in enumerate(shared.value):
                p = sigmoid(from_binary(batch.column("ab"[v])).logits(w, bias))
                for c, sure in ((0, p <= 1 - SURE), (1, p >= SURE)):
                    own = best[v, c]
                    own.update((h[i], views[1 - v][i]) for i in np.flatnonzero(sure).tolist())
                    best[v, c] = dict(sorted(own.items())[: most[c]])
        rows = [(v, c, k, x) for (v, c), own in best.items() for k, x in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["view", "class", "h", "features"])

    rows = cut(pool.mapInArrow(run, "view int, class int, h long, features binary"))
    chosen = [(v, c, rows.where((F.col("view") == v) & (F.col("class") == c)).groupBy("h").agg(F.min("features").alias("features")).orderBy("h").limit(most[c])) for v in (0, 1) for c in (0, 1)]
    return [(v, c, bytes(r["features"])) for v, c, df in chosen for r in df.collect()]


def co_train(views: list[Rows], y: np.ndarray, labelled: np.ndarray, hand_over, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Models of both views; `labelled`: row numbers. hand_over(models, share, turn) gives (view, class, the other view's features)."""
    own = [v.take(labelled) for v in views]
    target = [y[labelled].astype(float) for _ in views]
    sizes = [int(v.ids.max(initial=-1)) + 1 for v in views]
    seen = [set(), set()]
    share = float(y[labelled].mean())
    for turn in range(rounds + 1):
        models = [fit_logistic(x, t, n) for x, t, n in zip(own, target, sizes, strict=True)]
        if turn == rounds:
            return models
        for v, c, features in hand_over(models, share, turn):
            to = 1 - v
            if features not in seen[to]:
                seen[to].add(features)
                ids = np.frombuffer(features, "<i4").astype(np.int64)
                own[to] = Rows(np.append(own[to].ids, ids), np.append(own[to].lengths, len(ids)))
                target[to] = np.append(target[to], float(c))
    return models


def fit_quality(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> QualityModel:
    """docs as `view_columns` gives them; labels: (id, quality). Both are cut to the fit fold here."""
    fit = fold("id", FOLDS) != HELD_OUT
    known = labels.where(fit & F.col("quality").isNotNull()).groupBy("id").agg(F.min("quality").alias("quality"))
    # Bounded by most_labelled rows, so it may be broadcast.
    chosen = F.broadcast(bounded_ids(known.select("id"), most_labelled).join(known, "id"))
    rows = docs.join(chosen, "id").groupBy("id", "quality").agg(F.min(F.struct("text", "lang", "source")).alias("row")).select("id", "quality", "row.*")
    table = view_table(rows, "id long, quality int").toArrow().sort_by("id")
    y = np.array([int(q > 0) for q in table["quality"].to_pylist()], np.int64)
    good = int(y.sum())
    if good in (0, len(y)):
        return QualityModel([], np.zeros(0), float(np.log((good + 0.5) / (len(y) - good + 0.5))))
    views = [from_binary(table[c]) for c in "ab"]
    kept = tuple(np.flatnonzero(telling(v, y)) for v in views)
    kept = tuple(k if len(k) else np.unique(v.ids) for k, v in zip(kept, views, strict=True))
    views = [v.keep(places(k)) for v, k in zip(views, kept, strict=True)]
    calibrate = np.array([crc32(f"calibrate {i}".encode()) % 4 == 0 for i in table["id"].to_pylist()])
    every = np.arange(len(y))
    train, held = every[~calibrate], every[calibrate]
    if len(np.unique(y[train])) < 2 or len(np.unique(y[held])) < 2:  # too few to part
        train = held = every
    pool = cut(view_table(docs.where(fit).select("text", "lang", "source", F.lit(0).alias("row")), "row int", kept).drop("row"))
    models = co_train(views, y, train, lambda models, share, turn: sure_of(pool, models, share, turn))
    scales = [fit_scale(v.take(held).logits(*m), y[held]) for v, m in zip(views, models, strict=True)]
    models = [(w * float(s[0]), b * float(s[0]) + c) for (w, b), (s, c) in zip(models, scales, strict=True)]
    slopes, bias = fit_scale(np.column_stack([v.take(held).logits(*m) for v, m in zip(views, models, strict=True)]), y[held])
    return QualityModel([(dict(zip(k.tolist(), w.tolist(), strict=True)), b) for k, (w, b) in zip(kept, models, strict=True)], slopes, bias)


def telling(rows: Rows, y: np.ndarray) -> np.ndarray:
    """Which features enough rows have, with a share of label 1 that is SURENESS deviations off the overall one."""
    n, share = rows.counts(DIMENSIONS), y.mean()
    good = np.bincount(rows.ids, weights=y[rows.owner], minlength=DIMENSIONS)
    off = np.abs(good - share * n) >= SURENESS * np.sqrt(n * share * (1 - share))
    return (n >= max(LEAST_SHARE * len(y), LEAST_SEEN)) & off


def places(kept: np.ndarray) -> np.ndarray:
    place = np.full(DIMENSIONS, -1, np.int64)
    place[kept] = np.arange(len(kept))
    return place


def _with_scores(docs: DataFrame, model: QualityModel):
    shared = docs.sparkSession.sparkContext.broadcast((model.views, model.slopes, model.bias))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        own = QualityModel(*shared.value)
        for batch in by_bytes(batches):
            yield batch, own.score(batch)

    return scored


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score): the probability of label 1, for every row."""
    scored = _with_scores(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scored(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def label_rows(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score under the threshold; all columns stay."""
    scored = _with_scores(docs, fit_quality(view_columns(docs), label_rows(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scored(batches):
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view_columns(read(spark, sf_dir, "documents"))
    model = fit_quality(docs, label_rows(read(spark, sf_dir, "labels")))
    return score_quality(docs, model).select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", F.expr(f"int(score >= {THRESHOLD})").alias("predicted")
    )
