r"""Benchmark decontamination with an FM-index per training shard.

A shard is one slice of an Arrow batch (a few MB of text). Its words become
symbols of the benchmark's vocabulary. A phrase can only occur inside a run of
benchmark words at least as long as the shortest phrase, so the index holds just those
runs (exact, and much smaller than the text). Over them it keeps the
Burrows-Wheeler transform in a wavelet matrix with rank counts, and every eighth suffix
position. All phrases are searched backwards together, from the last word to the
first; the rows of a surviving range are walked to a sampled suffix for their
place. Places become spans per document, and overlapping spans are merged.

The benchmark is read in blocks of bounded bytes, each searched against all shards,
so what is sent to executors has a fixed bound however large the benchmark grows.

Words: A-Z lower-cased, then `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. Phrases: every 10 consecutive
words of an item; an item with fewer words, but not none, is one phrase.

Defined results: null and empty texts have no words and no hits; items without words
match nothing; equal items each count; a null item_id is written as an empty string;
rows that share an id each get their own result; an empty benchmark hits nothing;
further columns are ignored (or kept, by `remove_leaks`).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ledgerlens.llm.common import by_bytes, cut, keyed_text, ragged, ranges, read, texts_of

WINDOW = 10
SHARD_BYTES = 6 << 20
#: Bytes of benchmark text that are sent to executors at once.
BLOCK_BYTES = 16 << 20
SAMPLE = 8

#: Word bytes (lower-cased) stay, every other ASCII byte becomes a space.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")
#: An odd multiplier that mixes the hashes of windows.
HASH = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """0 for words that the benchmark doesn't have."""

    def __missing__(self, key: bytes) -> int:
        return 0


class Phrases:
    """The distinct windows of a block of benchmark items, in flat arrays.

    A phrase is a place in the words of all items, and a length. Windows of equal hash are one phrase if they are equal word for word.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.ids = _Ids()
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        texts, owner = [np.zeros(0, np.int32)], []
        for item, text in items:
            words = text.translate(TO_WORDS).split()
            if words:
                # Symbol 0 ends the text, 1 parts the runs.
                texts.append(np.fromiter((self.ids.setdefault(w, len(self.ids) + 2) for w in words), np.int32, len(words)))
                owner.append(number[item])
        self.n_symbols = len(self.ids) + 2
        self.symbols = np.concatenate(texts)
        n_words = np.fromiter(map(len, texts[1:]), np.int64, len(owner))
        count = np.maximum(1, n_words - window + 1)
        start = ranges(ragged(n_words)[0], count)
        length = np.repeat(np.minimum(n_words, window), count)
        phrase, first = self._distinct(start, length, window)
        self.starts, self.lengths = start[first].astype(np.int32), length[first].astype(np.int32)
        self.shortest = int(self.lengths.min()) if len(first) else 0
        pairs = np.unique(phrase * max(1, len(self.items)) + np.repeat(np.array(owner, np.int64), count))
        phrase, owner = np.divmod(pairs, max(1, len(self.items)))
        self.owner, self.owner_at = owner.astype(np.int32), np.append(0, np.cumsum(np.bincount(phrase, minlength=len(first))))

    def _distinct(self, start: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The phrase of each window, and a window of each phrase."""
        h = length.astype(np.uint64)
        for k in range(window):
            live = length > k
            h[live] = (h[live] + self.symbols[start[live] + k].astype(np.uint64)) * HASH
            h ^= h >> np.uint64(29)
        _, first, phrase = np.unique(h, return_index=True, return_inverse=True)
        other = first[phrase]
        equal = length[other] == length
        for k in range(window):
            live = np.flatnonzero(equal & (length > k))
            equal[live] = self.symbols[start[live] + k] == self.symbols[start[other[live]] + k]
        # Unequal windows of one hash each are a phrase of their own.
        apart = np.flatnonzero(~equal)
        phrase[apart] = len(first) + np.arange(len(apart))
        return phrase, np.concatenate([first, apart])

    def owners(self, phrase: int) -> list[str]:
        """The items that have a phrase."""
        return [self.items[i] for i in self.owner[self.owner_at[phrase] : self.owner_at[phrase + 1]]]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling the length that ranks stand for. The last symbol must be the only 0."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(text[order[1:]] != text[order[:-1]])
    width = 1
    while rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        width *= 2
    return order


class WaveletMatrix:
    """Rank and access over integer symbols, one level a bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((bit, before, zeros))
            symbols = symbols[np.argsort(ones, kind="stable")]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            ones_low, ones_high = before[low], before[high]
            low = np.where(one, zeros + ones_low, low - ones_low)
            high = np.where(one, zeros + ones_high, high - ones_high)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for bit, before, zeros in self.levels:
            one = before[at + 1] > before[at]
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros + before[at], at - before[at])
        return symbol


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_order(text)
        bwt = text[order - 1]
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.tree = WaveletMatrix(bwt, max(1, int(n_symbols - 1).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.sample_at = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, from row, to row) of the phrases that occur; a phrase is so many of the words from a start on."""
        live = np.arange(len(lengths))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for back in range(1, int(lengths.max()) + 1):
            step = lengths[live] >= back
            symbol = words[starts[live[step]] + lengths[live[step]] - back]
            start = self.first[symbol]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[step], high[step]]))
            low[step], high[step] = start + both[: len(symbol)], start + both[len(symbol) :]
            kept = high > low
            live, low, high = live[kept], low[kept], high[kept]
            if not len(live):
                break
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Suffix positions of rows: walk back to the next sampled suffix."""
        out, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            done = self.sampled[rows]
            out[todo[done]] = self.samples[self.sample_at[rows[done]]] + steps
            todo, rows = todo[~done], rows[~done]
            if len(todo):
                symbol = self.tree.access(rows)
                rows = self.first[symbol] + self.tree.rank(symbol, rows)
                steps += 1
        return out


def occurrences(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and for every occurrence its text, its first word and its phrase."""
    words = [t.translate(TO_WORDS).split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not n_words.sum():
        return n_words, none, none, none
    symbols = np.concatenate([np.fromiter(map(phrases.ids.__getitem__, w), np.int64, len(w)) for w in words])
    starts, owner = ragged(n_words)
    # Runs of benchmark words within one text.
    edge = np.ones(len(symbols), bool)
    edge[1:] = ((symbols[1:] > 0) != (symbols[:-1] > 0)) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(edge)
    long = np.diff(np.append(run, len(symbols)))
    kept = (symbols[run] > 0) & (long >= phrases.shortest)
    run, long = run[kept], long[kept]
    if not len(run):
        return n_words, none, none, none
    at = np.cumsum(long + 1) - long - 1  # each run is followed by a 1
    text = np.ones(int(long.sum()) + len(run) + 1, np.int64)
    text[ranges(at, long)] = symbols[ranges(run, long)]
    text[-1] = 0
    index = FMIndex(text, phrases.n_symbols)
    live, low, high = index.search(phrases.symbols, phrases.starts, phrases.lengths)
    count = high - low
    place = index.locate(ranges(low, count))
    phrase = np.repeat(live, count)
    of_run = np.searchsorted(at, place, side="right") - 1
    word = run[of_run] + place - at[of_run]
    return n_words, owner[word], word - starts[owner[word]], phrase


def merged_spans(doc: np.ndarray, start: np.ndarray, length: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of each text made one: (text, from word, to word)."""
    base = np.cumsum(n_words + 1) - n_words - 1  # a gap after each text keeps its spans apart
    depth = np.zeros(int((n_words + 1).sum()) + 1, np.int64)
    np.add.at(depth, base[doc] + start, 1)
    np.add.at(depth, base[doc] + start + length, -1)
    inside = np.concatenate([[0], (np.cumsum(depth) > 0).astype(np.int8), [0]])
    change = np.diff(inside)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    of = np.searchsorted(base, begin, side="right") - 1
    return of, begin - base[of], end - base[of]


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str, bytes]]]:
    """The items, in blocks of about BLOCK_BYTES; one partition of the benchmark is on the driver at a time."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item"], row["text"].encode()))
        size += len(block[-1][1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, row_key, n_words, spans (merged, in words) and items.

    One pass over the documents a block of benchmark, without a shuffle when there is one block.
    """
    spark = docs.sparkSession
    # The places of equal rows are merged by this key when there are several blocks.
    source = keyed_text(docs, id_col, text_col)
    schema = "doc_id long, text_key long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    source = source.withColumn("text_key", F.xxhash64("text"))
    found = None
    blocks = list(_broadcast_blocks(spark, benchmark))
    for shared in blocks:

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in by_bytes(batches, most=SHARD_BYTES):
                n_words, doc, start, phrase = occurrences(texts_of(batch), phrases)
                spans: dict[int, list[dict]] = defaultdict(list)
                for d, s, e in zip(*(x.tolist() for x in merged_spans(doc, start, phrases.lengths[phrase], n_words)), strict=True):
                    spans[d].append({"start": s, "end": e})
                items: dict[int, set[str]] = defaultdict(set)
                pairs = np.unique(doc * len(phrases.lengths) + phrase) if len(doc) else np.zeros(0, np.int64)
                for d, p in zip(*(x.tolist() for x in np.divmod(pairs, max(1, len(phrases.lengths)))), strict=True):
                    items[d].update(phrases.owners(p))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("text_key"),
                        pa.array(n_words, pa.int64()),
                        pa.array([spans.get(i, []) for i in range(n)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text_key", "n_words", "spans", "items"],
                )

        part = source.mapInArrow(searched, schema)
        found = part if found is None else found.unionByName(part)
    if len(blocks) > 1:
        found = _merge_blocks(found, len(blocks))
    return found.drop("text_key")


def _broadcast_blocks(spark: SparkSession, benchmark: DataFrame):
    some = False
    for block in benchmark_blocks(benchmark):
        some = True
        yield spark.sparkContext.broadcast(Phrases(block))
    if not some:
        yield spark.sparkContext.broadcast(Phrases([]))


def _merge_blocks(found: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of several blocks to one: union of items and of spans. Rows of one id and text are alike, so one result serves all of them."""
    merged = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.count("*").alias("times"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("all_spans"),
    )
    spans = F.expr(
        """aggregate(all_spans, cast(array() AS array<struct<start:int,end:int>>), (acc, s) ->
             CASE WHEN size(acc) > 0 AND element_at(acc, -1).end >= s.start
                  THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end))))
                  ELSE concat(acc, array(s)) END)"""
    )
    times = F.explode(F.sequence(F.lit(1), (F.col("times") / n_blocks).cast("int")))
    return merged.select("doc_id", "text_key", "n_words", spans.alias("spans"), "items", times.alias("copy")).drop("copy")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of merged spans."""
    places = [m.span() for m in WORD.finditer(text.translate(TO_WORDS))]
    kept, at = [], 0
    for b, e in spans:
        kept.append(text[at : places[b][0]])
        at = places[e - 1][1]
    kept.append(text[at:])
    return b" ".join(x for x in (k.strip(b" ") for k in kept) if x)


def spans_in(texts: list[bytes], phrases: Phrases) -> dict[int, list[tuple[int, int]]]:
    """The merged spans of the texts that have any."""
    n_words, doc, start, phrase = occurrences(texts, phrases)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, b, e in zip(*(x.tolist() for x in merged_spans(doc, start, phrases.lengths[phrase], n_words)), strict=True):
        spans[d].append((b, e))
    return spans


def cleaned(texts: list[bytes], phrases: Phrases) -> list[bytes]:
    """The texts without their spans. Where cutting joins words to a new phrase, that is cut too."""
    texts, todo = list(texts), list(range(len(texts)))
    while todo:
        found = spans_in([texts[i] for i in todo], phrases)
        for d, spans in found.items():
            texts[todo[d]] = without(texts[todo[d]], spans)
        todo = [todo[d] for d in sorted(found)]
    return texts


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the merged spans cut out of the text; rows, other columns and clean texts stay as they are.

    With several blocks of benchmark, the spans of all are found in the same text and cut at once, and the
    texts that changed go round again until no block hits, so the result doesn't depend on the blocks.
    `length_col`, if there is such a column, is set to the new length of a text that changed.
    """
    spark = docs.sparkSession
    schema = docs.schema
    places = {name: i for i, name in enumerate(schema.names)}
    blocks = list(_broadcast_blocks(spark, benchmark))

    def with_texts(batch: pa.RecordBatch, new: dict[int, bytes]) -> pa.RecordBatch:
        arrays = list(batch.columns)
        values = batch.column(text_col).to_pylist()
        lengths = batch.column(length_col).to_pylist() if length_col in places else None
        for i, text in new.items():
            values[i] = text.decode("utf-8", "replace")
            if lengths:
                lengths[i] = len(values[i])
        arrays[places[text_col]] = pa.array(values, batch.column(text_col).type)
        if lengths:
            arrays[places[length_col]] = pa.array(lengths, batch.column(length_col).type)
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    if len(blocks) == 1:

        def one_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, text_col, SHARD_BYTES):
                old = texts_of(batch, text_col)
                new = {i: y for i, (x, y) in enumerate(zip(old, cleaned(old, blocks[0].value), strict=True)) if x != y}
                yield with_texts(batch, new) if new else batch

        return docs.mapInArrow(one_block, schema)

    marks = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    marked = StructType([*schema.fields, StructField("__spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))])

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts the spans; those of texts that changed stay as a mark."""
        for batch in by_bytes(batches, text_col, SHARD_BYTES):
            texts, new = texts_of(batch, text_col), {}
            for i, found in enumerate(batch.column("__spans").to_pylist()):
                spans: list[tuple[int, int]] = []
                for b, e in sorted((x["start"], x["end"]) for x in found):
                    if spans and spans[-1][1] >= b:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], e))
                    else:
                        spans.append((b, e))
                if spans:
                    new[i] = without(texts[i], spans)
            yield with_texts(batch, new) if new else batch

    done, todo = None, docs
    while True:
        todo = todo.withColumn("__spans", F.expr("cast(array() AS array<struct<start:int,end:int>>)"))
        for shared in blocks:

            def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in by_bytes(batches, text_col, SHARD_BYTES):
                    found = spans_in(texts_of(batch, text_col), shared.value)
                    if found:
                        spans = batch.column("__spans").to_pylist()
                        for i, more in found.items():
                            spans[i] = spans[i] + [{"start": b, "end": e} for b, e in more]
                        batch = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, marks)], names=batch.schema.names)
                    yield batch

            todo = todo.mapInArrow(search, marked)
        todo = cut(todo.mapInArrow(cut_all, marked))
        same = todo.where("size(__spans) = 0").drop("__spans")
        done = same if done is None else done.unionByName(same)
        todo = todo.where("size(__spans) > 0").drop("__spans")
        if todo.isEmpty():
            return done


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: DuckDB, over whole tables: windows of words as strings, joined with each document's.
OP8_SQL = """
WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b0 AS (SELECT row_number() OVER () AS bid, coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b0 WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d0, ks WHERE len(w) >= k)),
hit AS (SELECT rid, i, dw.k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d0 LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
