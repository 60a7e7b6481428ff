"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The text, with a space put before it, is cut into segments before each run of spaces and
each new line. No piece of the vocabulary has a space after another character, and a new line is
a byte piece of its own, so the lattice of a text is the lattices of its segments, one after the other. Forward
filtering sums, for each position of each distinct segment, the weight of all ways to get
there; backward sampling draws, for every occurrence at once, the last piece, then the
one before, until the start. The draws come from a hash of (seed, row key, segment
number, step), so a row's segmentation does not depend on partitions, order or retries.

Weights: a unigram model's scores are log probabilities as they are. A BPE model only
ranks its pieces, so its pieces get Zipf's weights 1 / (rank + 1), normalised. `theta`
sharpens or flattens them. A character that is no piece is written as byte pieces.

Decoding joins pieces: the space mark becomes a space, byte pieces their bytes, and the
first space goes. A space mark that stands in the text itself is written as bytes, so
decoding gives back every text exactly.

Defined results: null text is empty; an empty text has the one piece of its first
space; rows with one id and text get one segmentation; a null id is a key of its own; a segment of
any length is one lattice; further columns are ignored (or kept, by `with_pieces`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerlens.llm.common import by_bytes, keyed_text, ragged, ranges, read, strings

MARK = "▁"
SEED, THETA = 7, 1.0
SHARD_BYTES = 1 << 20
#: Edges of distinct segments that a task keeps; the lattice starts anew beyond it.
KEPT_EDGES = 4_000_000
#: Characters of new segments that are filtered at once, which bounds what filtering takes besides the lattice.
ADDED_CHARS = 128 << 10
SEGMENT = re.compile(r"\n[^ \n]*| *[^ \n]+| +")
#: Stands for a space that isn't there, before a new line, while Arrow cuts at spaces.
CUT = "\x01"


class Pieces:
    """The vocabulary as a trie in sorted arrays."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        plain: list[tuple[str, int, float]] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append((piece, i, model.get_score(i)))
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so that decoding can't be lossless")
        if any(MARK in p.lstrip(MARK) for p, _, _ in plain):
            raise ValueError("pieces go over word ends, so that segments aren't independent")
        if any("\n" in p for p, _, _ in plain):
            raise ValueError("pieces hold a new line, so that segments aren't independent")
        scores = np.array([s for _, _, s in plain])
        if len(scores) and np.all(scores == np.round(scores)):  # ranks of merges
            rank = np.empty(len(plain))
            rank[np.argsort(-scores, kind="stable")] = np.arange(len(plain))
            scores = -np.log(rank + 1)
        logs = theta * (scores - np.logaddexp.reduce(scores))
        self.byte_log = float(logs.min())
        # Codes: 0 is a character without a piece, 1 the space mark.
        chars = sorted({c for p, _, _ in plain for c in p} - {MARK})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        self.code[ord(" ")] = 1
        self.single = np.zeros(len(chars) + 2, bool)
        children: dict[int, int] = {}
        ends: dict[int, tuple[int, float]] = {}
        width = np.int64(len(chars) + 2)
        self.width = width
        code_of = {c: i for i, c in enumerate(chars, 2)} | {MARK: 1}
        for (piece, i, _), log in zip(plain, logs.tolist(), strict=True):
            node = 0
            for c in piece:
                node = children.setdefault(node * int(width) + code_of[c], len(children) + 1)
            ends[node] = (i, log)
            if len(piece) == 1:
                self.single[code_of[piece]] = True
        keys = np.array(list(children), np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(children.values()), np.int64)[order]
        self.end_id, self.end_log = np.full(len(children) + 1, -1, np.int64), np.zeros(len(children) + 1)
        for node, (i, log) in ends.items():
            self.end_id[node], self.end_log[node] = i, log
        self.root = np.array([children.get(c, 0) for c in range(int(width))], np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str, theta: float) -> Pieces:
    return Pieces(path, theta)


def segments_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct segments, the number of each segment of all texts in order, and how many each text has.

    A text is cut before each space and each new line; only where spaces adjoin, or end a text, is there more to a segment.
    """
    texts = strings(texts)
    loose = np.asarray(pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.ends_with(texts, " "), pc.or_(pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, CUT)), pc.equal(texts, "")))))
    parts = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~loose)), "\n", " " + CUT), " ")
    others = [SEGMENT.findall(" " + t) for t in texts.filter(pa.array(loose)).to_pylist()]
    number = np.empty(len(loose), np.int64)
    number[~loose] = np.asarray(pc.list_value_length(parts))
    number[loose] = [len(x) for x in others]
    # The space before a segment is left out here; CUT stands for a new line before it.
    flat = pa.chunked_array([parts.flatten(), pa.array([x[1:] if x[0] == " " else CUT + x[1:] for o in others for x in o], pa.large_string())]).combine_chunks()
    coded = (flat if isinstance(flat, pa.Array) else flat.chunk(0)).dictionary_encode()
    order = np.concatenate([np.flatnonzero(~loose), np.flatnonzero(loose)])
    start = np.empty(len(loose), np.int64)
    start[order] = np.cumsum(number[order]) - number[order]
    return ["\n" + x[1:] if x[:1] == CUT else " " + x for x in coded.dictionary.to_pylist()], np.asarray(coded.indices)[ranges(start, number)], number


def sort_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of keys below 2^32, by two passes over 16 bits each."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high = (keys >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts_of(segments: list[str], most: int) -> Iterator[list[str]]:
    """The segments, the longest first, in lists of about `most` characters and at least one segment."""
    segments = sorted(segments, key=len, reverse=True)
    part = np.fromiter(accumulate(map(len, segments)), np.int64, len(segments)) // most
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(segments)).tolist()
    for at, to in zip(cuts, cuts[1:], strict=False):
        yield segments[at:to]


class Growing:
    """An array that is added to in place; `held` has room beyond `size`, which takes no memory until it is written."""

    def __init__(self, dtype: type):
        self.held, self.size = np.empty(1 << 16, dtype), 0

    def add(self, more: np.ndarray) -> None:
        to = self.size + len(more)
        if to > len(self.held):
            old, self.held = self.held, np.empty(max(to, 2 * len(self.held)), self.held.dtype)
            self.held[: self.size] = old[: self.size]
        self.held[self.size : to] = more
        self.size = to


class Lattice:
    """The lattices of distinct segments: edges by the node they end at, and how likely each is the last.

    Segments are added as they come, so that one that comes again is not filtered again.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.start, self.end, self.first_edge = Growing(np.int32), Growing(np.int32), Growing(np.int32)
        self.source, self.piece, self.up_to = Growing(np.int32), Growing(np.int32), Growing(np.float64)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        for x in (self.start, self.end, self.first_edge, self.source, self.piece, self.up_to):
            x.size = 0

    def numbers(self, segments: list[str]) -> np.ndarray:
        """Where each distinct segment is in the lattice; new ones are added."""
        new = [s for s in segments if s not in self.index]
        if new:
            if self.source.size > KEPT_EDGES:
                self.forget()
                new = segments
            for part in parts_of(new, ADDED_CHARS):
                self.add(part)
        return np.fromiter(map(self.index.__getitem__, segments), np.int64, len(segments))

    def add(self, segments: list[str]) -> None:
        # Longest first: then the nodes of a place in their segments are numbered one after the other.
        segments = sorted(segments, key=len, reverse=True)
        pieces = self.pieces
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        points = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")
        codes = pieces.code[points]
        starts, owner = ragged(lengths)
        place = np.arange(len(codes)) - starts[owner]
        # level[p]: the first node of place p. Node = level[place] + segment.
        at_place = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1), side="right")
        level = np.append(0, np.cumsum(at_place))
        last = lengths[owner]
        froms, tos, ids, logs = [], [], [], []
        live, state, depth = np.arange(len(codes)), pieces.root[codes], 1
        while True:
            some = state > 0
            live, state = live[some], state[some]
            if not len(live):
                break
            end = pieces.end_id[state] >= 0
            ending, node = live[end], state[end]
            froms.append((level[place[ending]] + owner[ending]).astype(np.int32))
            tos.append((level[place[ending] + depth] + owner[ending]).astype(np.int32))
            ids.append(pieces.end_id[node].astype(np.int32))
            logs.append(pieces.end_log[node])
            inside = place[live] + depth < last[live]
            live, state = live[inside], state[inside]
            key = state * pieces.width + codes[live + depth]
            at = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            state = np.where(pieces.keys[at] == key, pieces.child[at], 0)
            depth += 1
        lone = np.flatnonzero(~pieces.single[codes])  # written as bytes
        size = 1 + (points[lone] > 0x7F).astype(np.int64) + (points[lone] > 0x7FF) + (points[lone] > 0xFFFF)
        froms.append((level[place[lone]] + owner[lone]).astype(np.int32))
        tos.append((level[place[lone] + 1] + owner[lone]).astype(np.int32))
        ids.append((-1 - points[lone].astype(np.int64)).astype(np.int32))
        logs.append(size * pieces.byte_log)
        source, target, piece, log = (np.concatenate(x) for x in (froms, tos, ids, logs))
        order = sort_order(target)
        source, target, piece, log = source[order], target[order], piece[order], log[order]
        # Forward filtering, one place of all segments at a time. Every node but the first ones has an edge into it.
        heads = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        each = np.diff(np.append(heads, len(target)))
        alpha = np.zeros(int(level[-1]))
        share = np.empty(len(target))
        edge_of = np.append(np.zeros(level[1], np.int64), heads)  # first edge of each node
        n_edges = np.append(np.zeros(level[1], np.int64), each)
        for p in range(1, len(level) - 1):
            a, b = level[p], level[p + 1]
            e0, e1 = edge_of[a], edge_of[b - 1] + n_edges[b - 1]
            total = alpha[source[e0:e1]] + log[e0:e1]
            most = np.maximum.reduceat(total, edge_of[a:b] - e0)
            total = np.exp(total - np.repeat(most, n_edges[a:b]))
            summed = np.add.reduceat(total, edge_of[a:b] - e0)
            alpha[a:b] = most + np.log(summed)
            share[e0:e1] = total / np.repeat(summed, n_edges[a:b])
        # Shares of the edges into a node, summed up one by one (so that no other segment touches the rounding); the last is over any draw.
        on, step = heads[each > 1] + 1, 1
        count = each[each > 1]
        while len(on):
            share[on] += share[on - 1]
            step += 1
            on, count = on[count > step] + 1, count[count > step]
        share[heads + each - 1] = 2.0
        nodes, edges, known = self.first_edge.size, self.source.size, self.start.size
        self.index.update(zip(segments, range(known, known + len(segments)), strict=True))
        self.start.add(nodes + np.arange(len(segments)))
        self.end.add(nodes + level[lengths] + np.arange(len(segments)))
        self.first_edge.add(edges + edge_of)
        self.source.add(nodes + source)
        self.piece.add(piece)
        self.up_to.add(share)

    def sample(self, segment: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sampled edges of each occurrence in order, and how many each has."""
        at, start, live = self.end.held[segment], self.start.held[segment], np.arange(len(segment))
        taken, counts = [], np.zeros(len(segment), np.int64)
        while len(live):
            step = np.uint64(len(taken) * 0x9E3779B97F4A7C15 % 2**64)
            u = (mix(seeds[live] + step) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first_edge.held[at]
            over = np.flatnonzero(u >= self.up_to.held[edge])
            while len(over):
                edge[over] += 1
                over = over[u[over] >= self.up_to.held[edge[over]]]
            taken.append((live, edge))
            counts[live] += 1
            at = self.source.held[edge]
            going = at != start[live]
            live, at = live[going], at[going]
        out = np.empty(int(counts.sum()), np.int32)
        ends = np.cumsum(counts)
        for i, (who, edge) in enumerate(taken):
            out[ends[who] - 1 - i] = edge
        return out, counts


def encode(texts: pa.Array, keys: list, lattice: Lattice, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of all texts, one after the other, and how many each text has."""
    pieces = lattice.pieces
    distinct, segment, number = segments_of(texts)
    segment = lattice.numbers(distinct)[segment] if len(segment) else segment
    first, owner = ragged(number)
    row = np.array([xxhash.xxh64_intdigest(repr(k), seed) for k in keys], np.uint64)
    seeds = mix(row[owner] + (np.arange(len(owner)) - first[owner]).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    edges, counts = lattice.sample(segment, seeds)
    ids = lattice.piece.held[edges].astype(np.int64)
    per_text = np.add.reduceat(np.append(counts, 0), first) if len(first) else counts
    lone = np.flatnonzero(ids < 0)
    if len(lone):  # characters written as bytes
        raw = [chr(c).encode() for c in (-1 - ids[lone]).tolist()]
        more = np.fromiter(map(len, raw), np.int64, len(raw))
        width = np.ones(len(ids), np.int64)
        width[lone] = more
        of_text = np.repeat(np.arange(len(texts)), per_text)
        at = np.cumsum(width) - width
        wide = np.repeat(ids, width)
        wide[ranges(at[lone], more)] = pieces.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        ids, per_text = wide, np.bincount(of_text, weights=width, minlength=len(texts)).astype(np.int64)
    return ids, per_text


def decode(ids: list[int] | np.ndarray, path: str, theta: float = THETA) -> str:
    table = vocabulary(path, theta).bytes_of
    return b"".join(map(table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))[1:].decode()


def with_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, theta: float = THETA, out: str = "pieces") -> DataFrame:
    """docs with the sampled piece ids of each text in a column of their own, which replaces one of that name."""
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path, theta))
        for batch in by_bytes(batches, text_col, SHARD_BYTES):
            ids, each = encode(batch.column(text_col), batch.column(id_col).to_pylist(), lattice, seed)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, path: str, column: str = "pieces", out: str = "decoded") -> DataFrame:
    """rows with the text that the piece ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, path) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(out, T.StringType())]))


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes within one task; a row tells the number and digest of its pieces, and if decoding gave the text back."""
    path = default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path, THETA))
        for batch in by_bytes(batches, most=SHARD_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, each = encode(batch.column("text"), batch.column("id").to_pylist(), lattice)
            ends = np.cumsum(each)
            rows = [ids[a:b] for a, b in zip((ends - each).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(each, pa.int64()),
                    pa.array([hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in rows]),
                    pa.array([decode(r, path) == t for r, t in zip(rows, texts, strict=True)]),
                ],
                names=["doc_id", "n_bytes", "n_pieces", "pieces_sha256", "lossless"],
            )

    return keyed_text(read(spark, sf_dir, "documents"), "doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_pieces long, pieces_sha256 string, lossless boolean"
    )
