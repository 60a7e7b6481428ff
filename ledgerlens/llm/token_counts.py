"""Token counts by rank-synchronous array merging (byte-level BPE).

Pre-tokens are held as ragged numpy arrays of symbol ids. In each round every
sequence looks up the rank of each adjacent pair, takes its own lowest, and
merges all occurrences of that pair at once, left to right; sequences
without a known pair are done and leave. A merge of rank r makes a symbol
that only later ranks use, so merging all occurrences of the lowest pair
together gives what a queue gives that takes them one at a time.

The count of each distinct piece of text is kept in a bounded table per
task, so that a frequent word is merged once.

Defined results: null and empty text count 0 tokens; repeated rows and ids each
get their row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.common import by_bytes, keyed_text, ragged, read

#: Distinct pieces whose counts a task keeps; the table is emptied when full.
KEPT_PIECES = 400_000

# The white space of the vocabulary's pre-tokenizer.
SPACES = "\t-\r \x85\xa0  -     　"

PRE_TOKEN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

#: A space that touches other white space or an end of the text: such texts are not cut at spaces.
LOOSE_SPACE = re.compile(r" \s|\s |^ | $")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeTable:
    """Ranked pairs of a byte-level BPE vocabulary file, in sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in file["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.of_byte = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.of_byte[byte] = vocab[char]
        self.none = np.int64(len(keys))
        self.special = [t["content"] for t in file.get("added_tokens", []) if t.get("special")]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (`none` where unknown) and the row in the table."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], self.none), at

    def count(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        out = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        ids = self.of_byte[np.frombuffer(b"".join(pre_tokens), np.uint8)]
        todo = np.flatnonzero(out > 1)
        if len(todo) < len(out):
            ids = ids[np.repeat(out > 1, out)]
        lengths = out[todo]
        while len(todo):
            starts, owner = ragged(lengths)
            rank = np.full(len(ids), self.none, np.int64)
            row = np.zeros(len(ids), np.int64)
            inner = np.ones(len(ids), bool)
            inner[starts + lengths - 1] = False
            at = np.flatnonzero(inner)
            rank[at], row[at] = self.lookup(ids[at], ids[at + 1])
            lowest = np.minimum.reduceat(rank, starts)
            hit = (rank == lowest[owner]) & (rank < self.none)
            # In a run of hits that overlap (a pair of one symbol with itself), every second one counts.
            places = np.flatnonzero(hit)
            if len(places):
                new = np.ones(len(places), bool)
                new[1:] = (np.diff(places) != 1) | (owner[places[1:]] != owner[places[:-1]])
                first = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - first) % 2 == 0]
                ids[places] = self.made[row[places]]
                keep = np.ones(len(ids), bool)
                keep[places + 1] = False
                ids, lengths = ids[keep], lengths - np.bincount(owner[places], minlength=len(lengths))
            out[todo] = lengths
            going = (lowest < self.none) & (lengths > 1)
            if not going.all():
                ids = ids[np.repeat(going, lengths)]
                todo, lengths = todo[going], lengths[going]
        return out


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class Counter:
    """Counts tokens of whole texts; keeps the counts of pieces it has seen."""

    def __init__(self, path: str):
        self.table = merge_table(path)
        self.pattern = regex.compile(PRE_TOKEN)
        self.seen: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that are pre-tokenized independently: cut at single spaces between other characters."""
        if LOOSE_SPACE.search(text):
            return self.pattern.findall(text)
        first, *others = text.split(" ")
        return [first, *[f" {x}" for x in others]]

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.seen]
        if not new:
            return
        if len(self.seen) + len(new) > KEPT_PIECES:
            self.seen.clear()
            new = list(pieces)
        tokens, owner = [], []
        for i, piece in enumerate(new):
            found = self.pattern.findall(piece)
            tokens += found
            owner += [i] * len(found)
        counts = np.zeros(len(new), np.int64)
        if tokens:
            np.add.at(counts, np.array(owner), self.table.count([t.encode() for t in tokens]))
        self.seen.update(zip(new, counts.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            cut = [text]
            for special in self.table.special:  # its string in a text is one token
                cut = [y for x in cut for y in x.split(special)]
            extra.append(len(cut) - 1)
            parts.append([p for x in cut if x for p in self.pieces(x)])
        self.learn(set().union(*parts))
        return [n + sum(map(self.seen.__getitem__, p)) for n, p in zip(extra, parts, strict=True)]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; one pass, no shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in by_bytes(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(read(spark, sf_dir, "documents"), default_tokenizer())
    return counts.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 1024 AS over_limit")
