r"""Language-model scores: a causal self-attention model over subword ids, in numpy.

Tokens of the contract: A-Z lower-cased words `[^\x20\x09-\x0D]+`, then one end. Each word
becomes subword ids of a public vocabulary. The network embeds the ids, runs one head of
masked attention over windows of WINDOW ids, and predicts the next id by class, then by
member of the class. Windows overlap: each id is scored in one window only, and all but a text's
first ids see at least WINDOW - STRIDE ids before it. Ids outside the HEAD most frequent
share a slot, and the slot's probability by their counts.

Classes either begin a word (or end the text) or go on with one, so the network gives the
probability that a word is over, and with it a proper probability of whole words:
    P(word) = P(first id | a word begins) * prod P(next id) * P(the word is over).
The model's probability of a word mixes three causal parts: the network's; the
share of the word in all training tokens; and a copy head that attends evenly to all earlier
words of the text. All three sum to at most one, and so does a mixture. A text's
probability is the mean over a few fixed mixtures, so that each text leans to the one that suits it.

Texts are dealt to slices of about SLICE_BYTES by a hash of id and text, sorted within their slice; all that is fitted or scored
goes by slices, so the scores don't depend on the partitions of the input.
Training covers the corpus: the word counts, and the subword counts from them, are of all training texts;
the network is fitted by ROUNDS of local SGD, in which each slice trains on all of its training texts, and the weights are
averaged in two levels, so that no task or driver sees more than its part. The rounds take the slices in turn, so
each text is trained on in one of them (a corpus of one slice in all).

One pass lists the words of each slice with their counts. The sums of these are the corpus counts, and the same rows ask for
them: a slice gets the counts of its distinct words once, however often they occur. The FREQUENT commonest words are sent
to all slices instead, so no word has a row a slice.

Defined results: null text is empty, and an empty text is its end alone; rows with one id and text
get one result; a null id has no crc32 and is trained on; without training texts every count is 0;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_bytes, free_shuffles, keyed_text, ragged, read, shared_table, strings
from ledgerlens.llm.linear import fold

WINDOW, STRIDE = 16, 12
WIDTH, HIDDEN = 16, 32
CLASSES, MEMBERS = 32, 32
SLOTS = CLASSES * MEMBERS
#: Slots of the first half begin a word; the first two are the end of the text, and the rarer word beginnings.
END, RARE_FIRST, RARE_NEXT = 0, 1, SLOTS // 2
#: A slice takes batches of BATCH windows, at least LEAST_STEPS of them a round if MOST_EPOCHS give so many.
ROUNDS, BATCH, LEAST_STEPS, MOST_EPOCHS = 2, 64, 300, 6
#: The commonest words, whose counts every task gets.
FREQUENT = 50_000
#: Weights of the count, network and copy parts that a text may have; all are as likely beforehand.
MIXTURES = ((0.15, 0.68, 0.17), (0.45, 0.40, 0.15), (0.80, 0.08, 0.12), (0.93, 0.06, 0.01), (0.03, 0.95, 0.02), (0.10, 0.40, 0.50), (0.03, 0.07, 0.90), (0.30, 0.05, 0.65))
SLICE_BYTES = 8 << 20
#: Words of the texts that are scored at a time.
PART_WORDS = 300_000
FOLDS, HELD_OUT = 7, 2
SHAPES = {
    "emb": (SLOTS, WIDTH), "pos": (WINDOW, WIDTH), "wq": (WIDTH, WIDTH), "wk": (WIDTH, WIDTH), "wv": (WIDTH, WIDTH), "w1": (2 * WIDTH, HIDDEN), "b1": (HIDDEN,),
    "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wm": (CLASSES, HIDDEN, MEMBERS), "bm": (CLASSES, MEMBERS),
}
MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))
SCALE = np.float32(1 / math.sqrt(WIDTH))
#: Logits up to this size need no shift in float32.
CEILING = np.float32(60)


def within(logits: np.ndarray) -> bool:
    return not logits.size or bool(logits.max() <= CEILING and logits.min() >= -CEILING)


def error(logits: np.ndarray, right: np.ndarray, weight: np.floating) -> np.ndarray:
    """Turns logits to their gradient, weight * (softmax - 1 at the right answer), in place; gives the probability of the right answer."""
    if not within(logits):
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    share = 1 / (logits @ np.ones(logits.shape[1], logits.dtype))
    at = np.arange(0, logits.size, logits.shape[1]) + right
    likely = logits.ravel().take(at) * share
    logits *= (share * weight)[:, None]
    logits.ravel()[at] -= weight
    return likely


@lru_cache(maxsize=1)
def subwords(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@dataclass
class Slots:
    """Slot of each subword id, and the log probability of an id in its slot."""

    slot: np.ndarray
    log_share: np.ndarray
    log_counts: np.ndarray


def make_slots(path: str, counts: dict[int, int]) -> Slots:
    """The most frequent word beginnings and continuations get slots of their own. `counts` has the ends under -1."""
    model = subwords(path)
    n = model.get_piece_size()
    first = np.array([model.id_to_piece(i)[:1] == "▁" for i in range(n)])
    found = np.array([counts.get(i, 0) for i in range(n)], np.int64)
    slot, rest = np.where(first, RARE_FIRST, RARE_NEXT), np.zeros(n)
    total = np.ones(SLOTS)
    total[END] += counts.get(-1, 0)
    for begins, at, room in ((True, 2, SLOTS // 2 - 2), (False, RARE_NEXT + 1, SLOTS // 2 - 1)):
        ids = np.flatnonzero(first == begins)
        ids = ids[np.argsort(-found[ids], kind="stable")]
        own, others = ids[:room], ids[room:]
        slot[own] = at + np.arange(len(own))
        total[slot[own]] += found[own]
        total[RARE_FIRST if begins else RARE_NEXT] += found[others].sum()
        rest[others] = np.log((found[others] + 1) / (found[others] + 1).sum())
    return Slots(slot.astype(np.int16), rest.astype(np.float32), np.log(total / total.sum()).astype(np.float32))


class Network:
    """Weights in one flat array; forward and backward over windows of slots."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in SHAPES.items():
            size = math.prod(shape)
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def size() -> int:
        return sum(math.prod(s) for s in SHAPES.values())

    @classmethod
    def start(cls, log_counts: np.ndarray) -> Network:
        """Small random weights; biases give the slots' frequencies."""
        rng = np.random.default_rng(11)
        net = cls(np.zeros(cls.size(), np.float32))
        for name in ("emb", "pos", "wq", "wk", "wv", "w1", "wc", "wm"):
            x = getattr(net, name)
            x[...] = rng.normal(0, 0.3 if name in ("emb", "pos") else 1 / math.sqrt(x.shape[-2]), x.shape) * (0.3 if name in ("wc", "wm") else 1)
        by_class = log_counts.reshape(CLASSES, MEMBERS)
        net.bc[...] = np.logaddexp.reduce(by_class, axis=1)
        net.bm[...] = by_class - net.bc[:, None]
        return net

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries by keys as one scaled matrix between two states; and the hidden layer's weights for a state and a mean of states, the values' folded in."""
        return self.wq @ self.wk.T * SCALE, np.concatenate([self.w1[:WIDTH], self.wv @ self.w1[WIDTH:]])

    def scorer(self) -> Scorer:
        return Scorer(self)

    def gradient(self, x_in: np.ndarray, target: np.ndarray, weight: np.ndarray, grad: Network | None = None) -> tuple[np.ndarray, float]:
        """Of the mean loss over the places with weight 1; x_in: (windows, WINDOW) slots. It is put into `grad`, if that is given."""
        grad = grad or Network(np.empty_like(self.flat))
        grad.wm[...], grad.bm[...] = 0, 0  # classes without a target
        b, dtype = len(x_in), self.flat.dtype
        match, w1 = self.folded()
        x = self.emb.take(x_in, axis=0)
        x += self.pos
        states = x.reshape(-1, WIDTH)
        # Attention and, later, the gradient of its logits lie one below the other, as do what they are multiplied by.
        left, right = np.empty((b, 2 * WINDOW, WINDOW), dtype), np.empty((b, 2 * WINDOW, WIDTH), dtype)
        a, q = left[:, :WINDOW], right[:, WINDOW:]
        q[...] = (states @ match).reshape(b, WINDOW, WIDTH)
        np.matmul(q, x.transpose(0, 2, 1), out=a)
        if not within(a):
            a += MASK
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a *= CAUSAL
        np.einsum("bij,bi->bij", a, 1 / np.matmul(a, np.ones(WINDOW, dtype)), out=a)
        o = np.matmul(a, x).reshape(-1, WIDTH)
        t = target.reshape(-1)
        # Places with weight, in the order of their targets' classes; beyond attention there are no others.
        kind, member = np.divmod(t, MEMBERS)
        live = np.count_nonzero(weight)
        order = np.argsort(np.where(weight.reshape(-1) > 0, kind, CLASSES).astype(np.uint8), kind="stable")[:live]
        kind, member, w = kind.take(order), member.take(order), dtype.type(1 / max(1, live))
        z = np.empty((live, 2 * WIDTH), dtype)
        z[:, :WIDTH], z[:, WIDTH:] = states.take(order, axis=0), o.take(order, axis=0)
        g = z @ w1
        g += self.b1
        np.maximum(g, 0, out=g)
        ends = np.append(0, np.cumsum(np.bincount(kind, minlength=CLASSES)))
        some = [(i, slice(m, n)) for i, (m, n) in enumerate(pairwise(ends.tolist())) if m < n]
        m, dg = np.empty((live, MEMBERS), dtype), np.empty((live, HIDDEN), dtype)
        for i, own in some:
            np.dot(g[own], self.wm[i], out=m[own])
        m += self.bm.take(kind, axis=0)
        c = g @ self.wc
        c += self.bc
        likely = error(c, kind, w)
        likely *= error(m, member, w)
        loss = -float(np.log(likely + 1e-30).sum() * w)
        one = np.ones(live, dtype)
        np.matmul(g.T, c, out=grad.wc)
        np.matmul(one, c, out=grad.bc)
        for i, own in some:
            np.dot(g[own].T, m[own], out=grad.wm[i])
            np.dot(one[own], m[own], out=grad.bm[i])
            np.dot(m[own], self.wm[i].T, out=dg[own])
        dg += c @ self.wc.T
        dg *= g > 0
        by_weight = z.T @ dg
        grad.w1[:WIDTH], grad.w1[WIDTH:], grad.wv[...] = by_weight[:WIDTH], self.wv.T @ by_weight[WIDTH:], by_weight[WIDTH:] @ self.w1[WIDTH:].T
        np.matmul(one, dg, out=grad.b1)
        # Places without weight read a last row of zeros.
        dz = np.zeros((live + 1, 2 * WIDTH), dtype)
        np.matmul(dg, w1.T, out=dz[:live])
        row = np.full(len(t), live)
        row[order] = np.arange(live)
        dz = dz.take(row, axis=0)
        do, ds = right[:, :WINDOW], left[:, WINDOW:]
        do[...] = dz[:, WIDTH:].reshape(b, WINDOW, WIDTH)
        np.matmul(do, x.transpose(0, 2, 1), out=ds)
        # The mean of da by attention is the product of do and the output.
        ds -= ((dz[:, WIDTH:] * o) @ np.ones(WIDTH, dtype)).reshape(b, WINDOW, 1)
        ds *= a
        dq = np.matmul(ds, x).reshape(-1, WIDTH)
        dx = np.matmul(left.transpose(0, 2, 1), right).reshape(-1, WIDTH)
        dx += dz[:, :WIDTH]
        dx += dq @ match.T
        by_weight = states.T @ dq
        grad.wq[...], grad.wk[...] = by_weight @ self.wk * SCALE, by_weight.T @ self.wq * SCALE
        np.matmul(np.ones(b, dtype), dx.reshape(b, -1), out=grad.pos.reshape(-1))
        at = x_in.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
        grad.emb[...] = np.bincount(at.reshape(-1), weights=dx.reshape(-1), minlength=SLOTS * WIDTH).reshape(SLOTS, WIDTH)
        return grad.flat, loss


class Scorer:
    """Forward alone, from tables.

    What a place puts into attention depends on its slot and its place in the window only, so the
    states, queries and the part of the hidden state that skips attention are looked up,
    with products of weights folded. A last hidden unit that is always 1 carries the biases. Logits of class and member come from
    one product a class. They are shifted by their maximum only where float32 needs that.
    """

    def __init__(self, net: Network):
        put = lambda x: np.ascontiguousarray(x, np.float32)
        match, w1 = net.folded()
        own = (net.emb[None] + net.pos[:, None]).reshape(-1, WIDTH)
        self.state, self.query, self.attended = put(own), put(own @ match), put(np.hstack([w1[WIDTH:], np.zeros((WIDTH, 1))]))
        self.skip = put(np.hstack([own @ w1[:WIDTH] + net.b1, np.ones((len(own), 1))]))
        kinds = np.vstack([net.wc, net.bc])
        self.out = [put(np.hstack([kinds, np.vstack([w, b])])) for w, b in zip(net.wm, net.bm, strict=True)]
        self.offset = np.arange(WINDOW) * SLOTS
        # Of the exponentials: all classes, those that begin a word, all members.
        self.sums = np.zeros((CLASSES + MEMBERS, 3), np.float32)
        self.sums[:CLASSES, 0], self.sums[: CLASSES // 2, 1], self.sums[CLASSES:, 2] = 1, 1, 1

    def hidden(self, x_in: np.ndarray, lead: int = 0) -> np.ndarray:
        """Of all places but the first `lead` of each window, which only take part in attention."""
        x = x_in + self.offset
        state, asked = self.state.take(x, axis=0), x[:, lead:]
        a = np.matmul(self.query.take(asked, axis=0), state.transpose(0, 2, 1))
        if not within(a):
            a += MASK[lead:]
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a *= CAUSAL[lead:]
        o = np.matmul(a, state).reshape(-1, WIDTH)
        np.einsum("ij,i->ij", o, 1 / (a.reshape(-1, WINDOW) @ CAUSAL[-1]), out=o)
        h = o @ self.attended
        h += self.skip.take(asked.reshape(-1), axis=0)
        return np.maximum(h, 0, out=h)

    def log_probs(self, h: np.ndarray, target: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of the target slots, of the given rows of h (or all); and, where the target begins a word or ends the text, that one does."""
        kind, member = np.divmod(target, MEMBERS)
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        h, member = h.take(order if rows is None else rows.take(order), axis=0), member.take(order)
        ends = np.append(0, np.cumsum(np.bincount(kind, minlength=CLASSES))).tolist()
        log, sums = np.empty(len(h), np.float32), np.empty((len(h), 3), np.float32)
        for k, (at, to) in enumerate(pairwise(ends)):
            if at == to:
                continue
            m = h[at:to] @ self.out[k]
            if not within(m):
                for part in (m[:, :CLASSES], m[:, CLASSES:]):
                    part -= part.max(axis=1, keepdims=True)
            np.add(m[:, k], m.ravel().take(np.arange(CLASSES, m.size, CLASSES + MEMBERS) + member[at:to]), out=log[at:to])
            np.exp(m, out=m)
            np.matmul(m, self.sums, out=sums[at:to])
        n = ends[CLASSES // 2]
        sums[:n, 1] = np.maximum(sums[:n, 1], 1e-30)
        sums[n:, 1] = 1  # not asked for
        np.log(sums, out=sums)
        out, starts = np.empty(len(h), np.float32), np.zeros(len(h), np.float32)
        starts[order[:n]] = sums[:n, 1] - sums[:n, 0]
        out[order] = log - sums[:, 0] - sums[:, 2]
        return out, starts


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid one after the other: each window's first place, its number of places, and how many of them at its end it scores."""
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    start, owner = ragged(lengths)[0], np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(int(count.sum())) - (np.cumsum(count) - count)[owner]
    first = np.where(nth == 0, 0, nth * STRIDE)
    size = np.minimum(WINDOW, lengths[owner] - first)
    scored = np.where(nth == 0, size, size - (WINDOW - STRIDE))
    return start[owner] + first, size, scored


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(strings(texts)))
    flat, number = parts.flatten(), np.asarray(pc.list_value_length(parts)).astype(np.int64)
    some = np.asarray(pc.binary_length(flat)) > 0  # white space at an end leaves empty words
    if not some.all():
        number = np.bincount(np.repeat(np.arange(len(number)), number)[some], minlength=len(number))
        flat = flat.filter(pa.array(some))
    return flat, number


class Reader:
    """Texts to words, and words to slots."""

    def __init__(self, path: str, slots: Slots | None):
        self.model, self.slots = subwords(path), slots

    def ids_of(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of the words, one after the other, and how many each has."""
        # A word that the vocabulary reads as nothing still has one id. One thread: a task has one core.
        ids = [i or [0] for i in self.model.encode(distinct, num_threads=1)]
        number = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(number.sum())), number

    def slots_of(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of all words, the log share of ids in shared slots summed by word, and how many slots each word has."""
        ids, number = self.ids_of(distinct)
        slots = self.slots.slot[ids]
        begins = ragged(number)[0]
        inner = np.ones(len(slots), bool)
        inner[begins] = False
        # An id on the wrong side of a word's beginning takes the shared slot of its side.
        slots = np.where(inner & (slots < RARE_NEXT), RARE_NEXT, np.where(~inner & (slots >= RARE_NEXT), RARE_FIRST, slots)).astype(np.int16)
        share = np.add.reduceat(self.slots.log_share[ids], begins) if len(ids) else np.zeros(0)
        return slots, share, number


def numbered(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words, all words of all texts as numbers of these, and how many each text has."""
    flat, n_words = words_in(texts)
    coded = flat.dictionary_encode()
    # By way of NumPy, which takes a tenth of the time of to_pylist.
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices).astype(np.int64), n_words


def sequences(slots: np.ndarray, each: np.ndarray, number: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of each text with its end, how many these are, and where each word begins."""
    # The end goes after each text's last word, as one more word.
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.append(each, 1))), pa.int32()), pa.array(np.append(slots, np.int16(END))))
    stop = np.cumsum(n_words)
    number = np.insert(number, stop, len(each))
    sequence = np.asarray(lists.take(pa.array(number)).flatten())
    long = np.append(each, 1)[number]
    begin = np.cumsum(long) - long
    ends = stop + np.arange(len(stop))
    lengths = np.diff((begin + long)[ends], prepend=0)
    return sequence, lengths, np.delete(begin, ends)


def network_logs(scorer: Scorer, sequence: np.ndarray, lengths: np.ndarray, most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each slot given those before it in its text; where it begins a word or is the end, also that one begins."""
    inputs = np.empty_like(sequence)
    inputs[1:] = sequence[:-1]
    inputs[ragged(lengths)[0]] = END
    first, size, scored = windows(lengths)
    log, begins = np.zeros(len(sequence), np.float32), np.zeros(len(sequence), np.float32)
    column = np.arange(WINDOW)
    for lead in (0, WINDOW - STRIDE):
        some = np.flatnonzero(size - scored == lead)
        for at in range(0, len(some), most):
            f, n = first[some[at : at + most], None], size[some[at : at + most], None]
            place = np.minimum(f + column, len(sequence) - 1)
            live = column < n
            rows = np.flatnonzero(live[:, lead:])
            where = place[:, lead:].reshape(-1).take(rows)
            log[where], begins[where] = scorer.log_probs(scorer.hidden(np.where(live, inputs[place], END), lead), sequence[where], rows)
    return log, begins


def earlier(number: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each word came before in its text, and how many words came before."""
    start, owner = ragged(n_words)
    before = np.arange(len(number)) - start[owner]
    key = owner * (int(number.max()) + 1 if len(number) else 1) + number
    order = np.argsort(key, kind="stable")
    same = key[order]
    run = np.append(True, same[1:] != same[:-1]) if len(same) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(run, np.arange(len(same)), 0)) if len(same) else same
    count = np.empty(len(number), np.int64)
    count[order] = np.arange(len(same)) - first
    return count, before


def counts_of(distinct: list[str], words: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Each word's count, 0 for words that are not listed."""
    at = pc.index_in(pa.array(distinct, pa.large_string()), value_set=words).fill_null(len(counts))
    return np.append(counts, 0).astype(np.float64)[np.asarray(at)]


def score_texts(reader: Reader, net: Network, texts: pa.Array, words: pa.Array, word_counts: np.ndarray, n_tokens: int, n_ends: int) -> pd.DataFrame:
    """n_tokens, n_known, sum of log10(c + 1), and the log10 probability of each text by the model and by the network alone."""
    # Equal texts are scored once: a product's rounding may depend on the row, and equal texts have equal scores.
    once = strings(texts).dictionary_encode()
    distinct, number, n_words = numbered(once.dictionary)
    counts, of_words, scorer = counts_of(distinct, words, word_counts), reader.slots_of(distinct), net.scorer()
    stop, parts, at = np.cumsum(n_words), [], 0
    while at < len(n_words) or not parts:
        before = stop[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(stop, before + PART_WORDS, side="right")))
        some = number[before : stop[to - 1] if len(n_words) else 0]
        parts.append(score_part(scorer, some, n_words[at:to], counts, *of_words, n_tokens, n_ends))
        at = to
    return pd.concat(parts, ignore_index=True).take(np.asarray(once.indices)).reset_index(drop=True)


def score_part(scorer: Scorer, number: np.ndarray, n_words: np.ndarray, word_counts: np.ndarray, slots: np.ndarray, share: np.ndarray, each: np.ndarray, n_tokens: int, n_ends: int) -> pd.DataFrame:
    """Of texts whose words are numbers of distinct words; of these the counts, slots, log shares and numbers of slots are given."""
    sequence, lengths, word_at = sequences(slots, each, number, n_words)
    log, begins = network_logs(scorer, sequence, lengths)
    sums = np.concatenate([[0.0], np.cumsum(log, dtype=np.float64)])
    end_at = np.cumsum(lengths) - 1
    stop = word_at + each[number]
    own = sums[stop] - sums[word_at] - begins[word_at] + begins[stop] + share[number]
    counts = word_counts[number]
    copied, before = earlier(number, n_words)
    some = before > 0
    owner = np.repeat(np.arange(len(n_words)), n_words)
    total = lambda x: np.bincount(owner, weights=x, minlength=len(n_words))
    share_counted = counts / max(n_tokens, 1)
    by_network = np.exp(np.minimum(own, 0.0))
    copied = copied / np.maximum(before, 1)
    end_counted, end_network = n_ends / max(n_tokens, 1), np.exp(np.minimum(log[end_at] - begins[end_at], 0.0).astype(np.float64))
    by_mixture = np.empty((len(MIXTURES), len(n_words)))
    # A first word can't be a copy, so its share is the count's; an end is none either.
    copied = np.where(some, copied, share_counted)
    tiny = np.flatnonzero(share_counted + by_network + copied < 1e-280)  # a very long word's probability underflows
    for i, (u, n, c) in enumerate(MIXTURES):
        words = u * share_counted
        words += n * by_network
        words += c * copied
        words[tiny] = 1.0
        np.log(words, out=words)
        words[tiny] = math.log(n) + own[tiny]
        by_mixture[i] = total(words) + np.log(np.where(n_words > 0, u, u + c) * end_counted + n * end_network + 1e-300)
    score = np.logaddexp.reduce(by_mixture, axis=0) - math.log(len(MIXTURES))
    return pd.DataFrame(
        {
            "n_tokens": n_words + 1,
            "n_known": (total(counts > 0) + (n_ends > 0)).astype(np.int64),
            "log_counts": total(np.log10(counts + 1)) + math.log10(n_ends + 1),
            "score": score / math.log(10),
            "network_score": (total(np.minimum(own, 0.0)) + np.minimum(log[end_at] - begins[end_at], 0.0)) / math.log(10),
        }
    )


def subword_counts(counts: DataFrame, n_ends: int, path: str) -> dict[int, int]:
    """Of all training texts, from their word counts; at most as many rows as the vocabulary has ids come to the driver. The ends are under -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(subwords(path).get_piece_size(), np.int64)
        for batch in by_bytes(batches, "word"):
            ids, number = Reader(path, None).ids_of(batch.column("word").to_numpy(zero_copy_only=False).tolist())
            np.add.at(found, ids, np.repeat(np.asarray(batch.column("c")), number))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some])], names=["id", "n"])

    return {r["id"]: r["n"] for r in counts.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()} | {-1: n_ends}


def averaged(parts: DataFrame) -> np.ndarray | None:
    """Mean of the weights, by their numbers of ids, in two levels of groups."""

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pid")  # float sums in one order
        total = group["n"].sum()
        w = sum(np.frombuffer(x, np.float32).astype(np.float64) * n for x, n in zip(group["w"], group["n"], strict=True)) / total
        return pd.DataFrame({"pid": [int(group["pid"].iloc[0]) // 64], "n": [total], "w": [w.astype(np.float32).tobytes()]})

    schema = "pid long, n long, w binary"
    for _ in range(2):
        parts = parts.groupBy(F.expr("pid div 64").alias("g")).applyInPandas(mean, schema)
    total, w = 0, 0.0
    for r in sorted(parts.collect(), key=lambda r: r["pid"]):  # one in 4096 slices' worth
        total, w = total + r["n"], w + np.frombuffer(r["w"], np.float32).astype(np.float64) * r["n"]
    return (w / total).astype(np.float32) if total else None


def fit_slice(net: Network, reader: Reader, texts: pa.Array, seed: int, later: bool) -> int:
    """Adam on all windows of the texts, which change net; gives their number of ids."""
    m, v, by, step, rng = np.zeros_like(net.flat), np.zeros_like(net.flat), np.empty_like(net.flat), 0, np.random.default_rng(seed)
    if not len(texts):
        return 0
    distinct, number, n_words = numbered(texts)
    slots, _, each = reader.slots_of(distinct)
    sequence, lengths, _ = sequences(slots, each, number, n_words)
    inputs = np.empty_like(sequence)
    inputs[1:] = sequence[:-1]
    inputs[ragged(lengths)[0]] = END
    first, size, scored = windows(lengths)
    column, epochs = np.arange(WINDOW), min(MOST_EPOCHS, max(1, -(-LEAST_STEPS * BATCH // max(1, len(first)))))
    lead, grad = size - scored, Network(np.empty_like(net.flat))

    def batches() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Inputs, targets and weights, gathered for some batches at once."""
        for order in (rng.permutation(len(first)) for _ in range(epochs)):
            for many in range(0, len(order), 32 * BATCH):
                w = order[many : many + 32 * BATCH, None]
                place = np.minimum(first[w] + column, len(sequence) - 1)
                live = column < size[w]
                x, y, own = np.where(live, inputs[place], END).astype(np.int64), np.where(live, sequence[place], END).astype(np.int64), live & (column >= lead[w])
                for at in range(0, len(w), BATCH):
                    yield x[at : at + BATCH], y[at : at + BATCH], own[at : at + BATCH]

    for batch in batches():
        g, _ = net.gradient(*batch, grad)
        step += 1
        rate = 0.01 / (1 + step / 500) * (0.5 if later else 1)
        # In place: m and v are 10 and 100 times the means of g and g g, and the step is rate by the one over the root of the other, without their bias to 0.
        m *= 0.9
        m += g
        v *= 0.99
        g *= g
        v += g
        unbiased = math.sqrt(1 - 0.99**step)
        np.sqrt(v, out=by)
        by += 1e-6 * unbiased
        np.divide(m, by, out=by)
        by *= rate * unbiased / (1 - 0.9**step)
        net.flat -= by
    return len(sequence)


def train(training: DataFrame, counts: DataFrame, path: str, n_texts: int, n_slices: int) -> tuple[Slots, np.ndarray]:
    """Slots and network weights, from all training texts (slice, id, text) and their word counts."""
    slots = make_slots(path, subword_counts(counts, n_texts, path))
    flat = Network.start(slots.log_counts).flat
    turns = min(ROUNDS, n_slices)

    def fitted(r: int, flat: np.ndarray):
        shared = training.sparkSession.sparkContext.broadcast((slots, flat))

        def fit(table: pa.Table) -> pa.Table:
            slots, flat = shared.value
            net, number = Network(flat.copy()), table["slice"][0].as_py()
            seen = fit_slice(net, Reader(path, slots), in_order(table)["text"].combine_chunks(), 1000 * number + r, r > 0)
            return pa.table({"pid": pa.array([number], pa.int64()), "n": pa.array([seen], pa.int64()), "w": pa.array([net.flat.tobytes()], pa.binary())})

        return fit

    for r in range(ROUNDS):
        part = training.where(F.col("slice") % turns == r % turns)
        new = averaged(part.groupBy("slice").applyInArrow(fitted(r, flat), "pid long, n long, w binary"))
        flat = flat if new is None else new
        free_shuffles(training.sparkSession)  # the round's texts; they would stay until the query ends
    return slots, flat


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a slice in an order that doesn't depend on how they came."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")])


def listed(sliced: DataFrame) -> DataFrame:
    """(slice, word, n): the distinct words of each slice, and how often its training texts have them."""

    def count(table: pa.Table) -> pa.Table:
        words, held = [], []
        for batch in by_bytes(iter(table.to_batches()), most=2 << 20):
            flat, number = words_in(batch.column("text"))
            words.append(flat)
            held.append(np.repeat(np.asarray(batch.column("held")), number))
        coded = pa.concat_arrays(words).dictionary_encode()
        place = np.asarray(coded.indices)
        n = np.bincount(place[~np.concatenate(held)], minlength=len(coded.dictionary))
        return pa.table({"slice": pa.array(np.full(len(n), table["slice"][0].as_py(), np.int64)), "word": coded.dictionary.cast(pa.string()), "n": pa.array(n.astype(np.int64))})

    return sliced.groupBy("slice").applyInArrow(count, "slice long, word string, n long")


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, network_score of every row."""
    docs = keyed_text(docs, id_col, text_col)
    held = F.coalesce(fold("id", FOLDS) == HELD_OUT, F.lit(False))
    size, n_ends = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 64), F.lit(0)), F.coalesce(F.sum((~held).cast("long")), F.lit(0))).first()
    n_slices = max(1, -(-size // slice_bytes))
    sliced = docs.select(F.pmod(F.xxhash64("id", "text"), F.lit(n_slices)).alias("slice"), "id", "text", held.alias("held"))
    words = shared_table(listed(sliced))
    counts = shared_table(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    n_distinct, n_words = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n_tokens, n_distinct = n_words + n_ends, n_distinct + (n_ends > 0)
    free_shuffles(docs.sparkSession)  # the texts that were listed
    slots, flat = train(sliced.where(~F.col("held")).select("slice", "id", "text"), counts, path, n_ends, n_slices)
    common = counts.orderBy(F.desc("c"), "word").limit(FREQUENT)
    frequent = common.toArrow().combine_chunks()
    free_shuffles(docs.sparkSession)  # Spark keeps the last query's until another one has run
    shared = docs.sparkSession.sparkContext.broadcast((slots, flat, frequent))
    # Bounded by FREQUENT rows.
    rest = counts.join(F.broadcast(common.select("word")), "word", "left_anti")
    known = words.select("slice", "word").join(rest, "word")

    def scored(key, texts: pa.Table, words: pa.Table) -> pa.Table:
        slots, flat, frequent = shared.value
        reader, net = Reader(path, slots), Network(flat)
        value_set = pa.chunked_array([*frequent["word"].chunks, *words["word"].chunks], pa.string()).cast(pa.large_string()).combine_chunks()
        counts = np.concatenate([np.asarray(frequent["c"]), np.asarray(words["c"])])
        texts = in_order(texts)
        found = score_texts(reader, net, texts["text"].combine_chunks(), value_set, counts, n_tokens, n_ends)
        return pa.table({"doc_id": texts["id"], **{c: pa.array(found[c].to_numpy()) for c in found}})

    rows = sliced.select("slice", "id", "text").groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(scored, "doc_id long, n_tokens long, n_known long, log_counts double, score double, network_score double")
    base = F.col("log_counts") - F.col("n_tokens") * math.log10(n_tokens + n_distinct + 1)
    return rows.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "network_score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.sentencepiece_lattice import default_model

    return score(read(spark, sf_dir, "documents"), default_model())
