"""The training-data operators: edge tables, brute force, round trips, held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from ledgerlens.llm import attention_lm, decontamination, media, near_dedup, quality, registry, sentencepiece_lattice, sharding, simhash, token_counts, toxicity, url_rules
from ledgerlens.llm.linear import Rows

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, item string, pieces string, slice int"


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    folder = tmp_path_factory.mktemp("edge")
    long = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "délta", "naïve"], k=30_000))
    rows = [(1, "One two three four five six seven eight nine ten eleven."), (2, None), (3, ""), (None, "no id here"), (5, long), (6, "x"), (6, "x"), (7, "  \n\t "), (8, "One two three four five six seven eight nine ten eleven."), (None, None), (9, "▁ odd <|endoftext|> \x01 🙂")]
    spark.createDataFrame([(i, t, None if i == 2 else "en", None, None, 0, "z", "p", 1) for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0, 5), (2, None, None, 5), (None, 0, 1, 5), (5, 0, 1, 5), (5, 1, 0, 5)], "doc_id long, quality int, toxic int, id int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "one TWO three four five six seven eight nine ten"), (1, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, "http://A.Example.com/en/7?x=1"), (2, None), (None, "nonsense"), (4, "ftp://de"), (4, "ftp://de"), (5, "http://example.net/de/81#a/b")], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory, edge):
    folder = tmp_path_factory.mktemp("empty")
    for table in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{edge}/{table}.parquet").limit(0).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


LLM = {k: f for k, f in entry.queries().items() if k == "pipeline" or k in registry.queries()}


@pytest.mark.parametrize("name", sorted(LLM))
def test_edge_and_empty_tables(spark, edge, empty, name):
    rows = LLM[name](spark, edge).collect()
    if name == "pipeline":
        assert 1 <= len(rows) < 11
    else:
        assert len(rows) == (6 if name.startswith("op9") else 11)
    assert LLM[name](spark, empty).count() == 0
    if name in VALUES:
        texts = {(r.doc_id, r.text) for r in spark.read.parquet(f"{edge}/documents.parquet").collect()}
        VALUES[name](rows, texts)


def by_id(rows):
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return found


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()


def check_scores(rows, texts):
    of = by_id(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) or r.predicted == (r.score >= 0.5) for r in rows)
    assert of[6][0].score == of[6][1].score and of[1][0].score == of[8][0].score


def check_lm(rows, texts):
    of = by_id(rows)
    assert [r.n_tokens for r in of[2]] == [1] and of[3][0].n_tokens == 1 and of[7][0].n_tokens == 1 and of[5][0].n_tokens == 30_001
    assert of[6][0].score == of[6][1].score and of[2][0].score == of[3][0].score and all(np.isfinite(r.score) for r in rows)


def check_simhash(rows, texts):
    import xxhash

    def fingerprint(text, k=3):
        w = words_of(text)
        parts = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
        return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}" if h else "0" * 16

    assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == sorted([*((str(i), fingerprint(t)) for i, t in texts), ("6", fingerprint("x"))])
    of = by_id(rows)
    assert of[8][0].component_id == 1 and of[2][0].component_id == of[3][0].component_id == of[7][0].component_id == 2


def check_sharding(rows, texts):
    import zlib

    want = sorted([*((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts), ("6", 2, zlib.crc32(b"x"))])
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want


def check_media(rows, texts):
    import zlib

    of = by_id(rows)
    for i, t in texts:
        if i is None:
            continue
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        for r in of[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert of[1][0][1:] == of[8][0][1:] and of[2][0][1:] == of[3][0][1:] and all(r.media_bytes > r.payload_bytes for r in rows)


def check_leaks(rows, texts):
    of = by_id(rows)
    none, x = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
    assert tuple(of[1][0])[1:] == (11, 10, 1, hashlib.sha256(b"0").hexdigest(), True) == tuple(of[8][0])[1:]
    assert tuple(of[6][0])[1:] == (1, 1, 1, x, True) and tuple(of[2][0])[1:] == (0, 0, 0, none, False) == tuple(of[7][0])[1:]


def check_tokens(rows, texts):
    import public_tokenizers
    import tokenizers

    model = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in [*texts, (6, "x")])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want and all(r.over_limit == (r.n_tokens > 1024) for r in rows)


def check_urls(rows, texts):
    of = by_id(rows)
    assert tuple(of[1][0])[1:] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and tuple(of[5][0])[1:] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert tuple(of[2][0])[1:] == ("", "", None, "allow") == tuple(of[None][0])[1:] and [tuple(r)[1:] for r in of[4]] == [("de", "", None, "allow")] * 2


def check_pipeline(rows, texts):
    assert {r.doc_id for r in rows} <= {i for i, _ in texts} and len([r for r in rows if r.doc_id == 6]) <= 1
    assert all(not set(words_of(r.text)) or b" ".join(words_of(r.text)).find(b"one two three four five six seven eight nine ten") < 0 for r in rows)


VALUES = {
    "op2_quality": check_scores, "op3_lm_score": check_lm, "op4_simhash": check_simhash, "op5_toxicity": check_scores, "op6_sharding": check_sharding, "op7_media_columns": check_media,
    "op8_decontamination": check_leaks, "op9_url_rules": check_urls, "op10_token_counts": check_tokens, "pipeline": check_pipeline,
}


def test_views_need_no_metadata(spark):
    """Documents without lang and source columns: fitted, scored and filtered all the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert 0 < quality.keep_good(docs, labels).count() <= docs.count()


def test_one_round_of_co_training():
    """Each view's sure pseudo-labels go to the other view's set, once each, and the refitted models use them."""
    rng = np.random.default_rng(2)
    y = np.array([0, 1] * 20)
    pack = lambda x: Rows(np.concatenate(x), np.array([len(r) for r in x]))
    views = [pack([np.array([c, 2 + rng.integers(3)], np.int64) for c in y]) for _ in range(2)]
    given = np.array([0, 5], "<i4").tobytes()
    calls = []

    def hand_over(models, share, turn):
        calls.append([w.copy() for w, _ in models])
        return [(0, 1, given), (0, 1, given)]

    views[1] = Rows(np.append(views[1].ids, 5), np.append(views[1].lengths[:-1], views[1].lengths[-1] + 1))
    models = quality.co_train(views, y, np.arange(40), hand_over, 1)
    alone = quality.fit_logistic(views[0], y.astype(float), 5)
    assert len(calls) == 1 and np.allclose(models[0][0], alone[0]) and np.allclose(calls[0][0], alone[0])
    more = Rows(np.append(views[1].ids, [0, 5]), np.append(views[1].lengths, 2))
    assert np.allclose(models[1][0], quality.fit_logistic(more, np.append(y, 1.0), 6)[0])


def test_nnpu_errors_are_the_risk_gradient():
    """By differences of the risk, on both sides of the non-negative bound."""
    rng = np.random.default_rng(4)
    zp, zu, prior = rng.normal(size=6), rng.normal(size=9), 0.3
    share = np.full(9, 1 / 9)

    def risk(zp, zu):
        loss = lambda z: np.logaddexp(0, z)
        return prior * loss(-zp).mean() + share @ loss(zu) - prior * loss(zp).mean()

    ep, eu = toxicity.nnpu_errors(zp, zu, share, prior, 6)
    step = lambda z, i, e: np.where(np.arange(len(z)) == i, z + e, z)
    for i in range(6):
        assert abs((risk(step(zp, i, 1e-5), zu) - risk(step(zp, i, -1e-5), zu)) / 2e-5 - ep[i]) < 1e-6
    for i in range(9):
        assert abs((risk(zp, step(zu, i, 1e-5)) - risk(zp, step(zu, i, -1e-5))) / 2e-5 - eu[i]) < 1e-6
    ep, eu = toxicity.nnpu_errors(zp + 9, zu - 9, share, prior, 6)  # the negative part is below zero: up its gradient
    assert (ep > 0).all() and (eu < 0).all()


def test_rules_against_a_plain_miner(spark):
    """Every combination of up to four tokens, counted one by one."""
    import itertools

    rng = random.Random(8)
    rows = []
    for i in range(1200):
        host, section = rng.choice(["aa", "bb", "cc"]), rng.choice(["ads", "news", "blog"])
        rows.append((i, f"http://{host}.com/{section}/x{rng.randrange(4)}", int(rng.random() < (0.8 if (host, section) == ("aa", "ads") else 0.6 if section == "blog" and host == "bb" else 0.1))))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - bad, 0) for i, _, bad in rows], "doc_id long, quality int, toxic int")
    tokens = {r.page_id: r.t for r in pages.select("page_id", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    times, bad_times = {}, {}
    for i, _, bad in rows:
        for k in range(1, url_rules.MOST_TOKENS + 1):
            for c in itertools.combinations(sorted(tokens[i]), k):
                times[c] = times.get(c, 0) + 1
                bad_times[c] = bad_times.get(c, 0) + bad
    n, least = len(rows), max(url_rules.LEAST_CONFIDENCE, url_rules.LEAST_LIFT * sum(r[2] for r in rows) / len(rows))
    z2 = url_rules.SURENESS**2
    low = lambda p, m: (p + z2 / (2 * m) - z2**0.5 * ((p * (1 - p) + z2 / (4 * m)) / m) ** 0.5) / (1 + z2 / m)
    sure = {c: bad_times[c] / m for c, m in times.items() if bad_times[c] >= max(url_rules.LEAST_SUPPORT * n, url_rules.LEAST_PAGES) and low(bad_times[c] / m, m) >= least}
    want = [c for c, p in sure.items() if not any(set(o) < set(c) and q >= p for o, q in sure.items())]
    got = [tuple(r[0]) for r in url_rules.mine(pages, labels)]
    assert want and sorted(got) == sorted(want)


def test_decontamination_sql(spark, duck):
    got = {r.doc_id: tuple(r) for r in decontamination.op8_decontamination(spark, SF).collect()}
    assert got == {r[0]: r for r in duck.sql(decontamination.OP8_SQL).fetchall()}
    assert any(r[-1] for r in got.values())


def test_leaks_removed_in_blocks(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, decontamination.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2000)
    assert sorted(map(str, decontamination.find_leaks(docs, items).collect())) == whole
    clean = decontamination.remove_leaks(docs, items)
    assert decontamination.find_leaks(clean, items).where("size(spans) > 0").count() == 0
    changed = {r.doc_id for r in docs.exceptAll(clean).collect()}
    assert changed == {r.doc_id for r in decontamination.find_leaks(docs, items).where("size(spans) > 0").collect()}


def test_blocks_cut_as_one(spark, monkeypatch):
    """Windows of items of different blocks that overlap, and a phrase that a later block's cut makes, go as with one block."""
    words = [f"w{i}" for i in range(20)]
    split, inner = [f"p{i}" for i in range(10)], [f"q{i}" for i in range(10)]
    items = spark.createDataFrame([(0, " ".join(words[:12])), (1, " ".join(words[6:])), (2, " ".join(split)), (3, " ".join(inner))], "item_id long, text string").coalesce(1)
    texts = ["a b " + " ".join(words) + " c", " ".join(["a", *split[:5], *inner, *split[5:], "b"]), "clean", None]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    results = []
    for most in (decontamination.BLOCK_BYTES, 1):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", most)
        results.append(sorted((r.doc_id, r.text, r.n_chars) for r in decontamination.remove_leaks(docs, items).collect()))
    assert results[0] == results[1] == [(0, "a b c", 5), (1, "a b", 3), (2, "clean", 5), (3, None, 0)]


def test_phrases_brute_force(monkeypatch):
    """Distinct windows and their items, also where every window has one hash."""
    rng = random.Random(8)
    items = [(f"i{rng.randrange(12)}", " ".join(rng.choices("abc", k=rng.choice([0, 1, 3, 9, 10, 11, 25]))).encode()) for _ in range(40)]
    items += [("twice", items[-1][1]), ("other", b"A b; c")]
    want: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = re.findall(rb"[a-z0-9]+", text.lower())
        for i in range(max(1, len(words) - 9) if words else 0):
            want.setdefault(tuple(words[i : i + 10]), set()).add(item)
    for odd in (decontamination.HASH, np.uint64(0)):
        monkeypatch.setattr(decontamination, "HASH", odd)
        phrases = decontamination.Phrases(items)
        word = {n: w for w, n in phrases.ids.items()}
        got: dict[tuple[bytes, ...], set[str]] = {}
        for i, (at, n) in enumerate(zip(phrases.starts.tolist(), phrases.lengths.tolist(), strict=True)):
            got.setdefault(tuple(word[x] for x in phrases.symbols[at : at + n].tolist()), set()).update(phrases.owners(i))
        assert got == want
        assert odd == 0 or len(phrases.lengths) == len(want)
        assert phrases.shortest == 1
    assert len(decontamination.Phrases([]).lengths) == len(decontamination.Phrases([("a", b"; .")]).lengths) == 0


def test_fm_index_brute_force():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(2, 5, 400), 0)
    index = decontamination.FMIndex(text, 5)
    words = rng.integers(2, 5, (30, 6))
    lengths = rng.integers(1, 7, 30)
    live, low, high = index.search(words.ravel(), np.arange(0, 180, 6), lengths)
    found = {int(p): sorted(index.locate(np.arange(a, b)).tolist()) for p, a, b in zip(live, low, high)}
    for p in range(30):
        w = words[p, : lengths[p]]
        assert found.get(p, []) == [i for i in range(400 - len(w) + 1) if (text[i : i + len(w)] == w).all()]


def test_token_counts_match_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_tokenizer())
    rng = random.Random(5)
    odd = ["", " ", "a" * 3000, "<|endoftext|> x<|endoftext|>", "  a\n\n b\x1c\x85　", "I'll 'tis DON'T"] + ["".join(rng.choices("ab 'lé\n\t1½日🙂.|", k=rng.randint(1, 60))) for _ in range(400)]
    assert token_counts.Counter(token_counts.default_tokenizer()).count(odd) == [len(e.ids) for e in library.encode_batch(odd, add_special_tokens=False)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in token_counts.op10_token_counts(spark, SF).collect()}
    assert all(got[d.doc_id] == len(library.encode(d.text or "", add_special_tokens=False).ids) for d in docs)


def test_sharding_law(spark):
    rows = sharding.op6_sharding(spark, LARGER).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 2 * rows["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in rows.groupby("shard")["slot"])
    assert rows.sort_values("doc_id")["shard"].is_monotonic_increasing


@pytest.mark.parametrize("n", [64, 128, 4096, 4096 + 64, 64 * 1000])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(n)
    file = media.mux(payload)
    found = media.probe(file)
    assert found["error"] is None and media.stored_bytes(file, found) == payload and found["n_samples"] == n // 64
    for broken in (file[:-7], b"", b"not media at all", file[:40]):
        assert media.probe(broken)["error"]


def test_media_digest(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in media.op7_media_columns(spark, SF).collect():
        assert r.payload_sha256 == hashlib.sha256(media.padded(docs[r.doc_id].encode())).hexdigest()


def test_simhash_brute_force(spark):
    rows = simhash.op4_simhash(spark, LARGER).toPandas()
    fps = np.array([int(x, 16) for x in rows.fingerprint], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    parent = rows.doc_id.to_numpy().copy()
    while True:
        new = np.where(near, parent[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == parent).all():
            break
        parent = new
    assert (rows.component_id.to_numpy() == parent).all()


def test_simhash_bucket_ways_agree():
    rng = np.random.default_rng(2)
    mask = simhash.MASKS[3]
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.choice([b for b in range(64) if not mask >> b & 1], (300, 6)).astype(np.uint64), axis=1)
    fps = np.unique(np.uint64(0xDEADBEEF12345678) ^ flips)
    assert (simhash.link_tiles(fps, tile=64) == simhash.link_masks(fps, mask)).all()


def test_near_copies_brute_force(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    kept = {r.doc_id for r in near_dedup.drop_near_copies(docs).select("doc_id").collect()}
    sets = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5)) for r in docs.collect()}
    of: dict = {}
    for i, s in sets.items():
        for h in s:
            of.setdefault(h, []).append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(x, y) for v in of.values() for k, x in enumerate(v) for y in v[k + 1 :]}:
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert kept == {find(i) for i in sets}


def test_large_band_goes_round(spark, monkeypatch):
    """A group of near copies larger than a band's limit is one group all the same."""
    monkeypatch.setattr(near_dedup, "ALL_PAIRS", 3)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w if j != rng.randrange(300) else "z" for j, w in enumerate(base)), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, " ".join(f"{i}_{j}" for j in range(50)), "en", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in near_dedup.drop_near_copies(docs).collect()) == [0, 100, 101, 102, 103, 104]


def exact_groups(texts):
    """The least place of each group of texts at a similarity of 0.8, by brute force."""
    sets = [set(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    parent = list(range(len(sets)))
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if parent[i] != parent[j] and len(x & y) / len(x | y) >= 0.8:
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    return set(parent)


def texts_table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_hub_with_many_copies(spark, monkeypatch):
    """Copies that are similar to one text but not to each other all go with it, however large its bands are."""
    monkeypatch.setattr(near_dedup, "TILE", 30, raising=False)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for n in range(150):
        changed = set(rng.sample(range(300), 6))
        texts.append(" ".join(f"x{n}_{i}" if i in changed else w for i, w in enumerate(base)))
    groups = exact_groups(texts)
    assert 0 in groups and len(groups) < 20
    assert {r.doc_id for r in near_dedup.drop_near_copies(texts_table(spark, texts)).collect()} == groups


def test_copies_within_a_template(spark):
    """Many texts share a long passage without being near copies; the true pairs among them are found all the same."""
    shared = [f"t{i}" for i in range(300)]
    texts = [" ".join(shared + [f"{n}_{i}" for i in range(40)]) for n in range(200)]
    texts += [" ".join(shared + [f"{n}_{i}" for i in range(10)] + [f"new{n}_{i}" for i in range(28)]) for n in range(20)]
    groups = exact_groups(texts)
    assert groups == set(range(200))
    assert {r.doc_id for r in near_dedup.drop_near_copies(texts_table(spark, texts)).collect()} == groups


def test_short_copies_beyond_the_bits(spark):
    """Texts of 8 and 9 words are at 0.8 exactly; those that share a band are found even if their SimHashes differ widely."""
    texts = []
    for n in range(3000):
        one = " ".join(f"{n}_{i}" for i in range(8))
        (a, x), (b, y) = (near_dedup.sketch(t.encode()) for t in (one, one + " more"))
        if (a == b).any() and (int.from_bytes(x[:16]) ^ int.from_bytes(y[:16])).bit_count() > near_dedup.MOST_BITS:
            texts += [one, one + " more"]
    assert len(texts) >= 20
    assert {r.doc_id for r in near_dedup.drop_near_copies(texts_table(spark, texts)).collect()} == set(range(0, len(texts), 2))


def test_band_where_only_far_members_match(spark):
    """A template band of 600 texts in which only members that are far apart in every order are copies."""
    shared = [f"t{i}" for i in range(120)]
    texts = [" ".join(shared + [f"{n}_{i}" for i in range(60)]) for n in range(600)]
    for n in range(0, 40, 2):
        words = texts[n].split()
        texts[599 - n] = " ".join([*words[:-4], *(f"end{n}_{i}" for i in range(4))])
    groups = exact_groups(texts[:40] + texts[-40:])
    kept = {r.doc_id for r in near_dedup.drop_near_copies(texts_table(spark, texts)).collect()}
    assert len(groups) == 60 and kept == set(range(600)) - {599 - n for n in range(0, 40, 2)}


def test_near_copies_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y"), (2, "a b c d e f", "x", "z"), (3, "", "u", "v"), (None, None, "w", "t"), (3, "", "u", "v")], "doc_id long, text string, item string, known string")
    docs = docs.withColumnsRenamed({"item": "__digest"}).withColumn("row", docs.doc_id + 1)
    got = sorted(map(tuple, near_dedup.drop_near_copies(docs).collect()), key=str)
    assert got == [(1, "a b c d e f", "x", "y", 2), (None, None, "w", "t", None)]


def test_pieces_lossless_and_reproducible(spark):
    path = sentencepiece_lattice.default_model()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = sentencepiece_lattice.with_pieces(docs, path)
    assert sentencepiece_lattice.decoded(one, path).where("NOT decoded <=> text").count() == 0
    other = sentencepiece_lattice.with_pieces(docs.repartition(5), path)
    assert one.select("doc_id", "pieces").exceptAll(other.select("doc_id", "pieces")).count() == 0


def test_pieces_take_little_memory():
    """New segments are filtered part by part: what that takes beyond the lattice that is kept doesn't grow with them, nor do the draws change."""
    import tracemalloc

    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(100_000))
    lattice = sentencepiece_lattice.Lattice(sentencepiece_lattice.vocabulary(sentencepiece_lattice.default_model(), 1.0))
    words = [" " + w for w in dict.fromkeys(text.split())]
    tracemalloc.start()
    lattice.numbers(words)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most - kept < 40_000_000
    whole = sentencepiece_lattice.Lattice(lattice.pieces)
    whole.add(words)
    whole.index = {w: whole.index[w] for w in words}
    seeds = sentencepiece_lattice.mix(np.arange(len(words), dtype=np.uint64))
    got = [(x.piece.held[edges].tolist(), each.tolist()) for x in (lattice, whole) for edges, each in [x.sample(x.numbers(words), seeds)]]
    assert got[0] == got[1]


def test_piece_distribution():
    """Samples of one word against all its segmentations."""
    pieces = sentencepiece_lattice.vocabulary(sentencepiece_lattice.default_model(), 1.0)
    logs = {int(i): float(x) for i, x in zip(pieces.end_id, pieces.end_log) if i >= 0}
    of = {pieces.bytes_of[i].decode(): i for i in logs}

    def ways(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in of:
                for rest, log in ways(s[n:]):
                    yield (of[s[:n]], *rest), log + logs[of[s[:n]]]

    every = dict(ways(" than"))
    total = sum(np.exp(list(every.values())))
    ids, each = sentencepiece_lattice.encode(pa.array(["than"] * 40_000), list(range(40_000)), sentencepiece_lattice.Lattice(pieces))
    ends = np.cumsum(each)
    seen: dict = {}
    for a, b in zip(ends - each, ends):
        seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
    assert set(seen) <= set(every) and all(abs(seen.get(k, 0) / 40_000 - np.exp(v) / total) < 0.01 for k, v in every.items())


def test_lm_gradient_and_scorer():
    rng = np.random.default_rng(0)
    net = attention_lm.Network(attention_lm.Network.start(np.log(np.full(attention_lm.SLOTS, 1 / attention_lm.SLOTS)).astype(np.float32)).flat.astype(np.float64))
    x, y = rng.integers(0, attention_lm.SLOTS, (2, 3, attention_lm.WINDOW))
    weight = np.ones((3, attention_lm.WINDOW))
    gradient, loss = net.gradient(x, y, weight)
    for i in rng.choice(np.flatnonzero(gradient), 10):
        old = net.flat[i]
        net.flat[i] = old + 1e-5
        up = net.gradient(x, y, weight)[1]
        net.flat[i] = old - 1e-5
        down = net.gradient(x, y, weight)[1]
        net.flat[i] = old
        assert abs((up - down) / 2e-5 - gradient[i]) < 1e-4
    scorer = attention_lm.Network(net.flat.astype(np.float32)).scorer()
    log, _ = scorer.log_probs(scorer.hidden(x), y.reshape(-1))
    assert abs(loss + log.mean()) < 1e-4
    every = np.array([scorer.log_probs(scorer.hidden(x[:1])[:1], np.array([t]))[0][0] for t in range(attention_lm.SLOTS)])
    assert abs(np.exp(every).sum() - 1) < 1e-4


def test_windows_score_each_place_once():
    lengths = np.array([1, 15, 16, 17, 28, 29, 100])
    first, size, scored = attention_lm.windows(lengths)
    seen = np.concatenate([np.arange(f + n - s, f + n) for f, n, s in zip(first, size, scored)])
    assert sorted(seen.tolist()) == list(range(int(lengths.sum())))


def test_lm_base(spark):
    import math
    import re
    import zlib
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = {d.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in d.text or "")), None] for d in docs}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in attention_lm.op3_lm_score(spark, SF).collect():
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words[r.doc_id])) < 1e-6
        assert r.train_tokens == n and r.n_known == sum(counts[w] > 0 for w in words[r.doc_id]) and r.score < 0


def test_lm_trains_on_all_texts(spark, monkeypatch):
    """Both rounds, and the subword counts, see every training text of a table of some thousands."""
    import zlib

    path = sentencepiece_lattice.default_model()
    texts = {i: f"alpha w{i} beta{i % 50}" for i in range(3000)}
    training = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % attention_lm.FOLDS != attention_lm.HELD_OUT]
    ids = [x for t in training for w in t.split() for x in attention_lm.subwords(path).encode(w)]
    seen, given = [], []
    averaged, make_slots = attention_lm.averaged, attention_lm.make_slots

    def spied(parts):
        seen.append(parts.agg(F.sum("n")).first()[0])
        return averaged(parts)

    monkeypatch.setattr(attention_lm, "averaged", spied)
    monkeypatch.setattr(attention_lm, "make_slots", lambda p, counts: given.append(counts) or make_slots(p, counts))
    monkeypatch.setattr(attention_lm, "LEAST_STEPS", 1)
    attention_lm.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path)
    assert seen == [len(ids) + len(training)] * attention_lm.ROUNDS
    assert given[0].pop(-1) == len(training) and given[0] == {x: ids.count(x) for x in set(ids)}


def test_lm_frees_its_shuffles(spark, monkeypatch):
    """What training dealt out is gone before scoring, so that disk doesn't hold the texts once for each step."""
    import time

    def held():
        return {x for x in spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keySet().mkString(",").split(",") if x}

    before, made, averaged = held(), set(), attention_lm.averaged

    def spied(parts):
        flat = averaged(parts)
        made.update(held() - before)
        return flat

    monkeypatch.setattr(attention_lm, "averaged", spied)
    monkeypatch.setattr(attention_lm, "LEAST_STEPS", 1)
    attention_lm.score(spark.createDataFrame([(i, f"alpha w{i} beta{i % 50}") for i in range(500)], "doc_id long, text string"), sentencepiece_lattice.default_model())
    for _ in range(50):
        if not made & held():
            break
        time.sleep(0.2)
    assert len(made) >= 6 and not made & held()


def test_lm_reads_a_word_once_on_one_thread(monkeypatch):
    """Fitting and scoring split each distinct word of a slice once, and only on the core that the task has."""
    path = sentencepiece_lattice.default_model()
    model, calls = attention_lm.subwords(path), []

    class Spy:
        get_piece_size, id_to_piece = model.get_piece_size, model.id_to_piece

        def encode(self, words, **options):
            calls.append((words, options))
            return model.encode(words, **options)

    monkeypatch.setattr(attention_lm, "subwords", lambda path: Spy())
    texts = pa.array([f"alpha beta w{i % 7} alpha" for i in range(50)])
    slots = attention_lm.make_slots(path, {-1: 50})
    net = attention_lm.Network.start(slots.log_counts)
    assert attention_lm.fit_slice(net, attention_lm.Reader(path, slots), texts, 1, False) > 250
    attention_lm.score_texts(attention_lm.Reader(path, slots), net, texts, pa.array(["alpha"], pa.large_string()), np.array([100]), 250, 50)
    assert len(calls) == 2 and all(sorted(w) == sorted(["alpha", "beta", *(f"w{i}" for i in range(7))]) and o == {"num_threads": 1} for w, o in calls)


def test_lm_scores_texts_in_parts(monkeypatch):
    """The same scores whether a slice's texts are scored at once or a few words at a time."""
    path = sentencepiece_lattice.default_model()
    texts = pa.array([None, "", *(" ".join(f"w{i * k % 11}" for k in range(i)) for i in range(40)), " "])
    slots = attention_lm.make_slots(path, {-1: 43})
    found = []
    for most in (300_000, 50, 1):
        monkeypatch.setattr(attention_lm, "PART_WORDS", most)
        found.append(attention_lm.score_texts(attention_lm.Reader(path, slots), attention_lm.Network.start(slots.log_counts), texts, pa.array(["w1"], pa.large_string()), np.array([9]), 99, 43))
    assert len(found[0]) == 43 and found[0]["n_tokens"].tolist() == [1, 1, *range(1, 41), 1]
    assert all(np.allclose(found[0], f, rtol=1e-6, atol=1e-6) for f in found[1:])


def test_lm_scorer_leaves_out_lead_places():
    """Hidden states of the later places alone are those of all places; so are log probabilities of some rows."""
    rng = np.random.default_rng(5)
    net = attention_lm.Network.start(np.log(np.full(attention_lm.SLOTS, 1 / attention_lm.SLOTS)).astype(np.float32))
    scorer, lead = net.scorer(), attention_lm.WINDOW - attention_lm.STRIDE
    x, y = rng.integers(0, attention_lm.SLOTS, (2, 6, attention_lm.WINDOW))
    every, later = scorer.hidden(x), scorer.hidden(x, lead)
    assert np.allclose(every.reshape(6, attention_lm.WINDOW, -1)[:, lead:].reshape(len(later), -1), later, atol=1e-5)
    rows = np.flatnonzero(rng.random(len(later)) < 0.5)
    target = y[:, lead:].reshape(-1)
    for a, b in zip(scorer.log_probs(later, target), scorer.log_probs(later, target[rows], rows), strict=True):
        assert np.allclose(a[rows], b, atol=1e-5)


def test_lm_steps_are_small():
    assert attention_lm.BATCH <= 64


def test_nnpu_finds_positives():
    rng = np.random.default_rng(1)

    def rows(n, toxic):
        return [np.unique(np.append(rng.integers(10, 200, 20), rng.integers(0, 3, 2) if t else [])).astype(np.int64) for t in (rng.random(n) < toxic)]

    pack = lambda x: Rows(np.concatenate(x), np.array([len(r) for r in x]))
    *w, b = toxicity.fit_nnpu(pack(rows(300, 1.0)), pack(rows(2000, 0.1)), np.ones(2000), 0.1, 200)
    w = np.array(w)
    assert w[:3].min() > 2 and (pack(rows(200, 1.0)).logits(w, b) > 0).mean() > 0.9 and (pack(rows(500, 0.0)).logits(w, b) > 0).mean() < 0.05


def test_classifiers_held_out(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    for name, column, least in (("op5_toxicity", "toxic", 0.9), ("op2_quality", "quality", 0.95)):
        scored = registry.queries()[name](spark, LARGER).where("held_out").join(labels, "doc_id")
        assert scored.agg(F.avg((F.col("predicted") == F.col(column)).cast("double")).alias("x")).first().x >= least


def test_url_rules(spark):
    urls = ["https://www.example.com/en/7", "http://EXAMPLE.com/en/8?q", "http://notexample.com.evil/en/", "http://a.net/de/8", "http://example.net/de/8", "http://x.org/es/#y", "http://a.com?en/", None, "plain"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), []).orderBy("page_id").collect()]
    assert got == [
        ("www.example.com", "/en/7", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("notexample.com.evil", "/en/", None, "allow"), ("a.net", "/de/8", "net/de/", "allow"),
        ("example.net", "/de/8", "example.net/de/8", "block"), ("x.org", "/es/", "org/es/", "block"), ("a.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
    ]


def test_mined_rules(spark):
    """Pages of one host and section are bad: that pair is mined, and only pages with both are blocked."""
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.com/{'ads' if i % 4 < 2 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if "bad.com/ads" in u else 1, 0) for i, u in rows], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(pages, labels)
    assert [r[0] for r in rules] == [["host=bad", "path=ads"]]
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, rules, ()).collect()}
    assert all((got[i] == "block") == ("bad.com/ads" in u) for i, u in rows)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = docs.count(), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen.append(name)
        assert set(docs.columns) <= set(out.columns) and 0 < out.count() <= before
    assert seen == ["toxicity", "quality", "near_copies", "decontamination", "pieces"] and corpus_pipeline.ORACLE_SQL is None


def test_lm_scores_do_not_depend_on_partitions(spark):
    """Several slices, so that rounds, averages and lists of words all take part."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = []
    for n in (1, 5, 32):
        df = spark.createDataFrame(docs.sample(frac=1, random_state=n), "doc_id long, text string").repartition(n)
        rows = attention_lm.score(df, sentencepiece_lattice.default_model(), slice_bytes=150_000).collect()
        got.append(np.array([r.score for r in sorted(rows, key=lambda r: r.doc_id)]))
    assert len(got[0]) == len(docs) and abs(got[1] - got[0]).max() < 1e-6 and abs(got[2] - got[0]).max() < 1e-6


def test_lm_probabilities_by_a_plain_model(spark):
    """Words, windows, classes, copies and mixtures of 20 texts, place by place, against the batched scorer."""
    import math
    from collections import Counter

    import pyarrow as pa

    path = sentencepiece_lattice.default_model()
    docs = [r.text.lower() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(20).collect()]
    docs = [" ".join(t.split()[:60]) for t in docs] + [""]
    model = attention_lm.subwords(path)
    words = Counter(w for t in docs[::2] for w in t.split())
    ids = Counter()
    for w, c in words.items():
        for i in model.encode(w) or [0]:
            ids[i] += c
    slots = attention_lm.make_slots(path, dict(ids) | {-1: 11})
    net = attention_lm.Network.start(slots.log_counts)
    net.flat += np.random.default_rng(3).normal(0, 0.2, len(net.flat)).astype(np.float32)
    n_tokens = sum(words.values()) + 11
    found = attention_lm.score_texts(attention_lm.Reader(path, slots), net, pa.array(docs, pa.string()), pa.array(list(words), pa.large_string()), np.array(list(words.values())), n_tokens, 11)

    def softmax(x):
        x = np.exp(x - x.max())
        return x / x.sum()

    def place(before):
        """Probabilities of all slots after the given ones of a window."""
        x = np.array([net.emb[s] + net.pos[i] for i, s in enumerate(before)], np.float64)
        a = softmax((x[-1] @ net.wq) @ (x @ net.wk).T * attention_lm.SCALE)
        h = np.maximum(np.concatenate([x[-1], a @ (x @ net.wv)]) @ net.w1 + net.b1, 0)
        kinds = softmax(h @ net.wc + net.bc)
        return np.concatenate([kinds[k] * softmax(h @ net.wm[k] + net.bm[k]) for k in range(attention_lm.CLASSES)])

    for text, score in zip(docs, found["score"], strict=True):
        sequence, spans, shares = [], [], []
        for w in text.split():
            own = model.encode(w) or [0]
            at = [int(slots.slot[i]) for i in own]
            at = [attention_lm.RARE_FIRST if at[0] >= attention_lm.RARE_NEXT else at[0], *(attention_lm.RARE_NEXT if s < attention_lm.RARE_NEXT else s for s in at[1:])]
            spans.append((len(sequence), len(sequence) + len(at)))
            shares.append(sum(float(slots.log_share[i]) for i in own))
            sequence += at
        sequence.append(attention_lm.END)
        inputs = [attention_lm.END, *sequence[:-1]]
        each, starts = [], []
        for i in range(len(sequence)):
            nth = 0 if i < attention_lm.WINDOW else -(-(i + 1 - attention_lm.WINDOW) // attention_lm.STRIDE)
            p = place(inputs[nth * attention_lm.STRIDE : i + 1])
            each.append(math.log(p[sequence[i]]))
            starts.append(math.log(p[: attention_lm.RARE_NEXT].sum()))
        mixed = []
        for u, n, c in attention_lm.MIXTURES:
            total, earlier = 0.0, Counter()
            for k, (w, (a, b)) in enumerate(zip(text.split(), spans, strict=True)):
                network = math.exp(min(0.0, sum(each[a:b]) - starts[a] + starts[b] + shares[k]))
                share = words.get(w, 0) / n_tokens
                total += math.log(u * share + n * network + c * (earlier[w] / k if k else share))
                earlier[w] += 1
            total += math.log((u if spans else u + c) * 11 / n_tokens + n * math.exp(min(0.0, each[-1] - starts[-1])))
            mixed.append(total)
        assert abs((np.logaddexp.reduce(mixed) - math.log(len(mixed))) / math.log(10) - score) < 1e-3 * max(1.0, abs(score))
