"""Packing, LM scoring, WARC, BPE, fingerprints and the pipeline."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bpe, fingerprints, lm_scoring, packing, warc

P = pytest.importorskip("public_tokenizers")
ROWS = [(5, "The cat sat on the mat. " * 3), (1, None), (2, ""), (3, "it's <|endoftext|> A\n\nB"), (9, "naïve Σίσυφος ΑΣ 日本語  x"), (4, "word " * 5000), (7, "a b"), (8, "a b"), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, tag int").repartition(3).cache()


def texts():
    return {d: t or "" for d, t in ROWS if d is not None}


def test_bpe(docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, path, ids=True).collect()}
    for d, t in texts().items():
        ids = lib.encode(t, add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert got[d].ids == ids and got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    own, rnd = bpe.load(path), random.Random(4)
    tokens = [t.replace(bpe.END, "") for t in own.vocab]
    for _ in range(2000):
        w = bytes(own.places[c] for c in "".join(rnd.choice(tokens) for _ in range(3))).decode("utf-8", "ignore")
        assert own.encode(w) == lib.encode(w, add_special_tokens=False).ids


def test_packing(docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, 512, ids=True).collect()
    whole = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(whole[r.doc_id]) and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        whole[r.doc_id] += r.ids
    assert whole == {d: [*lib.encode(t, add_special_tokens=False).ids, 0] for d, t in texts().items()}
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_reduction_is_a_packing():
    rnd = random.Random(3)
    for _ in range(150):
        cap = rnd.choice([7, 10, 33, 100])
        hist = {rnd.randint(1, cap): rnd.randint(1, 20) for _ in range(rnd.randint(0, 15))}
        plan, info = packing.reduce_and_fit(hist, cap)
        bins = collections.defaultdict(list)
        import numpy as np

        for size, n in hist.items():
            for s, o in zip(*(x.tolist() for x in plan.place(np.full(n, size), np.arange(n))), strict=True):
                bins[s].append((o, size))
        for b in bins.values():
            at = 0
            for o, size in sorted(b):
                assert o == at
                at += size
            assert at <= cap
        assert len(bins) == info["sequences"] >= info["bound"]


def test_lm(docs):
    toks = {d: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)})), None] for d, t in texts().items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in toks}
    c = collections.Counter(w for d, t in toks.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs).collect()}
    for d, t in toks.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (got[d].held_out, got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (held[d], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(got[d].base_score - base) < 1e-6 * max(1, abs(base)) and got[d].score < 0
    assert lm_scoring.score_documents(docs.limit(0)).count() == 0


def test_lm_score(spark):
    """The score against brute-force counts and EM on exact held-out probabilities; probabilities sum to one."""
    import numpy as np

    rnd = random.Random(12)
    words = [f"w{i}" for i in range(80)]
    texts = {}
    for d in range(300):
        out = [rnd.choice(words)]
        for _ in range(rnd.randint(0, 60)):
            out.append(words[(words.index(out[-1]) * 7 + rnd.choice([1, 1, 1, 2, 3])) % 80] if rnd.random() < 0.7 else rnd.choice(words))
        texts[d] = " ".join(out)
    part = {d: zlib.crc32(str(d).encode()) % 10 for d in texts}

    def count(docs):
        uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for d in docs:
            toks = [*texts[d].split(), None]
            for v, w in zip(["<s>", *toks], toks, strict=False):
                uni[w] += 1
                bi[v, w] += 1
                ctx[v] += 1
        return uni, bi, ctx

    uni, bi, ctx = count([d for d in texts if part[d]])
    n, v = sum(uni.values()), len(uni)
    u8, b8, c8 = count([d for d in texts if 0 < part[d] < 9])
    n8 = sum(u8.values())
    bucket = lambda c: min(int(math.log2(c)) + 1, lm_scoring.BUCKETS - 1) if c else 0
    held = collections.defaultdict(list)
    for d in texts:
        if part[d] == 9:
            toks = [*texts[d].split(), None]
            for a, w in zip(["<s>", *toks], toks, strict=False):
                held[bucket(c8[a])].append((b8[a, w] / max(c8[a], 1), u8[w] / n8, 1 / (v + 1)))

    def em(rows):
        p, lam = np.array(rows), np.full(3, 1 / 3)
        for _ in range(60):
            share = lam * p
            lam = (share / share.sum(axis=1, keepdims=True)).sum(axis=0) + 0.5
            lam /= lam.sum()
        return lam

    everything = em([r for rows in held.values() for r in rows])
    lam = {b: em(held[b]) if held[b] else everything for b in range(lm_scoring.BUCKETS)}

    def prob(a, w):
        weights = lam[bucket(ctx[a])].copy()
        if not ctx[a]:
            weights[0] = 0
            weights /= weights.sum()
        return float(weights @ [bi[a, w] / max(ctx[a], 1), uni[w] / n, 1 / (v + 1)])

    for a in ("<s>", "w3", "never seen"):
        assert abs(sum(prob(a, w) for w in uni) + prob(a, "unknown word") - 1) < 1e-9
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in lm_scoring.score_documents(docs).collect():
        toks = [*texts[r.doc_id].split(), None]
        want = sum(math.log10(prob(a, w)) for a, w in zip(["<s>", *toks], toks, strict=False))
        assert abs(r.score - want) < 0.01 * abs(want), (r.doc_id, r.score, want)


def test_lm_probabilities():
    """Weights are positive and sum to one, and follow where the held-out counts point."""
    import numpy as np

    lam = lm_scoring.learn_weights(np.array([[3, 0, 4, 100], [5, lm_scoring._NONE, 8, 100]]), 1000, 50)
    assert np.allclose(lam.sum(axis=1), 1) and (lam > 0).all() and lam[3, 0] > 0.8 > lam[5, 0]


def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://a.org/x", "same"), (1, "http://www.a.org:80/y?q", "same"), (2, "https://b.org", "other"), (4, None, None), (5, "http://a.org/x", ""), (6, "x\ny", "é" * 5000), (None, "z", "no id"), (7, "http://a.org/x", "same")], "page_id long, url string, html string").repartition(3)
    rows = {r.page_id: r for r in pages.collect() if r.page_id is not None}
    first = {}
    for p in sorted(rows):
        first.setdefault(rows[p].html or "", p)
    archives = warc.write_archives(pages)
    index = warc.build_index(archives, 2)
    got = {r.page_id: r for r in warc.read_records(warc.lookup(index, pages.select(F.coalesce("url", F.lit("")).alias("url")))).collect()}
    assert sorted(got) == sorted(rows)
    for p, r in rows.items():
        body = (r.html or "").encode()
        f = first[r.html or ""]
        assert (got[p].payload_bytes, got[p].payload_digest, got[p].record_type, got[p].refers_to) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if f == p else "revisit", None if f == p else f)
        assert got[p].payload == (body if f == p else None)
    asked = spark.createDataFrame([("http://a.org/x",), ("http://nowhere.org",), ("http://a.org:80/x",)], "url string")
    assert sorted(r.page_id for r in warc.lookup(index, asked).collect()) == [3, 5, 7]
    assert {tuple(r) for r in warc.captures(index).collect()} == {tuple(r) for r in warc.lookup(index, pages.withColumn("url", F.coalesce("url", F.lit("")))).collect()}
    damaged = index.withColumn("first", F.lit("zzz"))  # without its directory the index finds nothing
    assert warc.lookup(damaged, asked).count() == 0
    with gzip.open(archives.first().archive.removeprefix("file://")) as f:  # the files are ordinary WARC
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: ")
    crowd = spark.createDataFrame([(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/", f"p{i % 50}") for i in range(900)], "page_id long, url string, html string")
    hot = warc.lookup(warc.build_index(warc.write_archives(crowd), 7), crowd)
    assert sorted(r.page_id for r in warc.read_records(hot).collect()) == list(range(900))
    assert warc.url_key("http://www.A.org:8080/p?q=1") == "org,a,www:8080)/p?q=1"
    none = warc.write_archives(pages.limit(0))
    assert warc.captures(warc.build_index(none)).count() == 0


def test_fingerprints(docs):
    order = sorted(texts().items(), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edits(docs).collect()}
    assert len(got) == len(order)
    sign = lambda t: fingerprints.fingerprint(fingerprints.signatures(pa.array([t])))[0]
    for i, (d, t) in enumerate(order):
        after, third = order[(i + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == sign(t) and r.edited_fingerprint == sign(edited) and 0 <= r.near_edited <= 1
        assert r.near_next == fingerprints.likeness(fingerprints.signatures(pa.array([t])), fingerprints.signatures(pa.array([after])))[0]
    assert fingerprints.edits(docs.where("doc_id = 5")).first().near_next == 1.0 and fingerprints.edits(docs.limit(0)).count() == 0
    assert {(r.doc_id, r.near_id) for r in fingerprints.near_pairs(docs).collect()} == {(8, 7)}
    assert {(r.doc_id, r.near_id) for r in fingerprints.with_neighbours(docs).collect()} == {(d, 7 if d == 8 else None) for d in texts()}


def test_near_first(spark):
    """The smallest of the bands' first documents that is near on full sets, and estimates close to Jaccard."""
    import numpy as np

    rnd = random.Random(9)
    base = [f"n{i}" for i in range(300)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 22)):
            w[rnd.randrange(300)] = f"y{rnd.randrange(900)}"
        rows.append((i + 1, " ".join(w)))
    grams = {d: {tuple(t.split()[i : i + 5]) for i in range(296)} for d, t in rows}
    sig = fingerprints.M.minima(*fingerprints.M.shingles(pa.array([t for _, t in rows])), 64)
    bands = sig.reshape(60, 16, 4)
    want = {}
    for d, _ in rows:
        firsts = {min(e for e, _ in rows if (bands[e - 1, b] == bands[d - 1, b]).all()) for b in range(16)} - {d}
        near = [e for e in firsts if 100 * len(grams[d] & grams[e]) >= 75 * len(grams[d] | grams[e])]
        want |= {d: min(near)} if near else {}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.near_id for r in fingerprints.near_first(docs).collect()} == want and 10 < len(want) < 59
    true = np.array([len(grams[1] & grams[d]) / len(grams[1] | grams[d]) for d, _ in rows])
    seen = fingerprints.likeness(fingerprints.signatures(pa.array([rows[0][1]] * 60)), fingerprints.signatures(pa.array([t for _, t in rows])))
    assert abs(seen - true).mean() < 0.06 and abs(seen - true).max() < 0.25


def test_neighbours_beyond_smallest(spark):
    """A link between two late documents is not lost where a smaller one below the threshold is first in all bands they share."""
    rnd = random.Random(5)
    words = [f"q{i}" for i in range(260)]
    late = {1000: " ".join(words), 1001: " ".join([*words[:-12], *(f"z{i}" for i in range(12))])}
    bands = lambda t: fingerprints.M.minima(*fingerprints.M.shingles(pa.array([t])), 64).reshape(16, 4)
    meet = lambda a, b: (bands(a) == bands(b)).all(axis=1)
    todo, rows = meet(late[1000], late[1001]), dict(late)
    for i in range(1000):
        w = list(words)
        for at in range(rnd.randrange(26), 260, 26):
            w[at] = f"y{i}x{at}"
        hit = meet(" ".join(w), late[1000]) & todo
        if hit.any():
            rows[i], todo = " ".join(w), todo & ~hit
    assert not todo.any()
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert not fingerprints.near_first(docs).where("doc_id = 1001 and near_id = 1000").count()
    grams = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows.items()}
    comp = {d: d for d in rows}
    for a in rows:
        for b in rows:
            if a < b and 100 * len(grams[a] & grams[b]) >= 75 * len(grams[a] | grams[b]):
                comp = {d: min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for d, c in comp.items()}
    assert comp[1001] == 1000
    assert {r.doc_id: r.near_id for r in fingerprints.with_neighbours(docs).collect()} == {d: c if c < d else None for d, c in comp.items()}


def test_corpus_counts_beyond_32_bits():
    """Counts of two blocks whose sum passes 2**31 come back whole, to the rows that are scored."""
    import numpy as np

    from loomgraph.llm import exchange as X

    text = X.pack(pa.record_batch([pa.array([1, 2, 3]), pa.array(["a b a", "c a b", "b b"], pa.large_string())], names=["doc_id", "text"]))
    (ask,) = lm_scoring._ask(1)([pa.record_batch([pa.array([0]), pa.array([text], pa.binary())], names=["f", "text"])])
    m = lm_scoring._opened(ask.column("frame")[0].as_py(), *lm_scoring._ASKED)
    big = [np.full(len(x), 2_000_000_000, x.dtype) if x.dtype == np.int32 else x for x in m]
    asked = [X.row(0, lm_scoring._ASK, lm_scoring._message(np.array([f], np.int64), *big[1:])) for f in (0, 1)]
    answers = [r for r in lm_scoring._answer(1)(asked) if r.column("tag")[0].as_py() == lm_scoring._ASK]
    (out,) = lm_scoring._join(1)([*answers, X.row(0, lm_scoring._TEXT, lm_scoring.struct.pack("<q", 0) + text)])
    words, pairs = lm_scoring._opened(out.column("counts")[0].as_py(), np.int64, np.int64)
    assert set(words) == set(pairs) == {8_000_000_000} and len(words) == len(m[1]) and len(pairs) == len(m[4])


def test_near_pairs_beyond_smallest(spark):
    """Two near documents are linked although a smaller one below the threshold is first in all bands they share."""
    import numpy as np

    rnd = random.Random(5)
    words = [f"q{i}" for i in range(260)]
    late = {1000: " ".join(words), 1001: " ".join([*words[:-12], *(f"z{i}" for i in range(12))]), 1002: " ".join(words)}
    sets = lambda t: {" ".join(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    bands = lambda t: fingerprints.M.minima(*fingerprints.M.shingles(pa.array([t])), 64).reshape(16, 4)
    meet = lambda a, b: (bands(a) == bands(b)).all(axis=1)
    todo, rows = meet(late[1000], late[1001]), dict(late)
    for i in range(1000):
        w = list(words)
        for at in range(rnd.randrange(40), 260, 26):
            w[at] = f"y{i}x{at}"
        hit = meet(" ".join(w), late[1000]) & todo
        if hit.any() and len(sets(" ".join(w)) & sets(late[1000])) < 0.7 * len(sets(" ".join(w)) | sets(late[1000])):
            rows[i], todo = " ".join(w), todo & ~hit
        if not todo.any():
            break
    assert not np.any(todo)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r.doc_id, r.near_id): r.jaccard for r in fingerprints.near_pairs(docs).collect()}
    a, b = sets(late[1001]), sets(late[1000])
    assert got[1001, 1000] == len(a & b) / len(a | b) and got[1002, 1000] == 1.0


def test_pipeline(spark):
    """Each stage against brute force on what its predecessor kept."""
    import corpus_pipeline as C

    rnd = random.Random(8)
    words = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(60)), "de", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " tail", "de", "s0", 0) for i in range(5)] + [(200, "too short", "de", "s0", 0), (201, None, None, None, None)]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    rows += [(300 + i, " ".join(rnd.choice(words) for _ in range(50)) + " " + passage, "de", "s1", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
            docs = out.cache()
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    good = {r[0] for r in rows if r[0] not in (200, 201)}
    assert set(kept["quality_rules"]) == good == set(kept["line_dedup"])
    assert set(kept["near_dedup"]) == good - {100, 101, 102, 103, 104}
    assert passage in kept["substring_dedup"][300] and passage not in kept["substring_dedup"][301] and kept["substring_dedup"][0] == rows[0][1]
    assert {r.doc_id for r in out.collect()} == set(kept["near_dedup"])
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "packing"]
