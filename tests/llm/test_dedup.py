"""Line, near, substring and byte dedup and quality rules against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import line_dedup, near_dedup, quality_rules, substring_dedup, suffix_array
from loomgraph.llm.cuckoo import CuckooFilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def corpus():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["ÄÖ", "naïve", "#tag"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 160))) for _ in range(12)]
    line = "This very line of furniture stands on quite many pages"
    rows = []
    for i in range(150):
        text = base[i % 12][rnd.randint(0, 40) : rnd.randint(60, 900)]
        if i % 3 == 0:
            text = line.upper() + " \n" + text + "\n\n" + line
        if i % 7 == 0:
            text = "aa " * rnd.randint(0, 60) + text
        rows.append((i * 3, text))
    return [*rows, (900, None), (901, ""), (902, "\n"), (903, base[0]), (904, base[0]), (905, "a b c d"), (906, "A b  c d"), (907, "x" * 300_000), (908, "é" * 120 + "z" * 120), (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns have the names of internal ones.
    return spark.createDataFrame([(d, t, "de", f"s{i % 2}", i, "x", 1) for i, (d, t) in enumerate(corpus())], "doc_id long, text string, lang string, source string, n_chars long, tag string, b int").repartition(5).cache()


@pytest.fixture(scope="module")
def rows():
    return sorted((d, t or "") for d, t in corpus() if d is not None)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_lines(docs, rows):
    key = lambda s: s.strip(" \t\n\v\f\r").translate(LOW)
    held = collections.defaultdict(set)
    for d, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(d)
    want = {}
    for d, t in rows:
        ls = t.split("\n")
        left = [x for x in ls if not (len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != d)]
        want[d] = (len(ls), len(ls) - len(left), sha("\n".join(left)))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.h) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("h")).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 50


def test_line_index_is_reversible(spark, docs, tmp_path):
    path = str(tmp_path / "ix")
    index = line_dedup.LineIndex(spark, path, 4)
    state = lambda ix: {tuple(r) for r in ix.counts().collect()}
    a, b = docs.where("doc_id < 200"), docs.where("doc_id >= 200")
    index.insert(a)
    one = state(index)
    index.insert(b)
    assert state(index) != one and index.seen(b).count() > 0
    opened = line_dedup.LineIndex(spark, path, 4)  # goes on where the other stopped
    assert opened.version == index.version and state(opened) == state(index)
    opened.delete(b)
    assert state(opened) == one
    keys = {(r.shard, r.k1, r.k2) for r in opened.counts().collect()}
    for r in opened.filters().collect():  # the filters hold what is left, and not what was taken back
        f = CuckooFilter.from_bytes(bytes(r.filter))
        own = np.array([(x, y) for s, x, y in keys if s == r.shard], np.int64).reshape(-1, 2).view(np.uint64)
        assert f.contains(own[:, 0] ^ line_dedup.K.mix(own[:, 1])).all() and (f.table != 0).sum() == len(own)
    text = "This very line of furniture stands on quite many pages"
    new = spark.createDataFrame([(5000, "fresh line\n" + text), (5001, None)], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_dropped) for r in opened.kept(new, 5).collect()} == {5000: ("fresh line", 1), 5001: ("", 0)}
    opened.delete(a)
    assert state(opened) == set() and {r.n_dropped for r in opened.kept(new, 1).collect()} == {0}


def test_cuckoo():
    keys = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    f = CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.contains(keys + np.uint64(1)).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    assert CuckooFilter.from_bytes(f.to_bytes()).contains(keys[2500:]).all()


def covered(seqs, n):
    seen, out = set(), {}
    for d, s in seqs:
        c = [False] * len(s)
        for i in range(len(s) - n + 1):
            w = s[i : i + n] if isinstance(s, bytes) else tuple(s[i : i + n])
            if w in seen:
                c[i : i + n] = [True] * n
            seen.add(w)
        out[d] = c
    return out


@pytest.mark.parametrize("spread", [(0, 1), (2, 3), (16, 2000)])
def test_substrings(docs, rows, spread):
    seqs = [(d, WORD.findall(t)) for d, t in rows]
    cov = covered(seqs, 20)
    want = {d: (len(s), sum(cov[d]), sha(" ".join(w for w, c in zip(s, cov[d], strict=True) if not c))) for d, s in seqs}
    got = {r.doc_id: (r.n_words, r.n_removed, r.h) for r in substring_dedup.dedup_substrings(docs, spread=spread).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("h")).collect()}
    assert got == want


@pytest.mark.parametrize("spread", [(0, 1), (2, 3), (16, 2000)])
def test_bytes(docs, rows, spread):
    short = [(d, t.encode()) for d, t in rows if len(t) < 100_000]
    cov = covered(short, 100)
    runs = lambda c: sum(x and not (i and c[i - 1]) for i, x in enumerate(c))
    want = {d: (len(s), sum(cov[d]), runs(cov[d]), sha(bytes(b for b, c in zip(s, cov[d], strict=True) if not c))) for d, s in short}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in suffix_array.dedup_bytes(docs.where("text is null or length(text) < 100000"), spread=spread).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()}
    assert got == want
    long = suffix_array.dedup_bytes(docs.where("doc_id = 907")).first()
    assert (long.n_bytes, long.n_removed, long.n_spans) == (300_000, 299_999, 1)


def test_interval_tree():
    rnd = random.Random(2)
    for _ in range(20):
        segs = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 14))).encode() for _ in range(3)]
        got = {(n, tuple(o)) for n, o in suffix_array.maximal_repeats(segs, 2)}
        want = set()
        for s in segs:
            for i in range(len(s)):
                for j in range(i + 2, len(s) + 1):
                    w = s[i:j]
                    occ = [(k, p) for k, t in enumerate(segs) for p in range(len(t)) if t.startswith(w, p)]
                    left = {segs[k][p - 1] if p else -1 - 100 * k for k, p in occ}
                    right = {segs[k][p + len(w)] if p + len(w) < len(segs[k]) else -1 - 100 * k for k, p in occ}
                    if len(occ) > 1 and len(left) > 1 and len(right) > 1:
                        want.add((len(w), tuple(sorted(occ))))
        assert got == want


def test_near(docs, rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(t.translate(LOW))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = list(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want and sum(not v[2] for v in want.values()) > 20


def test_near_blocks(monkeypatch):
    """A large band is searched in blocks and joins the same clusters."""
    import pyarrow as pa

    n, rng = 60, np.random.default_rng(1)
    sig = rng.integers(0, 64, (n, 4)).astype(np.int64)
    batch = pa.record_batch([pa.array(np.full(n, 7)), pa.array(np.full(n, n)), pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(np.full(n, 9)), *(pa.array(sig[:, i]) for i in range(4))], names=["band", "cnt", "doc_id", "cluster", "n", "s0", "s1", "s2", "s3"])

    def clusters(group):
        monkeypatch.setattr(near_dedup, "SEARCH_GROUP", group)
        send, search = near_dedup._forest(3, 123, 75)
        frames, root, links = list(send([batch])), list(range(n)), 0
        for b in range(3):
            for t in search([f for f in frames if f.column("b")[0].as_py() == b]):
                for u, v in zip(t.column("u").to_pylist(), t.column("v").to_pylist(), strict=True):
                    links += 1
                    root = [root[v] if x == root[u] else x for x in root]
        return [root.index(x) for x in root], links

    few, many = clusters(7), clusters(4096)
    assert few[0] == many[0] and many[1] == n - len(set(many[0])) and 1 < len(set(many[0])) < n


def test_near_family(spark, monkeypatch):
    """A family with links at and around the threshold, in blocks and units of a few documents."""
    rnd = random.Random(5)
    base = [f"f{i}" for i in range(200)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.randint(1, 9)):
            w[rnd.randrange(200)] = f"x{rnd.randrange(500)}"
        rows.append((rnd.randrange(10**6) * 200 + i, " ".join(w)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(196)} for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {d: find(d) for d in sets}
    assert len(set(want.values())) > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shingles, unit in ((1 << 20, 512), (3000, 2)):
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
        monkeypatch.setattr(near_dedup, "UNIT", unit)
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == want


def test_hash_structure(spark):
    """Lines and words that any polynomial modulo 2**64 confuses stay apart."""
    a = "a"
    for _ in range(11):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(1, a), (2, a), (3, a), (4, b), (5, b + "\n" + b + "\n" + a)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=4).collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.quality(docs.withColumn("source", F.lit("s"))).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    few = docs.where("doc_id in (3, 4)").select("doc_id", F.array_join(F.array_repeat("text", 20), " ").alias("text"))
    assert [r.n_removed for r in substring_dedup.dedup_substrings(few).orderBy("doc_id").collect()] == [0, 0]
    from loomgraph.llm import lm_scoring

    got = lm_scoring.score_documents(docs.where("doc_id in (1, 4)")).collect()
    assert all(r.n_known == 2 * (not r.held_out) + 1 * r.held_out or r.n_known == 2 for r in got)


def test_quality(docs, rows):
    kw = {"min_docs": 10, "share": 0.05}
    got = {r.doc_id: r for r in quality_rules.quality(docs, **kw).collect()}
    assert sorted(got) == sorted(d for d, _ in rows)
    host = {d: f"s{i % 2}" for i, (d, _) in enumerate(corpus()) if d is not None}
    size = collections.Counter(host.values())
    held = collections.defaultdict(set)
    norm = lambda x: x.strip(" \t\n\v\f\r").translate(LOW)
    for d, t in rows:
        for x in t.split("\n"):
            if WORD.search(x):
                held[host[d], norm(x)].add(d)
    for d, t in rows:
        words, lines, seen = WORD.findall(t), t.split("\n"), set()
        dup = lost = 0
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
                h = held[host[d], norm(x)]
                if len(h) >= 10 and len(h) > 0.05 * size[host[d]] and d != min(h):
                    lost += len(WORD.findall(x))
        grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        rep = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        failed = len(words) < 10 or 100 * len(rep) > 20 * len(words)
        left = len(words) - lost
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_frequent_words, r.base_failed, r.kept) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(rep), lost, failed, not failed and left >= 10 and left >= 0.2 * len(words))


def test_quality_text(spark):
    """Lines over the production limits leave the text of all documents of a host, large or small, but the first."""
    import corpus_pipeline

    rows = [(i, ("" if i % 2 else " Home | NEWS \n") + " ".join(f"w{i}x{j}" for j in range(30)) + ("" if i % 2 else "\nhome | news"), None, "a", 0) for i in range(500)]
    rows += [(1000 + i, "Home | News\n" + " ".join(f"v{i}x{j}" for j in range(30)), None, "b", 0) for i in range(20)]
    rows += [(2000, "home | news\n\ntwo words", None, "a", 0), (400, rows[400][1] + "\n\nend", None, "a", 0), (2001, None, None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    norm = lambda x: x.strip(" \t\n\v\f\r").translate(LOW)
    want = sorted((d, "\n".join(x for x in t.split("\n") if d in (0, 1000) or norm(x) != "home | news")) for d, t, _, h, _ in rows if t and d != 2000)
    stage = corpus_pipeline.quality_stage(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in stage) == want and all(r.n_chars == len(r.text) for r in stage)
    got = quality_rules.quality(docs, keep=("text",)).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.kept) == want
    assert sorted(r.n_frequent_words for r in got if r.doc_id == 400) == [6, 6] and len(got) == len(rows)
    with pytest.raises(ValueError, match="n_words"):
        quality_rules.quality(docs.withColumn("n_words", F.lit(1)), keep=("n_words",))


def test_empty(docs):
    none = docs.limit(0)
    assert line_dedup.dedup_lines(none).count() == 0
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert suffix_array.dedup_bytes(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert quality_rules.quality(none).count() == 0
