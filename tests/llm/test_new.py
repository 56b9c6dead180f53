"""Source audit, hard negatives and SimHash against plain Python on small tables."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ntuple.llm import divergence, negatives, queries, simhash
from ntuple.llm.oracles import ORACLES

# Source audit


def price(n, total, v):
    return 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)


def apart(p, q):
    return (p - q) ** 2 // (p + q)


def audited(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in docs:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        groups = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        v = len(kept)
        p = {s: {t: price(c[t], sum(c.values()), v) for t in kept} for s, c in groups.items()}
        q = {t: price(whole[t], sum(whole.values()), v) for t in kept}
        for s in groups:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-apart(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -f, k + 1) for k, (f, _, item) in enumerate(found)}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "straße", "naïve", "漢字", "été", "x", "O'Neil", "a1b", "Ünder_score"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = []
    for i in range(160):
        own = words[i % 7 :: 5]
        rows.append((rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "S3", "é", None, ""]), " ".join(rng.choice(own) for _ in range(rng.randint(0, 40)))))
    rows += [("xx", "one", "rare words only"), ("xx", "two", None), ("yy", "alone", ""), (None, None, None), *rows[:5]]
    return rows


@pytest.mark.parametrize(("height", "width", "leaves"), [(128, 2048, (4, 32)), (2, 16, (2, 4)), (3, 7, (1, 3))])
def test_audit_equals_all_pairs_over_all_terms(spark, corpus, monkeypatch, height, width, leaves):
    for name, value in (("ROWS", height), ("COLUMNS", width), ("LEAF_ROWS", leaves[0]), ("LEAF_COLUMNS", leaves[1]), ("BATCH", 64)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame(corpus, "lang string, source string, text string").withColumns({c: F.lit("x") for c in ("term", "n", "rank", "v", "docs")})
    got = divergence.audit(docs, min_docs=6, top=4).collect()
    want = audited(corpus, 6, 4)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {r["value"] for r in got if r["lang"] == "xx"} == {0}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_uniform_quadrants_are_never_opened(monkeypatch):
    """Joint walks over blocks of their own compute only leaves that hold something."""
    monkeypatch.setattr(divergence, "LEAF_ROWS", 1)
    monkeypatch.setattr(divergence, "LEAF_COLUMNS", 1)
    opened = []
    real = divergence.divergence
    monkeypatch.setattr(divergence, "divergence", lambda p, q: opened.append(np.broadcast(p, q).size) or real(p, q))
    counts = np.zeros((8, 64), dtype=np.int64)
    counts[0, :8] = counts[7, 8:16] = 5
    totals = counts.sum(axis=1) + 2 * 64
    got = divergence.pair_sums(counts, totals)
    p = divergence.price(counts, totals[:, None])
    for a, b in itertools.combinations(range(8), 2):
        assert got[a, b] == real(p[a], p[b]).sum()
    assert sum(opened) < 28 * 64 / 2


def test_prices_of_huge_counts_are_exact():
    n, total = np.array([0, 1, 10**15 - 3, 8 * 10**15]), np.array([3, 10**15, 10**15 + 1, 8 * 10**15 + 2])
    assert divergence.price(n, total).tolist() == [1 + 10**9 * (int(a) + 2) // int(b) for a, b in zip(n, total, strict=True)]


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 5)
    text = "Aé b c ÉÉ's long-word " * 9
    assert divergence.terms_of(text.encode()) == Counter(t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("A", "a")))


# Hard negatives


def mined(rows, positives=5, negatives=3):
    """``rows``: (id, vector, label, anchor)."""
    good = [(i, [math.floor(256 * x) for x in v], y, a) for i, v, y, a in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for k, (i, v, y, anchor) in enumerate(good):
        if not anchor:
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), j, z) for m, (j, w, z, _) in enumerate(good) if m != k)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            inside = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out.update((i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside[:negatives]))
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.3), 2) if rng.random() < 0.8 else 0.0 for _ in range(6)], rng.randrange(3), i % 5 == 0) for i in range(300)]
    # Copies, a hot label, nulls, what is not finite, an anchor of zeros, repeated rows and short vectors.
    rows += [(1000 + i, rows[0][1], 1, i < 3) for i in range(80)]
    rows += [(2000, None, 1, True), (2001, [0.1] * 6, None, True), (None, [0.1] * 6, 1, True), (2002, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1, True)]
    rows += [(2003, [math.nan] + [0.1] * 5, 1, True), (2004, [math.inf] * 6, 1, True), (2005, [0.0] * 6, 1, True), rows[3], rows[3], rows[5], (2006, [0.5], 2, True)]
    return rows


@pytest.mark.parametrize("block", [16_384, 40])
def test_negatives_equal_a_full_sort(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "SPREAD", 3)
    monkeypatch.setattr(negatives, "FIRST_STEP", 2)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, anchor boolean").withColumns({c: F.lit("x") for c in ("row", "rb", "id", "score")})
    as_floats = [(i, v and [None if x is None else float(np.float32(x)) for x in v], y, a) for i, v, y, a in vectors]
    got = negatives.hard_negatives(df, id="vec_id", vector="embedding", label=F.col("label"), anchors=F.col("anchor"))
    padded = [(i, v and v + [0.0] * (6 - len(v)), y, a) for i, v, y, a in as_floats]
    assert Counter(map(tuple, got.collect())) == mined(padded)
    none = negatives.hard_negatives(df.limit(0), id="vec_id", vector="embedding", label=F.col("label"), anchors=F.col("anchor"))
    assert none.count() == 0


def test_components_beyond_floating_point_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-(2**26), 2**26)) + 0.5 for _ in range(3)], i % 2, i < 6) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int, anchor boolean")
    got = negatives.hard_negatives(df, id="id", vector="v", label=F.col("label"), anchors=F.col("anchor"), scale=8)
    good = [(i, [x * 8 / 256 for x in v], y, a) for i, v, y, a in rows]
    assert Counter(map(tuple, got.collect())) == mined(good)


def test_a_walk_ends_before_the_lists_do():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(size=(5000, 3)))
    anchor, lists = vectors[7], np.argsort(vectors, axis=0, kind="stable").T
    best, met = negatives.Best(3), 0
    for new, scores, threshold in negatives.walk(lists, vectors, anchor):
        met += len(new)
        best.take(scores, new, np.arange(5000))
        if best.closed(threshold):
            break
    assert met < 2500
    assert best.rows.tolist() == np.lexsort((np.arange(5000), -(vectors @ anchor)))[:3].tolist()


# SimHash


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def plain_components(prints):
    """Least connected index for each of the fingerprints, pair by pair."""
    own = list(range(len(prints)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3:
            a, b = root(i), root(j)
            own[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = ["the", "Of", "naïve", "É", "zero width", *("".join(rng.choices("abcdef", k=4)) for _ in range(60))]
    out = [" ".join(rng.choices(base, k=rng.randint(3, 200))) for _ in range(40)]
    for t in out[:12]:
        words = t.split(" ")
        for _ in range(4):
            words[rng.randrange(len(words))] = rng.choice(base)
            out.append("\n".join(words))
    return out + [None, "", " \t\n", "one", "one two", "ONE two", "a b c", out[0], out[0], " ".join(rng.choices(base, k=30_000))]


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_fingerprints_equal_the_definition(texts, monkeypatch, size):
    monkeypatch.setattr(simhash, "SLICE", size)
    monkeypatch.setattr(simhash, "HASHES", size)
    for t in texts:
        assert simhash.simhash((t or "").encode()) == plain_simhash(t)


def test_near_texts_are_one_component(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("fp", "key", "cid", "component")})
    prints = [plain_simhash(t) for _, t in rows]
    of = plain_components(prints)
    least = defaultdict(list)
    for (i, _), c in zip(rows, of, strict=True):
        least[c] += [] if i is None else [i]
    want = Counter((i, f, min(least[c])) for (i, _), f, c in zip(rows, prints, of, strict=True))
    assert Counter(map(tuple, simhash.near_components(docs).collect())) == want
    assert len(set(of)) < len(set(prints))
    assert simhash.near_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("long", "short"), [(4096, 16), (5, 2), (30, 3)])
def test_all_linked_fingerprints_are_connected(spark, monkeypatch, long, short):
    """Dense groups of fingerprints, whose lists are too long to compare at the first or second key."""
    monkeypatch.setattr(simhash, "LIST", long)
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = random.Random(long)
    prints = [rng.getrandbits(64) for _ in range(50)]
    for p in prints[:6]:
        for _ in range(40):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.append(q)
    # A group that agrees in five bytes.
    prints += [prints[7] ^ rng.getrandbits(24) for _ in range(120)] + [prints[7] ^ (1 << b) for b in range(24)]
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    of = plain_components(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash.links_of(df).collect()
    own = {p: p for p in prints}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in edges:
        own[root(a)] = root(b)
    groups = defaultdict(set)
    for p in prints:
        groups[root(p)].add(p)
    want = defaultdict(set)
    for p, c in zip(prints, of, strict=True):
        want[c].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_tallies_count_shared_bytes():
    rng = random.Random(2)
    x = np.array([sum(rng.choice([0, rng.getrandbits(8)]) << 8 * k for k in range(8)) for _ in range(500)], dtype=np.uint64)
    want = [sum(int(v) >> 8 * k & 255 == 0 for k in range(8)) for v in x]
    assert simhash.shared_bytes(x).tolist() == want
    assert simhash.linked(x).tolist() == [int(v).bit_count() <= 3 for v in x]


def test_registered_queries_use_whole_tables(spark, tmp_path, corpus, vectors, texts):
    """The three queries against plain Python, with the labels and anchors that the query sets."""
    docs = [(i, t, lang, source, 0) for i, ((lang, source, _), t) in enumerate(zip(itertools.cycle(corpus), texts))]
    docs += [(1000 + i, t, lang, source, 0) for i, (lang, source, t) in enumerate(corpus)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([r[:3] for r in vectors if r[1] is None or len(r[1]) == 6], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in queries.op11_source_audit(spark, str(tmp_path)).collect()}
    assert got == audited([(lang, s, t) for _, t, lang, s, _ in docs], 10, 10)
    rows = [
        (i, v and [None if x is None else float(np.float32(x)) for x in v], y if y is None or i is None or i % 7 else (y + 1) % 10, i is not None and i % 50 == 0)
        for i, v, y, _ in vectors if v is None or len(v) == 6
    ]
    assert Counter(map(tuple, queries.op12_hard_negatives(spark, str(tmp_path)).collect())) == mined(rows)
    prints = [plain_simhash(r[1]) for r in docs]
    want = {r[0]: (f"{f & (2**64 - 1):016x}", docs[c][0]) for r, f, c in zip(docs, prints, plain_components(prints), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in queries.op13_simhash(spark, str(tmp_path)).collect()} == want
    assert "op13_simhash" not in ORACLES
