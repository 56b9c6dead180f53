"""Rows, markings and fingerprints on small tables: nulls, empty and long texts, ties, repeats, extra columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ntuple.llm import chat, fingerprints, linededup, mixing, nearjoin, packing, quality, secrets, sharding, urlfilter
from ntuple.llm.common import count_words, running

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("the and of in to a".split()) if rng.random() < 0.4 else "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Ordinary, null, empty, blank, repeated and very long texts, copies, and ids that are null or shared."""
    rng = random.Random(4)
    texts = ["\n".join(" ".join(words(rng, rng.randint(4, 14))) for _ in range(rng.randint(3, 12))) for _ in range(40)]
    texts += [None, "", " \n\t ", "one", "é ü 漢字 😀 word", texts[0], texts[0], texts[1], " ".join(words(rng, 20_000))]
    near = texts[2].split(" ")
    near[10] = "changed"
    texts.append(" ".join(near))
    data = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*data, (None, texts[3], None, "s1", 5), (None, None, None, None, None), data[5], data[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns with the names of added ones must do no harm.
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("score", "size", "shard", "start", "length", "kept", "runs", "n", "keys", "rule")}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def multiset(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_running_sums_follow_the_order(spark):
    df = spark.range(200).select((F.col("id") * 37 % 101).alias("a"), "id").repartition(7)
    got = running(df, ["a", "id"], "id").orderBy("a", "id").collect()
    assert [r["before"] for r in got] == [0, *itertools.accumulate(r["id"] for r in got)][:-1]


# Packing


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 2), (4, 2)])
def test_hilbert_neighbours_touch(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = packing.hilbert(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    assert np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1).max() == 1


def test_packed_pieces_hold_every_token_once(docs, rows, none):
    from tokenizers import Tokenizer

    from ntuple.llm.queries import tokenizer_path

    model = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), length=256).collect()
    whole = defaultdict(list)
    for r in got:
        whole[r["doc_id"]].append((r["start"], r["length"], r["ids"], r["doc_tokens"]))
        assert len(r["ids"]) == 4 * r["length"]
    want = Counter()
    for doc_id, text, *_ in rows:
        want[(doc_id, len(model.encode(text or "", add_special_tokens=False).ids) + 1)] += 1
    counted = Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0)
    assert counted == want
    for doc_id, text, *_ in rows[:45]:
        if sum(r[0] == doc_id for r in rows) == 1:
            ids = b"".join(x[2] for x in sorted(whole[doc_id]))
            assert np.frombuffer(ids, "<u4").tolist() == [*model.encode(text or "", add_special_tokens=False).ids, 1]
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for s, pieces in places.items():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends == 256 or s == max(places)
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_odd_characters_are_tokenised_as_in_one_piece():
    from tokenizers import Tokenizer

    from ntuple.llm.queries import tokenizer_path

    texts = ["", "  ", "a\u00a0b \u0301x <|endoftext|> it's 'S 12a İstanbul ΣΑΣ. ﬁ Å \x1cq", "한글 !!,, <|startoftext|>x", "a" * 300 + " " + "ß" * 20]
    ids, lengths = packing.token_ids([t.encode() for t in texts], tokenizer_path(), 1)
    want = [[*e.ids, 1] for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == sum(want, []) and lengths.tolist() == [len(w) for w in want]


# Fingerprints


def jaccard(a, b):
    a, b = Counter((a or "").split()), Counter((b or "").split())
    total = sum(max(a[w], b[w]) for w in a | b)
    return sum(min(a[w], b[w]) for w in a | b) / total if total else 1.0


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    rng = random.Random(1)
    pairs = []
    for i in range(150):
        a = words(rng, rng.randint(20, 120))
        cut = rng.randint(0, len(a))
        pairs.append((i, " ".join(a), " ".join(a[:cut] + words(rng, rng.randint(0, 60)))))
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    a = fingerprints.fingerprints(df, ["i"], "a").withColumnRenamed("fingerprint", "fa")
    b = fingerprints.fingerprints(df, ["i"], "b").withColumnRenamed("fingerprint", "fb")
    got = {r["i"]: r["near"] for r in a.join(b, "i").select("i", fingerprints.likeness("fa", "fb").alias("near")).collect()}
    errors = np.array([got[i] - jaccard(x, y) for i, x, y in pairs])
    # 64 samples: the standard deviation is at most 1/16, the mean over 150 pairs is close to 0.
    assert abs(errors.mean()) < 0.02 and np.sqrt((errors**2).mean()) < 0.0625


def test_fingerprints_of_odd_texts(docs, rows, none):
    keyed = docs.dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(keyed, ["doc_id"]).collect()}
    assert got[40] == got[41] == got[42] == "" and got[0] == got[45] == got[46] and len(got[0]) == 256
    assert got[1] != got[0]
    assert fingerprints.fingerprints(none, ["doc_id"]).count() == 0


# Quality rules


def test_quality_statistics(docs, rows, none):
    model = quality.Model(np.zeros(1 << quality.BUCKET_BITS), 0.0)
    got = quality.judge(docs, model).collect()
    word = re.compile("[^\x20\x09-\x0d]+")
    want = []
    for doc_id, text, *_ in rows:
        found, lines = word.findall(text or ""), [x for x in (text or "").split("\n") if word.search(x)]
        windows = list(zip(found, found[1:], found[2:], strict=False))
        times = Counter(windows)
        marked = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
        failed = len(found) < 50 or 100 * len(marked) > 50 * len(found)
        want.append((doc_id, len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked), failed, not failed))
    multiset([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got], want)
    assert quality.judge(none, model).count() == 0


def test_repeated_words_of_texts_with_many_words():
    """A text may have more different words than the bits of a code tell apart."""
    codes = np.append(np.arange((1 << 21) + 4), [5, 6, 7])
    assert quality.repeated_words(codes) == 6
    # These two windows overlap to the same number when they are packed with 21 bits.
    clash = np.array([1, 0, 9, 0, 1 << 21, 9])
    assert quality.repeated_words(clash) == 0


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(240):
        text = words(rng, 80)
        if i % 4 == 0:
            text = [w + rng.choice(["***", "%%%"]) for w in text]
        texts.append((i, " ".join(text)))
        if i % 3 != 2:
            labels.append((i, 0 if i % 4 == 0 else 1))
    labels += [(None, 1), (7, None), (9999, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, model).collect()}
    # Held out: a third of the documents have no label.
    assert all(got[i] == (i % 4 != 0) for i in range(240))
    without = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert without.threshold == -np.inf


# URL filter


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "x://net", "http://example.net/en", "http://b.example.com/de/1", "http://notexample.com/de/1",
            "http://q.org/fr/?a://b/c", "http://ÄB.org#/fr/", "http://casino-win.example.org/en/4", "http://museum.example.org/en/4"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    from ntuple.llm.queries import URL_RULES

    model = urlfilter.fit(urlfilter.labelled_urls(spark))
    got = {r["page_id"]: r for r in urlfilter.judge(df, URL_RULES, model).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(len(urls))] == [
        ("", ""), ("", ""), ("", ""), ("a.example.net", "/en/x"), ("net", ""), ("example.net", "/en"), ("b.example.com", "/de/1"),
        ("notexample.com", "/de/1"), ("q.org", "/fr/"), ("Äb.org", ""), ("casino-win.example.org", "/en/4"), ("museum.example.org", "/en/4"),
    ]
    assert [got[i]["rule"] for i in range(len(urls))] == [None, None, None, "example.net/en/", None, "net/", "example.com/de/", None, "org/fr/", None, None, None]
    assert [got[i]["verdict"] for i in (3, 5, 6, 8, 10, 11)] == ["allow", "block", "block", "allow", "block", "allow"]
    assert urlfilter.judge(df.limit(0), URL_RULES, model).count() == 0


def test_url_model_on_held_out_hosts(spark):
    model = urlfilter.fit(urlfilter.labelled_urls(spark))
    block = [f"http://{p}{h}.example.com/en/{i}" for i, h in enumerate(("casino-night", "free-bets", "cheap-tablets", "spam-net", "ads-click", "adult-zone")) for p in ("", "m.", "blog.")]
    allow = [f"https://{p}{h}.example.org/fr/{i}.html" for i, h in enumerate(("thother", "tionth", "bakery", "thering", "forest")) for p in ("", "www.", "m.")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(block + allow)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(df, [], model).collect()}
    right = sum(got[i] == ("block" if i < len(block) else "allow") for i in range(len(got)))
    assert right >= 0.9 * len(got)


# Near join


def brute_links(rows):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for i, j in itertools.combinations(range(n), 2):
        a, b = sets[i], sets[j]
        near[i][j] = near[j][i] = (a == b) if not (a and b) else len(a & b) >= 0.8 * len(a | b) - 1e-12
    seen, group = {}, list(range(n))
    for i in range(n):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = i
                stack += [y for y in range(n) if near[x][y]]
    group = [seen[i] for i in range(n)]
    best = {}
    for i, g in enumerate(group):
        key = (rows[i][0] is None, rows[i][0] or 0)
        best[g] = min(best.get(g, key), key)
    return [(rows[i][0], None if best[group[i]][0] else best[group[i]][1], sum(near[i])) for i in range(n)]


def test_near_classes_equal_brute_force(docs, rows, none):
    got = nearjoin.near_classes(linededup.with_row_id(docs)).select("doc_id", "class_id", "n_links", "first").collect()
    multiset([r[:3] for r in got], brute_links(rows))
    # The classes of this table differ in their class_id, but for the one of null ids.
    assert sum(r["first"] for r in got) == len({r["class_id"] for r in got})
    assert nearjoin.near_classes(linededup.with_row_id(none)).count() == 0


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Nodes beyond the leaf size are split, and at the last level compared block by block; so are groups."""
    monkeypatch.setattr(nearjoin, "LEAF", 16)
    monkeypatch.setattr(nearjoin, "BLOCK_SETS", 16)
    monkeypatch.setattr(nearjoin, "BLOCK_TOKENS", 1500)
    rng = random.Random(3)
    base, passage, rows = words(rng, 120), words(rng, 60), []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    # These share a passage and are no near copies.
    rows += [(100 + i, " ".join(words(rng, 100) + passage)) for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nearjoin.near_classes(linededup.with_row_id(docs)).select("doc_id", "class_id", "n_links").collect()
    multiset(got, brute_links(rows))


def test_split_nodes_miss_no_more_than_allowed(spark, monkeypatch):
    """Groups at the threshold whose nodes are split as often as can be."""
    monkeypatch.setattr(nearjoin, "LEAF", 2)
    rows, groups = [], 200
    for g in range(groups):
        # 160 shingles in common and 20 of each text alone: 160 / 200.
        common = [f"c{g}w{k}" for k in range(164)]
        rows += [(6 * g + i, " ".join(common + [f"o{g}t{i}w{k}" for k in range(20)])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = nearjoin.near_classes(linededup.with_row_id(docs), miss=0.05).select("n_links").collect()
    assert len(got) == len(rows) and max(r["n_links"] for r in got) == 5
    assert sum(5 - r["n_links"] for r in got) <= 0.05 * 5 * len(rows)


def test_groups_and_pairs_of_blocks_agree():
    """Links and roots of one group equal those summed over its two blocks and the pair of them."""
    rng = random.Random(11)
    base = np.array(sorted(rng.sample(range(10**6), 60)), dtype=np.uint32)
    rows = []
    for i in range(40):
        keep = np.array([x for x in base if rng.random() < 0.97], dtype=np.uint32)
        rows.append((i, len(keep), 1 + i % 3, keep, 0))
    whole = {c: (r, n) for c, r, n in nearjoin.compared(rows, False)}
    a, b = rows[:20], [(*r[:4], 1) for r in rows[20:]]
    parts = [*nearjoin.compared(rows[:20], False), *nearjoin.compared(rows[20:], False), *nearjoin.compared(a + b, True)]
    sums = Counter()
    for c, _, n in parts:
        sums[c] += n
    near = lambda x, y: 9 * len(np.intersect1d(x[3], y[3])) >= 4 * (x[1] + y[1])
    for x in rows:
        want = sum(y[2] for y in rows if y[0] != x[0] and near(x, y))
        assert whole.get(x[0], (0, 0))[1] == sums[x[0]] == want
    assert {r for r, _ in whole.values()} == {0}


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("cross", [False, True])
def test_sketches_lose_no_link(monkeypatch, few, cross):
    """Linked sets of sizes about a power of two are connected candidates; sets far apart are none."""
    monkeypatch.setattr(nearjoin, "FEW", few)
    rng = np.random.default_rng(5)
    sets = []
    for size in (20, 60, 130, 500, 540, 2000):
        base = rng.choice(2**32, size, replace=False).astype(np.uint32)
        for i in range(8):
            new = rng.choice(2**32, rng.integers(0, size // 5 + 1), replace=False).astype(np.uint32)
            sets.append(np.unique(np.concatenate([base[len(new) * (i % 2) :], new])))
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    n = np.array([len(x) for x in sets])
    sketches = nearjoin.parity_sketches(np.concatenate(sets), owner, n)
    assert [len(x) * 8 for x in sketches] == [max(64, 1 << (len(x) - 1).bit_length()) for x in sets]
    rows = [(i, len(x), k, i % 2) for i, (x, k) in enumerate(zip(sets, sketches, strict=True))]
    roots = dict(nearjoin.candidates(rows, cross))
    links = 0
    for i, j in itertools.combinations(range(len(sets)), 2):
        shared = len(np.intersect1d(sets[i], sets[j]))
        if 9 * shared >= 4 * (n[i] + n[j]) and not (cross and i % 2 == j % 2):
            links += 1
            assert roots.get(i, i) == roots.get(j, j)
        if i // 8 != j // 8 and min(n[i], n[j]) > 64:
            assert roots.get(i, i) != roots.get(j, j)
    assert links > (20 if cross else 50)


# Secrets


def test_trigram_queries():
    query = secrets.trigram_query
    assert query("abc[0-9]+xyz") == ("and", ("abc", "xyz"))
    assert query("[0-9a-f]{32,}") is True
    assert query("(?:abc|de)[0-9]") is True
    assert query("(?:ABC|def)+") == ("or", ("abc", "def"))
    assert query("a[bc]d") == ("or", ("abd", "acd"))
    assert query("xyz?") is True
    assert query("(?:abc)?def") == ("or", ("def",)) or query("(?:abc)?def") == "def"


def test_spans_equal_a_plain_search(spark, none):
    rng = random.Random(5)
    parts = ["password", "=", ":", " ", '"', "'", "TOKEN", "api_key", "apikey", "secret", "é😀", "AKIA", "ABCDEF123456", "deadbeef" * 4, "xyz", "\n", "0a1b2c3d",
             "ghp_" + "A1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "https://user:pw@host/", "xoxb-123456789012", "sk_live_0123456789abcdef0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "a" * 50_000, "password = secret: abcdefgh1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r["doc_id"]: [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"]] for r in secrets.scan(df).collect()}
    for i, text in enumerate(texts):
        want = sorted(
            (m.start(), k, m.end(), r.kind) for k, r in enumerate(secrets.BASE + secrets.MORE) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least
        )
        assert got[i] == want
    assert secrets.scan(none).count() == 0


# Line dedup


def brute_lines(rows, least):
    """Straight from the definition: any earlier run of lines of that many words, tried at every place."""
    lines = []
    for _, text, *_ in rows:
        lines.append([(p, x.strip(" \t\x0b\f\r"), len(x.split())) for p, x in enumerate((text or "").split("\n")) if x.split()])
    seen, gone = {}, [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    for kind in (0, 1):
        seen.clear()
        for d in order:
            own = lines[d]
            for i in range(len(own)):
                total, j = 0, i
                while 0 <= j < len(own) and total < least:
                    total += own[j][2]
                    j += 1 if kind == 0 else -1
                if total < least:
                    continue
                a, b = (i, j - 1) if kind == 0 else (j + 1, i)
                key = tuple(x[1] for x in own[a : b + 1])
                first = seen.setdefault(key, (d, own[b][0]))
                if first[0] != d or own[a][0] > first[1]:
                    gone[d].update(range(own[a][0], own[b][0] + 1))
    out = []
    for d, (doc_id, text, *_) in enumerate(rows):
        kept = [x for p, x in enumerate((text or "").split("\n")) if p not in gone[d]]
        out.append((doc_id, text if not gone[d] else "\n".join(kept), len(gone[d])))
    return out


def test_repeated_runs_go(spark, docs, rows, none):
    got = linededup.dedup_lines(docs.coalesce(1), words=20)
    assert set(docs.columns) <= set(got.columns)
    multiset([(r["doc_id"], r["text"], r["deleted_lines"]) for r in got.collect()], brute_lines(rows, 20))
    rng = random.Random(6)
    pool = [" ".join(words(rng, rng.randint(1, 12))) for _ in range(12)] + ["", "  "]
    many = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    multiset([(r["doc_id"], r["text"], r["deleted_lines"]) for r in linededup.dedup_lines(df, words=20).collect()], brute_lines(many, 20))
    assert linededup.dedup_lines(none).count() == 0


# Sharding


def test_shards_are_even_and_gapless(spark, docs, rows, none):
    df = spark.range(3000).select(
        "id", (F.rand(1) * 100).alias("a"), F.randn(2).alias("b"), (F.col("id") % 900).alias("tie"), (1 + F.col("id") % 50).alias("w")
    )
    df = df.withColumns({"a": F.when(F.col("id") < 1000, 5.0).otherwise(F.col("a"))})
    got = sharding.kd_shards(df, [F.col("a"), F.col("b")], F.xxhash64("id"), F.col("w"), 13, keep=["id"]).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["weight"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 3000 and sorted(sizes) == list(range(13))
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 13 + 100
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    odd = sharding.kd_shards(docs, [F.length("text")], F.abs(F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.length("text"), 5, keep=["doc_id"])
    assert odd.count() == len(rows)
    assert sharding.kd_shards(none, [F.length("text")], F.lit(0), F.lit(1), 5, keep=["doc_id"]).count() == 0


def test_a_text_with_a_third_of_the_bytes_leaves_no_shard_empty(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 40.0).otherwise(F.rand(1) * 100).alias("a"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(2)).alias("b"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.abs(F.xxhash64("id") % 10**9)).alias("tie"),
    )
    sizes = defaultdict(int)
    for r in sharding.kd_shards(df, [F.col("a"), F.col("b")], F.col("tie"), F.lit(10), 24, keep=["id"]).collect():
        sizes[r["shard"]] += r["weight"]
    assert sorted(sizes) == list(range(24))
    *others, largest = sorted(sizes.values())
    assert largest == 10_000 and max(others) - min(others) <= 0.05 * 20_000 / 23


# Chat


def test_layouts_become_the_same_turns(spark):
    turns = [("user", "hi"), ("assistant", "yo")]
    records = [
        '{"messages":[{"role":"user","content":"hi"},{"content":"yo","role":"assistant"}]}',
        '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}',
        '{"prompt":"hi","completion":"yo"}',
        '{"response":"yo","prompt":"hi"}',
        '{"instruction":"hi","input":"","output":"yo"}',
        '{"instruction":"hi","output":"yo"}',
        '{"system":"","data":{"answer":"yo","question":"hi"}}',
        '{"messages":[]}', '{"other":1}', "not json", None,
        '{"prompt":null,"completion":"yo"}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string").withColumn("turns", F.lit(1))
    out = chat.render(chat.canonical_turns(df)).withColumns({"back": chat.read_back(F.col("formatted"))}).orderBy("i").collect()
    for r in out[:7]:
        assert [tuple(t) for t in r["turns"]] == turns and [tuple(t) for t in r["back"]] == turns
        assert [r["formatted"][a:b] for a, b in r["loss_spans"]] == ["yo"]
    assert out[7]["turns"] == [] and out[7]["formatted"] == "" and out[7]["loss_spans"] == []
    assert [r["layout"] for r in out[8:11]] == [None] * 3 and out[11]["turns"][0]["text"] == ""


def test_formatting_is_reversible(spark):
    rng = random.Random(7)
    bits = ["\\", "<", ">", "</turn>", "<turn:user>", "\\b", "\\l", "é", "😀", "\n", "ok", ""]
    rows = [(i // 3, i % 3, rng.choice(["user", "assistant", "a>b", None]), rng.choice([None, "".join(rng.choices(bits, k=6))])) for i in range(150)]
    rows.append((None, 0, "user", "alone"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = chat.render(chat.canonical_turns(chat.conversation_records(df)))
    got = shown.select("conv_id", chat.read_back(F.col("formatted")).alias("back"), chat.learned().alias("learned")).collect()
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role or "", text or ""))
    for r in got:
        assert [tuple(t) for t in r["back"]] == want[r["conv_id"]]
        assert r["learned"] == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
    assert chat.conversation_records(df.limit(0)).count() == 0


def test_long_texts_keep_their_turns(spark):
    """Texts over the 20,000,000 characters that Spark's JSON reader takes by default."""
    n = 20_000_100
    long = F.when(F.col("id") % 2 == 0, "hi").otherwise(F.repeat(F.lit("y"), n))
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    rows = spark.range(4).select(F.floor(F.col("id") / 2).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), long.alias("text"))
    sizes = F.transform("turns", lambda t: F.length(t["text"]))
    whole = chat.conversation_turns(rows).select("layout", sizes.alias("n")).collect()
    assert [tuple(r) for r in whole] == [("messages", [2, n])] * 2
    raw = chat.canonical_turns(chat.conversation_records(rows.where("conv_id = 0"))).select("layout", sizes.alias("n")).collect()
    assert [tuple(r) for r in raw] == [("messages", [2, n])]
    pair = F.concat(F.lit('{"prompt":"hi","completion":"'), F.repeat(F.lit("y"), n), F.lit('"}')).alias("record")
    said = chat.canonical_turns(spark.range(1).select(pair)).select("layout", sizes.alias("n")).collect()
    assert [tuple(r) for r in said] == [("prompt", [2, n])]
    with pytest.raises(Exception, match="over 134217728 bytes"):
        chat.canonical_turns(spark.range(1).select(F.repeat(F.lit("{"), n).alias("record"))).select("layout").collect()


# Mixing


def test_seats_go_to_the_highest_quotients(spark):
    rng = random.Random(8)
    rows = [(g, i, float(rng.randint(1, 1000)) ** 2, 37 + g) for g in range(6) for i in range(1 + g * 3)]
    df = spark.createDataFrame(rows, "g int, i int, w double, seats int")
    got = {(r["g"], r["i"]): r["n"] for r in mixing.sainte_lague(df, ["g"], "w", "seats", ["i"], "n").collect()}
    for g in range(6):
        quotients = sorted(((-w / (2 * k + 1), i) for h, i, w, _ in rows if h == g for k in range(60)))[: 37 + g]
        want = Counter(i for _, i in quotients)
        assert {i: got[g, i] for h, i, *_ in rows if h == g} == {i: want[i] for h, i, *_ in rows if h == g}


def test_targets_stop_at_three_times_the_source(spark):
    rows = [(1, 10, 5.0), (2, 1000, 1.0), (3, 20, 9.0), (4, 0, 2.0), (5, 300, 1.0)]
    df = spark.createDataFrame(rows, "sid int, size long, weight double")
    got = {r["sid"]: r["target"] for r in mixing.targets(df, 3).collect()}
    left, open_, want = float(sum(s for _, s, _ in rows)), {i: (s, w) for i, s, w in rows}, {}
    while open_:
        share = left / sum(w for _, w in open_.values())
        full = {i for i, (s, w) in open_.items() if share * w > 3 * s}
        if not full:
            want |= {i: share * w for i, (_, w) in open_.items()}
            break
        for i in full:
            want[i] = 3.0 * open_.pop(i)[0]
            left -= want[i]
    assert got == pytest.approx(want)


def test_mixture_comes_near_its_targets(spark, docs, rows, none):
    rng = random.Random(9)
    many = [(i, " ".join(words(rng, rng.randint(0, 300))), None if i % 7 == 0 else f"s{i % 5 if i % 2 else 0}") for i in range(1200)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string").repartition(5)
    size = count_words(F.col("text"))
    mixed = mixing.mix(df, size).withColumnRenamed("doc_id", "id").cache()
    got = mixed.join(df, mixed["id"] == df["doc_id"]).collect()
    taken, target = Counter(), {}
    for r in got:
        assert r["size"] == len(r["text"].split()) and r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["whole"] * r["size"] + sum(p["length"] for p in r["parts"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 64 for s in target)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(3), size).collect()}
    assert again == {r["id"]: r["taken"] for r in got}
    texts = mixing.copies(mixed.withColumnRenamed("id", "doc_id").drop("size").join(df, "doc_id"))
    total = texts.select(F.sum(count_words(F.col("text")))).first()[0]
    assert total == sum(taken.values())
    assert mixing.mix(docs, count_words(F.col("text"))).count() == len(rows)
    assert mixing.mix(none, count_words(F.col("text"))).count() == 0


def test_small_sources_reach_their_targets(spark, monkeypatch):
    """Sources of a few words up to some seats, beside a large one, over several shards."""
    monkeypatch.setattr(mixing, "BLOCKS", 64)
    monkeypatch.setattr(mixing, "SHARD_DOCS", 100)
    data = [(i, "large", 300) for i in range(1500)] + [(5000 + i, "short", 3) for i in range(900)]
    data += [(10_000 + i, f"s{k}", k) for k in (1, 7, 40) for i in range(12)] + [(20_000 + i, "some", 500) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, source string, n long").repartition(4)
    got = mixing.mix(df, F.col("n"), keep=["doc_id", "source"]).collect()
    assert len(got) == len(data)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["whole"] * r["size"] + sum(p["length"] for p in r["parts"]) <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in target), (taken, target)


def test_words_are_numbered_as_by_splitting():
    """Places of words between ASCII white space, at ends and in runs, and of bytes that are no UTF-8."""
    rng = random.Random(3)
    texts = [b"".join(rng.choice([b"a", b"bc", b"\xc3\xa9", b"\xff", b" ", b" ", b"\t", b"\r\n", b"\x0b\x0c", b"\x1c", b"\xc2\x85", b"\x00"]) for _ in range(n)) for n in range(60)]
    for text in [*texts, b"a", b" \n", b"  a a  b\t"]:
        codes, unique = packing.words_of(text)
        assert [unique[c] for c in codes.tolist()] == text.split() and len(set(unique)) == len(unique)
        assert all(type(w) is bytes for w in unique)
