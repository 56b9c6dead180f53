"""The registered queries and the stages of the pipeline on a written fixture, against plain Python or SQL."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ntuple.llm import chat, mixing, oracles, queries, secrets
from ntuple.llm.common import sums_before
from tests.llm.test_small import words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    rng = random.Random(12)
    texts = ["\n".join(" ".join(words(rng, rng.randint(4, 14))) for _ in range(rng.randint(2, 14))) for _ in range(120)]
    keys = ["password = hunter2hunter2", 'API_KEY: "abcdefgh.12"', "token=short", "AKIA" + "Q7" * 8, "AKIAshort", "f" * 40, "0123456789abcdef" * 2]
    texts += [f"{t} {rng.choice(keys)} {rng.choice(keys)};{rng.choice(keys)}" for t in texts[:40]]
    texts += [None, "", " \n\t ", "one", "é ü 漢字 😀 word", texts[0], texts[0], texts[1], " ".join(words(rng, 20_000))]
    return [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """A folder with ``documents`` and ``labels``, and the rows of ``documents``."""
    folder, rows = tmp_path_factory.mktemp("tables"), corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 2) for r in rows if r[0] % 3], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_sums_before_each_element(spark):
    lists = [list(range(n, 0, -1)) for n in (0, 1, 2, 3, 4, 10, 101)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>").select("x", sums_before(F.col("x")).alias("s"))
    assert all(r["s"] == [sum(r["x"][:i]) for i in range(len(r["x"]))] for r in df.collect())


def test_fingerprints_query(spark, fixture):
    folder, rows = fixture
    got = {r["doc_id"]: r for r in queries.op2_weighted_fingerprints(spark, folder).collect()}
    texts = [r[1] or "" for r in sorted(rows)]
    assert sorted(got) == list(range(len(texts)))
    by_text = defaultdict(set)
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r, n = got[i], got[(i + 1) % len(texts)]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        by_text[text].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
        for field, other, a, b in (("near_edited", edited, r["fingerprint"], r["edited_fingerprint"]), ("near_next", after, r["fingerprint"], n["fingerprint"])):
            assert 0 <= r[field] <= 1 and (a != b or r[field] == 1)
            x, y = Counter(WORDS.findall(text)), Counter(WORDS.findall(other))
            total = sum((x | y).values())
            want = sum((x & y).values()) / total if total else 1.0
            # 64 samples: five standard deviations of the weighted Jaccard similarity.
            assert abs(r[field] - want) <= 5 * (max(want * (1 - want), 0.02) / 64) ** 0.5, (i, field, r[field], want)
    assert all(len(v) == 1 for v in by_text.values())


def test_quality_query_keeps_what_one_threshold_keeps(spark, fixture):
    folder, rows = fixture
    got = {r["doc_id"]: r for r in queries.op3_quality_rules(spark, folder).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, text, *_ in rows:
        found = WORDS.findall(text or "")
        windows = Counter(tuple(found[j : j + 3]) for j in range(len(found) - 2))
        inside = {k for j in range(len(found) - 2) if windows[tuple(found[j : j + 3])] > 1 for k in range(j, j + 3)}
        seen, copies = set(), 0
        for line in (text or "").split("\n"):
            if WORDS.search(line):
                copies += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(found), sum(map(len, found)), copies, len(inside))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["base_failed"] == (len(found) < 50 or 100 * len(inside) > 50 * len(found)) and not (r["base_failed"] and r["kept"])
    passed = [r for r in got.values() if not r["base_failed"]]
    lowest = min((r["score"] for r in passed if r["kept"]), default=float("inf"))
    assert all(r["kept"] == (r["score"] >= lowest) for r in passed)
    same = defaultdict(set)
    for i, text, *_ in rows:
        same[text].add((got[i]["score"], got[i]["kept"]))
    assert all(len(v) == 1 for v in same.values())


def test_secret_query(spark, fixture):
    folder, rows = fixture
    got = {r["doc_id"]: r for r in queries.op6_secret_scan(spark, folder).collect()}
    assert sorted(got) == [r[0] for r in rows]
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found_any = Counter()
    for i, text, *_ in rows:
        base = []
        for rank, (kind, pattern, group, least) in enumerate(
            [("assign", assign, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
        ):
            base += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
        base.sort()
        spans = [f"{kind}:{a}:{b}" for a, _, b, kind in base]
        r = got[i]
        n = Counter(x[3] for x in base)
        found_any += n
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n["assign"], n["access"], n["hex"])
        assert r["base_sha256"] == sha(",".join(spans)) and set(spans) <= set(r["spans"].split(",")) | {""}
    assert min(found_any[k] for k in ("assign", "access", "hex")) > 3


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token={i:08d}" for i in range(20_000))
    spans = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [(s["start"], s["end"]) for s in spans if s["kind"] == "assign"] == [(m.start(), m.end()) for m in re.finditer(r"token=\d+", text)]


def test_shard_query(spark, fixture, tmp_path):
    folder, rows = fixture
    few = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IN (0, 3, 160, 161, 165)")
    few.write.parquet(f"{tmp_path}/few/documents.parquet")
    few.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op8_kd_shards(spark, f"{tmp_path}/none").count() == 0
    kept = {r["doc_id"] for r in few.collect()}
    for path, expected in ((folder, rows), (f"{tmp_path}/few", [r for r in rows if r[0] in kept])):
        got = {r["doc_id"]: r for r in queries.op8_kd_shards(spark, path).collect()}
        slots, of_text = defaultdict(list), defaultdict(set)
        assert sorted(got) == sorted(r[0] for r in expected)
        for i, text, *_ in expected:
            r, raw = got[i], (text or "").encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
            assert 0 <= r["shard"] < 24
            slots[r["shard"]].append(r["slot"])
            of_text[text or ""].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in of_text.values())
        assert len(slots) == min(24, len(of_text))


def test_chat_query_of_several_layouts(spark, tmp_path):
    rng = random.Random(3)
    bits = ["\\", "<", ">", "</turn>", "<turn:user>", "é", "😀", "\n", '"', "ok", ""]
    orders = [["user", "assistant"], ["system", "user", "assistant"], ["user", "user", "assistant"], ["human", "gpt"], ["user"], ["assistant", None]]
    rows = [
        (c, t, role, rng.choice([None, "".join(rng.choices(bits, k=4)), "".join(rng.choices(bits, k=4))]))
        for c in range(200) for t, role in enumerate(orders[c % 6] * (1 + c % 5 // 4))
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op9_chat_turns(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(oracles.CHAT)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    layouts = {r["layout"] for r in chat.conversation_turns(df, chat.dealt_layout).collect()}
    assert layouts == {m.name for m in chat.LAYOUTS}


def test_mixing_query_and_its_sql_with_small_sources(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 300 + i % 90)), "long") for i in range(600)]
    rows += [(1000 + i, "a b c d e f g", f"small{i % 4}" if i % 5 else None) for i in range(40)]
    rows += [(2000, None, "empty"), (2001, "", "empty"), (2002, "x", "tiny")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_mix_sources(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(oracles.MIX)
    names = [d[0] for d in want.description]
    mine = sorted(map(tuple, got.select(*names).collect()))
    assert mine == sorted(want.fetchall())
    source = {r[0]: r[2] for r in rows}
    taken, target = Counter(), {}
    for r in got.collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 0.01 * t + 1 for s, t in target.items()), (taken, target)


def test_blocks_are_small_beside_the_smallest_target():
    assert mixing.block_size(10**6, 10.0) == 1 and mixing.block_size(10**6, 10**5) == mixing.LEAST_BLOCK + 3
    assert mixing.block_size(10**6, 2560.0) == 20 and mixing.block_size(0, None) == 1


def test_stages_leave_clashing_columns_alone(spark, fixture, tmp_path):
    """Columns named like what the operators add keep their values through every stage."""
    folder, rows = fixture
    extra = ("_file", "_row", "whole", "parts", "n_words", "score", "n_symbols", "n_lines", "runs", "deleted_lines", "first", "size", "key", "shard")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.concat(F.lit(c), "doc_id") for c in extra})
    docs.write.parquet(f"{tmp_path}/wide.parquet")
    docs = spark.read.parquet(f"{tmp_path}/wide.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == f"{c}{r['doc_id']}" for r in found for c in extra)
        none = stage(spark, docs.limit(0), folder)
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_stages_keep_clean_documents_and_drop_copies(spark, fixture):
    folder, rows = fixture
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lines = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, folder).collect()}
    firsts: dict = {}
    for i, text, *_ in rows:
        if text is None or text == "" or i in (162,):
            assert lines.get(i, text) == text
        elif text in firsts and len(WORDS.findall(text)) >= 50:
            assert i not in lines
        firsts.setdefault(text, i)
    near = {r["doc_id"] for r in corpus_pipeline.near_join(spark, docs, folder).collect()}
    empty = {i for i, t, *_ in rows if not WORDS.search(t or "")}
    copies = {i for i, t, *_ in rows if firsts.get(t) != i} - empty
    assert not near & copies and len(near & empty) == 1
    # The first 120 texts are different; those from 120 on that add a secret to one of them may be near it.
    assert set(range(120)) <= near
    judged = {r["doc_id"]: r["kept"] for r in queries.op3_quality_rules(spark, folder).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, folder).collect()} == {i for i, k in judged.items() if k}
