"""Sharding along a Hilbert curve, the trie of conversations and periodic runs, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerfold.llm import queries, runs, sharding, trie

DATA = "/root/testdata/sf0.001"


# Sharding


@pytest.mark.parametrize(("dims", "bits"), [(1, 3), (2, 3), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    from pyspark.sql import functions as F

    points = spark.range(1 << bits * dims)
    axes = [F.shiftright("id", bits * k).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"x{k}") for k in range(dims)]
    rows = points.select(*axes).withColumn("at", sharding.hilbert([F.col(f"x{k}") for k in range(dims)], bits)).collect()
    at = {r["at"]: tuple(r[f"x{k}"] for k in range(dims)) for r in rows}
    assert sorted(at) == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(at[n], at[n + 1], strict=True)) == 1 for n in range(len(at) - 1))


def _odd_docs(spark, n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "same text", "word " * rng.randrange(60), "é" * rng.randrange(50)])
        rows.append((None if i % 50 == 0 else i // 2, text, rng.choice([None, "en", "de"]), rng.choice(["s1", "s2", "", None, "s" * 100]), -1, "x"))
    rows += [(7, "same text", "en", "s1", -1, "x")] * 200 + [(8, "long " * 40_000, "en", "s1", -1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, curve long, dim0 string")


def test_shards_of_odd_rows(spark):
    docs = _odd_docs(spark)
    out = [r.asDict() for r in sharding.sharded(docs, 8, ["lang", "source", sharding.SIZE]).collect()]
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(8))
    total, longest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 8) <= longest
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in out)


def test_shards_are_of_equal_bytes(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "repeat('a', cast(id * 7919 % 200 AS int)) AS text", "concat('l', id % 3) AS lang")
    sizes = [r["b"] for r in sharding.sharded(rows, 16, ["lang", sharding.SIZE]).groupBy("shard").sum("size").withColumnRenamed("sum(size)", "b").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 216


def test_no_documents_no_shards(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert sharding.sharded(docs, 8, ["lang", sharding.SIZE]).collect() == []


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    docs = _odd_docs(spark)
    sharding.write_sharded(docs, str(tmp_path / "out"), 8, ["lang", "source", sharding.SIZE])
    back = spark.read.parquet(str(tmp_path / "out"))
    count = lambda df: Counter(map(tuple, df.select(*docs.columns).collect()))
    assert count(back) == count(docs)
    placed = sharding.sharded(docs, 8, ["lang", "source", sharding.SIZE])
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    with pytest.raises(ValueError):
        sharding.write_sharded(docs.withColumnRenamed("curve", "shard"), str(tmp_path / "no"), 8, ["lang"])


def test_shards_have_narrow_ranges(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'' AS text", "id * 7919 % 1009 AS a", "id * 104729 % 997 AS b", "id * 15485863 % 991 AS c")
    placed = sharding.sharded(docs, 64, ["a", "b", "c"]).select("id", "shard").join(docs, docs.doc_id == sharding.F.col("id"))
    ranges = placed.groupBy("shard").agg(*(sharding.F.expr(f"max({n}) - min({n})").alias(n) for n in "abc")).collect()
    for n in "abc":  # 64 shards of a cube: about a quarter of each axis
        assert np.median([r[n] for r in ranges]) < 500


# Trie


def _brute_trie(rows, branch):
    """Nodes by brute force: rows of (conv, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (t[0], t[1], t[2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest())
    own = {c: [(t[2], t[3]) for t in sorted(v, key=key)] for c, v in own.items()}
    built = own
    if branch:
        built = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        found, todo = [], [p]
        while todo:
            found.append(todo.pop())
            todo += children[found[-1]]
        return found

    words = lambda text: len(text.replace("\x0b", " ").replace("\x0c", " ").split(None)) if text.isascii() else len([w for w in text.split(" ") if w])
    out = []
    for p, members in nodes.items():
        sub = below(p)
        ends = sorted(c for c in members if len(built[c]) == len(p))
        saved = sum((len(nodes[s]) - 1) * words(s[-1][1]) for s in sub if s)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children[p]), sum(not children[s] for s in sub), saved, digest))
    return sorted(map(repr, out))


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("branch", [False, True])
def test_trie_of_odd_conversations(spark, branch):
    rng = random.Random(9)
    texts = ["a b", "a  b", "", None, "c\x0bd e", "long " * 3000, "x"]
    rows = []
    for c in range(90):
        shared = c % 3 == 0  # a third begins alike, many of them are equal
        for t in range(rng.choice([1, 2, 5]) if not shared else 3):
            text = "a b" if shared and t < 2 else rng.choice(texts)
            rows.append((c * 3 - 20, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", None]) if not shared else "user", text))
    rows += [(1000, 5, "user", "tie"), (1000, 5, "user", "a b"), (1000, 5, "assistant", "z"), (None, 0, "user", "nobody")]
    rows += [(2000, t, "user", f"turn {t // 2}") for t in range(300)] + [(2001, t, "user", f"turn {t // 2}") for t in range(250)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    turns = trie.numbered(df)
    if branch:
        turns, convs = queries.branched(turns)
    else:
        convs = turns.select("conv")
    assert sorted(repr(tuple(r[n] for n in NAMES)) for r in trie.trie(turns, convs).collect()) == _brute_trie(rows, branch)


def test_trie_without_conversations_and_without_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns = trie.numbered(none)
    assert trie.trie(turns, turns.select("conv")).collect() == []
    (root,) = trie.trie(turns, spark.createDataFrame([(5,), (5,), (3,)], "conv long")).collect()
    assert (root["conv_id"], root["depth"], root["n_convs"], root["n_children"], root["n_leaves"], root["saved_tokens"]) == (3, 0, 2, 0, 1, 0)
    assert root["parent"] is None and root["ends_sha256"] == hashlib.sha256(b"3,5").hexdigest()


def test_sums_that_collide_are_an_error(spark, monkeypatch):
    turns = spark.createDataFrame([(1, 1, "aa", 1), (1, 2, "bb", 1), (2, 1, "cc", 1), (2, 2, "dd", 1)], "conv long, at long, said string, words long")
    monkeypatch.setattr(trie, "members", lambda turns, convs: spark.createDataFrame([(1, 2, "n", "p"), (2, 2, "n", "q")], "conv long, depth long, node string, parent string").selectExpr("*", "0L AS words", "true AS ends"))
    with pytest.raises(Exception, match="same sum"):
        trie.trie(turns, turns.select("conv"))


# Runs


def _brute_runs(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found[i, j + q] = min(q, found.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _repetitive(rng, n, letters=3):
    w = []
    while len(w) < n:
        w += [rng.randrange(letters) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 8)
        if rng.random() < 0.4:
            start = rng.randrange(len(w))
            w += w[start : start + rng.randrange(1, 20)]
    return w[:n]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (4, 3), (10, 2)])
def test_runs_of_sequences(least, times):
    rng = random.Random(times)
    for _ in range(400):
        w = _repetitive(rng, rng.randrange(0, 70), rng.choice([1, 2, 3]))
        want = _brute_runs(w, least, times)
        assert runs.runs_of(w, least, times) == want
        codes, texts = np.array(w, np.int64), np.array([0, len(w) // 3, len(w)])
        found = [(s + at, n, q) for s, e in runs.worth_a_look(codes, texts, least, times) for at, n, q in runs.runs_of(w[s:e], least, times)]
        cut = [(at + texts[k], n, q) for k in (0, 1) for at, n, q in _brute_runs(w[texts[k] : texts[k + 1]], least, times)]
        assert sorted(found) == sorted(cut)


def test_factors_are_longest():
    rng = random.Random(2)
    for _ in range(200):
        w = _repetitive(rng, rng.randrange(1, 40))
        at = 0
        for start, length, earlier in runs.factors(w):
            assert start == at
            at += length
            starts_before = lambda n, start=start, w=w: start + n <= len(w) and any(w[j : j + n] == w[start : start + n] for j in range(start))
            assert not starts_before(length + 1 if earlier >= 0 else 1)
            assert earlier < 0 or w[earlier : earlier + length] == w[start : start + length]
        assert at == len(w)


def test_long_repetitions_take_linear_time():
    import time

    w = list(range(50_000)) * 4
    began = time.time()
    assert runs.runs_of(w) == [(0, 200_000, 50_000)] and time.time() - began < 20


def test_runs_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, " \x0b "), (4, "a " * 6), (4, "a " * 6), (5, "a " * 5), (6, "é b\tc " * 4 + "d"), (7, "x " * 40_000), (8, "A a " * 3)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, runs int, id int")
    got = sorted((str(r["id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df).collect())
    want = [("1", [], ""), ("2", [], ""), ("None", [], ""), ("4", [(0, 6, 1)], "a"), ("4", [(0, 6, 1)], "a"), ("5", [], "a a a a a"), ("6", [(0, 12, 3)], "é b c d"), ("7", [(0, 40_000, 1)], "x"), ("8", [], "A a A a A a")]
    assert got == sorted(want)
    assert runs.periodic_runs(df.limit(0)).collect() == []


def test_runs_of_planted_documents(spark):
    import pyarrow.parquet as pq

    got = {r["doc_id"]: r.asDict() for r in queries.op13_periodic_runs(spark, DATA).collect()}
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    assert set(got) == {d["doc_id"] for d in docs}
    seen = 0
    for d in docs:
        text, h = d["text"] or "", zlib.crc32(str(d["doc_id"]).encode())
        words = "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ")
        words = [w for w in words if w]
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = _brute_runs(words)
        drop = {i for s, length, q in found for i in range(s + q, s + length)}
        r = got[d["doc_id"]]
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert r["n_runs"] == len(found)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()
        seen += bool(found)
    assert seen > 5
