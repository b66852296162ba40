"""The operators on Spark: brute force, nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import chat, components, dedup_embedding, dedup_exact, dedup_minhash, html_text, mixing, packing, quality, tokens, url_filter

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def docs(spark, rows):
    """rows: (doc_id, text); the other columns clash with names that operators use."""
    full = [(i, t, f"l{(i or 0) % 2}", None if i == 3 else f"src{(i or 0) % 3}", k, b"x", 1.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, id long, sha binary, node double")


def family(rng, n, words=60):
    """Copies of a base text with ever more words changed."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(k % 8):
            own[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(own))
    return out


def classes(rows, words, percent):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[k] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i is None, i or 0), len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


EDGE = [(1, None), (2, ""), (3, "Solo"), (4, "solo"), (5, " \t\n"), (6, "A b"), (7, "a B"), (8, "É a"), (9, "é a"), (10, "long " * 60_000), (11, "LONG " * 60_000), (None, "a b"), (None, None), (12, "a b c"), (12, "a b c")]


def test_exchange_of_many_small_files(spark, monkeypatch):
    """Senders and owners are as many as rows ask for, not as files there are."""
    monkeypatch.setattr(dedup_exact, "ROWS_PER_SENDER", 500)
    monkeypatch.setattr(dedup_exact, "ROWS_PER_OWNER", 300)
    texts = [f"text {n % 2900}" for n in range(3000)]
    table = dedup_exact.stored(dedup_exact.fingerprints(docs(spark, list(enumerate(texts))).repartition(40), "doc_id", "text"))
    blocks = dedup_exact._blocks(table.repartition(40).coalesce(6), 10).collect()
    assert len({b["sender"] for b in blocks}) <= 6 and {b["owner"] for b in blocks} == set(range(10))
    got = sorted(r["fp"] for r in dedup_exact.suspects(table).collect())
    twice = table.groupBy("fp").count().where("count > 1")
    assert got == sorted(r["fp"] for r in twice.collect()) and len(got) == 100


def test_exact_dedup(spark):
    rows = EDGE + [(100 + i, "copy of many") for i in range(300)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    got = defaultdict(list)
    for r in dedup_exact.exact_dedup(docs(spark, rows)).collect():
        got[bytes(r.sha)].append(r)
    assert len(got) == len(groups)
    for text, ids in groups.items():
        found = got[hashlib.sha256(text.encode()).digest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r.id) for r in found) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in found} == {(keep, len(ids))}
        assert [r.id for r in found if r.kept] == [keep]


def test_keep_first_copies(spark):
    df = docs(spark, EDGE)
    kept = dedup_exact.keep_first_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()[:9]) for r in kept.collect()) == sorted(
        [(5, " \t\n"), (2, ""), (4, "solo"), (7, "a b"), (8, "é a"), (9, "é a"), (11, "long long"), (12, "a b c")]
    )


@pytest.mark.parametrize("words", [2, 5])
def test_near_classes_match_brute_force(spark, words):
    rng = random.Random(words)
    texts = family(rng, 60) + family(rng, 25, 12) + family(rng, 10, 3) + [" ".join(f"u{rng.randrange(99999)}" for _ in range(30)) for _ in range(20)]
    rows = EDGE + list(enumerate(texts, 100))
    got = dedup_minhash.near_classes(docs(spark, rows), words=words)
    found = sorted(((r.id is None, r.id or 0), r.n_shingles, r.component_id) for r in got.collect())
    assert found == classes(rows, words, 80)
    assert all(r.kept == (r.id == r.component_id) for r in got.collect())


def test_near_dedup_of_a_group_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup_minhash, "HELD", 7)
    monkeypatch.setattr(dedup_minhash, "STREAMED", 11)
    rows = list(enumerate(family(random.Random(9), 80)))
    got = dedup_minhash.near_classes(docs(spark, rows), words=2)
    assert sorted(((r.id is None, r.id or 0), r.n_shingles, r.component_id) for r in got.collect()) == classes(rows, 2, 80)


def test_many_families_under_common_keys(spark, monkeypatch):
    """Texts around several bases that share most words, so that keys are common to families which aren't linked; blocks of a few sketches."""
    for name, size in (("HELD", 5), ("STREAMED", 9), ("SKETCHES_HELD", 6), ("SKETCHES_STREAMED", 10)):
        monkeypatch.setattr(dedup_minhash, name, size)
    rng = random.Random(12)
    common = [f"c{rng.randrange(10_000)}" for _ in range(150)]
    texts = []
    for f in range(12):
        base = common + [f"f{f}x{i}" for i in range(30)]
        for k in range(8):
            own = list(base)
            for _ in range(3 * k):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    got = dedup_minhash.near_classes(docs(spark, rows), words=2)
    want = classes(rows, 2, 80)
    assert sorted(((r.id is None, r.id or 0), r.n_shingles, r.component_id) for r in got.collect()) == want
    assert 1 < len({c for _, _, c in want}) < len(rows)


def test_all_near_copies_of_the_documents_are_found(spark):
    duckdb = pytest.importorskip("duckdb")
    from ledgerfold.llm.queries import SQL

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    shown = lambda rows: sorted((int(a), int(b), int(c), bool(d)) for a, b, c, d in rows)
    found = dedup_minhash.near_classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), words=2)
    assert shown(found.select("id", "n_shingles", "component_id", "kept").collect()) == shown(
        con.execute(f"SELECT doc_id, n_shingles, component_id, kept FROM ({SQL['op1_minhash_near_dedup']})").fetchall()
    )
    found = dedup_embedding.near_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    assert shown(found.select("id", "n_links", "component_id", "kept").collect()) == shown(
        con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({SQL['op9_embedding_near_dedup']})").fetchall()
    )


def test_results_hold_without_broadcasts(spark, monkeypatch):
    """Tables beyond what may be broadcast go by the filter and a shuffle."""
    from ledgerfold.llm import scratch

    rows = EDGE + [(100 + i, t) for i, t in enumerate(family(random.Random(3), 30))] + [(200 + i, "copy") for i in range(40)]
    df = docs(spark, rows)
    of = lambda out: sorted(map(str, out.collect()))
    ops = (
        dedup_exact.exact_dedup,
        dedup_exact.keep_first_copies,
        lambda d: dedup_minhash.keep_one_of_each(d, words=2),
    )
    want = [of(op(df)) for op in ops]
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    assert [of(op(df)) for op in ops] == want


def test_rows_that_no_join_can_match_are_sifted(spark):
    from ledgerfold.llm import scratch

    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    for wanted in ("id * 70", "CAST(NULL AS BIGINT)"):
        some = spark.range(100).select(F.expr(wanted).alias("k"))
        got, want = {r.k for r in scratch.sifted(rows, "k", some).collect()}, {r.k for r in some.collect()}
        assert {k for k in want if k is None or 0 < k} <= got and len(got) < 110


def test_keep_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, None), (5, "z y x w v u")]
    kept = dedup_minhash.keep_one_of_each(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_small_sets_are_not_estimated(spark):
    """Sketches without a register in common: only sets as large as the sketch may be ruled out by it."""
    size = dedup_minhash.REGISTERS
    of = lambda name, v, n: (name.encode(), bytearray(np.full(size, v, np.uint16).tobytes()), n)
    nodes = spark.createDataFrame([of("a", 1, 5), of("b", 2, 4), of("c", 3, size), of("d", 4, size)], "node binary, registers binary, n long")
    pairs = spark.createDataFrame([(b"a", b"b"), (b"b", b"a"), (b"c", b"a"), (b"c", b"d")], "leader binary, node binary")
    got = {(bytes(r.leader), bytes(r.node)) for r in dedup_minhash._likely(pairs, nodes, 80).collect()}
    assert got == {(b"a", b"b"), (b"b", b"a")}  # a and c differ too much in size


def test_empty_tables(spark):
    none = docs(spark, []).select("doc_id", "text", "lang", "source")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = tokens.public_tokenizer()
    for out in (
        dedup_exact.exact_dedup(none),
        dedup_exact.keep_first_copies(none),
        dedup_minhash.near_classes(none),
        dedup_embedding.near_vectors(vectors),
        url_filter.judged_urls(pages, {"com/": "block"}),
        html_text.extracted(pages),
        tokens.token_counts(none, path),
        packing.packed(none, path),
        quality.quality(none, labels),
        mixing.mixed_sources(none, F.lit("web"), {}),
        chat.read_back(chat.rendered(chat.folded(chat.turn_events(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))),
    ):
        assert out.count() == 0


def test_urls(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "bad.org": "block"}
    urls = {1: "http://a.example.com/en/70?x", 2: "http://a.example.com/en/8", 3: "https://BAD.org", 4: "x://notbad.org/", 5: None, 6: "com/en/", 7: "http://com/en/", 8: "http://x.com/EN/"}
    df = spark.createDataFrame([(k, v, "r") for k, v in urls.items()], "page_id long, url string, rule string")
    got = {r.id: (r.rule, r.verdict) for r in url_filter.judged_urls(df, rules).collect()}
    assert got == {
        1: ("example.com/en/7", "allow"),
        2: ("com/en/", "block"),
        3: ("bad.org", "block"),
        4: (None, "allow"),
        5: (None, "allow"),
        6: (None, "allow"),
        7: ("com/en/", "block"),
        8: (None, "allow"),
    }


def test_url_rules_of_the_contract(spark, tmp_path):
    """Each rule's word as the contract of op2 has it, on its own host, on a subdomain and beside a longer rule."""
    from ledgerfold.llm.queries import op2_url_filter

    want = {
        "x://com/en/6": ("com/en/", "block"),
        "x://a.example.com/en/6": ("com/en/", "block"),
        "x://a.example.com/en/70": ("example.com/en/7", "allow"),
        "x://net/de/": ("net/de/", "allow"),
        "x://a.example.net/de/7": ("net/de/", "allow"),
        "x://b.net/de/8": ("net/de/", "allow"),
        "x://EXAMPLE.net/de/8": ("example.net/de/8", "block"),
        "x://a.example.net/de/80?q": ("example.net/de/8", "block"),
        "x://a.org/es/": ("org/es/", "block"),
        "x://a.org/de/8": (None, "allow"),
    }
    urls = list(want)
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {urls[r.page_id]: (r.rule, r.verdict) for r in op2_url_filter(spark, str(tmp_path)).collect()}
    assert got == want


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", "a <b> & &lt; </turn> \\"),
        (1, 0, "user", "### <turn>x<text>"),
        (1, 2, None, None),
        (1, 3, "assistant", "é😀"),
        (2, 0, "assistant", "same"),
        (2, 0, "assistant", "same"),
        (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    texts = chat.rendered(chat.folded(chat.turn_events(df)))
    for r in texts.collect():
        for s in r.loss:
            assert r.formatted[s.start : s.start + s.length].count("<") == 0
    got = {r.conv_id: r for r in chat.read_back(texts).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "### <turn>x<text>"), ("assistant", "a <b> & &lt; </turn> \\"), ("", ""), ("assistant", "é😀")]
    assert got[1].loss_texts == ["a <b> & &lt; </turn> \\", "é😀"]
    assert got[2].loss_texts == ["same", "same"] and [t.text for t in got[None].turns] == ["lost"]


def test_chat_events_fold(spark):
    rows = [
        (1, 1, 1, "delta", "user", "Hel"),
        (1, 1, 2, "delta", None, "lo"),
        (1, 2, 3, "message", "assistant", "draft"),
        (1, 2, 4, "delta", None, " more"),
        (1, 2, 5, "regenerate", None, None),
        (1, 2, 6, "delta", "assistant", "fi"),
        (1, 2, 7, "delta", None, "nal"),
        (1, 3, 8, "message", "user", "typo"),
        (1, 3, 9, "edit", None, "fixed"),
        (1, 3, 9, "edit", None, "fixed"),
        (1, 4, 10, "noise", "user", "ignored"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, message long, seq long, kind string, role string, text string")
    got = sorted((r.message, r.role, r.text) for r in chat.folded(df).collect())
    assert got == [(1, "user", "Hello"), (2, "assistant", "final"), (3, "user", "fixed")]


def test_token_counts_and_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokens.public_tokenizer()
    whole = tokenizers.Tokenizer.from_file(path)
    df = docs(spark, EDGE + [(50 + i, "word " * (37 * i)) for i in range(60)])
    texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    want = sorted((str(i), len(t.encode()), n, n > 1024) for i, t in texts for n in [len(whole.encode(t, add_special_tokens=False).ids)])
    assert sorted((str(r.id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(df, path).collect()) == want
    pieces = packing.packed(df, path, keep_ids=True).collect()
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(whole.encode(t, add_special_tokens=False).ids + [1])
    assert sum(r.length for r in pieces) == sum(len(x) for own in ids.values() for x in own)
    bins = defaultdict(list)
    for r in pieces:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        assert any(x[r.start : r.start + r.length] == r.ids and len(x) == r.doc_tokens for x in ids[r.id])
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_brings_left_overs_together_in_groups(spark, monkeypatch):
    df = docs(spark, [(i, "word " * (i % 90)) for i in range(900)]).repartition(8)
    path = tokens.public_tokenizer()
    whole = packing.packed(df, path).agg(F.sum("length")).first()[0]
    monkeypatch.setattr(packing, "GROUP_ROWS", 250)
    pieces = packing.packed(df, path).collect()
    assert sum(r.length for r in pieces) == whole
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    assert whole > 0.9 * 2048 * len(bins)


def test_padding_of_the_documents_is_small(spark):
    pieces = packing.packed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokens.public_tokenizer())
    used, bins = pieces.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert used > 0.99 * 2048 * bins


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup_embedding, "HELD", 13)
    monkeypatch.setattr(dedup_embedding, "STREAMED", 20)
    monkeypatch.setattr(dedup_embedding, "PIVOTS", 4)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    x[60:100] = x[0] + rng.normal(size=(40, 8)) * 0.15
    x[100:120] = x[5]
    x[120] = 3 * x[6]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0]]
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)] + [(200 + i, v, "l") for i, v in enumerate(odd)] + [(None, x[7].tolist(), "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    u = np.vstack([x, x[7:8]]).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    reach = near | np.eye(len(u), dtype=bool)
    while (more := reach @ reach).sum() > reach.sum():
        reach = more
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in dedup_embedding.near_vectors(df).collect()}
    for i in range(150):
        least = min(j for j in np.flatnonzero(reach[i]) if j < 150)
        assert got[i] == (near[i].sum(), least, i == least)
    assert got[None] == (near[150].sum(), 7, False)
    for i in range(200, 207):
        assert got[i] == (0, i, True)


def test_embeddings_at_the_limit_and_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.0], [0.95, (1 - 0.95**2) ** 0.5, 0.0]
    rows = [(1, a), (1, a), (2, b), (3, [v * 1e-300 for v in a]), (4, [v * 1e300 for v in a]), (None, None), (5, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u, v = np.array(a), np.array(b)
    linked = (u @ v) / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.95
    got = sorted((r.id or 0, r.n_links) for r in dedup_embedding.near_vectors(df).collect())
    assert got == [(0, 0), (1, 3 + linked), (1, 3 + linked), (2, 4 * linked), (3, 3 + linked), (4, 3 + linked), (5, 0)]


def test_urls_that_are_odd(spark):
    long = "http://" + "a." * 50_000 + "example.com/en/" + "x" * 100_000
    rows = [(1, long), (1, long), (None, "http://h.com/en/"), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(0)).withColumn("verdict", F.lit(1))
    got = sorted((r.id or 0, r.rule or "", r.verdict, len(r.path)) for r in url_filter.judged_urls(df, {"com/en/": "block", "example.com/en/x": "allow"}).collect())
    assert got == [(0, "com/en/", "block", 4), (1, "example.com/en/x", "allow", 100_004), (1, "example.com/en/x", "allow", 100_004), (2, "", "allow", 0), (2, "", "allow", 0)]


def test_pages_that_are_odd(spark):
    body = "<article>" + "<p>Some text, of an article.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "v", body), (3, "v", body), (None, "w", "<p>x &amp; y</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5)).withColumn("id", F.lit("clash"))
    got = sorted((r.id or 0, r.url or "", r.n_chars, r.text[:9]) for r in html_text.extracted(df).collect())
    n = 20_000 * 26 - 1 + 19_999 * 0
    assert [(a, b) for a, b, _, _ in got] == [(0, "w"), (1, "u"), (2, ""), (3, "v"), (3, "v")]
    assert [c for _, _, c, _ in got] == [5, 0, 0, len("\n".join(["Some text, of an article."] * 20_000))] + [len("\n".join(["Some text, of an article."] * 20_000))]
    assert n > 0 and got[0][3] == "x & y"


def test_long_chats_and_repeated_events(spark):
    long = "<&x " * 100_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, "assistant", "abc")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.rendered(chat.folded(chat.turn_events(df.withColumn("seq", F.lit(1)))))).collect()}
    assert [t.text for t in got[1].turns] == [long] * 3 and got[1].loss_texts == [long] * 2 and got[2].loss_texts == ["abc"]
    kinds = {r.kind: r["count"] for r in chat.turn_events(df).groupBy("kind").count().collect()}
    assert kinds == {"message": 4, "edit": 1, "regenerate": 3, "delta": 12}


def test_posteriors_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"h{rng.randrange(4)}" if i % 9 else None, f"p{rng.randrange(3)}", min(0.99, max(0.01, rng.random()))) for i in range(300)]
    df = spark.createDataFrame(rows, "host string, path string, p double")
    got = quality.judged(df, F.col("host"), F.col("path"), "p", 0.5).collect()

    def sums(keys):
        out = defaultdict(lambda: [0, 0.0, 0.0])
        for row in rows:
            own = out[keys(row)]
            own[0], own[1], own[2] = own[0] + 1, own[1] + row[2], own[2] + row[2] ** 2
        return out

    def strength(groups):
        n, s = sum(g[0] for g in groups), sum(g[1] for g in groups)
        between_sums = sum(g[1] ** 2 / g[0] for g in groups)
        within = (sum(g[2] for g in groups) - between_sums) / (n - len(groups))
        between = (between_sums - s * s / n - (len(groups) - 1) * within) / (n - sum(g[0] ** 2 for g in groups) / n)
        return min(max(within / between, 5.0), 10_000.0) if between > 0 else 10_000.0

    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    mean = sum(r[2] for r in rows) / len(rows)
    a, b = strength(list(hosts.values())), strength(list(paths.values()))
    odds = lambda x: np.log(x / (1 - x))
    for r in got:
        n, s, _ = hosts[r.host]
        host = (s - r.p + a * mean) / (n - 1 + a)
        n, s, _ = paths[r.host, r.path]
        path = (s - r.p + b * host) / (n - 1 + b)
        want = 1 / (1 + np.exp(-(odds(r.p) + odds(path) - odds(mean))))
        assert (r.p_host, r.p_path, r.p_quality) == pytest.approx((host, path, want))
        assert r.kept == (r.p_quality >= 0.5)


def test_held_out_accuracy_on_the_labels(spark):
    """Fitted on half of the labelled documents, tested on the other half."""
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    train = F.xxhash64(F.lit("half"), "doc_id") % 2 == 0
    df = spark.read.parquet(f"{at}/documents.parquet")
    out = quality.quality(df, labels.where(train)).join(labels.where(~train), F.col("id") == F.col("doc_id")).select("p_quality", "quality", "kept").toPandas()
    rank = out.p_quality.rank()
    good = out.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.99 and (out.kept == good).mean() > 0.99 and out.kept[good].mean() > 0.995


def test_a_sample_of_labels_is_bounded_and_repeatable(spark):
    df = docs(spark, [(i // 2, f"text {i}") for i in range(400)] + [(None, "x")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, 1)], "doc_id long, quality int")
    of = lambda: sorted((r.id, r.y, r.text) for r in quality.labelled(df, labels, sample=50).collect())
    assert len(of()) == 50 and of() == of() and all(t == min(f"text {2 * i}", f"text {2 * i + 1}") for i, _, t in of())
    everything = quality.fit(df, labels, sample=1000)
    assert len(everything.weights) == 2 * quality.FEATURES + 1


def test_ties_at_the_threshold_are_kept(spark):
    df = spark.createDataFrame([("h", "p", 0.5), ("h", "p", 0.5)], "host string, path string, p double")
    assert [r.kept for r in quality.judged(df, F.col("host"), F.col("path"), "p", 0.5).collect()] == [True, True]


def test_quality_learns_and_shrinks(spark):
    rng = random.Random(6)
    good = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(40)) + "."
    bad = lambda: " | ".join(f"w{rng.randrange(500)}!!" for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)] + [(None, None), (900, "")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 600, 2)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = quality.quality(df, labels).collect()
    assert len(out) == len(rows)
    held_out = [r.kept == (r.id % 3 > 0) for r in out if r.id is not None and r.id < 600 and r.id % 2]
    assert sum(held_out) / len(held_out) > 0.95
    assert all(0 < r.p_quality < 1 for r in out)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in out)


def test_mixing_moves_shortages_to_siblings_first(spark):
    rows = [(i, "a " * 10, "en", s) for i, s in enumerate(["s1"] * 10 + ["s2"] * 40 + ["s3"] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    domain = F.when(F.col("source") == "s3", "b").otherwise("a")
    drawn = mixing.mixed_sources(df, domain, {"domain": {"a": 300, "b": 100}}, percent=40, max_epochs=1)
    by = {r.source: r.t for r in drawn.groupBy("source").agg(F.sum("taken_tokens").alias("t")).collect()}
    assert by == {"s1": 100, "s2": 200, "s3": 100}  # s1 gives all it has, its sibling the rest


def test_mixing_repeats_epochs_and_is_seeded(spark):
    rows = [(i, "a b c", "en", "s1") for i in range(20)] + [(i, "a b c", "en", "s2") for i in range(20, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    draw = lambda seed: mixing.mixed_sources(df, F.lit("d"), {"source": {"s1": 900, "s2": 100}}, percent=25, max_epochs=2, seed=seed)
    a = {r.id: r.taken_tokens for r in draw(1).collect()}
    assert sum(a.values()) == 150 and all(a[i] == 6 for i in range(20))
    assert {r.id: r.taken_tokens for r in draw(1).collect()} == a
    assert {r.id for r in draw(2).collect()} != set(a)


def test_mixing_takes_counted_tokens_long_texts_and_repeated_ids(spark):
    rows = [(1, "word " * 200_000), (2, None), (3, ""), (4, "a b")] + [(5, "a b c")] * 3
    df = docs(spark, rows).withColumn("tokens", F.lit(7))
    drawn = {r.id: r.tokens for r in mixing.mixed_sources(df, F.lit("d"), {}, percent=100, max_epochs=1).collect()}
    assert drawn == {1: 200_000, 4: 2, 5: 3}
    counted = mixing.mixed_sources(df, F.lit("d"), {}, percent=50, max_epochs=1, tokens=F.col("tokens")).agg(F.sum("taken_tokens")).first()[0]
    assert 21 <= counted <= 24  # 24 of 49, shares of repeated ids are rounded down
    kept = mixing.keep_drawn(df, F.lit("d"), {}, 50).groupBy("doc_id").count().collect()
    assert all(r["count"] == (3 if r.doc_id == 5 else 1) for r in kept)


def test_mixing_draws_nothing_of_what_is_switched_off(spark):
    rows = [(i, "w " * 10, "en" if i % 2 else "de", f"s{i % 4}", "web" if i % 3 else "bad") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    draw = lambda weights, percent=40: mixing.mixed_sources(df, F.col("domain"), weights, percent=percent, max_epochs=1).collect()
    drawn = draw({"domain": {"web": 100, "bad": 0}})
    assert {r.domain for r in drawn} == {"web"} and sum(r.taken_tokens for r in drawn) == 2400
    assert sum(r.taken_tokens for r in draw({"domain": {"web": 100, "bad": 0}}, 90)) == 4000  # all that may be drawn
    assert draw({"domain": {"web": 0, "bad": 0}}) == []
    # bad has no language left: its share goes to web, though its own weight isn't 0
    drawn = draw({"domain": {"web": 1, "bad": 99}, "source": {"s0": 0, "s1": 0, "s2": 0}})
    assert {r.source for r in drawn} == {"s3"} and sum(r.taken_tokens for r in drawn) == 1500
    kept = mixing.keep_drawn(df, F.col("domain"), {"lang": {"de": 0}}, 30).collect()
    assert {r.lang for r in kept} == {"en"} and 175 <= len(kept) <= 185
    for weights in ({"domain": {"web": -1}}, {"lang": {"en": 1.5}}, {"lang": {"en": 1 << 21}}):
        with pytest.raises(ValueError):
            draw(weights)
    with pytest.raises(Exception, match="negative number of tokens"):
        mixing.mixed_sources(df.withColumn("n", F.lit(-1)), F.col("domain"), {}, tokens=F.col("n")).collect()


def test_children_are_ordered_by_exact_fractions(spark):
    big = 10**17
    rows = [("a", 3 * big + 1, 3), ("b", big, 1), ("c", 7 * big - 1, 7)]
    df = spark.createDataFrame([(n, c, w, 8 * big) for n, c, w in rows], "name string, capacity long, weight long, budget long")
    given = {r["name"]: r["given"] for r in mixing.shared_out(df, [], "name").collect()}
    assert sum(given.values()) <= 8 * big and all(given[n] <= c for n, c, _ in rows) and given == {n: 8 * big * w // 11 for n, _, w in rows}


def test_keep_drawn_keeps_columns(spark):
    df = docs(spark, EDGE + [(100 + i, "x y z") for i in range(200)])
    kept = mixing.keep_drawn(df, F.lit("d"), {}, 50)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()


def test_stored_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    from ledgerfold.llm import scratch

    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    assert scratch.stored(spark.range(3)).count() == 3
    assert list(tmp_path.glob("ledgerfold/*/*/*.parquet"))
    scratch.clear(spark)
    assert not list(tmp_path.glob("ledgerfold/*"))


def test_temporary_tables_go_when_their_work_is_done(spark, tmp_path, monkeypatch):
    from ledgerfold.llm import scratch

    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    with scratch.temporary(spark):
        inner, lasting = scratch.stored(spark.range(3)), scratch.stored(spark.range(4), lasting=True)
        assert inner.count() == 3
    assert lasting.count() == 4 and len(list(tmp_path.glob("ledgerfold/*/*"))) == 1


def test_pipeline_on_odd_rows(spark, tmp_path):
    """All stages against what each should keep, on nulls, empty and very long texts and repeated rows."""
    import corpus_pipeline

    rng = random.Random(5)
    good = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(60)) + "."
    bad = lambda: " | ".join(f"w{rng.randrange(900)}!!#" for _ in range(60))
    texts = [(i, good() if i % 4 else bad()) for i in range(1, 301)]
    near = texts[0][1].split()
    texts += [(400, None), (401, ""), (402, texts[4][1].upper()), (403, " ".join(["changed", *near[1:]])), (404, "long " + good() * 3000), (5, texts[4][1]), (5, texts[4][1])]
    rows = [(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in texts] + [(None, good(), None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(1, 301, 2)] + [(4, 0, 0), (8, 0, 0), (12, 0, 0), (16, 0, 0), (20, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/out{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/out{i}")
        out.append(docs.collect())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    lower = lambda r: (r.text or "").translate(LOWER)
    accepted = quality.quality(spark.createDataFrame(rows, schema), spark.read.parquet(f"file://{tmp_path}/labels.parquet")).where("kept").collect()
    assert sorted(str(r.doc_id) for r in out[0]) == sorted(str(r.id) for r in accepted)
    assert sum(r.doc_id is None or r.doc_id % 4 > 0 or r.doc_id > 300 for r in out[0]) >= len(out[0]) - 2
    groups = defaultdict(list)
    for r in out[0]:
        groups[lower(r)].append(r.doc_id)
    assert sorted(str(r.doc_id) for r in out[1]) == sorted(str(max((i for i in own if i is not None), default=None)) for own in groups.values())
    want = classes([(r.doc_id, r.text) for r in out[1]], 5, 80)
    assert sorted(str(r.doc_id) for r in out[2]) == sorted(str(None if none else i) for (none, i), n, least in want if least == (None if none else i) or n == 0)
    assert {(r.doc_id, r.text) for r in out[3]} <= {(r.doc_id, r.text) for r in out[2]} and 0 < len(out[3]) < len(out[2])
    n_words = lambda found: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in found)
    assert n_words(out[3]) >= 0.79 * n_words(out[2])
    encode = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.public_tokenizer()).encode
    total = {str(r.doc_id): len(encode(r.text or "", add_special_tokens=False).ids) + 1 for r in out[3]}
    packed = defaultdict(int)
    for r in out[4]:
        packed[str(r.doc_id)] += r.length
    assert packed == total
    assert sorted(map(str, corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        map(str, spark.read.parquet(f"file://{tmp_path}/out4").select("doc_id", "start", "length", "ids_crc32").collect())
    )


def test_stages_take_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    names = ["__", "__id", "__sha", "kept", "id", "keep_id", "node", "key", "group_size", "p_text", "domain", "tokens", "epochs", "size", "sequence_id"]
    good = [(i, f"Text number {i} says what there is to say, again and again, in words like {i * 7} and {i * 13}.", "en", f"s{i % 3}", 9, *range(len(names))) for i in range(60)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    spark.createDataFrame([(i, 1 if i % 5 else 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for rows in ([], [*good, good[3], (3, good[3][1], "xx", None, None, *reversed(range(len(names))))]):
        docs = spark.createDataFrame(rows, shape)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/out{len(rows)}-{i}")
            docs = spark.read.parquet(f"file://{tmp_path}/out{len(rows)}-{i}")
            assert (docs.count() > 0) == bool(rows), name
            if i < 4:
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
            if i == 1 and rows:
                (r,) = docs.where("doc_id = 3").collect()  # one of three equal rows, always the same
                assert (r.lang, r.source) == ("en", "s0")


def test_two_threads_keep_their_own_temporary_tables(spark, tmp_path, monkeypatch):
    import threading

    from ledgerfold.llm import scratch

    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    found = {}
    with scratch.temporary(spark):
        mine = scratch.stored(spark.range(3))

        def other():
            with scratch.temporary(spark):
                scratch.stored(spark.range(4))
            found["after"] = mine.count()

        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert found["after"] == 3
