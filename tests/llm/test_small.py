"""The operators without Spark: codes, filters, cuts, trees."""

import random
import time

import numpy as np
import pytest

from ledgerfold.llm import dedup_embedding, dedup_exact, dedup_minhash, html_text, packing, tokens, url_filter


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_golomb_round_trip(n):
    values = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    k, coded = dedup_exact.golomb_encode(values)
    assert (dedup_exact.golomb_decode(len(values), k, coded) == values).all()
    if n == 1000:
        assert len(coded) < 0.9 * values.nbytes


def test_golomb_extremes():
    values = np.array([0, 1, 2**64 - 1], np.uint64)
    k, coded = dedup_exact.golomb_encode(values)
    assert (dedup_exact.golomb_decode(3, k, coded) == values).all()


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    order = dedup_minhash._borrow_order()
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            both = rng.integers(0, 2**63, int(2000 * share)).astype(np.uint64)
            a = np.unique(np.concatenate([both, rng.integers(0, 2**63, int(1000 * (1 - share))).astype(np.uint64)]))
            b = np.unique(np.concatenate([both, rng.integers(0, 2**63, int(1000 * (1 - share))).astype(np.uint64)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            ra, rb = dedup_minhash.registers([a, b], order)
            errors.append(float(dedup_minhash.estimated((ra == rb).sum(), np.array([len(a)]), np.array([len(b)]))[0]) - true)
        assert abs(np.mean(errors)) < 0.03


def test_small_sets_share_a_band():
    order = dedup_minhash._borrow_order()
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 2**63, 5).astype(np.uint64)
        ra, rb = dedup_minhash.registers([np.unique(a), np.unique(a[:4])], order)
        assert (ra.reshape(-1, dedup_minhash.ROWS) == rb.reshape(-1, dedup_minhash.ROWS)).all(axis=1).any()


def test_cascade_is_exact():
    rng = random.Random(1)
    keys = list({f"k{rng.random()}" for _ in range(5000)})
    listed, others = keys[:200], keys[200:]
    asked = []

    def passing(levels, most):
        found = [[k for k, hit in zip(others, level.has(others), strict=True) if hit] for level in levels]
        asked.append(sum(map(len, found)))
        return found if asked[-1] <= most else None

    (first,) = url_filter.first_levels([listed], 40, passing)  # a bound so small that several levels are needed
    cascade = url_filter.build_cascade(listed, *first)
    assert asked[0] > 1400 >= asked[-1] and len(cascade.levels) > 2  # too many passed at first
    assert cascade.has(listed).all() and not cascade.has(others).any()
    (first,) = url_filter.first_levels([[]], 10, passing)
    assert not url_filter.build_cascade([], *first).has(others).any()


def test_chance_collisions_follow_the_sizes():
    order, rng = dedup_minhash._borrow_order(), np.random.default_rng(1)
    for n, m in ((400, 400), (300, 3000), (5000, 4000)):
        equal = []
        for _ in range(150):
            ra, rb = dedup_minhash.registers([np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (n, m)], order)
            equal.append((ra == rb).mean())
        want = dedup_minhash.chance(np.array([n]), np.array([m]))[0]
        assert 0 < want < 1e-3 and abs(np.mean(equal) - want) < 5 * (want / (150 * dedup_minhash.REGISTERS)) ** 0.5


def test_a_tokenizer_that_joins_over_white_space_is_refused(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    joining = tokenizers.Tokenizer(tokenizers.models.BPE())
    joining.pre_tokenizer = tokenizers.pre_tokenizers.Sequence(
        [tokenizers.pre_tokenizers.Split(tokenizers.Regex(r"[.]\s?|\w+|\s"), "isolated"), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    joining.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        tokens.Encoder(str(tmp_path / "t.json"))


@pytest.mark.parametrize(
    "url, want",
    [
        (None, ("", "")),
        ("", ("", "")),
        ("no mark", ("", "")),
        ("http://A.Example.COM", ("a.example.com", "")),
        ("http://É.com/Ä?q#f", ("É.com", "/Ä")),
        ("x://h?a/b", ("h", "")),
        ("x://h#a", ("h", "")),
        ("x:///p", ("", "/p")),
    ],
)
def test_split_url(url, want):
    assert url_filter.split_url(url) == want


def test_cuts_fill_their_slots():
    for total in range(1, 9000, 7):
        lengths = packing.cut(total, 2048)
        assert sum(lengths) == total and all(0 < n <= 2048 for n in lengths)
        for n in lengths:
            slot = 2048 // (2048 // n)
            assert n <= packing.SHORT or slot - n <= packing.PADDING * slot


def test_chunks_encode_like_whole_texts():
    tokenizers = pytest.importorskip("tokenizers")
    path = tokens.public_tokenizer()
    whole = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(2)
    signs = [" ", "\n", "\u00a0", "\u3000", "\u2003", "\x85", "\x1c", "\t", "\r", "a", "é", "è", "à", "Â", "<|endoftext|>", "'s", "1", "!", "世", "😀", "\u200b"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 16)))
        raw = text.encode()
        ids, order, _ = tokens.encoded(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), path)
        assert np.frombuffer(b"".join(ids[j] for j in order.tolist()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
<header><p>Site, name, and, more, commas, than, text</p></header><nav><a href="/">Home</a></nav>
<div id="main"><div class="post"><h1>Head &amp; line</h1><p>One,  two,\n three &lt;b&gt; words.<p>Second <b>bold</b> and <a href="x">link</a>.
<ul><li>item one<li>item two</ul><div style="display: none">hidden</div><!-- <p>comment</p> -->
<blockquote>Quoted, text.</blockquote></div><div class="comments"><p>Reader, says, something, long, here.</p></div></div>
<div class="sidebar-left"><p>Side, bar, text, with, commas.</p></div><form><p>Form</p></form><footer>&copy; foot</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n") == [
        "Head & line",
        "One, two, three <b> words.",
        "Second bold and link.",
        "item one",
        "item two",
        "Quoted, text.",
    ]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p>", "<<>>", "<script>", "<!--", "<a href='", "<p>" * 3000])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html_text.main_text(page), str)


LINES = [f"Line {i}, of the article, which goes on for a while and has some commas, as lines of articles do." for i in range(4)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="wrapper has-sidebar"><div>{BODY}</div><div class="sidebar"><p>Side, bar, text, with, commas.</p></div></div>',
        f'<article class="post no-comments">{BODY}</article>',
        f'<div id="page-with-header"><div class="header"><p>Site, name.</p></div>{BODY}</div>',
        f'<div class="post social">{BODY}</div>',
        f'<article class="post comments">{BODY}</article>',
        f'<p>Short, note, here.</p><div class="content related">{BODY}</div>',
        f'<div class="comments">{BODY}</div>',
        f'<article>{BODY}</article><div class="comments">{"<p>Reader, says, something, long, here, again, and, again.</p>" * 20}</div>',
        f'<div class="post">{BODY}</div><div class="comments">{"<p>Reader, says, something, long, here, again, and, again.</p>" * 20}</div>',
        f'<div class="related"><article><p>Another, page.</p></article></div><div>{BODY}</div>',
        f'<article>{BODY}<div class="ad">{"Buy, this. " * 60}</div></article>',
        f'<div class="ad"><p>{"Buy, this. " * 60}</p></div><article>{BODY}</article>',
    ],
)
def test_a_class_does_not_lose_the_article(page):
    assert [x for x in html_text.main_text(page).split("\n") if x != "Short, note, here."] == LINES


LEAD = "A lead of some eighty characters that opens the article, without being long at all."
LONG_BODY = "".join(f"<p>{i} {'word, ' * 3}{'word ' * 55}</p>" for i in range(10))


@pytest.mark.parametrize(
    "page",
    [
        '<article><div class="lead"><p>{0}</p></div><div class="body">{1}</div><section><p>The end.</p></section></article>',
        '<div><div class="lead"><p>{0}</p></div><div class="body">{1}</div><div><p>The end.</p></div></div>',
        '<article><div><div><p>{0}</p></div></div><div><div>{1}</div></div><div><div>The end.</div></div></article>',
        '<main><div><div><p>{0}</p></div></div><div><div>{1}</div></div><div><div>The end.</div></div></main>',
        '<div><div><p>{0}</p></div></div><div><div>{1}</div></div><div><div><p>The end.</p></div></div>',
    ],
)
def test_a_long_article_keeps_its_short_parts(page):
    lines = html_text.main_text("<body>" + page.format(LEAD, LONG_BODY) + '<div><a href="/">Home</a> <a href="/b">Blog</a></div></body>').split("\n")
    assert (lines[0], lines[-1], len(lines)) == (LEAD, "The end.", 12)


def test_the_neighbours_of_an_article_stay_out():
    page = f'<main><h1>Title</h1><article><div>{LONG_BODY}</div></article><div><p>Another page.</p></div></main><div><p>About us.</p></div>'
    lines = html_text.main_text(page).split("\n")
    assert lines[0] == "Title" and len(lines) == 11


def test_plain_text_is_its_own_article():
    assert html_text.main_text("just  text &eacute;") == "just text é"


@pytest.mark.parametrize(
    "kept, page",
    [
        ("Shares fell, a lot.", f'<article><p class="share-price">Shares fell, a lot.</p>{BODY}</article>'),
        ("A court said so.", f'<article><div class="legal-news"><p>A court said so.</p></div>{BODY}</article>'),
        (None, f'<article><div class="ad-banner"><p>Buy now.</p></div>{BODY}</article>'),
        (None, f'<article><div class="promo-teaser">Buy our book.</div>{BODY}</article>'),
        (None, f'<article>{BODY}<ul class="share-tools"><li><a href="#">Mail</a></li><li><a href="#">Print</a></li></ul></article>'),
    ],
)
def test_part_of_a_name_does_not_drop_a_paragraph(kept, page):
    lines = html_text.main_text(page).split("\n")
    assert [x for x in lines if x not in LINES] == ([kept] if kept else [])
    assert [x for x in lines if x in LINES] == LINES


@pytest.mark.parametrize(
    "piece",
    ["<p", "<div>x", "<p title='x>text ", '<a href="', "<!-- ", "<span hidden>", "<b hidden><i hidden>x", "<script>x</script", "<div class=ad>x", "<div class=share-price><p>text", "<", "<p a=b ", "</div>"],
)
def test_broken_markup_costs_no_more_than_its_length(piece):
    def took(n):
        began = time.process_time()
        html_text.main_text(piece * n)
        return time.process_time() - began

    took(100)
    assert took(40_000) < 12 * took(10_000) + 0.5


def brute_best(page):
    """The best container by plain recursion over the tree."""
    root = html_text._tree(page, True)
    html_text._leave_out_named(list(html_text._walk(root)))

    def blocks(x):
        return [] if x.out else ([x] if x.text else []) + [b for c in x.children for b in blocks(c)]

    def distance(b, x):
        n = b.parent
        if n.parent is not None and (n.tag in ("p", "li", "td", "blockquote", "pre") or n.tag in ("h1", "h2", "h3", "h4", "h5", "h6")):
            n = n.parent
        for d in range(1000):
            if n is x:
                return d
            if n is None:
                return None
            n = n.parent

    def points(x):
        return sum((1 + b.text.count(",") + min(len(b.text) / 100, 3)) / 2**d for b in blocks(x) if (d := distance(b, x)) is not None)

    def score(x):
        n = sum(len(b.text) for b in blocks(x))
        return points(x) * (1 - sum(b.linked for b in blocks(x)) / n) if n else 0.0

    def every(x):
        return [x] + [y for c in x.children for y in every(c)]

    return {id(x): (points(x), score(x)) for x in every(root) if not x.text}, root


def test_scores_match_recursion_over_all_pages():
    pages = pytest.importorskip("pyarrow.parquet").read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    for page in [*pages, PAGE]:
        want, root = brute_best(page or "")
        walk = list(html_text._walk(root))
        html_text._score(walk, [x for x in walk if x.text and not x.out])
        for x in walk:
            if not x.text and not x.out:
                assert x.points == pytest.approx(want[id(x)][0])
                assert (x.points * (1 - x.linked / x.chars) if x.chars else 0.0) == pytest.approx(want[id(x)][1])


def test_cells_hold_ids_only_and_few_rows_at_a_time():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(8)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 64)))
    pivots, vectors, radius = unit(4096), unit(6000), (2 - 2 * 0.95) ** 0.5
    batch = pa.RecordBatch.from_arrays(
        [pa.array([b"%016d" % i for i in range(6000)], pa.binary()), pa.array([64] * 6000, pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([1] * 6000, pa.int64())],
        ["node", "dim", "vec", "weight"],
    )
    tracemalloc.start()
    base, most, sent = pa.total_allocated_bytes(), 0, 0
    for out in dedup_embedding._cells({64: pivots}, radius)(iter([batch])):
        assert out.schema.names == ["cell", "home", "node", "dim", "weight"]
        most, sent = max(most, pa.total_allocated_bytes() - base), sent + out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most + peak < 300e6
    d2 = 2 - 2 * vectors[:1500] @ pivots.T
    home = d2.argmin(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots[home] @ pivots.T))
    goes = (d2 - d2[np.arange(1500), home][:, None] <= 2 * radius * apart + 1e-9) & (np.arange(4096) >= home[:, None])
    found = np.zeros_like(goes)
    first = batch.slice(0, 1500)
    for out in dedup_embedding._cells({64: pivots}, radius)(iter([first])):
        at = [int(x) for x in out.column(2).to_pylist()]
        found[at, np.asarray(out.column(0))] = True
    assert (found == goes).all() and sent > 4 * goes.sum() * 0.9


SAID = [f"Sentence number {n} of the article goes on for a while, with commas, and says what there is to say about it at length." for n in range(5)]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in SAID)
TEXT = "\n".join(SAID)
LINKS = "<ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul>"
OWN_HEADER = "<header><h1>Title</h1><p>A lead of some words.</p></header>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><form id=aspnetForm><div class=content><h1>Head</h1>{PARAGRAPHS}</div></form>", f"Head\n{TEXT}"),
        (f"<body><form id=aspnetForm><input name=q><nav>{LINKS}</nav><div class=content><h1>Head</h1>{PARAGRAPHS}</div><footer><p>{SAID[0]}</p></footer></form>", f"Head\n{TEXT}"),
        (f"<body><form><h1>Head</h1>{PARAGRAPHS}<div>{LINKS}</div>Search:<button>Go</button></form>", f"Head\n{TEXT}"),
        (f"<body><nav>{LINKS}<div id=main><article>{PARAGRAPHS}</article></div>", TEXT),
        (f"<body><nav>{LINKS}<main>{PARAGRAPHS}</main><footer>Imprint</footer>", TEXT),
        (f"<body><header><a href=/>Home</a><div id=main><article>{PARAGRAPHS}</article></div>", TEXT),
        (f"<body><header><a href=/>Home</a>{LINKS}<h1>Head</h1>{PARAGRAPHS}", f"Head\n{TEXT}"),
        (f"<body><aside>{LINKS}<div>{PARAGRAPHS}</div>", TEXT),
        (f"<body><article>{OWN_HEADER}{PARAGRAPHS}</article>", f"Title\nA lead of some words.\n{TEXT}"),
        (f"<body><main>{OWN_HEADER}<article>{PARAGRAPHS}</article></main>", f"Title\nA lead of some words.\n{TEXT}"),
        (f"<body><header><h1>Site</h1></header><article>{PARAGRAPHS}</article>", TEXT),
        (f"<body><article><header>{LINKS}</header>{PARAGRAPHS}</article>", TEXT),
        (f"<body><article>{PARAGRAPHS}</article><div class=user-reviews>{PARAGRAPHS * 2}</div>", TEXT),
        (f"<body><div class=post>{PARAGRAPHS}</div><section id=customer_feedback>{PARAGRAPHS}</section>", TEXT),
        (f"<body><div class=review>{PARAGRAPHS}</div>", TEXT),
        (f"<body><article>{PARAGRAPHS}</article><aside><p>{SAID[0]}</p></aside><form><p>{SAID[1]}</p><input></form>", TEXT),
        (f"<body><form hidden>{PARAGRAPHS}</form><p>{SAID[0]}</p>", SAID[0]),
        (f"<body><nav>{LINKS}</nav><footer><p>{SAID[0]}</p></footer>", ""),
        (f"<body><header><p>{SAID[0]}</p></header><aside><p>{SAID[1]}</p></aside>", SAID[0]),
        (f"<body><form><header>{LINKS}<div><article>{OWN_HEADER}{PARAGRAPHS}</article></div></form>", f"Title\nA lead of some words.\n{TEXT}"),
    ],
)
def test_pages_whose_article_stands_in_forms_menus_and_headers(page, text):
    assert html_text.main_text(page) == text


def test_cuts_don_t_depend_on_ranges(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["a", "b ", " ", "\n", "é", "\u2003", "\u00a0", " c", "中 "]) for _ in range(3000))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = tokens._cuts(data).tolist()
    for size in (1, 2, 3, 7, 1000, len(data)):
        monkeypatch.setattr(tokens, "STEP_BYTES", size)
        assert [c for part in tokens.safe_cuts(data) for c in part.tolist()] == whole
    assert len(whole) > 100
