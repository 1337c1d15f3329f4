"""Toxicity, language, main text, URL rules and top-k against plain versions, on held-out rows, and their odd inputs."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawork.llm import html_extract, language_id, topk, toxicity, url_filter
from stratawork.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2


def vocabulary(letters, n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.randint(2, 7))) for _ in range(n)]


WORDS = vocabulary("abcdefghi", 400, 1)
RUDE = ["zugol", "zugolen", "zugolat", "wrak", "snuf"]


@pytest.fixture(scope="module")
def rated(spark):
    """Documents and labels; toxic ones hold a few rude words, also in forms that are seen once."""
    draw = random.Random(3)
    docs, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        words = [draw.choice(WORDS) for _ in range(draw.randint(15, 60))]
        if toxic:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(RUDE) if draw.random() < 0.8 else "zugol" + draw.choice(WORDS)
        docs.append((i, " ".join(words).capitalize() + ".", "en", "s", 0))
        labels.append((i, 0, int(toxic)))
    extra = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "wrak snuf zugol wrak", "en", "s", 0), (7, docs[7][1], "en", "s", 0),
             (1002, "word " * 30_000 + "zugol wrak snuf", "en", "s", 0)]
    frame = spark.createDataFrame(docs + extra, SCHEMA).withColumn("score", F.lit("mine")).withColumn("toxic", F.lit("mine"))
    return frame, spark.createDataFrame(labels + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")


def test_marginals_equal_the_sum_over_all_tag_sequences():
    rng = np.random.default_rng(1)
    score, moves = rng.normal(size=7), rng.normal(size=(2, 2))
    first, length = np.array([3, 0]), np.array([4, 3])
    marginal, pairs = toxicity._marginals(score, first, length, moves, pairs=True)
    expected, moved = np.zeros(7), np.zeros((2, 2))
    for a, n in zip(first, length):
        weights = {}
        for tags in itertools.product((0, 1), repeat=n):
            total = sum(score[a + k] for k in range(n) if tags[k]) + sum(moves[x, y] for x, y in itertools.pairwise(tags))
            weights[tags] = np.exp(total)
        for tags, weight in weights.items():
            share = weight / sum(weights.values())
            expected[a : a + n] += share * np.array(tags)
            for x, y in itertools.pairwise(tags):
                moved[x, y] += share
    assert np.allclose(marginal, expected) and np.allclose(pairs, moved)


def test_toxicity_on_held_out_documents(rated):
    docs, labels = rated
    field = toxicity.train(docs, labels)
    rows = toxicity.scores(docs, field).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    judged = [(r.predicted, r.doc_id % 5 == 0) for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert len(judged) > 100 and np.mean([p == t for p, t in judged]) > 0.95
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].predicted == by_id[1002].predicted == 1 and by_id[1000].score == by_id[1001].score < 0.3
    span = by_id[1002].spans[-1]
    assert ("word " * 30_000 + "zugol wrak snuf")[span.start : span.end] == "zugol wrak snuf"
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.select("doc_id").collect()))) == sorted(str(r.doc_id) for r in rows if not r.predicted)


def test_toxicity_learns_nothing_from_held_out_labels(rated, spark):
    docs, labels = rated
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((str(r.doc_id), r.score) for r in toxicity.scores(docs, toxicity.train(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_without_labels(rated, spark):
    docs, labels = rated
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.train(docs.limit(0), labels) is None
    assert {r.score for r in toxicity.scores(docs, None).collect()} == {0.0}
    assert toxicity.clean_documents(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.scores(docs.limit(0), None).count() == 0


@pytest.fixture(scope="module")
def spoken(spark):
    draw = random.Random(5)
    tongues = {"aa": vocabulary("abcdefg", 300, 11), "bb": vocabulary("fghijkl", 300, 12), "cc": vocabulary("äöüklmn", 300, 13)}
    rows = []
    for i in range(600):
        lang = ["aa", "bb", "cc"][i % 3]
        text = " ".join(draw.choice(tongues[lang]) for _ in range(draw.randint(8, 40)))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang if i % 11 else None, "s", 0))
    rows += [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "12 34 !? ²½", "aa", "s", 0), (None, rows[1][1], None, None, None), (3, rows[3][1], "aa", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("lang_pred", F.lit("x")).withColumn("bucket", F.lit("x"))


def test_language_on_held_out_documents(spoken):
    model = language_id.train(spoken)
    assert model[0] == ["aa", "bb", "cc"] and 0 < (model[2] != 0).mean() < 0.5  # sparse
    rows = language_id.languages(spoken, model).collect()
    assert len(rows) == spoken.count() and all(0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == ["aa", "bb", "cc"][r.doc_id % 3] for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert np.mean(judged) > 0.97
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by_id[900] == by_id[901] == by_id[902] == ("und", 0.0) and by_id[None][0] == "bb"


def test_language_learns_nothing_from_held_out_rows(spoken):
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = spoken.withColumn("lang", F.when(out, "zz").otherwise(F.col("lang")))
    a, b = language_id.train(spoken), language_id.train(turned)
    assert a[0] == b[0] and a[3] == b[3] and np.array_equal(a[2], b[2])


def test_language_without_training_rows(spoken):
    assert language_id.train(spoken.limit(0)) is None and language_id.train(spoken.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in language_id.languages(spoken, None).collect()} == {"und"}


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>{before}<{tag}><h1>{title}</h1>"
    "<p>{a}<br>{b}&amp;<p>{c}</{close}>{after}</body></html>"
)


@pytest.fixture(scope="module")
def trees():
    draw = random.Random(9)
    text = lambda n: " ".join(draw.choice(WORDS) for _ in range(n)).capitalize() + "."
    pages = [
        f"<html><body><nav><ul><li><a href=x>{text(1)}</a></ul></nav><div class=ad>{text(9)}</div><article><h1>{text(5)}</h1>"
        f"<p>{text(30)}</p><p>{text(25)}</p></article><footer>&copy; {text(6)}</footer></body></html>"
        for _ in range(60)
    ]
    return html_extract.fit(pages)


def extracted(trees, source):
    nodes = html_extract.parse([source])
    x, parent, levels = html_extract.features(nodes)
    return html_extract._texts(nodes, html_extract.decoded(html_extract._odds(trees, x), parent, levels), 1)[0]


@pytest.mark.parametrize("tag", ["article", "main", "div id=content", 'div class="post entry"', "section"])
@pytest.mark.parametrize(
    "before,after",
    [
        ("<nav><a href=x>home</a> <a href=y>about</a></nav>", "<footer>&copy; somebody</footer>"),
        ("<header><h1>The site</h1><ul class=menu><li><a href=x>one</a><li><a>two</a></ul></header>", "<div id=footer>bottom words</div>"),
        ("<div class='cookie-notice'><p>We use cookies, as you may know by now.</p></div>", "<aside><p>Something else to read here.</p></aside>"),
        ("<div class=advert>Buy this now.</div>", "<section id=comments><div class=comment><p>What a nice text, thanks for it.</p></div></section>"),
        ("<!-- <p>no</p> --><form class=search><input><label>look for</label></form>", "<div class='sidebar'><h3>More</h3><ul><li><a href=z>other</a></ul></div>"),
    ],
)
def test_main_text(trees, tag, before, after):
    draw = random.Random(10)
    title, a, b, c = (" ".join(draw.choice(WORDS) for _ in range(n)) + "." for n in (5, 30, 10, 40))
    page = PAGE.replace("{before}", before).replace("{after}", after).replace("{tag}", tag).replace("{close}", tag.split()[0])
    page = page.replace("{title}", title).replace("{a}", a).replace("{b}", b).replace("{c}", c)
    assert extracted(trees, page) == f"{title}\n\n{a} {b}&\n\n{c}"


@pytest.mark.parametrize(
    "piece",
    [
        "<video-player src=x>KEPT</video-player>", "<button-group><b>KEPT</b></button-group>", "<svg-icon></svg-icon>KEPT", "<title-bar>KEPT",
        '<svg class="i" viewBox="0 0 1 1"/>KEPT', "<div><button>GONE</div>KEPT<button>GONE</button>", "<div><select><option>GONE</div>KEPT",
        "<a href=x><button>GONE</a>KEPT", "<button>GONE<p>KEPT</p>", "<svg><title>GONE</title><path/></svg>KEPT<p>a <svg>",
        "<svg><svg/><text>GONE</text></svg>KEPT",
        "<button type=x><div>GONE</div><p>GONE</p></button>KEPT", "<select><option>GONE<option>GONE</select>KEPT",
        '<div data-state="' + "{&quot;a&quot;: 1} > " * 900 + '" class="main">KEPT</div>', "<img src='" + "x>" * 9000 + "'>KEPT",
        '<p class="a" b">KEPT</p><p class="c">', "<script>var GONE = '<p>'</script >KEPT", "<title>GONE</title>KEPT", "<textarea></div>GONE</textarea>KEPT",
    ],
)
def test_text_beside_raw_elements_and_long_attributes_is_read(piece):
    nodes = html_extract.parse([f"<body><article><p>before</p>{piece}<p>after</p></article><p>last</p></body>"])
    text = [t.strip() for _, _, t in nodes.pieces if t.strip()]
    assert [t for t in text if t not in ("a", ">")] == ["before", "KEPT", "after", "last"]


def test_a_long_attribute_does_not_lose_its_element():
    long = '<div data-state="' + "x" * 9000 + '" class="sidebar">text</div>'
    assert html_extract.parse([long]).rows[1][3:5] == html_extract.parse([long.replace("x" * 9000, "")]).rows[1][3:5]


def test_decoding_equals_the_best_allowed_choice():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = 8
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        odds = rng.normal(size=n) * 2
        kept = html_extract.decoded(odds, parent, html_extract._by_depth(depth))
        likely = lambda keep: sum(-np.logaddexp(0, -odds[k] if keep[k] else odds[k]) for k in range(1, n))  # noqa: E731,B023
        allowed = [
            (True, *rest) for rest in itertools.product((False, True), repeat=n - 1)
            if all((True, *rest)[parent[k]] or not rest[k - 1] for k in range(1, n))
        ]
        assert likely(kept) == pytest.approx(max(map(likely, allowed)))


def test_pages_of_odd_rows(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "just text &lt;b&gt;"), (3, "u", "<p>one<div>two" + " word" * 60_000), (3, "u", "<<<>< a='\"<p"), (4, "u", "<script>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(5))
    found = html_extract.main_texts(pages, trees).collect()
    assert len(found) == 6 and all(r.n_chars == len(r.text) for r in found)
    texts = {(r.page_id, r.url): r.text for r in found}
    assert texts[1, "u"] == texts[2, None] == texts[4, "u"] == "" and texts[None, "u"] == "just text <b>"
    assert html_extract.main_texts(pages.limit(0), html_extract.train(pages.limit(0))).count() == 0


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule[0], rule[1]


def test_url_rules(spark):
    urls = [
        "http://www.example.com/en/1?x", "https://a.example.com/en/", "http://EXAMPLE.com/en", "http://example.com/de/#/en/", "ftp://x.net/es/1", "http://net/fr/",
        "http://anet/fr/", "http://a.b.c.net/fr", "http://com", "http://com/", "x.com/", "", None, "://", "http://com?/", "http://a..com/", "http://.com/x",
        "http://example.com./en/", "http://b.www.example.com/en/q#f", "http://a.com:80/", "http://Ä.com/", "http://com/a\nb?c", "a://b://net/es/",
    ]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls + urls[:3])], "page_id long, url string").withColumn("rule", F.lit(1))
    rules = spark.createDataFrame(URL_RULES + [(None, "/", "block")], "host string, path string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, rules).collect()}
    assert found == {k: plain_rule(u) for k, u in enumerate(urls + urls[:3])}
    assert url_filter.judged(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judged(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("n_listed,n_others", [(1, 5000), (300, 20_000), (5000, 300), (20, 0)])
def test_cascade_is_exact_over_its_universe(spark, n_listed, n_others):
    listed = spark.range(n_listed).selectExpr("concat('k', id) as key")
    universe = listed.union(spark.range(n_others).selectExpr("concat('o', id) as key"))
    filters = url_filter.build_cascade(listed, universe)
    assert len(filters) < 40
    hashed = url_filter._hashed(universe).toArrow()
    passed = url_filter._passes(filters, hashed.column("h1").to_numpy(), hashed.column("h2").to_numpy())
    assert [k.startswith("k") for k in hashed.column("key").to_pylist()] == (passed % 2 == 1).tolist()


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(600, 8)).astype(np.float32)
    vectors[300:330] = vectors[7]  # ties
    vectors[10] = vectors[20]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [(700, None), (800, [1.0, None] + [0.0] * 6), (900, [float("nan")] * 8), (1000, [float("inf")] * 8), (None, [1.0] * 8), (1100, []), (1201, [2.0, 1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    found = topk.top_k(frame.repartition(5), F.col("vec_id") % 100 == 0, 10)
    usable = {k: np.floor(1024 * np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v)))).astype(int) for k, v in rows + [odd[5], odd[6]]}
    expected = set()
    for q in (k for k in usable if k % 100 == 0):
        best = sorted((-int(usable[q] @ v), k) for k, v in usable.items() if k != q)[:10]
        expected |= {(q, rank, k, -s) for rank, (s, k) in enumerate(best, 1)}
    assert {tuple(r) for r in found.collect()} == expected
    few = topk.top_k(frame.filter("vec_id in (0, 5, 6)"), F.col("vec_id") == 0, 10)
    assert few.count() == 2
    assert topk.top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(frame.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_queries_are_searched_block_by_block(spark, monkeypatch):
    rows = [(k, np.random.default_rng(k).normal(size=4).tolist()) for k in range(80)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 2 == 0, 3).collect()))
    monkeypatch.setattr(topk, "BLOCK", 8)
    assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 2 == 0, 3).collect())) == whole
