import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from crestline.llm import decontamination, html_text, quality_classifier, toxicity
from crestline.llm.common import fold
from pyspark.sql import functions as F

from .conftest import TEXT, prose


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(4)
    insults = "idiot moron scum clown".split()
    data = []
    for i in range(600):
        words = prose(i % 150 + 1000, 60 + i % 40).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        if i % 3 == 0:
            words = [w.upper() + "!!" for w in words]
        data.append((i, " ".join(words), int(bad), int(i % 3 != 0)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in data], TEXT).repartition(3)
    return data, docs, spark.createDataFrame([(i, q, x) for i, _, x, q in data] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(marked, docs, empty, spark):
    data, texts, labels = marked
    model = toxicity.train(texts.where(fold(F.col("doc_id"), 4) != 2), labels)
    import zlib

    held = {i: x for i, _, x, _ in data if zlib.crc32(str(i).encode()) % 4 == 2}
    got = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    ids = sorted(held)
    assert auc(np.array([got[i] for i in ids]), np.array([held[i] for i in ids])) > 0.97
    kept = {r.doc_id for r in toxicity.reject(texts, model).collect()}
    assert sum(i in kept for i, _, x, _ in data if x) <= 6 and sum(i not in kept for i, _, x, _ in data if not x) <= 6
    scores = [r.score for r in toxicity.score(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.reject(docs, model).schema == docs.schema
    assert toxicity.score(empty, model).collect() == []
    none = toxicity.train(texts, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(texts, none).collect()} == {0.0}


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    knots, level = toxicity.isotonic(raw, (rng.random(500) < 1 / (1 + np.exp(-2 * raw))).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(level) >= 0).all() and (0 <= level).all() and (level <= 1).all()


def test_quality(marked, docs, empty, spark):
    data, texts, labels = marked
    model = quality_classifier.train(texts.where(fold(F.col("doc_id"), 5) != 0), labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(texts, model).collect()}
    assert auc(np.array([got[i] for i, *_ in data]), np.array([q for *_, q in data])) > 0.99
    scores = [r.score for r in quality_classifier.score(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality_classifier.score(empty, model).collect() == []
    one = quality_classifier.train(texts, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.99 for r in quality_classifier.score(texts, one).collect())


def test_buckets_in_parts(monkeypatch):
    text = prose(8, 3000)
    whole = Counter(np.concatenate(list(quality_classifier.buckets(text))).tolist())
    monkeypatch.setattr(quality_classifier, "CHUNK", 4096)
    parts = Counter(np.concatenate(list(quality_classifier.buckets(text))).tolist())
    assert sum((whole - parts).values()) + sum((parts - whole).values()) < 30  # words at a cut


def brute_distance(item, text):
    best = list(range(len(text) + 1))
    best = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(best[j - 1] + (a != b), best[j] + 1, new[j - 1] + 1))
        best = new
    return min(best)


def test_leaks(spark, docs, empty):
    rng = random.Random(2)
    items = [(k, prose(500 + k, rng.randint(6, 60))) for k in range(30)] + [(90, None), (91, ""), (92, "one two")]
    pool = prose(1, 4000, 3000).split()
    texts, truth = [], set()
    for i in range(120):
        k, item = items[rng.randrange(30)]
        words = item.split()
        for _ in range(rng.randint(0, len(words) // 3)):
            words[rng.randrange(len(words))] = rng.choice(pool)
        texts.append((i, " ".join([*rng.choices(pool, k=30), *words, *rng.choices(pool, k=rng.randint(0, 30))]).upper() + "."))
    for i, text in texts:
        for k, item in items[:30]:
            own = item.split()
            if brute_distance(own, text.lower().strip(".").split()) <= decontamination.allowed(len(own)):
                truth.add((i, k))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], TEXT).repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (5000, 7):
        found = {(r.doc_id, r.item_id) for r in decontamination.leaks(df, benchmark, block).collect()}
        assert found <= truth and len(found) >= 0.97 * len(truth)
    kept = {r.doc_id for r in decontamination.decontaminate(df, benchmark, 7).collect()}
    assert kept == {i for i, _ in texts} - {i for i, _ in found}
    assert decontamination.decontaminate(docs, benchmark).schema == docs.schema
    assert decontamination.decontaminate(docs, benchmark).count() == docs.count()
    assert decontamination.leaks(empty, benchmark).collect() == []
    assert decontamination.leaks(df, benchmark.limit(0)).collect() == []


def test_null_item_id(spark):
    item = prose(41, 20)
    df = spark.createDataFrame([(1, item, "en", "s", 1), (2, prose(42, 20), "en", "s", 1)], TEXT)
    benchmark = spark.createDataFrame([(None, item), (5, prose(43, 20))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.leaks(df, benchmark).collect()] == [(1, None)]
    assert [r.doc_id for r in decontamination.decontaminate(df, benchmark).collect()] == [2]


def test_long_items():
    """Passages at the allowed distance from items of 100 to 500 words, all of whose edits are of one kind."""
    rng = random.Random(12)
    pool = prose(1, 4000, 3000).split()
    items, texts = [], []
    for k, n in enumerate([100] * 12 + [200] * 10 + [300] * 8 + [500] * 8):
        own = prose(700 + k, n, 3000).split()
        words = list(own)
        for at in sorted(rng.sample(range(n), decontamination.allowed(n)), reverse=True):
            words[at : at + 1] = [] if k % 2 else [rng.choice(pool)]
        items.append((k, " ".join(own)))
        texts.append(" ".join([*rng.choices(pool, k=30), *words, *rng.choices(pool, k=30)]))
    found = {(t, i) for t, i, *_ in decontamination.Items(items).search(texts)}
    truth = {
        (t, i) for t, text in enumerate(texts) for i, item in items
        if t == i and brute_distance(item.split(), text.split()) <= decontamination.allowed(len(item.split()))
    }
    assert len(truth) == len(items) and found == truth


def test_alignment():
    rng = np.random.default_rng(5)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        distance, start, stop = decontamination.align(item, text)
        assert distance == brute_distance(list(item), list(text))
        assert 0 <= start <= stop <= len(text)


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>menu</a></nav><div class="ad">Buy now, a long advert text without markup</div>
<article><h1>Head &amp; tail</h1><p>{long}<p>Short.<ul><li>a<li>b</ul><script>var x="</p>"</script><p>x<b>y</b>z<br>end</p></article>
<div id="comments"><p>{long}</p></div><form><p>sign up</p></form><footer>&copy; f</footer></body></html>"""


def test_main_text():
    long = prose(1, 200)
    assert html_text.main_text(PAGE.format(long=long)) == f"Head & tail {long} Short. a b xyz end"
    cases = {None: "", "": "", "plain  text": "plain text", "<p>Hello<p>World</": "Hello World", "a < b <b": "a < b", "<script>x": "", "<div>a</div>": "a"}
    assert {k: html_text.main_text(k) for k in cases} == cases


@pytest.mark.parametrize(
    "second",
    [
        "<div class=part2><p>{0}</p><p>{0}</p></div>",
        "<ul>" + "".join(f"<li>item {k} of a list</li>" for k in range(40)) + "</ul>",
        "<table>" + "".join(f"<tr><td>{k}</td><td>cell {k}</td></tr>" for k in range(40)) + "</table>",
        "<div><p>A short one.</p><p>Two.</p><h2>Three</h2></div>",
    ],
)
def test_second_block(second):
    """Without article or main, a second block stays, whatever its ratio; a menu outside the text does not."""
    first = f"<div class=part1><p>{prose(2, 300)}</p><p>{prose(3, 300)}</p></div>"
    menu = "<div><a href=/a>Home</a><a href=/b>News</a><a href=/c>Shop</a></div>"
    second = second.format(prose(4, 90))
    plain = lambda html: " ".join(re.sub("<[^>]*>", " ", html).split())
    for body in (f"<div>{first}{second}</div>", f"<div>{second}{first}</div>", first + second, f"<div>{first}</div>{second}"):
        assert html_text.main_text(f"<body>{menu}{body}{menu}</body>") == plain(body)


def test_several_articles():
    texts = [prose(20 + k, n) for k, n in enumerate((400, 30, 60))]
    page = "<div><a href=/a>Home</a></div><div>" + "".join(f"<article><p>{t}</p><p>Short.</p></article>" for t in texts) + "</div>"
    assert html_text.main_text(page) == " ".join(f"{t} Short." for t in texts)
    page = f"<article><p>{texts[1]}</p></article><div><p>{texts[0]}</p></div><p>{texts[2]}</p>"
    assert html_text.main_text(page) == f"{texts[1]} {texts[0]} {texts[2]}"


def test_names_that_hide():
    """A class or id of html, body, main, article or of what holds most of the text hides nothing; a small one does."""
    long, other = prose(31, 200), prose(32, 200)
    text, share = f"<p>{long}</p><p>{other}</p>", '<div class="share">Share this with all of your friends</div>'
    whole = f"{long} {other}"
    for page in (
        f'<html id="header"><body class="has-sidebar">{text}{share}</body></html>',
        f'<body class="sidebar-left menu"><div>{text}</div>{share}</body>',
        f'<div class="content no-sidebar">{text}{share}</div>',
        f'<div class="page-header widget">{share}<div>{text}</div></div>',
        f'<main id="related"><div class="header">{text}</div>{share}</main>',
        f'<article class="post related">{text}{share}</article><div id="comments">{text * 3}</div>',
        f'<div><div class="x-widget"><p>{long}</p></div><div class="x-widget"><p>{other}</p></div></div>',
        f'<article class="ad"><p>Few words</p></article>{share}<div class="comments">{text}</div>',
    ):
        assert html_text.main_text(page) == ("Few words" if "Few" in page else whole)


def test_reader_comments_go():
    """By any usual name, however much of the page they are, nested in the article or beside it."""
    article, talk = prose(41, 60), prose(42, 400)
    for comments in (
        f'<div class="comment"><p>{talk}</p></div>',
        f'<div class="user-comments"><p>{talk}</p></div>',
        f'<section id="commentList"><p>{talk}</p></section>',
        f'<article class="comment"><p>{talk}</p></article>' * 2,
        f'<div class="commentsSection"><article class="comment"><p>{talk}</p></article></div>',
    ):
        for page in (f"<article><p>{article}</p>{comments}</article>", f"<article><p>{article}</p></article>{comments}", f"<div><p>{article}</p></div>{comments}"):
            if "<article><p>" in page or "<article" not in page:
                assert html_text.main_text(page) == article, page[:200]
    assert html_text.main_text(f'<article class="comment"><p>{article}</p></article>') == article
    for name in ("siteFooter", "adbox", "shareWidget", "mainNav"):
        assert html_text.main_text(f'<article><p>{article}</p><div class="{name}">Some words of furniture here</div></article>') == article


def test_malformed_declarations_and_deep_pages():
    cases = {"<![foo[x]]>a": "a", "<p>b<![ >c": "bc", "<![CDATA[x]]><p>d": "d", "<!x><![if y]>e<![endif]>": "e", "<![": "", "f<![foo": "f"}
    assert {k: html_text.main_text(k) for k in cases} == cases
    count = 50_000
    for unit in ("<div>t", "<div>t</foo{0}>", '<div class="ad">t', "<center>t<p>", "<div>t</div></span>", "<b class=ad><td>t"):
        began = time.perf_counter()
        assert "t" in html_text.main_text("<div>text " * 2 + "".join(unit.format(k % 999) for k in range(count)))
        assert time.perf_counter() - began < 20, unit


def by_plain_rules(ratios):
    """Smoothing and the two-cluster threshold of ``content_lines``, number by number."""
    reach = int(3 * html_text.SIGMA)
    smooth = []
    for i in range(len(ratios)):
        near = [(math.exp(-0.5 * (k / html_text.SIGMA) ** 2), ratios[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(ratios)]
        smooth.append(math.log1p(sum(w * r for w, r in near) / sum(w for w, _ in near)))
    level = sorted(smooth)
    if len(level) < 3 or level[-1] - level[0] < 0.5:
        return [True] * len(ratios)
    spread = lambda k: k * (len(level) - k) * (sum(level[:k]) / k - sum(level[k:]) / (len(level) - k)) ** 2
    cut = max(range(1, len(level)), key=lambda k: (spread(k), -k))
    return [x > (level[cut - 1] + level[cut]) / 2 for x in smooth]


def test_clusters_against_plain_rules():
    rng = np.random.default_rng(6)
    for _ in range(60):
        lines = [html_text.Line("x" * int(rng.integers(1, 10 ** int(rng.integers(1, 4)))), int(rng.integers(0, 9)), 0) for _ in range(int(rng.integers(1, 40)))]
        assert html_text.content_lines(lines).tolist() == by_plain_rules([len(x.text) / (1 + x.tags) for x in lines])


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>", 3), (1, "u", "<p>a b</p>", 3), (2, None, None, 3), (3, "v", "<p>" + "w " * 50_000, 3)], "page_id long, url string, html string, text int")
    got = Counter((r.page_id, r.url, r.n_chars) for r in html_text.extract(df).collect())
    assert got == Counter({(1, "u", 3): 2, (2, None, 0): 1, (3, "v", 99_999): 1})
    assert html_text.extract(df.limit(0)).collect() == []
