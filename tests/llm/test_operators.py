"""Each operator against brute force or its guarantees, and on nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import chat, decontam, fingerprint, htmlcut, mixing, neardup, quality, sharding, textbuf, toxicity, urlfilter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, target int, prefix string, th string"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every awkward trait, and extra columns named like ones the operators use."""
    g = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "rho", "sigma", "tau", "phi", "chi", "psi"]
    text = lambda n: " ".join(g.choice(words) + str(g.randrange(400)) for _ in range(n))
    long = text(60_000)
    base = text(80)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (None, text(30)), (None, None), (5, "!!!"), (6, "???"), (7, long), (8, "x"), (9, "é ü\u00a0漢字 ñ"), (10, text(50)), (11, base.replace("alpha", "ALPHA") + " more")]
    return spark.createDataFrame([(i, t, "en" if i else None, f"s{(i or 0) % 3}" if i != 4 else None, 1, "c", 7, "p", "h") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# text buffers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é_9 -'.\n漢“”", max_size=40), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    raw, off = textbuf.buffer(textbuf.strings(pa.array(texts, pa.string())))
    h, s, e, first = textbuf.words(raw, off)
    b = raw.tobytes()
    got = [[b[s[i] : e[i]].decode() for i in range(first[r], first[r + 1])] for r in range(len(texts))]
    assert got == [re.findall(r"漢|[a-zé_9]+", t) for t in texts]
    by = {}
    for x, y in zip((w for r in got for w in r), h):
        assert by.setdefault(x, y) == y
    assert len(set(by.values())) == len(by)


def test_long_buffer_in_pieces_gives_the_same_words(monkeypatch):
    t = pa.array(["abc " * 5000 + "x" * 9000, "é" * 3000])
    a = textbuf.words(*textbuf.buffer(textbuf.strings(t)))
    monkeypatch.setattr(textbuf, "PIECE", 1024)
    b = textbuf.words(*textbuf.buffer(textbuf.strings(t)))
    assert all((x == y).all() for x, y in zip(a, b))


# 1 decontamination


def _edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_leaks_are_those_of_brute_force(spark):
    g = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    items = [[g.choice(vocab) for _ in range(g.randrange(10, 18))] for _ in range(12)]
    docs = []
    for d in range(60):
        t = [g.choice(vocab) for _ in range(40)]
        if d % 2:
            x = list(items[d % 12])
            for _ in range(g.randrange(0, 5)):
                x[g.randrange(len(x))] = g.choice(vocab)
            t[20:20] = x
        docs.append(t)
    expected = set()
    for d, t in enumerate(docs):
        for i, x in enumerate(items):
            k = int(len(x) * 0.2)
            if any(_edits(x, t[a : a + n]) <= k for n in range(len(x) - k, len(x) + k + 1) for a in range(len(t) - n + 1)):
                expected.add((d, i))
    sd = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id bigint, text string")
    sb = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    assert decontam.LeakIndex(list(range(12)), [" ".join(x) for x in items], decontam.LeakConfig(max_tables=1)).tables == 0
    for cfg in (decontam.LeakConfig(), decontam.LeakConfig(block_bytes=20_000), decontam.LeakConfig(max_tables=1)):
        found = decontam.find_leaks(sd, sb, cfg=cfg).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected
        for r in found:
            assert r.distance == _edits(items[r.item_id], docs[r.doc_id][r.first_word : r.end_word])
    kept = {r.doc_id for r in decontam.decontaminate(sd, sb).collect()}
    assert kept == set(range(60)) - {d for d, _ in expected}


def test_one_long_item_among_short_ones():
    g = random.Random(2)
    texts = [" ".join(f"s{g.randrange(10**6)}" for _ in range(g.randrange(20, 60))) for _ in range(3000)]
    long = [f"l{g.randrange(10**6)}" for _ in range(20_000)]
    tracemalloc.start()
    index = decontam.LeakIndex(list(range(3001)), [*texts, " ".join(long)], decontam.LeakConfig())
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert index.tables and index.recall >= 0.995
    edited = list(long)
    for _ in range(3900):
        edited[g.randrange(len(edited))] = f"e{g.randrange(10**6)}"
    for _ in range(20):
        del edited[g.randrange(len(edited))]
    pad = " ".join(f"p{i}" for i in range(137))
    docs = [f"{pad} {' '.join(edited)} {pad}", f"{pad} {texts[7]} {pad}", pad, " ".join(long[:15_000]), None]
    got = index.search(pa.array(docs))
    assert [(r, o) for r, o, *_ in got] == [(0, 3000), (1, 7)] and got[0][2] <= 3920 and got[0][3:] == (137, 137 + len(edited)) and got[1][2:4] == (0, 137)


def test_short_items(spark):
    d = spark.createDataFrame([(1, "The zyzzyva, the ZYZZYVA!"), (2, "red fox"), (3, "fox red"), (4, "zyzzyvas")], "doc_id int, text string")
    b = spark.createDataFrame([(1, "zyzzyva"), (2, "red fox"), (3, "zyzzyva"), (4, "!?")], "item_id int, text string")
    got = sorted(tuple(r) for r in decontam.find_leaks(d, b).collect())
    assert got == [(1, 1, 0, 1, 1, 2), (1, 3, 0, 1, 1, 2), (2, 2, 0, 2, 0, 2)]
    assert decontam.find_leaks(d, b, cfg=decontam.LeakConfig(min_words=3)).count() == 0


def test_leaks_on_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(1, "omega1 beta2"), (2, None), (3, "")], "item_id int, text string")
    assert decontam.find_leaks(odd, b).count() == 0
    assert decontam.decontaminate(odd, b).count() == odd.count()
    assert decontam.decontaminate(odd, b).columns == odd.columns
    text = odd.where("doc_id = 10").first().text
    b = spark.createDataFrame([("i", " ".join(text.split()[5:30]))] * 2, "item_id string, text string")
    assert sorted((r.doc_id, r.item_id, r.distance, r.first_word) for r in decontam.find_leaks(odd, b).collect()) == [(10, "i", 0, 5)] * 2
    assert decontam.decontaminate(odd, b).count() == odd.count() - 1
    assert decontam.find_leaks(none, b).count() == decontam.decontaminate(none, b).count() == 0
    assert decontam.find_leaks(odd, b.where("false")).count() == 0


# 2 URL filters


def _glob(pattern, text):
    return all(re.fullmatch("(?s)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p), t) for p, t in zip(pattern, text))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab*?.", max_size=7), st.text("/ab*?\n", max_size=9)), min_size=1, max_size=25), st.lists(st.tuples(st.text("ab.\n", max_size=8), st.text("/ab\n", max_size=10)), max_size=12), st.integers(1, 9))
def test_automaton_is_glob_matching(globs, urls, block):
    join = lambda x: urlfilter.SEP.join(p.encode() for p in x)
    data = pa.array([join(u) for u in urls], pa.binary())
    m = urlfilter.Automaton([join(g) for g in globs]).matches(data)
    want = [[_glob(g, u) for g in globs] for u in urls]
    assert m.tolist() == want
    parts = [urlfilter.Automaton([join(g) for g in globs[i : i + block]]) for i in range(0, len(globs), block)]
    assert urlfilter.first_match(parts, data).tolist() == [x.index(True) if any(x) else len(globs) for x in want]


def test_url_rules(spark):
    urls = ["http://EXAMPLE.org/es/1", "https://m.example.org/en/12?x", "https://notexample.org/en/12", "http://a.com/fr/", "http://a.com/de/x", "http://org", "http://x.org?/y", None, "", "no scheme.org/", "x://y://z.com/de/", "http://big-casino.net/", "http://a.net/x.zip", "http://É.ORG/a", "http://a\nb.org/x", "http://x.com/fr/\n" + "a" * 50_000]
    p = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in urlfilter.judge(p).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None, None, None, "org/", "org/", "com/fr/"]
    assert [got[i].verdict for i in range(len(urls))] == ["block", "block", "allow", "allow", "block", "allow", "allow", "block", "block", "block", "allow", "block", "block", "allow", "allow", "allow"]
    assert (got[0].host, got[1].path, got[6].path, got[10].host, got[10].path, got[13].host) == ("example.org", "/en/12", "", "y:", "//z.com/de/", "É.org")
    assert urlfilter.judge(p.where("false")).count() == 0
    many = tuple(urlfilter.Rule("block", f"h{i}.net", "/") for i in range(9000)) + urlfilter.RULES
    assert {r.page_id: r.rule for r in urlfilter.judge(p, rules=many).collect()} == {i: r.rule for i, r in got.items()}


def test_url_rules_are_the_sql_on_odd_urls(spark, same):
    import duckdb
    import pandas as pd

    urls = ["http://a\nb.org/x", "http://\n.com/fr/\n/de/", "x://ads.\nnet/login/", "http://a.net/b\n/cart/\nc", None, "http://a.net/\n.zip"]
    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    c = duckdb.connect()
    c.register("pages", pages)
    same(urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")), c.sql(urlfilter.oracle()))


# 3 HTML

PROSE = "The council met on Monday, and after a long debate it voted for the new bridge over the river. " * 4


def test_minimum_cut_is_least_of_all_labellings():
    g = random.Random(3)
    for _ in range(200):
        n = g.randrange(1, 9)
        x = [g.uniform(-2, 2) for _ in range(n)]
        e = [(g.randrange(n), g.randrange(n), g.uniform(0, 2)) for _ in range(g.randrange(0, 12))]
        cost = lambda lab: sum(max(0, -v) if k else max(0, v) for v, k in zip(x, lab)) + sum(w for a, b, w in e if lab[a] != lab[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(htmlcut.minimum_cut(x, e)) == pytest.approx(best)


def test_the_cut_decides_what_scores_do_not():
    line = "<p>Indeed.</p>"
    page = f"<div id=a7><p>{PROSE}</p>{line}<p>{PROSE}</p>{line}{line}<p>{PROSE}</p></div><div id=b9><div><div>{line}</div></div></div>"
    found = htmlcut.blocks(page)
    score = htmlcut.scores(found, htmlcut.TextModel.default())
    assert all((s > 0) == (len(b[0]) > 50) for s, b in zip(score, found))
    assert htmlcut.minimum_cut(score, htmlcut.edges(found)) == [True] * 6 + [False]
    assert htmlcut.main_text(page) == " ".join([PROSE.strip(), "Indeed.", PROSE.strip(), "Indeed. Indeed.", PROSE.strip()])


def test_flow_on_long_chains():
    g = random.Random(6)
    x = [g.uniform(-0.4, 0.4) for _ in range(30_000)]
    e = [(i, i + 1, 0.5) for i in range(len(x) - 1)]
    got = htmlcut.minimum_cut(x, e)
    # along a chain the best labelling is a shortest path
    low, back = (max(0, x[0]), max(0, -x[0])), []
    for v in x[1:]:
        prev, low = low, []
        step = []
        for k, own in ((0, max(0, v)), (1, max(0, -v))):
            a, b = prev[k], prev[1 - k] + 0.5
            step.append(k if a <= b else 1 - k)
            low.append(min(a, b) + own)
        back.append(step)
    cost = sum(max(0, -v) if k else max(0, v) for v, k in zip(x, got)) + sum(0.5 for a, b in zip(got, got[1:]) if a != b)
    assert cost == pytest.approx(min(low))


def test_classifier_is_drawn_to_its_prior_and_learns(spark):
    cfg = htmlcut.CutConfig()
    none = spark.createDataFrame([(None,), ("",), ("<p>no marks at all</p>",)], "html string")
    for p in (none, none.where("false")):
        assert htmlcut.train(p) == htmlcut.TextModel(cfg.weights, cfg.bias)
    rows = [(f"<nav>Some words that go here, {i} of them.</nav><article><p>{'word ' * 40}{i}</p></article>",) for i in range(60)]
    d = spark.createDataFrame(rows * 2, "html string")
    m = htmlcut.train(d)
    assert m.weights[2] < cfg.weights[2] and m == htmlcut.train(d.repartition(7))
    x, y = np.array([[3.0, 0, 1, 1], [5.5, 0, 0, 0]]), np.array([0.0, 1.0])
    w = htmlcut.fit(x, y, np.array([60.0, 60.0]))
    z, v = np.column_stack([x, [1, 1]]), np.array([*w.weights, w.bias])
    p = 1 / (1 + np.exp(-z @ v))
    assert np.allclose(z.T @ (60.0 * (p - y)) + cfg.strength * 120 * (v - np.array([*cfg.weights, cfg.bias])), 0, atol=1e-3)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><a href=/>Home</a> <a href=/b>News</a></nav><div id="cookie-notice">We use cookies.</div>
<article><header><h1>Big &amp; old</h1></header><p>First  para<b>graph</b>,\nwith words&nbsp;here.<br>And &#233;t&eacute;.<script>x("</p>")</script>
<p>Short.<ul><li>An item of a list, of some length.</ul><form><label>Mail</label><input></form>
<section class="comments"><p>I loved reading this long article, thank you very much!</p></section></article>
<aside class=sidebar><p>Most read stories of the week, all of them here.</p></aside><div class="ad banner">Buy now, it is cheap!</div><footer>&copy; someone</footer></body></html>"""


def test_main_text():
    assert htmlcut.main_text(PAGE) == "Big & old First paragraph, with words here. And été. Short. An item of a list, of some length."
    assert htmlcut.main_text(None) == htmlcut.main_text("") == htmlcut.main_text("<html></html>") == htmlcut.main_text("<nav>a b c</nav>") == ""
    body = "Plain text without any markup at all, but long enough to be a paragraph of prose, is what it says."
    assert htmlcut.main_text(body) == body
    assert len(htmlcut.main_text("<article>" + "<p>word, and more words.</p>" * 3000)) == 3000 * 22 - 1
    deep = "<div>" * 20_000 + f"<p>{PROSE}</p>" + "</div>" * 20_000 + f"<p>{PROSE}</p>"
    assert htmlcut.main_text(deep) == f"{PROSE}{PROSE}".strip()
    assert htmlcut.main_text("<i class=x>" * 20_000 + PROSE + "</b>" * 20_000) == PROSE.strip()
    huge = "word " * 400_000
    assert htmlcut.main_text(f"<article><p>{huge}.</p></article>") == huge + "."


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post type-post tag-politics"><p>{}</p></article>',
        '<div class="site has-sidebar"><article><p>{}</p></article></div>',
        '<div class="overflow-hidden"><article><p>{}</p></article></div>',
        '<div class="overflow-hidden"><div><p>{}</p></div></div>',
        '<main><div class="sidebar-left"><article><p>{}</p></article></div></main>',
        '<div class="layout sidebar-right"><main><p>{}</p></main></div>',
        '<div class="sidebar-left"><article class="post"><p>{}</p></article></div><div class="related-posts"><article><p>Another story, of no matter here.</p></article></div>',
        '<article><p>{}</p></article><ol class="comment-list"><li><article class="comment-body"><p>I loved reading this, thank you!</p></article></li></ol>',
        '<article class="post-12 post hentry tag-politics"><p>{}</p></article>',
        '<div id="page" class="has-sidebar"><p>{}</p></div>',
        '<p><a href="/hidden-valley">{}</a> and so on, as it was said before, at length and with care.</p>',
        '<p data-state="hidden-x" data-hidden=true data-role="navigation">{}</p>',
        '<article><p>{}</p></article><div class="sidebar"><article><p>Most read stories, all of them here.</p></article></div><div id="site-footer">All rights, reserved by us.</div>',
    ],
)
def test_names_do_not_hide_articles(page):
    tail = " and so on, as it was said before, at length and with care." if "and so on" in page else ""
    assert htmlcut.main_text(page.format(PROSE.strip())) == PROSE.strip() + tail


@pytest.mark.parametrize("tag", ['<svg class="i"/>', "<svg/>", '<math display="block" />', "<video-player>", "<select-menu>", '<title-bar class="x">', '<svg class="i"><path d="M0"/></svg>', "<video src=x>no video</video>"])
def test_tags_do_not_swallow_the_page(tag):
    assert htmlcut.main_text(f"<body>{tag}<article><p>{PROSE}</p></article></body>") == PROSE.strip()


def test_pages_all_give_their_article(spark, sf):
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = htmlcut.train(pages)
    got = {r.page_id: r for r in htmlcut.extract(pages, model=model).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?p>|<br>|</?h1>", inner)]
        assert got[p.page_id].text == " ".join(x for x in parts if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_pages_odd(spark):
    p = spark.createDataFrame([(1, "u", None, "t"), (None, None, "", "t"), (1, "u", None, "t")], "page_id bigint, url string, html string, text string")
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in htmlcut.extract(p).collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0)]
    assert htmlcut.extract(p.where("false")).count() == 0


# 4 quality


def test_quality_is_the_formula(spark, odd):
    import pandas as pd

    rng = np.random.RandomState(0)
    m = quality.QualityModel(np.zeros(11), np.ones(11), rng.normal(0, 0.05, 34), 0.3)
    got = quality.assess(odd, m).toPandas()
    d = odd.toPandas()
    d["p"] = 1 / (1 + np.exp(-m.logit(pa.array(d["text"].tolist(), pa.string()))))
    d[["source", "lang"]] = d[["source", "lang"]].fillna("none")
    mu = d.p.mean()

    def strength(k, s, c):
        within, between, n = (k * c * (1 - c)).sum() / k.sum(), (k * (s / k - c) ** 2).sum() / k.sum(), len(k)
        spread = between - within * n / k.sum()
        return min(max(within / spread - 1, 1), 1e6) if spread > 0 else 1e6

    h = d.groupby("source").p.agg(["count", "sum"])
    k1 = strength(h["count"], h["sum"], pd.Series(mu, index=h.index))
    q = d.groupby(["source", "lang"]).p.agg(["count", "sum"]).reset_index().merge(h.add_prefix("h"), left_on="source", right_index=True)
    k2 = strength(q["count"], q["sum"], (q.hsum + k1 * mu) / (q.hcount + k1))
    d = d.merge(q, on=["source", "lang"])
    host = (k1 * mu + d.hsum - d.p) / (k1 + d.hcount - 1)
    path = (k2 * host + d["sum"] - d.p) / (k2 + d["count"] - 1)
    z = np.log(d.p / (1 - d.p)) + np.log(path / (1 - path)) - np.log(mu / (1 - mu))
    assert np.allclose(np.sort(1 / (1 + np.exp(-z))), np.sort(got.score), atol=1e-6)
    assert len(got) == odd.count()


def test_quality_learns_and_odd(spark, sf, odd, none):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels)
    j = quality.assess(docs, m).join(labels, "doc_id").where("quality is not null").toPandas()
    assert (j.keep == (j.quality == 1)).mean() > 0.95
    assert quality.assess(none, m).count() == 0
    assert quality.assess(odd, quality.train(none, labels)).count() == odd.count()


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels, all_labels=False)
    j = quality.assess(docs, m).join(labels, "doc_id").where("quality is not null AND crc32(CAST(doc_id AS STRING)) % 5 = 0").toPandas()
    assert len(j) > 500 and (j.keep == (j.quality == 1)).mean() > 0.97


def test_sites_decide_what_texts_do_not(spark):
    # texts that say little, on a site of good ones and on one of bad ones: the posteriors turn verdicts
    rows = [(s * 1000 + i, "AAaa" if i % 10 == 0 else "AAAA" if s else "aaaa", f"site{s}", "p") for s in (0, 1) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    w = np.zeros(34)
    w[quality.FEATURES.index("upper")] = 4.0
    got = quality.assess(d, quality.QualityModel(np.zeros(11), np.ones(11), w, -1.9)).toPandas()
    faint = got[got.doc_id % 10 == 0]
    assert (faint.evidence > 0).all()  # alone, all of them would be kept
    assert (faint[faint.doc_id >= 1000].keep).all() and not faint[faint.doc_id < 1000].keep.any()


def test_sparse_hosts_shrink(spark):
    rows = [(i, "AAAA" if i % 2 else "aaaa", "big", "x") for i in range(400)] + [(1000, "aaaa", "tiny", "x"), (1001, "aaaa", "tiny", "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    upper = np.zeros(34)
    upper[quality.FEATURES.index("upper")] = 4.0  # log-odds 2 for capitals, -2 else
    got = quality.assess(d, quality.QualityModel(np.zeros(11), np.ones(11), upper, -2.0)).toPandas().set_index("doc_id")
    assert 0.12 < got.path_posterior[1000] < 0.5


# 5 sharding


@pytest.mark.parametrize("limit", [10**9, 60_000, 4_000, 700])
def test_shards_are_those_of_sql(spark, duck, same, sf, limit):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.shard(d, limit)
    same(got.select("doc_id", "shard", "shard_depth", "doc_bytes", "shard_bytes"), duck.sql(sharding.oracle(limit)))
    p = got.toPandas()
    for s, part in p.groupby("shard"):
        assert part.doc_bytes.sum() == part.shard_bytes.iloc[0]
        assert part.doc_bytes.sum() <= limit or len(part) == 1
    leaves = sorted(p.shard.unique())
    assert not any(b.startswith(a) for a, b in zip(leaves, leaves[1:]))


def test_shards_odd(spark, odd, none):
    got = sharding.shard(odd.withColumn("shard", odd.lang), 1000).toPandas()
    assert len(got) == odd.count() and sharding.shard(none, 10).count() == 0
    assert set(odd.columns) < set(got.columns)
    same = spark.range(400).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "repeat('x', 100) AS text")
    p = sharding.shard(same.repartition(3), 1000).toPandas()
    assert len(p) == 400 and p.groupby("shard").doc_bytes.sum().max() <= 1000
    assert (p.groupby("shard").doc_bytes.sum() == p.groupby("shard").shard_bytes.first()).all()
    with pytest.raises(ValueError):
        sharding.shard(odd, 0)


def test_shard_files(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), 2000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()
    sharding.write_shards(odd, str(tmp_path / "o"), 10**9, order=("doc_id", "text"))
    got = [r.doc_id for r in spark.read.parquet(str(tmp_path / "o")).coalesce(1).collect()]
    assert got == sorted(got, key=lambda x: x or 0)


def test_shards_by_a_shuffle_are_the_same(spark, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda: sorted(map(tuple, sharding.shard(d, 3000).select("doc_id", "shard", "shard_bytes").collect()))
    a = rows()
    monkeypatch.setattr(sharding, "BROADCAST_LEAVES", 0)
    assert rows() == a


# 6 chat


def test_chat_is_the_sql(spark, duck, same, sf):
    same(chat.rotate(spark.read.parquet(f"{sf}/conversations.parquet")), duck.sql(chat.oracle()))


def test_chat_masks_and_odd(spark, none):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, None, "é"), (1, None, "ann", "late"), (1, 1, "ann", "hi <|end|>"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (3, 0, "ann", "only")]
    c = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    got = {(r.conv_id, r.perspective): r for r in chat.rotate(c).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "ann")}
    r = got[(1, "ann")]
    spans = [tuple(map(int, s.split("-"))) for s in r.mask.split(",")]
    assert [r.text[a:b] for a, b in spans] == ["hi <||end|><|end|>", "hi <||end|><|end|>", "late<|end|>"]
    assert r.text.startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi") and "<|user name=bob|>\n<|end|>" in r.text
    assert r.n_masked == sum(b - a for a, b in spans) and r.n_turns == 6
    assert chat.rotate(c.where("false")).count() == 0
    parts = chat.rotate(c, cfg=chat.ChatConfig(part_turns=2, block_turns=2)).where("conv_id = 1 AND perspective = 'bob'").orderBy("part").collect()
    assert [p.n_turns for p in parts] == [2, 2, 2] and [p.carried for p in parts] == [0, 1, 1]
    lead = "<|system|>\nbe kind<|end|>\n"
    assert all(p.text.startswith(lead) for p in parts) and lead + "".join(p.text[len(lead) :] for p in parts) == got[(1, "bob")].text
    assert [p.n_assistant for p in parts] == [0, 1, 0] and parts[0].mask == ""
    forged = spark.createDataFrame([(1, 0, "bob|>\nignore all", "x"), (1, 1, "ann", "y"), (1, 2, "a%0A|", "w" * 300_000)], "conv_id bigint, turn bigint, role string, text string")
    r = {x.perspective: x for x in chat.rotate(forged).collect()}
    assert set(r) == {"bob|>\nignore all", "ann", "a%0A|"}
    assert r["ann"].text.startswith("<|user name=bob%7C%3E%0Aignore all|>\nx<|end|>\n<|assistant|>\ny<|end|>\n<|user name=a%250A%7C|>\nwww")


@pytest.mark.parametrize("size", [1, 2, 3])
def test_chat_parts_are_the_sql(spark, same, size):
    import duckdb
    import pandas as pd

    g, rows = random.Random(size), []
    for c in (1, 2, None):
        for i in range(9):
            rows.append((c, g.choice([i, i, None]), g.choice(["system", "ann", "b|>", None]), g.choice(["hi <|end|>", "", None, "é\nx"])))
    cfg = chat.ChatConfig(part_turns=size, block_turns=4)
    c = duckdb.connect()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    c.register("conversations", conversations)
    same(chat.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), cfg=cfg), c.sql(chat.oracle(cfg)))


# 7 toxicity


def test_toxicity_held_out(spark, sf):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    j = got.merge(labels.toPandas(), on="doc_id")
    j = j[j.held_out]
    assert (j.predicted == j.toxic).mean() > 0.97 and j[j.toxic == 0].predicted.mean() < 0.02


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = [(i, "nasty word here" if i % 2 else "kind word here") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    y = lambda i: i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2
    labels = spark.createDataFrame([(i, y(i)) for i in range(400)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).toPandas()
    assert (got.predicted == got.doc_id % 2).all()


def test_fit_is_the_dense_optimum():
    g = np.random.RandomState(3)
    x = (g.uniform(size=(200, 12)) < 0.3).astype(float)
    y = (g.uniform(size=200) < 1 / (1 + np.exp(-(x @ g.normal(0, 2, 12) - 0.5)))).astype(float)
    diff = g.choice([-1.0, 0.0, 0.0, 1.0], size=(30, 12))
    cfg = toxicity.ToxicityConfig(l2=1e-2, swap=0.7, steps=6000)
    (r, c), (sr, sc) = np.nonzero(x), np.nonzero(diff)
    w, b = toxicity.fit_arrays(r, c, y, sr, sc, diff[sr, sc], 30, 12, cfg)
    v = np.zeros(13)
    z = np.column_stack([x, np.ones(200)])
    ridge = np.diag([cfg.l2] * 12 + [0.0])
    ridge[:12, :12] += 2 * cfg.swap / 30 * diff.T @ diff
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ v))
        v -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / 200 + ridge, z.T @ (p - y) / 200 + ridge @ v)
    assert np.allclose(np.append(w, b), v, atol=1e-5)


def test_swapping_terms_evens_scores(spark):
    rows = []
    for i in range(600):
        group = "muslim" if i % 3 == 0 else "christian" if i % 3 == 1 else ""
        toxic = int(i % 3 == 0 and i % 2 == 0 or i % 10 == 0)
        rows.append((i, f"the {group} neighbours met {'vermin' if toxic else 'again'} today {i % 7}", toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    gap = {}
    for swap in (0.0, 50.0):
        m = toxicity.train(docs.drop("toxic"), docs.drop("text"), cfg=toxicity.ToxicityConfig(swap=swap, z=2.0))
        a, b, c = m.score(pa.array(["a muslim family", "a christian family", "vermin"]))
        gap[swap] = abs(math.log(a / (1 - a)) - math.log(b / (1 - b)))
        assert c > 0.5
    assert gap[50.0] < 0.25 * gap[0.0]
    assert toxicity.counterfactuals("Muslim and gay", (("muslim", "jewish"), ("gay", "straight", "queer")), 5) == ["jewish and straight", "muslim and queer"]


def test_terms_come_from_a_table(spark):
    t = spark.createDataFrame([("a", "Poles"), ("a", "danes "), ("b", "lone"), (None, "x"), ("a", "poles"), ("c", None)], "kind string, term string")
    assert toxicity.terms_of(t) == (("danes", "poles"),)
    assert toxicity.counterfactuals("the Poles", toxicity.terms_of(t), 3) == ["the danes"]


def test_toxicity_odd(spark, odd, none):
    assert toxicity.drop_toxic(odd, toxicity.train(odd, spark.createDataFrame([], "doc_id bigint, toxic int"))).count() == odd.count()
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (10, 0), (10, 0), (9, 0)], "doc_id bigint, toxic int")
    for m in (toxicity.train(odd, labels), toxicity.train(none, labels), toxicity.train(odd, labels.where("false"))):
        got = toxicity.score(odd, m).toPandas()
        assert len(got) == odd.count() and got.score.notna().all() and not got[got.doc_id.isna()].held_out.any()
        assert toxicity.score(none, m).count() == 0
        kept = toxicity.drop_toxic(odd, m)
        assert m.weight.any() or kept.count() in (0, odd.count())
        assert kept.columns == odd.columns and kept.count() == int((got.score < 0.5).sum())


# 8 fingerprints


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab c漢😀", max_size=50), max_size=6), st.integers(1, 6), st.integers(1, 7))
def test_winnowing_is_brute_force(texts, k, w):
    cfg = fingerprint.WinnowConfig(k, w)
    cp, off = fingerprint.code_points(texts)
    pos, h = fingerprint.winnow(cp, off, cfg, step=13)
    for i, t in enumerate(texts):
        own = (pos >= off[i]) & (pos < off[i + 1])
        x = cp[off[i] : off[i + 1]]
        grams = fingerprint._grams(x, k).tolist() if len(t) >= k else fingerprint._grams(x, len(t)).tolist() if t else []
        want = set()
        for a in range(max(1, len(grams) - w + 1)) if grams else ():
            part = grams[a : a + w]
            want.add(a + max(j for j, v in enumerate(part) if v == min(part)))
        assert (pos[own] - off[i]).tolist() == sorted(want)
        assert h[own].tolist() == [grams[j] for j in sorted(want)]


def _winnowed(t):
    """Hashes, as they are printed, and positions of the winnowed runs of a text, window by window."""
    cfg = fingerprint.WinnowConfig()
    cp = np.array([ord(c) for c in t], dtype=np.uint32)
    grams = fingerprint._grams(cp, cfg.k if len(t) >= cfg.k else len(t)).tolist() if t else []
    at = set()
    for a in range(max(1, len(grams) - cfg.w + 1)) if grams else ():
        part = grams[a : a + cfg.w]
        low = min(part)
        at.add(a + max(j for j, v in enumerate(part) if v == low))
    return [f"{int(grams[a]):08x}" for a in sorted(at)], sorted(at)


def test_groups_of_fingerprints_grow_without_end(spark):
    cfg = fingerprint.WinnowConfig()
    assert [cfg.groups(x << 20) for x in (0, 20, 8 << 12, 1 << 20, 100 << 20)] == [1, 2, 4096, 4096, 100 << 10]
    d = spark.range(500).selectExpr("CASE WHEN id > 3 THEN id DIV 2 END AS id", "hash(id) % 9 AS th")
    for kind in ("bigint", "string"):
        k = d.selectExpr(f"CAST(id AS {kind}) AS id", "CAST(th AS bigint) AS th")
        order = lambda r: (r[0] is not None, r[0] or 0 if kind == "bigint" else r[0] or "", r[1])
        splits = sorted({tuple(r) for r in k.sample(0.1, 3).collect()} | {(None, 1)}, key=order, reverse=True)
        for s in (splits, splits[:1]):
            for r in k.withColumn("g", fingerprint._group(s, kind, F.struct("id", "th"))).collect():
                assert r.g == sum(order(x) > order((r.id, r.th)) for x in s)


def test_string_ids_with_nulls(spark):
    d = spark.createDataFrame([(None, "b" * 60), ("z", "c" * 70), (None, "b" * 60), ("a", None), ("z", "d" * 40)], "doc_id string, text string")
    got = fingerprint.edited_fingerprints(d, cfg=fingerprint.WinnowConfig(group_bytes=60)).toPandas()
    assert len(got) == 5 and got[got.n_chars == 60].near_next.iloc[0] == 1.0 and got.doc_id.isna().sum() == 2


@pytest.mark.parametrize("size", [300_000, 200])
def test_fingerprints_of_edited_texts(spark, odd, none, size):
    got = fingerprint.edited_fingerprints(odd, cfg=fingerprint.WinnowConfig(group_bytes=size)).toPandas()
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    th = {r.text: r.h for r in odd.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, th[r[1]]), reverse=True)
    want = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        (own, at), (new, new_at), (nxt, _) = _winnowed(t), _winnowed(e), _winnowed(n)
        like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if {*a} | {*b} else 1.0
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(own), "".join(new), round(like(own, new), 12), round(like(own, nxt), 12), at, new_at))
    key = lambda r: (r[0] is None, r)
    columns = zip(got.edited_sha256, got.fingerprint, got.edited_fingerprint, got.near_edited.round(12), got.near_next.round(12), map(list, got.positions), map(list, got.edited_positions))
    assert sorted(((None if i != i else int(i), n, *c) for i, n, c in zip(got.doc_id, got.n_chars, columns)), key=key) == sorted(want, key=key)
    assert fingerprint.edited_fingerprints(none).count() == 0
    one = spark.createDataFrame([(5, "abcdef" * 9)], "doc_id bigint, text string")
    r = fingerprint.edited_fingerprints(one).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(("abcdef" * 9)[:36].encode() + ("abcdef" * 9)[:18].encode()).hexdigest()
    f = fingerprint.fingerprints(odd).toPandas()
    assert len(f) == odd.count() and all(len(a) == len(b) for a, b in zip(f.hashes, f.positions))


# 9 near duplicates


def _weighted_jaccard(a, b, df, n, cfg):
    def vec(t):
        *_, key, r, tf = neardup._vectors(pa.array([t]), cfg)
        return dict(zip(key.tolist(), neardup._weights(key, tf, df, n, cfg)))

    x, y = vec(a), vec(b)
    low = sum(min(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys())
    high = sum(max(x.get(k, 0), y.get(k, 0)) for k in x.keys() | y.keys())
    return low / high if high else 0.0


def test_samples_agree_as_often_as_texts_are_alike():
    cfg = neardup.NearDupConfig(bands=200, rows=4)
    g = random.Random(8)
    a = [f"w{g.randrange(900)}" for _ in range(300)]
    b = [x if g.random() < 0.85 else f"v{g.randrange(900)}" for x in a]
    df, n = np.zeros(1 << cfg.df_bits, dtype=np.int32), 50
    texts = pa.array([" ".join(a), " ".join(b)])
    *_, key, r, tf = neardup._vectors(texts, cfg)
    ids = neardup.Sampler(cfg)(key, r, neardup._weights(key, tf, df, n, cfg), 2, step=100)
    assert (ids == neardup.Sampler(cfg)(key, r, neardup._weights(key, tf, df, n, cfg), 2)).all()
    j = _weighted_jaccard(texts[0].as_py(), texts[1].as_py(), df, n, cfg)
    assert neardup.weighted_jaccard(texts[:1], texts[1:], df, n, cfg)[0] == pytest.approx(j)
    assert (ids[0] == ids[1]).mean() == pytest.approx(j, abs=0.06)


def test_pivot_similarity_is_that_of_pairs():
    cfg, g = neardup.NearDupConfig(), random.Random(3)
    texts = pa.array([" ".join(f"w{g.randrange(30)}" for _ in range(g.randrange(0, 40))) for _ in range(60)] + [None, "", "x"])
    pivot = np.maximum.accumulate(np.where(np.arange(len(texts)) % 7 == 0, np.arange(len(texts)), 0))
    df = g.choices(range(9), k=1 << cfg.df_bits)
    df = np.array(df, dtype=np.int32)
    got = neardup.pivot_similarity(texts, pivot, df, 60, cfg)
    assert got == pytest.approx(neardup.weighted_jaccard(texts, texts.take(pa.array(pivot)), df, 60, cfg))


def test_frequencies_are_counted_over_all_rows(spark, monkeypatch):
    cfg = neardup.NearDupConfig(df_bits=12)
    d = spark.range(300).selectExpr("CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN '' ELSE concat('the cat ', id % 7) END AS text").repartition(7)
    df, n = neardup.shingle_df(d, "text", cfg)
    want = np.zeros(1 << 12, dtype=np.int64)
    for r in d.collect():
        *_, key, _, _ = neardup._vectors(pa.array([r.text], pa.string()), cfg)
        want[neardup._cells(key, cfg)] += 1
    assert n == 240 and (df == want).all()


@pytest.mark.parametrize("star, rest", [(512, 24), (3, 2)])
def test_near_duplicates_are_those_of_brute_force(spark, star, rest, monkeypatch):
    monkeypatch.setattr(neardup, "STAR_ROWS", star)
    cfg = neardup.NearDupConfig(rest=rest)
    g = random.Random(5)
    docs = []
    for c in range(12):
        base = [f"w{g.randrange(500)}" for _ in range(60)]
        for _ in range(c):
            docs.append(" ".join(x if g.random() > 0.06 else f"u{g.randrange(500)}" for x in base))
    docs += [f"lone {i} text of its own {i * 7} {i * 13} words" for i in range(20)] + docs[:6]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {r.id: r for r in neardup.near_duplicates(d, cfg=cfg).collect()}
    df, n = neardup.shingle_df(d, "text", cfg)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i] == docs[j] or _weighted_jaccard(docs[i], docs[j], df, n, cfg) >= cfg.threshold:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert [got[i].class_id for i in range(len(docs))] == [root(i) for i in range(len(docs))]
    size = Counter(root(i) for i in range(len(docs)))
    assert all(got[i].class_size == size[root(i)] and got[i].copies == docs.count(docs[i]) for i in range(len(docs)))
    assert sorted(r.doc_id for r in neardup.keep_one(d, cfg=cfg).collect()) == sorted(size)


def _brute_links(d, docs, cfg):
    df, n = neardup.shingle_df(d, "text", cfg)
    texts = sorted(set(docs))
    linked = Counter()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if _weighted_jaccard(a, b, df, n, cfg) >= cfg.threshold:
                linked.update((a, b))
    return [linked[x] for x in docs]


def _edited(g, base, copies, words):
    return [" ".join(x if i not in at else f"e{g.randrange(10**6)}" for i, x in enumerate(base)) for at in (set(g.sample(range(len(base)), words)) for _ in range(copies))]


@pytest.mark.parametrize("block", [1024, 7])
def test_links_are_those_of_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    cfg, g = neardup.NearDupConfig(), random.Random(8)
    docs = []
    for words, copies in ((2, 40), (3, 30), (4, 20), (0, 1)):
        docs += _edited(g, [f"w{g.randrange(10**6)}" for _ in range(80)], copies, words)
    docs += docs[:5]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {r.id: r for r in neardup.near_duplicates(d, cfg=cfg).collect()}
    want = _brute_links(d, docs, cfg)
    assert [got[i].links for i in range(len(docs))] == want
    assert want[0] == 39 and any(0 < x < 19 for x in want[70:90])


def _plain_group_links(key, w, r, side, limit):
    """Each text laid out over all shingles, the others merged with it entry by entry."""
    n, at = len(side), np.unique(key, return_inverse=True)[1]
    first, total = np.searchsorted(r, np.arange(n + 1)), np.bincount(r, w, n)
    dense, out = np.zeros(at.max() + 1), np.zeros(n, dtype=np.int64)
    for i in range(n):
        own = slice(first[i], first[i + 1])
        dense[at[own]] = w[own]
        low = np.bincount(r, np.minimum(dense[at], w), n)
        dense[at[own]] = 0.0
        meet = (np.arange(n) != i) & (side != side[i] if side.any() else True)
        out[i] = (meet & (total[i] > 0) & (total > 0) & (low >= limit * (total[i] + total - low))).sum()
    return out


@pytest.mark.parametrize("settings", [{}, {"DENSE": 0, "LEVELS": 1, "PAIRS": 1}, {"DENSE": 10**9, "LEVELS": 2, "COLUMNS": 1}, {"DENSE": 4, "LEVELS": 3, "COLUMNS": 7, "PAIRS": 50}])
def test_links_of_a_group_are_those_of_plain_merging(settings, monkeypatch):
    for name, value in settings.items():
        monkeypatch.setattr(neardup, name, value)
    cfg, g = neardup.NearDupConfig(), random.Random(14)
    df = np.zeros(1 << cfg.df_bits, dtype=np.int32)
    for trial in range(60):
        base = [g.choice("abcdefgh"[: g.randint(1, 8)]) for _ in range(g.randint(1, 100))]
        texts = ["" if g.random() < 0.05 else x if g.random() < 0.8 else f"{x} " * g.randint(2, 30) for x in _edited(g, base, g.randint(1, 30), g.randint(0, len(base) // 2))]
        *_, key, r, tf = neardup._vectors(pa.array(texts), cfg)
        if not len(key):
            continue
        w = neardup._weights(key, tf, df, 1000, cfg)
        for side in (np.zeros(len(texts), dtype=int), np.array([g.choice([1, 2]) for _ in texts])):
            assert (neardup._group_links(key, w, r, side, cfg.threshold - 1e-9) == _plain_group_links(key, w, r, side, cfg.threshold - 1e-9)).all(), (trial, texts, side)


def test_links_of_a_large_class_do_not_merge_every_pair(monkeypatch):
    # entries laid out pair by pair are counted: merging each pair of the 1,200 near copies takes 143 million
    cfg, g, merged = neardup.NearDupConfig(), random.Random(15), 0
    texts = _edited(g, [f"w{g.randrange(10**6)}" for _ in range(200)], 1200, 8)
    *_, key, r, tf = neardup._vectors(pa.array(texts), cfg)
    w = neardup._weights(key, tf, np.zeros(1 << cfg.df_bits, dtype=np.int32), 10**6, cfg)

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def minimum(self, a, b):
            nonlocal merged
            merged += np.size(a)
            return np.minimum(a, b)

        def bincount(self, x, *args, **kwargs):
            nonlocal merged
            merged += len(x)
            return np.bincount(x, *args, **kwargs)

    monkeypatch.setattr(neardup, "np", Counted())
    got = neardup._group_links(key, w, r, np.zeros(1200, dtype=int), cfg.threshold - 1e-9)
    assert (got == 1199).all()
    assert merged < 20_000_000, merged


def test_links_do_not_depend_on_unrelated_rows(spark, monkeypatch):
    # equal weights for all shingles: the frequencies of a larger corpus would move similarities as well
    monkeypatch.setattr(neardup, "shingle_df", lambda docs, text, cfg: (np.zeros(1 << cfg.df_bits, dtype=np.int32), docs.count()))
    cfg, g = neardup.NearDupConfig(rest=2), random.Random(9)
    base = [f"w{g.randrange(10**6)}" for _ in range(80)]
    docs = [x for words in (4, 5, 6, 7) for x in _edited(g, base, 15, words)]
    want = _brute_links(spark.createDataFrame([(x,) for x in docs], "text string"), docs, cfg)
    assert any(0 < x < 59 for x in want)
    for more in (0, 4000):
        rows = docs + [f"lone{i} a{i * 7} b{i * 13}" for i in range(more)]
        got = {r.id: r.links for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), cfg=cfg).collect()}
        assert [got[i] for i in range(len(rows))] == want + [0] * more, more


def test_near_duplicates_odd(odd, none):
    got = neardup.near_duplicates(odd)
    assert got.count() == odd.count()
    by = {r.id: r for r in got.collect() if r.id is not None}
    assert by[1].class_id == by[2].class_id == by[11].class_id == 1 and by[1].copies == 3
    assert by[3].class_id == by[4].class_id == 3 and by[5].class_id == 5 and by[6].class_id == 6
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 7, 8, 9, 10]
    assert neardup.near_duplicates(none).count() == neardup.keep_one(none).count() == 0


# 10 mixing


def test_mix_is_the_sql(spark, duck, same, sf):
    same(mixing.mixed_sizes(spark.read.parquet(f"{sf}/documents.parquet")), duck.sql(mixing.oracle()))


def test_mix_in_blocks_is_the_same(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (mixing.mixed_sizes(d, cfg=c).toPandas().sort_values("doc_id").reset_index(drop=True) for c in (mixing.MixConfig(block_rows=1), mixing.MixConfig()))
    assert a.equals(b)
    by = a.merge(d.select("doc_id", "source").toPandas(), on="doc_id").groupby("source", dropna=False)
    assert ((by.taken.sum() - by.target.first()).abs() <= by["size"].max()).all()
    assert (a.taken <= 3 * a["size"]).all() and a.target.notna().all()


def test_positions_invert_the_schedule(spark):
    s = ((0.0, 1.0), (0.3, 3.0), (0.3001, 0.0), (0.6, 0.0), (1.0, 2.0))
    rows = spark.range(101).selectExpr("id / 100 AS u")
    got = rows.select("u", mixing.position(rows["u"], s).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    w = np.interp(grid, [x for x, _ in s], [x for _, x in s])
    area = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2)]
    area /= area[-1]
    for r in got:
        assert np.interp(r.t, grid, area) == pytest.approx(r.u, abs=1e-4)
    with pytest.raises(ValueError):
        mixing.position(rows["u"], ((0.0, 0.0), (1.0, 0.0)))


def test_mix_rows_and_odd(spark, odd, none):
    got = mixing.mixed_sizes(odd).toPandas()
    assert Counter(got["size"]) == Counter(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd.collect())
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() == int(got.passes.sum())
    kept = mixing.mix(odd.withColumn("pass", odd.target), keep=True).toPandas()
    assert list(kept.columns) == [*odd.columns, "position", "pass"] and kept.position.is_monotonic_increasing
    want = sorted(x for i in (1, 2, 3) for x in got[f"position_{i}" if i > 1 else "position"].dropna())
    assert kept.position.round(6).tolist() == want and Counter(kept["pass"]) == Counter(p for n in got.passes for p in range(n))
    nameless = spark.range(2000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('w ', id) AS text", "'s' AS source")
    p = mixing.mixed_sizes(nameless, cfg=mixing.MixConfig(block_rows=100)).toPandas()
    assert p.position.nunique() == 2000 and (p.taken == 2).all() and p.position_2.isna().all()
    assert mixing.mixed_sizes(none).count() == mixing.mix(none).count() == 0
    one = spark.createDataFrame([(1, "a b", "s"), (2, "", "s"), (3, "c", None)], "doc_id bigint, text string, source string")
    t = {r.doc_id: r for r in mixing.mixed_sizes(one).collect()}
    assert (t[1].source_size, t[2].size, t[3].source_size) == (2, 0, 1)
    assert t[1].target == 1.0 and t[3].target == 2.0
