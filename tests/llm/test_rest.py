"""URL lists, main text, quality rules, mixing, and the queries with SQL twins."""

import datetime
import random
import re
from collections import Counter

import oracle
import pytest
from pyspark.sql import functions as F

from tidesignal.llm import html, mixing, rules, urlfilter
from tidesignal.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    oracle.assert_same(QUERIES[name](spark, small).toPandas(), oracle.connect(small).execute(ORACLES[name]).df())


def test_main_text_keeps_the_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
    <header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="cookie-banner">We use cookies</div>
    <article><h1>A &amp; B</h1><p>First   paragraph&nbsp;here with <b>bold</b> words.</p><p>caf&eacute; &#x41;</p></article>
    <aside>Most read</aside><div id="comments"><p>Nice!</p></div><form>Subscribe</form><footer>Imprint</footer></body></html>"""
    assert html.main_text(page) == "A & B\n\nFirst paragraph here with bold words.\n\ncafé A"


def test_main_text_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<div></div>"), (5, "u", "<article><p>" + "word " * 50_000), (5, "u", "a < b")], "page_id long, url string, html string")
    got = html.extract(pages.withColumn("text", pages["url"])).collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got] and len(got) == 6
    assert [r["text"] for r in got[:4]] == [""] * 4 and got[4]["text"] == ("word " * 50_000).strip()
    assert html.extract(pages.limit(0)).count() == 0


TEXT = "News\n\nThe bridge opens on Monday after ten years of work."
PLAIN = "<h1>News</h1><p>The bridge opens on Monday after ten years of work.</p>"
ARTICLE = f"<article>{PLAIN}</article>"


@pytest.mark.parametrize("page", [
    f"<html><head><title>T x</title></head><body>{PLAIN}</body></html>",
    f"<html><head><title>T x</title>{PLAIN}",
    f"<table><tr><td>{PLAIN}</td></tr></table>",
    f'<ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul><div class="c7">{PLAIN}</div><div class="footer">Imprint</div>',
    f'{PLAIN}<section id="comments"><article>Nice, and more words than the text itself has, many many many many more of them than that.</article></section>',
])
def test_main_text_in_plain_containers(page):
    assert html.WEIGHTS["w:page"] > 0 and html.WEIGHTS["l:page"] > 0
    assert html.main_text(page) == TEXT and html.main_text("a < b") == "a < b"


@pytest.mark.parametrize("page", [
    f'<nav><a href="/">Home</a>{ARTICLE}<footer>Imprint</footer>',
    f"<aside>Most read{ARTICLE}",
    f'<div class="ad">Buy now{ARTICLE}',
    f'<div id="w"><div class="ad">Buy now{ARTICLE}</div><div class="footer">Imprint</div>',
    f"<button>Go{ARTICLE}",
    f'<div class="no-sidebar">{ARTICLE}</div>',
    f'<div class="has-sidebar"><main>{PLAIN}</main><aside>Most read here</aside></div>',
    f"{ARTICLE}<aside><article>Teaser of another story</article></aside>",
])
def test_main_text_of_an_article_within_another_kind(page):
    assert html.main_text(page) == TEXT


@pytest.mark.parametrize("page", [
    f'<div class="content-with-sidebar">{ARTICLE}</div>', f'<div class="has-search">{ARTICLE}</div>', f'<div id="page-header-less">{ARTICLE}</div>',
    f'<div class="layout-sidebar">{PLAIN}</div>', f"<div class='article-comments-wrapper'>{PLAIN}</div>",
])
def test_main_text_within_wrappers_named_after_other_parts(page):
    assert html.main_text(page) == TEXT


def test_main_text_of_broken_tags():
    menu = '<nav><a href="/">Home</a> and a long menu of words that goes on and on for a good while longer than that</nav>'
    assert html.main_text(f"<article>one two three</article>{menu}<article>four five six</article>") == "one two three\n\nfour five six"
    assert html.main_text('<p class="x>Hello world text</p><p class="y">More text here</p>') == "Hello world text\n\nMore text here"
    assert html.main_text("<p>for all a<b holds the rest.</p>") == "for all a<b holds the rest." and html.main_text("a<b holds the rest") == "a<b holds the rest"
    assert html.main_text('<p title="a > b">Text here</p><p title=don\'t>and there</p>') == "Text here\n\nand there"
    assert html.main_text('<div class="sidebar"><p>Only a menu</p></div>') == ""


def made_page(r, layout):
    """A page in a markup that no labelled page has, and its article."""
    say = lambda n: " ".join("".join(r.choice("abdegilmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(n))
    links = lambda n, tag: "".join(f'<{tag}><a href="/{k}">{say(r.randrange(1, 4))}</a></{tag}>' for k in range(n))
    title, parts = say(5), [say(r.randrange(12, 60)) for _ in range(r.randrange(2, 8))]
    good = "\n\n".join([title, *parts])
    if layout == 0:
        page = f"<body><table><tr><td>{links(8, 'div')}</td><td><h2>{title}</h2>{''.join(f'<p>{x}' for x in parts)}</td></tr></table><center>{links(3, 'span')}</center>"
    elif layout == 1:
        page = f"<div id=wrap><ul>{links(9, 'li')}</ul><div class=a1><h1>{title}</h1>{''.join(f'<div>{x}</div>' for x in parts)}</div><ul>{links(6, 'li')}</ul></div>"
    elif layout == 2:
        page = f"<div>{links(7, 'span')}</div><h1>{title}</h1>{''.join(f'<p>{x}</p>' for x in parts)}<div id=disqus_thread class=comments><p>{say(30)}</p></div><div class='site-footer'>{say(8)}</div>"
    else:
        page = f"<div class=wrapper><div class='top-nav'>{links(5, 'b')}</div><section><h1>{title}</h1>{''.join(f'<section><p>{x}</p></section>' for x in parts)}</section><div class='sponsored'>{say(15)}</div></div>"
    return page, good


def f1(got, good):
    a, b = Counter(got.split()), Counter(good.split())
    same = sum((a & b).values())
    return 2 * same / max(1, sum(a.values()) + sum(b.values()))


def test_main_text_of_held_out_layouts_needs_the_scan(monkeypatch):
    r = random.Random(8)
    pages = [made_page(r, k % 4) for k in range(80)]
    scores = [f1(html.main_text(p), good) for p, good in pages]
    assert sum(scores) / len(scores) >= 0.97 and min(scores) >= 0.8, (sum(scores) / len(scores), min(scores))
    flat = {k: v if v > 0 else -1e-12 for k, v in html.WEIGHTS.items()}  # any run of words of a good kind, nothing weighed
    without = [f1(html.main_text(p, flat), good) for p, good in pages]
    assert sum(scores) > sum(without) + 2, (sum(scores), sum(without))


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    inside = {j for k, g in enumerate(grams) if n[g] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_rules_equal_brute_force(make_docs):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 2, 3, 30, 200]))) for _ in range(40)]
    texts += [None, "", "\n \n", "a\nb\na\n\nb", "# é 日本 <x> 💚", "a a a a", "a b c a b c a b", "x " * 40_000, "l\x0b\x0cm\r\nl"]
    got = {x["doc_id"]: tuple(x)[1:6] for x in rules.apply_rules(make_docs(texts)).collect()}
    assert got == {k: base(t) for k, t in enumerate(texts)}


def test_hosts_with_many_failures_are_rejected(make_docs):
    r = random.Random(5)
    good = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    rows = [(k, good(), "fine") for k in range(200)] + [(1000 + k, good() if k < 20 else "short", "bad") for k in range(200)] + [(5000, "short", "tiny"), (5001, good(), "tiny"), (6000, good(), None)]
    got = {x["doc_id"]: x["kept"] for x in rules.apply_rules(make_docs(rows)).collect()}
    assert all(got[k] for k in range(200)) and not any(got[1000 + k] for k in range(200)) and not got[5000]
    assert rules.apply_rules(make_docs([])).count() == 0


def judge(url, day, entries):
    u = (url or "").strip().lower()
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", u)
    host = m[1].rstrip(".") if m else ""
    if not host:
        return "invalid"
    seg = re.match(r"[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)", u)
    rank = {"clear": 1, "block": 2, "allow": 3}
    state = {}
    for lst, pat, act, d in sorted((e for e in entries if e[3] <= day), key=lambda e: (e[3], rank[e[2]])):
        state[lst, pat] = act
    on = {a for (_, p), a in state.items() if host == p or host.endswith("." + p) or seg and p == f"{host}/{seg[1]}"}
    return "allowed" if "allow" in on else "blocked" if "block" in on else "clean"


def test_url_lists_equal_brute_force(spark):
    r = random.Random(6)
    day = lambda: (datetime.date(2024, 1, 1) + datetime.timedelta(r.randrange(200))).isoformat()
    hosts = ["a.example", "b.a.example", "c.b.a.example", "xa.example", "d.example"]
    entries = [(r.choice("pq"), r.choice(hosts + ["a.example/x", "d.example/y"]), r.choice(["block", "allow", "clear"]), day()) for _ in range(40)]
    urls = [f"https://{h}{p}" for h in hosts for p in ("", "/x", "/y/z", ":80/x?q")] + [None, "", "nonsense", "HTTP://User@D.EXAMPLE./Y"]
    caps = [(k, r.choice(urls), day()) for k in range(400)]
    captures = spark.createDataFrame(caps, "page_id long, url string, fetch_date string")
    got = {x["page_id"]: x["verdict"] for x in urlfilter.judge(captures, spark.createDataFrame(entries, "list string, pattern string, action string, effective string")).collect()}
    assert got == {k: judge(u, d, entries) for k, u, d in caps}
    none = spark.createDataFrame([], "list string, pattern string, action string, effective string")
    assert {x["verdict"] for x in urlfilter.judge(captures, none).collect()} == {"clean", "invalid"}
    assert urlfilter.judge(captures.limit(0), none).count() == 0


@pytest.mark.parametrize("hot", [1, 20, 10_000])
def test_url_lists_with_hot_patterns_long_urls_and_clashing_columns(spark, monkeypatch, hot):
    """Top-level domains with and without an entry; patterns that are all cold, partly hot and all hot give the same."""
    monkeypatch.setattr(urlfilter, "HOT", hot)
    r = random.Random(8)
    day = lambda: (datetime.date(2024, 1, 1) + datetime.timedelta(r.randrange(200))).isoformat()
    hosts = [f"h{k}.site{k % 7}.{t}" for k in range(30) for t in ("com", "org")]
    entries = [(r.choice("pq"), r.choice(hosts[:20] + ["org", "site1.com", "site2.org", hosts[0] + "/x"]), r.choice(["block", "allow", "clear"]), day()) for _ in range(60)]
    caps = [(k, f"https://{r.choice(hosts)}/{r.choice('xyz')}" + ("/" + "w" * 200_000 if k % 300 == 0 else ""), day()) for k in range(900)]
    names = "_salt", "_hot", "_named", "pattern", "month", "host", "segment", "verdict", "_allow"
    captures = spark.createDataFrame(caps, "page_id long, url string, fetch_date string")
    for n in names:
        captures = captures.withColumn(n, F.lit("x"))
    listed = spark.createDataFrame(entries, "list string, pattern string, action string, effective string")
    for n in ("_salt", "host", "month", "valid_to", "rank"):
        listed = listed.withColumn(n, F.lit("x"))
    got = {x["page_id"]: x["verdict"] for x in urlfilter.judge(captures, listed).collect()}
    assert got == {k: judge(u, d, entries) for k, u, d in caps}
    assert set(got.values()) == {"clean", "blocked", "allowed"}


def test_mixture_meets_weights_and_limits(make_docs):
    r = random.Random(7)
    sizes = {"big": 300, "mid": 60, "low": 8, None: 5}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join("w" * r.randrange(5, 60)), s))
            k += 1
    rows += [(k, None, "void"), (k + 1, "", "void")]
    docs = make_docs(rows)
    got = mixing.mix(docs, entropy_gain=0.5, max_epochs=3.0).collect()
    seen = Counter((x["source"], x["doc_id"]) for x in got)
    assert {d for _, d in seen} == {d for d, _, _ in rows}  # each document once at least
    assert max(seen.values()) <= 4  # three epochs and the part of one that a last document opens
    tokens = Counter()
    for x in got:
        tokens[x["source"]] += x["tokens"]
    own = Counter()
    for d, t, s in rows:
        own[s] += len((t or "").split())
    assert tokens["low"] / own["low"] > tokens["big"] / own["big"] >= 1.0
    assert max(tokens[s] / own[s] for s in own if own[s]) <= 3.0 + 0.25
    assert mixing.mix(make_docs([])).count() == 0


def test_a_budget_beyond_the_limit_is_cut(make_docs):
    docs = make_docs([(k, "a b c d e", "s" if k % 3 else "t") for k in range(30)])
    got = mixing.mix(docs, max_epochs=2.0, budget=1e6).collect()
    assert sum(x["tokens"] for x in got) <= 2 * 150 + 10 and max(x["epoch"] for x in got) <= 1
    assert sum(x["tokens"] for x in mixing.mix(docs, max_epochs=2.0, budget=100).collect()) <= 100 + 10


def test_place_of_rows_that_repeat_a_key(make_docs):
    """Texts of one key are ordered by tokens, then by hash: the same mixture whatever the order of the rows."""
    rows = [(k % 4, " ".join("w" * (1 + k % 5)) + " " + "xyz"[k % 3], "s") for k in range(40)]
    runs = []
    for order in (rows, rows[::-1]):
        got = mixing.mix(make_docs(order).repartition(3), with_row=True).collect()
        runs.append(sorted((x["doc_id"], x["epoch"], x["place"], x["row"]["text"]) for x in got))
    assert runs[0] == runs[1]


def test_exponent_equals_a_search_over_the_whole_grid(make_docs, spark):
    r = random.Random(9)
    for limit in (1.5, 4.0):
        sizes = [r.randrange(1, 10**6) for _ in range(20)]
        shares = spark.createDataFrame([(str(k), 1, n) for k, n in enumerate(sizes)], "source string, docs long, tokens long")
        all_ = mixing._trials(shares, list(range(mixing.GRID + 1)))
        target = all_[mixing.GRID][0] + 0.25 * (all_[0][0] - all_[mixing.GRID][0])
        k = max(x for x in all_ if all_[x][0] >= target - 1e-9)
        if all_[k][1] * all_[k][2] > limit + 1e-9:
            k = min(x for x in all_ if all_[x][1] * all_[x][2] <= limit + 1e-9)
        assert mixing.choose_exponent(shares, 0.25, limit)[0] == k
