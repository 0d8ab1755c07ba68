"""PII, HTML text, lattice scores, the quality model and the pipeline."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockweave.llm import html_text, lattice, pii, quality_model, queries

from .fixtures import ODD, documents, real, same
from .test_pairs import brute as brute_components
from .test_rows import brute_hits, brute_lines, brute_rules

KIND = {"email": 0, "ip": 1, "card": 2, "phone": 3}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    t = t or ""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PERSONAL = [
    (1, "a.b@c.example.com_x@y.org, é 4539 1488 0343 6467 and 4539148803436468; 4539-1488-0343-6467."),
    (2, "1.2.3.4.5 256.1.1.1 001.02.3.255 1.2.3 10.0.0.1.x 1.2.3.4000"),
    (3, "+1 (017) 555-7713 +12 +1234567 +123456789012345678 +49 30.123-456 (x) +33"),
    (4, "@x @@ a@b a@b. a@b.c- ..@-.- 😀 x@y.z"),
    (5, "12 " * 4000 + "4539148803436467"),
    (6, "9" * 30000 + " " + "a" * 30000 + "@b"),
    (7, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0"),
    (8, "write to john (at) example (dot) com or call 017-555-7713 today"),
    (9, None),
    (10, ""),
    (10, ""),
]


@pytest.mark.parametrize("which", ["personal", "odd", "real"])
def test_base_spans(spark, sf_dir, which):
    rows = {"personal": PERSONAL, "odd": ODD, "real": real(spark, sf_dir)}[which]
    got = pii.find_pii(documents(spark, rows)).select("doc_id", "base_spans", "all_spans").collect()
    same([(r["doc_id"], [tuple(x) for x in r["base_spans"]]) for r in got], [(d, brute_pii(t)) for d, t in rows])
    for r in got:
        assert {tuple(x) for x in r["base_spans"]} <= {tuple(x) for x in r["all_spans"]}


def planted(seed=7, n=600):
    """Texts of random words with planted forms beyond the base, decoys, and the spans that are true."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    hexed = lambda k: "".join(pick(*"0123456789abcdef") for _ in range(k))

    def card(k):
        d = pick("34", "37") + digits(k - 3)
        return next(d + str(x) for x in range(10) if luhn(d + str(x)))

    make = [
        lambda: (0, pick("write to", "e-mail", "contact"), f"{word()} (at) {word()} (dot) {pick('com', 'org', 'de')}"),
        lambda: (1, pick("from host", "server", "ip"), ":".join(hexed(4) for _ in range(8))),
        lambda: (2, pick("amex card", "card", "credit card"), card(15)),
        lambda: (3, pick("call", "phone", "tel"), f"{digits(3)}-{digits(3)}-{digits(4)}"),
        lambda: (4, pick("password:", "token =", "api_key ="), '"' + hexed(int(rng.integers(16, 40))) + '"'),
    ]
    decoy = [
        lambda: (None, "order", f"{digits(3)}-{digits(3)}-{digits(4)}"),
        lambda: (None, "invoice no.", digits(10)),
        lambda: (None, "password:", "please"),
        lambda: (None, "sha", hexed(40)),
        lambda: (None, "version", "1.2.3"),
        lambda: (None, word(), digits(12)),
    ]
    base = [lambda: f"{word()}.{word()}@{word()}.com", lambda: ".".join(str(rng.integers(1, 255)) for _ in range(4)), lambda: "+1 (555) " + digits(3) + "-" + digits(4), lambda: next(d + str(x) for d in ["4" + digits(14)] for x in range(10) if luhn(d + str(x)))]
    rows, truth = [], set()
    for i in range(n):
        text = " ".join(word() for _ in range(rng.integers(1, 12)))
        for _ in range(rng.integers(0, 3)):
            k, lead, x = pick(*make)() if rng.random() < 0.6 else pick(*decoy)()
            text += f" {lead} "
            at = len(text) + x.startswith('"')
            if k is not None:
                truth.add((i, k, at, at + len(x.strip('"'))))
            text += x + " " + " ".join(word() for _ in range(rng.integers(1, 8)))
        if rng.random() < 0.5:
            text += " " + pick(*base)() + " " + word()
        rows.append((i, text))
    return rows, truth


def test_spans_beyond_the_base_are_found(spark):
    rows, truth = planted()
    got = pii.find_pii(documents(spark, rows)).select("doc_id", "base_spans", "all_spans").collect()
    same([(r["doc_id"], [tuple(x) for x in r["base_spans"]]) for r in got], [(d, brute_pii(t)) for d, t in rows])
    added = {(r["doc_id"], *x) for r in got for x in r["all_spans"] if x not in r["base_spans"]}
    right = len(added & truth)
    print("recall", right / len(truth), "precision", right / len(added), "by kind", collections.Counter(x[1] for x in truth - added), sorted(added - truth)[:5])
    assert right >= 0.9 * len(truth) and right >= 0.9 * len(added)


def test_many_matches_are_linear(spark):
    import time

    text = "a@b.cd 1.2.3.4 x (at) y.de, " * 20_000
    start = time.time()
    r = pii.find_pii(documents(spark, [(1, text)])).first()
    assert len(r["base_spans"]) == 40_000 and r["base_spans"][-1]["e"] == 28 * 19_999 + 14 and time.time() - start < 120


def test_pii_empty_table(spark):
    assert pii.find_pii(documents(spark, [])).count() == 0


def test_labelers_are_told_apart():
    rng = np.random.default_rng(0)
    right = [0.95, 0.8, 0.85, 0.9, 0.6]
    counts = collections.Counter()
    for _ in range(20_000):
        y = rng.random() < 0.4
        votes = tuple(2 if rng.random() < 0.2 else int(y if rng.random() < r else not y) for r in right)
        counts[(0, votes)] += 1
    found, chance = pii.reliabilities(counts)
    assert all(abs(sum(f) / 2 - r) < 0.06 for f, r in zip(found[0], right, strict=True))
    assert chance[(0, (1, 1, 1, 1, 1))] > 0.95 and chance[(0, (0, 0, 0, 0, 0))] < 0.05


PAGE = (
    '<html><head><title>T</title></head><body class="page nav-open"><header><h1>Site</h1></header><nav>x</nav><div class="cookie-notice">We use</div><main><article><header><h1>Head &amp; line</h1></header>'
    '<p>One <b>two</b>three&nbsp;four<br>five<p>Next <a href=x>link</a>.<div class="ad">buy</div><ul><li>i1<li>i2</ul><script>if(a<b){"</p>"}</script>'
    '<section class="comments"><article class="comment"><p>nice</p></article></section></article></main><aside>z</aside><footer>f</footer></body></html>'
)


def test_page_text():
    assert html_text.Page(PAGE, "h").text(()) == "Head & line\nOne twothree four five\nNext link.\ni1\ni2"
    assert html_text.Page(None, "").text(()) == html_text.Page("", "").text(()) == ""
    assert html_text.Page("plain < text &lt;b&gt;", "").text(()) == "plain < text <b>"
    assert html_text.Page("<p>a<style>p{}</style>b<script>never ends", "").text(()) == "a b"
    assert html_text.Page("<div><p>a</div></span></p>b<!-- c", "").text(()) == "a\nb"
    assert html_text.Page("<div>" * 30000 + "deep", "").text(()) == "deep"


@pytest.mark.parametrize("name", ["site-content no-sidebar", "has-banner", "comments-open", "post share-buttons-enabled", "sidebar", "elementor-widget", "content-sidebar-wrap", "modal share", "menu-open cookie"])
def test_main_text_survives_names(name):
    body = "<h1>T</h1><p>x y</p>"
    for inner in (f"<article>{body}</article>", f"<main>{body}</main>", body):
        assert html_text.Page(f'<body><div id=a class="{name}">{inner}</div><footer>f</footer></body>', "h").text(()) == "T\nx y"
    assert html_text.Page(f'<main class="{name}">{body}</main>', "").text(()) == "T\nx y"
    assert html_text.Page(f'<article class="{name}">{body}</article>', "").text(()) == "T\nx y"


def test_names_that_go():
    for name in ("ad", "site-footer", "cookieBanner", "footer__inner", "post-comments", "related-posts", "social-share-buttons", "widget-area", "ad-300"):
        assert html_text.Page(f'<body><div class="x {name}"><p>gone</p></div><article><p>stays</p></article><div class="{name}"><p>gone</p></div></body>', "").text(()) == "stays"
        assert html_text.Page(f'<body><div class="{name}"><p>gone</p></div><div><p>stays</p></div></body>', "").text(()) == "stays"
    assert [html_text.named(x) for x in ("share-article", "no-sidebar", "comments-open", "site-header", "content", "entry-header", "")] == ["", "", "", "header", "", "", ""]
    assert html_text.Page('<p title="class=ad" data-class="ad">a</p><p title=it\'s>b', "").text(()) == "a\nb"


def test_leads_beside_articles_and_whole_forms():
    text = lambda h: html_text.Page(h, "").text(())
    assert text("<body><nav>n</nav><h1>H</h1><p>lead</p><article><p>x</p></article><div>box</div><article>y</article></body>") == "H\nlead\nx\ny"
    assert text("<main><h1>H</h1><div><article><p>x</p></article></div></main><div><p>z</p></div>") == "H\nx"
    assert text("<form><div><h1>a</h1><p>b</p></div></form>") == "a\nb"
    assert text("<form><p>search</p></form><p>b</p>") == "b"
    assert text("<article></article><div class=ad>buy</div>") == text('<div class="ad">buy</div><nav>n</nav>') == ""
    assert text('<article><p>x</p></article><section class="comments"><article><p>nice</p></article></section>') == "x"
    assert text('<section class="comments"><article><p>nice</p></article></section><div><p>x</p></div>') == "x"


ODD_MARKUP = ["<a ", '<p class="', "if a <b c ", "<svg ", "<svg>", "<p a=\">\" ", "<!--", "<!", "<div>x", "<ul><li>", "&", '<b class="ad ', "</p>", "<blockquote></p>", "<p a=b\"'"]


@pytest.mark.parametrize("unit", ODD_MARKUP)
def test_malformed_pages_are_read_in_linear_time(unit):
    import time

    start = time.process_time()
    page = html_text.Page("<article><p>x</p></article>" + unit * (1_000_000 // len(unit)), "")
    assert page.text(()).startswith("x") and time.process_time() - start < 30


def test_pages_of_known_parts():
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9)))
    say = lambda: " ".join(word() for _ in range(rng.integers(1, 9)))
    junk = ["<nav><ul><li>{}</li></ul></nav>", "<footer><p>{}</p></footer>", '<div class="ad"><p>{}</p></div>', "<aside>{}</aside>", '<div id="cookie-notice">{}</div>', "<form><p>{}</p></form>", "<script>{}</script>", "<!-- {} -->", '<section class="comments"><p>{}</p></section>']
    for _ in range(200):
        parts, want = [], []
        for _ in range(rng.integers(0, 6)):
            kind, t = rng.integers(0, 5), say()
            if kind == 4:
                items = [say() for _ in range(rng.integers(1, 4))]
                parts.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
                want += items
            else:
                parts.append(("<p>{}</p>", "<h2> {}</h2>", "<p>{}\n", "<div><b>{}</b></div>")[kind].format(t))
                want.append(t)
            if rng.random() < 0.4:
                parts.append(junk[rng.integers(len(junk))].format(say()))
        around = [junk[i].format(say()) for i in rng.integers(0, len(junk), 4)]
        tag = ("article", "main")[rng.integers(2)]
        page = f"<html><body><div class='page has-sidebar'>{''.join(around[:2])}<{tag}>{''.join(parts)}</{tag}>{''.join(around[2:])}</div></body></html>"
        assert html_text.Page(page, "h").text(()) == "\n".join(want)


def test_names_do_not_reach_into_the_text():
    text = lambda h: html_text.Page(h, "").text(())
    for name in ("advertising", "search", "footer", "related", "cookies"):
        assert text(f'<article><h2 id="{name}" class="{name}">Head</h2><p id="{name}">x</p></article>') == "Head\nx"
        assert text(f'<body><article><h1 id="{name}">Head</h1><p>x</p></article></body>') == "Head\nx"
    assert text('<p>A <span class="market-share">40%</span> b</p>') == "A 40% b"
    assert text('<p>See <a class="social-link" href="x">twitter</a> for <b class="ad">more</b>.</p>') == "See twitter for more."
    assert text('<article><p class="notice">Mind the gap.</p><div class="recommended"><p>Recommended dose: two.</p></div></article>') == "Mind the gap.\nRecommended dose: two."
    assert text('<article><p>x</p><div class="recommended"><ul><li><a href=a>More of it</a></li><li><a href=b>And more</a></li></ul></div></article>') == "x"
    assert text('<article><p>x</p><div class="newsletter"><p>Join us</p><input type=email></div></article>') == "x"
    assert text('<article class="post"><p>a</p></article><article class="post social"><p>b</p></article>') == "a\nb"
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p>") == "Let x=2 hold."
    long = " ".join(f"word{i}" for i in range(50))
    assert text(f'<div id="content"><article><h1>T</h1></article><div class="entry"><p>{long}</p></div></div>') == f"T\n{long}"
    assert text(f'<form id="aspnetForm"><div><p>{long}</p></div></form>') == long


@pytest.mark.parametrize(("unit", "end"), [("<nav>", ""), ("<nav><article>", ""), ("<article>", ""), ("<aside><div>", "<article><p>y</p></article>"), ("<div class='menu'><article class='ad'>", "")])
def test_nested_articles_are_read_in_linear_time(unit, end):
    import time

    raw = "<p>x</p>" + unit * (1_000_000 // len(unit)) + end * 1000
    start = time.process_time()
    html_text.Page(raw, "").text(())
    assert time.process_time() - start < 30


def test_counts_alone_find_the_text(spark):
    """Without tags and names, on hosts of ten pages and more."""
    import html
    from collections import Counter

    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df, lists=False).collect()}
    rows = df.collect()
    hosts = Counter(html_text.host_of(r["url"]) for r in rows)
    hit = found = want = whole = 0
    for r in rows:
        if hosts[html_text.host_of(r["url"])] >= 10:
            inner = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r["html"], re.S)[1]
            words = Counter(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
            mine = Counter(got[r["page_id"]].split())
            hit, found, want = hit + (words & mine).total(), found + mine.total(), want + words.total()
            whole += words == mine
    assert hit / found > 0.98 and hit / want > 0.98, (hit / found, hit / want)


def test_structure_decides_where_words_change(spark):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    rows = []
    for i in range(14):
        box = f'<div class="xq"><span>{say(3)}</span><div>{say(2)}</div></div>'
        rows.append((i, f"http://s.example.com/{i}", f'<body>{box}<div class="t{i}"><h1>{say(4)}</h1></div><div class="zz"><p>{say(40)}</p><div>{say(9)}</div></div>{box}</body>'))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_text.main_text(df).collect():
        blocks = re.findall(r"<(?:h1|p|div)>([^<]+)<", re.sub(r'<div class="xq">.*?</div></div>', "", r["html"]))
        assert r["text"].split("\n") == blocks
    few = html_text.main_text(df.limit(4)).collect()
    assert all(len(r["text"].split("\n")) == 7 for r in few)


def test_data_pages(spark, sf_dir):
    """The test pages hold one article of headings and paragraphs and otherwise only template."""
    import html

    got = {r["page_id"]: r["text"] for r in queries.op9_html_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", inner[1] if inner else "")
        plain = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", b))).split()) for b in blocks]
        assert got[r["page_id"]] == "\n".join(b for b in plain if b)


def pages(n, article, box, host="h.example.com", extra=""):
    return [(i, f"https://{host}/{i}", f"<body><div class=x1><span>Site wide box</span><p>{box}</p></div>{extra}<{article}><p>Text number {i % (n - 2)} here.</p></{article}></body>") for i in range(n)]


@pytest.mark.parametrize("sent", [1000, 0])
def test_site_template(spark, sent):
    rows = pages(12, "div", "Join us") + pages(3, "div", "Join us", "small.example.com") + pages(12, "article", "Join us", "art.example.com")
    rows += [(90, None, None), (91, "not a url", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("key", F.lit(1))
    got = html_text.main_text(df, sent_hashes=sent).select("page_id", "url", "text").collect()
    want = [(i, u, "" if not h else (f"Text number {i % (10 if 'small' not in u else 1)} here." if "small" not in u else f"Site wide box\nJoin us\nText number {i % 1} here.")) for i, u, h in rows]
    same(got, want)


def test_copied_pages_are_no_template(spark):
    rows = [(i, f"http://c.example.com/{i}", "<body><div><p>The same text.</p></div></body>") for i in range(30)] + pages(12, "div", "Join us", "c.example.com")
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).filter("text = 'The same text.'")
    assert got.count() == 30
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_base(rows):
    tok = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), None] for _, t in rows]
    out = [zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c = collections.Counter(x for t, o in zip(tok, out, strict=True) if not o for x in t)
    n = sum(c.values())
    return [(d, o, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in t), 3)) for (d, _), t, o in zip(rows, tok, out, strict=True)]


@pytest.mark.parametrize("which", ["odd", "real"])
def test_base_scores(spark, sf_dir, which):
    rows = ODD if which == "odd" else real(spark, sf_dir)
    got = lattice.lattice_scores(documents(spark, rows), queries.vocabulary_path(), bucket_bytes=40_000).collect()
    same([(*r[:5], round(r[5], 3)) for r in got], brute_base(rows))
    assert all(r["score"] < 0 for r in got)


def brute_scores(rows):
    """score of each row by plain counting and a forward sum over all segmentations of each distinct word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path())
    usual = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    spelt = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
    words = [(t or "").encode().lower().split() for _, t in rows]
    train = [w for (d, _), w in zip(rows, words, strict=True) if d is None or zlib.crc32(str(d).encode()) % 10]
    pieces = collections.Counter()
    for w, n in collections.Counter(x for ws in train for x in ws).items():
        for i in sp.encode(w.decode()):
            pieces[i] += n
    used = [*usual, *spelt.values()]
    total = sum(pieces[i] for i in used) + len(train) + 0.5 * (len(used) + 1)
    of = {sp.id_to_piece(i): math.log((pieces[i] + 0.5) / total) for i in usual}
    byte = {b: math.log((pieces[i] + 0.5) / total) for b, i in spelt.items()}
    longest = max(map(len, of))

    def word(w):
        at = [0.0]
        for end in range(1, len(w) + 1):
            terms = [at[end - 1] + sum(byte[b] for b in w[end - 1].encode())]
            terms += [at[k] + of[w[k:end]] for k in range(max(0, end - longest), end) if w[k:end] in of]
            at.append(max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms)))
        return at[-1]

    known = {w: word("▁" + w.decode()) for w in {x for ws in words for x in ws}}
    end = math.log((len(train) + 0.5) / total)
    return [(d, (sum(known[x] for x in ws) + end) / math.log(10)) for (d, _), ws in zip(rows, words, strict=True)]


@pytest.mark.parametrize("which", ["odd", "real", "long"])
def test_scores_end_to_end(spark, sf_dir, which):
    rows = {"odd": lambda: [*ODD, (None, "a null id")], "real": lambda: real(spark, sf_dir, 60), "long": lambda: [(1, " ".join(f"w{i}ü{i * 7919 % 1000}" for i in range(30_000))), (2, "w1ü919 short")]}[which]()
    got = lattice.lattice_scores(documents(spark, rows), queries.vocabulary_path(), bucket_bytes=40_000).select("doc_id", "score").collect()
    key = lambda r: (str(r[0]), r[1])
    for (a, x), (b, y) in zip(sorted(map(tuple, got), key=key), sorted(brute_scores(rows), key=key), strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-9)


def test_lattice_sums_all_segmentations():
    v = lattice.Vocabulary(queries.vocabulary_path())
    v.weigh(np.arange(v.size), 10)
    word = "▁thing"

    def paths(w):
        if not w:
            return 1.0
        total = math.exp(v._one(w[0])) * paths(w[1:])
        return total + sum(math.exp(v.logs[w[:k]]) * paths(w[k:]) for k in range(2, len(w) + 1) if w[:k] in v.logs)

    assert v.log_probability(word) == pytest.approx(math.log(paths(word)))
    words = [word, "▁", "▁😀漢", "▁" + "y" * 300]
    assert v.log_probabilities(words).tolist() == pytest.approx([v.log_probability(w) for w in words])


def test_lattice_empty_table_and_null_ids(spark):
    assert lattice.lattice_scores(documents(spark, []), queries.vocabulary_path()).count() == 0
    r = lattice.lattice_scores(documents(spark, [(None, "a b"), (1, None)]), queries.vocabulary_path()).orderBy("n_tokens").collect()
    assert [x["n_tokens"] for x in r] == [1, 3] and not r[1]["held_out"]


def test_quality_model_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = quality_model.quality_model(spark.read.parquet(f"{d}/documents.parquet"), labels.filter(~out)).join(labels.filter(out).select("doc_id", "quality"), "doc_id")
    got = labels.filter(out).select("doc_id", F.col("quality").alias("y")).join(got.drop("quality"), "doc_id")
    share = {r["y"]: r["s"] for r in got.groupBy("y").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.99 and share[0] < 0.05


def test_toxic_documents_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = labels.join(docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m")), "doc_id")
    out = texts.filter(F.col("m") < "4").select("doc_id", F.col("toxic").alias("y"))  # copies of a text are on one side
    words = quality_model.toxic_words(docs, labels.join(out, "doc_id", "left_anti"), "doc_id", "text", "toxic", 20_000)
    assert 5 < len(words) <= 256
    got = docs.join(out, "doc_id").groupBy("y").agg(F.avg((quality_model._listed(F.col("text"), words) >= 2).cast("int")).alias("s"))
    share = {r["y"]: r["s"] for r in got.collect()}
    print(share)
    assert share[1] > 0.85 and share[0] < 0.01


def test_toxic_words_without_labels(spark):
    df = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.toxic_words(df, none, "doc_id", "text", "toxic", 100) == []
    assert quality_model.toxic_words(df, none.drop("toxic"), "doc_id", "text", "toxic", 100) == []
    rows = [(i, f"plain words and a {'Clod! oaf,' if i % 2 else 'friend'} number") for i in range(40)] + [(50, None), (51, "oaf oaf"), (52, "CLOD oaf")]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in rows], "doc_id long, text string, source string, lang string").withColumn("toxic", F.lit("mine"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    texts = df.withColumn("text", F.concat("text", F.lit(" x"), F.col("doc_id").cast("string")))
    assert quality_model.toxic_words(texts, labels, "doc_id", "text", "toxic", 100) == ["clod", "oaf"]
    assert quality_model._listed(F.lit("x"), []) is not None
    got = {r["doc_id"]: (r["n_toxic_words"], r["toxic"]) for r in quality_model.quality_model(texts, labels).collect()}
    assert (got[0], got[1], got[50], got[51], got[52]) == ((0, False), (2, True), (0, False), (1, False), (2, True))


def test_sparse_sites_are_shrunk(spark):
    rows = [(i, "Good plain words of a text. " * 6 if i % 10 else "### $$$ %%% " * 10, "big") for i in range(200)]
    rows += [(200 + i, "### $$$ %%% " * 10, "bad") for i in range(100)] + [(300, "### $$$ %%% " * 10, "once"), (301, None, None), (302, "", "big"), (302, "", "big")]
    df = spark.createDataFrame([(a, b, c, None) for a, b, c in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), None) for i in range(200)], "doc_id long, quality int, toxic int")
    r = {x["doc_id"]: x for x in quality_model.quality_model(df, labels).collect()}
    assert len(r) == 303 and r[5]["host_posterior"] > r[300]["host_posterior"] > r[250]["host_posterior"]
    assert quality_model.quality_model(df, labels.limit(0)).filter("kept").count() == len(rows)
    assert quality_model.quality_model(df.limit(0), labels).count() == 0


SYMBOLS = "#*$%&|<>"


def measured(t):
    """Words, and characters by class: a-z, A-Z, digits, symbols, other ASCII marks, the rest."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    classes = [0] * 6
    for c in "".join(w):
        classes[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in SYMBOLS else 4 if "!" <= c <= "~" else 5] += 1
    return w, classes


def distance(p, q):
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def brute_kept(rows):
    """Ids of (id, text, language) that the quality rules keep, with references from distinct texts that pass the base."""
    code = lambda x: x.lower() if x and re.fullmatch("[A-Za-z]{2,3}", x) else "und"
    norm = collections.defaultdict(list)
    for t, lang in {(t, code(x)) for _, t, x in rows}:
        if not brute_rules(t)[-1]:
            norm[lang].append(measured(t))
    refs = {}
    for lang, texts in norm.items():
        classes = [sum(c[i] for _, c in texts) for i in range(6)]
        exact = collections.Counter(x for w, _ in texts for x in w)
        low = collections.Counter()
        for x, n in exact.items():
            if len(x) <= 24 and "," not in x:
                low[x.lower()] += n
        top = sorted(low, key=lambda x: (-low[x], x))[:32]
        refs[lang] = [c / sum(classes) for c in classes], top, [low[x] / sum(exact.values()) for x in top]
    kept = set()
    for d, t, lang in rows:
        w, classes = measured(t)
        if brute_rules(t)[-1]:
            continue
        shares, top, common = refs[code(lang)]
        far = distance([c / sum(classes) for c in classes], shares) if sum(classes) >= 200 else 0.0
        mine = collections.Counter(x.lower() for x in w)
        own = [mine[x] / len(w) for x in top]
        other = distance([*own, max(0.0, 1 - sum(own))], [*common, max(0.0, 1 - sum(common))]) if len(w) >= 40 else 0.0
        assert abs(far - 0.3) > 1e-9 and abs(other - 0.42) > 1e-9
        if far <= 0.3 and other <= 0.42:
            kept.add(d)
    return kept


def test_pipeline_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = at.select("doc_id", "text", "lang").collect()
        before = [(r["doc_id"], r["text"]) for r in rows]
        new = stage(spark, at, sf_dir).cache()
        if name != "packing":
            assert new.columns == docs.columns
            got = {(r["doc_id"], r["text"]) for r in new.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in new.collect()) or name == "quality_rules"
        if name == "quality_rules":
            keep = brute_kept([tuple(r) for r in rows])
            assert got == {(d, t) for d, t in before if d in keep} and 0 < len(got) < len(before)
        elif name == "line_dedup":
            assert got == {(d, t) for d, t, _, _ in brute_lines(before)}
        elif name == "near_duplicates":
            keep = {d for d, _, c in brute_components(before, 5, 8, 10) if d == c}
            assert got == {(d, t) for d, t in before if d in keep}
        elif name == "decontamination":
            clean = {d for d, _, hit, _ in brute_hits(before, bench) if not hit}
            assert got == {(d, t) for d, t in before if d in clean} and len(got) < len(before)
        else:
            tokenizer = Tokenizer.from_file(queries.tokenizer_path())
            pieces = collections.defaultdict(list)
            for r in new.orderBy("start").collect():
                pieces[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
            assert pieces == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in before}
        at = new


def test_pipeline_without_rows_and_with_nulls(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(3).withColumns({"text": F.when(F.col("doc_id") % 2 == 0, F.lit("")), "doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        out = stage(spark, odd, sf_dir)
        assert out.count() == (0 if name == "quality_rules" else 3)
        assert name == "packing" or out.columns == docs.columns


def test_quality_model_by_hand(spark, sf_dir):
    """Evidence, posteriors and quality of every row against plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()] + [(None, None, None, None), (3, "", "a", None)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit("mine") for c in ("doc", "host", "path", "x", "quality", "kept", "n", "s")})
    got = sorted(quality_model.quality_model(clash, labels).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["n_words"]))

    def values(t):
        w, c = measured(t)
        n, some, chars = len(w), max(1, len(w)), max(1, sum(c))
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        dup = len(lines) - len(set(lines))
        return [math.log1p(n), min(sum(c) / some, 30.0), *[math.sqrt(x / chars) for x in c[1:]], len(set(w)) / some**0.85, min(dup / max(1.0, math.sqrt(some)), 3.0), max(0.0, (10 - n) / 10)]

    x = {(d, t): values(t) for d, t, _, _ in rows}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    fit = [(x[d, t], known[d]) for d, t, _, _ in rows if d in known]
    model = quality_model.Logistic(np.array([f[0] for f in fit]), np.array([f[1] for f in fit], float))
    z = {k: float(np.clip(model._expand(np.array([v])) @ model.w, -12, 12)[0]) for k, v in x.items()}
    every = [(d, s or "", l or "", z[d, t], 1 / (1 + math.exp(-z[d, t])), len(measured(t)[0])) for d, t, s, l in rows]
    mean = sum(r[4] for r in every) / len(every)

    def shrunk(key, above):
        groups = collections.defaultdict(list)
        for r in every:
            groups[key(r)].append(r[4])
        n = [len(v) for v in groups.values()]
        between = sum(len(v) * (sum(v) / len(v) - above(k)) ** 2 for k, v in groups.items())
        within = sum(sum(p * p for p in v) - len(v) * (sum(v) / len(v)) ** 2 for v in groups.values())
        k0 = quality_model.strength(len(n), sum(n), sum(i * i for i in n), between, within)
        return {k: (sum(v) + k0 * above(k)) / (len(v) + k0) for k, v in groups.items()}

    hosts = shrunk(lambda r: r[1], lambda k: mean)
    paths = shrunk(lambda r: (r[1], r[2]), lambda k: hosts[k[0]])
    want = []
    for d, s, l, zz, p, n in every:
        q = min(max(paths[s, l], 1e-6), 1 - 1e-6)
        moved = zz + math.log(q / (1 - q)) - math.log(mean / (1 - mean))
        want.append((d, n, p, hosts[s], paths[s, l], 1 / (1 + math.exp(-moved))))
    want.sort(key=lambda r: (r[0] is not None, r[0], r[1]))
    for g, w in zip(got, want, strict=True):
        assert (g["doc_id"], g["n_words"]) == w[:2]
        assert [g[c] for c in ("evidence", "host_posterior", "path_posterior", "quality")] == pytest.approx(w[2:], abs=1e-5)


def test_digests(spark, sf_dir):
    r = queries.op8_pii(spark, sf_dir).filter("n_email + n_ip + n_card + n_phone > 0").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("doc_id") == r["doc_id"]).first()["text"]
    spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute_pii(text))
    assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
