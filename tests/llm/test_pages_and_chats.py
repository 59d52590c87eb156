"""HTML extraction and chat formatting on small tables."""

import collections
import math
import random

import pytest

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><p>x";</script></head>
<body><header>Top</header><nav><ul><li><a href=/a>menu {i}</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice">Accept?</div>
<div class="ad">Buy</div><article><h1>Head {i}&amp;amp</h1><p><b>First&nbsp; {i}<br>line<p>Second <a href=x>link</a>s &lt;b&gt; &eacute;
<form><input name=q><button>Go</button></form><ul><li>one<li>two</ul><div class="comments"><p>nice!</div></article>
<aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_articles(llm):
    from strandgraph.llm.html_extract import extract

    rows = [(i, "http://a.example/x", PAGE.format(i=i)) for i in range(4)] + [(10, None, None), (11, "x", ""), (12, "http://b.example", "no markup &amp; text"), (13, "http://b.example", "<p>cut <b"), (14, "http://a.example/x", PAGE.format(i=0))]
    pages = llm.createDataFrame([(*r, "clash", "s", 1) for r in rows], "page_id long, url string, html string, text string, host_key string, salt int")
    out = {r.page_id: r.text for r in extract(pages).collect()}
    for i in range(4):
        assert out[i] == f"Head {i}&amp\nFirst {i} line\nSecond links <b> é\none\ntwo"
    assert (out[10], out[11], out[12], out[13], out[14]) == ("", "", "no markup & text", "cut", out[0])
    assert extract(pages.limit(0)).count() == 0


def test_style_tree_cuts_templates_without_roles(llm):
    """Without an article, what a host repeats is cut and what varies stays."""
    from strandgraph.llm.html_extract import extract, style_tree

    page = '<body><div class="top">Our site</div><div class="body"><p>Story {i} of {j}</p><p>More {i}</p></div><div class="end">Imprint</div></body>'
    rows = [(i, f"https://www.c.example:80/{i}", page.format(i=i, j=i * 7)) for i in range(12)] + [(99, "https://d.example/", page.format(i=1, j=2))]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    tree = {(r.host, r.path): r.importance for r in style_tree(pages).collect()}
    assert tree["www.c.example", ">body>div.top"] == 0 and tree["www.c.example", ">body>div.body"] > 0.8 and tree["d.example", ">body>div.top"] == 1
    out = {r.page_id: r.text for r in extract(pages).collect()}
    assert out[3] == "Story 3 of 21\nMore 3" and out[99] == "Our site\nStory 1 of 2\nMore 1\nImprint"


def brute_force_tree(rows):
    """Importance by counting, page by page, and what each page then keeps."""
    from strandgraph.llm import html_extract as h

    seen = collections.defaultdict(dict)
    for _, url, html in rows:
        for path, page, content, shape in h.style_rows(html):
            at = seen[h.host(url), path]
            at[page] = min(at.get(page, (content, shape)), (content, shape))

    def entropy(values):
        m, n = len(values), collections.Counter(values)
        return 1.0 if m < 2 else -sum(k / m * math.log(k / m, m) for k in n.values())

    tree = {k: (len(v), h.GAMMA * entropy([c for c, _ in v.values()]) + (1 - h.GAMMA) * entropy([s for _, s in v.values()])) for k, v in seen.items()}
    ruled = collections.defaultdict(set)
    for (host, path), (m, i) in tree.items():
        low = (h.PRIOR + m * i) / (h.PRIOR + m) < h.LOW if path[0] == "+" else m * i / (h.PRIOR + m) >= h.LOW if path[0] == "-" else i < h.LOW and m >= h.MIN_PAGES
        if low:
            ruled[host].add(path)
    return tree, {k: h.text_of(html, frozenset(ruled[h.host(url)])) for k, url, html in rows}


def test_style_tree_against_brute_force(llm):
    """Random pages of a few hosts, with copies, templates, articles and without."""
    from strandgraph.llm.html_extract import extract, style_tree

    r = random.Random(8)
    rows = []
    for k in range(160):
        host = r.choice("pqrs")
        some = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
        box = [f'<div class="top">Site {host}</div>', f'<div class="m"><p>{some(30)}</p><p>{some(12)}</p></div>', f'<div class="n">{r.choice(["one", "two"])}</div>', f"<ul><li>{some(2)}<li>tip</ul>"]
        inner = "".join(x for x in box if r.random() < 0.9)
        rows.append((k, f"http://{host}.example/{k}", f"<html><body>{inner if host in 'pq' else '<article>' + inner + '</article>' + box[2]}<div>Imprint</div></body></html>"))
        if r.random() < 0.2:
            rows.append((1000 + k, rows[-1][1], rows[-1][2]))
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    tree, texts = brute_force_tree(rows)
    got = {(x.host, x.path): (x.n_pages, x.importance) for x in style_tree(pages).collect()}
    assert got.keys() == tree.keys() and all(got[k][0] == m and abs(got[k][1] - i) < 1e-9 for k, (m, i) in tree.items())
    assert {x.page_id: x.text for x in extract(pages).collect()} == texts
    from strandgraph.llm.html_extract import text_of

    assert sum(texts[k] != text_of(html, frozenset()) for k, _, html in rows) > len(rows) / 2  # the tree decides


def test_well_formed_pages_against_a_parser():
    """Without roles, text is what the standard parser reads, by block."""
    from html.parser import HTMLParser

    from strandgraph.llm.html_extract import text_of

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out = [""]

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.out[-1] += " "
            elif tag not in ("b", "i", "a", "span"):
                self.out.append("")

        def handle_endtag(self, tag):
            if tag not in ("b", "i", "a", "span"):
                self.out.append("")

        def handle_data(self, data):
            self.out[-1] += data

    r = random.Random(9)

    def inline(depth=0):
        words = " ".join(r.choice(["one", "x &amp; y", "&lt;b&gt;", "caf&eacute;", "n&#233;", "a\n  b", "&nbsp;"]) for _ in range(r.randint(1, 4)))
        return words if depth > 2 or r.random() < 0.5 else f"{words}<{(t := r.choice(['b', 'i', 'a', 'span']))} title='q > \"x\"'>{inline(depth + 1)}</{t}>{r.choice(['', '<br>', ' z'])}"

    def block(depth=0):
        if depth > 3 or r.random() < 0.4:
            return f"<p>{inline()}</p>"
        t = r.choice(["div", "section", "blockquote", "ul"])
        return f"<{t}>" + "".join(f"<li>{inline()}</li>" if t == "ul" else block(depth + 1) for _ in range(r.randint(1, 3))) + f"</{t}>"

    for _ in range(200):
        html = f"<html><body>{''.join(block() for _ in range(3))}</body></html>"
        p = Plain()
        p.feed(html)
        assert text_of(html, frozenset()) == "\n".join(x for x in (" ".join(o.split()) for o in p.out) if x)


def test_salted_join_gives_the_same(llm, monkeypatch):
    from strandgraph.llm import html_extract as h

    page = '<body><div class="top">Our site</div><p>Story {i}</p></body>'
    pages = llm.createDataFrame([(i, "https://c.example/", page.format(i=i)) for i in range(9)], "page_id long, url string, html string")
    want = sorted(h.extract(pages).collect())
    monkeypatch.setattr(h, "BROADCAST_BYTES", -1)
    assert sorted(h.extract(pages).collect()) == want


def test_copies_are_no_template(llm):
    """Equal rows, and a host of mostly copies, keep their texts without an article."""
    from strandgraph.llm.html_extract import extract

    page = '<html><body><div class="top">Our site</div><div class="body"><p>Story {i} has quite a few words</p><p>More {i}</p></div></body></html>'
    rows = [(i, None, page.format(i="x")) for i in range(3)]
    rows += [(100 + i, "http://e.example/", page.format(i="copy")) for i in range(70)] + [(200 + i, "http://e.example/", page.format(i=i)) for i in range(30)]
    # copies beside a line that differs
    rows += [(300 + i, "http://f.example/", page.format(i="same").replace("Our site", f"No {i}")) for i in range(20)]
    out = {r.page_id: r.text for r in extract(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story = lambda i: f"Story {i} has quite a few words\nMore {i}"
    assert {out[i] for i in range(3)} == {"Our site\n" + story("x")}
    assert {out[100 + i] for i in range(70)} == {story("copy")} and all(out[200 + i] == story(i) for i in range(30))
    assert all(story("same").split("\n")[0] in out[300 + i] for i in range(20))


@pytest.mark.parametrize("html", [
    '<body class="has-sidebar"><p>text</p></body>',
    '<body><div id="page" class="nav-open"><p>text</p></div></body>',
    '<body><article class="post comment-open"><p>text</p></article></body>',
    '<body class="modal"><main class="overlay"><p>text</p></main></body>',
    '<article><section id="related-work" class="related"><p>text</p></section></article>',
    '<article><h2 id="ad-hoc-networks" class="ad">text</h2></article>',
    '<article><div id="skip-list"><p>text</p></div></article>',
    '<article><p>text</p><div class="big ad">Buy</div><p class="sponsored">Buy</p></article>',
])
def test_words_in_names_drop_no_text(html):
    """Only a whole class token is a stated role, and not on a page's frame."""
    from strandgraph.llm.html_extract import text_of

    assert text_of(html, frozenset()) == "text"


def test_tree_decides_beside_and_in_an_article(llm):
    """An article is a prior: text beside a teaser stays, a notice that all pages
    repeat in the article goes."""
    from strandgraph.llm.html_extract import extract

    teaser = '<body><div class="x"><h2>Title {i}</h2><p>The main text of page {i} is long</p></div><article>Teaser {i}</article></body>'
    notice = '<body><article><p>The main text of page {i} is long</p><div class="x">Read our paper</div></article><div class="y">Author {i}</div><div class="z">Imprint</div></body>'
    rows = [(1, "http://t.example/", teaser.format(i=1))] + [(100 + i, "http://n.example/", notice.format(i=i)) for i in range(30)] + [(200, "http://few.example/", notice.format(i=1))]
    rows += [(300 + i, "http://copies.example/", notice.format(i=0).replace("Author 0", f"Author {i}")) for i in range(30)]
    out = {r.page_id: r.text for r in extract(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == "Title 1\nThe main text of page 1 is long\nTeaser 1"
    assert all(out[100 + i] == f"The main text of page {i} is long\nAuthor {i}" for i in range(30))
    assert {out[200], *(out[300 + i] for i in range(30))} == {f"The main text of page {i} is long\nRead our paper" for i in (0, 1)}


def test_templates_below_many_elements(llm):
    """What all pages repeat goes at any depth."""
    from strandgraph.llm.html_extract import extract

    page = "<div>" * 40 + "<div class='m'>Menu</div><div class='s'>Story {i} is the longest part</div>" + "</div>" * 40
    rows = [(i, "http://g.example/", page.format(i=i)) for i in range(12)]
    out = {r.page_id: r.text for r in extract(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Story {i} is the longest part" for i in range(12))


@pytest.fixture(scope="module")
def log(llm):
    turn = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rows = turn(1, "hi", "ho") + turn(2, "hi", "ho", "more", "less") + turn(3, "hi", "ho", "more", "less") + turn(4, "hi", "other") + turn(5, "hi") + turn(6, "ho", "hi")
    rows += [(7, i, "user", f"t{i}") for i in range(200)] + [(8, i, "user", f"t{i}") for i in range(130)]
    rows += [(9, None, None, None), (None, 0, "user", "lost"), (10, 0, "user", "twin"), (10, 0, "user", "twin"), (11, -5, "user", "early")]
    return llm.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, k int")


def test_snapshots_collapse(log):
    from strandgraph.llm.chat_format import rendered

    out = rendered(log).collect()
    assert sorted({r.conv_id for r in out}, key=str) == sorted([2, 4, 6, 7, 9, None, 10, 11], key=str)
    of = {(r.conv_id, r.segment): r for r in out}
    assert of[2, 0].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nho<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n<|im_start|>assistant\nless<|im_end|>\n"
    assert [(of[7, g].first, of[7, g].n_turns) for g in range(4)] == [(0, 200), (64, 200), (128, 200), (192, 200)]
    assert of[10, 0].n_turns == 2 and of[9, -1].text == "<|im_start|>\n<|im_end|>\n"


def test_ties_are_ordered_as_in_sql(llm, tmp_path):
    import duckdb

    from strandgraph.llm.chat_format import rendered
    from strandgraph.llm.queries import CHAT_SQL

    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "c"), (2, 0, "user", "a"), (2, 0, "assistant", "c"), (2, 0, "user", "b"), (2, 1, "user", None), (3, None, None, "z"), (3, 0, "q", "")]
    t = llm.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, tie string")
    t.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = sorted(con.execute(CHAT_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in rendered(t).collect()), key=str) == want and {w[0] for w in want} == {2, 3}


def test_no_conversations(log):
    from strandgraph.llm.chat_format import rendered

    assert rendered(log.limit(0)).count() == 0


def test_chat_plan_is_native(log):
    from strandgraph.llm.chat_format import rendered

    plan = rendered(log)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
