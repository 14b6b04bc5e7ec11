import copy
import re
from collections import Counter

import pytest

from fleetsig.llm import templates

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav>'


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain  words\n here", "plain words here"), ("<p>a &amp; b&nbsp;c &lt;d&gt; &#233;", "a & b c <d> é"),
    (f"<html><head><title>T</title></head><body>{NAV}<article><h1>Head</h1><p><b>One<br><p>t<i>w</i>o</article><footer>x</footer>", "Head One two"),
    ("<article><p>a<script>var t='</p>';</script><style>p{}</style><form><input>q</form><div class='comments'>no</div><p>b</article>", "a b"),
    ("<article class='comment'>no</article><main><p>yes<aside>no</aside></main>", "yes"),
    ("<article>short</article><article>the longer one</article>", "short the longer one"),
    ("<div hidden>no</div><div style='display: none'>no</div><p>a<p>b", "a b"),
    ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one two x y"),
    ("<p>a</b></i></div>b<unknown>c</unknown> < d <", "abc < d <"),
    ("<article><div class='cookie-notice'>no</div><div class='admin'>yes</div></article>", "yes"),
    ("<article><p class='related-work'>kept</p><p class='related'>no</p><p class='related-links'>no</p>more of it</article>", "kept more of it"),
    ("<form id=f><header>H</header><p>a page in one form</p><input name=x></form>", "H a page in one form"),
    ("<form><article>a</article></form><form>b <button>c</button></form>", "a"),
    ("<article></article><main>m <aside>no</aside></main>", "m"),
    ("<article><nav>n</nav></article><p>rest of the page</p>", "rest of the page"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
])
def test_main_text(html, text):
    assert templates.main_text(html) == text


def test_templates_go_and_repeated_articles_stay(spark):
    head, foot = "<div class='top'><p>Site of the town</p></div>", "<div><p>All rights kept</p></div>"
    rows = [(i, f"http://town.org/{i}", f"<body>{head}<p>Story {i} of the day</p>{foot}") for i in range(20)]
    rows += [(100 + i, f"http://one.org/{i}", f"<body>{head}<p>alone {i}</p>") for i in range(2)]
    rows += [(200 + i, "http://copies.org/x", "<body><p>the same page</p><div>again</div>") for i in range(9)]
    rows += [(300 + i, f"http://art.org/{i}", f"{NAV}<article><p>quoted in every page</p><p>{i}</p></article>") for i in range(9)]
    rows += [(None, None, "<p>no url</p>"), (400, "no scheme", None), (0, "http://town.org/0", rows[0][2])]
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, host string, trees int, text string")
    got = sorted(((r.page, r.url, r.text, r.n_chars) for r in templates.extract(pages).collect()), key=repr)
    want = [(i, u, f"Story {i} of the day") for i, u, _ in rows[:20]] + [(100 + i, f"http://one.org/{i}", f"Site of the town alone {i}") for i in range(2)]
    want += [(200 + i, "http://copies.org/x", "the same page again") for i in range(9)]
    want += [(300 + i, f"http://art.org/{i}", f"{i}") for i in range(9)]  # what all articles of a host share is template
    want += [(None, None, "no url"), (400, "no scheme", ""), (0, "http://town.org/0", "Story 0 of the day")]
    assert got == sorted(((*w, len(w[2])) for w in want), key=repr)
    assert templates.extract(pages.limit(0)).collect() == []


def plain_extract(rows, share=0.3, least=3):
    """All pages of a host side by side: subtrees as nested tuples, counted over its different pages."""
    def shape(node):
        if isinstance(node, str):
            return " ".join(node.split())
        return (node.mark, *[s for s in map(shape, node.children) if s and s != ("", )])

    def has_text(x):
        return bool(x) if isinstance(x, str) else any(map(has_text, x[1:]))

    def textual(x):
        return x if isinstance(x, str) else (x[0], *[textual(c) for c in x[1:] if has_text(c)])

    def holds(node):
        return node.tag in ("article", "main", "body") or any(holds(c) for c in node.children if not isinstance(c, str))

    def trees(node):
        for c in node.children:
            if not isinstance(c, str):
                if not holds(c) and has_text(shape(c)):
                    yield c
                yield from trees(c)

    hosts = {}
    for _, url, html in rows:
        hosts.setdefault(host(url), set()).add(html or "")
    found = {}
    for name, pages in hosts.items():
        seen = Counter(x for p in pages for x in {repr(textual(shape(t))) for t in trees(templates.parse(p))})
        found[name] = {x for x, n in seen.items() if n >= least and n >= share * len(pages)}

    def text(node, gone):
        kept = copy.copy(node)
        kept.children = [
            c if isinstance(c, str) else text(c, gone) for c in node.children
            if isinstance(c, str) or (not c.dropped and (holds(c) or repr(textual(shape(c))) not in gone))
        ]
        return kept

    out = []
    for page, url, html in rows:
        root = text(templates.parse(html), found[host(url)])
        for holders in templates._holders(root):
            words = [t for t in (templates._text(n, frozenset(), {}) for n in holders) if t]
            if words:
                break
        out.append((page, url, " ".join(words)))
    return sorted(out, key=repr)


def host(url):
    rest = (url or "").partition("://")[2]
    return re.split("[/?#]", rest)[0].lower()


def test_equals_all_pages_of_a_host_side_by_side(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    rows += [
        (9000 + i, f"http://shared.org/{i}", f"<article><h1>Story {i}</h1><div class=x><p>Read our <b>other</b> site</p></div><p>text {i}</p>"
         f"<p>{i % 4} of four</p></article><div>same below</div>") for i in range(12)
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page, r.url, r.text) for r in templates.extract(frame).collect()), key=repr)
    assert got == plain_extract(rows)
    assert sum(r[2] == f"Story {r[0] - 9000} text {r[0] - 9000} {r[0] % 4} of four" for r in got) == 12
