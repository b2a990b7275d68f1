import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forage.llm import wrapper
from tests.llm.conftest import CLASHING


def text_of(source):
    return " ".join(b.text for b in wrapper.Page(source).content())


def test_elements_and_names_rule_out_what_is_no_article():
    assert text_of(
        """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li>Menu</ul></nav>
        <div class="cookie-notice">Cookies</div><div class="content-with-sidebar"><h1>Title &amp; more</h1><p>One<b>bold</b>
        two<p>Three &nbsp; f&#111;ur &lt;b&gt;<ul><li>a<li>b</ul><form>f<input></form><div id="comments"><p>reader</p></div><span class="ad">buy</span> tail<br>end</div>
        <aside>Side</aside><div style="display: none">gone</div><footer>foot</footer><!-- c <p>no</p> --><script>if (a<b) "</p>"</script><noscript>n</noscript></body></html>"""
    ) == "Title & more Onebold two Three four <b> a b tail end"


def test_the_article_comes_before_the_rest_of_the_page():
    page = "<body><p>teaser</p><article><header><h1>T</h1></header><p><b>x</i> y<br>z</article><p>after"
    assert text_of(page) == "T x y z"
    assert text_of("<p>teaser</p><main><p>m</main>") == "m"
    assert text_of("<div>teaser</div><div class='entry-content'><p>m</div>") == "m"


def test_odd_sources():
    assert text_of("") == ""
    assert text_of("plain < text & more") == "plain < text & more"
    assert text_of("<p>a<!-- never closed <p>b") == "a"
    assert text_of("<p a='x>y' b=\">\">a</p") == "a</p"
    assert text_of("<script>never closed <p>b") == ""
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert len(text_of("<p>word</p>" * 20000)) == 20000 * 5 - 1


trees = st.recursive(st.sampled_from("abc").map(lambda t: (t, [])), lambda c: st.tuples(st.sampled_from("abc"), st.lists(c, max_size=3)), max_leaves=7)


def tree_of(shape):
    labels, parents = [], []

    def add(node, parent):
        labels.append(ord(node[0]))
        parents.append(parent)
        own = len(labels) - 1
        for child in node[1]:
            add(child, own)

    add(shape, -1)
    return wrapper.Tree(labels, parents)


def best(a, b):
    if a[0] != b[0]:
        return 0
    table = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + best(x, y))
    return 1 + table[-1][-1]


@settings(max_examples=150, deadline=None)
@given(trees, trees)
def test_match_is_a_largest_one(a, b):
    x, y = tree_of(a), tree_of(b)
    found = wrapper.match(x, y)
    assert len(found) == best(a, b) and len(set(found.values())) == len(found)
    assert all(x.labels[p] == y.labels[q] for p, q in found.items())
    assert all(p == 0 or found[x.parents[p]] == y.parents[q] for p, q in found.items())


def test_long_lists_are_matched_in_order(monkeypatch):
    assert wrapper._in_order([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)] and wrapper._in_order([]) == []
    monkeypatch.setattr(wrapper, "MOST_PAIRS", 0)
    x, y = tree_of(("a", [("b", [("c", [])]), ("c", []), ("b", [])])), tree_of(("a", [("c", []), ("b", []), ("b", []), ("c", [])]))
    found = wrapper.match(x, y)
    pairs = sorted(found.items())
    assert len(pairs) == 3 and [q for _, q in pairs] == sorted(q for _, q in pairs)
    assert all(x.labels[p] == y.labels[q] and (p == 0 or found[x.parents[p]] == y.parents[q]) for p, q in pairs)


def test_deep_and_wide_pages(spark):
    """Thousands of nested elements, and thousands of siblings that all differ, end in bounded time."""
    deep = lambda k: "<div>" * 3000 + f"<p>core {k}</p><p>same on all</p>" + "</div>" * 3000
    wide = lambda k: "<div>" + "".join(f"<li><b>{j}</b>{'<p>x</p>' * ((j * (k + 3)) % 7)}<p>entry {k} {j}</p></li>" for j in range(2500)) + "</div>"
    rows = [(f"http://deep.example/{k}", deep(k)) for k in range(6)] + [(f"http://wide.example/{k}", wide(k)) for k in range(6)]
    rows += [(f"http://many.example/{k}", "<div>" + "".join(f"text {j if j != 4500 else 'z' + str(k)}<br><hr>" for j in range(5000)) + "</div>") for k in range(5)]
    began = time.monotonic()
    got = wrapper.digest(pages_of(spark, rows)).orderBy("page_id").collect()
    assert time.monotonic() - began < 120
    assert [r.text for r in got[:6]] == [f"core {k}" for k in range(6)]
    assert all(f"entry {k} 2499" in r.text for k, r in enumerate(got[6:12]))
    assert [r.text for r in got[12:]] == [f"text z{k}" for k in range(5)]


def page(k, prose, host="site.example", top="Latest stories from our newsroom"):
    body = "".join(f"<div><p>{prose(1000 * k + j, 12)}</p></div>" for j in range(1 + k % 4))
    return f"http://{host}/{k}", f"<html><body><div><div><b>{top}</b></div><div><h2>{prose(k, 4)}</h2>{body}</div><div>All rights reserved by the site</div></div></body></html>"


def pages_of(spark, rows):
    return spark.createDataFrame([(k, u, h, *("x" for _ in CLASHING)) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string" + "".join(f", {c} string" for c in CLASHING))


def test_what_stays_the_same_on_a_host_is_template(spark, prose):
    rows = [page(k, prose) for k in range(12)] + [page(k, prose, "small.example") for k in range(2)]
    rows += [page(3, prose, "copies.example")] * 9 + [(None, "<p>no url</p>"), ("http://x.example/", None), ("", ""), ("nonsense", "<p>n</p>")]
    got = wrapper.digest(pages_of(spark, rows)).orderBy("page_id").collect()
    assert [r.url for r in got] == [u for u, _ in rows]
    for r, (url, source) in zip(got, rows):
        want = text_of(source or "")
        if url and url.startswith("http://site."):
            want = want.removeprefix("Latest stories from our newsroom ").removesuffix(" All rights reserved by the site")
        assert r.text == want and r.n_chars == len(want)


def test_extract_keeps_other_columns(spark, prose):
    table = pages_of(spark, [page(k, prose) for k in range(5)])
    found = wrapper.extract(table)
    assert found.columns == [*table.columns, "text"] and {r.host for r in found.collect()} == {"x"}
    assert wrapper.digest(pages_of(spark, [])).count() == 0


def test_every_layout_of_a_host_has_its_template(spark, prose):
    def laid(k):
        shell = "<html><body><div class='top'><p>Read by all of the town</p></div>%s</body></html>"
        if k % 3 == 0:
            return shell % f"<div class='story'><p>Told by our own people</p><p>{prose(k, 30)}</p></div>"
        if k % 3 == 1:
            items = "".join(f"<div class='row'><div class='cell'><p>{prose(50 * k + i, 8)}</p></div></div>" for i in range(3 + k % 4))
            return shell % f"<div class='grid'><div class='hint'><p>Sorted by date of arrival</p></div>{items}</div>"
        return shell % f"<div class='goods'><div class='left'><div class='deep'><p>{prose(k, 9)}</p></div></div><div class='right'><p>Prices hold while stocks last</p><p>{prose(k + 500, 9)}</p></div></div>"

    rows = [(f"http://three.example/{k}", laid(k)) for k in range(30)]
    got = [r.text for r in wrapper.digest(pages_of(spark, rows)).orderBy("page_id").collect()]
    for constant in ("Read by all", "Told by our", "Sorted by date", "Prices hold"):
        assert not any(constant in t for t in got)
    assert all(prose(k, 30) == got[k] for k in range(0, 30, 3))


def test_the_layout_is_not_told_by_content_or_numbers():
    def name(source):
        return wrapper.layout_of(wrapper.Page(source))

    assert name("<div class='post-12'><p>a</p></div>") == name("<div class='post-7'><h2>t</h2><p>a<b>b</b></p><ul><li>c</ul></div>")
    assert name("<div class='post'><p>a</p></div>") != name("<div class='list'><p>a</p></div>")


@settings(max_examples=150, deadline=None)
@given(trees, trees)
def test_long_lists_are_matched_as_short_ones(a, b):
    """The size of lists decides how the table is filled, not what is matched."""
    x, y = tree_of(a), tree_of(b)
    short = wrapper.match(x, y)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(wrapper, "MOST_PAIRS", 0)
        assert wrapper.match(x, y) == short
        patch.setattr(wrapper._Level, "KEPT", 0)
        assert wrapper.match(x, y) == short


def test_long_lists_keep_the_pairs_that_a_change_shifts():
    """A list of 200 rows, of which the other page lacks one: only a table finds all others."""
    row = lambda k: ("d", [("p", [])] * (1 + k * k % 11))
    rows = [row(k) for k in range(200)]
    a, b = ("u", [("h", []), *rows, ("f", [])]), ("u", [("k", []), *rows[:3], *rows[4:], ("g", [])])
    found = wrapper.match(tree_of(a), tree_of(b))
    assert len(found) == best(a, b) == 1 + sum(1 + len(r[1]) for k, r in enumerate(rows) if k != 3)
