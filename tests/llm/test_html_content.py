import itertools

import numpy as np
import pytest

from slotline.llm import html_content as hc
from slotline.llm import html_tree as ht
from slotline.llm.page_layouts import labelled_pages


def text_of(page):
    return hc.main_texts([page], hc.layout_model())[0]


def test_blocks_of_odd_markup():
    tree = lambda page: [t for t in ht.parse(page).text if t is not None]
    assert tree("<p>a <b>b<i>c</b>d<br>e<p>f") == ["a bcd e", "f"]
    assert tree("a<!-- > <p> -->b<script>if (x<y) '</p>'</script>c<style>p{}</STYLE>d") == ["abcd"]
    assert tree("<ul><li>x<li>y<ul><li>z</ul></ul>w") == ["x", "y", "z", "w"]
    assert tree("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert tree("&lt;p&gt; &amp;amp; &#65;&#x42; &copy &nbsp;&eacute; &unknown; &amp &am") == ["<p> &amp; AB © é &unknown; & &am"]
    assert tree("<div title='a > b'>x</div></div></p>y</b>") == ["x", "y"]
    assert tree("<head><title>no</title><meta x><p>yes</p>") == ["yes"]
    assert tree("<select><option>no</select><svg><text>no</text></svg>yes<div cla") == ["yes"]
    assert tree("<p>1 < 2 and 3 <4 x") == ["1 < 2 and 3 <4 x"]
    assert tree("") == tree("   ") == tree("<!-- ") == tree("<div><p></p></div>") == []
    assert tree("<p>a&nbsp;  b\r\n\tc</p>") == ["a b c"]


@pytest.mark.parametrize("seed", range(4))
def test_messages_equal_enumeration(seed):
    """Marginals and the sum over all states, against all assignments of small trees."""
    rng = np.random.default_rng(seed)
    trees = []
    for n in (1, 5, 7):
        t = ht.Tree()
        for k in range(1, n):
            t.add(int(rng.integers(0, k)), ("<div>",), None, 0, False)
        trees.append(t)
    forest = hc.Forest(trees)
    n = len(forest.parent)
    node, edge = rng.normal(size=(n, 2)), rng.normal(size=(n, 2, 2))
    got = hc.sum_product(forest, node, edge)
    log_z = 0.0
    for a, b in zip(forest.first, forest.first[1:], strict=False):
        total, one, pair = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for states in itertools.product((0, 1), repeat=b - a):
            s = sum(node[a + k, x] for k, x in enumerate(states))
            s += sum(edge[a + k, states[forest.parent[a + k] - a], x] for k, x in enumerate(states) if k)
            w = np.exp(s)
            total += w
            one += w * np.array(states)
            for k in range(1, b - a):
                pair[k, states[forest.parent[a + k] - a], states[k]] += w
        assert np.allclose(got.marginal[a:b], one / total)
        assert np.allclose(got.pair[a + 1 : b], pair[1:] / total)
        log_z += np.log(total)
    assert abs(got.log_z - log_z) < 1e-9


def test_deep_tree():
    page = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert text_of(page) in ("", "deep")


def test_held_out_layouts():
    pages = labelled_pages(300, seed=99)
    forest = hc.Forest([ht.parse(p) for p in pages])
    b, y = hc.layout_model().beliefs(forest), forest.main
    leaf = forest.leaf
    right = ((b.marginal > 0.5) == y)[leaf]
    by_chars = np.average(right, weights=forest.chars[leaf])
    assert right.mean() > 0.97 and by_chars > 0.97


def test_kinds_of_parts():
    prose = "Some words that make a sentence of the usual length, more or less."
    article = f"<h1>Title</h1><p>{prose}</p><p>No.</p><p>{prose}</p>"
    want = f"Title\n{prose}\nNo.\n{prose}"
    for around in ("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id=main-content><div>{}</div></div>"):
        for other in (
            "<nav><a href=x>Home</a></nav>", f"<header>{prose}</header>", f"<footer>{prose}</footer>", f"<aside>{prose}</aside>", f"<div class=sidebar><p>{prose}</p></div>",
            f"<div class='cookie-notice'>{prose}</div>", f"<div class=ad>{prose}</div>", f"<form><p>{prose}</p><input></form>", f"<section id=comments><div class=comment><p>{prose}</p></div></section>", f"<div class='comments'><p>{prose}</p><p>{prose}</p></div>",
        ):
            assert text_of(f"<body>{other}{around.format(article)}") == want
            assert text_of(f"<body>{around.format(article)}{other}</body>") == want
            assert text_of(f"<body>{around.format(article + other)}</body>") == want


def test_parts_within_a_short_article():
    """Much that isn't main text within an article doesn't take the article's own blocks along."""
    prose = "Some words that make a sentence of the usual length, more or less."
    page = f"<body><article><h1>Title</h1><p>{prose}</p><div class='ad'><p>{prose}</p></div><p>Yes.</p><aside>{prose}</aside><div class='sidebar'>{prose}</div></article></body>"
    assert text_of(page) == f"Title\n{prose}\nYes."


def test_long_pages():
    """Hundreds of blocks don't outweigh what their container is called, in an article as among its comments."""
    odd, prose = "ODD $$ words || without an end", "Some words that make a sentence of the usual length, more or less."
    page = f"<article>{f'<p>{odd}</p>' * 400}<section class='comments'>{f'<p>{prose}</p>' * 400}</section></article>"
    assert text_of(f"<body><nav>{'<a href=x>Home</a>' * 9}</nav>{page}") == "\n".join([odd] * 400)


def test_rows(spark):
    page = "<html><body><nav><ul><li><a href='/a'>A</a></li></ul></nav><article><h1>T &amp; U</h1><p>One\n two.<br><p>Three.</article><footer>F</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "", ""), (None, "v", page), (1, "u", page), (4, "w", "<p>" + "word " * 400_000 + "</p>"), (5, "x", "no markup at all")]
    df = spark.createDataFrame([(*r, "t", 1, True) for r in rows], "page_id long, url string, html string, text string, n_chars int, main boolean")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in hc.extract(df).collect()}
    want = "T & U\nOne two.\nThree."
    assert got[1, "u"] == got[None, "v"] == (want, len(want)) and got[2, None] == got[3, ""] == ("", 0)
    assert got[4, "w"][1] in (0, 5 * 400_000 - 1)
    assert hc.extract(df).count() == len(rows) and hc.extract(df.limit(0)).count() == 0


def test_fit_on_a_table(spark):
    """Names that only a table's labelled pages have are learned from them; `x7` says nothing to the composed pages."""
    short = "<div class='x7'{}>Two words.</div><div class='y8'{}>Two words.</div>"
    marked = short.format(f" {ht.MARK}='0'", f" {ht.MARK}='1'")
    df = spark.createDataFrame([(i, marked + " " * i) for i in range(60)] + [(99, short.format("", "")), (100, None)], "page_id long, html string")
    sample = hc.labelled_sample(df, most=40)
    assert 10 < len(sample) <= 60 and all(ht.MARK in p for p in sample)
    assert hc.main_texts([short.format("", "").replace("Two", "Other", 1)], hc.fit(sample)) == ["Two words."]
    assert hc.main_texts(["<p>x</p>"], hc.fit([])) == [""]
