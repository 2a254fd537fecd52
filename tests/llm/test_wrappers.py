import html
import random
import re

import pytest

from fairloom.llm import wrappers as W
from fairloom.operators.storage import table


def text_of(page):
    p = W.Page(page)
    return W.main_text(p.texts, p.prose, p.ups, [True] * len(p.texts))


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<article><h1>T</h1><p>one<br>two <b>th</b>ree<p>four &lt;5&gt;&nbsp;&#233;</article>", "T\n\none two three\n\nfour <5> é"),
    ("<p><b>Title.<br><p>Next</b> more</p>tail", "Title.\n\nNext more\n\ntail"),
    ("<nav><a>x</a></nav><main><div class='share-buttons'>s</div><p>kept</p><section id=comments><p>nice</p></section></main><footer>f</footer>", "kept"),
    ("<body class='no-sidebar'><header><h1>Site</h1></header><div class='post-content has-ads-no'><article><header><h2>Head</h2><p>by X</p></header><p>Body</p><footer>meta</footer></article></div>", "Head\n\nBody"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><dl><dt>f<dd>g</dl></article>", "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng"),
    ("<article><p>a <button>Buy</button> b <select><option>1<option>2</select> c</p><form><p>mail</p></form><script>if (a<b) '</p>'</script><style>p{}</style>d</article>", "a b c\n\nd"),
    ("<article><!-- <p>no</p> --><p title='a>b'>x < y</p><p hidden>gone</p><p>cut <a href='", "x < y\n\ncut"),
    ("<head><title>no</title><p>yes</p>", "yes"),
    ("<article><div role=alert>no</div><aside>no</aside><p>yes <span class=ad>no</span>too</p></article>", "yes too"),
    ("<article class=comment>c</article><article>real</article>", "real"),
    ("<div>" * 500 + "deep" + "</div>" * 500 + "<p>after</p>", "deep\n\nafter"),
])
def test_main_text_of_one_page(page, want):
    assert text_of(page) == want


def test_no_marked_element():
    links = "<ul>" + "<li><a href=x>some link text</a></li>" * 9 + "</ul>"
    page = f"<div id=q1>{links}</div><div id=q2><div>{'<p>words of the text, ' * 9}</div></div><div id=q3>short line</div>"
    assert text_of(page) == "\n\n".join(["words of the text,"] * 9)


def naive(a, b, path_a="0", path_b="0"):
    """Size of the largest matching, by plain recursion."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), naive(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a[1], b[1])


def drawn(rnd, depth):
    return rnd.choice("xyz") if depth else "r", [drawn(rnd, depth + 1) for _ in range(rnd.randint(0, 3))] if depth < 3 else []


def spelled(t):
    return t[0] + ("(" + "".join(map(spelled, t[1])) + ")" if t[1] else ",")


def test_simple_tree_matching_is_largest_and_keeps_order():
    rnd = random.Random(3)
    for _ in range(150):
        a, b = spelled(x := drawn(rnd, 0)), spelled(y := drawn(rnd, 0))
        match = W.matched(a, b)
        (kinds_a, below_a), (kinds_b, below_b) = W.tree(a), W.tree(b)
        pairs = [(i, j) for j, i in enumerate(match) if i >= 0]
        assert len(pairs) == naive(x, y) and all(kinds_a[i] == kinds_b[j] for i, j in pairs)
        assert [i for i, _ in pairs] == sorted({i for i, _ in pairs})
        up_a, up_b = ({c: p for p, cs in enumerate(below) for c in cs} for below in (below_a, below_b))
        assert all((up_a[i], up_b[j]) in pairs for i, j in pairs if j)


@pytest.mark.parametrize("limit", [W.BROADCAST_BYTES, -1])
def test_constant_text_is_template(spark, monkeypatch, limit):
    monkeypatch.setattr(W, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(W, "DEALT", 4)
    rnd = random.Random(7)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows, want = [], {}
    for i in range(40):
        paras = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(rnd.randint(1, 4))]
        if i in (7, 9):
            paras = [" ".join(words * 2)]  # copies
        shared = ["The license of all our texts."] if i % 3 == 0 else []
        body = "".join(f"<p>{p}</p>" for p in [*paras, *shared])
        rows.append((i, f"https://{'www.' * (i % 2)}one.example:80/{i}", f"<div class=z1><p>Welcome to the site</p></div><div class=z2>{body}<p>Read more of us</p></div>"))
        want[i] = "\n\n".join([*paras, *shared])
    rows += [(50, "https://two.example/a", "<div><p>Welcome to the site of two</p></div>"), (51, None, None), (None, "nonsense", ""), (50, "https://two.example/a", "<div><p>Welcome to the site of two</p></div>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = [(r.page_id, r.text, r.n_chars) for r in W.extracted(pages).collect()]
    assert sorted(got, key=repr) == sorted([(i, t, len(t)) for i, t in want.items()] + 2 * [(50, "Welcome to the site of two", 26)] + [(51, "", 0), (None, "", 0)], key=repr)
    assert W.extracted(pages.limit(0)).count() == 0


def test_given_pages_against_a_pattern(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")

    def plain(page):
        inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        return "\n\n".join(p for p in parts if p)

    want = sorted((r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in pages.collect())
    assert sorted(map(tuple, W.extracted(pages).collect())) == want
