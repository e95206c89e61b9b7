from revisio.llm import wrappers

PAGE = """<html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="ad">Buy %d</div>%s<div class="cookie-notice">OK?</div>
<form>Search <input name=q><button>Go</button></form><aside>Side</aside><section id="comments"><article><p>First!</p></article></section><footer>&copy; me</footer></body></html>"""


def page(body, k=0):
    return PAGE % (k, body)


def by(spark, rows, cols="page_id long, url string, html string, host int, text string"):
    got = wrappers.main_text(spark.createDataFrame([(*r, 1, "x") for r in rows], cols)).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted(((r.page_id, r.text) for r in got), key=str)


def test_articles(spark):
    body = "<article><header><h1>A &lt;b&gt; \n c</h1></header><p><b>Bold\tnew<br><p>Next &eacute;&#33; <a href=x>link</a>s<ul><li>one<li>two</ul><table><tr><td>1<td>2</table><div class=share>Tweet</div>tail</article>"
    text = "A <b> c\nBold new\nNext é! links\none\ntwo\n1\n2\ntail"
    rows = [(1, "http://h/1", page(body)), (1, "http://h/1", page(body)), (2, None, page(body)), (3, "http://h/3", None), (4, "", ""), (5, "http://x/", "just text"),
            (6, "http://h/6", "<html><body><article><p>cut &am"), (7, "http://h/7", "<div>" * 5000 + "deep"), (None, "http://h/8", "<article>" + "<p>w w" * 20000)]
    want = [(1, text), (1, text), (2, text), (3, ""), (4, ""), (5, "just text"), (6, "cut &am"), (7, "deep"), (None, "\n".join(["w w"] * 20000))]
    assert by(spark, rows) == sorted(want, key=str)
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_slots_without_article(spark):
    rows = [(k, f"https://www.h.example/{k}", page(f"<div class=x><div class=y>Always here</div><h1>Title {k}</h1>" + "".join(f"<p>Text {j} of {k}</p>" for j in range(k % 4 + 1)) + "</div><div class=z><a href=1>More</a> <a href=2>links</a></div>", k)) for k in range(9)]
    assert by(spark, rows) == [(k, "\n".join([f"Title {k}"] + [f"Text {j} of {k}" for j in range(k % 4 + 1)])) for k in range(9)]


def test_wrapper_is_a_union_free_expression():
    def w(h):
        return wrappers.wrapper(wrappers.parse(h)[0])

    a = wrappers.merge(w("<h1>a</h1><p>same</p>"), w("<h1>b</h1><h2>q</h2><p>same</p><p>same</p>"))
    assert [(x[0], x[1], x[2], x[4] is True) for x in a[7]] == [("h1", False, False, True), ("h2", True, False, False), ("p", False, True, False)]
    assert [(x[0], x[2]) for x in w("<dl>" + "<dt>a<dd>b" * 3)[7][0][7]] == [("dt", True), ("dd", True)]


def test_copies_and_long_texts_are_not_constants(spark):
    copies = [(k, f"http://c/{k}", page("<div class=x><p>Main text of copies</p></div>", k)) for k in range(8)]
    others = [(k, f"http://o/{k}", page("<div class=x><p>Same text</p></div>" if k < 18 else f"<div class=y><p>Other {k}</p></div>", k)) for k in range(10, 20)]
    long = "a long text that goes on " * 40
    dated = [(k, f"http://d/{k}", page(f"<div class=x>{long}{k}{long}</div>", k)) for k in range(20, 30)]
    want = [(k, "Main text of copies") for k in range(8)] + [(k, "Same text" if k < 18 else f"Other {k}") for k in range(10, 20)] + [(k, f"{long}{k}{long}".strip()) for k in range(20, 30)]
    assert by(spark, copies + others + dated) == sorted(want, key=str)


def test_slots_decide_in_articles(spark):
    rows = [(k, f"http://a/{k}", page(f"<article><h1>Title {k}</h1><div class=x>Read us every day</div><p>Text {k}</p></article>", k)) for k in range(6)]
    same = [(k, f"http://s/{k}", page(f"<p>Page {k}</p><main><p>All of it constant</p></main>", k)) for k in range(10, 16)]
    few = [(k, f"http://f/{k}", page(f"<article><p>Text {k}</p><div class=x>Not enough pages</div></article>", k)) for k in range(20, 24)]
    want = [(k, f"Title {k}\nText {k}") for k in range(6)] + [(k, "All of it constant") for k in range(10, 16)] + [(k, f"Text {k}\nNot enough pages") for k in range(20, 24)]
    assert by(spark, rows + same + few) == sorted(want, key=str)


def test_classes_around_an_article(spark):
    layouts = ("has-sidebar", "elementor-widget-container", "header-fixed", "widget", "cookies x")
    rows = [(k, f"http://l{k}/", f"<body><nav>Menu</nav><div class='{c}' id=content-with-sidebar><article><p>Text</p><div class=share-box>Tweet</div></article></div>") for k, c in enumerate(layouts)]
    rows += [(7, "http://l7/", "<div class=has-sidebar><p>No article</p><div class=sidebar>Side</div></div>"), (8, "http://l8/", "<div class=post-comments><article>First!</article></div><article>Text</article>"),
             (9, "http://l9/", "<p>Text</p><div class=comments><article>First!</article></div>"), (10, "http://l10/", "<footer><article>x</article></footer>")]
    assert by(spark, rows) == sorted([(k, "Text") for k in (*range(5), 8, 9)] + [(7, "No article"), (10, "")], key=str)


def test_content_words_and_formulas_stay(spark):
    body = "<article><h1>T</h1><section class='related-work'><p>Others did</p></section><figure><img src=a><p class='banner-image-caption'>A flag</p></figure><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<div class='related-posts'>More</div></article>"
    assert by(spark, [(1, "http://h/1", page(body))]) == [(1, "T\nOthers did\nA flag\nWhere x=2 holds")]
