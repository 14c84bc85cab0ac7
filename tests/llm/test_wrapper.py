"""Article text of pages against what they were built from."""

import random
import time

import pytest

from weirline.llm import wrapper

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{margin:0}}</style><script>var t="</p>{i}";</script></head><body>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href="/{i}">menu {i}</a></li></ul></nav><!-- ad {i} --><div class="ad">buy {i}</div>
<div class="cookie-notice">We use cookies {i}</div><{box}><h1>Title&nbsp;{i} &amp; more</h1><p class=byline>The Daily Page</p><p><b>First {i}   para<br>goes on<p>Second &lt;para&gt; {i}</p>
<ul><li>one {i}<li>two</ul><form>name <input></form><aside>see {i}</aside><div class="comments"><p>nice {i}</p></div></{close}><aside class="sidebar">side {i}</aside><footer>&copy; {i}</footer>{end}"""


def page(i, box="article", end="</body></html>"):
    return PAGE.format(i=i, box=box, close=box.split()[0], end=end)


def want(i, byline=True):
    return "\n\n".join([f"Title {i} & more", *(["The Daily Page"] if byline else []), f"First {i} para goes on", f"Second <para> {i}", f"one {i}", "two"])


@pytest.mark.parametrize("box", ["article", "main", 'div id="x7"'])
def test_article_text(spark, box):
    rows = [(i, f"http://{'hot' if i % 3 else 'b'}.example.com/{i}", page(i, box, "" if i % 2 else "</body></html>"), "x") for i in range(4)]
    rows += [(90, None, None, "x"), (91, "http://c.org", "", "x"), (92, "", "plain words", "x"), (93, "http://c.org/", "<p>a &am b &#233;", "x"), (0, rows[0][1], rows[0][2], "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = wrapper.extract(frame).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert [text[i] for i in range(4)] == [want(i) for i in range(4)]
    assert (text[90], text[91], text[92], text[93]) == ("", "", "plain words", "a &am b é")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert wrapper.extract(frame.limit(0)).count() == 0


def test_text_that_never_varies_is_template(spark):
    """The boxed line is on every page of the host: known from the alignment, not from a name."""
    html = "<html><body><div><div>Printed on every page of this site.</div><h2>About {i}</h2><p>words of page {i}</p><p>more of {i}</p></div></body></html>"
    rows = [(i, f"http://h.example.org/{i}", html.format(i=i)) for i in range(8)]
    copies = [(20 + i, f"http://copies.org/{i}", html.format(i=0)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows + copies, "page_id long, url string, html string").repartition(4)).collect()}
    assert [got[i] for i in range(8)] == [f"About {i}\n\nwords of page {i}\n\nmore of {i}" for i in range(8)]
    assert {got[20 + i] for i in range(8)} == {"Printed on every page of this site.\n\nAbout 0\n\nwords of page 0\n\nmore of 0"}


def test_tree_matching_aligns_by_order_and_label():
    leaf = lambda x, *c: [x, 1, 1, list(c)]
    a = [leaf("h1"), leaf("div", leaf("p"), leaf("ul")), leaf("p")]
    b = [leaf("div", leaf("p")), leaf("h1"), leaf("div", leaf("ul"), leaf("p"), leaf("ul")), leaf("p")]
    assert wrapper.matched(a, b) == [(0, 1), (1, 2), (2, 3)]
    both = wrapper.merged(["html", 1, 1, a], ["html", 1, 1, b], 1)
    assert [c[0] for c in both[3]] == ["div", "h1", "div", "p"] and both[1] == 2


def test_very_long_and_broken_pages():
    assert wrapper.main_text("<p>" + "word " * 200_000 + "</p>", None) == ("word " * 200_000).strip()
    assert wrapper.main_text("<p>a<p>b" * 2000, None) == "\n\n".join(["a", "b"] * 2000)
    assert wrapper.main_text("<<<>>><p a='>x</p", None) is not None
    assert wrapper.main_text("</p></div>text<!-- open", None) == "text"


BOXED = "<html><body><div class=top><p>Printed on every page.</p></div><div id=body><h1>Head {i}</h1><p>first {i}</p><p>second {i}</p>{big}</div></body></html>"
LONG = [f"long point number {k} of the list" for k in range(12)]


@pytest.mark.parametrize("big", ["<ul>" + "".join(f"<li>{x} {{i}}" for x in LONG) + "</ul>", "<section>" + "".join(f"<p>{x} {{i}}</p>" for x in LONG) + "</section>",
                                 "<div>" + " ".join(LONG) + " {i}</div>"])
def test_siblings_of_a_heavy_block_stay(spark, big):
    rows = [(i, f"http://{'h' if i < 8 else 'few'}.org/{i}", BOXED.format(i=i, big=big.format(i=i))) for i in range(10)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(10):
        assert got[i].startswith(("" if i < 8 else "Printed on every page.\n\n") + f"Head {i}\n\nfirst {i}\n\nsecond {i}\n\n") and got[i].count("long point") == 12


def test_all_articles_and_mains_stay():
    assert wrapper.main_text("<div>by</div><article><p>one</p></article><article><p>two two</p></article>", None) == "one\n\ntwo two"
    assert wrapper.main_text("<main><p>one</p></main><div>x</div><main><p>two</p></main>", None) == "one\n\ntwo"
    assert wrapper.main_text("<main><h1>Head</h1><article><p>one</p></article></main>", None) == "Head\n\none"


def test_template_decides_where_an_article_exists(spark):
    html = "<body><div class=top><p>Same on all.</p></div><div><p>Lead of {i}</p></div><article><p>words of {i}</p></article></body>"
    rows = [(i, f"http://h.org/{i}", html.format(i=i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Lead of {i}\n\nwords of {i}" for i in range(8)}


def test_names_are_noise_on_boxes_and_by_their_head_word():
    text = "some running text of the page"
    for keep in ("<article class='post no-sidebar'><p>{}</p></article>", "<div class='content has-sidebar'><p>{}</p></div>", "<p class='related-work'>{}</p>",
                 "<h2 id='legal-basis'>{}</h2>", "<h3 id=copyright>{}</h3>", "<section id='comments-on-x'><p>{}</p></section>", "<div id='notice-period'>{}</div>"):
        assert wrapper.main_text("<div>" + keep.format("kept") + f"<p>{text}</p></div>", None) == "\n\n".join(["kept", text] if "article" not in keep else ["kept"]), keep
    for drop in ("site-footer", "cookie-notice", "sidebar-left", "related-posts", "ad", "share_buttons", "comments-section", "nav menu", "ad-container", "ads-2"):
        assert wrapper.main_text(f"<div><div class='{drop}'>gone</div><p>{text}</p></div>", None) == text, drop


def test_most_of_the_running_text_overrules_a_name():
    text = "word " * 40
    assert wrapper.main_text(f"<div><h1>Head</h1><div class=notice><p>{text}</p></div><div class=menu>m</div></div>", None) == f"Head\n\n{text.strip()}"
    assert wrapper.main_text(f"<div><article><p>short</p></article><div class=comments><p>{text}</p></div></div>", None) == "short"
    assert wrapper.main_text(f"<div><div hidden><p>{text}</p></div><p>short</p></div>", None) == "short"


def most_matched(a, b):
    """Nodes of the largest order-preserving matching, by trying every choice."""
    if a[0] != b[0]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max([best(x[1:], y)] + [most_matched(x[0], y[j]) + best(x[1:], y[j + 1:]) for j in range(len(y)) if x[0][0] == y[j][0]])

    return 1 + best(a[3], b[3])


def test_matching_equals_exhaustive_search():
    r = random.Random(3)

    def tree(depth):
        return [r.choice("ab"), 1, r.randrange(3), [tree(depth - 1) for _ in range(r.randrange(4))] if depth else []]

    for _ in range(300):
        a, b = tree(3), tree(3)
        a[0] = b[0] = "root"
        assert wrapper.Matching().weight(a, b) == most_matched(a, b)


def test_very_deep_pages():
    deep = "<div>" * 100_000 + "<p>kept</p>" + "<aside>gone</aside></div>" * 100_000 + "<p>after"
    template = wrapper.page_template(deep)
    for i in range(wrapper.PAGES + 1):
        template = wrapper.combine(template, wrapper.page_template("<div>" * 100_000 + f"<p>page {i}</p>"))
    assert wrapper.json.loads(wrapper.json.dumps(template)) == template
    assert wrapper.main_text(deep, None) == wrapper.main_text(deep, template) == "kept\n\nafter"
    assert wrapper.main_text("<b>" * 100_000 + "kept", template) == "kept"


def test_alignment_of_deep_differing_pages_is_quick():
    def page(extra, depth=60):
        out = "<p>x</p>"
        for _ in range(depth):
            out = f"<div><p>a</p>{extra}{out}<p>b</p></div>"
        return out

    start = time.monotonic()
    both = wrapper.combine(wrapper.page_template(page("")), wrapper.page_template(page("<h2>c</h2>")))
    assert time.monotonic() - start < 1 and both["tree"][1] == 2


def test_ids_and_numbers_make_no_new_nodes():
    total = None
    for i in range(400):
        own = wrapper.page_template(f"<div id=post-{i} class='post post-{i}'><p>Same line.</p><h1>T {i}</h1></div>")
        total = own if total is None else wrapper.combine(total, own)
    assert wrapper.n_nodes(total["tree"]) == 4
    assert wrapper.main_text("<div id=post-9 class='post post-9'><p>Same line.</p><h1>T 9</h1></div>", total) == "T 9"


def test_template_of_ever_new_classes_is_bounded(monkeypatch):
    monkeypatch.setattr(wrapper, "NODES", 50)
    total = None
    for i in range(300):
        name = "".join(chr(97 + int(c)) for c in str(i))
        own = wrapper.page_template(f"<div class=top><p>Same line.</p></div><div class={name}><p>text {i}</p></div>")
        total = own if total is None else wrapper.combine(total, own)
        assert wrapper.n_nodes(total["tree"]) <= 60
    assert wrapper.main_text("<div class=top><p>Same line.</p></div><div class=zz><p>text z</p></div>", total) == "text z"


def test_a_long_page_of_many_boxes_takes_time_in_proportion():
    html = "".join(f"<div><p>one {i}</p><ul><li>two</ul></div>" for i in range(20_000))
    template = wrapper.page_template(html)
    for i in range(6):
        template = wrapper.combine(template, wrapper.page_template(f"<div><p>p {i}</p><ul><li>{i}</ul></div>"))
    start = time.monotonic()
    assert wrapper.main_text(html, template).count("two") == 20_000
    assert time.monotonic() - start < 10
