from vecloom.llm.html_extraction import align, content_slots, extract_text, infer_wrappers, main_text, page_expression, shape

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul>{nav}</ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
<article><h1>{title}</h1>{body}<aside>Related</aside><form><label>Mail</label><input><button>Send</button></form></article>
<section class="comments"><p>First!</p></section><div class="sidebar"><p>Links</p></div><footer>&copy; me</footer></body></html>"""


def page(title, paragraphs, links=3):
    return PAGE.format(
        title=title, nav="".join(f"<li><a href='/{k}'>l{k}</a></li>" for k in range(links)), body="".join(paragraphs)
    )


PAGES = [
    (1, "http://a.example/1", page("One &amp; only", ["<p>First  <b>bold</b>\n text.</p>", "<p>Second&nbsp;&eacute;</p>"])),
    (2, "http://a.example/2", page("Two", ["<p>Open<br>next<p>unclosed <i>it", "<ul><li>x<li>y</ul>"], 7)),
    (3, "http://b.example/1", "<div class=menu>home</div><div><p>Same</p><p>Story one</p></div><div class='foot'>Same end</div>"),
    (4, "http://b.example/2", "<div class=menu>home</div><div><p>Same</p><p>Story two</p></div><div class='foot'>Same end</div>"),
    (5, "http://c.example/", None),
    (6, None, "<main><p>No url</main>"),
    (7, "http://c.example/x", ""),
    (8, "nohost", "plain text only"),
    (None, "http://a.example/3", page("Null", ["<p>id</p>"])),
    (1, "http://a.example/1", page("One &amp; only", ["<p>again</p>"])),
    (9, "http://d.example", "<<<>< <p <b>a < b & c</p></x></p> <!-- open"),
]
WANT = {
    (1, "One & only\nFirst bold text.\nSecond é"),
    (2, "Two\nOpen\nnext\nunclosed it\nx\ny"),
    (5, ""),
    (6, "No url"),
    (7, ""),
    (None, "Null\nid"),
    (1, "One & only\nagain"),
}


def test_main_text(spark):
    rows = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, host string, slots int")
    found = extract_text(rows).collect()
    assert len(found) == len(PAGES)
    assert WANT <= {(r.page_id, r.text) for r in found}
    assert all(r.n_chars == len(r.text) for r in found)
    by_id = {r.page_id: r.text for r in found}
    assert by_id[8] == "plain text only" and by_id[3] == "Same\nStory one"
    assert extract_text(rows.limit(0)).collect() == []


def test_wrappers_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([p for p in PAGES if p[2]], "page_id long, url string, html string")
    one = {r.host: r.slots for r in infer_wrappers(rows.coalesce(1)).collect()}
    many = {r.host: r.slots for r in infer_wrappers(rows.repartition(7)).collect()}
    assert one == many
    assert one["a.example"] and all(">article" in s for s in one["a.example"])


def test_alignment_finds_groups_optionals_and_slots():
    a = page_expression("<div><h1>A</h1><p>x</p><p>y</p></div>")
    b = page_expression("<div><h1>B</h1><img src=x><p>z</p><hr></div>")
    assert shape(a) == "(div<(h1<#>)(p<#>)+>)"
    assert shape(align(a, b)) == "(div<(h1<#>)(p<#>)+(hr)?>)"
    pairs = page_expression("<dl><dt>a<dd>b<dt>c<dd>d</dl>")
    assert shape(pairs) == "(dl<(dt<#>)+(dd<#>)+>)"
    # Without a marked main part, text that never varies is template.
    same = align(page_expression("<div><p>menu</p></div><pre>one</pre>"), page_expression("<div><p>menu</p></div><pre>two</pre>"))
    assert content_slots(same) == ([], [">pre"])


def test_text_in_blocks():
    text = "<article><p> a\n b<br/>c</p>d<span>e</span>&lt;p&gt;<textarea>no</textarea></article>"
    marked, loose = map(frozenset, content_slots(page_expression(text)))
    assert main_text(text, marked, loose) == "a b\nc\nde<p>"
    assert main_text("<article></article><div>x</div>", marked, frozenset([">div"])) == ""
    assert main_text("<div>x</div>", marked, frozenset([">div"])) == "x"


def test_main_elements_in_skipped_parts_do_not_count(spark):
    pages = [
        (1, "http://f.example/1", "<p>Story</p><div class='footer-content'>imprint</div><aside><article>teaser</article></aside>"),
        (2, "http://g.example/1", "<p>Other</p><div class='cookie-text'>ok</div><div class='sidebar-content'>links</div>"),
    ]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(rows).collect()} == {1: "Story", 2: "Other"}


def test_names_behind_long_classes_are_seen(spark):
    long = " ".join(f"u-{c * 9}" for c in "abcdefghij")
    pages = [
        (1, "http://h.example/1", f"<p>no</p><div class='{long} article-body'><p>Story</p><div class='{long}' id='comments'>c</div></div>"),
        (2, "http://i.example/1", f"<div class='{long} sidebar'>side</div><div class='{long} x|y'>Text</div>"),
    ]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(rows).collect()} == {1: "Story", 2: "Text"}


def test_copies_of_a_page_keep_their_text(spark):
    own = "<div><h2>Head</h2></div><pre>one</pre><script>n={}</script>"
    pages = [(k, "http://j.example/1", own.format(k)) for k in range(3)]
    pages += [(10, None, "<p>twice</p>"), (11, None, "<p>twice</p>"), (12, "http://k.example/", "<p>Same</p><hr><p>Same</p>")]
    pages += [(20, "http://l.example/1", "<h2>menu</h2><pre>a</pre>"), (21, "http://l.example/2", "<h2>menu</h2><pre>b</pre>")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    want = {0: "Head\none", 1: "Head\none", 2: "Head\none", 10: "twice", 11: "twice", 12: "Same\nSame", 20: "a", 21: "b"}
    assert {r.page_id: r.text for r in extract_text(rows).collect()} == want


def test_text_that_all_articles_of_a_host_have_is_template(spark):
    story = lambda k: f"<p>Story {k} of many words.</p><p>Ask us, <b>dear</b> reader.</p><p>End {k} of it.</p>"
    pages = [(k, f"http://m.example/{k}", f"<article>{story(k)}<div class='x'>Buy now</div></article>") for k in range(4)]
    # Copies are no evidence, nor are two pages, nor versions of one text.
    pages += [(10 + k, "http://n.example/1", f"<article>{story(1)}</article>") for k in range(4)]
    pages += [(20 + k, f"http://o.example/{k}", f"<article>{story(k)}</article>") for k in range(2)]
    pages += [(30 + k, f"http://p.example/{k}", f"<article><p>{'Long text. ' * 9}</p><p>Version {k}</p></article>") for k in range(4)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    for parts in (1, 7):
        found = {r.page_id: r.text for r in extract_text(rows.repartition(parts)).collect()}
        for k in range(4):
            assert found[k] == f"Story {k} of many words.\nEnd {k} of it."
            assert found[10 + k] == "Story 1 of many words.\nAsk us, dear reader.\nEnd 1 of it."
            assert found[30 + k].endswith(f"Long text.\nVersion {k}")
        assert all("Ask us, dear reader." in found[20 + k] for k in range(2))


def test_deep_pages_give_their_text(spark):
    for opened in ("<font>", "<div>", "<b><div class=x>"):
        deep = f"<article><p>top</p>{opened * 10_000}<p>one</p><script>var x;</script><nav>menu</nav><p>two <i>three</i></p>"
        rows = [(1, "http://deep.example/1", deep), (2, "http://deep.example/2", deep.replace("two", "four"))]
        found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {(r.page_id, r.text) for r in found} == {(1, "top\none\ntwo three"), (2, "top\none\nfour three")}
