from eventide.llm.op6_html import LABELLED, count_words, extract, main_text, table, tree

ARTICLE = "<html><head><title>T</title><style>p{}</style></head><body>%s</body></html>"


def test_the_labelled_table_is_learnt():
    assert len(table()) == len(LABELLED)
    for row in table():
        node = tree()
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        assert node == row[-1]


def test_article_without_what_surrounds_it():
    page = ARTICLE % """<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a><li><a href=/b>About</a></ul></nav>
<!-- <p>not this</p> --><div class="ad-box">Buy this wonderful thing today, it is the best thing that you have ever seen in your life</div>
<div id="cookieNotice"><p>We use cookies to give you the best experience on our site, and you agree to that by reading on.</p></div>
<article><header><h2>The &eacute;vent &amp; more</h2></header><p>First<br>line   with <a href="x">one link</a> in it, a &lt; b &#x41;.
<p>Short.</p><script>var t="</p><p>no</p>";</script><ul><li>Item one</li><li>Item two</li></ul>
<form><label>Your name</label><input></form><aside>By the way, this is an aside of the article.</aside>
<div class="share">Tweet this</div><section class="comments"><h3>Comments</h3><p>Great article, I have read it twice and told my friends.</p></section>
</article><div class="sidebar"><p>Other things that you might want to read on this site, one after another.</p></div>
<footer>&copy; 2020 &middot; imprint</footer>"""
    assert main_text(page) == "The évent & more\n\nFirst line with one link in it, a < b A.\n\nShort.\n\nItem one\n\nItem two"


def test_without_an_article_element():
    long = "This is a paragraph of running text that is long enough to be told from a menu by its number of words alone."
    page = ARTICLE % f"<div><a href=1>One</a> <a href=2>Two</a></div><div><h1>Heading here</h1><p>{long}</p><p>{long}</p></div><div><a href=3>Next</a></div>"
    assert main_text(page) == f"Heading here\n\n{long}\n\n{long}"


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("   ") == ""
    assert main_text("<article><p>Cut off in a tag <a hre") == "Cut off in a tag"
    assert main_text("<article><p>Open comment <!-- never closed <p>x") == "Open comment"
    assert main_text("<article><p>Text<script>never closed <p>x") == "Text"
    assert main_text('<article><p class="a>b">Quoted > sign</p></div></p></article>') == "Quoted > sign"
    assert main_text("<article><p>5 < 6 & 7 &nbsp; 8 &unknown; &#0;</p>") .startswith("5 < 6 & 7 8 &unknown;")
    deep = "<div>" * 3000 + "<article><p>deep</p></article>"
    assert main_text(deep) == "deep"
    assert len(main_text("<article>" + "<p>word " * 50_000)) == 50_000 * 6 - 2


def test_rows(spark):
    schema = "page_id BIGINT, url STRING, html STRING, text STRING, n_chars STRING"
    rows = [(1, "u", "<article><p>naïve 😀</p></article>", "clash", "x"), (2, None, None, None, None), (None, "v", "", "", ""),
            (1, "u", "<article><p>naïve 😀</p></article>", "clash", "x")]
    got = extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "naïve 😀", 7), (2, None, "", 0), (None, "v", "", 0), (1, "u", "naïve 😀", 7)], key=str)
    assert extract(spark.createDataFrame([], schema)).collect() == []


def test_given_pages_hold_their_article(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>"):r.html.index("</article>")].replace("<br>", " ").replace("<b>", "")
        parts = [" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:p|h1|article)>", inner)]
        assert texts[r.page_id] == "\n\n".join(p for p in parts if p)


LONG = "This is a paragraph of running text that is long enough to be told from a menu by its number of words alone."


def test_linked_blocks_of_an_article_stay():
    menu = "<ul>" + "".join(f"<li><a href={i}>Entry {i}</a></li>" for i in range(5)) + "</ul>"
    page = ARTICLE % (f"<nav>{menu}</nav><article><h1><a href=p>The permalink</a></h1><p>{LONG}</p><p><a href=s>Only a linked sentence stands here</a></p>"
                      f"<h2><a href=#x>Second part</a></h2><p>{LONG}</p><ul><li><a href=1>A long linked entry of a list of sources, number one</a></li>"
                      f"<li><a href=2>A long linked entry of a list of sources, number two</a></li></ul><p>{LONG}</p>{menu}</article>")
    assert main_text(page) == "\n\n".join([
        "The permalink", LONG, "Only a linked sentence stands here", "Second part", LONG, "A long linked entry of a list of sources, number one",
        "A long linked entry of a list of sources, number two", LONG])


def test_short_last_paragraph_and_linked_heading_without_an_article():
    menu = "<div><a href=1>One</a></div><div><a href=2>Two</a></div>"
    page = ARTICLE % f"{menu}<div><h1><a href=p>The permalink</a></h1><p>{LONG} {LONG}</p><p>{LONG} {LONG}</p><p>%s</p></div>{menu}"
    for last in ("That is all that there was to say.", "The end."):
        assert main_text(page % last) == "\n\n".join(["The permalink", f"{LONG} {LONG}", f"{LONG} {LONG}", last])
    assert main_text((page % "The end.")[:-len(menu) - len("</body></html>")]).endswith("The end.")


def test_entries_before_a_text_are_no_text():
    page = ARTICLE % f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><p>{LONG} {LONG}</p><p>{LONG}</p>"
    assert main_text(page) == f"{LONG} {LONG}\n\n{LONG}"


def test_names_of_the_page_mark_nothing():
    for page in ('<body class="single comments-open"><article id="post-banner" class="post sidebar"><p>Text</p></article></body>',
                 '<main class="has-sidebar widget"><article class="social"><p>Text</p></article></main>',
                 '<article><div class="no-sidebar"><p>Text</p></div></article>',
                 '<article><section class="layout--with-comments hasBanner"><p>Text</p></section></article>'):
        assert main_text(page) == "Text"
    assert main_text('<article><p>Text</p><article class="comment"><p>Other</p></article><div class="sidebar-no-border">Other</div></article>') == "Text"
    assert main_text('<article hidden><p>Other</p></article><article><p>Text</p></article>') == "Text"


def body(*parts):
    menu = "<div><a href=1>One</a></div><div><a href=2>Two</a></div><div><a href=3>Three</a></div>"
    return ARTICLE % (menu + "<div>" + "".join(parts) + "</div>" + menu)


def test_scripts_without_spaces_are_counted_by_characters():
    assert count_words("漢字かな交じり文の段落") >= 5 and count_words("naïve café") == 2 and count_words("") == 0 and count_words("漢") == 1
    text = "这是一个没有文章元素的页面上的段落，它足够长，可以与菜单区分开来，所以它应该被保留下来作为正文的一部分。"
    assert main_text(body(f"<p>{text}</p>", f"<p>{text}</p>")) == f"{text}\n\n{text}"


def test_short_blocks_between_and_after_dense_ones_stay():
    lines = ["Yes.", "No, I said.", "Why not?", "Because.", "I see.", "Well then."]
    page = body(f"<p>{LONG}</p>", *[f"<p>{x}</p>" for x in lines], f"<p>{LONG}</p>")
    assert main_text(page) == "\n\n".join([LONG, *lines, LONG])
    items = ["Flour", "Two eggs", "Some milk", "A bit of salt"]
    assert main_text(body(f"<p>{LONG}</p><ul>", *[f"<li>{x}</li>" for x in items], "</ul>")) == "\n\n".join([LONG, *items])
    assert main_text(body(f"<p>{LONG}</p><table><tr>", *[f"<td>{x}</td>" for x in items], "</tr></table>")) == "\n\n".join([LONG, *items])


def test_short_pages_give_what_they_have():
    line = "Only ten words stand on this page in all here."
    assert main_text(body(f"<h1>A heading</h1><p>{line}</p>")) == f"A heading\n\n{line}"
    assert main_text(body("")) == "" and main_text("<nav><p>x</p></nav><footer>y</footer>") == ""


def test_marks_on_every_tag_and_weighed_with_density():
    page = f'<article><p>{LONG}</p><p class="advert">{LONG}</p><h2 class="related">More of this</h2><pre id="sponsored">{LONG}</pre><p>{LONG}</p></article>'
    assert main_text(page) == f"{LONG}\n\n{LONG}"
    for name in ("search", "privacy", "copyright-law"):
        page = f'<article><section id="{name}"><p>{LONG}</p><p>Short one</p></section><p>{LONG}</p></article>'
        assert main_text(page) == f"{LONG}\n\n{LONG}"
    assert main_text(f'<article><p>{LONG}</p><div class="tags">one two</div></article>') == LONG


def test_buttons_and_formulas_within_sentences_stay():
    assert main_text("<article><p>Press <button>OK</button> and get <math><mi>x</mi><mo>=</mo><mn>1</mn></math> back.</p></article>") == "Press OK and get x=1 back."
    assert main_text(f"<article><p>{LONG}</p><div><button>Share</button> <button>Like</button></div></article>") == LONG
