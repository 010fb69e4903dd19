"""Main text of made pages, and conversations with quotes."""

import html
import re

from tidewire.llm import pages, replies


def test_articles_come_out_whole(small):
    want = {}
    for r in small["pages"].collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", body)]
        want[r.page_id] = "\n".join(p for p in parts if p)
    assert {r.page_id: r.text for r in pages.extracted(small["pages"]).collect()} == want


LONG = "This is a paragraph with quite some words in it, so that it is seen as text and kept. "


def test_furniture_goes_and_text_stays():
    tree = pages.trained()
    page = f"""<html><head><title>T</title><style>x</style></head><body><header><h1>Site name</h1></header>
      <div class="cookie-notice">{LONG}</div><main><h2>Head &amp; line</h2><p>{LONG}<b>bold</b>
      &lt;tag&gt;<script>var a = "<p>no</p>";</script></p><ul><li>one</li><li>two</li></ul>
      <div id="comments"><p>{LONG}</p></div></main><aside>{LONG}</aside><form><p>{LONG}</p></form><footer>{LONG}</footer>"""
    assert pages.main_text(page, tree) == f"Head & line\n{LONG}bold <tag>\none\ntwo"
    bare = f"""<div><a href=a>Home</a> <a href=b>News</a></div><h1>A title</h1><div>{LONG}</div><div>{LONG}</div>
      <div><a href=c>Read more of it</a></div>"""
    assert pages.main_text(bare, tree) == f"A title\n{LONG.strip()}\n{LONG.strip()}"


def test_wrappers_named_after_furniture_keep_their_article():
    tree = pages.trained()
    for name in ("site has-sidebar", "content no-comments", "page-with-header", "layout widget-area", "post tags-news",
                 "main-nav-open", "social-science", "widget", "promo banner"):
        page = f"""<body><nav><a href=a>Home</a></nav><div class="{name}"><article><h1>The head line</h1><p>{LONG}</p>
          <section class="share-prices"><p>Prices: {LONG}</p></section></article></div><div class="ad">Buy this now.</div></body>"""
        assert pages.main_text(page, tree) == f"The head line\n{LONG.strip()}\nPrices: {LONG.strip()}", name
    for name in ("comments", "comment-replies"):  # however long they are
        page = f"<article><p>{LONG}</p></article><div id='{name}'>" + f"<article><p>I think {LONG}</p></article>" * 9 + "</div>"
        assert pages.main_text(page, tree) == LONG.strip(), name


def test_a_teaser_article_does_not_hide_the_page():
    tree = pages.trained()
    body = "".join(f"<div>{LONG * 2}</div>" for _ in range(6))
    page = f"<div><a href=a>Home</a> <a href=b>News</a></div><article>Read <a href=c>more of it</a></article><h1>A title line</h1>{body}"
    got = pages.main_text(page, tree)
    assert got.count(LONG.strip()) == 12 and "A title line" in got and "Home" not in got


def test_open_tags_are_passed_over_once():
    import time

    tree = pages.trained()
    for page in ("<a " * 350_000, '<a "' * 250_000, "<a '" * 250_001 + ">x", "<p>" * 300_000, "<" * 1_000_000, "<!-" * 300_000, "</a" * 300_000):
        start = time.time()
        pages.main_text(f"<article><p>{LONG}</p></article>{page}", tree)
        assert time.time() - start < 8, page[:10]
    assert pages.main_text(f'<article><p>{LONG}</p><p title="open>{LONG}</p></article>', tree).count(LONG.strip()) == 2


def test_trained_tree_knows_its_table():
    tree = pages.trained()
    assert sum(pages.is_main(tree, r[:-1]) == bool(r[-1]) for r in pages.LABELLED) == len(pages.LABELLED)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>cut &am"), (None, "u", "<!-- open"), (None, "u", "<!-- open"), (4, "u", "<p>" * 20000 + "x")]
    got = pages.extracted(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text"] and got.count() == 6
    assert got.limit(0).count() == 0 and {r.text for r in got.collect() if r.page_id in (1, 2)} == {""}


def test_quotes_link_and_go(spark):
    rows = [(1, 0, "user", "First question\nover two lines"), (1, 1, "user", "Other   matter"), (1, 2, "assistant", "> first question\n> over two LINES\n\nAnswer one"),
            (1, 3, "assistant", "> other matter\nAnswer two"), (1, 4, "user", "On Monday X wrote:\n> > Over two lines\n> Answer one\nThanks"),
            (1, 5, "user", "> never said\nHm"), (2, 0, "user", "> Answer one\nalone"), (None, 1, "user", "Other matter"), (1, None, "user", "> Other matter"),
            (2, 1, None, None), (2, 2, "user", "")]
    got = {(r.conv_id, r.turn): r for r in replies.reply_ordered(
        spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, thread string")).collect()}
    assert len(got) == len(rows)
    assert [got[1, t].reply_to for t in range(6)] == [None, None, 0, 1, 2, None]
    assert [got[1, t].thread for t in range(6)] == [0, 1, 0, 1, 0, 5]
    assert got[1, 2].text == "Answer one" and got[1, 4].text == "Thanks" and got[1, 4].n_linked == 2
    assert got[2, 0].reply_to is None and got[2, 1].text == "" and got[1, None].reply_to is None
    order = sorted((k for k in got if k[0] == 1 and k[1] is not None), key=lambda k: (got[k].thread, k[1]))
    assert [t for _, t in order] == [0, 2, 4, 1, 3, 5]


def test_a_long_chain_has_one_root(spark):
    rows = [(1, t, "user", (f"> line {t - 1}\n" if t else "") + f"line {t}") for t in range(60)]
    got = replies.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.thread for r in got.collect()} == {0}


def test_conversations_without_quotes_keep_their_order(small):
    got = replies.chat_lines(replies.reply_ordered(small["conversations"])).collect()
    assert len(got) == small["conversations"].count() and all(r.thread == r.turn and r.reply_to is None for r in got)
