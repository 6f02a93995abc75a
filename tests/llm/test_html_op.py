import pytest
from pyspark.sql import functions as F

from sigspark.llm.html import extract, main_text, settle
from sigspark.llm.queries import op5_html_extraction

ARTICLE = "<article><h1>T &amp; t</h1><p>One  two\n three &#233;&nbsp;x<p>two <a href=x>link</a> four<ul><li>a<li>b</ul></article>"
WANT = "T & t\nOne two three é x\ntwo link four\na\nb"


@pytest.mark.parametrize(
    "around",
    [
        "{}",
        "<nav><ul><li><a href=/>Home</a></ul></nav>{}<footer>&copy; site</footer>",
        "<header>Site name</header><aside><p>The side of the page is here and it is of no use to the reader.</aside>{}",
        "<div class='ad banner'>The best of the best is here for you and for me to buy in the shop.</div>{}",
        "<div id=cookie-notice>We use cookies and the like to make it all the better for you and us.</div>{}",
        "<form><p>Mail <input name=x><button>Go</button></form>{}<section class=comments><p>I like it and the rest of the page.</section>",
        "<script>var t = '<p>The';</script><style>p{{}}</style><!-- <p>no -->{}<noscript>no</noscript>",
        "{}<div role='contentinfo'>About the site and the people of it</div><div hidden>x</div>",
        "<head><title>T</title></head><body>{}</body></html>",
    ],
)
def test_article_without_the_rest(around):
    assert main_text("<!DOCTYPE html><html>" + around.format(ARTICLE)) == WANT


def test_pages_without_article():
    rich = "The cat and the dog are in the house of the man with the hat, and it is late."
    assert main_text(f"<div><a href=a>Home</a> <a href=b>News</a></div><h1>Cats</h1><p>{rich}</p><p>Short</p><p>{rich}</p><div><a href=c>More</a></div>") == f"Cats\n{rich}\nShort\n{rich}"
    text = main_text(f"<p>{rich}</p><p>Short</p><p>{rich}</p><div><a href=c>More of this</a></div>")
    assert text == f"{rich}\nShort\n{rich}"


def test_second_pass():
    t, f, o = True, False, None
    assert settle([t, o, t], [9, 1, 9], [False] * len([9, 1, 9])) == [t, t, t]
    assert settle([f, o, o, t], [9, 1, 5, 9], [False] * len([9, 1, 5, 9])) == [f, f, t, t]
    assert settle([t, o, f], [9, 1, 9], [False] * len([9, 1, 9])) == [t, f, f]
    assert settle([o, o, t], [1, 1, 9], [False] * len([1, 1, 9])) == [t, t, t]
    assert settle([f, o, t], [9, 1, 9], [False, True, False]) == [f, t, t] and settle([t, o], [9, 1], [False, True]) == [t, t]
    assert settle([o, o], [1, 1], [False] * len([1, 1])) == [t, t] and settle([], [], [False] * len([])) == []


@pytest.mark.parametrize("html", ["", None, "<", "<p", "<p class=\"x", "<!--", "<script>x", "</p></div>", "<p>a</p" * 3, "&#xFFFFFFFF;&#0;&bogus;", "<a <b <c", "\x00", "<p>" * 3000, "<div class='" + "x" * 5000])
def test_broken_pages_do_not_crash(html):
    assert isinstance(main_text(html), str)


def test_open_tag_ends_with_the_page():
    assert main_text("<article><p>One</p><p>two<foo") == "One\ntwo"
    assert main_text("<article><p>One</p><p>a < b and 1<2") == "One\na < b and 1<2"


@pytest.mark.parametrize("tag", ["svg-icon", "video-player", "select-box", "template-x", "object-view"])
def test_custom_elements_are_not_raw(tag):
    assert main_text(f"<article><p>One</p><{tag} name=x>two</{tag}><p>three</p></article>") == "One\ntwo\nthree"


@pytest.mark.parametrize("raw", ["<svg/>", "<svg />", "<svg viewBox='0 0 1 1' class=\"i/>\"/>", "<math/>", "<svg a=b/c><path d='M'/></svg>", "<video src=a/></video>", "<script src=x>'</script >"])
def test_raw_elements_end_where_they_end(raw):
    assert main_text(f"<article><p>One {raw} two</p><p>three</p></article>") == "One two\nthree"


def test_links_in_the_article_stay():
    assert main_text("<nav><a href=n>Home</a></nav><article><h1><a href=x>Title</a></h1><p>Text here</p><ul><li><a href=y>Item</a></ul></article>") == "Title\nText here\nItem"


def test_rows(spark):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "é word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as __html", "4 as __main")
    got = extract(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(WANT)), (1, len(WANT)), (2, 0), (3, 699_999)]
    assert extract(df.limit(0)).count() == 0


def test_query(spark):
    got = op5_html_extraction(spark, "/root/testdata/sf0.001")
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    both = got.join(pages.select("page_id", "html"), "page_id").collect()
    assert len(both) == pages.count()
    for r in both:
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        for tag in ("p", "h1", "/h1", "/p"):
            inner = inner.replace(f"<{tag}>", "\0")
        for tag in ("<article>", "<b>", "</b>"):
            inner = inner.replace(tag, "")
        import html as std

        blocks = [" ".join(std.unescape(x).split()) for x in inner.replace("<br>", "\n").split("\0")]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert got.where(F.col("text") == "").count() == 0


STORY = "<h1>On the news of the day</h1>" + "".join(f"<p>This is the part number {k} of the story, and it is told in the words of the people who were there with it.</p>" for k in range(4))
PLAIN = "On the news of the day\n" + "\n".join(f"This is the part number {k} of the story, and it is told in the words of the people who were there with it." for k in range(4))
COMMENTS = "<p>" + "I am of the view that this is a story to be read by all, and it is not the first of its kind. " * 30 + "</p>"


@pytest.mark.parametrize("wrapper", ["has-sidebar", "post comments-open", "content no-comments", "share-story", "page with-sidebar nav-open", "promo"])
@pytest.mark.parametrize("element", ["article", "main", "div"])
def test_wrappers_named_by_a_state_or_around_the_article(wrapper, element):
    page = f'<body><nav><a href="/">Home</a></nav><div class="{wrapper}"><{element}>{STORY}</{element}></div><div class="sidebar"><p>Also of note on this site</p></div></body>'
    assert main_text(page) == PLAIN


@pytest.mark.parametrize("element", ["article", "div"])
def test_comments_stay_out_however_long(element):
    page = f'<{element}>{STORY}</{element}><div id="comments"><article class="comment-body">{COMMENTS}</article><div>{COMMENTS}</div></div>'
    assert main_text(page) == PLAIN
    inside = f'<article>{STORY}<section class="comments">{COMMENTS}</section></article>'
    assert main_text(inside) == PLAIN


def test_teasers_of_other_articles_stay_out():
    page = f'<main>{STORY}</main><div class="related-posts"><article><p>This is one of the stories that you may like to read on the site.</p></article></div>'
    assert main_text(page) == PLAIN
    advert = f'<article>{STORY}<div class="advert has-image"><p>Buy the best of the things that are on sale now.</p></div></article>'
    assert main_text(advert) == PLAIN
