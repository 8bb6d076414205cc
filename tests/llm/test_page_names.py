"""Names inside an article, and long attributes."""

import time

import pytest

from riskloom.llm import html_text


def _text(html, deleted=()):
    page = html_text.Page(html)
    page.judge()
    return page.text(set(deleted))


@pytest.mark.parametrize(
    "tag",
    ['h2 id="related-work"', 'section id="search-algorithms"', 'section id="social-policy"', 'p class="notice-period"', 'div class="share-prices"', 'li class="menu"', 'h2 id="comments"', 'div class="newsletter-box"'],
)
def test_slugs_inside_an_article_delete_nothing(tag):
    name = tag.split()[0]
    assert _text(f"<body><article><p>One</p><{tag}>two</{name}><p>three</p></article></body>") == "One two three"


@pytest.mark.parametrize(
    "tag",
    [
        'h2 id="related-work"', 'section id="search-algorithms"', 'p class="notice-period"', 'div class="share-prices"', 'h2 id="notice-of-results"',
        'p id="login-flow"', 'div class="post-header"', 'div id="menu-of-the-day"',
    ],
)
def test_slugs_on_a_page_without_article_delete_nothing(tag):
    name = tag.split()[0]
    assert _text(f"<body><p>One</p><{tag}>two</{name}><p>three</p></body>") == "One two three"


@pytest.mark.parametrize(
    "tag",
    [
        'div class="main-nav"', 'div id="site-footer"', 'ul class="nav-menu"', 'div class="cookie-banner"', 'div class="related-posts"', 'section id="comments"',
        'div id="disqus_thread"', 'div class="site-header"', 'span class="ad"', 'p class="notice"', 'div class="comment-list"', 'div class="sidebar-left"',
    ],
)
def test_names_on_a_page_without_article(tag):
    name = tag.split()[0]
    assert _text(f"<body><p>One</p><{tag}>two</{name}><p>three</p></body>") == "One three"


@pytest.mark.parametrize(
    "tag",
    [
        'div id="comments"', 'article class="comment"', 'article class="comment-12 even"', 'div class="comment"', 'div id="disqus_thread"', 'div id="respond"', 'div class="sidebar"',
        'div id="sidebar"', 'ul class="menu"', 'div class="newsletter"', 'div class="related-posts"', 'div class="notice"', 'div id="footer"',
    ],
)
def test_readers_comments_and_boxes_inside_an_article(tag):
    name = tag.split()[0]
    assert _text(f"<body><article><p>One</p><{tag}><b>two</b></{name}><p>three</p></article></body>") == "One three"


@pytest.mark.parametrize(
    "html,want",
    [("<p>a</p> b <!-- c", "a b"), ("<p>a <!-- b <i>c</i>", "a"), ("a <![CDATA[ b > c", "a"), ("a <![CDATA[ b ]]> c", "a c"), ("<p>a</p> <b", "a <b"), ("a <!x> b <!y", "a b <!y"), ("a </b", "a </b")],
)
def test_ends_of_pages(html, want):
    assert _text(html) == want


@pytest.mark.parametrize("tag", ['article id="social-policy"', 'article class="post category-social tag-search"', 'main id="search-algorithms"'])
def test_slugs_of_the_article_itself(tag):
    name = tag.split()[0]
    assert _text(f"<body><div>Menu</div><{tag}><p>One</p></{name}></body>") == "One"


@pytest.mark.parametrize("tag", ['div class="ad"', 'aside', 'section class="box comments"', 'div class="share-bar"', 'div role="navigation"', 'div hidden'])
def test_clear_names_inside_an_article(tag):
    name = tag.split()[0]
    assert _text(f"<body><article><p>One</p><{tag}><p>two</p></{name}><p>three</p></article></body>") == "One three"


def test_named_prose_inside_articles_goes_when_it_recurs(spark):
    body = "<article><p>Story {i}</p><div class='newsletter-box'><p>Write to us</p></div><section id='social-policy'><p>Copied</p></section></article>"
    rows = [(i, f"http://a.example/{i}", body.replace("{i}", str(i))) for i in range(6)] + [(9, "http://b.example/", body.replace("{i}", "9"))]
    got = {x["page_id"]: x["text"] for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} Copied" for i in range(6)) and got[9] == "Story 9 Write to us Copied"


@pytest.mark.parametrize("quote", ["'", '"'])
def test_attributes_have_no_length_limit(quote):
    for sign in (" x > y leaked", " x < y leaked", ""):
        value = "v" * 50_000 + sign
        page = html_text.Page(f"<article><p>One</p><div data-x={quote}{value}{quote} class=ad>two</div><p>three</p></article>")
        assert page.tags == ["article", "p", "div", "p"] and value in page.attributes[2]
        page.judge()
        assert page.text(set()) == "One three"


@pytest.mark.parametrize(
    "html,want",
    [('<p>a <b title="x>c</b> d', "a c d"), ("<p>1 < 2 <i>x</i>", "1 < 2 x"), ("<p>a <b <i>c</i>", "a <b c"), ("<p title='it'>a's <b>b's</b>", "a's b's"), ("a <b", "a <b")],
)
def test_broken_tags(html, want):
    assert _text(html) == want


@pytest.mark.parametrize("part", ['<a "<a" ', "<a '", "<a \"<a '", '<a "" ', '<a x="', "<a", "<a</a", "<!<!", "<!--", "<![CDATA["])
def test_broken_tags_take_linear_time(part):
    begin = time.process_time()
    html_text.Page(part * (400_000 // len(part)))
    assert time.process_time() - begin < 10
