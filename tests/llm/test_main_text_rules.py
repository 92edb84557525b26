"""Block rules of main text on pages whose markup does not name the article, or names it wrongly."""

import pyarrow.parquet as pq
from skirmish.llm import main_text

PROSE = "The cat of the house is in the garden with the dog and it is not at all amused by what they are up to. "
LONG = (PROSE * 3).strip()


def test_an_article_is_evidence_not_the_answer():
    teaser = "<article><h2><a href=x>Another story</a></h2><p>Short teaser.</p></article>"
    assert main_text.main_blocks(f"{teaser}<div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>") == [LONG, "Short one.", LONG]
    posts = f"<article><p>{LONG}</p><ul><li><a href=1>one two</a></li></ul><p>Short one.</p></article>"
    assert main_text.main_blocks(posts * 2) == [LONG, "Short one."] * 2  # a list of links is none the better for where it lies
    assert main_text.main_blocks(f"<article><p>{LONG}</p></article><p>after</p>") == [LONG]


def test_pages_without_article_tags():
    """The rules decide the blocks of the given pages once their article is a div."""
    found = total = 0
    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        whole = main_text.main_blocks(page)
        got = main_text.main_blocks(page.replace("<article>", "<div>").replace("</article>", "</div>"))
        assert set(got) <= set(whole)
        found, total = found + sum(map(len, got)), total + sum(map(len, whole))
    assert found > 0.75 * total


def test_a_class_name_hides_no_article():
    body = f"<p>{LONG}</p><p>Short one.</p>"
    for page in (f"<div class='site-content has-sidebar'><article>{body}</article></div>", f"<div class='no-sidebar'>{body}<p>{LONG}</p></div>",
                 f"<main class='nav-open'>{body}</main>", f"<article class='post share-buttons'>{body}</article>",
                 f"<div class='social'><div id='nav'><article>{body}</article></div></div>"):
        assert main_text.main_blocks(page)[:2] == [LONG, "Short one."]
    assert main_text.main_blocks(f"<div class='banner'><p>{LONG}</p></div>") == [LONG]
    assert main_text.main_blocks(f"<div class='page-header-wrap'><p>{LONG}</p></div>") == [LONG]
    hidden = f"<div class='comments'><article class='comment'><p>{LONG} A comment.</p></article></div><div class='cookie-notice'>We use cookies</div>"
    assert main_text.main_blocks(f"<article>{body}</article>{hidden}") == [LONG, "Short one."]
    assert main_text.main_blocks(f"<p>{LONG}</p>{hidden}") == [LONG]


def test_an_empty_drawing_ends_at_once():
    for drawing in ("<svg/>", "<svg class='a' />", "<math/>"):
        assert main_text.main_blocks(f"<p>{drawing}{LONG}</p><svg><text>no</text></svg><p>{LONG}</p>") == [LONG, LONG]


def test_names_of_boilerplate_hide_what_is_not_the_article():
    names = "comment-body comment-list user-comments cookie-banner sidebar-left site-footer related-posts newsletter-box ad-slot".split()
    for name in names:
        aside = f"<div class='{name}'><p>{LONG} Aside.</p><p>Short aside.</p></div>"
        for tag in ("article", "div", "section"):
            page = f"<{tag}><h1>A title</h1><p>{LONG}</p><p>{LONG} More.</p></{tag}>"
            want = ["A title", LONG, f"{LONG} More."]
            assert main_text.main_blocks(page + aside) == main_text.main_blocks(aside + page) == want, (name, tag)
            assert main_text.main_blocks(f"<div class='{name}'>{page}</div>") == want  # most of the page's text lies in it


def test_short_blocks_beside_good_ones_are_text():
    body = f"<div><p>Short first.</p><p>{LONG}</p><p>bar | bar | bar | bar | bar | bar | bar | bar | bar | bar | bar | bar | bar |</p><p>Short last.</p></div>"
    got = main_text.main_blocks(f"<div><p>Menu</p></div>{body}<p>\N{COPYRIGHT SIGN} owner</p>")
    assert len(got) == 4 and got[0] == "Short first." and got[-1] == "Short last."


def test_hand_labelled_page():
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body class="home"><header><a href=/>Site</a></header>
      <nav><ul><li><a href=1>One</a></li></ul></nav><div class="cookie-bar notice"><p>{LONG}</p></div>
      <div id="content"><h1>Title &amp; more</h1><p>{LONG}</p><aside><p>{LONG}</p></aside><h2>Part</h2><p>{LONG}</p><p>Fin.</p>
      <form><p>{LONG}</p></form></div><div class="comments"><h3>Comments</h3><p>{LONG}</p></div><footer><p>{LONG}</p></footer></body></html>"""
    assert main_text.main_blocks(page) == ["Title & more", LONG, "Part", LONG, "Fin."]


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<div>{}".format, "<!{}".format, "<li>{}".format, "<div class=ad-x>{}".format, "</div>{}".format, "<div><p>x{}".format):
        start = time.perf_counter()
        main_text.main_blocks(page("") * 50_000 + "x")
        assert time.perf_counter() - start < 5
