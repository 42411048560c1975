"""Main texts of pages whose names mislead, that have none, or that a form wraps."""

import pytest

from robustspark.llm import html

TEXT = [f"The {w} of the valley was measured again this spring, and the report gives the figures for every station in turn." for w in ("river", "forest", "harbour", "road")]
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/a'>News</a></li><li><a href='/b'>Contact us</a></li></ul>"


def page(open_, close, body="<body>"):
    inner = "".join(f"<p>{t}</p>" for t in TEXT)
    return f"<html><head><title>x</title></head>{body}<nav>{MENU}</nav>{open_}<h1>Measured again</h1>{inner}{close}<footer><p>\xa9 2024 All rights reserved</p></footer></body></html>"


CASES = {
    "football": page('<article class="post category-football">', "</article>"), "legal": page('<article class="post category-legal">', "</article>"), "social": page('<article class="post tag-social-media">', "</article>"),
    "commentary": page('<div class="commentary">', "</div>"), "responsive": page('<div class="responsive">', "</div>"), "fixed": page('<div class="container">', "</div>", '<body class="navbar-fixed">'),
    "sidebar": page("<article>", "</article>", '<body class="has-sidebar">'), "plain": page("<article>", "</article>"), "nameless": page("<div>", "</div>"), "searchable": page('<main class="searchable navigable">', "</main>"),
    "form": "<html><body><form id='form1' method='post'>" + page("<div class='content'>", "</div>").split("<body>")[1].replace("</body></html>", "") + "</form></body></html>",
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_texts_stay_and_menus_go(name):
    text, _, _ = html.main_text(CASES[name], html.trained())
    got = text.split("\n\n")
    assert [t for t in got if t in TEXT] == TEXT
    assert not {"Home", "News", "Contact us"} & set(got) and "All rights" not in text


def test_a_form_within_a_page_goes():
    form = "<form><p>Your name and your message, please, with all the details that you have at hand.</p><input></form>"
    text, _, _ = html.main_text(page("<article>", form + "</article>"), html.trained())
    assert "Your name" not in text and TEXT[0] in text


def test_comments_go():
    comment = "".join(f"<div class='comment'><p>I liked this one, says reader {k} of the paper at some length.</p></div>" for k in range(3))
    text, _, _ = html.main_text(page("<article>", "</article><section id='comments'>" + comment + "</section>"), html.trained())
    assert "I liked this one" not in text and TEXT[3] in text
