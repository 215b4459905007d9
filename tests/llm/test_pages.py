"""Wrappers whose names have marks by chance keep their article; real sidebars, comments and forms go."""

import pytest

from framequery.llm import pages

LONG = ("A sentence of the story about tools and how they are lent. " * 8).strip()
MORE = ("Another paragraph that goes on about the same neighbours. " * 6).strip()
BODY = f"<p>{LONG}</p><p>{MORE}</p>"
WANT = f"{LONG}\n\n{MORE}"
SIDE = "<div class=sidebar><p>Read next: a few words on something else.</p><ul><li><a href=/a>One</a></li></ul></div>"
TALK = "<div id=comments><h3>Comments</h3><div class=comment><p>I liked this very much, thank you.</p></div></div>"
FORM = "<form action=/search><p>Search the site with many words</p><input name=q></form>"
AD = "<div class=ad>Buy now!</div>"


def text(body):
    page = pages.parse(f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>Foot</footer></body></html>")
    best = pages.best_container(page)
    return pages.main_text(page, best and best[0])


@pytest.mark.parametrize("wrapped", [
    f"<div class='layout with-sidebar'><article>{BODY}</article>{SIDE}</div>",
    f"<div class='layout with-sidebar'><div class=content>{BODY}</div>{SIDE}</div>",
    f"<div class='has-sidebar'>{BODY}{SIDE}</div>",
    f"<div class='has-sidebar'><div class='page comments-open'><article>{BODY}</article>{TALK}</div>{SIDE}</div>",
    f"<div class='page comments-open'>{BODY}{TALK}{AD}</div>",
    f"<form id=aspnetForm><div class=content>{BODY}</div>{SIDE}{AD}</form>",
    f"<form id=aspnetForm><div class='no-sidebar header-fixed'>{BODY}{FORM}</div>{TALK}</form>",
    f"<section class='widget-area-off'><main>{BODY}</main></section>{SIDE}{TALK}",
    f"<div class=wrap><article>{BODY}</article>{SIDE}{TALK}{FORM}{AD}</div>",
])
def test_no_article_is_lost_by_a_wrapper(wrapped):
    assert text(wrapped) == WANT


def test_the_header_of_a_post_stays_and_that_of_a_page_goes():
    assert text(f"<header><h1>The site</h1></header><div class=post><header><h1>Headline</h1></header>{BODY}</div>") == f"Headline\n\n{WANT}"
    assert text(f"<div class=post><div class='post-header'><h2>Headline</h2></div>{BODY}{TALK}</div>") == f"Headline\n\n{WANT}"
    assert text(f"<div class=page><header><h1>The site</h1><p>Its motto</p></header><div class=content>{BODY}</div></div>") == WANT
    assert text(f"<article><header><h1>Headline</h1></header>{BODY}</article>") == f"Headline\n\n{WANT}"


def test_what_is_marked_goes_even_if_it_is_long():
    talk = "<div id=comments>" + "".join(f"<article class=comment><p>{MORE} Number {k}.</p></article>" for k in range(12)) + "</div>"
    assert text(f"<article>{BODY}</article>{talk}") == WANT
    assert text(f"<div class=content>{BODY}</div>{talk}") == WANT
    assert text(f"<div class=content>{BODY}</div><div class='cookie-consent'><p>{MORE}</p></div>") == WANT
    assert text(f"<div class=content><p>Short news.</p></div><div class=notice><p>{MORE}</p></div>") == "Short news."


def test_pages_without_an_article():
    assert text(f"{AD}{FORM}") == ""
    assert text("") == ""
    assert text(f"<div class=sidebar>{BODY}</div>") == WANT  # all there is, and long
