"""Operator 3 where a word of boilerplate stands in the class of what wraps the article."""

from __future__ import annotations

import pytest

from matchloom.llm import html_extract

TEXT = "A paragraph of the story, with commas, that is long enough to be taken for a part of an article."
STORY = f"<p>{TEXT}</p>" * 3


@pytest.mark.parametrize("start, end", [('<div class="has-navbar">', "</div>"), ('<article class="post comments-open">', "</article>"), ('<div class="with-sidebar"><main>', "</main></div>")])
def test_a_marked_wrapper_keeps_its_article(start, end):
    page = f'<html><body>{start}{STORY}<div class="sidebar"><p>Other, things, to read, that are no part of it.</p></div>{end}</body></html>'
    assert html_extract.blocks(page) == [TEXT] * 3


def test_long_comments_beside_the_article_go():
    comments = "<p>Reader one says: great article, thanks, love it, really do, and more of that.</p>" * 9
    assert html_extract.blocks(f'<body><article>{STORY}</article><div id="comments">{comments}</div></body>') == [TEXT] * 3
