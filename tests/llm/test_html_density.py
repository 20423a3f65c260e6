"""Pages on which density decides against comments and teasers that are articles themselves."""

import pyarrow.parquet as pq
import pytest

from skyloom.llm import html_text

STORY = "<h1>T</h1>" + "<p>The first long paragraph of the story goes on and on for a while.</p>" * 6
WANT = "\n\n".join(["T"] + ["The first long paragraph of the story goes on and on for a while."] * 6)
COMMENT = "<article{}><p>I liked it very much, and so did all the others here, I am sure.</p></article>"


@pytest.mark.parametrize("page", [
    f"<body><div class='story'>{STORY}</div><section class='comments'>{COMMENT.format(' class=comment')}</section></body>",
    f"<body><div class='story'>{STORY}</div><div class='more'><article><p>A teaser for another story.</p></article></div></body>",
    f"<body><article class='post'>{STORY}<div>{COMMENT.format(' class=comment')}</div></article></body>",
    f"<body><article class='post'>{STORY}</article><section class='comments'>{COMMENT.format('') * 12}</section></body>",
    f"<body><div id='banner'><article>{STORY}</article></div></body>",
    f"<body><div class='comments-on'><div class='story'>{STORY}</div></div></body>",
])
def test_story_alone(page):
    assert html_text.main_text(page) == WANT


def test_article_tags_are_not_needed():
    """Every page of sf0.01 gives the same text where its articles are plain divisions."""
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        plain = page.replace("<article", "<div").replace("</article", "</div")
        assert html_text.main_text(plain) == html_text.main_text(page)
