"""Main texts against a plain version on the standard library's parser, and the markup that could mislead the rules or take long."""

import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from tesserae.llm import html_text

PART = "<p>This is the article that we are all here to read and it has many of the words that one would expect in a text of its length, which is long enough.</p>"
ASIDE = "<div class='sidebar'><p>Not this one, which is the text of a sidebar and is as long as any other text of the page might be here, or longer.</p></div>"


class Plain(HTMLParser):
    """The text blocks of the article of a page that marks it, without furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.text = [], [], ""

    def flush(self):
        if joined := " ".join(self.text.split()):
            self.blocks.append(joined)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.INLINE and tag != "br":
            self.flush()
        if tag == "br":
            self.text += " "
        elif tag not in html_text.VOID:
            if tag == "p" and "p" in self.open:
                del self.open[len(self.open) - 1 - self.open[::-1].index("p") :]
            self.open.append("ad" if dict(attrs).get("class") == "ad" else tag)

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.flush()
            for name in (tag, "ad"):
                if name in self.open:
                    del self.open[len(self.open) - 1 - self.open[::-1].index(name) :]
                    break

    def handle_data(self, data):
        if "article" in self.open and not {"ad", "nav", "footer", "script", "style"} & set(self.open):
            self.text += data


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_pages(size):
    rules = set()
    for page in pq.read_table(f"/root/testdata/{size}/pages.parquet")["html"].to_pylist():
        plain = Plain()
        plain.feed(page or "")
        plain.flush()
        assert html_text.main_text(page) == "\n\n".join(plain.blocks)
        rules |= {rule for _, _, rule in html_text.decided(page)}
    assert rules == {"furniture", "density", "neighbours", "position"}


@pytest.mark.parametrize("opened", ["div style='overflow:hidden'", "div data-id='search'", "div class='content has-sidebar'", "div class='post no-comments'", "div class='commentary'", "div class='overflow-hidden'", "div class=sidebar", "div id=comments title='hidden'"])
def test_the_article_stays(opened):
    for more in (ASIDE, "<div class='comment-list'><p>I have read it and it is all that one could want of a text, and more than that.</p></div>"):
        got = html_text.main_text(f"<body><nav><a href=/>Home</a></nav><{opened}>{PART * 3}</div>{more}</body>")
        assert got.count("This is the article") == 3 and "sidebar" not in got and "I have read" not in got


def test_marks_and_densities():
    teasers = "<article><h3><a href=a>Read on</a></h3></article>" * 3
    assert "This is the article" in html_text.main_text(f"{teasers}<div>{PART * 4}</div>")
    assert html_text.main_text(f"<article>{PART}<p><a href=x>A link that is a whole block</a></p></article>{PART}").split("\n\n")[1:] == ["A link that is a whole block"]
    assert html_text.main_text("<main><p>Xyzzy plugh</p></main><p>outside</p>") == "Xyzzy plugh"
    assert html_text.main_text("<article class='comment'><p>Xyzzy</p></article>") == "Xyzzy"


@pytest.mark.parametrize("mark", ["class='header-image-post'", "id='comment-free'", "class='login-story wide'"])
def test_a_hint_gives_way_to_good_blocks(mark):
    """Inside a marked article and without one: what is only hinted at stays with its short blocks if it holds good text, and goes if not."""
    held = f"<div {mark}><h3>Short head</h3>{PART}</div>"
    for page in (f"<article>{PART}{held}{PART}</article>", f"<div>{PART}{held}{PART}</div>"):
        got = html_text.main_text(page)
        assert got.count("This is the article") == 3 and "Short head" in got
    assert html_text.main_text(f"<article>{PART}<div {mark}><p>Xyzzy plugh</p></div>{PART}</article>").count("\n\n") == 1


@pytest.mark.parametrize("mark", ["class=comments", "class='comment-list'", "id='comment-12'", "class='main-nav'", "class='sidebar-right widget'", "class='adsBox'"])
def test_plain_names_of_furniture_go_whatever_they_hold(mark):
    assert html_text.main_text(f"<article>{PART}<div {mark}>{PART}</div></article>").count("This is the article") == 1


def test_densities_decide_inside_the_article():
    """Blocks of links go from a marked article, with the short block between them, though its place and its name say nothing against them."""
    links = "<ul>" + "".join(f"<li><a href=/{k}>Another page of this site that has a number and it is {k}, which is linked from here</a></li>" for k in range(2)) + "<li>and more</li>" + "<li><a href=/x>The last of the pages of this site that is linked from here, with the number of all</a></li></ul>"
    page = f"<article>{PART}<h2>Next</h2>{PART}{links}</article>"
    plain = [b.text for b in html_text.blocks(page) if b.main and not b.furniture]
    kept = html_text.main_text(page).split("\n\n")
    assert kept == [x for x in plain if "is linked from" not in x and "linked from here" not in x and x != "and more"] and len(kept) == 3
    assert {rule for text, keep, rule in html_text.decided(page) if not keep} == {"density", "neighbours"}


@pytest.mark.parametrize("part", ["<b></p>", "<a '", "<p>x <![CDATA[", "<div></span>", '<a "x>', "<i><div></i>", "</script ", "<li><i>", "<p><b>", "<!-- ", "<div class='", "<", "&", "<td><tr>", "<b><div><i>"])
def test_linear_time(part):
    def taken(n):
        page = "<p>begin</p>" + part * (n // len(part))
        begun = time.perf_counter()
        for p in (page, page + "'>", page + '">'):
            html_text.main_text(p)
        return time.perf_counter() - begun

    assert taken(400_000) < 3
