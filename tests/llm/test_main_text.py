"""Articles whose text is spread over several containers, and wrappers that look like furniture."""

from __future__ import annotations

import random

import pytest

from corpus_blend.llm import html_text

LONG, TEXT = "long text " * 60, ("long text " * 60).strip()


@pytest.mark.parametrize("wrapped", ["<article class='post'>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"])
def test_title_and_lead_beside_the_body(wrapped):
    inner = f"<h1>title</h1><p>lead</p><div class='entry-content'><p>{LONG}</p></div>"
    assert html_text.extract(f"<body>{wrapped.format(inner)}</body>") == f"title\n\nlead\n\n{TEXT}"


def test_sections_of_unequal_size():
    page = f"<body><article><section class='a'><p>short</p></section><section class='b'><p>{LONG}</p></section></article></body>"
    assert html_text.extract(page) == f"short\n\n{TEXT}"


def test_an_article_in_a_list_stays_alone():
    page = f"<body><main><article><p>{LONG}</p></article><article><p>other</p></article></main></body>"
    assert html_text.extract(page) == TEXT


@pytest.mark.parametrize("wrapper", [
    "<div class='layout has-sidebar'>{}</div>", "<div class='no-ads'>{}</div>", "<div class='social-theme'>{}</div>",
    "<form id='aspnetForm'>{}</form>",
])
def test_wrappers_do_not_hide_the_article(wrapper):
    inner = f"<div class='ad'>Buy!</div><article><h1>title</h1><p>{LONG}</p><div class='related'><article>more</article></div></article>"
    assert html_text.extract(f"<body>{wrapper.format(inner)}</body>") == f"title\n\n{TEXT}"


def test_a_form_around_a_page_without_an_article():
    page = f"<body><form id='aspnetForm'><div class='menu'>Home</div><div><p>{LONG}</p></div></form></body>"
    assert html_text.extract(page) == TEXT


LAYOUTS = {
    "layout sidebar-right": "<div class='layout sidebar-right'><div class='content'><h1>title</h1><p>lead</p>{body}</div></div>",
    "share-price-story": "<div class='share-price-story'><h1>title</h1><p>lead</p>{body}</div>",
    "elementor-widget-wrap": "<div class='elementor-widget-wrap'><h1>title</h1><p>lead</p>{body}</div>",
    "subscription-guide": "<div id='subscription-guide'><h1>title</h1><p>lead</p>{body}</div>",
    "post around entry-content": "<div class='post'><h1>title</h1><p>lead</p><div class='entry-content'>{body}</div></div>",
    "header inside content": "<div class='content'><header><h1>title</h1></header><p>lead</p>{body}</div>",
    "sections": "<div id='main'><div><h1>title</h1><p>lead</p></div><div>{body}</div></div>",
    "plain wrapper": "<div class='x1'><h1>title</h1><p>lead</p><div class='x2'>{body}</div></div>",
    "nested wrappers": "<form><div class='widget-area'><div class='related-theme'><h1>title</h1><p>lead</p>{body}</div></div></form>",
}
FURNITURE = [
    "<nav><a href='/'>Home</a></nav>",
    "<div class='cookie-notice'><p>We use cookies.</p></div>",
    "<div class='sidebar'><p>Most read today</p></div>",
    "<ul><li><a href='/a'>Other things</a></li><li><a href='/b'>More of them</a></li></ul>",
    "<footer><p>All rights reserved</p></footer>",
    "<div class='comments'><p>" + "I quite disagree. " * 12 + "</p></div>",
]


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page = f"<body><header><h1>Site</h1></header>{LAYOUTS[name].format(body=f'<p>{LONG}</p>')}{FURNITURE[4]}</body>"
    assert html_text.extract(page) == f"title\n\nlead\n\n{TEXT}"


@pytest.mark.parametrize("seed", range(40))
def test_templates_put_together_at_random(seed):
    """Any layout, any furniture around it and within it: the text is that of the layout alone."""
    rng = random.Random(seed)
    paragraphs = [" ".join(rng.choice(("some", "words", "of", "text")) for _ in range(rng.randint(60, 200))) for _ in range(rng.randint(2, 5))]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    body += rng.choice(["", "<div class='ad'>Buy!</div>", "<div class='share'><a href='/s'>Share</a></div>"])
    before, after = rng.sample(FURNITURE[:4], 2), rng.sample(FURNITURE, 2)
    page = f"<body>{''.join(before)}{LAYOUTS[rng.choice(list(LAYOUTS))].format(body=body)}{''.join(after)}</body>"
    assert html_text.extract(page) == "\n\n".join(["title", "lead", *paragraphs])


def test_long_comments_and_notices_are_no_article():
    noise = "I quite disagree with that. " * 200
    page = f"<body><article><p>{LONG}</p></article><div class='comments'><p>{noise}</p></div></body>"
    assert html_text.extract(page) == TEXT
    assert html_text.extract(f"<body><h1>title</h1><div id='comments'><p>{noise}</p></div></body>") == "title"
    assert html_text.extract("<body><div class='cookie'><p>We use cookies.</p></div></body>") == ""


def test_a_host_opens_what_its_pages_agree_on(spark):
    """A page with more text outside than inside the wrapper follows the other pages of its host."""
    wrapped = "<div class='share-price-story'><h1>title</h1><p>{}</p></div>"
    pages = [(i, "http://a.example/x", f"<body>{wrapped.format(LONG)}</body>") for i in range(4)]
    pages.append((9, "http://a.example/y", f"<body><div class='x'><p>{LONG}</p></div>{wrapped.format('short')}</body>"))
    found = html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.id: r.text for r in found} == {i: f"title\n\n{TEXT}" for i in range(4)} | {9: "title\n\nshort"}
