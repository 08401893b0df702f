"""A small labelled table of page blocks for the decision tree of main_text: pages in the layouts that sites use, each in
several lengths, in which the attribute data-main marks the elements whose text belongs to the article. Inside a marked
article length means nothing, and neither does it outside of one, so each place holds short and long blocks; only pages whose
tags say nothing have long articles and short surroundings."""

from __future__ import annotations

_PROSE = (
    "The council met on Tuesday evening to settle the long dispute over the old bridge, and after four hours of talks both sides agreed that the repairs will begin in spring. Engineers had warned for years that the"
    " northern pier was sinking, a little more with every flood, while the money that had been set aside for it went to other works. Work is to last nine months, during which traffic will be sent over the new crossing."
).split()
_SELLING = (
    "Get our best offers for the whole family now, with free delivery to your door and a full refund within thirty days if you are not happy with what you bought from us. We and our partners store information on your"
    " device so that we can show you content and offers that suit you, and you may change your choice at any time. Thank you for this report, it was about time that somebody wrote it down."
).split()
_TITLES = ("Home", "World", "Fire at the mill", "Fair opens", "What the floods have cost the valley so far", "All the reports of last year that you may have missed in these pages")


def prose(n: int) -> str:
    return " ".join(_PROSE[i % len(_PROSE)] for i in range(n))


def selling(n: int) -> str:
    return " ".join(_SELLING[i % len(_SELLING)] for i in range(n))


def links(tag: str, n: int) -> str:
    return "".join(f'<{tag}><a href="/{i}">{t}</a></{tag}>' for i, t in enumerate(_TITLES[:n]))


def paragraphs(*lengths: int) -> str:
    return "".join(f"<p data-main>{prose(n)}</p>" for n in lengths)


def layouts(a: int, b: int, c: int, d: int) -> list[str]:
    """Lengths of paragraphs (a, b) and of what stands around the article (c, d)."""
    return [
        # An article element between menu, advert and footer; one that text without a mark surrounds.
        f'<nav><ul>{links("li", 4)}</ul></nav><div class="ad">{selling(c)}</div><article><h1 data-main>{prose(b)}</h1>{paragraphs(a, 1, b)}</article><footer>{selling(d)}</footer>',
        f"<div>{selling(c)}</div><div>{selling(d)}</div><article><h2 data-main>{prose(3)}</h2>{paragraphs(b, a)}<p data-main><a href='/r'>{prose(8)}</a></p>{paragraphs(a, 2)}</article><p>{selling(d)}</p><h3>{selling(4)}</h3><p>{selling(c)}</p>",
        # A main element with lists, a form and comments; a menu of links alone inside an article.
        f'<header><p>{selling(d)}</p></header><main><h1 data-main>{prose(6)}</h1>{paragraphs(a)}<ul><li data-main>{prose(2)}</li><li data-main>{prose(4)}</li></ul><blockquote data-main>{prose(b)}</blockquote><form><p>{selling(c)}</p></form>'
        f'<section id="comments"><h3>2 comments</h3><p>{selling(c)}</p><p>{selling(d)}</p></section></main><aside><h3>Most read</h3>{links("p", 3)}<p>{selling(c)}</p></aside>',
        f"<article><h1 data-main>{prose(4)}</h1><ul>{links('li', 6)}</ul>{paragraphs(a, b, 1)}</article><p>{selling(40)}</p>{links('p', 6)}<div>{selling(d)}</div>",
        f"<article><h1 data-main><a href='/own'>{prose(5)}</a></h1>{paragraphs(1, a, b)}{links('p', 5)}</article><p>{selling(c)}</p>",
        # Links after long text, which are the article's own only where they stand alone in it.
        f"<main><h2 data-main><a href='/own'>{prose(3)}</a></h2>{paragraphs(a, 45)}<p data-main><a href='/r'>{prose(12)}</a></p>{paragraphs(60)}</main><aside><p>{selling(50)}</p><h4><a href='/x'>{selling(9)}</a></h4><p>{selling(45)}</p><p><a href='/y'>{selling(3)}</a></p></aside>"
        f"<footer><p>{selling(60)}</p><p><a href='/z'>{selling(11)}</a></p><p>{selling(c)}</p></footer><div><p>{selling(50)}</p><p><a href='/z'>{selling(10)}</a></p></div>",
        # Classes alone.
        f'<div class="topnav">{links("span", 3)}</div><div id="content"><h1 data-main>{prose(5)}</h1>{paragraphs(a, b, 3)}<div class="share">{selling(d)}</div><div class="related">{links("p", 5)}</div></div><div class="sidebar"><p>{selling(c)}</p></div><p>{selling(c)}</p><p>{selling(d)}</p>',
        # Nothing but tags: lengths and links decide, with the neighbours.
        f"<div>{links('span', 4)}</div><h1 data-main>{prose(7)}</h1>{paragraphs(30 + a, 25 + b, 3, 40)}<div>{links('span', 3)}</div><div>{selling(3)}</div>",
        f"<table><tr><td>{links('p', 6)}</td><td><h2 data-main>{prose(4)}</h2>{paragraphs(22 + b, 30 + a)}</td></tr></table><p>{selling(5)}</p><p>{selling(2)}</p>",
        f"<p>{selling(4)}</p><p>{selling(1)}</p><h1 data-main>{prose(3)}</h1>{paragraphs(25 + a, 5, 24 + b)}{links('p', 6)}<p>{selling(2)}</p>",
        # Pages without an article.
        f"<nav>{links('p', 2)}</nav><ul>{links('li', 6)}</ul><footer>{selling(c)}</footer>",
        f"<form><p>{selling(2)}</p><p>{selling(d)}</p></form><h2>{selling(1)}</h2>{links('h3', 2)}<p>{selling(2)}</p>",
    ]


LABELLED_PAGES = [page for lengths in ((40, 9, 30, 1), (3, 150, 5, 90), (80, 1, 400, 12), (200, 30, 2, 500)) for page in layouts(*lengths)]
