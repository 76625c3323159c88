"""Labelled pages that the HTML extractor is trained on.

Each page is written out of blocks by a rule: ``main`` blocks are the article, the rest is what surrounds articles on
the web. Labels come with the blocks, so no page needs marking by hand.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

# Names that authors give to parts of a page, and the words of its furniture.
CHROME = {
    "nav": ("menu", "main-nav", "navbar", "breadcrumb", "topnav", "navigation"),
    "header": ("site-header", "masthead", "banner", "branding", "page-top", "header"),
    "footer": ("site-footer", "footer", "copyright", "legal", "page-bottom", "credits"),
    "aside": ("sidebar", "related", "widget", "recommended", "popular", "rail"),
    "ad": ("ad", "advert", "ads", "sponsor", "promo", "banner-ad"),
    "notice": ("cookie-notice", "notice", "consent", "newsletter", "alert", "popup"),
    "form": ("search", "login", "subscribe", "contact-form", "signup", "form"),
    "comments": ("comments", "comment", "comment-list", "discussion", "replies", "responses"),
    "share": ("share", "social", "toolbar", "buttons", "follow", "tags"),
}
MAIN = ("article", "content", "post", "entry", "story", "main", "article-body", "post-content", "text")
SYLLABLES = ("an", "be", "co", "de", "el", "for", "ga", "in", "lo", "men", "no", "or", "pa", "que", "re", "sch", "ti", "un")


def _text(draw: random.Random, least: int, most: int) -> str:
    words = ["".join(draw.choices(SYLLABLES, k=draw.randint(1, 4))) for _ in range(draw.randint(least, most))]
    return f"{' '.join(words).capitalize()}{draw.choice(('.', '.', '.', '', '?', '!'))}"


def _chrome(draw: random.Random, kind: str) -> str:
    name = draw.choice(CHROME[kind])
    mark = draw.choice((f' class="{name}"', f' id="{name}"', f' class="{name} x{draw.randint(0, 9)}"', ""))
    tag = kind if kind in ("nav", "header", "footer", "aside", "form") and draw.random() < 0.8 else "div"
    if not mark and tag == "div":
        mark = f' class="{name}"'
    links = [f'<a href="/{i}">{_text(draw, 1, 3)}</a>' for i in range(draw.randint(2, 7))]
    if kind == "nav":
        inner = f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>"
    elif kind == "form":
        inner = f"<label>{_text(draw, 1, 3)}</label><input><p>{_text(draw, 2, 8)}</p><button>{_text(draw, 1, 2)}</button>"
    elif kind == "comments":
        inner = f"<h3>{_text(draw, 1, 2)}</h3>" + "".join(
            f'<div class="comment"><p>{_text(draw, 4, 60)}</p></div>' for _ in range(draw.randint(1, 4))
        )
    elif kind == "aside":
        inner = f"<h3>{_text(draw, 1, 3)}</h3>" + draw.choice(
            (f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>", f"<p>{_text(draw, 3, 40)}</p><p>{_text(draw, 3, 20)}</p>")
        )
    elif kind == "footer":
        inner = draw.choice((f"&copy; {_text(draw, 2, 9)}", f"<p>&copy; {_text(draw, 3, 12)}</p>", " ".join(links)))
    elif kind == "header":
        inner = draw.choice((f"<h1>{_text(draw, 1, 4)}</h1>", f"<p>{_text(draw, 1, 6)}</p>", _text(draw, 1, 5)))
    else:
        inner = draw.choice((_text(draw, 3, 25), f"<p>{_text(draw, 3, 25)}</p>", f"{_text(draw, 2, 9)} {links[0]}"))
    return f'<{tag}{mark} data-main="0">{inner}</{tag}>'


def _main(draw: random.Random) -> str:
    tag = draw.choice(("article", "article", "main", "div", "section"))
    mark = f' class="{draw.choice(MAIN)}"' if tag == "div" or draw.random() < 0.4 else ""
    blocks = [f"<h1>{_text(draw, 1, 9)}</h1>"] if draw.random() < 0.8 else []
    if draw.random() < 0.15:  # an article may have a header of its own
        blocks = [f"<header>{''.join(blocks)}<p>{_text(draw, 3, 12)}</p></header>"]
    short = draw.random() < 0.35  # a brief article is one all the same
    for _ in range(draw.randint(1, 2) if short else draw.randint(1, 9)):
        kind = draw.random() * (0.8 if short else 1)
        if kind < 0.72:
            blocks.append(f"<p>{_text(draw, 1, 8 if short else 120)}</p>")
        elif kind < 0.78:
            blocks.append(f'<p>{_text(draw, 2, 30)} <a href="/x">{_text(draw, 1, 3)}</a> {_text(draw, 2, 30)}</p>')
        elif kind < 0.84:
            blocks.append(f"<h2>{_text(draw, 1, 6)}</h2>")
        elif kind < 0.9:
            blocks.append(f"<ul>{''.join(f'<li>{_text(draw, 1, 15)}</li>' for _ in range(draw.randint(2, 5)))}</ul>")
        elif kind < 0.93:
            blocks.append(f"<blockquote><p>{_text(draw, 5, 40)}</p></blockquote>")
        elif kind < 0.96:
            blocks.append(f"<table><tr><td>{_text(draw, 1, 4)}</td><td>{_text(draw, 1, 4)}</td></tr></table>")
        else:
            blocks.append(f"<pre>{_text(draw, 3, 20)}</pre>")
    inner = "".join(blocks)
    if draw.random() < 0.25:
        inner = f'<div class="{draw.choice(MAIN)}">{inner}</div>'
    if draw.random() < 0.25:  # furniture within the article's element
        inner += _chrome(draw, draw.choice(("share", "ad", "aside", "comments", "form", "notice")))
    return f'<{tag}{mark} data-main="1">{inner}</{tag}>'


def labelled_pages(n: int, seed: int = 7) -> Iterator[str]:
    """``n`` pages; ``data-main`` is 1 on the article and 0 on furniture, also within the article."""
    draw = random.Random(seed)
    for _ in range(n):
        kinds = list(CHROME)
        before = [_chrome(draw, k) for k in draw.choices(kinds, k=draw.randint(1, 4))]
        after = [_chrome(draw, k) for k in draw.choices(kinds, k=draw.randint(1, 4))]
        body = "".join([*before, _main(draw), *after])
        if draw.random() < 0.4:
            body = f'<div class="{draw.choice(("wrapper", "page", "container", "layout"))}">{body}</div>'
        yield f"<!DOCTYPE html><html><head><title>{_text(draw, 1, 8)}</title></head><body>{body}</body></html>"
