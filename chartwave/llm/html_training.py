"""Generated labelled web pages: what the page model of html_tree is trained on.

Layouts, wrappers, class names and mistakes in the markup vary independently of each
other, so that no single one of them tells content from the rest.  data-y="1" marks
content and data-y="0" what is not; elements inherit the mark.
"""

from __future__ import annotations

import random

GOOD = "article content entry post story body text main prose page-content post-body entry-content story-text".split()
NEUTRAL = "row col col-8 box inner wrap container block x1 css-1ab grid left center section-2 module unit clearfix".split()
#: Class names of content that also speak against it.
CLASHING = (
    "story-related article-header text-widget post-sidebar page-header-body story-more content-tools main-story-side body-follow"
    " article-tags-text entry-promo-free popular-story content-banner-free"
).split()
ADS = "ad ads advert ad-slot sponsored promo ad-content promo-text advertisement sponsor-box".split()
NOTICES = "cookie cookie-notice consent newsletter notice popup gdpr-text paywall alert-body subscribe-box newsletter-content".split()
SIDES = "sidebar related widget side recommended more-stories trending sidebar-content related-posts popular-text".split()
NAVS = "nav menu main-menu navbar breadcrumb nav-main toc pager pagination menu-content".split()
TOPS = "header masthead topbar site-header banner header-content page-header".split()
ENDS = "footer site-footer colophon footer-text copyright page-footer footer-content".split()
REMARKS = "comment comment-body reply comment-content user-comment comment-text".split()
REMARK_LISTS = "comments comment-list discussion responds comments-main replies disqus_thread".split()
#: Classes of content that tell what the page has or lacks.
STATED = (
    "ad-free no-ads no-sidebar has-comments comments-open share-enabled newsletter-signup-enabled without-related with-sidebar"
    " hide-share promo-off notice-board"
).split()
SHARES = "share social sharing share-tools follow tags".split()


class PageMaker:
    """Random pages; the same seed gives the same pages."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.lexicon = ["".join(self.rng.choices("abcdefghijklmnopqrstuvwxyz", k=self.rng.randint(2, 8))) for _ in range(3000)]

    def pick(self, *options):
        return self.rng.choice(options)

    def maybe(self, share: float) -> bool:
        return self.rng.random() < share

    def some(self, lo: int, hi: int) -> range:
        return range(self.rng.randint(lo, hi))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.rng.choices(self.lexicon, k=self.rng.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(3, 16).capitalize() + self.pick(".", ".", ".", "?", ",") for _ in self.some(lo, hi))

    def links(self, lo: int, hi: int, wrap: str = "li") -> str:
        return "".join(f"<{wrap}><a href='/x'>{self.words(1, 4)}</a></{wrap}>" for _ in self.some(lo, hi))

    def named(self, names: list[str], bare: float = 0.0) -> str:
        if self.maybe(bare):
            return ""
        extra = f" {self.pick(*NEUTRAL)}" if self.maybe(0.2) else ""
        return f' {self.pick("class", "class", "class", "id")}="{self.pick(*names)}{extra}"'

    def own_name(self) -> str:
        """The attribute of an element of content: mostly none or one that says nothing."""
        kind = self.rng.random()
        return "" if kind < 0.4 else self.named(NEUTRAL) if kind < 0.7 else self.named(GOOD) if kind < 0.9 else self.named(STATED) if kind < 0.94 else self.named(CLASHING)

    # Content

    def inline(self, body: str) -> str:
        if self.maybe(0.25):
            body += f" <a href='/y'>{self.words(1, 4)}</a> {self.sentences(1, 2)}"
        if self.maybe(0.15):
            body += f" <{self.pick('b', 'em', 'code', 'q', 'sup')}>{self.words(1, 3)}</{self.pick('b', 'em', 'code', 'q', 'sup')}> {self.words(1, 5)}."
        if self.maybe(0.15):
            body = f"<{self.pick('b', 'em', 'strong', 'span')}>{body}"
        if self.maybe(0.12):
            body += "<br>" + (self.sentences(1, 2) if self.maybe(0.6) else "")
        return body

    def paragraph(self) -> str:
        kind = self.rng.random()
        if self.maybe(0.01):
            body = self.pick("All rights reserved.", f"&copy; {self.words(1, 4)}", f"Copyright {self.words(1, 5)}.")
        elif kind < 0.78:
            body = self.inline(self.sentences(1, 6))
        elif kind < 0.84:
            body = " | ".join(self.words(1, 2) for _ in self.some(2, 12))
        elif kind < 0.9:
            body = self.words(1, 3).capitalize() + self.pick(".", "", "!", ":")
        elif kind < 0.94:
            body = f"<a href='/z'>{self.words(1, 8)}</a>{self.pick('', '.')}"
        else:
            body = self.words(4, 14)
        tag = self.pick("p", "p", "p", "p", "p", "p", "p", "div")
        return f"<{tag}{self.own_name() if self.maybe(0.3) else ''}>{body}" + ("</p>" if tag == "p" and self.maybe(0.75) else "</div>" if tag == "div" else "")

    def block(self) -> str:
        kind = self.rng.random()
        heads = f"h{self.pick(2, 2, 3, 3, 4, 5)}"
        if kind < 0.56:
            return self.paragraph()
        if kind < 0.64:
            return f"<{heads}>{self.words(1, 7)}</{heads}>"
        if kind < 0.71:
            tag = self.pick("ul", "ol")
            item = self.pick(lambda: self.inline(self.sentences(1, 2)), lambda: self.words(1, 4), lambda: f"<p>{self.sentences(1, 2)}</p>", lambda: f"<a href=/r>{self.words(2, 6)}</a> {self.words(1, 6)}")
            return f"<{tag}{self.own_name()}>" + "".join(f"<li>{item()}" + self.pick("</li>", "</li>", "") for _ in self.some(2, 6)) + f"</{tag}>"
        if kind < 0.74:
            return "<dl>" + "".join(f"<dt>{self.words(1, 3)}<dd>{self.sentences(1, 1)}" for _ in self.some(1, 4)) + "</dl>"
        if kind < 0.79:
            body = self.sentences(1, 3)
            return f"<blockquote{self.own_name()}>{self.pick(body, f'<p>{body}</p><cite>{self.words(1, 3)}</cite>')}</blockquote>"
        if kind < 0.84:
            rows = "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(2)) + "</tr>" for _ in self.some(2, 6))
            top = f"<caption>{self.words(1, 5)}</caption>" if self.maybe(0.3) else ""
            return f"<table{self.own_name()}>{top}" + (f"<thead><tr><th>{self.words(1, 2)}</th><th>{self.words(1, 2)}</th></tr></thead><tbody>{rows}</tbody>" if self.maybe(0.5) else rows) + "</table>"
        if kind < 0.88:
            return f"<figure{self.own_name()}><img src=/i.png>" + self.pick("", f"<figcaption>{self.words(3, 12)}</figcaption>", f"<figcaption>{self.sentences(1, 2)}</figcaption>") + "</figure>"
        if kind < 0.91:
            return f"<pre><code>{self.words(3, 20)}</code></pre>"
        if kind < 0.93:
            return f"<details><summary>{self.words(1, 4)}</summary>{self.paragraph()}</details>"
        if kind < 0.97:
            return self.pick("<hr>", "<img src=/a.png>", "<svg><path d='M0'/></svg>", "<script>track(1)</script>", "<select><option>one<option>two</select>", "<button>Copy</button>", "<iframe src=/v></iframe>", "<video>no</video>")
        return f"{self.sentences(1, 3)}<br><br>{self.sentences(1, 3)}<br>"

    def wrapped(self, body: str, most: int) -> str:
        for _ in self.some(0, most):
            tag = self.pick("div", "div", "div", "section", "section", "center" if self.maybe(0.2) else "div")
            body = f"<{tag}{self.own_name()}>{body}</{tag}>"
        return body

    def head(self) -> str:
        title = f"<h1>{self.words(2, 9)}</h1>"
        if self.maybe(0.25):
            more = self.pick("", f"<p>{self.sentences(1, 2)}</p>", f"<h2>{self.words(3, 8)}</h2>", f"<p>{self.words(1, 4)}, <time>{self.words(1, 2)}</time></p>")
            return f"<header{self.own_name() if self.maybe(0.5) else ''} data-y='1'>{title}{more}</header>"
        return title

    def article(self, junk: float) -> str:
        parts = [self.head()] if self.maybe(0.75) else []
        if self.maybe(0.35):
            for _ in self.some(1, 4):
                inner = "".join([f"<h2>{self.words(1, 6)}</h2>" if self.maybe(0.8) else "", *(self.block() for _ in self.some(1, 4))])
                if self.maybe(junk):
                    inner += self.junk()
                parts.append(f"<{self.pick('section', 'section', 'div')}{self.own_name()}>{inner}</{self.pick('section', 'div')}>" if self.maybe(0.1) else self.wrapped(f"<section{self.own_name()}>{inner}</section>", 1))
        else:
            blocks = [self.block() for _ in (self.some(1, 9) if self.maybe(0.88) else self.some(10, 90))]
            k = self.rng.randint(0, len(blocks))
            if self.maybe(0.4):
                blocks = [self.wrapped("".join(blocks[:k]), 4), *blocks[k:]] if k else blocks
            if self.maybe(junk):
                blocks.insert(self.rng.randint(0, len(blocks)), self.junk())
            parts += blocks
        if self.maybe(junk / 2):
            parts.append(self.pick(self.junk, self.comments, lambda: f"<footer data-y='0'>{self.words(1, 3)}{self.links(1, 3, 'span')}</footer>")())
        if self.maybe(0.2):
            parts.append(self.tags())
        body = "".join(parts)
        return self.wrapped(body, 6) if self.maybe(0.4) else body

    # The rest

    def junk(self) -> str:
        made = (
            lambda: f"<div{self.named(ADS)} data-y='0'>{self.pick('', '<p>')}{self.sentences(1, 3)}</div>",
            lambda: f"<p{self.named(self.pick(ADS, SIDES, NOTICES))} data-y='0'>{self.pick('', '<a href=/p>')}{self.sentences(1, 2)}</a></p>",
            lambda: f"<{self.pick('aside', 'aside', 'div class=sidebar')} data-y='0'{self.named(SIDES, 0.3)}><h3>{self.words(1, 3)}</h3><ul>{self.links(2, 6)}</ul></aside></div>",
            lambda: f"<aside{self.named(SIDES, 0.5)} data-y='0'>{self.pick('<p>', '<div><p>', '<h4>')}{self.sentences(1, 3)}</aside>",
            lambda: f"<div{self.named(NOTICES)} data-y='0'><p>{self.sentences(1, 3)}</p>{self.pick('', f'<button>{self.words(1, 2)}</button>', f'<form><input><button>{self.words(1, 2)}</button></form>')}</div>",
            self.form,
            self.form,
            lambda: f"<div{self.named(SHARES)} data-y='0'>{self.words(0, 2)}{self.links(2, 4, 'span')}</div>",
            self.tags,
            lambda: f"<{self.pick('section', 'div')}{self.named(SIDES)} data-y='0'><h3>{self.words(1, 3)}</h3>{self.teasers()}</section></div>",
            lambda: f"<nav{self.named(NAVS, 0.5)} data-y='0'>{self.pick(f'<ul>{self.links(2, 9)}</ul>', self.links(2, 5, 'span'), self.links(2, 5, 'div'))}</nav>",
            lambda: f"<{self.pick('ul', 'ol', 'div')}{self.named(NAVS)} data-y='0'>{self.links(2, 8)}</ul></ol></div>",
        )
        return self.pick(*made)()

    def tags(self) -> str:
        tag, names = self.pick("div", "p", "p"), self.pick(["tags"], ["post-tags"], ["share"], ["tags-line"])
        links = self.pick(", ", " ", " | ").join(f"<a href='/t'>{self.words(1, 2)}</a>" for _ in self.some(1, 4))
        word = self.words(1, 1).capitalize()
        return f"<{tag}{self.named(names)} data-y='0'>{self.pick(f'{word}: ', f'<span>{word}:</span> ', '')}{links}</{tag}>"

    def plain_side(self) -> str:
        tag = self.pick("div", "div", "section")
        body = "".join(f"<p>{self.sentences(1, 3)}</p>" for _ in self.some(1, 3)) if self.maybe(0.8) else self.sentences(1, 3)
        return f"<{tag}{self.named(SIDES)} data-y='0'>{f'<h3>{self.words(1, 3)}</h3>' if self.maybe(0.4) else ''}{body}</{tag}>"

    def form(self) -> str:
        body = self.pick("", f"<p>{self.sentences(1, 2)}</p>", f"<h3>{self.words(1, 3)}</h3>")
        for _ in self.some(1, 4):
            label = self.pick(f"<label>{self.words(1, 3)}</label>", self.words(1, 3), f"<legend>{self.words(1, 2)}</legend>")
            body += label + self.pick("<input name=q>", "<select><option>a<option>b</select>", "<textarea></textarea>", f"<button>{self.words(1, 2)}</button>", "")
        for _ in self.some(0, 4):
            body = f"<{self.pick('div', 'fieldset')}>{body}</div></fieldset>"
        return f"<form{self.named(NEUTRAL, 0.5)} data-y='0'>{body}</form>"

    def teasers(self) -> str:
        tag = self.pick("article", "div", "li")
        return "".join(f"<{tag}><h4><a href=/t>{self.words(2, 7)}</a></h4><p>{self.sentences(0, 1)}</p></{tag}>" for _ in self.some(2, 4))

    def comments(self) -> str:
        def one(depth: int = 0) -> str:
            tag = self.pick("div", "li", "article", "section")
            more = one(depth + 1) if depth < 3 and self.maybe(0.25) else ""
            body = self.pick(f"<p>{self.sentences(1, 4)}</p>", f"<div><p>{self.sentences(1, 3)}</p><p>{self.sentences(1, 2)}</p></div>", self.sentences(1, 3))
            return f"<{tag}{self.named(REMARKS)}>{self.pick('<b>', '<h4>', '<header>')}{self.words(1, 2)}</b></h4></header>{body}{more}</{tag}>"

        many = self.some(1, 5) if self.maybe(0.9) else self.some(6, 30)
        form = f"<form><textarea></textarea><button>{self.words(1, 2)}</button></form>" if self.maybe(0.4) else ""
        return f"<{self.pick('section', 'div', 'div', 'aside')}{self.named(REMARK_LISTS)} data-y='0'><h3>{self.words(1, 3)}</h3>{''.join(one() for _ in many)}{form}</section></div></aside>"

    def top(self) -> str:
        inner = [f"<a href='/'>{self.words(1, 3)}</a>" if self.maybe(0.8) else f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.sentences(0, 1)}</p>" if self.maybe(0.4) else ""]
        bar = f"<{self.pick('nav', 'nav', 'div class=menu', 'div id=nav')} data-y='0'><ul>{self.links(3, 9)}</ul></nav></div>" if self.maybe(0.8) else ""
        if self.maybe(0.2):
            return bar
        inside = bar if self.maybe(0.4) else ""
        tag = self.pick("header", "header", "div")
        return f"<{tag}{self.named(TOPS, 0.5 if tag == 'header' else 0)} data-y='0'>{''.join(inner)}{inside}</{tag}>" + ("" if inside else bar)

    def end(self) -> str:
        rights = f"{self.pick('&copy;', '', 'Copyright', '(c)')} {self.words(1, 4)} &middot; {self.sentences(0, 2)}"
        if self.maybe(0.08):
            return f"<{self.pick('p', 'div', 'small')} data-y='0'>&copy; {self.words(1, 6)}</p></div></small>"
        tag = self.pick("footer", "footer", "footer", "div")
        body = self.pick(rights, f"<p>{rights}</p>", f"{self.links(2, 6, self.pick('span', 'div'))}<p>{rights}</p>", f"<div><ul>{self.links(2, 6)}</ul></div><div>{rights}</div>")
        return f"<{tag}{self.named(ENDS, 0.5 if tag == 'footer' else 0)} data-y='0'>{body}</{tag}>"

    def page(self) -> str:
        junk = self.pick(0.0, 0.2, 0.5)
        body = self.article(junk)
        shape, loose = self.rng.random(), 0
        if shape < 0.4:
            tag = self.pick("article", "article", "main")
            core = f"<{tag}{self.own_name()} data-y='1'>{body}" + (f"</{tag}>" if self.maybe(0.92) else "")
            if tag == "article" and self.maybe(0.3):
                core = f"<main{self.own_name()} data-y='0'>{self.junk() if self.maybe(junk) else ''}{core}{self.comments() if self.maybe(junk / 2) else ''}{self.junk() if self.maybe(junk) else ''}</main>"
        elif shape < 0.6:
            core = f"<{self.pick('div', 'div', 'section')}{self.named(GOOD)} data-y='1'>{body}</div></section>"
        elif shape < 0.8:
            core = f"<div{self.named(NEUTRAL, 0.6)} data-y='1'>{body}</div>" + (f"<div data-y='1'>{self.paragraph()}</div>" if self.maybe(0.2) else "")
        elif shape < 0.95:
            core, loose = body, 1  # content that lies among the rest: what is not content is marked itself
        else:
            core = f"<table><tr><td data-y='0'><ul>{self.links(3, 8)}</ul></td><td data-y='1'>{body}</td></tr></table>"
        side = self.plain_side()
        if self.maybe(0.2) and len(body) > 2 * len(side):
            core = f"<div{self.named(NEUTRAL, 0.5)} data-y='{loose}'>{self.pick(side + core, core + side)}</div>"
        if self.maybe(0.35):
            core = f"<div{self.named(NEUTRAL, 0.5)} data-y='{loose}'>{self.junk() if self.maybe(junk) else ''}{core}{self.junk() if self.maybe(0.3) else ''}</div>"
        around = self.maybe(0.85)
        before = self.top() if around and self.maybe(0.9) else ""
        before += "".join(self.junk() for _ in self.some(0, 2)) if around else ""
        after = (self.comments() if around and self.maybe(0.25) else "") + (self.junk() if around and self.maybe(0.4) else "")
        after += self.end() if around and self.maybe(0.85) else ""
        if self.maybe(0.02):
            before, after = f"{before}<form action=/p data-y='{loose}'><input type=hidden name=s>", f"</form>{after}"
        if self.maybe(0.1):
            return f"<div data-y='{loose}'>{before}{core}{after}</div>" if loose else before + core + after
        made = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body{self.named(GOOD, 0.9)} data-y='{loose}'>{before}{core}{after}</body></html>"
        return made[: self.rng.randrange(len(made) // 2, len(made))] if self.maybe(0.06) else made


def training_pages(n: int = 1600, seed: int = 11) -> list[str]:
    """n labelled pages of many layouts."""
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]
