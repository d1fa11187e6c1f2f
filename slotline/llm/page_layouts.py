"""Labelled pages: layouts with marked main text, put together at random and filled with words.

No given table says what the main text of a page is. So pages are composed from parts that
carry the label in `data-main`: a container for the main text, with parts of other kinds
before, behind, around and within it. Some lose their telling names, so that what is left
is how text and links are spread.
"""

from __future__ import annotations

import random
import re

from slotline.llm.html_tree import MARK

# Parts of pages: plain values.
CONTAINERS = (
    "<article>", "<main>", "<main><article>", "<article class='post'>", "<article class='entry hentry'>", "<section class='article-text'>",
    "<div class='content'>", "<div id='content'>", "<div id='main-content'>", "<div class='post-body'>", "<div class='entry-content'>",
    "<div class='article-body'>", "<div class='story text'>", "<div role='main'>", "<div class='main'><div class='text'>", "<div class='page'><article>", "<section>", "<div id='article'>", "<div class='blog-post'>", "<div class='main-text'>", "<div class='body'>",
)
PARTS = (
    "<nav><ul>{links}</ul></nav>", "<nav class='navbar'>{inline_links}</nav>", "<div class='menu'><ul>{links}</ul></div>", "<ul id='navigation'>{links}</ul>",
    "<div class='breadcrumb'>{inline_links}</div>", "<div class='pagination'>{inline_links}</div>", "<div class='tags'>{inline_links}</div>",
    "<header><h2>{title}</h2><p>{sentence}</p></header>", "<header>{sentence}</header>", "<header><h1>{title}</h1>{inline_links}</header>", "<header><h1>{word}</h1></header>", "<header class='masthead'><div><h1>{title}</h1><p>{sentence}</p></div></header>", "<div id='header'><h2>{title}</h2>{inline_links}</div>", "<div class='banner' role='banner'><p>{sentence}</p></div>",
    "<footer>&copy; {sentence}</footer>", "<footer>{word}</footer>", "<footer><p>{prose}</p></footer>", "<footer class='bottom'><div>{inline_links}</div><p>&copy; {word}</p></footer>", "<footer><p>{sentence}</p><ul>{links}</ul></footer>", "<div id='footer'><p>&copy; {sentence}</p></div>", "<div class='copyright legal'>{sentence}</div>",
    "<aside><h3>{title}</h3><p>{prose}</p></aside>", "<aside>{prose}</aside>", "<aside class='sidebar'><ul>{links}</ul></aside>", "<div class='sidebar'><h3>{title}</h3><p>{sentence}</p></div>", "<div id='sidebar'>{prose}</div>", "<div class='widget'><h4>{title}</h4><ul>{links}</ul></div>",
    "<div class='ad'>{sentence}</div>", "<div class='ads'><p>{sentence}</p></div>", "<div class='advert sponsored'>{sentence}</div>", "<div class='advertisement'><p>{prose}</p></div>", "<section class='promo'><h3>{title}</h3><p>{sentence}</p></section>",
    "<div class='cookie-notice'><p>{sentence}</p><button>{word}</button></div>", "<div id='cookies' role='dialog'><p>{prose}</p></div>", "<div class='notice' role='alert'>{sentence}</div>", "<div class='consent popup'><p>{sentence}</p></div>",
    "<form><p>{sentence}</p><label>{word}</label><input><button>{word}</button></form>", "<form class='search'><input><button>{word}</button></form>", "<form id='login'><label>{word}</label><input> {sentence}</form>", "<div class='newsletter subscribe'><form><p>{sentence}</p><input></form></div>",
    "<div class='share social'>{inline_links}</div>", "<div class='related'><h3>{title}</h3><ul>{links}</ul></div>", "<section class='recommended'><h3>{title}</h3>{inline_links}</section>",
    "<section id='comments'><h3>{title}</h3>{comments}</section>", "<section class='comments'>{comments}</section>", "<div class='comments'><h3>{title}</h3>{comments}</div>", "<ol class='commentlist'><li class='comment'><p>{prose}</p></li><li class='comment'><p>{sentence}</p></li></ol>", "<div id='disqus' class='discussion'>{comments}</div>",
    "<div hidden><p>{prose}</p></div>", "<div style='display:none'>{sentence}</div>",
)
# What parts that aren't main text are called, beside the parts above: plain values.
NAMES = (
    "side-bar", "right-rail", "top-nav", "main-menu", "site-header", "masthead", "page-header", "site-footer", "page-footer", "colophon", "toolbar", "popup", "overlay", "modal", "gdpr", "cookie-banner", "legal-notice", "disclaimer", "alert-box",
    "responses", "replies", "respond", "comment-list", "reader-comments", "user-reviews", "breadcrumbs", "pager", "related-posts", "see-also", "trending", "most-popular", "teaser", "share-buttons", "social-links", "sign-up", "login-box", "search-box", "contact-form",
    "ad", "ads", "comments", "sidebar", "footer", "header", "menu", "adsense", "ad-slot", "ad-unit", "sponsor", "partner-links", "advert-box", "promo-box", "announcement", "skip-link", "widget-area", "tag-cloud",
)
BLOCKS = ("<p>{prose}</p>", "<p>{prose}</p>", "<p>{junk}</p>", "<p>{junk}</p>", "<p>{prose}", "<p>{sentence}</p>", "<p>{word}.</p>", "<p><b>{sentence}<br>", "<h2>{title}</h2>", "<h3>{title}</h3>", "<ul><li>{sentence}</li><li>{sentence}</li></ul>", "<ol><li>{prose}</li><li>{word}</li></ol>", "<blockquote><p>{prose}</p></blockquote>", "<pre>{sentence}</pre>", "<figure><img><figcaption>{sentence}</figcaption></figure>", "<table><tr><td>{word}</td><td>{sentence}</td></tr></table>", "<div>{prose}</div>", "<div><p>{sentence}</p></div>", "<p>{sentence} <a href='/x'>{title}</a> {sentence}</p>")
_TELLING = re.compile(r" (?:class|id|role)='[^']*'")


class _Filler:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        syllables = [a + b for a in "b d g k l m n r s t v ch".split() for b in "a e i o u an er".split()]
        self.vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.choice((1, 1, 2, 2, 3, 4)))) for _ in range(400)]

    def words(self, least: int, most: int) -> str:
        return " ".join(self.rng.choice(self.vocabulary) for _ in range(self.rng.randint(least, most)))

    def sentence(self) -> str:
        return self.words(2, 14).capitalize() + self.rng.choice(("." * 4 + "!?"))

    def link(self) -> str:
        return f"<a href='/{self.words(1, 1)}'>{self.words(1, 3)}</a>"

    def fill(self, template: str) -> str:
        kinds = {
            "word": lambda: self.words(1, 1),
            "junk": lambda: " ".join(w + self.rng.choice(("", "***", "%%%", "$", "|")) for w in self.words(1, 80).split()),
            "title": lambda: self.words(1, 8).capitalize(),
            "sentence": self.sentence,
            "prose": lambda: " ".join(self.sentence() for _ in range(self.rng.randint(1, 12))),
            "links": lambda: "".join(f"<li>{self.link()}</li>" for _ in range(self.rng.randint(2, 8))),
            "inline_links": lambda: self.rng.choice((" ", " | ", " / ")).join(self.link() for _ in range(self.rng.randint(2, 6))),
            "comments": lambda: "".join(self.fill(self.rng.choice(("<div class='comment'><p>{prose}</p></div>", "<p>{sentence}</p>", "<div><b>{word}</b><p>{prose}</p></div>"))) for _ in range(self.rng.choice((1, 2, 3, 4, 5, 25)))),
        }
        return re.sub(r"\{(\w+)\}", lambda m: kinds[m[1]](), template)


def labelled_pages(n: int = 600, seed: int = 13) -> list[str]:
    """`n` pages, the same for a seed, whose elements say in `data-main` whether they hold main text."""
    rng = random.Random(seed)
    filler, out = _Filler(rng), []

    def mark(part: str, value: int) -> str:
        return re.sub(r"^<(\w+)", rf"<\1 {MARK}='{value}'", part)

    def other() -> str:
        part = rng.choice(PARTS)
        if rng.random() < 0.35:
            inner = rng.choice(("<p>{prose}</p>", "<p>{sentence}</p>", "<p>{sentence}</p><p>{prose}</p>", "{sentence}", "{prose}", "<h3>{title}</h3><p>{prose}</p>", "{inline_links}", "<ul>{links}</ul>"))
            tag, key = rng.choice(("div", "section", "p") if inner[0] == "{" else ("div", "div", "section")), rng.choice(("class", "class", "id"))
            return mark(filler.fill(f"<{tag} {key}='{rng.choice(NAMES)}'>{inner}</{tag}>"), 0)
        if rng.random() < 0.1 and not re.search("comment|hidden|none|prose", part):
            part = _TELLING.sub("", re.sub(r"<(/?)(?:nav|header|footer|aside|section)\b", r"<\1div", part))
        return mark(filler.fill(part), 0)

    for _ in range(n):
        container = rng.choice(CONTAINERS[:3] if rng.random() < 0.5 else CONTAINERS)
        if rng.random() < 0.1:
            container = _TELLING.sub("", re.sub(r"<(?:article|main|section)", "<div", container))
        closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", container)))
        blocks = [filler.fill("<h1>{title}</h1>")] if rng.random() < 0.8 else []
        blocks += [filler.fill(rng.choice(BLOCKS)) for _ in range(rng.choice((1, 1, 2, 2, 3, 3, 5, 5, 8, 12, 25, 80)))]
        for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
            blocks.insert(rng.randint(0, len(blocks)), other())
        page = [mark(container, 1) + "".join(blocks) + closing]
        for _ in range(rng.randint(0, 4)):
            page.insert(0, other())
        for _ in range(rng.randint(0, 4)):
            page.append(other())
        body = "".join(page)
        if rng.random() < 0.4:
            wrapper = rng.choice(("<div id='page'>", "<div class='wrapper'>", "<div class='container'>", "<div>"))
            body = f"{wrapper}{body}</div>"
        out.append(f"<html><head><title>{filler.words(1, 5)}</title></head><body>{body}" + ("</body></html>" if rng.random() < 0.8 else ""))
    return out
