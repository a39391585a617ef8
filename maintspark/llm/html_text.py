"""The main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: stretches of text that no block-level tag interrupts. Each
block has features of its ancestors (tag names, words of class and id) and of its text
(length, links, punctuation, place). A chain with two states, article and rest, is trained
on labelled pages by gradient ascent on the likelihood (forward-backward) and decoded by
Viterbi. The training pages are drawn by ``labelled_pages`` from layouts of common sites,
with menus, notices, adverts, forms and comments outside and inside of the article.

Character references are decoded, white space in a block becomes one space, and the blocks
of the article are joined by an empty line, all of them, whatever their length. Null, empty
and text-free pages give the empty text. Broken markup is read as browsers do as far as it
matters here: unclosed tags end with their block, stray end tags are skipped, an unclosed
comment or script reaches to the end. Rows don't depend on each other; repeated rows stay.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH = 1 << 13
ARTICLE, REST = 1, 0

#: Tags that begin and end a block, tags whose content isn't text, tags without content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template svg math iframe head title object".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag in the first place ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead select body article main section div".split())

#: Outermost ancestors that a block's features look at; deeper ones count for nesting only.
DEEPEST = 100

_MARK = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|(/?)([A-Za-z][^\s/>]*))")
_COMMENT = re.compile(r"<(?:(!--)|(!\[CDATA\[))")
_STOP = re.compile(r"""['">]""")
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


class _Tags:
    """The tags of a page, in time that grows with its length whatever the markup.

    Each says (begin, end, name, is an end tag, attributes); comments and declarations have
    no name. A quote in a tag that never ends counts as a character. A ``<`` that no ``>``
    follows is text.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.open = set()  # quotes from which no tag ends

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``."""
        page, seen, begin = self.page, [], at
        while m := _STOP.search(page, at):
            if m[0] == ">":
                return m.end()
            seen.append(m.start())
            close = -1 if m.start() in self.open else page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.open.update(seen)
        return page.index(">", begin) + 1

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        page = self.page
        m = _MARK.search(page, at) if at <= self.last else None
        if m is None or m.end() > self.last:
            m = _COMMENT.search(page, at)  # all that needs no ``>``
            if m is None:
                return None
        if m[1] or m[2]:
            close = page.find("-->" if m[1] else "]]>", m.end())
            return m.start(), len(page) if close < 0 else close + 3, None, False, ""
        if m[4] is None:
            return m.start(), page.index(">", m.end()) + 1, None, False, ""
        end = self._end(m.end())
        return m.start(), end, m[4].lower(), m[3] == "/", page[m.end() : end - 1]


class _Stack:
    """Open elements, with the places of each tag at hand."""

    def __init__(self):
        self.tags: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []  # places of blocks
        self._path: tuple | None = ()

    def push(self, tag: str, names: str) -> None:
        at = len(self.tags)
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK_TAGS:
            self.solid.append(at)
        if at < DEEPEST:
            self._path = None
        self.tags.append((tag, names))

    def last(self, tag: str) -> int:
        """The place of the innermost element of a tag, -1 if none is open."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def pop_to(self, k: int) -> None:
        if k < DEEPEST:
            self._path = None
        while len(self.tags) > k:
            self.places[self.tags.pop()[0]].pop()
        while self.solid and self.solid[-1] >= k:
            self.solid.pop()

    def path(self) -> tuple:
        if self._path is None:
            self._path = tuple(self.tags[:DEEPEST])
        return self._path


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, with their ancestors as (tag, words of class and id)."""
    page = page or ""
    out: list[Block] = []
    tags, stack = _Tags(page), _Stack()
    pieces: list[str] = []
    linked = 0
    unclosed: set[str] = set()  # tags whose end isn't in the rest of the page

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(stack.path(), text, linked))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            if stack.last("a") >= 0:
                linked += len(text)

    def content_end(tag: str, at: int) -> int:
        """Where what isn't text ends: behind the end tag, or with the page."""
        if tag in unclosed:
            return at
        close = re.compile(rf"</{re.escape(tag)}\s*+>", re.IGNORECASE).search(page, at)
        if close is None and tag == "head":  # may be unclosed: then it ends where the body begins
            close = re.compile(r"(?=<body\b)", re.IGNORECASE).search(page, at)
            if close is None:
                unclosed.add(tag)
                return at
        return close.end() if close else len(page)

    at = 0
    while at < len(page):
        found = tags.next(at)
        if found is None:
            add(page[at:])
            break
        begin, end, tag, ending, inside = found
        add(page[at:begin])
        at = end
        if tag is None:
            continue
        if not ending and tag in RAW_TAGS:
            if not inside.endswith("/"):
                at = content_end(tag, at)
            continue
        if tag == "br":
            pieces.append(" ")
        elif ending:
            k = stack.last(tag)
            if tag in BLOCK_TAGS:
                flush()
            elif stack.solid and k < stack.solid[-1]:
                k = -1  # an inline end tag doesn't close blocks
            if k >= 0:
                stack.pop_to(k)
        else:
            if tag in BLOCK_TAGS:
                flush()
                if stack.last("p") >= 0:
                    stack.pop_to(stack.last("p"))
                if tag in ENDS:
                    k = max(map(stack.last, ENDS[tag]))
                    if k > max(map(stack.last, LISTS)):
                        stack.pop_to(k)
            if tag not in VOID_TAGS:
                stack.push(tag, " ".join(w for x in _NAMED.findall(inside) for w in _WORD.findall(x.lower())) if inside else "")
    flush()
    return out


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


@lru_cache(maxsize=50_000)
def _path_features(path: tuple) -> tuple[int, ...]:
    names = {f"tag {t}" for t, _ in path} | {f"name {w}" for _, c in path for w in c.split()}
    outer = [t for t, _ in path if t in BLOCK_TAGS and t not in ("html", "body")]
    names |= {f"parent {outer[-1]}" if outer else "parent none", "bare" if not outer else "nested", f"depth {min(len(outer), 4)}"}
    return tuple(sorted({_hashed(x) for x in names}))


def block_features(found: list[Block]) -> list[list[int]]:
    rows = []
    n = len(found)
    for i, b in enumerate(found):
        t = b.text
        size = t.count(" ") + 1
        share = b.linked / max(1, len(t))
        names = (
            "bias", f"size {min(size.bit_length(), 7)}", f"links {0 if share == 0 else 1 if share < 0.5 else 2}", f"end {t[-1] if t[-1] in '.!?:,;' else 'x'}",
            f"stops {min(4, t.count('. ') + t.count('? ') + t.count('! '))}", f"place {0 if i == 0 else 1 if i < n / 5 else 3 if i == n - 1 else 2}", "mark" if "©" in t or "|" in t[:40] else "plain", "upper" if t[:1].isupper() else "lower",
        )
        rows.append([*_path_features(b.path), *map(_hashed_cached, names)])
    return rows


_hashed_cached = lru_cache(maxsize=5_000)(_hashed)


class ChainModel:
    """Two states; ``emit`` has a weight for each hashed feature and state."""

    def __init__(self):
        self.emit, self.move, self.first = np.zeros((WIDTH, 2)), np.zeros((2, 2)), np.zeros(2)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest states, by Viterbi."""
        if not rows:
            return []
        flat = np.fromiter((f for r in rows for f in r), np.int64)
        starts = np.cumsum([0, *map(len, rows[:-1])])
        scores = np.add.reduceat(self.emit[flat], starts, axis=0).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0][0] + self.first[0], scores[0][1] + self.first[1]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
        state = int(b > a)
        states = [state]
        for step in reversed(back):
            state = int(step[state])
            states.append(state)
        return states[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 120, rate: float = 0.15, ridge: float = 2e-3) -> ChainModel:
    """Maximises the likelihood of the labels; forward-backward over all pages at once, padded to the longest."""
    model = ChainModel()
    pages = [p for p in pages if p[0]]
    n, longest = len(pages), max(len(r) for r, _ in pages)
    size = np.array([len(r) for r, _ in pages])
    mask = np.arange(longest) < size[:, None]
    gold = np.zeros((n, longest), dtype=np.int64)
    for i, (_, labels) in enumerate(pages):
        gold[i, : len(labels)] = labels
    rows = [r for p, _ in pages for r in p]
    flat = np.fromiter((f for r in rows for f in r), np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    where = np.flatnonzero(mask.ravel())
    params = [model.emit, model.move, model.first]
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one = np.eye(2)
    for step in range(1, rounds + 1):
        scores = np.zeros((n * longest, 2))
        scores[where] = np.stack([np.bincount(owner, model.emit[flat, y], len(rows)) for y in (0, 1)], 1)
        scores = scores.reshape(n, longest, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = scores[:, 0] + model.first
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + model.move, axis=1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(model.move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + model.move + (scores + backward)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        miss = (one[gold] * mask[:, :, None] - chance).reshape(-1, 2)[where]
        grads = [
            np.stack([np.bincount(flat, miss[owner, y], WIDTH) for y in (0, 1)], 1) / n,
            np.einsum("nti,ntj->ij", one[gold[:, :-1]] * mask[:, 1:, None], one[gold[:, 1:]] * mask[:, 1:, None]) / n - pair.sum((0, 1)) / n,
            (one[gold[:, 0]] - chance[:, 0]).sum(0) / n,
        ]
        for p, g, m, v in zip(params, grads, first_moment, second_moment, strict=True):
            g = g - ridge * p
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


_SYLLABLES = "the an er in on re ti en st nd ou ea le la de que ment tion ung lich der die que ra do ci es os".split()


def labelled_pages(n: int = 360, seed: int = 11) -> list[tuple[str, None]]:
    """Training pages; each block begins with §1 (article) or §0 (rest)."""
    rng = random.Random(seed)

    def words(k: int) -> str:
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(k))

    def sentence(lo=3, hi=18) -> str:
        s = words(rng.randint(lo, hi))
        return s[:1].upper() + s[1:] + rng.choice("....?!")

    def para(label: int, lo: int = 1, hi: int = 6) -> str:
        style = rng.random()
        text = f"§{label}" + " ".join(sentence() for _ in range(rng.randint(lo, hi)))
        if style < 0.1:
            text = f"§{label}" + " ".join(w + rng.choice(["***", "###", "%%%", "&amp;&amp;"]) for w in words(rng.randint(5, 40)).split())
        elif style < 0.2:
            text = f"§{label}" + words(rng.randint(3, 30)).upper() + "!!"
        elif style < 0.3:
            text = f"§{label}" + words(rng.randint(1, 3)) + rng.choice(["", "."])
        elif style < 0.4:
            cut = text.rfind(" ")
            text = text[:cut] + f' <a href="/x">{words(2)}</a>' + text[cut:] if cut > 2 else text
        return text

    def link_list(tag_class: str, label: int = REST) -> str:
        return f"<ul{tag_class}>" + "".join(f'<li><a href="/{i}">§{label}{words(rng.randint(1, 3))}</a></li>' for i in range(rng.randint(2, 7))) + "</ul>"

    def named(*names: str) -> str:
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'

    def menu() -> str:
        return rng.choice([lambda: f"<nav>{link_list('')}</nav>", lambda: f"<div{named('menu', 'nav', 'navbar', 'breadcrumbs', 'main-menu')}>{link_list('')}</div>", lambda: link_list(named("menu", "nav-list", "navigation"))])()

    def advert() -> str:
        return rng.choice([f"<div{named('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo', 'ad-slot')}>{rng.choice(['{}', '<p>{}</p>'])}</div>", f"<aside{named('ad', 'promo', 'advertisement')}>{{}}</aside>"]).format(para(REST, 1, 2))

    def sidebar() -> str:
        inner = "".join(rng.choice([f"<h3>§0{words(2)}</h3>{link_list('')}", f"<p>{para(REST, 1, 3)}</p>"]) for _ in range(rng.randint(1, 3)))
        return rng.choice(["<aside>{}</aside>", f"<div{named('sidebar', 'related', 'widget', 'recommended', 'more-stories', 'popular')}>{{}}</div>", f"<aside{named('sidebar', 'related')}>{{}}</aside>"]).format(inner)

    def notice() -> str:
        return f"<div{named('cookie', 'cookie-banner', 'consent', 'notice', 'alert', 'newsletter', 'gdpr', 'popup')}><p>{para(REST, 1, 3)}</p>{rng.choice(['', f'<button>§0{words(1)}</button>'])}</div>"

    def form() -> str:
        return f"<form{rng.choice(['', named('search', 'subscribe', 'signup', 'login', 'contact-form')])}><label>§0{words(2)}</label><input name=q>{rng.choice(['', f'<p>{para(REST, 1, 2)}</p>'])}<button>§0{words(1)}</button></form>"

    def comments() -> str:
        one = lambda: f"<{t}{named('comment', 'reply', 'comment-body')}><p>{para(REST, 1, 3)}</p></{t}>"
        t = rng.choice(["div", "li", "article", "div"])
        inner = f"<h3>§0{words(1)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5)))
        return f"<{(o := rng.choice(['section', 'div']))}{named('comments', 'responses', 'discussion', 'comment-list', 'disqus')}>{inner}</{o}>"

    def share() -> str:
        return f"<div{named('share', 'social', 'tags', 'byline-links', 'toolbar', 'pagination')}>{link_list('')}</div>"

    def header() -> str:
        return f"<header{rng.choice(['', named('header', 'site-header', 'masthead')])}><{(h := rng.choice(['h1', 'div', 'p', 'h2']))}>§0{words(2)}</{h}>{rng.choice(['', menu()])}</header>"

    def footer() -> str:
        return rng.choice(["<footer>{}</footer>", f"<div{named('footer', 'site-footer', 'copyright', 'legal')}>{{}}</div>"]).format(rng.choice(["§0&copy; {}", "<p>§0&copy; {}</p>", "<p>§0{}</p>"]).format(sentence(2, 9)) + rng.choice(["", link_list("")]))

    def article() -> str:
        inside = [f"<p>{para(ARTICLE)}</p>" for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.15:
            inside = [f"<p>§1{words(rng.randint(100, 200))}</p>"]
        if rng.random() < 0.4:
            inside = [x.replace("<p>", "<p><b>", 1).replace("</p>", rng.choice(["<br>", "</b><br>"])) if rng.random() < 0.3 else x for x in inside]
        for _ in range(rng.choice([0, 0, 1, 2])):
            extra = rng.choice([
                lambda: f"<h2>§1{words(3)}</h2>", lambda: "<ul>" + "".join(f"<li>{para(ARTICLE, 1, 1)}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote><p>{para(ARTICLE, 1, 2)}</p></blockquote>",
                lambda: f"<pre>§1{words(6)}</pre>", lambda: f"<table><tr><td>§1{words(2)}</td><td>§1{words(2)}</td></tr></table>", lambda: f"<figure><figcaption>§1{sentence()}</figcaption></figure>",
                lambda: f"<div>{para(ARTICLE, 1, 2)}</div>", lambda: f"<section><h3>§1{words(2)}</h3><p>{para(ARTICLE)}</p></section>",
            ])()
            inside.insert(rng.randint(0, len(inside)), extra)
        for make in (advert, share, sidebar, form, notice, comments, menu):
            if rng.random() < 0.1:
                inside.insert(len(inside) if make in (comments, share) else rng.randint(0, len(inside)), make())
        if rng.random() < 0.08:
            inside.append(f"<footer>§0{sentence(2, 6)}</footer>")
        title = f"<h1>§1{words(rng.randint(2, 12))}</h1>"
        title = rng.choice([title, title, title, f"<header>{title}</header>", ""])
        body = title + "".join(inside)
        outer = rng.random()
        if outer < 0.5:
            return f"<article{rng.choice(['', named('post', 'story', 'entry')])}>{body}</article>"
        if outer < 0.65:
            return f"<main>{rng.choice(['{}', '<article>{}</article>', '<div>{}</div>'])}</main>".format(body)
        if outer < 0.95:
            return f"<div{named('content', 'article', 'post', 'entry-content', 'story-body', 'main-content', 'text', 'article-body')}>{body}</div>"
        return body

    pages = []
    for _ in range(n):
        parts = [f() for f in rng.choices([menu, header, notice, advert, form, sidebar], k=rng.choice([0, 1, 1, 2, 3, 4]))]
        parts.append(article())
        parts += [f() for f in rng.choices([sidebar, advert, comments, form, share, notice], k=rng.randint(0, 3))]
        parts += [footer()] if rng.random() < 0.8 else []
        pages.append(f"<html><head><title>t</title></head><body>{''.join(parts)}</body></html>")
    return pages


def _examples(pages: list[str]) -> list[tuple[list[list[int]], list[int]]]:
    out = []
    for page in pages:
        found = blocks(page)
        labels = [int(b.text[1]) if b.text[:1] == "§" else REST for b in found]
        for b in found:
            b.text = b.text[2:] if b.text[:1] == "§" else b.text
            b.linked = min(b.linked, len(b.text))
            b.text = b.text or "x"
        out.append((block_features(found), labels))
    return out


@lru_cache(maxsize=1)
def default_model() -> ChainModel:
    return train(_examples(labelled_pages()))


def main_text(page: str | None, model: ChainModel) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, model.decode(block_features(found)), strict=True) if y == ARTICLE)


def extract(pages: DataFrame, model: ChainModel | None = None, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """page_id, url and the main text of every page."""
    model = model or default_model()

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", text_col])

    return pages.selectExpr("cast(page_id as long) page_id", "url", f"`{html_col}` html").mapInArrow(rows, f"page_id long, url string, `{text_col}` string")


def op3_html_text(pages: DataFrame) -> DataFrame:
    return extract(pages).selectExpr("page_id", "url", "text", "cast(length(text) as long) n_chars")
