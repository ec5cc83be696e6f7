"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Blocks are described by their ancestors' tags, by what class and id values hint at, and by their
text; neighbouring labels are coupled. The field is trained here on labelled pages that a seeded
generator writes (many layouts, broken markup, boilerplate of every kind the contract names) and
decoded by Viterbi. Nothing is dropped from a block that is kept.

Defined cases: a null or empty page, or one without main text, gives the empty text; repeated rows
give repeated results; an empty table gives no rows; further columns are ignored; a page cut off
anywhere is read to its end. Whole pages are read, however long.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkforge.llm.arrow import map_texts
from linkforge.llm.html_blocks import STRUCTURE, Block, blocks

PAGES = 500
EPOCHS = 6
SEED = 5
_END = (".", "!", "?", "…", "\"", "”", "»", ":", ";")
_LENGTHS = (2, 5, 10, 20, 40, 80)
_AWAY = frozenset("ad side comment foot nav share notice form related hidden".split())


def features(page: Sequence[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    first_h1 = next((i for i, b in enumerate(page) if b.tag == "h1"), -1)
    n = len(page)
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        size = sum(words > x for x in _LENGTHS)
        tag = b.tag if b.tag in STRUCTURE else "div"
        link = "all" if b.link_share > 0.8 else "much" if b.link_share > 0.3 else "some" if b.link_share > 0 else "no"
        f = ["bias", f"tag={tag}", f"size={size}", f"link={link}", f"tag={tag}&size={size}", f"size={size}&link={link}"]
        f += [f"above={t}" for t in b.above]
        f += [f"hint={h}" for h in b.hints]
        away = bool(b.hints & _AWAY) or not b.above.isdisjoint(("nav", "footer", "aside", "form"))
        inside = not b.above.isdisjoint(("article", "main")) or "body" in b.hints
        f += [f"place={'away' if away else 'in' if inside else 'open'}", f"place={'away' if away else 'in' if inside else 'open'}&tag={tag}"]
        if "header" in b.above:
            f.append("header&in" if inside else "header&out")
        f.append("stops" if b.text.endswith(_END) else "open end")
        if "©" in b.text[:40] or b.text[:9].lower() == "copyright":
            f.append("copyright")
        if i < first_h1:
            f.append("before h1")
        elif i == first_h1:
            f.append("h1")
        f.append("begins" if i == 0 else "ends" if i == n - 1 else "amid")
        if i and page[i - 1].tag == b.tag and page[i - 1].above == b.above and page[i - 1].hints == b.hints:
            f.append("like the last")
        out.append(f)
    return out


class Field:
    """Weights of the two-label chain: per feature the score of *main* over *other*, and transitions."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.weights = {k: float(weights[i]) for k, i in index.items()}
        self.moves = moves.tolist()

    def decode(self, page: Sequence[Block]) -> list[int]:
        """Viterbi labels of a page's blocks."""
        (a, b), (c, d) = self.moves
        get = self.weights.get
        other = main = 0.0
        back = []
        for i, f in enumerate(features(page)):
            s = 0.0
            for name in f:
                s += get(name, 0.0)
            if i:
                from_other, from_main = other + a, main + c
                to_other, to_main = other + b, main + d
                back.append((from_main > from_other, to_main > to_other))
                other, main = max(from_other, from_main), max(to_other, to_main) + s
            else:
                main = s
        label = int(main > other)
        labels = [label] * len(page)
        for i in range(len(page) - 1, 0, -1):
            label = int(back[i - 1][label])
            labels[i - 1] = label
        return labels


def train(pages: Sequence[tuple[Sequence[Block], Sequence[int]]], epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """Maximum-likelihood weights by AdaGrad over pages; forward-backward in log space."""
    index: dict[str, int] = {}
    data = []
    for page, labels in pages:
        if page:
            named = features(page)
            flat = np.array([index.setdefault(x, len(index)) for f in named for x in f])
            data.append((flat, np.repeat(np.arange(len(named)), [len(f) for f in named]), np.array(labels)))
    w, moves = np.zeros(len(index)), np.zeros((2, 2))
    seen, seen_moves = np.full(len(index), 1e-2), np.full((2, 2), 1e-2)
    order = random.Random(seed)
    for _ in range(epochs):
        for at in order.sample(range(len(data)), len(data)):
            flat, block, y = data[at]
            n = len(y)
            unary = np.zeros((n, 2))
            unary[:, 1] = np.bincount(block, w[flat], n)
            fore, aft = unary.copy(), np.zeros((n, 2))
            for i in range(1, n):
                fore[i] += np.logaddexp(fore[i - 1, 0] + moves[0], fore[i - 1, 1] + moves[1])
            for i in range(n - 2, -1, -1):
                nxt = unary[i + 1] + aft[i + 1]
                aft[i] = np.logaddexp(moves[:, 0] + nxt[0], moves[:, 1] + nxt[1])
            z = np.logaddexp(fore[-1, 0], fore[-1, 1])
            p = np.exp(fore + aft - z)
            grad = np.zeros(len(index))
            np.add.at(grad, flat, (p[:, 1] - y)[block])
            grad += 1e-3 * w
            pair = np.zeros((2, 2))
            if n > 1:
                joint = np.exp(fore[:-1, :, None] + moves[None] + (unary[1:] + aft[1:])[:, None, :] - z)
                pair = joint.sum(axis=0)
                np.add.at(pair, (y[:-1], y[1:]), -1.0)
            seen += grad**2
            seen_moves += pair**2
            w -= 0.2 * grad / np.sqrt(seen)
            moves -= 0.2 * pair / np.sqrt(seen_moves)
    return Field(index, w, moves)


# --- labelled pages ---------------------------------------------------------------------------


class _Writer:
    """Writes one page and remembers which of its blocks are main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts: list[str] = []
        self.main: list[str] = []

    def word(self) -> str:
        syllables = ("ka", "ro", "mi", "tel", "sun", "é", "dor", "qui", "ß", "an", "ver", "lo", "ñe", "th", "ing", "be", "o", "a", "ste", "pra")
        return "".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        s = self.words(low, high)
        return s[:1].upper() + s[1:] + self.r.choice((".", ".", ".", "!", "?", "", " ***", " $$$"))

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, self.r.choice((1, 2, most)))))

    def maybe(self, p: float) -> bool:
        return self.r.random() < p

    def attribute(self, *names: str) -> str:
        name = self.r.choice(names)
        name = self.r.choice((name, f"{name}-{self.word()}", f"{self.word()}_{name}", name.capitalize(), f"js {name} x{self.r.randint(1, 9)}"))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def put(self, text: str, main: bool = False, tag: str = "p", attrs: str = "") -> None:
        shown = text.replace("&", "&amp;").replace("<", "&lt;")
        if self.maybe(0.1):
            head, _, tail = shown.partition(" ")
            shown = f"<b>{head}</b> {tail}" if self.maybe(0.5) else f"{head} <a href='/{self.word()}'>{tail}</a>" if main and len(tail) < 30 and tail else f"<em>{shown}"
        close = "" if tag in ("p", "li") and self.maybe(0.1) else f"{self.r.choice(('', '<br>')) if tag == 'p' else ''}</{tag}>"
        self.parts.append(f"<{tag}{attrs}>{shown}{close}{self.r.choice(('', chr(10), '  '))}")
        if main and text.strip():
            self.main.append(" ".join(text.split()))

    def links(self, low: int = 2, high: int = 9) -> None:
        self.parts.append("<ul>")
        for _ in range(self.r.randint(low, high)):
            w = self.words(1, self.r.choice((1, 3, 7)))
            self.parts.append(f'<li><a href="/{self.word()}">{w}</a></li>')
        self.parts.append("</ul>")

    def wrap(self, tag: str, attrs: str, inner) -> None:
        self.parts.append(f"<{tag}{attrs}>")
        inner()
        self.parts.append(f"</{tag}>")

    def plain(self, most: int = 3):
        def inner() -> None:
            if self.maybe(0.3):
                self.put(self.words(1, 5), tag=self.r.choice(("h2", "h3", "h4", "p")))
            for _ in range(self.r.randint(1, most)):
                if self.maybe(0.3):
                    self.parts.append(f" {self.prose(3)} ")
                else:
                    self.put(self.prose(4), tag=self.r.choice(("p", "p", "div", "span", "li")))

        return inner

    def aside(self) -> None:
        """One piece of boilerplate."""
        kind = self.r.randrange(11)
        box = self.r.choice(("div", "div", "section", "aside"))
        if kind == 0:
            self.wrap("nav", self.r.choice(("", self.attribute("nav", "menu"))), self.links)
        elif kind == 1:
            self.wrap("div", self.attribute("ad", "advert", "sponsored", "promo", "banner", "ads"), self.plain())
        elif kind == 2:
            self.wrap(self.r.choice(("aside", "div")), self.attribute("sidebar", "widget", "side"), self.plain())
        elif kind == 3:
            self.wrap(box, self.attribute("comments", "comment-list", "disqus_thread", "replies"), self.plain(6))
        elif kind == 4:
            self.wrap(box, self.attribute("cookie", "consent", "notice", "privacy-notice", "popup", "alert"), self.plain(2))
        elif kind == 5:

            def inner() -> None:
                self.put(self.words(1, 4), tag=self.r.choice(("label", "p", "legend", "div")))
                self.parts.append(f'<input name="q"><textarea>{self.prose(2)}</textarea><select><option>{self.word()}</select><button>{self.word()}</button>')

            self.wrap("form", self.r.choice(("", self.attribute("search", "login", "newsletter", "subscribe"))), inner)
        elif kind == 6:
            self.wrap(box, self.attribute("related", "recommended", "popular", "more-stories", "latest"), self.links)
        elif kind == 7:
            self.wrap(self.r.choice(("div", "ul")), self.attribute("share", "social", "follow"), self.plain(2))
        elif kind == 8:
            self.wrap("aside", self.r.choice(("", self.attribute("sidebar"))), self.plain())
        elif kind == 9:
            self.wrap("div", self.attribute("breadcrumb", "pagination", "menu", "skip-links"), self.links)
        else:
            self.parts.append(f"<script>var x = '<p>{self.sentence()}</p>';</script><style>.{self.word()}{{}}</style><!-- {self.sentence()} <p> -->")

    def header(self) -> None:
        def inner() -> None:
            self.put(self.words(1, 4), tag=self.r.choice(("h1", "h2", "div", "p", "a")))
            if self.maybe(0.6):
                self.put(self.sentence(), tag=self.r.choice(("p", "div", "span")))
            if self.maybe(0.6):
                self.wrap("nav", "", self.links) if self.maybe(0.5) else self.links()

        self.wrap(self.r.choice(("header", "header", "div")), self.attribute("header", "masthead", "topbar"), inner)

    def footer(self) -> None:
        def inner() -> None:
            start = self.r.choice(("© ", "&copy; ", "Copyright ", "", ""))
            self.parts.append(f"{start}{self.word()}.example &middot; {self.sentence()}")
            if self.maybe(0.4):
                self.links()
            if self.maybe(0.3):
                self.put(self.prose(3))

        if self.maybe(0.8):
            self.wrap("footer", self.r.choice(("", self.attribute("footer"))), inner)
        else:
            self.wrap("div", self.attribute("footer", "copyright", "legal"), inner)

    def article(self) -> None:
        if self.maybe(0.85):
            title = self.words(2, 12)
            if self.maybe(0.15):
                self.wrap("header", self.r.choice(("", self.attribute("entry-header", "article-header"))), lambda: self.put(title, True, self.r.choice(("h1", "h1", "h2"))))
            else:
                self.put(title, True, self.r.choice(("h1", "h1", "h1", "h2")))
        for _ in range(self.r.choice((1, 2, 4, 8, 14))):
            kind = self.r.random()
            if kind < 0.72:
                if self.maybe(0.15):
                    self.parts.append(f"<p><b>{self.word()}.")  # never closed, and empty but for a word
                    self.main.append(self.parts[-1][6:])
                self.put(self.prose(), True, self.r.choice(("p", "p", "p", "p", "div")))
            elif kind < 0.78:
                self.put(self.words(2, 8), True, self.r.choice(("h2", "h3", "h4")))
            elif kind < 0.83:
                self.wrap("blockquote", "", lambda: self.put(self.prose(2), True))
            elif kind < 0.89:
                self.parts.append("<ul>" if self.maybe(0.5) else "<ol>")
                for _ in range(self.r.randint(2, 6)):
                    self.put(self.sentence(1, 12), True, "li")
                self.parts.append("</ul></ol>")
            elif kind < 0.92:
                self.parts.append("<table>")
                for _ in range(self.r.randint(1, 4)):
                    self.parts.append("<tr>")
                    for _ in range(self.r.randint(1, 3)):
                        self.put(self.words(1, 4), True, self.r.choice(("td", "td", "th")))
                    self.parts.append("</tr>")
                self.parts.append("</table>")
            elif kind < 0.95:
                self.wrap("figure", "", lambda: self.wrap("figcaption", "", lambda: self.put(self.sentence(), True, "p")))
            elif kind < 0.97:
                self.put(self.words(2, 12), True, "pre")
            else:
                self.aside()

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        self.parts.append(f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body{r.choice(('', self.attribute('page', 'home')))}>")
        outer = r.choice(("", "", "div", "main", "div"))
        if outer and self.maybe(0.3):
            self.parts.append(f"<{outer} id='wrapper'>")
        if self.maybe(0.5):
            self.header()
        for _ in range(r.choice((0, 1, 2, 3))):
            self.aside()
        kind = r.random()
        if kind < 0.5:
            self.wrap("article", r.choice(("", "", self.attribute("post", "entry", "story"))), self.article)
        elif kind < 0.62:
            self.wrap("main", r.choice(("", self.attribute("content"))), self.article)
        elif kind < 0.7:
            self.wrap("main", "", lambda: self.wrap("article", "", self.article))
        elif kind < 0.92:
            self.wrap(r.choice(("div", "div", "section")), self.attribute("content", "article-body", "post-content", "entry", "story", "main", "articleBody", "text"), self.article)
        else:
            self.wrap("div", r.choice(("", f' class="{self.word()}"')), self.article)
        for _ in range(r.choice((0, 1, 2, 3))):
            self.aside()
        if self.maybe(0.85):
            self.footer()
        text = "".join(self.parts)
        return text if self.maybe(0.15) else text + "</body></html>", self.main


def labelled_page(seed: int) -> tuple[str, list[Block], list[int]]:
    """A generated page, its blocks, and 1 for the blocks of its main text."""
    text, main = _Writer(seed).page()
    own, todo = blocks(text), list(main)
    labels = []
    for b in own:
        hit = bool(todo) and b.text == todo[0]
        labels.append(int(hit))
        if hit:
            todo.pop(0)
    return text, own, labels


@lru_cache(maxsize=1)
def model(pages: int = PAGES) -> Field:
    """The field trained on generated pages; once per process."""
    return train([labelled_page(SEED * 1_000_003 + i)[1:] for i in range(pages)])


def extract(page: str, field: Field) -> str:
    """Main text of one whole page: its kept blocks joined by line ends."""
    own = blocks(page)
    return "\n".join(b.text for b, keep in zip(own, field.decode(own), strict=True) if keep) if own else ""


def extract_pages(pages: DataFrame, field: Field | None = None, html: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with the main text and its number of code points."""
    field = field or model()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def one(page: str) -> tuple[str, int]:
        text = extract(page, field)
        return text, len(text)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "text string", "n_chars long"])
    return map_texts(pages, one, list(keep), html, schema, ["text", "n_chars"], [pa.string(), pa.int64()])


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
