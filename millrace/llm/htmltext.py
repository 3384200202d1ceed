"""Main text of HTML pages by maximum-scoring subsequence.

A page becomes a sequence of words and tags.  Words score positive and tags negative, with
weights estimated from labelled pages; one linear scan finds the contiguous region with
the best sum.  What markup says of a word (that it stands in an article, outside of the page's article, in
a menu, an advert or a footer) is evidence: a weight, learned like those of tags.  Menus and adverts before and after a page's other text are left out
because their words score negative; those with other text on both sides are cut out.  Scripts, styles and form fields are no words.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
HINTS = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
VALUES = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
HIDDEN = re.compile(r"(?:^|\s)(?:aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*|\S*)display\s*:\s*none)", re.IGNORECASE)

#: Elements of the HTML vocabulary by role.
RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())
RAW_TEXT = frozenset("title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
OPTIONAL_END = frozenset("p li dt dd td th tr thead tbody tfoot option".split())
CONTAINERS = frozenset("article aside blockquote body button canvas center dd details dialog dir div dl fieldset figure footer form head header html iframe legend main menu nav noscript object ol section select svg table template ul".split())
NEVER_TEXT = frozenset("aside button canvas dialog fieldset footer form head header iframe input label legend menu nav noscript object option script select style svg template textarea title".split())
NEVER_HINTS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget menu nav navbar navigation breadcrumb breadcrumbs masthead topbar header footer "
    "cookie cookies consent notice notices alert gdpr disclaimer popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations "
    "comment comments commentlist disqus respond replies pagination pager toolbar skip complementary contentinfo".split()
)
#: Parts of names that say nothing themselves; a name counts if all its other parts do (``site-footer``, not ``related-work`` or ``with-sidebar``).
NEUTRAL = frozenset("site page global main top bottom left right upper lower primary secondary inner outer box bar block list section area container wrapper wrap inline slot unit buttons button links items posts post text content widget widgets".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup title".split())
ARTICLE = frozenset(["article", "main"])
ARTICLE_HINTS = frozenset("article articlebody main content post entry story".split())
#: Elements whose text nobody reads as text.
NO_WORDS = frozenset("canvas head iframe input object option script select style svg template textarea title".split())
OWN_HEADER = frozenset(f".{x}" for x in ARTICLE_HINTS)

#: Kind under which tags within an article are scored.
INNER = "inner"
#: Kinds of words: in the page's article (or on a page without one), outside of it, in a menu, advert or the like.
WORDS = ("text", "stray", "menu")
#: An article element that holds less than this share of a page's words (a teaser) is no evidence.
CREDIBLE = 0.25


def _hints(attributes: str) -> set[str]:
    """Lower-case words for what an element is, from class names, ids, roles and labels of which every part counts; parts of other names come with a dot."""
    found: set[str] = set()
    for m in HINTS.finditer(attributes) if "=" in attributes else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        for name in [value] if m[1].lower() == "aria-label" else value.split():
            parts = [x for x in re.split(r"[^a-z0-9]+", name) if x and not x.isdigit()]
            telling = [x for x in parts if x not in NEUTRAL or x in NEVER_HINTS]
            whole = all(x in NEVER_HINTS or x in ARTICLE_HINTS for x in telling)
            found.update(telling if whole else (f".{x}" for x in parts))
            found.update(f".{x}" for x in parts)
    return found


def _hidden(attributes: str) -> bool:
    """Whether the element is not shown: the attribute ``hidden`` itself, ``aria-hidden`` or a style."""
    return "hidden" in VALUES.sub("", attributes).lower().split() or bool(HIDDEN.search(attributes))


def events(page: str) -> list[tuple[str, str, bool]]:
    """The page in order: ``(kind, text, inner)``, kind one of ``WORDS``, ``skip`` (no words) or a tag name; closing tags begin with ``/``.

    Texts are raw.  Text in a menu, an advert or the like is ``menu`` before and after all other words, ``skip`` between them.  On a page whose article
    elements hold less than ``CREDIBLE`` of its words, or that has none, words are ``text`` wherever they stand.
    ``inner`` tags stand within an article; of a part that is never article text only the outermost tags are events.
    """
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, never text, no words, article
    open_now: Counter[str] = Counter()
    never, wordless, article, at, n = 0, 0, 0, 0, len(page)
    held: Counter[str] = Counter()

    def text(raw: str) -> None:
        if raw:
            kind = "skip" if wordless else "menu" if never else "text" if article else "stray"
            held[kind] += len(raw.split())
            out.append((kind, raw, False))

    def close() -> str:
        nonlocal never, wordless, article
        name, bad, mute, is_article = stack.pop()
        open_now[name] -= 1
        never, wordless, article = never - bad, wordless - mute, article - is_article
        return name

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue  # comment, doctype or processing instruction
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if open_now[name]:
                while close() != name:
                    pass
            if not never:
                out.append((f"/{name}", "", article > 0))
            continue
        if not never:
            out.append((name, "", article > 0))
        if name in RAW or name in RAW_TEXT:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = end.start() if end else n
            continue
        if name in VOID or attributes.endswith("/") and name not in CONTAINERS:
            continue
        hints = _hints(attributes) if attributes else set()
        # the header of an article holds its title, that of a page doesn't
        own_header = name == "header" and article > 0
        is_article = name in ARTICLE
        hidden = bool(attributes) and _hidden(attributes)
        bad = not is_article and name not in ("html", "body") and (name in NEVER_TEXT and not own_header or bool(hints & NEVER_HINTS) and name not in HEADINGS and not (article and hints & OWN_HEADER and "header" in hints) or hidden)
        mute = bad and (name in NO_WORDS or hidden)
        if not (name in CONTAINERS or bad):
            if name in OPTIONAL_END and stack and stack[-1][0] == name:
                close()
            continue
        # an element whose end may be left out goes up to its end tag or the next of its kind
        counts = name in CONTAINERS or name not in OPTIONAL_END
        stack.append((name, bad, mute, is_article and counts))
        open_now[name] += 1
        never, wordless, article = never + bad, wordless + mute, article + (is_article and counts)
    own = [k for k, (kind, raw, _) in enumerate(out) if kind in WORDS[:2] and raw.strip()]
    if own:
        out[own[0] : own[-1]] = [("skip" if kind == "menu" else kind, raw, inner) for kind, raw, inner in out[own[0] : own[-1]]]
    if held["text"] and held["text"] >= CREDIBLE * (held["text"] + held["stray"]):
        return out
    return [("text" if kind == "stray" else kind, raw, False) for kind, raw, _ in out]


#: Labelled pages: the markup, and the article's blocks.  Written for this purpose; half of them mark neither article nor menus.
LABELLED_PAGES: list[tuple[str, list[str]]] = [
    ('<html><head><title>t</title></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><div class="ad">buy this now</div><article><h1>Rain ahead</h1><p>Clouds move in from the west.</p><p>Wind grows.<br>Later it calms.</p></article><footer>c site</footer></body></html>', ["Rain ahead", "Clouds move in from the west.", "Wind grows.", "Later it calms."]),
    ('<html><body><header><a href="/">Home</a></header><div><p>Bread needs four things: flour, water, salt and time.</p><p>Mix, wait, fold, bake.</p></div><aside><h3>More</h3><ul><li><a href="/c">Cakes</a></li></ul></aside><footer>Imprint</footer></body></html>', ["Bread needs four things: flour, water, salt and time.", "Mix, wait, fold, bake."]),
    ('<html><body><div>Welcome</div><main><h1>Bees</h1><p>A hive has one queen.</p><ul><li>workers</li><li>drones</li></ul><p>They live on <a href="/n">nectar</a> and pollen.</p></main><form><input name="q"><button>Go</button></form><section id="comments"><p>Nice!</p></section></body></html>', ["Bees", "A hive has one queen.", "workers", "drones", "They live on nectar and pollen."]),
    ('<html><body><table><tr><td><a href="/1">A</a></td><td><a href="/2">B</a></td></tr></table><div><h2>Tides</h2><p>The moon pulls the sea twice a day, and <b>spring</b> tides are the highest.</p></div><div><a href="/x">x</a> <a href="/y">y</a></div></body></html>', ["Tides", "The moon pulls the sea twice a day, and spring tides are the highest."]),
    ('<html><body><div class="menu"><a href="/">Home</a></div><div><h2>Soil</h2><div class="text"><p>Clay holds water.</p><div class="ad">Buy pots</div><p>Sand lets it run.</p></div><div><p>Loam does both.</p></div><div><div><p>Peat is sour.</p></div></div><p>Test it first.</p></div><div class="footer">Imprint</div></body></html>', ["Soil", "Clay holds water.", "Sand lets it run.", "Loam does both.", "Peat is sour.", "Test it first."]),
    ('<html><body><table><tr><td><a href="/">Home</a></td><td><a href="/n">News</a></td><td><a href="/c">Contact</a></td></tr></table><table><tr><td><h1>Glaciers</h1><p>Ice that lasts for years begins to flow under its own weight.</p><p>It carves valleys and <i>carries</i> stones along.</p></td><td><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul></td></tr></table></body></html>', ["Glaciers", "Ice that lasts for years begins to flow under its own weight.", "It carves valleys and carries stones along."]),
    ('<body><div><a href="/">Start</a> <a href="/a">About</a> <a href="/m">Map</a></div><div><h2>Clocks</h2><p>A pendulum keeps time because each swing takes as long as the last.</p><p>Springs made clocks small enough to carry in a pocket.</p></div><div><a href="/p">Privacy</a> <a href="/t">Terms</a></div></body>', ["Clocks", "A pendulum keeps time because each swing takes as long as the last.", "Springs made clocks small enough to carry in a pocket."]),
    ('<body><div><p>Salt was once worth its weight in silver, and roads were built to move it.</p><aside>Buy salt</aside><p>Today it melts the ice on them.</p><form><input><button>Send</button></form><p>Too much of it harms the soil beside the road.</p></div><div><ul><li><a href="/x">x</a></li><li><a href="/y">y</a></li></ul></div></body>', ["Salt was once worth its weight in silver, and roads were built to move it.", "Today it melts the ice on them.", "Too much of it harms the soil beside the road."]),
    ('<body><div><ul><li><a href="/1">a</a></li><li><a href="/2">b</a></li><li><a href="/3">c</a></li><li><a href="/4">d</a></li></ul></div><div><h1>Tea</h1><p>Leaves are picked by hand, <a href="/w">withered</a>, rolled and dried.</p><blockquote>A cup of tea makes everything better.</blockquote><p>Water just off the boil suits <a href="/g">green</a> tea best.</p></div></body>', ["Tea", "Leaves are picked by hand, withered, rolled and dried.", "A cup of tea makes everything better.", "Water just off the boil suits green tea best."]),
    ('<body><div>Our paper is free for readers of this site and will stay so as long as many of you help us to pay for it</div><main><h1>Wells</h1><p>Water stands in them at the level of the ground water.</p></main><div>Write to us</div></body>', ["Wells", "Water stands in them at the level of the ground water."]),
    ('<body><article><h1>Knots</h1><section id="related-work"><h2 id="related">Kinds</h2><p title="the hidden end">A bowline holds and comes undone with ease.</p></section><dl><dt>Hitch</dt><dd>ties a rope to a post</dd></dl><pre>over under</pre></article><div><a href="/k">k</a></div></body>', ["Knots", "Kinds", "A bowline holds and comes undone with ease.", "Hitch", "ties a rope to a post", "over under"]),
]


def _counted(labelled: Sequence[tuple[str, list[str]]]) -> tuple[dict[str, float], dict[str, float]]:
    """How often words and tags of each kind stand inside an article of the labelled pages, and in all."""
    inside: dict[str, float] = defaultdict(float)
    seen: dict[str, float] = defaultdict(float)
    for page, blocks in labelled:
        wanted = set(" ".join(blocks).split())
        found = events(page)
        hit = [kind in WORDS[:2] and bool(wanted & set(html.unescape(raw).split())) for kind, raw, _ in found]
        first, last = hit.index(True), len(hit) - 1 - hit[::-1].index(True)
        # the tags around the first and the last block are part of them
        while first and found[first - 1][0] not in CONTAINERS and not found[first - 1][0].startswith("/") and found[first - 1][0] not in (*WORDS, "skip"):
            first -= 1
        while last + 1 < len(found) and found[last + 1][0].startswith("/") and found[last + 1][0][1:] not in CONTAINERS:
            last += 1
        for k, (kind, raw, inner) in enumerate(found):
            n = len(raw.split()) if kind in WORDS else 0 if kind == "skip" else 1
            kind = f"{INNER}:{kind}" if inner else kind
            seen[kind] += n
            inside[kind] += n * (first <= k <= last)
    return inside, seen


#: How much an odd tag may weigh against a word, and what is added to counts before odds are taken: the first pair that reads most labelled pages right is taken.
SCALES, SMOOTHS = (0.5, 1.0, 2.0, 3.0, 4.0), (1.0, 0.5, 0.25, 0.05)


def learn_weights(labelled: Sequence[tuple[str, list[str]]], word: float = 1.0) -> dict[str, float]:
    """Scores of words and tags: log odds of standing inside the article, tags never above zero.

    ``word`` is the least score of a word.  How tags weigh against words is fitted on the same pages.
    """
    inside, seen = _counted(labelled)

    def weighed(scale: float, smooth: float) -> dict[str, float]:
        weights = {}
        for kind, n in seen.items():
            odds = math.log((inside[kind] + smooth) / (n - inside[kind] + smooth))
            weights[kind] = word * odds if kind in WORDS else min(UNSEEN_INNER, scale * odds)
        weights["text"] = word
        for kind in WORDS[1:]:
            weights[kind] = max(-word, min(weights.get(kind, -word), -word / 2))
        return weights

    tried = [weighed(scale, smooth) for smooth in SMOOTHS for scale in SCALES]
    return max(tried, key=lambda w: sum(main_text(page, w).split("\n") == blocks for page, blocks in labelled))


#: Score of tags that no labelled page has, and of those within an article.
UNSEEN, UNSEEN_INNER = -0.1, -0.01


def best_region(found: list[tuple[str, str, bool]], weights: dict[str, float]) -> tuple[int, int]:
    """First event and end of the region with the largest sum, by one scan; the earliest of equals, empty if none is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for k, (kind, raw, inner) in enumerate(found):
        if kind == "skip":
            continue
        score = (weights.get(f"{INNER}:{kind}", UNSEEN_INNER) if inner else weights.get(kind, UNSEEN)) * (len(raw.split()) if kind in WORDS else 1)
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, where = total, (start, k + 1)
    return where


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The article's blocks, one a line; empty for null, empty and textless pages.

    All words of the best region.  Character references are decoded after the
    markup is read, white space inside a block becomes one space.
    """
    if not page:
        return ""
    found = events(page)
    start, end = best_region(found, weights)
    blocks: list[list[str]] = [[]]
    for kind, raw, _ in found[start:end]:
        if kind in WORDS:
            blocks[-1].append(raw)
        elif kind.lstrip("/") in BLOCKS and blocks[-1]:
            blocks.append([])
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, labelled: Sequence[tuple[str, list[str]]] = LABELLED_PAGES) -> DataFrame:
    """Replace ``html`` by ``text`` (the main text, empty if there is none) and ``n_chars`` (its code points).

    Pages are read whole, each by itself, whatever their length; null and empty html give
    empty text; repeated rows are treated alike; columns of the input named as the new
    ones are replaced.  Markup that never ends runs to the end of the page.
    """
    weights = learn_weights(labelled)

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page, weights) for page in batch], dtype="object")

    return pages.drop("text", "n_chars").withColumn("text", read("html")).withColumn("n_chars", F.char_length("text").cast("long")).drop("html")
