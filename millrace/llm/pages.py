"""One page's text blocks and containers, from its html."""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash

#: Comment, declaration, or tag with its attributes; a quoted value may hold ">", a quote elsewhere means nothing.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+(?:>|\Z))", re.DOTALL)
#: A name and its value, in order, so that nothing is looked for inside a value.
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?)?+")
#: Elements whose content is no markup.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that hold one block; their text counts for the container around them.
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary address".split())
#: Elements and roles of what is not the article.
ASIDE = set("head nav header footer aside script style noscript template menu dialog button select option svg canvas object audio video map".split())
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Names that make an element a suspect of not being the article.
ASIDE_NAMES = re.compile(
    r"(?:^|[_-])(?:ads?|adv|advert\w*|adsense|ad-?(?:slot|box|unit|banner)s?|sponsor\w*|promo\w*|banner\w*|(?:top|main|sub|site)?-?nav\w*|menus?|breadcrumbs?|sidebars?|side|aside|rail|footers?|foot|copyright|colophon|headers?|masthead|topbar|toolbar"
    r"|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletter|subscri\w+|sign-?up|login|forms?|share|sharing|social|related|recommend\w*|widgets?|pagination|pager"
    r"|comments?|commentlist|reply|replies|disqus|discussion|respond|skip|hidden|disclaimer)(?=$|[_-])",
    re.IGNORECASE,
)
#: What is never the article, however much text it holds: readers' comments may be longer than it.
NEVER_NAMES = re.compile(
    r"(?:^|[_-])(?:comments?|commentlist|reply|replies|disqus|discussion|respond|cookies?|consent|gdpr|copyright|colophon|footers?|newsletter|subscri\w+|sign-?up|login|forms?|pagination|pager|(?:top|main|sub|site)?-?nav\w*|menus?|breadcrumbs?|skip|hidden)(?=$|[_-])",
    re.IGNORECASE,
)
#: Names that tell what the layout around an element has or lacks.
LAYOUT_NAMES = re.compile(r"(?:^|[_-])(?:has|with|without|no)[_-]", re.IGNORECASE)
#: Names that also speak for the article or for the frame of the page.
FRAME_NAMES = re.compile(r"(?:^|[_-])(?:article|post|entry|story|content|main|body|text|news|page|site|layout|wrap|wrapper|container|root)(?=$|[_-])", re.IGNORECASE)
#: A suspect whose name also speaks for it is the article if it holds more than this share of the text, and less than this share of that in links.
MOST, LINKED = 0.5, 0.3
#: Longer paths are told by their hash, so that deep nesting costs no more than wide.
LONGEST_PATH = 1000
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?=$|[\s_-])", re.IGNORECASE)
DIGITS = re.compile(r"\d+")


#: What the names say: nothing against the element; it is one if it holds most of the text; only if nothing else is left; only if an article is inside and nothing else is left.
FREE, MIXED, SUSPECT, NEVER = range(4)


def _named(tag: str, attributes: str) -> tuple[str, bool, int, bool]:
    """The element's generalised name, whether it surely stands beside the article, what its names say, whether it claims to be the article."""
    form = NEVER if tag == "form" else FREE
    if not attributes.strip("/> \t\r\n"):
        return tag, tag in ASIDE, form, tag in ("article", "main")
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    role = found.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article")
    aside = tag in ASIDE or role in ASIDE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    says = form
    # The names of the page's outermost elements tell its layout, not what they hold.
    if tag not in ("html", "body") and not main:
        for n in names:
            if ASIDE_NAMES.search(n) and not LAYOUT_NAMES.search(n):
                # Mixed names of comments, footers and the like ("post-comments") are theirs.
                says = max(says, NEVER if NEVER_NAMES.search(n) else MIXED if FRAME_NAMES.search(n) else SUSPECT)
    general = sorted({DIGITS.sub("0", n).replace("\x00", "") for n in names})
    return ".".join([tag, *general]), aside, says, main or any(MAIN_NAMES.search(n) for n in names)


class Page:
    """``blocks``: (container, text) in page order; containers have a parent, a path and whether they claim to be the article.

    A suspect's blocks are read and then judged by what the whole page holds: `_judge`.
    """

    def __init__(self, source: str | None):
        self.parent, self.path, self.main = [-1], [""], [False]
        #: Suspect 0 stands for the page; each other has one around it, what its names say, whether it is a form,
        #: and whether an article or main element is inside (2), or at least the page's heading (1).
        self._around, self._says, self._form, self._holds = [-1], [FREE], [False], [0]
        #: (container, suspect, text, characters in links) of each block.
        self._found: list[tuple[int, int, str, int]] = []
        self._read(source or "")
        self.blocks: list[tuple[int, str]] = self._judge()

    def _judge(self) -> list[tuple[int, str]]:
        """The blocks outside suspects that are not the article. If there are none, suspects that may be it are read."""
        around, says, n = self._around, self._says, len(self._says)
        # Text of the page and of each suspect, without that of elements inside which aren't the article by their names alone.
        frame = [self._form[k] and self._holds[k] == 2 for k in range(n)]
        out = [False] * n
        for k in range(1, n):
            out[k] = out[around[k]] or (says[k] >= SUSPECT and not frame[k])
        size, linked = [0] * n, [0] * n
        for _, suspect, text, links in self._found:
            size[suspect] += 0 if out[suspect] else len(text)
            linked[suspect] += 0 if out[suspect] else links
        for k in range(n - 1, 0, -1):  # what is inside comes later
            size[around[k]] += size[k]
            linked[around[k]] += linked[k]

        def read(cleared: list[bool]) -> list[tuple[int, str]]:
            kept = [True] * n
            for k in range(1, n):
                kept[k] = kept[around[k]] and cleared[k]
            return [(c, text) for c, suspect, text, _ in self._found if kept[suspect]]

        most = [says[k] == MIXED and size[k] > MOST * size[0] and linked[k] < LINKED * size[k] for k in range(n)]
        return read([a or b for a, b in zip(most, frame, strict=True)]) or read([says[k] <= SUSPECT or self._holds[k] > 0 for k in range(n)])

    def _read(self, source: str) -> None:
        # Each open element: tag, container, whether its text is left out, suspect.
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
        n_open: Counter = Counter()
        runs: list[str] = []
        in_link, links = False, 0

        def close() -> None:
            """Ends the running block."""
            nonlocal in_link, links
            if runs:
                if text := " ".join(html.unescape("".join(runs)).split()):
                    self._found.append((stack[-1][1], stack[-1][3], text, links))
                runs.clear()
            in_link, links = False, 0

        def cut(depth: int) -> None:
            """Closes the open elements from ``depth`` on."""
            while len(stack) > depth:
                n_open[stack.pop()[0]] -= 1

        at = 0
        while token := TOKEN.search(source, at):
            if token.start() > at and not stack[-1][2]:
                runs.append(source[at : token.start()])
                links += in_link * (token.start() - at)
            at = token.end()
            if token[2] is None:
                continue
            tag = token[2].lower()
            if tag == "a":
                in_link = not token[1]
            if token[1]:
                if tag not in INLINE:
                    close()
                if n_open[tag]:
                    while stack[-1][0] != tag:
                        cut(len(stack) - 1)
                    cut(len(stack) - 1)
                continue
            if tag == "br" or tag == "hr":
                close()
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
                continue
            name, aside, says, main = _named(tag, token[3])
            suspect = stack[-1][3]
            if tag in INLINE:
                if aside or says >= SUSPECT:
                    stack.append((tag, stack[-1][1], True, suspect))
                    n_open[tag] += 1
                continue
            close()
            if stack[-1][0] == "p" or (tag == "li" and stack[-1][0] == "li"):
                cut(len(stack) - 1)
            if tag == "body":  # whatever the head left open
                cut(1)
            if not (token[3].endswith("/>") and tag in ("svg", "path")):
                _, container, dropped, suspect = stack[-1]
                dropped = dropped or aside
                if not dropped:
                    if says:
                        self._around.append(suspect)
                        self._says.append(says)
                        self._form.append(tag == "form")
                        self._holds.append(0)
                        suspect = len(self._says) - 1
                    around, held = suspect, 2 if tag in ("article", "main") else tag == "h1"
                    while around and self._holds[around] < held:
                        self._holds[around] = held
                        around = self._around[around]
                    if tag not in LEAVES and tag not in ("html", "body"):
                        self.parent.append(container)
                        path = f"{self.path[container]}/{name}"
                        self.path.append(path if len(path) <= LONGEST_PATH else "#" + xxhash.xxh3_128_hexdigest(path))
                        self.main.append(main)
                        container = len(self.parent) - 1
                stack.append((tag, container, dropped, suspect))
                n_open[tag] += 1
        if not stack[-1][2]:
            runs.append(source[at:])
            links += in_link * (len(source) - at)
        close()

    def scores(self) -> list[int]:
        """Characters that each container stands for: its own blocks; half of them for the container around it.

        Blocks inside an element that claims to be the article count for the outermost such element alone.
        """
        totals = [0] * len(self.parent)
        claims = [-1] * len(self.parent)
        for c in range(1, len(self.parent)):
            claims[c] = claims[self.parent[c]] if claims[self.parent[c]] >= 0 else (c if self.main[c] else -1)
        for c, text in self.blocks:
            if claims[c] >= 0:
                totals[claims[c]] += 2 * len(text)
            else:
                totals[c] += len(text)
                if c:
                    totals[self.parent[c]] += len(text) // 2
        return totals

    def best(self) -> int:
        """The container with the highest score, the first of equals."""
        totals = self.scores()
        return max(range(len(totals)), key=totals.__getitem__)

    def text(self, roots: set[int]) -> str:
        """The blocks inside the given containers, one a line."""
        inside = [k in roots for k in range(len(self.parent))]
        for c in range(1, len(self.parent)):
            inside[c] = inside[c] or inside[self.parent[c]]
        return "\n".join(text for c, text in self.blocks if inside[c])
