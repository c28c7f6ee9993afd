"""Leaf blocks of web pages, and a generator of labelled pages to train on."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape, unescape
from random import Random

# Element names of the HTML standard.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
search section summary table tbody td tfoot th thead tr ul""".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset("head select button svg object audio video canvas datalist".split())
# Start tags that leave an open head open; any other, and any text, is the start of the body.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An element that a start tag closes if it is open within the given container.
CLOSES = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "td": ("td th", "tr table"),
          "th": ("td th", "tr table"), "tr": ("tr td th", "table"), "tbody": ("tbody thead tfoot tr td th", "table"),
          "option": ("option", "select datalist"), "body": ("head", "html")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

DEPTH = 60  # block-level elements that a path holds, from the nearest on; those above are in a chain that blocks share

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BUTTON = re.compile(r"<(/?)button\b", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Above:
    """An ancestor too far up for a path, and those above it; a page has one for each sequence of ancestors."""

    __slots__ = ("buckets", "entry", "parent")

    def __init__(self, parent: Above | None, entry: tuple[str, tuple[str, ...]]):
        self.parent, self.entry, self.buckets = parent, entry, None


@dataclass
class Block:
    """Text of a leaf block, the ancestors (tag, names) above it, and how much of the text is in links."""

    path: tuple
    text: str
    linked: int = 0
    parts: list = field(default_factory=list)
    above: Above | None = None  # ancestors before those of the path

    @property
    def place(self) -> tuple:
        """Equal for blocks of a page that have equal ancestors."""
        return self.path, self.above


def names(attrs: str) -> tuple[str, ...]:
    """Words of an element's class, id, role and itemprop."""
    if "=" not in attrs:
        return ()
    found = " ".join(a or b or c for _, a, b, c in ATTR.findall(attrs))
    return tuple(sorted({w.lower() for w in WORD.findall(found)}))


def blocks(html: str) -> list[Block]:
    """The page's leaf blocks in order: runs of text between block-level tags, references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[tuple[str, tuple[str, ...]]] = []  # the stack's block-level elements
    chain: list[Above] = []  # for each of them but the nearest DEPTH
    known: dict[tuple, Above] = {}
    opened: Counter[str] = Counter()
    hidden = links = linked = 0
    loose = False  # the last button has no end tag of its own
    parts: list[str] = []
    at, size, lower = 0, len(html), None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(held[-DEPTH:]), text, linked, above=chain[-1] if chain else None))
            parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal hidden, links
        for name, _ in stack[k:]:
            hidden -= name in UNSEEN
            links -= name == "a"
            opened[name] -= 1
            if name in BLOCKS:
                held.pop()
        del stack[k:], chain[max(0, len(held) - DEPTH):]

    def close(name: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                pop_to(k)
                break

    while at < size:
        tag = TAG.search(html, at)
        until = tag.start() if tag else size
        if hidden and opened["head"] and html[at:until].strip(" \t\n\f\r"):
            close("head")
        if until > at and not hidden:
            text = unescape(html[at:until])
            parts.append(text)
            if links:
                linked += len(text)
        if not tag:
            break
        at = tag.end()
        if not tag["name"]:
            continue
        name = tag["name"].lower()
        if tag["end"]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if name not in BLOCKS and name not in UNSEEN and stack[k][0] in BLOCKS:
                    break
            continue
        if opened["head"] and name not in IN_HEAD:
            close("head")
        if name in RAW:
            lower = lower or html.lower()
            end = lower.find("</" + name, at) if len(lower) == size else -1
            if len(lower) != size:  # lowering changed the length: look for the end with a pattern
                found = re.compile("</" + name, re.I).search(html, at)
                end = found.start() if found else -1
            at = end if end >= 0 else size
            continue
        if name in BLOCKS:
            flush()
            # a block-level tag is the end of a drawing (but for one that embeds a page), and of a button that nothing else ends
            if opened["svg"] and not opened["foreignobject"] and not opened["desc"]:
                close("svg")
            if loose and opened["button"]:
                close("button")
            closed, within = _CLOSES.get(name, (frozenset(("p",)), frozenset()))
            for k in range(len(stack) - 1, -1, -1) if any(opened[c] for c in closed) else ():
                if stack[k][0] in within or (not within and stack[k][0] in BLOCKS and stack[k][0] != "p"):
                    break
                if stack[k][0] in closed:
                    pop_to(k)
                    if not within:
                        break
        if name == "br":
            parts.append(" ")
        if name in EMPTY or name == "head" and opened[name] or tag["attrs"].endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, names(tag["attrs"])))
        if name in BLOCKS:
            held.append(stack[-1])
            if len(held) > DEPTH:
                key = (chain[-1] if chain else None, held[-DEPTH - 1])
                chain.append(known.setdefault(key, Above(*key)))
        if name == "button":
            following = BUTTON.search(html, at)
            loose = not following or not following[1]
        hidden += name in UNSEEN
        links += name == "a"
        opened[name] += 1
    flush()
    return out


class Pages:
    """Invented pages of many layouts; content is marked by a character that no page has."""

    MARK = ""
    # Names that sites give to the parts of a page.
    PARTS = {
        "menu": "nav menu navbar navigation topnav breadcrumb tabs links toolbar", "head": "header masthead banner top branding logo",
        "foot": "footer copyright bottom legal colophon credits", "side": "sidebar aside widget related rail recommended trending tags",
        "notice": "cookie notice consent banner alert gdpr message popup modal privacy", "ad": "ad ad ads advert advertisement sponsor sponsored promo banner",
        "form": "form search login newsletter subscribe signup contact feedback", "talk": "comments comment discussion replies reply responses commentlist disqus thread",
        "share": "share social sharing buttons tools meta", "body": "content article post entry story text body main page single hentry",
    }
    SAY = {
        "menu": "Home|About|News|Contact|Products|Blog|Archive|Help|Login|Sitemap", "foot": "All rights reserved|Terms of use|Privacy policy|Imprint|Powered by",
        "notice": "We use cookies|Accept all|This site uses cookies|Important notice|Learn more", "ad": "Advertisement|Sponsored|Buy now|Special offer",
        "form": "Subscribe to our newsletter|Your email|Search|Sign in|Send|Password|Leave a reply", "talk": "Comments|3 comments|Reply|Reader comments|Leave a comment|says|Discussion",
        "side": "Related articles|Popular posts|Most read|Tags|You may also like", "share": "Share|Tweet|Print|Email this", "head": "Skip to content|Daily news",
    }

    def __init__(self, seed: int):
        self.random = Random(seed)
        r = self.random
        starts, ends = ["", *"bcdfghklmnprstvz", "st", "ch", "pr"], ["", "", "n", "r", "s", "ng", "l"]
        parts = [a + v + e for a in starts for v in "aeiouäé" for e in ends]
        self.words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(100_000)]

    def sentence(self, low: int = 4, high: int = 18) -> str:
        r = self.random
        words = [r.choice(self.words) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high))]
        return escape(" ".join(words).capitalize().rstrip(",") + r.choice("....!?"))

    def prose(self, low: int = 1, high: int = 7) -> str:
        r = self.random
        out = [self.sentence() for _ in range(r.randint(low, high))]
        if r.random() < 0.2:
            out.append(f'<a href="/{r.choice(self.words)}">{r.choice(self.words)}</a> {r.choice(self.words)}.')
        if r.random() < 0.2:
            out.insert(0, f"<b>{r.choice(self.words)}</b>")
        return " ".join(out)

    def attrs(self, part: str) -> str:
        """Usually a telling class or id, sometimes none or one that tells nothing."""
        r = self.random
        if r.random() < 0.15:
            return ""
        if r.random() < 0.2:
            return f' class="{r.choice("abcxyz")}{r.randint(1, 99)}"'
        name = r.choice(self.PARTS[part].split())
        name = r.choice([name, name, f"{name}-{r.choice(['box', 'area', 'wrap', 'list', 'item', 'inner'])}", f"site-{name}"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def wrap(self, part: str, inner: str, tag: str | None = None) -> str:
        r = self.random
        named = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "talk": "section"}
        tag = tag or (named[part] if part in named and r.random() < 0.6 else r.choice(["div", "div", "section"]))
        return f"<{tag}{self.attrs(part)}>{inner}</{tag}>"

    def links(self, part: str, count: int) -> str:
        r = self.random

        def label() -> str:
            if part in self.SAY and r.random() < 0.3:
                return r.choice(self.SAY[part].split("|"))
            text = " ".join(r.choice(self.words) for _ in range(r.choice([1, 1, 1, 2, 3, 6])))
            return (text.capitalize() if r.random() < 0.4 else text) + r.choice(["", "", ".", ",", "!", "?"])

        link = lambda k: f'<a href="/{k}">{label()}</a>' if r.random() < 0.95 else label()
        kind = r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{link(k)}</li>" for k in range(count)) + "</ul>"
        if kind < 0.75:
            return "".join(f"<{(t := r.choice(['div', 'p']))}>{link(k)}</{t}>" for k in range(count))
        return r.choice([" | ", " ", " &middot; "]).join(link(k) for k in range(count))

    def said(self, part: str) -> str:
        return self.random.choice(self.SAY[part].split("|"))

    def boilerplate(self, part: str) -> str:
        r = self.random
        if part == "menu":
            return self.wrap(part, self.links(part, r.randint(3, 9)))
        if part == "head":
            return self.wrap(part, f"<div>{self.sentence(1, 5)}</div>" + (self.links("menu", r.randint(2, 5)) if r.random() < 0.5 else f"<p>{self.sentence(2, 6)}</p>"))
        if part == "foot":
            inner = f"&copy; {r.choice(self.words)}.example &middot; {self.sentence()}" if r.random() < 0.6 else f"<p>{self.said(part)}</p><p>{self.prose(1, 2)}</p>"
            return self.wrap(part, inner + (self.links(part, 3) if r.random() < 0.4 else ""))
        if part == "side":
            inner = f"<h3>{self.said(part)}</h3>" + (self.links(part, r.randint(2, 6)) if r.random() < 0.6 else f"<p>{self.prose(1, 3)}</p><p>{self.sentence()}</p>")
            return self.wrap(part, inner)
        if part == "ad":
            return self.wrap(part, r.choice([self.sentence(2, 18), self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>", f'<a href="/b">{self.said(part)}</a>']), "div")
        if part == "notice":
            return self.wrap(part, r.choice([f"<p>{self.said(part)}. {self.prose(1, 2)}</p>", self.prose(1, 2), f"{self.said(part)} <a href='#'>OK</a>"]), "div")
        if part == "form":
            return self.wrap(part, f"<label>{self.said(part)}</label><input type=text><p>{self.sentence(2, 9)}</p><button>{self.said(part)}</button>", r.choice(["form", "form", None]))
        if part == "talk":
            one = lambda: self.wrap("talk", r.choice([
                f"<b>{r.choice(self.words)}</b> {self.said('talk')} <p>{self.prose(1, 3)}</p>", f"<p>{self.prose(1, 4)}</p>", self.prose(1, 2)]), r.choice(["div", "li", "article", "p"]))
            title = f"<h{r.randint(2, 4)}>{self.said('talk')}</h{3}>" if r.random() < 0.7 else ""
            return self.wrap(part, title + "".join(one() for _ in range(r.randint(1, 5))), r.choice(["section", "div", "ol"]))
        return self.wrap(part, self.links(part, r.randint(2, 4)), "div")

    def content(self) -> str:
        """The article's own blocks, marked; now and then with boilerplate in between."""
        r, m = self.random, self.MARK
        out = [f"<h1>{m}{self.sentence(2, 9)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12])):
            kind = r.random()
            if kind < 0.70:
                out.append(f"<p>{m}{self.prose()}" + ("</p>" if r.random() < 0.9 else ""))
            elif kind < 0.77:
                out.append(f"<h{(k := r.randint(2, 4))}>{m}{self.sentence(1, 6)}</h{k}>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{m}{self.sentence(2, 14)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{m}{self.prose(1, 3)}</p></blockquote>")
            elif kind < 0.95:
                out.append(f"<p>{m}{self.sentence(1, 8)}</p>")
            elif kind < 0.97:
                out.append(f"<div>{m}{self.prose(1, 4)}</div>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{m}{r.choice(self.words)}</td><td>{m}{self.sentence(1, 5)}</td></tr>" for _ in range(3)) + "</table>")
            if r.random() < 0.12:
                out.append(self.boilerplate(r.choice(["ad", "share", "side", "form"])))
        return "".join(out)

    def page(self) -> str:
        r = self.random
        inner = self.content()
        if r.random() < 0.12:
            inner += self.boilerplate("talk")
        holder = r.choice(["article", "article", "main", "div", "div", "section", "td", None])
        if holder == "td":
            inner = f"<table><tr><td>{self.links('menu', 4)}</td><td>{inner}</td></tr></table>"
        elif holder:
            attrs = self.attrs("body") if holder != "article" or r.random() < 0.5 else ""
            inner = f"<{holder}{attrs}>{inner}</{holder}>"
            if r.random() < 0.3:
                inner = f"<main>{inner}</main>" if holder != "main" else f"<div{self.attrs('body')}>{inner}</div>"
        before = [p for p, often in (("notice", 0.3), ("head", 0.5), ("menu", 0.7), ("ad", 0.6), ("form", 0.2)) if r.random() < often]
        after = [p for p, often in (("share", 0.2), ("ad", 0.25), ("talk", 0.4), ("side", 0.4), ("form", 0.3), ("menu", 0.15), ("foot", 0.8), ("notice", 0.15)) if r.random() < often]
        r.shuffle(before)
        body = "".join(map(self.boilerplate, before)) + inner + "".join(map(self.boilerplate, after))
        return f"<!DOCTYPE html><html><head><title>{self.sentence(2, 6)}</title></head><body>{body}</body></html>"

    def labelled(self, count: int) -> Iterator[tuple[list[Block], list[int]]]:
        """Pages as blocks, and for each block whether it is content."""
        for _ in range(count):
            found = blocks(self.page())
            labels = [int(self.MARK in b.text) for b in found]
            for b in found:
                b.text = b.text.replace(self.MARK, "").strip()
            yield found, labels
