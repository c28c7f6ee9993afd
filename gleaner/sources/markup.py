"""Small HTML helper used inside Arrow tasks: collects text and attributes.

It reads one page, keeps no tree, and returns for each requested field the
text (or first attribute value) of the elements its selector names.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta source track wbr".split())
LIST_TAGS = frozenset(("ul", "ol", "menu"))


@dataclass(frozen=True)
class Field:
    """``selector`` is ``tag``, ``.class``, ``#id``, ``tag.class`` or empty (whole scope)."""

    name: str
    selector: str = ""
    attr: str | None = None

    def matches(self, tag: str, attrs: dict) -> bool:
        if not self.selector:
            return False
        if "#" in self.selector:
            want_tag, _, want = self.selector.partition("#")
            named = attrs.get("id") == want
        elif "." in self.selector:
            want_tag, _, want = self.selector.partition(".")
            named = want in (attrs.get("class") or "").split()
        else:
            want_tag, named = self.selector, True
        return named and want_tag in ("", tag)


class _Scope:
    """Values gathered for one item (or for the page)."""

    def __init__(self, fields):
        self.texts = {f.name: [] for f in fields if f.attr is None}
        self.attrs = {}
        for f in fields:
            if f.attr is None and not f.selector:
                self.texts[f.name].append([])
        self.whole = [parts[0] for parts in self.texts.values() if parts]

    def value(self, field):
        if field.attr is not None:
            return self.attrs.get(field.name)
        return "".join("".join(part) for part in self.texts[field.name])


class _Collector(HTMLParser):
    def __init__(self, fields, item_tag):
        super().__init__(convert_charrefs=True)
        self.fields = fields
        self.item_tag = item_tag
        self.scopes = [] if item_tag else [_Scope(fields)]
        self.live = list(self.scopes)
        self.stack = []  # (tag, text buffers opened here, scope opened here)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "li":
            self._end_open_list_item()
        buffers = []
        for field in self.fields:
            if field.matches(tag, attrs):
                for scope in self.live:
                    if field.attr is None:
                        buffers.append([])
                        scope.texts[field.name].append(buffers[-1])
                    else:
                        scope.attrs.setdefault(field.name, attrs.get(field.attr))
        scope = None
        if tag == self.item_tag:
            scope = _Scope(self.fields)
            self.scopes.append(scope)
            self.live.append(scope)
        if tag not in VOID_TAGS:
            self.stack.append((tag, buffers, scope))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(entry[0] == tag for entry in self.stack):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        for _, buffers, _ in self.stack:
            for part in buffers:
                part.append(data)
        for scope in self.live:
            for part in scope.whole:
                part.append(data)

    def _pop(self):
        tag, _, scope = self.stack.pop()
        if scope is not None:
            self.live.remove(scope)
        return tag

    def _end_open_list_item(self):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in LIST_TAGS:
                return
            if self.stack[depth][0] == "li":
                while len(self.stack) > depth:
                    self._pop()
                return


def collect(html: str | None, fields, item_tag: str | None = None) -> list[dict]:
    """One dict per item, or one for the page; an unreadable page gives none."""
    reader = _Collector(fields, item_tag)
    try:
        reader.feed(html or "")
        reader.close()
    except Exception:
        return []
    return [{f.name: scope.value(f) for f in fields} for scope in reader.scopes]
