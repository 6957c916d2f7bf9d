"""DOM nodes of a page as plain lists: elements and text leaves in page order, with their parents."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser

#: Elements without an end tag, elements whose text is never shown, and inline elements (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title iframe object svg canvas audio video datalist select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open element: the elements they end, and where the search for them stops.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("html body table ul ol dl select article section main aside nav div td th form fieldset".split())
#: All that may stand in a head: whatever else starts ends it, as text does.
_IN_HEAD = frozenset("head title base basefont bgsound link meta style script noscript noframes template".split())
#: Foreign content, the elements within that hold HTML again, and the start tags that end foreign content.
_FOREIGN = frozenset(("svg", "math"))
_HTML_AGAIN = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
_LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: What begins a tag, an end tag, a comment or a declaration.
_OPENING = re.compile(r"<[A-Za-z/!?]")
_TOKEN = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Dom(HTMLParser):
    """``parent``, ``tag`` ("#text" for leaves), ``tokens`` of class, id and role, ``text`` and ``mark`` (data-main) of each node; node 0 is the page.

    Time grows with the page, however it is broken: depths of open elements are kept by name, so no tag walks over elements that it does not
    end, and what is still open at the end of the page is left out, as browsers do, and not looked at again and again.
    """

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.tokens, self.text, self.mark = [-1], ["#page"], [()], [""], [None]
        self.linked = [False]
        self.open, self.hidden = [0], 0
        #: Depths of open elements, rising: by name, and those of three kinds.
        self.depths: defaultdict[str, list[int]] = defaultdict(list)
        self.scopes, self.foreign, self.again = [0], [], [0]
        #: Grows whenever a block begins or ends: leaves of one number belong to one block.
        self.block, self.blocks = [0], 0
        unclosed = _OPENING.search(page, page.rfind(">") + 1)
        self.feed(page[: unclosed.start()] if unclosed else page)
        self.close()

    def _add(self, tag: str, tokens: tuple, text: str, mark: str | None) -> int:
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.text.append(text)
        self.mark.append(mark)
        self.linked.append(tag == "a" or self.linked[self.open[-1]])
        self.block.append(self.blocks)
        return len(self.tag) - 1

    def _close(self, depth: int) -> None:
        for node in self.open[depth:]:
            if self.tag[node] not in INLINE:
                self.blocks += 1
            if self.tag[node] in UNSEEN:
                self.hidden -= 1
            self.depths[self.tag[node]].pop()
        del self.open[depth:]
        for kept in (self.scopes, self.foreign, self.again):
            while kept and kept[-1] >= depth:
                kept.pop()

    def _push(self, node: int, tag: str) -> None:
        depth = len(self.open)
        self.open.append(node)
        self.depths[tag].append(depth)
        self.hidden += tag in UNSEEN
        for kept, names in ((self.scopes, _SCOPE), (self.foreign, _FOREIGN), (self.again, _HTML_AGAIN)):
            if tag in names:
                kept.append(depth)

    def _foreign_depth(self) -> int:
        """Depth of the outermost element of the foreign content that is open here, 0 outside of any."""
        first = bisect_right(self.foreign, self.again[-1])
        return self.foreign[first] if first < len(self.foreign) else 0

    def _end_head(self) -> None:
        if self.tag[self.open[-1]] == "head":
            self._close(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _IN_HEAD:
            self._end_head()
        if tag in _LEAVES and (depth := self._foreign_depth()):
            self._close(depth)
        if tag not in INLINE:
            self.blocks += 1
            for ended in (_ENDS.get(tag, ()), ("p",) if tag != "br" else ()):
                depth = max((self.depths[name][-1] for name in ended if self.depths.get(name)), default=0)
                if depth and depth >= self.scopes[-1]:
                    self._close(depth)
        if tag in VOID:
            return
        found = {k: v for k, v in attrs if v}
        words = " ".join(found.get(k, "") for k in ("class", "id", "role"))
        tokens = tuple(t.lower() for t in _TOKEN.findall(_CAMEL.sub(" ", words))) if words.strip() else ()
        if "hidden" in dict(attrs) or found.get("aria-hidden") == "true":
            tokens += ("hidden",)
        self._push(self._add(tag, tokens, "", found.get("data-main")), tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        # As in browsers, "/>" ends foreign elements and those that have no end tag. Beyond that it ends elements
        # whose text is never shown, as XHTML means it: else they would hide all that follows.
        if tag not in VOID and (tag in UNSEEN or self._foreign_depth()):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.depths.get(tag):
            self._close(self.depths[tag][-1])

    def parse_comment(self, i: int, report: bool = True) -> int:
        """A comment without an end takes the rest of the page."""
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def handle_data(self, data: str) -> None:
        if self.hidden and not data.isspace():
            self._end_head()
        if not self.hidden and data:
            self._add("#text", (), data, None)
