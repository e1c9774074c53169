"""Leaf blocks of an HTML page: the text between two block boundaries, with the
path of elements around it.

A small reader for the rules that decide text and nesting: comments and
declarations vanish, an unfinished tag or comment runs to the end of the page,
scripts, styles, titles and form controls hold no text, a block element closes an
open paragraph, list items, definitions and table cells close their like, end
tags that match nothing are ignored. ``br`` is white space; inline elements don't
cut a block. Every step moves forward, so a page costs time in line with its length.
"""

from __future__ import annotations

import html as _html
import re
import zlib

from ratecraft.llm.common import ship_by_value

# Element classes of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li listing main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
CONTROLS = frozenset("audio button canvas datalist noscript object select svg template video".split())
#: Start tag -> open elements it closes, and the elements beyond which it doesn't look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
_TAG = re.compile(
    r"</?([A-Za-z][^\s/>]*+)((?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_COMMENT_END = re.compile(r"--!?>")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW | CONTROLS}
_NAME = re.compile(r"[a-z]+|[0-9]+")

#: Buckets of path tokens; the elements nearest to a block that its path names.
PATHS = 2048
NEAREST = 16


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % PATHS


class Paths:
    """Element paths by number; each is made once, from its parent's."""

    def __init__(self):
        self.known, self.tokens = {}, [()]

    def child(self, parent: int, tag: str, attributes: str) -> int:
        key = parent, tag, attributes
        found = self.known.get(key)
        if found is None:
            own = {bucket(tag)}
            for name, *value in _ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id", "role", "hidden", "aria-hidden"):
                    own.update(bucket(f"{name.lower()[0]}-{t}" if name.lower() in ("hidden", "aria-hidden") else "." + t)
                               for t in _NAME.findall("".join(value).lower() or "yes"))
            found = self.known[key] = len(self.tokens)
            self.tokens.append((frozenset(own), *self.tokens[parent][:NEAREST - 1]))
        return found

    def buckets(self, path: int) -> list[int]:
        """Tokens of a path, and those of the innermost element once more under other numbers."""
        levels = self.tokens[path]
        out = [b for level in levels for b in sorted(level)]
        return out + ([(b + 1) % PATHS for b in sorted(levels[0])] if levels else [])


def leaves(page: str, paths: Paths):
    """(text, path, characters inside links) of the page's blocks, in order."""
    out = []
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    pieces: list[str] = []
    linked, in_link = 0, False

    def flush():
        nonlocal linked, in_link
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, stack[-1][1] if stack else 0, min(linked, len(text))))
            pieces.clear()
        linked, in_link = 0, False

    def pop_to(size):
        while len(stack) > size:
            count[stack.pop()[0]] -= 1

    def say(text):
        nonlocal linked
        if "&" in text:
            text = _html.unescape(text)
        pieces.append(text)
        if in_link:
            linked += len(text)

    i, n, unclosed = 0, len(page), set()
    while i < n:
        j = page.find("<", i)
        if j < 0:
            say(page[i:])
            break
        if j > i:
            say(page[i:j])
        after = page[j + 1:j + 3]
        if after[:1] in ("!", "?") or after[:1] == "/" and not (after[1:].isascii() and after[1:].isalpha()):
            if page.startswith("<!--", j):
                if page.startswith((">", "->"), j + 4):
                    i = page.index(">", j) + 1
                else:
                    end = _COMMENT_END.search(page, j + 4)
                    i = end.end() if end else n
            else:
                end = page.find(">", j)
                i = end + 1 if end >= 0 else n
            continue
        if not (after[:1].isascii() and after[:1].isalpha()) and after[:1] != "/":
            say("<")
            i = j + 1
            continue
        m = _TAG.match(page, j)
        if m is None:
            break
        i, tag = m.end(), m[1].lower()
        if page[j + 1] == "/":
            if tag == "a":
                in_link = False
            elif tag == "p" and not count.get("p"):
                flush()
            elif tag in BLOCK and count.get(tag):
                flush()
                size = len(stack) - 1
                while stack[size][0] != tag:
                    size -= 1
                pop_to(size)
            continue
        if tag in _CLOSE:
            end = _CLOSE[tag].search(page, i) if tag not in unclosed else None
            if end:
                i = end.end()
            elif tag in RAW:
                break
            else:
                unclosed.add(tag)
        elif tag == "br":
            say(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            in_link = True
        elif tag in BLOCK:
            flush()
            if stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            if tag in CLOSES:
                like, beyond = CLOSES[tag]
                if any(count.get(t) for t in like):
                    size = len(stack) - 1
                    while size >= 0 and stack[size][0] not in beyond and stack[size][0] not in like:
                        size -= 1
                    if size >= 0 and stack[size][0] in like:
                        pop_to(size)
            stack.append((tag, paths.child(stack[-1][1] if stack else 0, tag, m[2].strip())))
            count[tag] = count.get(tag, 0) + 1
    flush()
    return out


ship_by_value(__name__)
