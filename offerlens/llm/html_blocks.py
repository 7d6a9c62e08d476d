"""HTML to a sequence of leaf blocks: their text, the tokens of their tag path, and how much of the text is links."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
SAME_CLOSES = {"li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table select div section article aside nav header footer main form body".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
PATH = 24  # innermost elements whose tokens a block keeps one by one; of those around them it keeps the distinct tokens


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order. Markup, comments and the contents of scripts, styles and titles are left out; references are decoded.

    Tags without an end or a start are accepted; nesting of any depth costs no recursion.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], dict[str, None]]] = []  # tag, tokens, distinct tokens from the outermost on
    text: list[str] = []
    links = in_link = at = 0
    n = len(page)

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                around = stack[-PATH - 1][2] if len(stack) > PATH else {}
                path = (*around, *(t for _, tokens, _ in stack[-PATH:] for t in tokens))
                out.append(Block(joined, path, links))
            text.clear()
        links = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text.append(page[at:lt])
            if in_link:
                links += lt - at
            at = lt
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, at)
        if not m:
            after = page[at + 1 : at + 2]
            end = page.find(">", at) if after == "/" or after.isalpha() else -1
            if end < 0 and (after == "/" or after.isalpha()):
                break  # a tag that the page cuts off
            if end < 0:
                text.append("<")
                at += 1
            else:
                at = end + 1
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        at = m.end()
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
            close = -1 if not end else page.find(">", end.start())
            at = n if close < 0 else close + 1
            if tag not in INLINE:
                flush()
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
                continue
            if tag in VOID:
                continue
        else:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            continue
        if tag not in INLINE:
            in_link = 0
            while stack and stack[-1][0] in INLINE:
                stack.pop()
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in SAME_CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in SAME_CLOSES[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE:
                        break
        tokens = [tag]
        if attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                tokens += [f".{x}" for x in dict.fromkeys(_NAME.findall("".join(values).lower()))]
        known = stack[-1][2] if stack else {}
        if any(t not in known for t in tokens):
            known = known | dict.fromkeys(tokens)
        stack.append((tag, tuple(tokens), known))
    flush()
    return out
