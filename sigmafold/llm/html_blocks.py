"""HTML to text blocks with their tag paths, without a tree: one pass over the markup."""

from __future__ import annotations

import html
import re
import zlib

#: Elements that begin a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements without content, and elements whose content isn't text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math title audio video canvas".split())
#: Elements that end an open one of the same list, up to the element that holds them.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDERS = frozenset("ul ol menu dl table select".split())
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z)
      | <(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>
      | <(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*)(?:>|\Z)""",
    re.S | re.X,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[^a-z]+")

PATH_BUCKETS = 256
WORD_BUCKETS = 64
_buckets: dict[tuple[str, int], int] = {}


def bucket(token: str, size: int) -> int:
    found = _buckets.get((token, size))
    if found is None:
        found = zlib.crc32(token.encode("utf-8", "surrogatepass")) % size
        if len(_buckets) < 500_000:
            _buckets[token, size] = found
    return found


def _names(rest: str) -> list[str]:
    """Parts of class, id and role of a tag, in lower case."""
    if "=" not in rest:
        return []
    return [part for found in _NAMES.findall(rest) for part in _PARTS.split("".join(found).lower()) if part]


def blocks(markup: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of every block with text, in page order.

    The path names the open elements at any depth and all their class, id and role parts, the block's
    own element last as ``=tag``; a part whose bucket an outer one has is left out, as it adds nothing.
    Character references are decoded, white space is one blank, ends are trimmed.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    # Of every open element: tag, path, its buckets as bits, and the innermost block.  The work per tag does not grow with the depth.
    stack: list[tuple[str, tuple[str, ...], int, str]] = [("", (), 0, "")]
    places: dict[str, list[int]] = {}
    text: list[str] = []
    linked = links = 0
    at, size = 0, len(markup)

    def flush() -> None:
        nonlocal linked
        words = html.unescape("".join(text)).split()
        if words:
            out.append(((*stack[-1][1], f"={stack[-1][3]}"), " ".join(words), linked))
        text.clear()
        linked = 0

    def close(tags: tuple[str, ...], stop: frozenset[str]) -> None:
        last = lambda names: max((places[t][-1] for t in names if places.get(t)), default=0)
        i = last(tags)
        if i > last(stop):
            for tag, *_ in stack[i:]:
                places[tag].pop()
            del stack[i:]

    def push(tag: str, names: list[str]) -> None:
        _, path, seen, leaf = stack[-1]
        new = []
        for token in (tag, *[f".{n}" for n in names]):
            bit = 1 << bucket(token, PATH_BUCKETS)
            if not seen & bit:
                seen |= bit
                new.append(token)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, (*path, *new) if new else path, seen, tag if tag in BLOCKS else leaf))

    while at < size:
        found = _MARKUP.search(markup, at)
        if found is None:
            text.append(markup[at:])
            break
        if found.start() > at:
            text.append(markup[at : found.start()])
            if links:
                linked += found.start() - at
        at = found.end()
        tag = (found["tag"] or found["tag2"] or "").lower()
        if not tag:
            continue
        if found["close"] or found["close2"]:
            if tag in BLOCKS:
                flush()
            if tag == "a":
                links = 0
            close((tag,), frozenset())
            continue
        if tag in HIDDEN:
            end = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(markup, at)
            at = end.end() if end else size
            if tag not in ("svg", "math"):
                text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            close(("p",), frozenset())
            if tag in _SIBLINGS:
                close(_SIBLINGS[tag], _HOLDERS)
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if tag == "a":
            links = 1
        push(tag, _names(found["rest"] or found["rest2"] or ""))
    flush()
    return out
