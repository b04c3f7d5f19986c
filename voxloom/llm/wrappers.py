"""Operator 10: main text of HTML pages by inferred wrappers.

A page is a token stream: tags (name and the words of class, id and role) and
texts. A host's wrapper is a union-free regular expression over such tokens,
kept as a tree: the first page is the wrapper, each further one is aligned with
it (longest common subsequences of siblings, of any length). Runs of equal
siblings, or of up to three siblings that come again, become repeated groups;
what only one side has becomes optional; differing texts become text slots,
equal ones stay fixed. A list of siblings that grows without settling (over
`LONG` of which most have come before) becomes a repeated group of optional ones.

All pages of a host make its wrapper: each task aligns those that it meets, the
tasks' wrappers are aligned in two further rounds, so a hot host is spread.

The wrapper tells what is main text:

- Template: a text that is fixed, in no optional part, over three different
  pages or more. It doesn't count as text of an article or main element that holds
  less of it than of text in slots, nor elsewhere, unless it is 20 times all text in
  slots (the host's pages are copies). It only tells where the main text does not
  lie: within the main text nothing is left out for coming again on other pages.
- Where the main text lies: the outermost article, else a main element or one
  named as content, each if it holds a quarter of the text in slots; else the
  innermost element with most of that text. A page that none of these places
  fits (the innermost is the body, or lies elsewhere) is placed by a wrapper of its
  own, in which the host's template texts don't count.
- What is left out within it. Always: scripts, styles, menus, asides,
  footers, headers outside an article or main. Forms, unless they hold half of
  all text: then the page stands in the form. Elements named as adverts,
  comments, sidebars and the like, if all parts of the name say so (`ad-slot`,
  not `no-sidebar` or `share-price`), unless they hold half of the host's text.
  Elements with a weaker name (`share`, `discussion`, `notice`), only if half of
  their text is template or in links.

Character references are decoded, white space in a block becomes one space
(a line break too), blocks are trimmed and joined by line feeds, empty ones go.

Bounds: a task's unfinished wrappers are passed on when they have `HELD` nodes in
all. A wrapper keeps all its parts, however many. Only if the caller gives `most_nodes`,
one of more nodes loses its optional parts seen on the fewest pages; then what it lacks
is decided by the page itself, which is read whole.

Defined cases: a null or empty page has the empty text; a null url counts as the
host ''; unclosed and stray tags follow the usual implied ends; an unfinished tag
or comment at the end is dropped; rows repeat as often as they come (equal pages
count as one page for the template); a null page_id is kept; further columns are ignored.
"""

from __future__ import annotations

import html as _html
import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import written
from voxloom.session import on_workers

BROADCAST_BYTES = 16 << 20
HELD, LONG, FEW = 400_000, 48, 3
PARTS = 32  # wrappers of a host that the second round makes

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul html".split())
CLOSES_P = BLOCKS - frozenset("dd dt li td th tr tbody thead tfoot body html".split()) | {"li", "dt", "dd"}
P_SCOPE = ("table", "button", "td", "th", "article", "body")
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: elements that are no main text
OUT_TAGS = frozenset("nav aside footer script style noscript iframe template button select textarea input svg canvas object embed audio video dialog menu head title xmp noembed noframes".split())
#: parts of names of what is no main text, of what may be none, and parts that say nothing
STRONG = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars cookie cookies gdpr popup modal newsletter subscribe subscription signup login comment comments commentlist commenter disqus pagination pager skip skiplink contentinfo complementary footer footnav masthead".split())
WEAK = frozenset("banner side widget widgets notice notices notification alert consent overlay search respond reply replies discussion share sharing social related recommended recommendations toolbar form dialog".split())
NEUTRAL = frozenset("box block list area section container wrapper wrap bar links link buttons button slot unit inner outer item items post posts entry article blog site page top bottom left right col column primary secondary main the my js id new small large big fixed sticky header content text title row group panel thread feed policy tools icons icon user users reader readers".split())
REMARKS = frozenset("comment comments commentlist commenter disqus reply replies".split())
ROLES = frozenset("navigation banner search complementary contentinfo form dialog alert menu menubar".split())
MAIN_WORDS = ("articlebody", "article", "post", "entry", "story", "content", "main", "text", "body")
_PART = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])|\d+|[^\sa-zA-Z\d_-]+")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


#: marks of an element: nothing, a weak name, a strong one, one of readers' remarks, a header's, a form
PLAIN, MAYBE, OUT, REMARK, HEAD, FORM = range(6)


def _mark(name: str, tokens: list[str], roles: list[str]) -> int:
    if name == "form":
        return FORM
    found = HEAD if name == "header" else PLAIN
    for token in tokens:
        parts = [p.lower() for p in _PART.findall(token) if not p.isdigit()]
        if not parts or not all(p in STRONG or p in WEAK or p in NEUTRAL or len(p) == 1 for p in parts):
            continue
        if any(p in STRONG for p in parts):
            found = REMARK if any(p in REMARKS for p in parts) else max(found, OUT) if found != HEAD else OUT
        elif any(p in WEAK for p in parts) and found == PLAIN:
            found = MAYBE
        elif parts in (["header"], ["site", "header"], ["page", "header"]) and found == PLAIN:
            found = HEAD
    return OUT if found in (PLAIN, MAYBE) and any(r in ROLES for r in roles) else found


_SIGNATURES: dict[tuple[str, str], tuple[str, int]] = {}


def _signature(name: str, attributes: str) -> tuple[str, int]:
    """Name and words of class, id and role; and the mark."""
    if "=" not in attributes:
        return name, HEAD if name == "header" else FORM if name == "form" else PLAIN
    known = _SIGNATURES.get((name, attributes))
    if known is not None:
        return known
    tokens: list[str] = []
    roles: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        kind = m[1].lower()
        if kind in ("class", "id", "role", "itemprop"):
            (roles if kind == "role" else tokens).extend((m[2] or m[3] or m[4] or "").split())
    words = {w for t in [*tokens, *roles] for w in t.lower().replace("-", " ").replace("_", " ").split() if not any(c.isdigit() for c in w)}  # numbered names differ by page
    made = ".".join([name, *sorted(words)]), _mark(name, tokens, [r.lower() for r in roles])
    if len(attributes) <= 200:
        if len(_SIGNATURES) >= 50_000:
            _SIGNATURES.clear()
        _SIGNATURES[name, attributes] = made
    return made


def events(page: str) -> Iterator[tuple[str, object, object]]:
    """('open', signature, (name, mark)), ('close', signature, name) and ('text', text, None) of a page with implied ends, and ('break', ...) for line breaks."""
    stack: list[tuple[str, str]] = []
    places: dict[str, list[int]] = {}  # of a name's open elements in the stack
    at, size = 0, len(page)
    match = _TOKEN.match

    def close(depth: int) -> Iterator[tuple[str, object, object]]:
        while len(stack) > depth:
            signature, name = stack.pop()
            places[name].pop()
            yield "close", signature, name

    def last(names) -> int:
        return max((found[-1] for n in names if (found := places.get(n))), default=-1)

    while at < size:
        m = match(page, at)
        at = m.end()
        text = m[7]
        if text is not None:
            yield "text", text, None
            continue
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[5] is not None and not m[0].endswith(">"):
            break  # an unfinished tag
        if m[1] or m[4]:
            if found := places.get(name):
                yield from close(found[-1])
            continue
        attributes = m[3] if m[3] is not None else m[6]
        if name == "br":
            yield "break", None, None
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in CLOSES_P and (found := places.get("p")) and found[-1] > last(P_SCOPE):
            yield from close(found[-1])
        if name in CLOSES:
            ends, until = CLOSES[name]
            if (depth := last(ends)) > last(until):
                yield from close(depth)
        signature, mark = _signature(name, attributes)
        yield "open", signature, (name, mark)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            yield "close", signature, name
        else:
            places.setdefault(name, []).append(len(stack))
            stack.append((signature, name))
    yield from close(0)


class Node:
    """A wrapper's element, group or text. sign: its signature, "(..." of a group (the units' signatures; "(*" a bag, of optional units in any order), "#" of a text.

    length, fixed, pages: of a text, its characters in all, the hash of a fixed one, and the least hashes of up to FEW different pages that have it.
    """

    __slots__ = ("sign", "mark", "kids", "optional", "repeated", "length", "fixed", "pages")

    def __init__(self, sign: str, mark: int = PLAIN, kids: list | None = None, optional: bool = False, repeated: bool = False, length: int = 0, fixed: int | None = None, pages: tuple = ()) -> None:
        self.sign, self.mark, self.kids, self.optional, self.repeated, self.length, self.fixed, self.pages = sign, mark, kids if kids is not None else [], optional, repeated, length, fixed, pages

    def as_(self, optional: bool, repeated: bool) -> Node:
        """The same, but for these two."""
        if optional == self.optional and repeated == self.repeated:
            return self
        return Node(self.sign, self.mark, self.kids, optional, repeated, self.length, self.fixed, self.pages)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 2


def _deep(depth: int) -> None:
    """Lets functions that call themselves for each level go so deep."""
    if 4 * depth + 2000 > sys.getrecursionlimit():
        sys.setrecursionlimit(4 * depth + 2000)


def skeleton(page: str) -> Node:
    """The tree of a page, folded, for alignment."""
    root = Node("")
    stack, whole, deepest, texts = [root], (hash_of(page),), 1, []
    for kind, a, b in events(page):
        if kind == "open":
            node = Node(a, b[1])
            stack[-1].kids.append(node)
            stack.append(node)
            deepest = max(deepest, len(stack))
        elif kind == "close":
            done = stack.pop()
            if len(done.kids) > 1:
                done.kids = folded(done.kids)
        elif kind == "text" and (text := a.strip()):
            stack[-1].kids.append(Node("#", length=len(text), fixed=hash_of(text), pages=whole))
            texts.append(text)
    _deep(deepest)
    root.kids = folded(root.kids)
    return root


def merged(a: Node, b: Node) -> Node:
    """The least wrapper of two nodes of one signature."""
    out = Node(a.sign, a.mark, optional=a.optional or b.optional, repeated=a.repeated or b.repeated)
    if a.sign == "#":
        out.length = a.length + b.length
        out.fixed = a.fixed if a.fixed == b.fixed else None
        out.pages = a.pages if a.pages == b.pages else tuple(sorted({*a.pages, *b.pages})[:FEW])
    else:
        out.kids = aligned(a.kids, b.kids)
    return out


def folded(kids: list[Node]) -> list[Node]:
    """Siblings with what comes again side by side made repeated groups."""
    out = kids
    for width in (1, 2, 3):
        if len(out) < 2 * width:
            break
        signs = [x.sign for x in out]
        if not any(signs[k] == signs[k + width] for k in range(len(signs) - width)):
            continue
        at, made = 0, []
        while at < len(out):
            key, n = signs[at : at + width], 1
            if len(key) == width and (width == 1 or not any(x.startswith("(") for x in key) and len(set(key)) > 1):
                while signs[at + n * width : at + (n + 1) * width] == key:
                    n += 1
            if n < 2:
                made.append(out[at])
                at += 1
                continue
            unit = out[at : at + width]
            for k in range(1, n):
                other = out[at + k * width : at + (k + 1) * width]
                unit = [merged(x, y).as_(x.optional and y.optional if width == 1 else x.optional or y.optional, x.repeated or y.repeated or width == 1) for x, y in zip(unit, other, strict=True)]
            made.append(unit[0] if width == 1 else Node("(" + "|".join(key) + ")", kids=unit, repeated=True))
            at += n * width
        out = made
    return out


def bag(kids: list[Node]) -> list[Node]:
    """One repeated group of the optional units that kids have, each once."""
    units: dict[str, Node] = {}
    todo = list(reversed(kids))
    while todo:
        kid = todo.pop()
        if kid.sign.startswith("("):
            todo += reversed(kid.kids)
            continue
        units[kid.sign] = merged(units[kid.sign], kid) if kid.sign in units else kid
    return [Node("(*", kids=[x.as_(True, x.repeated) for x in units.values()], optional=True, repeated=True)]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, by bit-parallel rows (a row is an integer with a bit for each of b)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    found: list[tuple[int, int]] = []
    if x and y:
        where: dict[str, int] = {}
        for j, sign in enumerate(y):
            where[sign] = where.get(sign, 0) | 1 << j
        full = (1 << len(y)) - 1
        row, rows = full, []
        for sign in x:
            hit = row & where.get(sign, 0)
            row = (row + hit | row - hit) & full
            rows.append(row)
        i, j = len(x), len(y)
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                found.append((head + i, head + j))
            elif rows[i - 1] >> j - 1 & 1:
                j -= 1
            else:
                i -= 1
    return [(k, k) for k in range(head)] + found[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """The least sequence that both lists of children match; what one side lacks is optional."""
    if a and a[-1].sign == "(*" or b and b[-1].sign == "(*":
        return bag(a + b)
    out, i, j = [], 0, 0
    for p, q in common([x.sign for x in a], [y.sign for y in b]):
        out += [x.as_(True, x.repeated) for x in a[i:p]] + [y.as_(True, y.repeated) for y in b[j:q]]
        out.append(merged(a[p], b[q]))
        i, j = p + 1, q + 1
    out += [x.as_(True, x.repeated) for x in a[i:]] + [y.as_(True, y.repeated) for y in b[j:]]
    out = folded(out)
    return bag(out) if len(out) > LONG and len(out) > 2 * len({x.sign for x in out}) else out


def infer(pages: list[Node]) -> Node:
    """The wrapper of skeletons, aligned one after the other."""
    made = pages[0]
    for page in pages[1:]:
        made = merged(made, page)
    return made


def flat(root: Node) -> str:
    """A wrapper as a list of its nodes in order, each with its depth."""
    out, todo = [], [(0, root)]
    while todo:
        depth, n = todo.pop()
        out.append([depth, n.sign, n.mark, n.optional | n.repeated << 1, *([n.length, n.fixed, n.pages] if n.sign == "#" else [])])
        todo += [(depth + 1, k) for k in reversed(n.kids)]
    return json.dumps(out, separators=(",", ":"))


def unflat(text: str) -> Node:
    path: list[Node] = []
    for depth, sign, mark, flags, *rest in json.loads(text):
        node = Node(sign, mark, None, bool(flags & 1), bool(flags & 2), *([rest[0], rest[1], tuple(rest[2])] if rest else []))
        del path[depth:]
        if path:
            path[-1].kids.append(node)
        path.append(node)
        _deep(depth)
    return path[0]


def _counted(root: Node) -> int:
    n, todo = 0, [root]
    while todo:
        n += 1
        todo += todo.pop().kids
    return n


def pruned(root: Node, most: int | None) -> Node:
    """The wrapper without optional parts of few pages, if it has more than `most` nodes; without a `most`, as it is."""
    if most is None:
        return root
    for few in range(1, FEW):
        if _counted(root) <= most:
            break
        todo = [root]
        while todo:
            node = todo.pop()
            node.kids = [k for k in node.kids if not k.optional or len(_pages(k)) > few]
            todo += node.kids
    if _counted(root) > most:  # optional parts all of which are common: the deepest go
        todo, left = [root], most
        for node in todo:  # grows: level by level
            node.kids = node.kids[: max(0, left)]
            left -= len(node.kids)
            todo += node.kids
    return root


def _pages(node: Node) -> set:
    found, todo = set(), [node]
    while todo and len(found) < FEW:
        n = todo.pop()
        found.update(n.pages)
        todo += n.kids
    return found


_PATHS: dict[tuple[int, str], int] = {}


def _path(above: int, sign: str) -> int:
    """The hash of a path of signatures."""
    found = _PATHS.get((above, sign))
    if found is None:
        if len(_PATHS) >= 100_000:
            _PATHS.clear()
        found = _PATHS[above, sign] = hash_of(f"{above} {sign}")
    return found


class Masses:
    """Of each element of a wrapper: (text in slots, in template texts, in links, all text with that of elements always left out)."""

    def __init__(self, root: Node, known: dict[int, list[int]]) -> None:
        self.of: dict[int, tuple[float, float, float, float]] = {}
        self.known = known
        self._walk(root, 0, False, False)

    def _walk(self, node: Node, path: int, link: bool, optional: bool) -> tuple[float, float, float, float]:
        if node.sign == "#":
            n = float(node.length)
            return (0.0, n, 0.0, n) if self.template(node, path, optional) else (0.0, 0.0, n, n) if link else (n, 0.0, 0.0, n)
        name = node.sign.partition(".")[0]
        slots = fixed = links = every = 0.0
        for kid in node.kids:
            s, f, x, e = self._walk(kid, path if kid.sign == "#" or kid.sign.startswith("(") else _path(path, kid.sign), link or name == "a", optional or node.optional)
            slots, fixed, links, every = slots + s, fixed + f, links + x, every + e
        self.of[id(node)] = found = (0.0, 0.0, 0.0, every) if name in OUT_TAGS else (slots, fixed, links, every)
        return found

    def template(self, text: Node, path: int, optional: bool) -> bool:
        """Whether the text is the host's: fixed over FEW pages, or known so for its path."""
        return text.fixed is not None and (not text.optional and not optional and len(text.pages) >= FEW or text.fixed in self.known.get(path, ()))


class Decisions:
    """What a wrapper says of its pages, by hashes of paths: places of the main text, best first; elements to leave out; template texts, which tell a page's own place."""

    def __init__(self, places: list[int], out: dict[int, bool], texts: dict[int, list[int]]) -> None:
        self.places, self.out, self.texts = places, out, texts

    def told(self) -> str:
        return json.dumps([self.places, list(self.out.items()), list(self.texts.items())])

    @classmethod
    def read(cls, told: str) -> Decisions:
        places, out, texts = json.loads(told)
        return cls(places, dict(out), {k: v for k, v in texts})


def decided(root: Node, known: dict[int, list[int]] | None = None) -> Decisions:
    """The decisions that follow from a wrapper. known: template texts of its host."""
    masses = Masses(root, known or {})
    mass = masses.of
    slots, fixed, links, every = mass[id(root)]
    use_template = 20 * slots >= fixed
    out: dict[int, bool] = {}
    texts: dict[int, list[int]] = {}
    found: list[tuple[tuple, int]] = []
    own: dict[int, float] = {}  # text of an element that may be main text

    def goes(node: Node, name: str, above: Node, inside: bool) -> bool:
        s, f, x, _ = mass[id(node)]
        dull = 2 * (f * use_template + x) >= s + f + x
        if node.mark == HEAD:  # of the site, if beside all there is
            return not inside and (dull or mass[id(above)][3] >= 0.95 * every)
        if node.mark == FORM:  # a page's own form, if it holds most of the page
            return 2 * (s + f + x) < slots + fixed + links
        if name in ("html", "body", "main") or name == "article" and node.mark != REMARK:
            return False
        return dull if node.mark == MAYBE else 2 * (s + f) < slots + fixed

    def weigh(node: Node, path: int, optional: bool, link: bool, inside: bool, copied: bool) -> float:
        held = 0.0
        for kid in node.kids:
            if kid.sign == "#":
                if use_template and not copied and masses.template(kid, path, optional or node.optional):
                    texts.setdefault(path, []).append(kid.fixed)
                elif not link:
                    held += kid.length
            elif kid.sign.startswith("("):
                held += weigh(kid, path, optional or node.optional, link, inside, copied)
            else:
                name = kid.sign.partition(".")[0]
                if name in OUT_TAGS:
                    continue
                here = _path(path, kid.sign)
                text = name in ("article", "main")
                part = weigh(kid, here, optional or node.optional, link or name == "a", inside or text, copied or text and mass[id(kid)][1] > mass[id(kid)][0])
                if kid.mark:
                    out[here] = goes(kid, name, node, inside)
                    part *= not out[here]
                own[id(kid)] = part
                held += part
        return held

    own[id(root)] = total = weigh(root, 0, False, False, False, False)

    def skipped(node: Node, name: str, here: int) -> bool:
        return name in OUT_TAGS or out.get(here, False)

    def walk(node: Node, path: int, depth: int, within: bool) -> None:
        for kid in node.kids:
            if kid.sign == "#":
                continue
            if kid.sign.startswith("("):
                walk(kid, path, depth, within)
                continue
            name, *words = kid.sign.split(".")
            here = _path(path, kid.sign)
            if skipped(kid, name, here):
                continue
            rank = 0 if name == "article" else 1 if name == "main" or "main" in words else next((2 + k for k, w in enumerate(MAIN_WORDS) if w in words), None)
            if rank is not None and name not in ("html", "body", "a", "p", "span", "li") and not within and own[id(kid)] > 0 and 4 * own[id(kid)] >= total:
                found.append(((rank, depth, -own[id(kid)]), here))
            walk(kid, here, depth + 1, within or rank == 0)

    walk(root, 0, 1, False)
    found.sort(key=lambda x: x[0])
    node, path, weight = root, 0, total
    while True:  # the innermost element with most of the text
        heavy, most, todo = None, 0.0, list(reversed(node.kids))
        while todo:
            kid = todo.pop()
            if kid.sign.startswith("("):
                todo += reversed(kid.kids)
            elif kid.sign != "#" and own.get(id(kid), 0.0) > most and not skipped(kid, kid.sign.partition(".")[0], _path(path, kid.sign)):
                heavy, most = kid, own[id(kid)]
        if heavy is None or most < 0.6 * weight or heavy.repeated or heavy.sign.partition(".")[0] in ("p", "h1", "h2", "b", "span", "li", "ul", "table", "a", "tr", "td"):
            break
        node, path, weight = heavy, _path(path, heavy.sign), most
    inner = [path] if known is not None or node.sign.partition(".")[0] not in ("", "html", "body") else []  # else each page's own
    return Decisions(list(dict.fromkeys([*(here for _, here in found), *inner])), out, texts)


_SPACE = re.compile(r"\s+")


def extract(page: str | None, known: Decisions, places: list[int] | None = None) -> str | None:
    """The main text at the first of the places that the page has text at; None if it has none of them."""
    if not page:
        return ""
    places = known.places if places is None else places
    of_path: dict[int, list[int]] = {}
    for k, p in enumerate(places):
        of_path.setdefault(p, []).append(k)
    texts: list[list[str] | None] = [None] * len(places)
    path, skipped = [0], []
    out = inside = 0  # depth of elements that are left out, and of articles and mains
    within: list[tuple[int, int]] = [(k, 0) for k in of_path.get(0, ())]  # (place, depth) of the open places; the path 0 is the whole page
    for k, _ in within:
        texts[k] = []
    block: list[str] = []

    def flush() -> None:
        if block:
            text = _SPACE.sub(" ", "".join(block)).strip()
            if text:
                for k, _ in within:
                    texts[k].append(text)
            block.clear()

    for kind, a, b in events(page):
        if kind == "text":
            if within and not out:
                block.append(_html.unescape(a))
        elif kind == "break":
            block.append(" ")
        elif kind == "open":
            name, mark = b
            if name in BLOCKS:
                flush()
            here = _path(path[-1], a)
            path.append(here)
            skip = name in OUT_TAGS
            if not skip and mark:
                skip = known.out.get(here, mark != MAYBE and name not in ("html", "body", "main", "article")) and not (inside and mark == HEAD)
            skipped.append(skip)
            out += skip
            inside += name in ("article", "main")
            if here in of_path and not out:
                for k in of_path[here]:
                    if texts[k] is None:
                        texts[k] = []
                    within.append((k, len(path) - 1))
        else:
            if b in BLOCKS:
                flush()
            while within and within[-1][1] == len(path) - 1 and within[-1][1]:
                flush()
                within.pop()
            path.pop()
            out -= skipped.pop()
            inside -= b in ("article", "main")
    flush()
    return next(("\n".join(t) for t in texts if t), "" if any(t is not None for t in texts) else None)


def page_text(page: str | None, known: Decisions | None) -> str:
    """The main text of a page at its host's places, or at its own."""
    if not page:
        return ""
    found = extract(page, known) if known is not None else None
    if found:
        return found
    own = decided(skeleton(page), known.texts if known is not None else {})
    if known is not None:
        own = Decisions(own.places, own.out | known.out, known.texts)
    return extract(page, own) or ""


def wrappers(pages: DataFrame, *, held: int = HELD, most_nodes: int | None = None) -> DataFrame:
    """(host, decisions) of the wrapper of each host of pages (page_id, url, html)."""
    on_workers(pages.sparkSession)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, size = TaskContext.get().partitionId() % PARTS, {}, 0

        def done() -> Iterator[pd.DataFrame]:
            rows = [(host, part, flat(pruned(w, most_nodes))) for host, w in made.items()]
            for at in range(0, len(rows), 256):
                yield pd.DataFrame(rows[at : at + 256], columns=["host", "part", "wrapper"])

        for batch in batches:
            for url, page in zip(batch["url"], batch["html"], strict=True):
                if not page:
                    continue
                host, tree = host_of(url), skeleton(page)
                if host in made:
                    made[host] = merged(made[host], tree)
                else:
                    made[host] = tree
                    size += _counted(tree)
                if size > held or len(page) > held:
                    yield from done()
                    made, size = {}, 0
            if made:
                size = sum(map(_counted, made.values()))
        yield from done()

    def further(batches: Iterator[pd.DataFrame], keys: list[str], last: bool) -> Iterator[pd.DataFrame]:
        now, made = None, None

        def done() -> pd.DataFrame:
            wrapper = pruned(made, most_nodes)
            return pd.DataFrame([(*now, decided(wrapper).told() if last else flat(wrapper))], columns=[*keys, "decisions" if last else "wrapper"])

        for batch in batches:  # sorted by keys
            for *key, text in zip(*(batch[k] for k in keys), batch["wrapper"], strict=True):
                if key != now:
                    if now is not None:
                        yield done()
                    now, made = key, unflat(text)
                else:
                    made = merged(made, unflat(text))
        if now is not None:
            yield done()

    rows = pages.select("url", "html").mapInPandas(first, "host string, part int, wrapper string")
    rows = rows.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInPandas(lambda x: further(x, ["host", "part"], False), "host string, part int, wrapper string")
    return rows.repartition("host").sortWithinPartitions("host", "part").select("host", "wrapper").mapInPandas(lambda x: further(x, ["host"], True), "host string, decisions string")


def main_texts(pages: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    spark = on_workers(pages.sparkSession)
    found = written(wrappers(pages, **options), "wrappers")
    size = found.agg(F.sum(F.length("host") + F.length("decisions") + 64)).first()[0] or 0
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("page_id", "url")) + ", text string, n_chars long"

    def made(batch: pd.DataFrame, of: list) -> pd.DataFrame:
        texts = [page_text(page, p) for page, p in zip(batch["html"], of, strict=True)]
        return pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    if size <= broadcast_bytes:
        known = spark.sparkContext.broadcast({r.host: r.decisions for r in found.collect()})  # of a checked size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read: dict[str, Decisions | None] = {}

            def of(url: str | None) -> Decisions | None:
                host = host_of(url)
                if host not in read:
                    told = known.value.get(host)
                    read[host] = None if told is None else Decisions.read(told)
                return read[host]

            for batch in batches:
                yield made(batch, [of(u) for u in batch["url"]])

        return pages.select("page_id", "url", "html").mapInPandas(run, schema)

    def hosted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(host=[host_of(u) for u in batch["url"]])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield made(batch, [Decisions.read(p) if p else None for p in batch["decisions"]])

    base = pages.select("page_id", "url", "html")
    with_host = base.mapInPandas(hosted, ", ".join(f"{c} {t}" for c, t in base.dtypes) + ", host string")
    return with_host.join(found, "host", "left").select("page_id", "url", "html", "decisions").mapInPandas(joined, schema)
