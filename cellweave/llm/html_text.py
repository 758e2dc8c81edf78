"""Operator 7, main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import functools
import html
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, passes, table
from .labelled_pages import labelled_pages
from .toxicity import marginals

TRAIN_PAGES = 1500
SEED = 5
ROUNDS = 100

#: Fixed values of HTML: elements that begin a new block, that hold no text to show, that have no end tag. What noscript, object,
#: canvas, audio, video and iframe hold is shown only where the thing itself is not, so it is no text of the article;
#: formulas (math) are, but not their annotations.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul label caption".split())
HIDDEN = frozenset("script style noscript template svg head title iframe object canvas audio video select button textarea option annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"label", "caption", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
ALONE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Hidden elements that people leave open, and those of them that do not hold another of their kind.
LEFT_OPEN = frozenset("object canvas audio video select button option svg template".split())
NOT_NESTED = frozenset("audio video select button option".split())
#: Elements that a slash before the end of their tag closes.
FOREIGN = frozenset("svg math".split())

#: A comment, another declaration, or a tag: slash, name and attributes. A quote counts only where a value begins with it;
#: one that is never closed is part of a name, so that its tag ends at the next >.
ATTRIBUTE = r"""[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
TAG = re.compile(rf"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:{ATTRIBUTE})*+)(?:>|\Z))", re.S)
VALUE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?+)?+)?+""")
NAMED = frozenset(("class", "id", "role", "data-y"))
PARTS = re.compile(r"[a-z]+")
END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
#: Where elements that may be left open begin and end.
BOUNDS = {t: (re.compile(rf"<{t}(?=[\s/>])", re.I), re.compile(rf"</{t}(?=[\s/>])", re.I)) for t in LEFT_OPEN}


#: What may stand in a head whose end tag is left out; anything else begins the body.
IN_HEAD = frozenset("title meta link base basefont bgsound script style noscript template".split())
#: Weights of ancestors are summed in whole units of 1 / UNITS, so that sums do not depend on their order.
UNITS = 1 << 24


class Block:
    """A leaf block: its text, the letters of it within links, its innermost block element, what its ancestors say (their
    features, or with weights the sum of those), whether any ancestor has a name, and the mark of a labelled page."""

    __slots__ = ("text", "linked", "last", "around", "named", "gold")

    def __init__(self, text: str, linked: int, last: str, around, named: bool, gold: str | None):
        self.text, self.linked, self.last, self.around, self.named, self.gold = text, linked, last, around, named, gold


class Ahead:
    """Whether an element that begins here is closed later on. Where tags are is looked up once, from left to right."""

    def __init__(self, page: str):
        self.page = page
        self.found: dict[tuple[str, int], int] = {}

    def next(self, tag: str, end: int, at: int) -> int:
        where = self.found.get((tag, end), -1)
        if where < at:
            m = BOUNDS[tag][end].search(self.page, at)
            where = self.found[tag, end] = m.start() if m else len(self.page)
        return where

    def closed(self, tag: str, at: int) -> bool:
        end = self.next(tag, 1, at)
        return end < len(self.page) and (tag not in NOT_NESTED or end < self.next(tag, 0, at))


class Open:
    """The open elements of a page, with counts of tags and of features: no step walks all of them."""

    def __init__(self, weights: dict[str, float] | None):
        self.stack: list[tuple[str, list[str], str | None]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[str] = []
        self.golds: list[str] = []
        self.met: Counter = Counter()
        self.weights, self.total, self.names = weights, 0, 0

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at[tag] else -1

    def push(self, tag: str, names: list[str], gold: str | None) -> None:
        own = ["name=" + x for x in names]
        if tag in BLOCKS:
            own.append("in=" + tag)
            self.blocks.append(tag)
        for f in own:
            self.met[f] += 1
            if self.weights is not None and self.met[f] == 1:
                self.total += round(self.weights.get(f, 0.0) * UNITS)
        if gold is not None:
            self.golds.append(gold)
        self.names += len(names)
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, own, gold))

    def pop(self) -> str:
        tag, own, gold = self.stack.pop()
        self.at[tag].pop()
        if tag in BLOCKS:
            self.blocks.pop()
        for f in own:
            self.met[f] -= 1
            if not self.met[f]:
                del self.met[f]
                if self.weights is not None:
                    self.total -= round(self.weights.get(f, 0.0) * UNITS)
            self.names -= f.startswith("name=")
        if gold is not None:
            self.golds.pop()
        return tag

    def leave(self, k: int) -> None:
        """The element at k ends, those within it stay open."""
        tag, own, gold = self.stack[k]
        self.at[tag].pop()
        self.at[""].append(k)
        self.stack[k] = ("", own, gold)

    def around(self):
        return frozenset(self.met) if self.weights is None else self.total / UNITS


def leaf_blocks(page: str, weights: dict[str, float] | None = None) -> list[Block]:
    """The text blocks in page order. Time and memory grow with the page, however deep its elements are nested.

    No text is lost to markup that is not closed: text closes a head, and a hidden element without an end tag of its own
    ends where the next block begins.
    """
    out: list[Block] = []
    opened = Open(weights)
    ahead = Ahead(page)
    pieces: list[str] = []
    loose: list[int] = []  # places in the stack of hidden elements that nothing closes
    linked = hidden = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, linked, opened.blocks[-1] if opened.blocks else "none", opened.around(), opened.names > 0, opened.golds[-1] if opened.golds else None))
            pieces.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal hidden
        if opened.blocks and opened.last(opened.blocks[-1]) >= k:
            flush()
        while len(opened.stack) > k:
            hidden -= opened.pop() in HIDDEN
        while loose and loose[-1] >= k:
            loose.pop()

    def show(text: str) -> None:
        nonlocal linked
        if hidden and opened.stack[-1][0] == "head" and text.strip():
            close(len(opened.stack) - 1)
        if hidden or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if opened.at["a"]:
            linked += len(text.strip())

    while at < n:
        start = page.find("<", at)
        if start < 0:
            show(page[at:])
            break
        show(page[at:start])
        m = TAG.match(page, start)
        if m is None:
            show("<")
            at = start + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if (k := opened.last(tag)) >= 0:
                if tag not in BLOCKS and tag not in HIDDEN and opened.blocks and opened.last(opened.blocks[-1]) > k:
                    opened.leave(k)  # a block inside it goes on
                else:
                    close(k)
            elif tag in BLOCKS:
                flush()
            continue
        if opened.at["head"] and tag not in IN_HEAD:
            close(opened.last("head"))
        if tag == "br":
            pieces.append(" ")
            continue
        if loose and tag in BLOCKS:
            close(loose[0])
        if tag in CLOSES_P and (k := opened.last("p")) >= 0:
            close(k)
        for other in ALONE.get(tag, ()):
            k = opened.last(other)
            if k > max(opened.last(x) for x in ("ul", "ol", "dl", "table", "select")):
                close(k)
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        names, gold = [], None
        attributes = m[3]
        if attributes:
            for key, a, b, c in VALUE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key not in NAMED:
                    continue
                if key == "data-y":
                    gold = value
                else:
                    names += PARTS.findall(value.lower())
            if tag in FOREIGN and attributes.endswith("/"):
                continue
        if tag in RAW:
            m = END[tag].search(page, at)
            at = m.end() if m else n
            continue
        if tag in LEFT_OPEN and not ahead.closed(tag, at):
            loose.append(len(opened.stack))
        opened.push(tag, names, gold)
        hidden += tag in HIDDEN
    flush()
    return out


def own_features(block: Block) -> list[str]:
    """Of the block's text and innermost element."""
    out, text, last = set(), block.text, block.last
    words = text.count(" ") + 1
    out.add("tag=" + last)
    out.add(f"words={min(8, words.bit_length())}")
    out.add(f"{last}:words={min(8, words.bit_length())}")
    density = block.linked / max(1, len(text))
    out.add(f"linked={0 if density == 0 else 1 if density < 0.3 else 2 if density < 0.8 else 3}")
    out.add("ends=" + ("stop" if text[-1] in ".!?…\"”»" else "colon" if text[-1] == ":" else "other"))
    if "©" in text[:20] or "(c)" in text[:20].lower():
        out.add("copyright")
    if text.count(",") + text.count(". ") > 2:
        out.add("prose")
    if not block.named:
        out.add("nameless")
    return list(out)


def features(block: Block) -> list[str]:
    """All features of a block that was read without weights."""
    return sorted({*own_features(block), *block.around})


def emissions(page: str, weights: dict[str, float]) -> tuple[list[Block], list[float]]:
    """A page's blocks and the log-odds of each."""
    blocks = leaf_blocks(page, weights)
    return blocks, [b.around + sum(weights.get(f, 0.0) for f in own_features(b)) for b in blocks]


def decode(odds: list[float], moves: tuple[float, float, float]) -> list[int]:
    """The likeliest labels (Viterbi) from log-odds of emission and scores of moves to label 1."""
    from0, from1, start = moves
    back, a, b = [], 0.0, start + odds[0]
    for o in odds[1:]:
        to0, to1 = (0, a) if a >= b else (1, b), (0, a + from0) if a + from0 >= b + from1 else (1, b + from1)
        back.append((to0[0], to1[0]))
        a, b = to0[1], to1[1] + o
    y = int(b > a)
    out = [y]
    for step in reversed(back):
        y = step[y]
        out.append(y)
    return out[::-1]


def fit(pages: list[str], rounds: int = ROUNDS) -> tuple[dict[str, float], tuple[float, float, float]]:
    """Feature weights and moves of the field from pages whose blocks carry data-y."""
    known: dict[str, int] = defaultdict()
    known.default_factory = known.__len__
    rows, cols, gold, first = [], [], [], []
    for page in pages:
        for i, b in enumerate(leaf_blocks(page)):
            for f in features(b):
                rows.append(len(gold))
                cols.append(known[f])
            gold.append(float(b.gold == "1"))
            first.append(i == 0)
    rows, cols, gold, first = np.array(rows), np.array(cols), np.array(gold), np.array(first)
    w, seen, moves, moves_seen = np.zeros(len(known)), np.full(len(known), 1e-2), np.zeros(3), np.full(3, 1e-2)
    inner, n = ~first[1:], len(gold)
    n01, n11 = ((inner & (gold[1:] == 1) & (gold[:-1] == k)).sum() for k in (0, 1))
    for _ in range(rounds):
        odds = np.exp(np.clip(np.bincount(rows, weights=w[cols], minlength=n), -25, 25))
        forward, back, p = marginals(odds, first, moves)
        grad = np.bincount(cols, weights=(gold - p)[rows], minlength=len(w)) - 0.05 * w
        later, e = odds[1:] * back[1:], np.exp(moves)
        go, stay = e[0] * later, forward[:-1] * e[1] * later
        total = 1 + go + forward[:-1] + stay
        g = np.array([n01 - (go / total)[inner].sum(), n11 - (stay / total)[inner].sum(), (gold - p)[first].sum()]) - 0.3 * moves
        seen += grad**2
        moves_seen += g**2
        w += 0.5 * grad / np.sqrt(seen)
        moves += 0.3 * g / np.sqrt(moves_seen)
    return {f: float(w[i]) for f, i in known.items()}, tuple(moves.tolist())


@functools.cache
def trained(n: int = TRAIN_PAGES, seed: int = SEED):
    return fit(labelled_pages(n, seed))


def main_blocks(page: str, model) -> list[str]:
    weights, moves = model
    blocks, odds = emissions(page, weights)
    if not blocks:
        return []
    return [b.text for b, y in zip(blocks, decode(odds, moves), strict=True) if y]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model=None) -> DataFrame:
    """The main text of every page: id_col, url_col, text, n_chars (code points). No shuffle.

    Blocks keep page order and are joined by an empty line; white space inside a block is one space. A null or
    empty page, and one without main text, gives an empty text. Null ids and urls and repeated rows stay, row by row;
    other columns are not read; a table without rows gives none.
    """
    model = model or trained()
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def one(batch: pa.RecordBatch):
        for part in passes(batch, "html", 4 << 20):
            texts = ["\n\n".join(main_blocks(h, model)) if h else "" for h in part.column("html").to_pylist()]
            yield pa.record_batch([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    own = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return map_arrow(own, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long", one).withColumnsRenamed({"id": id_col, "url": url_col})


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
