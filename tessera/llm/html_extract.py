"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its DOM's leaf blocks. Each block has features of
its ancestors' tags and class names and of its text; the field scores the
sequence of labels main / other and is decoded by Viterbi. It is trained here,
by gradient ascent on the log-likelihood of labelled pages.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh
from .html_pages import labelled_pages

# Element classes of HTML.
BLOCK = frozenset("address article aside blockquote body button caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td text textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template title head iframe canvas audio video datalist".split())
UNSEEN_IN = {"svg": frozenset("defs desc metadata symbol".split()), "math": frozenset("annotation annotation-xml".split())}
IN_HEAD = frozenset("base link meta noframes".split())  # with those of RAW; anything else ends a head that is still open
RAW = frozenset("script style textarea title noscript iframe template".split())
CLOSES_P = BLOCK - {"body", "html", "button", "datalist", "select", "text", "textarea", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_LABEL = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?|["'=]""")
_OPEN_VALUE = re.compile(r"""=\s*[^\s"'>]+$""")  # a slash that ends it is the value's
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_DIGIT = re.compile(r"\d")
_NAME = re.compile(r"[a-z]+")
# What notices, adverts, footers and comments say.
KEYWORDS = ("cookie", "newsletter", "subscri", "copyright", "©", "all rights", "privacy", "datenschutz", "impressum", "advert", "sponsor", "anzeige", "publicit", "sign up", "log in", "login", "share", "follow us", "related", "recommended", "read more", "javascript", "comment", "reply", "replies")


_PARTS: frozenset[str] = frozenset().union(*UNSEEN_IN.values())


class Place:
    """Where a block stands: its innermost block element, all tags and names above it, and the place it is in.

    Places are shared: an element of the same tag and names under the same
    place is the same place, so a page costs in proportion to its length.
    """

    __slots__ = ("own", "up", "tags", "names", "below")

    def __init__(self, own: str, up: Place | None, tags: frozenset[str], names: frozenset[str]) -> None:
        self.own, self.up, self.tags, self.names = own, up, tags, names
        self.below: dict[tuple[str, frozenset[str]], Place] = {}

    def enter(self, tag: str, names: frozenset[str]) -> Place:
        place = self.below.get((tag, names))
        if place is None:
            tags = self.tags if tag in self.tags else self.tags | {tag}
            place = Place(tag if tag in BLOCK else self.own, self, tags, self.names if names <= self.names else self.names | names)
            self.below[tag, names] = place
        return place


@dataclass
class Block:
    """A leaf block: its text, its place, and how many of its letters are in links."""

    text: str
    place: Place
    linked: int

    @property
    def names(self) -> frozenset[str]:
        return self.place.names


def is_hidden(attributes: str) -> bool:
    """Whether a tag's attributes hide it: hidden, aria-hidden equal to true, or a style whose display is none."""
    if not _MAY_HIDE.search(attributes):
        return False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1]:
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))  # the first of a name counts
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true":
        return True
    display, fixed = "", False
    for declaration in _COMMENT.sub("", found.get("style", "")).lower().split(";"):
        name, _, value = declaration.partition(":")
        value, bang, _ = value.partition("!")
        if name.strip() == "display" and value.strip() and (bang or not fixed):
            display, fixed = value.strip(), bool(bang)
    return display == "none"


def leaf_blocks(page: str) -> list[Block]:
    """The page's text in leaf blocks, white space joined, references decoded; never in elements that show none."""
    blocks: list[Block] = []
    stack: list[tuple[str, Place, bool]] = []  # tag, place, whether unseen from here on
    opened: Counter[str] = Counter()  # how many of each tag the stack holds
    root = Place("none", None, frozenset(), frozenset())
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            blocks.append(Block(text, stack[-1][1] if stack else root, linked))
        pieces.clear()
        linked = 0

    def drop(i: int) -> None:
        opened.subtract(t for t, _, _ in stack[i:])
        del stack[i:]

    def put(text: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and text.strip():
            drop(-1)
        if text and not (stack and stack[-1][2]):
            pieces.append(text)
            if opened["a"]:
                linked += len(text.strip())

    def pop_to(i: int) -> None:
        if any(t in BLOCK for t, _, _ in stack[i:]):
            flush()
        drop(i)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        put(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)
        if not m:
            put("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "br":
                put(" ")
                continue
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break  # an inline end tag doesn't end blocks
            else:
                if tag in BLOCK:
                    flush()
            continue
        end = m[3].rstrip()
        closed = end.endswith("/") and not _OPEN_VALUE.search(end)
        if closed and tag not in BLOCK and any(opened[t] for t in UNSEEN_IN):
            continue
        if tag in RAW and tag != "textarea":
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            drop(-1)
        if tag == "br" or tag in VOID:
            if tag == "hr":
                flush()
            else:
                put(" " if tag == "br" else "")
            continue
        if tag in CLOSES_P:
            flush()
            for i in range(len(stack) - 1, -1, -1) if opened["p"] else ():
                if stack[i][0] == "p":
                    drop(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, -1, -1) if any(opened[t] for t in SIBLINGS[tag]) else ():
                if stack[i][0] in SCOPE[tag]:
                    break
                if stack[i][0] in SIBLINGS[tag]:
                    outer = i
                    while outer and stack[outer - 1][0] in SIBLINGS[tag]:
                        outer -= 1
                    pop_to(outer)
                    break
        if tag in BLOCK:
            flush()
        if closed and tag not in BLOCK:
            continue
        names = frozenset(n for a in _LABEL.findall(m[3]) for n in _NAME.findall("".join(a).lower())) if m[3] else frozenset()
        unseen = tag in UNSEEN or bool(stack and stack[-1][2]) or bool(m[3] and is_hidden(m[3])) or (tag in _PARTS and any(opened[t] and tag in parts for t, parts in UNSEEN_IN.items()))
        stack.append((tag, (stack[-1][1] if stack else root).enter(tag, names), unseen))
        opened[tag] += 1
        if tag == "textarea":
            end = re.compile(r"</textarea\b[^>]*>", re.I).search(page, at)
            put(page[at : end.start() if end else size])
            at = end.end() if end else size
            pop_to(len(stack) - 1)
    flush()
    return blocks


def _bin(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def place_features(place: Place) -> list[str]:
    """Binary features of where a block stands: its ancestors and their names."""
    own, tags = place.own, place.tags
    content = bool({"article", "main"} & tags)
    away = bool({"nav", "header", "footer", "aside", "form"} & tags)
    return ["bias", f"own={own}", f"content={content},away={away},own={own}", *[f"in={t}" for t in sorted(tags)], *[f"name={x}" for x in sorted(place.names)]]


def title_features(blocks: list[Block]) -> list[str]:
    """For each block, whether it is in the element that holds the page's first heading, and whether that has come."""
    at = next((i for i, b in enumerate(blocks) if "h1" in b.place.tags), -1)
    if at < 0:
        return ["title=none"] * len(blocks)
    around: Place | None = blocks[at].place
    while around is not None and "h1" in around.tags:
        around = around.up
    wide = around is None or around.own in ("none", "html", "body")
    within: dict[int, bool] = {id(around): True}
    out = []
    for i, b in enumerate(blocks):
        path, place = [], b.place
        while place is not None and id(place) not in within:
            path.append(place)
            place = place.up
        inside = place is not None and within[id(place)]
        within.update((id(p), inside) for p in path)
        out.append(f"title={i >= at},{'wide' if wide else inside}")
    return out


def run_features(blocks: list[Block]) -> list[str]:
    """For each block, how much of its run is linked: the blocks at its place that follow one another, as a list's items."""
    out: list[str] = []
    for _, run in groupby(blocks, key=lambda b: id(b.place)):
        run = list(run)
        share = sum(b.linked for b in run) / sum(len(b.text) for b in run)
        out += [f"run={_bin(len(run), (2, 4))},{_bin(share, (0.01, 0.3, 0.8))},{run[0].place.own in ('li', 'dd', 'td')}"] * len(run)
    return out


def text_features(b: Block, first: bool, last: bool) -> list[str]:
    """Binary features of a block's text."""
    words = b.text.split()
    n, letters, end = len(words), len(b.text), b.text[-1]
    f = [f"words={_bin(n, (2, 4, 8, 15, 30, 60))}", f"links={_bin(b.linked / letters, (0.01, 0.3, 0.8))}", f"end={'w' if end.isalnum() else end}", f"commas={_bin(b.text.count(','), (1, 3))}"]
    f += [f"caps={_bin(sum(w[:1].isupper() for w in words) / n, (0.2, 0.5, 0.99))}", f"digits={_bin(len(_DIGIT.findall(b.text)) / letters, (0.01, 0.2))}"]
    low = b.text.lower()
    if any(k in low for k in KEYWORDS):
        f += ["key", f"key+words={_bin(n, (4, 15))}"]
    if first:
        f.append("first")
    if last:
        f.append("last")
    return f


def features(blocks: list[Block]) -> list[list[str]]:
    """All features of each block; where it stands decides most, its text the rest."""
    return [[*place_features(b.place), *around, *text_features(b, i == 0, i == len(blocks) - 1)] for i, (b, *around) in enumerate(zip(blocks, run_features(blocks), title_features(blocks), strict=True))]


@dataclass
class Field:
    """A trained field: weights of label main against other by feature, and transition scores [from, to]."""

    weights: dict[str, float]
    transitions: np.ndarray
    start: np.ndarray

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most likely labels, by Viterbi."""
        if not blocks:
            return []
        w, tr, places, last = self.weights, self.transitions.tolist(), {}, len(blocks) - 1
        scores = []
        for i, (b, run, title) in enumerate(zip(blocks, run_features(blocks), title_features(blocks), strict=True)):
            at = id(b.place)
            if at not in places:  # many blocks of a page stand in the same place
                places[at] = sum(w.get(f, 0.0) for f in place_features(b.place))
            scores.append(places[at] + w.get(run, 0.0) + w.get(title, 0.0) + sum(w.get(f, 0.0) for f in text_features(b, i == 0, i == last)))
        best, back = [float(self.start[0]), float(self.start[1]) + scores[0]], []
        for s in scores[1:]:
            other = (best[0] + tr[0][0], best[1] + tr[1][0])
            main = (best[0] + tr[0][1], best[1] + tr[1][1])
            back.append((other[1] > other[0], main[1] > main[0]))
            best = [max(other), max(main) + s]
        label = best[1] > best[0]
        labels = [label]
        for b in reversed(back):
            label = b[1] if label else b[0]
            labels.append(label)
        return labels[::-1]


def train_field(pages: list[tuple[str, list[str]]], rounds: int = 160, decay: float = 2e-4) -> Field:
    """Fit a field to labelled pages; a block is main if its text is the next of the page's main texts."""
    sequences, labels = [], []
    for page, main in pages:
        blocks, wanted, y = leaf_blocks(page), 0, []
        for b in blocks:
            hit = wanted < len(main) and b.text == main[wanted]
            wanted += hit
            y.append(int(hit))
        if blocks and wanted == len(main):
            sequences.append(features(blocks))
            labels.append(y)
    counts: dict[str, int] = {}
    for s in sequences:
        for fs in s:
            for f in fs:
                counts[f] = counts.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= 3))}
    n, length = len(sequences), max(map(len, sequences))
    x = np.zeros((n, length, len(index)), dtype=np.float32)
    y, mask = np.zeros((n, length), dtype=int), np.zeros((n, length), dtype=bool)
    for i, (s, lab) in enumerate(zip(sequences, labels, strict=True)):
        y[i, : len(lab)], mask[i, : len(lab)] = lab, True
        for t, fs in enumerate(s):
            x[i, t, [index[f] for f in fs if f in index]] = 1
    flat = x.reshape(-1, len(index))
    w, tr, st = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    gold_tr, gold_st = np.zeros((2, 2)), np.bincount(y[:, 0], minlength=2).astype(float)
    both = mask[:, 1:]
    np.add.at(gold_tr, (y[:, :-1][both], y[:, 1:][both]), 1)
    m1 = [np.zeros_like(p) for p in (w, tr, st)]
    m2 = [np.zeros_like(p) for p in (w, tr, st)]
    for r in range(1, rounds + 1):
        e = np.zeros((n, length, 2))
        e[:, :, 1] = (flat @ w.astype(np.float32)).reshape(n, length)
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = st + e[:, 0]
        for t in range(1, length):
            alpha[:, t] = np.logaddexp(alpha[:, t - 1, 0, None] + tr[0], alpha[:, t - 1, 1, None] + tr[1]) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], alpha[:, t], alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            go = e[:, t + 1] + beta[:, t + 1]
            b = np.logaddexp(tr[:, 0] + go[:, 0, None], tr[:, 1] + go[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None], b, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        post = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + tr + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        grads = [
            flat.T @ ((y * mask) - post[:, :, 1]).reshape(-1).astype(np.float32) / n - decay * w * 10,
            (gold_tr - pair.sum((0, 1))) / n - decay * tr,
            (gold_st - post[:, 0].sum(0)) / n - decay * st,
        ]
        for p, g, a, b in zip((w, tr, st), grads, m1, m2, strict=True):  # Adam
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += 0.12 * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-8)
    return Field({f: float(w[i]) for f, i in index.items()}, tr, st)


@functools.lru_cache(maxsize=2)
def default_field(n_pages: int = 1000, seed: int = 8) -> Field:
    return train_field(labelled_pages(n_pages, seed))


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, field.decode(blocks), strict=True) if keep)


def extract(df: DataFrame, *, page: str = "html", field: Field | None = None) -> DataFrame:
    """Every row of ``df`` with ``text``, the main text of its page, and ``n_chars``, its length in code points.

    Null and empty pages, and pages without main text, give an empty text and
    0; whole pages are read, however long. Repeated rows stay. Input columns of
    the added names are replaced, other columns are kept; an empty table gives
    an empty result. Without ``field``, one trained on invented pages is used.
    """
    model = field or default_field()
    rows = fresh(df, "text", "n_chars")
    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            texts = [main_text(p, model) for p in batch.column(page).to_pylist()]
            cols = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def html_digest(df: DataFrame) -> DataFrame:
    return extract(df.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
