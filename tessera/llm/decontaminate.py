"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick words of a window and ignore the others, so that a seed
survives a substituted word. Seeds of the benchmark are joined with those of
every position of the training texts; around each hit the two texts are laid on
each other and the overlap is verified, tolerating substitutions.
"""

from __future__ import annotations

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, fresh, mix64
from .tokens import encode, steps

# The masks; 1 counts, 0 is ignored.
MASKS = ("1111", "11011", "101101", "1100011")
SHORT_MASKS = ("1", "11", "111")  # for items of just as many words
# Unicode ranges of scripts written without blanks; that many of their characters count as a word.
UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9DF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
CHARACTERS = 3

_UNSPACED = "".join(f"{chr(a)}-{chr(z)}" for a, z in UNSPACED)
_ONE = re.compile(f"[{_UNSPACED}]")
_PIECE = re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+")
_DROP = re.compile(r"[\W_]+")
MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType()), T.StructField("same", T.LongType())]))


def _pieces(word: str) -> list[str]:
    """A word in lower case without punctuation: itself, its characters where the script has no blanks, nothing if nothing is left."""
    w = _DROP.sub("", word.lower())
    return ([w] if w else []) if w.isascii() else _PIECE.findall(w)


def normal_words(text: str) -> list[str]:
    """Words in lower case without punctuation, characters of scripts without blanks one by one; words of punctuation alone are left out."""
    return [p for w in re.findall(WORD, text) for p in _pieces(w)]


def _plain(text: str) -> str:
    return f" {' '.join(re.findall(WORD, text))} "


def _seeds(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of all windows under the mask; 0 where a counted word isn't of the benchmark."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for k, bit in enumerate(mask):
        if bit == "1":
            w = ids[k : k + n]
            known &= w > 0
            h = h * np.uint64(0x100000001B3) + w.astype(np.uint64)
    return np.where(known, mix64(h + np.uint64(1)) | np.uint64(1), np.uint64(0))


class SeedIndex:
    """The seeds of a bounded block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int, share: float) -> None:
        self.window, self.share = window, share
        self.vocabulary: dict[str, int] = {"": 0}
        self.items: list[tuple[int, np.ndarray, int]] = []  # with how many entries make up a word
        self.bare: list[tuple[int, str]] = []  # items without letters and digits, as they are
        for item_id, text in items:
            words = normal_words(text)
            unit = CHARACTERS if 2 * sum(len(w) == 1 and bool(_ONE.match(w)) for w in words) > len(words) else 1
            if words:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], dtype=np.int64), unit))
            elif text.strip():
                self.bare.append((item_id, _plain(text)))
        self.masks = []
        for mask in MASKS + SHORT_MASKS:
            seeds, items_at, places = [], [], []
            for i, (_, ids, _) in enumerate(self.items):
                if mask in SHORT_MASKS and len(ids) != len(mask):
                    continue
                s = _seeds(ids, mask)
                at = np.nonzero(s)[0]
                seeds.append(s[at])
                items_at.append(np.full(len(at), i))
                places.append(at)
            s = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
            order = np.argsort(s, kind="stable")
            self.masks.append((s[order], np.concatenate(items_at)[order] if seeds else s, np.concatenate(places)[order] if seeds else s))

    def overlap(self, doc: np.ndarray, item: np.ndarray, shift: int, unit: int) -> tuple[int, int, int] | None:
        """Verify item laid on doc from ``shift`` on: (start in doc, words, equal words) of the part that agrees."""
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        a = item[low:high]
        same = (doc[low + shift : high + shift] == a) & (a > 0)
        w = min(self.window * unit, len(item))
        if len(a) < w:
            return None
        need = w if w < 8 * unit else math.ceil(self.share * w)
        sums = np.concatenate([[0], np.cumsum(same)])
        good = np.nonzero(sums[w:] - sums[:-w] >= need)[0]
        if not len(good):
            return None
        first, last = int(good[0]), int(good[-1]) + w
        return low + shift + first, last - first, int(sums[last] - sums[first])

    def search(self, texts: pa.Array) -> list[list[dict]]:
        codes, offsets, vocabulary = encode(texts)
        known = [(i,) if (i := self.vocabulary.get(w)) else [self.vocabulary.get(p, 0) for p in _pieces(w)] for w in vocabulary]
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        flat, starts = np.fromiter(chain.from_iterable(known), np.int64, int(lengths.sum())), np.cumsum(lengths) - lengths
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        place = np.repeat(np.arange(len(codes)), lengths[codes])  # of each entry, its word among all words
        ids = flat[np.arange(len(place)) - ends[place] + starts[codes[place]]]
        words_from, offsets = offsets, ends[offsets]
        found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        hits: set[tuple[int, int, int]] = set()
        for mask, (seeds, items_at, places) in zip(MASKS + SHORT_MASKS, self.masks, strict=True):
            if not len(seeds):
                continue
            s = _seeds(ids, mask)
            at = np.nonzero(s)[0]
            if not len(at):
                continue
            lo = np.searchsorted(seeds, s[at], side="left")
            hit = (lo < len(seeds)) & (seeds[np.minimum(lo, len(seeds) - 1)] == s[at])
            at, lo = at[hit], lo[hit]
            hi = np.searchsorted(seeds, s[at], side="right")
            docs = np.searchsorted(offsets, at, side="right") - 1
            inside = at + len(mask) <= offsets[docs + 1]
            for p, a, b, d in zip(at[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), docs[inside].tolist(), strict=True):
                hits.update((d, int(items_at[k]), p - int(offsets[d]) - int(places[k])) for k in range(a, b))
        for d, i, shift in sorted(hits):
            item_id, item, unit = self.items[i]
            if got := self.overlap(ids[offsets[d] : offsets[d + 1]], item, shift, unit):
                first, last = place[offsets[d] + got[0]], place[offsets[d] + got[0] + got[1] - 1]
                found[d].append({"item_id": item_id, "start": int(first - words_from[d]), "words": int(last - first) + 1, "same": got[2]})
        if self.bare:
            for d, text in enumerate(texts.to_pylist()):
                plain = _plain(text or "")
                for item_id, phrase in self.bare:
                    at = plain.find(phrase)
                    while at >= 0:
                        n = phrase.count(" ") - 1
                        found[d].append({"item_id": item_id, "start": plain.count(" ", 0, at), "words": n, "same": n})
                        at = plain.find(phrase, at + 1)
        return found


def decontaminate(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, share: float = 0.8, block_words: int = 1_000_000) -> DataFrame:
    """Every row of ``df`` with ``matches``, what it has of the benchmark (an empty array if nothing).

    A match (item_id, start and words in the text, how many of them are equal)
    holds a window of ``window`` words, or of the whole item if that is
    shorter, of which ``share`` are equal in place; items under 8 words must be
    there entirely, however short they are: an item of one word is in every
    text with that word. Words are compared in lower case without punctuation,
    and words of punctuation alone are passed over on both sides; only an item
    that has no others is looked for as it is, between blanks. Scripts without
    blanks are compared by characters, which ``same`` then counts; in items
    mostly in such a script three count as a word. Null and empty texts match nothing, null
    items are ignored, repeated rows stay, and an input column ``matches`` is
    replaced. The benchmark goes to the executors in blocks of about
    ``block_words`` words, one after the other, whatever its size; a text's
    matches of one diagonal are one match.
    """
    rows = fresh(df, "matches")
    items = benchmark.filter(F.col(item_text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.regexp_count("t", F.lit(r"\S+")) + F.regexp_count("t", F.lit(f"[{_UNSPACED}]")))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    schema = T.StructType([*rows.schema.fields, T.StructField("matches", MATCH)])
    out = rows.withColumn("matches", F.array().cast(MATCH))
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toArrow().sort_by([("i", "ascending"), ("t", "ascending")])
        index = SeedIndex(list(zip(block.column("i").to_pylist(), block.column("t").to_pylist(), strict=True)), window, share)

        def search(batches, index=index):  # noqa: ANN001, ANN202
            for batch in batches:
                texts, found = batch.column(text), []
                for a, z in steps(texts):
                    found += index.search(texts.slice(a, z - a))
                before = batch.column("matches").to_pylist()
                both = pa.array([x + y for x, y in zip(before, found, strict=True)], batch.schema.field("matches").type)
                yield pa.RecordBatch.from_arrays([c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "matches"] + [both], names=[n for n in batch.schema.names if n != "matches"] + ["matches"])

        out = out.mapInArrow(search, schema)
    return out


def decontamination_digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: contaminated, its items (comma-joined, ascending) and the most equal words of one match."""
    found = decontaminate(documents.select("doc_id", "text"), benchmark)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_join(ids.cast("array<string>"), ",").alias("items"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["same"])), F.lit(0)).cast("long").alias("most_words"))
