"""Passages of held-out evaluation items inside a corpus."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Items that a task looks for together.
BLOCK = 512
#: Words of items shipped to the tasks at once, some tens of megabytes; more take another pass.
SHIPPED = 1 << 21
#: Distinct words whose q-gram rows a task keeps.
MEMO = 50_000
#: Words of a long document that are looked at together (besides the overlap).
STEP = 16_384

TAG = re.compile(r"<[/!]?[A-Za-z][^<>\n]{0,200}>|<br\s*/?>")
HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*[\r\n]+\s*(?=[^\W\d_])")
HIDDEN = re.compile("[­​‌‍⁠﻿]")
POINT = re.compile(r"(?<=\d)[.,'\u2009\u202f](?=\d)")
#: Combining marks of the blocks that decomposed letters use.
MARK = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words and numbers without case, accents, punctuation, markup and typesetting."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = HYPHEN.sub("", text if text.isascii() else HIDDEN.sub("", text))
    if not text.isascii():
        text = MARK.sub("", unicodedata.normalize("NFKD", text))
    return WORD.findall(POINT.sub("", text.casefold()))


class Finder:
    """Finds items in one document in three steps, each keeping every true case.

    1. Q-gram lemma: a stretch that holds a share of the item's words holds at least the q-grams
       of as many of its shortest words.  The stretches tried are overlapping diagonal bands of
       the alignment, a little wider than twice the item's words so that each run of that many
       words lies in one.  Their q-gram counts come from prefix sums over the words; bands under
       the bound are dropped.
    2. The same count over whole words, first as often as they come, then at most as often as the
       item has them.
    3. Banded alignment: longest common subsequence of the item and each remaining band, one bit
       a word of the item.
    """

    def __init__(self, items: dict[int, list[str]], share: float, q: int):
        self.ids = list(items)
        self.items = [items[i] for i in self.ids]
        self.q, self.share = q, share
        self.need = [int(np.ceil(share * len(w) - 1e-9)) for w in self.items]
        self.reach = np.array([2 * len(w) for w in self.items])
        self.least = np.array(self.need)
        self.shortest = int(self.reach.min(initial=0))
        self.stride = max(1, self.shortest // 16)
        self.grams: dict[str, list[int]] = {}
        bound = []
        for at, own in enumerate(self.items):
            for g in {g for w in own for g in self.pieces(w)}:
                self.grams.setdefault(g, []).append(at)
            sizes = sorted(len(self.pieces(w)) for w in own)
            bound.append(sum(sizes[: self.need[at]]))
        self.bound = np.array(bound, dtype=np.int64)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, 2 * len(self.ids)), dtype=np.uint8)
        self.holds: dict[str, list[int]] = {}
        for at, own in enumerate(self.items):
            for w in set(own):
                self.holds.setdefault(w, []).append(at)
        self.known = [Counter(w) for w in self.items]
        self.masks: list[dict[str, int]] = []
        for own in self.items:
            masks: dict[str, int] = {}
            for i, w in enumerate(own):
                masks[w] = masks.get(w, 0) | (1 << i)
            self.masks.append(masks)

    def pieces(self, word: str) -> list[str]:
        """q-grams of the word between blanks; a word shorter than that counts as one."""
        padded = f" {word} "
        return [padded[i : i + self.q] for i in range(max(1, len(padded) - self.q + 1))]

    def row(self, word: str) -> int:
        """Row of the table with the word's q-grams found in each item, then whether the item
        has the word."""
        at = self.rows.get(word)
        if at is None:
            at = len(self.rows)
            if at >= len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            counts = self.table[at]
            counts[:] = 0
            for g in self.pieces(word[:250]):
                for i in self.grams.get(g, ()):
                    counts[i] += 1
            if len(word) > 250:
                counts[counts > 0] = 255  # never undercounts
            for i in self.holds.get(word, ()):
                counts[len(self.ids) + i] = 1
            self.rows[word] = at
        return at

    def find(self, text: str | None) -> Iterator[tuple[int, float]]:
        """(item, share of its words in the best stretch) of each leaked item."""
        return self.find_words(words(text) if text else [])

    def find_words(self, doc: list[str]) -> Iterator[tuple[int, float]]:
        best: dict[int, int] = {}
        widest = int(self.reach.max(initial=0))
        for s in range(0, max(1, len(doc) - widest), STEP):
            for at, got in self.find_in(doc[s : s + STEP + widest]):
                best[at] = max(got, best.get(at, 0))
        for at, got in best.items():
            yield self.ids[at], got / len(self.items[at])

    def find_in(self, doc: list[str]) -> Iterator[tuple[int, int]]:
        if not doc:
            return
        if len(self.rows) > MEMO:
            self.rows.clear()
        at = np.array([self.row(w) for w in doc])
        m = len(self.ids)
        cells = self.table[at]
        sums = cells.sum(axis=0, dtype=np.int64)
        # items that the whole text cannot hold need no bands
        open_ = np.flatnonzero((sums[:m] >= self.bound) & (sums[m:] >= self.least))
        if len(open_) and len(doc) > self.shortest:
            k = len(open_)
            run = np.zeros((len(doc) + 1, 2 * k), dtype=np.int32)
            np.cumsum(cells[:, np.concatenate([open_, m + open_])], axis=0, dtype=np.int32, out=run[1:])
            # bands of twice the item's words, overlapping by all but a few words
            starts = np.arange(0, len(doc), self.stride)
            ends = np.minimum(starts[:, None] + self.reach[open_] + self.stride - 1, len(doc))
            cols = np.arange(k)
            most = (run[ends, cols] - run[starts, :k]).max(axis=0)
            shared = (run[ends, k + cols] - run[starts, k:]).max(axis=0)
            open_ = open_[(most >= self.bound[open_]) & (shared >= self.least[open_])]
        if not len(open_):
            return
        have = Counter(doc).get
        for item in open_:
            # words in common at all, each at most as often as the item has it
            if sum(min(n, have(w, 0)) for w, n in self.known[item].items()) < self.need[item]:
                continue
            got = self.align(doc, int(item))
            if got >= self.need[item]:
                yield int(item), got

    def align(self, doc: list[str], at: int) -> int:
        """Most words of the item in order within any stretch of twice its length."""
        own, need, reach = self.items[at], self.need[at], int(self.reach[at])
        known, masks = self.known[at], self.masks[at]
        spots = [i for i, w in enumerate(doc) if w in known]
        if len(spots) < need:
            return 0
        full = (1 << len(own)) - 1
        best = right = shared = 0
        held: dict[str, int] = {}
        for left, start in enumerate(spots):
            while right < len(spots) and spots[right] < start + reach:
                w = doc[spots[right]]
                n = held.get(w, 0)
                held[w] = n + 1
                shared += n < known[w]
                right += 1
            if shared >= max(need, best + 1):
                v = full
                for i in spots[left:right]:
                    u = v & masks[doc[i]]
                    v = ((v + u) | (v - u)) & full
                best = max(best, len(own) - v.bit_count())
                if best == len(own):
                    break
            w = doc[start]
            held[w] -= 1
            shared -= held[w] < known[w]
        return best


def item_words(items: DataFrame, item_col: str = "item_id", text_col: str = "item_text") -> DataFrame:
    """``item, own``: the words of each item without an opening line that other items share.

    Of equal ids the longest text counts (ties: the first in order); null ids and texts and items
    without own words are left out."""
    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("t")).dropna()
    rows = rows.groupBy("item").agg(F.max_by("t", F.struct(F.length("t"), "t")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, rest = [], []
            for text in batch.column("t").to_pylist():
                lines = [x for x in text.splitlines() if x.strip()]
                head.append(words(lines[0]) if lines else [])
                rest.append(words("\n".join(lines[1:])) if len(lines) > 1 else None)
            full = [words(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), *(pa.array(x, pa.list_(pa.string())) for x in (head, rest, full))], names=["item", "head", "rest", "full"])

    cut_up = rows.mapInArrow(run, "item long, head array<string>, rest array<string>, full array<string>")
    shared = cut_up.filter("rest is not null").groupBy("head").agg(F.count("*").alias("n")).filter("n > 1").select("head", F.lit(True).alias("shared"))
    own = F.when(F.col("shared") & F.col("rest").isNotNull(), F.col("rest")).otherwise(F.col("full"))
    return cut_up.join(shared, "head", "left").select("item", own.alias("own")).filter(F.size("own") > 0)


def find_leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "item_text", share: float = 0.55, q: int = 4) -> DataFrame:
    """``doc_id, item_id, share``: documents with at least ``share`` of an item's own words, in
    their order, within a stretch of at most twice the item's words.

    The items are cut to words on the executors.  They are shipped to the tasks in loads of at
    most ``SHIPPED`` words, each measured before it is sent; a load takes one pass over the corpus,
    in which each document is cut to words once and looked through block by block.  The corpus is
    only streamed: no shuffle of texts.  Items may repeat; of equal ids the longest text counts.
    Null or empty texts, null ids and items without own words give nothing.  Texts are read whole.
    Two items with the same words are both reported.  Empty tables give an empty result.
    """
    own = cut(item_words(items, item_col, item_text_col))
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    total = own.agg(F.sum(F.size("own")).alias("n")).first()["n"] or 0
    loads = max(1, -(-total * 2 // SHIPPED))  # twice as many as would do, as the hash deals unevenly
    out = None
    for load in range(loads):
        part = own.filter(F.pmod(F.xxhash64("item"), F.lit(loads)) == load) if loads > 1 else own
        got = {r["item"]: r["own"] for r in part.orderBy("item").collect()}  # about SHIPPED words at most
        ids = list(got)
        blocks = [{i: got[i] for i in ids[s : s + BLOCK]} for s in range(0, len(ids), BLOCK)]
        sent = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finders = [Finder(b, share, q) for b in sent.value]
            for batch in batches:
                found = []
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    doc = words(t)
                    found += [(d, i, x) for finder in finders for i, x in finder.find_words(doc)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())],
                    names=["doc_id", "item_id", "share"],
                )

        found = rows.mapInArrow(run, "doc_id long, item_id long, share double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
