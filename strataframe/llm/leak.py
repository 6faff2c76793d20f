"""Held-out passages that stand in a corpus.

Each task builds FM-indexes over the words of its documents (shards of a bounded number of words): one of the text, one
of every second word of it. Two words that follow each other in a stretch are neighbours in one of them, or next but one
neighbours of the item, as at most one word may be changed, inserted or left out between them. So backward search for the
pairs of words one and two apart in the items, in both indexes, meets every step of every stretch.

A stretch of ``need`` words makes ``need - 1`` of an item's ``n - 1`` words first words of a step. Of any ``n - need + k`` of
them at least ``k`` are such, so only the rarest ones in the shard are located, and ``k`` of them must lie within the length
that a stretch can have: a condition that loses nothing, however dense the edits. What meets it is aligned word by word,
which measures the longest stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.fmindex import FMIndex
from strataframe.llm.tex import _WORD, streams

#: Words of a shard (it needs about 150 bytes of memory each); items searched in one pass.
SHARD, ITEMS = 1 << 20, 20_000
#: Every so many positions of a shard one is kept with its suffix.
RATE = 4
#: Words that may be changed, inserted or left out between two words of a stretch. The steps that are searched belong to it.
GAP = 1
SPANS = "doc_id bigint, item_id bigint, share double, stream int, first_word int, end_word int"


class Phrases:
    """The words of a set of items as numbers, and the pairs of words one and two apart in them."""

    def __init__(self, items: list[tuple[int, str]], least: float):
        self.ids = [i for i, _ in items]
        words = [_WORD.findall((t or "").lower()) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        for w in words:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 2)  # 0 parts texts, 1 is any other word
        self.words = [np.array([self.vocabulary[x] for x in w], dtype="int64") for w in words]
        self.length = np.array([len(w) for w in words], dtype="int64")
        self.need = np.maximum(1, np.ceil(least * self.length - 1e-9)).astype("int64")
        self.least = np.maximum(1, (self.need - 1) * 2 // 5)  # rare steps that a stretch must have: more are surer, fewer are sooner located
        step = [(np.full(max(0, n - d), k), np.arange(max(0, n - d)), w[: max(0, n - d)], w[d:]) for k, (w, n, need) in enumerate(zip(self.words, self.length, self.need, strict=True)) if need > 1 for d in range(1, GAP + 2)]
        single = [(np.full(n, k), np.arange(n), w, np.zeros(n, "int64")) for k, (w, n, need) in enumerate(zip(self.words, self.length, self.need, strict=True)) if need == 1 and n]
        item, place, left, right = (np.concatenate([s[c] for s in step + single]).astype("int64") if step or single else np.empty(0, "int64") for c in range(4))
        pairs, self.pattern = np.unique(np.stack([left, right], axis=1), axis=0, return_inverse=True)
        self.pattern = self.pattern.ravel()
        self.item, self.place, self.pairs = item, place, pairs
        self.spot, self.of_spot = np.unique(item * (int(self.length.max(initial=0)) + 1) + place, return_inverse=True)
        self.of_spot = self.of_spot.ravel()

    def rare(self, counts: np.ndarray) -> np.ndarray:
        """Which pairs to locate, given how often each stands in the shard: those of each item's ``n - need + k`` rarest first words."""
        if not len(self.spot):
            return np.empty(0, bool)
        weight = np.bincount(self.of_spot, weights=counts[self.pattern])
        item = self.spot // (int(self.length.max()) + 1)
        order = np.lexsort((weight, item))
        rank = np.empty(len(order), "int64")
        rank[order] = np.arange(len(order)) - np.searchsorted(item, item)[order]
        return (rank < (self.length - self.need + self.least)[item])[self.of_spot]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair of start and count."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _ends(item: np.ndarray, text: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of ``text``: most words of a stretch that ends at it, and where that starts."""
    places: dict[int, list[int]] = {}
    for i, word in enumerate(item.tolist()):
        places.setdefault(word, []).append(i)
    count, begin = np.zeros(len(text), "int32"), np.zeros(len(text), "int32")
    before: list[dict[int, tuple[int, int]]] = [{} for _ in range(gap + 1)]
    for j, word in enumerate(text.tolist()):
        now: dict[int, tuple[int, int]] = {}
        best = (0, j)
        for i in places.get(word, ()):
            score, start = 0, j
            for column in before:
                for k in range(i - 1, i - gap - 2, -1):
                    seen = column.get(k)
                    if seen and seen[0] > score:
                        score, start = seen
            now[i] = (score + 1, start)
            if score + 1 > best[0]:
                best = now[i]
        count[j], begin[j] = best
        before = [now, *before[:-1]]
    return count, begin


def stretch(item: np.ndarray, text: np.ndarray, gap: int = GAP) -> tuple[int, int, int]:
    """Most words of ``item`` that stand in ``text`` in order as one stretch, and the stretch's ends in ``text``.

    Between matching words, up to ``gap`` words may be changed, inserted or left out.
    """
    count, begin = _ends(item, text, gap)
    j = int(np.argmax(count))
    return int(count[j]), int(begin[j]), j + 1


def stretches(item: np.ndarray, text: np.ndarray, need: float, gap: int = GAP) -> list[tuple[int, int, int]]:
    """All stretches (see :func:`stretch`) of at least ``need`` words, the longest first, that do not overlap.

    What lies between those found is aligned again by itself, until none of ``need`` words is left.
    """
    found, parts = [], [(0, len(text))]
    while parts:
        low, high = parts.pop()
        if high - low < max(1, need):
            continue
        count, begin = _ends(item, text[low:high], gap)
        ends = np.flatnonzero(count >= max(1, need))
        taken = np.zeros(high - low, bool)
        for j in ends[np.argsort(-count[ends], kind="stable")]:
            s, e = int(begin[j]), int(j) + 1
            if not taken[s:e].any():
                taken[s:e] = True
                found.append((int(count[j]), low + s, low + e))
        left = ends[~taken[ends]]  # last words of stretches that lay partly in those found
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True]))
        parts += [(low + int(a), low + int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if np.searchsorted(left, a) < np.searchsorted(left, b)]
    return sorted(found, key=lambda f: (-f[0], f[1]))


def _ranges(index: FMIndex, phrases: Phrases, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each pair; of single words only where asked for."""
    low, found = np.zeros(len(phrases.pairs), "int64"), np.zeros(len(phrases.pairs), "int64")
    lone = phrases.pairs[:, 1] == 0
    for columns, which in ((2, ~lone), (1, lone & single)):
        low[which], high = index.search(phrases.pairs[which, :columns])
        found[which] = high - low[which]
    return low, found


def _places(phrases: Phrases, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place in it, place in the text) of the first words of all rare steps in a shard whose texts end in two zeros."""
    size = len(phrases.vocabulary) + 2
    every = np.arange(len(text))
    origin = np.concatenate([every[0::2], [len(text) - 1], every[1::2]])
    indexes = [(FMIndex(text, size, RATE), every, True), (FMIndex(np.concatenate([text[0::2], [0], text[1::2]]), size, RATE), origin, False)]
    ranges = [_ranges(index, phrases, single) for index, _, single in indexes]
    entry = np.flatnonzero(phrases.rare(sum(found for _, found in ranges)))
    entry = entry[np.argsort(phrases.pattern[entry], kind="stable")]
    pattern, begin, many = np.unique(phrases.pattern[entry], return_index=True, return_counts=True)
    parts = []
    for (index, back, _), (low, found) in zip(indexes, ranges, strict=True):
        at = back[index.locate(_spread(low[pattern], found[pattern]))]
        which = np.repeat(np.arange(len(pattern)), found[pattern])
        hit = entry[_spread(begin[which], many[which])]
        parts.append((phrases.item[hit], phrases.place[hit], np.repeat(at, many[which])))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def _crowded(key: np.ndarray, at: np.ndarray, long: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places that may have ``least`` places of their key within ``long`` words: by counts of blocks as long, hashed (collisions only keep more)."""
    bits = max(10, min(22, int(len(key)).bit_length()))
    block = at // (long + 1)
    own, before, after = ((((key * 0x9E3779B1 + (block + d)) * 0x2545F4914F6CDD1D) >> 20) & ((1 << bits) - 1) for d in (0, -1, 1))
    counts = np.bincount(own, minlength=1 << bits)
    mine = counts[own]
    return np.maximum(counts[before], counts[after]) + mine >= least


def _openings(key: np.ndarray, place: np.ndarray, at: np.ndarray, long: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of places sorted by key and ``at``, those that ``least - 1`` others can follow in one stretch of ``long`` words."""
    need = least - 1
    good = need <= 0
    active, shift = np.flatnonzero(~good), 0
    while len(active):
        shift += 1
        active = active[active + shift < len(key)]
        other = active + shift
        ahead, up = at[other] - at[active], place[other] - place[active]
        inside = (key[other] == key[active]) & (ahead <= long[active])
        active, other, ahead, up = active[inside], other[inside], ahead[inside], up[inside]
        need[active] -= (up > 0) & (ahead > 0) & (ahead <= (GAP + 1) * up) & (up <= (GAP + 1) * ahead)
        done = need[active] <= 0
        good[active[done]] = True
        active = active[~done]
    return good


def _search_shard(phrases: Phrases, text: np.ndarray, ends: np.ndarray, owner: list[tuple[int, int]], least: float) -> Iterator[tuple]:
    """(doc, item, share, stream, first, end) of the leaks of one shard; ``owner`` names document and stream of each text.

    The first ``need`` words of a stretch are a stretch, so its rare steps must follow the first of them within ``long`` words.
    """
    item, place, at = _places(phrases, text)
    stream = np.searchsorted(ends, np.arange(len(text)), side="right")
    key = stream[at] * len(phrases.ids) + item
    span = (GAP + 1) * (phrases.need - 1)
    kept = np.flatnonzero(_crowded(key, at, span[item], phrases.least[item]))
    kept = kept[np.argsort(key[kept] * len(text) + at[kept])]
    key, item, place, at = key[kept], item[kept], place[kept], at[kept]
    kept = np.flatnonzero(_openings(key, place, at, span[item], phrases.least[item]))
    reach = (GAP + 1) * phrases.length
    windows: list[list[int]] = []  # stream, item, from, to
    for k, here in zip(item[kept].tolist(), at[kept].tolist(), strict=True):
        own = int(stream[here])
        low, high = max(int(ends[own - 1]) if own else 0, here - int(reach[k])), min(int(ends[own]) - 2, here + int(reach[k]))
        if windows and windows[-1][:2] == [own, k] and low < windows[-1][3]:  # neighbours see the same words: once
            windows[-1][3] = max(high, windows[-1][3])
        else:
            windows.append([own, k, low, high])
    for own, k, low, high in windows:
        words, begin = phrases.words[k], int(ends[own - 1]) if own else 0
        for count, s, e in stretches(words, text[low:high], least * len(words) - 1e-9):
            yield (*owner[own], phrases.ids[k], count / len(words), low + s - begin, low + e - begin)


def _search(phrases: Phrases, least: float, shard: int):
    def rows(hits: list[tuple]) -> pa.RecordBatch:
        doc, stream, item, share, first, end = zip(*hits, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(stream, pa.int32()), pa.array(first, pa.int32()), pa.array(end, pa.int32())],
            names=["doc_id", "item_id", "share", "stream", "first_word", "end_word"],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = phrases.vocabulary.get
        texts: list[np.ndarray] = []
        owner: list[tuple[int, int]] = []
        held = 0

        def flush() -> list[tuple]:
            ends = np.cumsum([len(t) for t in texts])
            hits = list(_search_shard(phrases, np.concatenate(texts), ends, owner, least))
            texts.clear(), owner.clear()
            return hits

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, words in enumerate(streams(text.as_py())):
                    texts.append(np.array([number(w, 1) for w in words] + [0, 0], dtype="int64"))
                    owner.append((doc, k))
                    held += len(words) + 2
                if held >= shard:
                    hits, held = flush(), 0
                    if hits:
                        yield rows(hits)
        if texts and (hits := flush()):
            yield rows(hits)

    return search


def leaks(documents: DataFrame, items: DataFrame, least: float = 0.5, shard: int = SHARD, block: int = ITEMS) -> DataFrame:
    """Documents that hold at least the share ``least`` of an item's words as one stretch.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, item_text``; other columns are ignored. One row per
    stretch (those of one item do not overlap, and no further one is left between them): ``doc_id, item_id, share, stream, first_word, end_word`` (word positions within a stream of the document: its
    source, an aside or its comments; the end is exclusive). Rows with a null id or text take no part; documents that
    repeat give their rows again; of items with one id the greatest text counts. Items without
    words are not searched. Empty tables give no rows. Items are sent to the tasks in blocks of at most ``block`` rows, one pass over
    the documents for each.
    """
    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("item_text").alias("item_text")).dropna().groupBy("item_id").agg(F.max("item_text").alias("item_text"))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").dropna()
    out, after = None, None
    while True:
        rest = texts if after is None else texts.where(F.col("item_id") > after)
        rows = [(r.item_id, r.item_text) for r in rest.orderBy("item_id").limit(block).collect()]
        if rows or out is None:
            found = docs.mapInArrow(_search(Phrases(rows, least), least, shard), SPANS) if rows else docs.sparkSession.createDataFrame([], SPANS)
            out = found if out is None else out.unionAll(found)
        if len(rows) < block:
            return out
        after = rows[-1][0]


def removal_spans(found: DataFrame) -> DataFrame:
    """Stretches of :func:`leaks` that overlap or touch, merged: ``doc_id, stream, first_word, end_word, n_items``."""
    order = Window.partitionBy("doc_id", "stream").orderBy("first_word", "end_word", "item_id")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("fresh", F.coalesce((F.col("first_word") > reach).cast("int"), F.lit(1)))
    grouped = marked.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "stream", "part").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.countDistinct("item_id").alias("n_items")).drop("part")
