"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Items and texts are sequences of words (runs of ASCII letters and digits, lower-cased, and of bytes over 127). An
item of n words leaks where a stretch of a text is within floor(n / 4) word edits of it. The CGK random walk reads a
sequence of n words through 3 n steps, each step emitting the word it stands on and moving on by a coin that hangs on
step and word, so that few edits become few differing places. A repetition samples SAMPLED places of the walk's output
as the key of a bucket; REPEATS independent walks make the recall. A window of an item's size whose key falls in
the item's bucket is verified by exact edit distance (free ends in the text), so nothing is reported that does not leak.

Windows that cannot be within the distance are not embedded. k edits leave at least n - 1 - 2 k of an item's n - 1
word pairs, each moved by k words at most; so of any 2 k + 1 + m pairs of the item m + 1 stand where they should. An
inverted index of each item's rarest pairs finds the starts of which that is true, and all of the item's pairs are
counted there. That bound drops no match, and every start that passes it is tried by one rule, whatever other items
there are; coins and keys come from the words themselves, so an item's result does not change when others are added.

Items come in blocks of bounded size; each block is sent to all tasks and makes a pass over the texts. Null and
empty texts and items match nothing; repeated items are reported each; repeated rows give repeated rows; an empty
table on either side gives an empty result; columns other than ids and texts are left behind. Of overlapping stretches
that leak the same item one is reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, lean, mix64, pieces

#: Edits a leak may have for each word of an item; repetitions and sampled places of the LSH, steps of a walk for each word.
EDITS, REPEATS, SAMPLED, STEPS = 0.25, 32, 2, 3
#: Pairs beyond the first that the index of rarest pairs asks for; how many entries and words are worked on at once.
MORE, PORTION, TOGETHER = 3, 2_000_000, 200_000
#: Bytes of items that are sent to the tasks at once.
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, edits int, n_words int, start long, end long"

_class = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))
_word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def edit_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between item and any stretch of text, and that stretch (first word, word after the last)."""
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for w in item:
        diag, from_diag = cost[:-1] + (text != w), begin[:-1]
        up, from_up = cost[1:] + 1, begin[1:]
        best = np.where(diag <= up, diag, up)
        src = np.where(diag <= up, from_diag, from_up)
        new, nb = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], nb[0] = cost[0] + 1, begin[0]
        shifted = np.concatenate([[new[0]], best]) - np.arange(n + 1)
        least = np.minimum.accumulate(shifted)
        new = least + np.arange(n + 1)
        where = np.maximum.accumulate(np.where(shifted == least, np.arange(n + 1), 0))
        nb = np.concatenate([[nb[0]], src])[where]
        cost, begin = new, nb
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


class Items:
    """A block of items: their word pairs in an inverted index, and their LSH keys."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.number: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.seqs: list[np.ndarray] = []
        for i, t in rows:
            words = (t or "").encode().translate(_class).split()
            if words:
                self.ids.append(i)
                self.seqs.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words]))
        self.hashes = np.array([0, *map(xxhash.xxh3_64_intdigest, self.number)], np.uint64)
        self.width = len(self.hashes)
        self.n = np.array([len(s) for s in self.seqs], int)
        self.edits = (EDITS * self.n).astype(int)
        #: Pairs that a leak keeps at least, and how many of those its rarest pairs must show (less one).
        self.need = np.maximum(self.n - 1 - 2 * self.edits, 0)
        self.more = np.clip(self.need - 1, 0, MORE)
        owner = np.repeat(np.arange(len(self.seqs)), np.maximum(self.n - 1, 0))
        codes = np.concatenate([s[:-1] * self.width + s[1:] for s in self.seqs]) if self.seqs else np.zeros(0, int)
        place = np.concatenate([np.arange(len(s) - 1) for s in self.seqs]) if self.seqs else np.zeros(0, int)
        self.pairs, which, often = np.unique(codes, return_inverse=True, return_counts=True)
        size = 1 << max(20, int(len(self.pairs) * 16).bit_length())
        self.mask = np.uint64(size - 1)
        self.maybe = np.zeros(size, bool)
        self.maybe[(mix64(self.pairs) & self.mask).astype(np.int64)] = True
        #: Each item's pairs with their places, by pair.
        cuts = np.cumsum(np.maximum(self.n - 1, 0))[:-1]
        self.own = [(w[o := np.argsort(w, kind="stable")], p[o]) for w, p in zip(np.split(which, cuts), np.split(place, cuts))] if self.seqs else []
        # the rarest pairs of each item, as many as 2 edits + 1 + more
        order = np.lexsort((which, often[which], owner)) if len(which) else np.zeros(0, int)
        rank = np.arange(len(order)) - np.repeat(np.cumsum(np.maximum(self.n - 1, 0)) - np.maximum(self.n - 1, 0), np.maximum(self.n - 1, 0))
        order = order[rank < (2 * self.edits + 1 + self.more)[owner[order]]]
        order = order[np.argsort(which[order], kind="stable")]
        self.post_item, self.post_place = owner[order], place[order]
        self.post = np.searchsorted(which[order], np.arange(len(self.pairs) + 1))
        self.single = {int(s[0]): [j for j in range(len(self.seqs)) if self.n[j] == 1 and self.seqs[j][0] == s[0]] for s in self.seqs if len(s) == 1}
        self.sampled: dict[int, np.ndarray] = {}
        self.keys: dict[int, np.ndarray] = {}

    def steps(self, n: int) -> np.ndarray:
        """The places of the walk's output that each repetition samples for items of n words."""
        if n not in self.sampled:
            self.sampled[n] = np.random.default_rng([7, n]).integers(0, STEPS * n, (REPEATS, SAMPLED))
        return self.sampled[n]

    def embedded(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """LSH keys (starts x REPEATS) of the windows of words (hashes) from each start on: up to its end, for items of its size."""
        out = np.zeros((len(starts), REPEATS), np.uint64)
        order = np.argsort(-sizes, kind="stable")
        starts, ends, sizes = starts[order], ends[order], sizes[order]
        words = np.append(words, np.uint64(0))  # behind a window's end stands one word, the same for all
        coins = mix64(words[:, None] + np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        picked = np.stack([self.steps(int(n)) for n in sizes]).reshape(-1)  # starts x repetitions x SAMPLED
        events = np.argsort(picked, kind="stable")
        at_event = np.searchsorted(picked[events], np.arange(STEPS * int(sizes[0]) + 1))
        row, rep, nth = events // (REPEATS * SAMPLED), events // SAMPLED % REPEATS, events % SAMPLED
        shown = np.zeros((len(starts), REPEATS, SAMPLED), np.uint64)
        at, which = np.repeat(starts[:, None], REPEATS, 1), np.arange(REPEATS)
        for j in range(STEPS * int(sizes[0])):
            live = int(np.searchsorted(-sizes, -(j // STEPS), "left"))  # windows whose walk goes on
            at, ends = at[:live], ends[:live]
            if j and j % 64 == 0:
                coins = mix64(coins)
            here = np.where(at < ends[:, None], at, len(words) - 1)
            a, b = at_event[j], at_event[j + 1]
            shown[row[a:b], rep[a:b], nth[a:b]] = words[here[row[a:b], rep[a:b]]]
            at = at + (coins[here, which] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
        key = np.zeros((len(starts), REPEATS), np.uint64)
        for k in range(SAMPLED):
            key = mix64(key + shown[:, :, k])
        out[order] = key
        return out

    def bucket(self, item: int) -> np.ndarray:
        """The item's own keys."""
        if item not in self.keys:
            n = self.n[item : item + 1]
            self.keys[item] = self.embedded(self.hashes[self.seqs[item]], np.zeros(1, int), n, n)[0]
        return self.keys[item]

    def regions(self, ids: np.ndarray, text: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(item, text, starts): the windows that pass the pair bound, starts close together in one entry."""
        code = ids[:-1] * self.width + ids[1:]
        hit = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        hit = hit[self.maybe[(mix64(code[hit]) & self.mask).astype(np.int64)]] if len(self.pairs) else hit[:0]
        pair = np.searchsorted(self.pairs, code[hit])
        real = self.pairs[np.minimum(pair, max(0, len(self.pairs) - 1))] == code[hit] if len(hit) else np.zeros(0, bool)
        hit, pair = hit[real], pair[real]
        out = [(j, int(np.searchsorted(text, q, "right")) - 1, np.array([q])) for w, js in self.single.items() for q in np.flatnonzero(ids == w).tolist() for j in js]
        many = self.post[pair + 1] - self.post[pair]
        portion = np.cumsum(many) // PORTION
        found = []
        for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(portion)) + 1) if len(hit) else []:
            m = many[part]
            at = np.repeat(self.post[pair[part]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            found.append((self.post_item[at], np.repeat(hit[part], m), self.post_place[at]))
        if not found:
            return out
        item, where, place = (np.concatenate(x) for x in zip(*found))
        own, diagonal = np.searchsorted(text, where, "right") - 1, where - place
        order = np.lexsort((diagonal, own, item))
        item, own, diagonal = item[order], own[order], diagonal[order]
        other = np.arange(len(item)) + self.more[item]
        ok = other < len(item)
        other = np.minimum(other, len(item) - 1)
        reach = self.edits[item]
        ok &= (item[other] == item) & (own[other] == own) & (diagonal[other] - diagonal <= 2 * reach)
        low, high = np.maximum(diagonal[other] - reach, text[own]), np.minimum(diagonal + reach, text[own + 1] - 2)
        ok &= low <= high
        item, own, low, high = item[ok], own[ok], low[ok], high[ok]
        if not len(item):
            return out
        # runs of overlapping ranges of starts
        order = np.lexsort((low, own, item))
        item, own, low, high = item[order], own[order], low[order], high[order]
        group = np.cumsum(np.concatenate([[0], (item[1:] != item[:-1]) | (own[1:] != own[:-1])]))
        far = np.maximum.accumulate(high + group * (len(ids) + 1)) - group * (len(ids) + 1)
        first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (low[1:] > far[:-1] + 1)]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(item)]):
            j, lo, hi = int(item[a]), int(low[a]), int(far[b - 1])
            starts = np.arange(lo, hi + 1)
            k, n = int(self.edits[j]), int(self.n[j])
            if self.need[j] > self.more[j] + 1:  # count all of the item's pairs
                x, y = np.searchsorted(hit, [lo - k, hi + n + k])
                mine, places = self.own[j]
                begin, end = np.searchsorted(mine, pair[x:y], "left"), np.searchsorted(mine, pair[x:y], "right")
                m = end - begin
                d = np.repeat(hit[x:y], m) - places[np.repeat(begin - np.cumsum(m) + m, m) + np.arange(m.sum())]
                d = np.sort(d)
                near = np.searchsorted(d, starts + k, "right") - np.searchsorted(d, starts - k, "left") >= self.need[j]
                starts = starts[near]
                middle = np.median(d) if len(d) else lo
            else:
                middle = (lo + hi) / 2
            if len(starts):
                out.append((j, int(own[a]), starts[np.argsort(np.abs(starts - middle), kind="stable")]))
        return out

    def search(self, ids: np.ndarray, text: np.ndarray, hashed) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item_id, edits, words of the item, first word, word after the last) of the leaks. ids: the word
        numbers of some texts, one after the other, after each a 0 that is no word; text: where each begins, and the
        end; hashed(text, first, end): hashes of a text's words."""
        if not self.seqs or len(ids) < 2:
            return []
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        open_, tried = self.regions(ids, text), set()
        while open_:
            batch, rest, words, parts, at = [], [], 0, [], []
            for r in open_:
                j, o, starts = r
                if words > TOGETHER:
                    rest.append(r)
                    continue
                now, later = starts[: 32 + self.n[j] // 64], starts[32 + self.n[j] // 64 :]
                lo, hi = int(now.min()), min(int(now.max() + self.n[j]), int(text[o + 1]) - 1)
                parts.append(hashed(o, lo - int(text[o]), hi - int(text[o])))
                batch.append((j, o, now, later))
                at.append((now + (words - lo), np.minimum(now + self.n[j], hi) + (words - lo), np.full(len(now), self.n[j])))
                words += hi - lo
            keys = self.embedded(np.concatenate(parts), *(np.concatenate(x) for x in zip(*at)))
            open_, done = rest, 0
            for j, o, now, later in batch:
                met = (keys[done : done + len(now)] == self.bucket(j)).any(1)
                done += len(now)
                k, n, base = int(self.edits[j]), int(self.n[j]), int(text[o])
                spans = found.setdefault((o, j), [])
                for q in now[met].tolist():
                    if any(a - (n - k) < q < b for _, a, b in spans) or (mark := (j, o, (q - base) // max(1, k))) in tried:
                        continue
                    tried.add(mark)
                    low, high = max(base, q - 2 * k), min(int(text[o + 1]) - 1, q + n + 2 * k + 1)
                    stretch = set(ids[low:high].tolist())
                    if sum(w in stretch for w in self.seqs[j].tolist()) < n - k:  # each word that is missing costs an edit
                        continue
                    d, a, b = edit_span(self.seqs[j], ids[low:high])
                    if d <= k and all(low + b <= x or y <= low + a for _, x, y in spans):
                        spans.append((d, low + a, low + b))
                for _, a, b in spans:
                    later = later[(later <= a - (n - k)) | (later >= b)]
                if len(later):
                    open_.append((j, o, later))
        return [(o, self.ids[j], d, int(self.n[j]), a - int(text[o]), b - int(text[o])) for (o, j), spans in found.items() for d, a, b in spans]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items with text, in blocks of bounded size (one at least), held one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and text != ''")
    block, size = [], 0
    for r in items.orderBy("item_id", "text").toLocalIterator(prefetchPartitions=False):
        size += len(r["text"]) + 64
        if size > BLOCK_BYTES and block:
            yield block
            block, size = [], len(r["text"]) + 64
        block.append((r["item_id"], r["text"]))
    yield block


def search_piece(items: Items, data: np.ndarray, off: np.ndarray) -> tuple[list[tuple[int, int, int, int, int, int]], bytes]:
    """items.search over the texts of a piece, and the piece as bytes."""
    get = items.number.get
    raw = data.tobytes()
    folded = raw.translate(_class)
    nums = [[get(w, 0) for w in folded[a:e].split()] for a, e in zip(off[:-1], off[1:])]
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in nums])])

    @lru_cache(8)
    def words(o: int) -> list[bytes]:
        return folded[off[o] : off[o + 1]].split()

    def hashed(o: int, first: int, end: int) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words(o)[first:end]), np.uint64, end - first)

    return items.search(np.fromiter((y for x in nums for y in (*x, 0)), np.int64, at[-1]), at, hashed), raw


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each leak: doc_id, item_id, edits, n_words, and where in the text (code points)."""
    spark = docs.sparkSession
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def passed(rows) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        @lean
        def run(batches):
            items = Items(shared.value)
            for b in batches:
                out = []
                ids = b.column("doc_id")
                for i, _, data, off in pieces(b):
                    found, raw = search_piece(items, data, off)
                    spots: dict[int, list] = {}
                    for r, item, d, n, a, e in found:
                        text = raw[off[r] : off[r + 1]]
                        spot = spots.setdefault(r, [m.span() for m in _word.finditer(text)])
                        begin, end = (len(text[:q].decode(errors="ignore")) for q in (spot[a][0], spot[e - 1][1]))
                        out.append((ids[i + r].as_py(), item, d, n, begin, end))
                cols = [*zip(*out)] if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "edits", "n_words", "start", "end"])

        return id_text(docs).mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, map(passed, blocks(benchmark)))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without a leak."""
    spark = docs.sparkSession

    def passed(docs: DataFrame, rows) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        @lean
        def run(batches):
            items = Items(shared.value)
            for b in batches:
                keep = np.ones(len(b), bool)
                for i, _, data, off in pieces(b):
                    keep[[i + f[0] for f in search_piece(items, data, off)[0]]] = False
                yield b.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    for rows in blocks(benchmark):
        docs = passed(docs, rows)
    return docs
