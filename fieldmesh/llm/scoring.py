"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ORDER symbols (256 bytes and one that ends and precedes a text), with
counts from all training documents. A symbol that a context has not seen costs an escape (method C: as many escape
counts as distinct symbols) to the context shorter by one, in which symbols that the longer one has seen are excluded;
below the empty context all symbols left are alike. As a context's symbols are all seen in its suffix, what an
escape excludes hangs on the context escaped from alone, so every context carries its denominators with it and a
text's positions are scored all at once by hash lookups. A text's code length includes its end.

All contexts count. Frequent ones are broadcast: those with at least RARE of all training symbols or, where these take
more than BYTES, with as many more as it takes to stay below that (sizes are counted by powers of two first); and all of fewer than
LOW symbols (at most 257 ** LOW symbols in them). As a context's suffixes are as frequent as itself, they code what follows them
without the rest. Symbols after other contexts are asked for by a shuffle. A context's place is its shortest suffix that is not
broadcast: the contexts that an escape leads to are there too, or broadcast, and no place holds more than a
frequent context would, so none is hot. A unigram baseline over words comes with it. Word counts are held by 63-bit hashes of the
words: frequent ones (at least HEAD of all tokens, so at most 1 / HEAD) are broadcast, the others meet the documents
that use them in a shuffle by word.

Null texts are empty texts: one token, the end. Repeated rows each count (in training) and give repeated rows; an
empty table gives an empty table; without training documents scores are those of an empty model; other columns are left behind.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, crc_fold, dealt, gathered, id_text, kept, lean, mix64, packed, partitions, pieces, summed

ORDER = 5
RARE, HEAD = 2e-7, 2e-7
#: Contexts shorter than that are all broadcast; of the others, so many bytes at most.
LOW, BYTES = 3, 96 << 20
#: Words whose hash a worker remembers; counts that a training task holds before it passes them on.
REMEMBERED, HELD = 250_000, 1_500_000
END = 0
#: Code of the end among word hashes (which have 63 bits and are never negative).
END_WORD = np.int64(0x5851F42D4C957F2D)
COUNT = np.dtype([("key", "<i8"), ("n", "<i8")])
ASK = np.dtype([("row", "<i8"), ("key", "<i8"), ("n", "<i4")])
ANSWER = np.dtype([("row", "<i8"), ("known", "<i4"), ("log", "<f8"), ("ppm", "<f8")])
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Tags of blobs: contexts' symbols by order, then words.
WORDS = ORDER + 1
#: Tags of asks: for words, for symbols after contexts that are not broadcast.
ASK_WORDS, ASK_SYMBOLS = -1, -2


def shared_suffix(context: np.ndarray) -> np.ndarray:
    """The last LOW symbols of contexts (shorter ones whole)."""
    return context & ((1 << 9 * LOW) - 1)


class Words(dict):
    """Word to 63-bit hash, remembered."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        x = self[w] = xxhash.xxh3_64_intdigest(w) >> 1
        return x


def sequence(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of some texts, ORDER ends before each and after the last, and where each text's first symbol is."""
    n = len(off) - 1
    begin = off[:-1] + ORDER * np.arange(1, n + 1)
    out = np.zeros(len(data) + ORDER * (n + 1), np.int64)
    shift = np.repeat(ORDER * np.arange(1, n + 1), np.diff(off))
    out[np.arange(len(data)) + shift] = data.astype(np.int64) + 1
    return out, begin


def grams(seq: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every symbol to predict (texts' bytes and ends), the symbol with its context as one number, and how many of each text."""
    key = seq[ORDER:].copy()
    for k in range(1, ORDER + 1):
        key |= seq[ORDER - k : len(seq) - k] << (9 * k)
    keep = np.ones(len(key), bool)
    # the ends that stand before a text: ORDER of them before the first are not in key, of the others the first is an end to predict
    gap = (begin[1:] - ORDER)[:, None] - ORDER + np.arange(1, ORDER) if len(begin) > 1 else np.zeros((0, 1), int)
    keep[gap.ravel()] = False
    keep[len(key) - ORDER + 1 :] = False
    return key[keep], size + 1


@lean
def counted(batches):
    """Blobs of one task's counts: for each order symbols with contexts, and words."""
    words = Words()
    tokens: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def fold(top, parts):
        keys = np.concatenate([top[0], *[p[0] for p in parts]])
        return summed(keys, np.concatenate([top[1], *[p[1] for p in parts]]))

    def out(tag, keys, counts, nb):
        context = keys if tag == WORDS else shared_suffix(keys >> 9)
        yield from dealt(packed(COUNT, keys, counts), (mix64(context) % np.uint64(nb)).astype(np.int64), tag)

    top = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    parts, word_parts, n_docs, nb = [], [], 0, None
    for b in batches:
        nb = b.column("nb")[0].as_py()
        ids = b.column("doc_id").to_pylist()
        b = b.take(pa.array([k for k, i in enumerate(ids) if crc_fold(i, 10) != 0], pa.int64()))
        for _, _, data, off in pieces(b):
            n_docs += len(off) - 1
            seq, begin = sequence(data, off)
            keys = np.sort(grams(seq, begin, np.diff(off))[0])
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            parts.append((keys[first], np.diff(np.append(first, len(keys)))))
            low = data.tobytes().lower()
            codes = np.concatenate([np.fromiter(map(words.__getitem__, x := low[off[r] : off[r + 1]].split()), np.int64, len(x)) for r in range(len(off) - 1)])
            codes.sort()
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)
            word_parts.append((codes[first], np.diff(np.append(first, len(codes)))))
            if sum(len(p[0]) for p in parts) > HELD:
                top, parts = fold(top, parts), []
            if sum(len(p[0]) for p in word_parts) > HELD:
                tokens, word_parts = fold(tokens, word_parts), []
            if len(tokens[0]) > HELD:
                yield from out(WORDS, *tokens, nb)
                tokens = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(top[0]) > HELD:
                for k in range(ORDER + 1):
                    yield from out(k, *summed(top[0] & ((1 << 9 * (k + 1)) - 1), top[1]), nb)
                top = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if nb is not None:
        top, tokens = fold(top, parts), fold(tokens, [*word_parts, (np.array([END_WORD] * (n_docs > 0), np.int64), np.array([n_docs] * (n_docs > 0), np.int64))])
        for k in range(ORDER + 1):
            yield from out(k, *summed(top[0] & ((1 << 9 * (k + 1)) - 1), top[1]), nb)
        yield from out(WORDS, *tokens, nb)


@lean
def totals(batches):
    """Sums of a partition's blobs, by bucket and tag."""
    parts: dict[tuple[int, int], list[bytes]] = {}
    for b in batches:
        for bucket, tag, x in zip(*(b.column(c).to_pylist() for c in ("bucket", "tag", "blob"))):
            parts.setdefault((bucket, tag), []).append(x)
    for (bucket, tag), blobs in parts.items():
        x = np.frombuffer(b"".join(blobs), COUNT)
        keys, n = summed(x["key"], x["n"])
        yield from dealt(packed(COUNT, keys, n), np.full(len(keys), bucket), tag)


class Table:
    """A hash table from 64-bit keys to rows, probed for many keys at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.rows = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):
            s = slot[left]
            free = self.keys[s] == -1
            _, first = np.unique(s[free], return_index=True)
            win = left[free][first]
            self.keys[slot[win]], self.rows[slot[win]] = keys[win], win
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        slot = self.slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.rows[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            seen = self.keys[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.rows[slot[left[hit]]]
            left = left[~hit & (seen != -1)]
        return out


class Model:
    """Contexts with their denominators. counts: by order, distinct (context, symbol) keys, ascending, and counts."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = []
        before = None
        for k, (keys, n) in enumerate(counts):
            context = keys >> 9
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, int)
            own = context[first]
            total = np.add.reduceat(n, first).astype(float) if len(keys) else np.zeros(0)
            kinds = np.diff(np.append(first, len(keys))).astype(float)
            row = np.repeat(np.arange(len(first)), kinds.astype(int))
            level = {"log": np.log(n), "entry": Table(keys), "context": Table(own), "start": np.log(n) - np.log(total + kinds)[row], "escape": np.log(kinds) - np.log(total + kinds)}
            if k:
                mask = (1 << 9 * (k - 1)) - 1
                parent = np.searchsorted(before["own"], own & mask)
                shared = before["n"][np.searchsorted(before["keys"], keys & ((mask << 9) | 511))]
                rest = before["total"][parent] - np.bincount(row, shared, len(own))
                new = before["kinds"][parent] - kinds
                level["parent"] = parent
                level["after"] = np.log(np.maximum(rest + new, 1))
                level["again"] = np.where(new > 0, np.log(np.maximum(new, 1)) - level["after"], 0.0)
            before = {"own": own, "keys": keys, "n": n, "total": total, "kinds": kinds}
            self.levels.append(level)
            if k == 0:
                self.none = -np.log(257 - kinds[0]) if len(kinds) and kinds[0] < 257 else -np.log(257)
                self.empty = not len(kinds)

    def code(self, keys: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
        """Log probability (base e) of each symbol in its context. left: set where the longest context is unknown; such symbols are not coded then."""
        out = np.zeros(len(keys))
        last = np.full(len(keys), -1)  # row of the context escaped from, of the order above
        todo = np.arange(len(keys))
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            here = keys[todo] & ((1 << 9 * (k + 1)) - 1)
            at = level["entry"].find(here)
            came = last[todo] >= 0
            hit = at >= 0
            fresh = hit & ~came
            out[todo[fresh]] += level["start"][at[fresh]]
            back = hit & came
            if back.any():
                out[todo[back]] += level["log"][at[back]] - self.levels[k + 1]["after"][last[todo[back]]]
            todo, came, here = todo[~hit], came[~hit], here[~hit]
            if not len(todo):
                return out
            if came.any():
                x = todo[came]
                out[x] += self.levels[k + 1]["again"][last[x]]
                last[x] = self.levels[k + 1]["parent"][last[x]]
            if not came.all():
                x = todo[~came]
                row = level["context"].find(here[~came] >> 9)
                known = row >= 0
                out[x[known]] += level["escape"][row[known]]
                last[x] = np.where(known, row, -1)
                if left is not None and k == len(self.levels) - 1:
                    left[x[~known]] = True
                    todo = x[known]
        out[todo] += self.none
        return out


def part_model(counts: list[list[tuple[np.ndarray, np.ndarray]]], asked: np.ndarray) -> Model:
    """A model of those contexts that asked symbols may fall back on. counts: by order, parts with different contexts, each ascending."""
    some = []
    for k, parts in enumerate(counts):
        context = np.unique((asked >> 9) & ((1 << 9 * k) - 1))
        found = []
        for keys, n in parts:
            begin, end = np.searchsorted(keys, context << 9), np.searchsorted(keys, (context + 1) << 9)
            size = end - begin
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            found.append((keys[at], n[at]))
        keys, n = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(keys)
        some.append((keys[order], n[order]))
    return Model(some)


def places(context: np.ndarray, order: int, frequent) -> np.ndarray:
    """The shortest suffix of LOW symbols or more that is not frequent, of contexts of so many symbols; -1 where all are.
    frequent(k, contexts): which contexts of k symbols are."""
    out = np.full(len(context), -1)
    for k in range(order, LOW - 1, -1):
        own = context & ((1 << 9 * k) - 1)
        rare = ~frequent(k, own)
        out[rare] = own[rare] | ((k - LOW) << 9 * ORDER)  # a suffix of LOW symbols is its own place: its counts lie in that bucket already
    return out


def dealt_to_places(batches, nb: int, frequent):
    """Counts (BLOBS of contexts' symbols and of words) dealt to the buckets where they are asked for; contexts that are broadcast stay behind.
    A task deals HELD counts at a time, so it makes a blob for each bucket and tag rather than for each of those and each blob it reads."""
    held: dict[int, list[np.ndarray]] = {}

    def out():
        for t, parts in held.items():
            x = np.concatenate(parts)
            place = x["key"] if t == WORDS else places(x["key"] >> 9, t, frequent)
            x, place = x[place >= 0], place[place >= 0]
            yield from dealt(x, (mix64(place) % np.uint64(nb)).astype(np.int64), t)
        held.clear()

    n = 0
    for b in batches:
        for t, x in zip(b.column("tag").to_pylist(), b.column("blob").to_pylist()):
            held.setdefault(t, []).append(np.frombuffer(x, COUNT))
            n += len(x) // COUNT.itemsize
            if n > HELD:
                yield from out()
                n = 0
    yield from out()


_models: dict = {}


def score(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    nb = partitions(spark) * 4
    parts = id_text(docs).withColumn("nb", F.lit(nb)).mapInArrow(counted, BLOBS)
    table = kept(parts.repartition(partitions(spark), "bucket").mapInArrow(totals, BLOBS), "ppm-totals")

    @lean
    def sizes(batches):
        for b in batches:
            rows = [(t, np.frombuffer(x, COUNT)["n"].sum(), len(x) // COUNT.itemsize) for t, x in zip(b.column("tag").to_pylist(), b.column("blob").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(3)], ["tag", "n", "v"])

    # symbols and tokens in all, and distinct tokens
    size = {r["tag"]: (r["n"], r["v"]) for r in table.mapInArrow(sizes, "tag long, n long, v long").groupBy("tag").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    symbols, (tokens, distinct) = size.get(0, (0, 0))[0], size.get(WORDS, (0, 0))

    @lean
    def spread(batches):
        """Entries of contexts by the power of two of their symbols."""
        found = np.zeros(64, np.int64)
        for b in batches:
            for t, x in zip(b.column("tag").to_pylist(), b.column("blob").to_pylist()):
                if LOW <= t < WORDS:
                    x = np.frombuffer(x, COUNT)
                    context = x["key"] >> 9
                    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                    many = np.log2(np.add.reduceat(x["n"], first)).astype(int)
                    found += np.bincount(many, np.diff(np.append(first, len(x))), 64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(found)], ["power", "entries"])

    least, held = RARE * symbols, 0
    entries = {r["power"]: r["n"] for r in table.mapInArrow(spread, "power long, entries long").groupBy("power").agg(F.sum("entries").alias("n")).collect()}
    for power in range(63, -1, -1):
        held += entries.get(power, 0) * COUNT.itemsize
        if held > BYTES:
            least = max(least, float(1 << (power + 1)))
            break

    @lean
    def frequent(batches):
        for b in batches:
            for t, x in zip(b.column("tag").to_pylist(), b.column("blob").to_pylist()):
                x = np.frombuffer(x, COUNT)
                if t == WORDS:
                    x = x[x["n"] >= HEAD * tokens]
                elif t >= LOW:
                    context = x["key"] >> 9
                    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                    many = np.add.reduceat(x["n"], first) >= least
                    x = x[np.repeat(many, np.diff(np.append(first, len(x))))]
                yield from dealt(x, np.zeros(len(x), int), t)

    got = gathered(table.mapInArrow(frequent, BLOBS).toArrow().to_batches(), dict.fromkeys(range(WORDS + 1), COUNT))
    got = {t: summed(x["key"], x["n"]) for t, x in got.items()}
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(got)
    floor = np.log10(tokens + 0.1 * (distinct + 1))
    here = partitions(spark)

    @lean
    def scored(batches):
        if name not in _models:
            _models.clear()
            head = shared.value[WORDS]
            _models[name] = (Model([shared.value[k] for k in range(ORDER + 1)]), Table(head[0]), np.log10(head[1] + 0.1), Words())
        model, table, logs, words = _models[name]
        asked: dict[int, list[np.ndarray]] = {ASK_WORDS: [], ASK_SYMBOLS: []}

        def ask(tag, owner, key):
            both = np.lexsort((key, owner))
            o, c = owner[both], key[both]
            first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])]))
            asked[tag].append(packed(ASK, row_id[o[first]], c[first], np.diff(np.append(first, len(o)))))

        for b in batches:
            ids = b.column("doc_id")
            n = len(b)
            n_tokens, known, base, ppm = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            row_id = np.array(b.column("row").to_pylist(), np.int64)
            for i, j, data, off in pieces(b, 1 << 19):
                seq, begin = sequence(data, off)
                keys, many = grams(seq, begin, np.diff(off))
                ends = np.concatenate([[0], np.cumsum(many)])
                left = np.zeros(len(keys), bool)
                ppm[i:j] = np.add.reduceat(model.code(keys, left), ends[:-1]) / np.log(10)
                if left.any():
                    ask(ASK_SYMBOLS, np.repeat(np.arange(i, j), many)[left], keys[left])
                low = data.tobytes().lower()
                lists = [low[off[r] : off[r + 1]].split() for r in range(j - i)]
                count = np.array([len(x) for x in lists])
                codes = np.fromiter((words[w] for x in lists for w in x), np.int64, count.sum())
                n_tokens[i:j] += count
                owner = np.repeat(np.arange(i, j), count)
                at = table.find(codes)
                hit = at >= 0
                base += np.bincount(owner[hit], logs[at[hit]], n)
                known += np.bincount(owner[hit], minlength=n)
                if not hit.all():
                    ask(ASK_WORDS, owner[~hit], codes[~hit])
            end = table.find(np.array([END_WORD]))[0]
            known += int(end >= 0)
            base += (logs[end] if end >= 0 else np.log10(0.1)) - n_tokens * floor
            yield pa.RecordBatch.from_arrays([b.column("row"), ids, pa.array([crc_fold(i, 10) == 0 for i in ids.to_pylist()], pa.bool_()), *map(pa.array, (n_tokens, known, base, ppm)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            for tag in asked:
                if sum(map(len, asked[tag])) > HELD:
                    yield from asks(tag, asked[tag])
                    asked[tag] = []
        for tag in asked:
            if asked[tag]:
                yield from asks(tag, asked[tag])

    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "bucket", "tag", "blob"]

    def asks(tag, asked):
        x = np.concatenate(asked)
        levels = _models[name][0].levels
        place = x["key"] if tag == ASK_WORDS else places(x["key"] >> 9, ORDER, lambda k, own: levels[k]["context"].find(own) >= 0)
        for b in dealt(x, (mix64(place) % np.uint64(nb)).astype(np.int64), tag):
            k = len(b)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())), *(b.column(c) for c in ("bucket", "tag", "blob"))], names)

    # a row's number holds through the one pass that gives both its asks and its results, as that pass is written
    numbered = id_text(docs).withColumn("row", F.monotonically_increasing_id())
    first = kept(numbered.mapInArrow(scored, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, bucket int, tag int, blob binary"), "ppm-scores")

    @lean
    def answered(batches):
        got = gathered(batches, {ASK_WORDS: ASK, ASK_SYMBOLS: ASK, WORDS: COUNT, **dict.fromkeys(range(LOW, ORDER + 1), COUNT)})
        ask, have = got[ASK_WORDS], got[WORDS]
        keys, n = summed(have["key"], have["n"])
        at = np.minimum(np.searchsorted(keys, ask["key"]), max(0, len(keys) - 1))
        c = np.where(keys[at] == ask["key"], n[at], 0) if len(keys) else np.zeros(len(ask), np.int64)
        out = [packed(ANSWER, ask["row"], ask["n"] * (c > 0), ask["n"] * np.log10(c + 0.1), np.zeros(len(ask)))]
        ask = got[ASK_SYMBOLS]
        if len(ask):
            keys, at = np.unique(ask["key"], return_inverse=True)
            model = part_model([[shared.value[k], *([summed(got[k]["key"], got[k]["n"])] if k >= LOW else [])] for k in range(ORDER + 1)], keys)
            none = np.zeros(len(ask))
            out.append(packed(ANSWER, ask["row"], none, none, ask["n"] * (model.code(keys) / np.log(10))[at]))
        # one record for each row and one blob for each bucket, of both kinds of answers
        x = np.concatenate(out)
        if len(x):
            x = x[np.argsort(x["row"], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], x["row"][1:] != x["row"][:-1]]))
            x = packed(ANSWER, x["row"][first], *(np.add.reduceat(x[c], first) for c in ("known", "log", "ppm")))
            yield from dealt(x, (mix64(x["row"]) % np.uint64(nb)).astype(np.int64))

    @lean
    def rare(batches):
        known = {k: np.unique(shared.value[k][0] >> 9) for k in range(LOW, ORDER + 1)}

        def frequent(k, own):
            at = np.minimum(np.searchsorted(known[k], own), max(0, len(known[k]) - 1))
            return known[k][at] == own if len(known[k]) else np.zeros(len(own), bool)

        yield from dealt_to_places(batches, nb, frequent)

    counts = table.where(F.col("tag") >= LOW).mapInArrow(rare, BLOBS)
    asks_ = first.where("blob is not null").select("bucket", "tag", "blob")
    answers = counts.unionByName(asks_).repartition(here, "bucket").mapInArrow(answered, BLOBS)

    @lean
    def together(batches):
        rows, blobs = [], []
        for b in batches:
            rows.append(b.filter(pc.is_valid(b.column("row"))))
            blobs += [x for x in b.column("blob").to_pylist() if x is not None]
        if not rows:
            return
        b = pa.Table.from_batches(rows)
        x = np.frombuffer(b"".join(blobs), ANSWER)
        row = b.column("row").to_numpy()
        order = np.argsort(row)
        at = np.minimum(np.searchsorted(row, x["row"], sorter=order), max(0, len(row) - 1))
        ok = row[order[at]] == x["row"] if len(row) else np.zeros(0, bool)
        more = np.bincount(order[at[ok]], x["known"][ok], len(row))
        log, ppm = (np.bincount(order[at[ok]], x[c][ok], len(row)) for c in ("log", "ppm"))
        out = pa.Table.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("n_tokens"), pa.array(b.column("known").to_numpy() + more.astype(np.int64)), pa.array(np.full(len(row), tokens, np.int64)), pa.array(b.column("base").to_numpy() + log), pa.array(b.column("score").to_numpy() + ppm)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        yield from out.to_batches(max_chunksize=10_000)

    return _together(first.where("blob is null"), answers, nb, here, together)


def _together(own: DataFrame, answers: DataFrame, nb: int, parts: int, f) -> DataFrame:
    """f over results and answers that belong to the same rows."""

    @lean
    def place(batches):
        for b in batches:
            bucket = (mix64(b.column("row").to_numpy()) % np.uint64(nb)).astype(np.int32)
            yield b.set_column(b.schema.get_field_index("bucket"), "bucket", pa.array(bucket))

    placed = own.mapInArrow(place, own.schema)
    empty = [F.lit(None).cast(t).alias(c) for c, t in own.dtypes if c not in ("bucket", "blob")]
    return placed.unionByName(answers.select("bucket", "blob", *empty)).repartition(parts, "bucket").mapInArrow(f, SCHEMA)
