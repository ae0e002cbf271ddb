"""Removal of long repeats: a run-length index over what repeats, whose matching statistics mark the copies.

A byte goes if a LENGTH-byte string over it also starts earlier in the corpus: in a document with a smaller doc_id,
or in the same document further left. Strings are bytes of UTF-8 and never cross documents; they are judged on the
input.

Localisation. Every LENGTH-byte string is named by the least hash among the GRAM-byte strings in it (its anchor),
so equal strings have equal anchors at equal places. The strings in a row that share one anchor make a segment of
under 2 * LENGTH bytes. Only anchors that occur more than once matter. A segment that repeats an earlier one whole is
a copy whole; tasks find those within their own documents first and pass on one of each kind, so frequent passages
are no hot keys. Segments with a common anchor that differ go to the index.

Index. The segments of a bucket are one text, in order of document and place. Its suffixes are sorted by prefix
doubling; the Burrows-Wheeler transform is held as runs, with text positions sampled at run ends. A longest common
prefix with the suffix before is measured at run starts only; as text is streamed on, each other place's is one less
than that of the place before it. Places whose statistics reach LENGTH form classes, and every place of a class but
its earliest is a copy. Copied stretches of all kinds are united for each document.

Null texts are empty texts. Rows that repeat a doc_id (or have none) are ordered by doc_id, nulls last, then by a hash
of the text. Very short texts lose nothing. An empty table gives an empty table; columns other than doc_id and text
are left behind (with_texts adds the text that is left).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, bitmap, dealt, gathered, id_text, kept, lean, mix64, packed, partitions, pieces, slices_of

LENGTH, GRAM = 100, 32
SPREAD = LENGTH - GRAM + 1
#: Bits of the filter of anchors that go to the index: BITS_EACH for each, at most MOST_BITS.
BITS_EACH, MOST_BITS = 32, 1 << 30
#: Differing segments of one anchor that go to one index; the strings of an anchor with more are dealt out one by one.
TOGETHER = 50_000
#: Segments that a task holds before it passes them on.
HELD = 500_000
SEGMENT = np.dtype([("anchor", "<u8"), ("kind", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("size", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("size", "<i4")])
PIECE = np.dtype([("anchor", "<u8"), ("kind", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("size", "u1"), ("bytes", f"V{LENGTH + SPREAD}")])
ONE = np.dtype([("doc", "<i8"), ("start", "<i4"), ("size", "<i4")])
STRING = np.dtype([("anchor", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("start", "<i4")])
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_odd = mix64(np.arange(1, 40, dtype=np.uint64)) | np.uint64(1)


def _hash(data: np.ndarray, at: np.ndarray | None, width: int) -> np.ndarray:
    """Hashes of width bytes from each place of at on (or from every place)."""
    n = len(data) - width + 1
    out = 0
    for k, o in enumerate([*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]):
        x = np.ndarray((n,), "<u8", data, o, (1,))
        x = x[at] if at is not None else x
        out = out + (x ^ (x >> np.uint64(29))) * _odd[k]
        out = out ^ (out >> np.uint64(32)) if k % 2 else out
    return mix64(out)


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, start (in data), strings in a row, anchor, kind of the segments of some documents."""
    none = np.zeros(0, np.int64)
    many = np.maximum(np.diff(off) - LENGTH + 1, 0)
    total = int(many.sum())
    if not total:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    data = np.ascontiguousarray(data)
    h = _hash(data, None, GRAM)
    low = np.uint64((1 << 26) - 1) if len(h) < 1 << 26 else np.uint64((1 << 34) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPREAD - width)], least[SPREAD - width :])
    row = np.repeat(np.arange(len(many)), many)
    place = off[row] + np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    anchor = (least[place] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], total) - 1
    start, end, at = place[first], place[last], anchor[first]
    a = h[at]
    kind = mix64(_hash(data, start, LENGTH) * _odd[30] + _hash(data, end, LENGTH) * _odd[31] + ((end - start) * 256 + (at - start)).astype(np.uint64))
    return row[first], start, end - start + 1, a, kind


def _doc_bucket(doc: np.ndarray, nb: int) -> np.ndarray:
    return (mix64(doc) % np.uint64(nb)).astype(np.int64)


def _earliest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments in order of anchor, kind, document and place; which are the earliest of their kind."""
    x = x[np.lexsort((x["start"], x["doc"], x["kind"], x["anchor"]))]
    first = np.ones(len(x), bool)
    first[1:] = (x["anchor"][1:] != x["anchor"][:-1]) | (x["kind"][1:] != x["kind"][:-1])
    return x, first


def _spans(x: np.ndarray, nb: int):
    """Blobs of the stretches that these segments cover, united where they touch."""
    if not len(x):
        return
    x = x[np.lexsort((x["start"], x["doc"]))]
    end = x["start"].astype(np.int64) + x["size"] + LENGTH - 1
    fresh = np.concatenate([[True], (x["doc"][1:] != x["doc"][:-1]) | (x["start"][1:] > end[:-1])])
    at = np.flatnonzero(fresh)
    out = packed(SPAN, x["doc"][at], x["start"][at], np.maximum.reduceat(end, at) - x["start"][at])
    yield from dealt(out, _doc_bucket(out["doc"], nb), 1)


def _found(batches):
    """Segments of a task's documents, in portions."""
    for b in batches:
        ids = b.column("doc_id").to_numpy()
        for i, _, data, off in pieces(b):
            row, start, size, anchor, kind = segments(data, off)
            yield data, off, ids[i + row], row, start, size, anchor, kind


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of a text of zero-terminated parts in order; suffixes that end alike go by part. ends: of each place, where its part's terminator is."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    over = np.minimum(ends - np.arange(n), 8)  # bytes beyond the part's end don't count
    key &= np.where(over >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), ~((np.uint64(1) << (np.uint64(64) - np.uint64(8) * np.minimum(over, 7).astype(np.uint64))) - np.uint64(1)) * (over > 0))
    order = np.argsort(key)
    k = key[order]
    rank = np.empty(n, np.int64)
    # a rank is the number of smaller suffixes, which leaves room for telling equals apart
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), place, 0))
    stop = np.flatnonzero(text == 0)
    rank[stop] = np.arange(len(stop))  # terminators differ, by part
    order[: len(stop)] = stop
    width = 8
    todo = order
    while True:
        # only suffixes that share their rank so far are told apart further
        r = rank[todo]
        tie = np.zeros(len(r), bool)
        tie[1:] = r[1:] == r[:-1]
        tie[:-1] |= tie[1:].copy()
        todo, r = todo[tie], r[tie]
        if not len(todo):
            break
        both = r * n + rank[np.minimum(todo + width, ends[todo])]
        order = np.argsort(both)
        todo, both = todo[order], both[order]
        r = both // n
        place = np.arange(len(r))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], r[1:] != r[:-1]]), place, 0))
        head = np.maximum.accumulate(np.where(np.concatenate([[True], both[1:] != both[:-1]]), place, 0))
        rank[todo] = r + (head - group)
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of zero-terminated parts, with positions sampled at run ends."""

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        self.text, self.ends = text, ends
        self.order = suffix_order(text, ends)
        before = np.where(self.order > 0, text[self.order - 1], 0)
        first = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])  # what precedes different parts differs
        self.run_start = np.flatnonzero(first)
        self.run_symbol = before[self.run_start]
        self.sample_first = self.order[self.run_start]
        self.sample_last = self.order[np.append(self.run_start[1:], len(before)) - 1]

    def statistics(self) -> np.ndarray:
        """For each row, the common prefix with the row before, without terminators (exact up to 8 * 32 bytes)."""
        text = np.concatenate([self.text, np.zeros(8, np.uint8)])
        words = np.ndarray((len(self.text),), "<u8", text, 0, (1,))
        here, above = self.sample_first[1:], self.sample_last[:-1]
        room = np.minimum(self.ends[here] - here, self.ends[above] - above)
        length = np.zeros(len(here), np.int64)
        todo = np.flatnonzero(room > 0)
        while len(todo):
            x = words[here[todo] + length[todo]] ^ words[above[todo] + length[todo]]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64)) // 8)
            length[todo] += same
            todo = todo[(same == 8) & (length[todo] < room[todo])]
        length = np.minimum(length, room)
        # streamed along the text: run starts set the value, other places have one less than the place before
        value = np.full(len(self.text), -1, np.int64)
        value[here] = length
        value[self.sample_first[:1]] = 0
        place = np.arange(len(self.text))
        source = np.maximum.accumulate(np.where(value >= 0, place, -1))
        plcp = np.where(source >= 0, np.maximum(value[source] - (place - source), 0), 0)
        return plcp[self.order]

    def copies(self, least: int, earlier: np.ndarray) -> np.ndarray:
        """Places whose next least symbols also occur at a place with a smaller value of earlier."""
        joined = self.statistics() >= least
        at = np.flatnonzero(~joined)
        value = earlier[self.order]
        low = np.minimum.reduceat(value, at)
        size = np.diff(np.append(at, len(joined)))
        out = np.zeros(len(self.text), bool)
        out[self.order] = value > np.repeat(low, size)
        return out


def marked(x: np.ndarray) -> np.ndarray:
    """SEGMENT-like records (doc, start, size) of the strings in these pieces that also start earlier among them."""
    x = x[np.lexsort((x["start"], x["doc"]))]
    whole = np.frombuffer(x["bytes"].tobytes(), np.uint8).reshape(len(x), LENGTH + SPREAD)
    length = x["size"].astype(np.int64) + LENGTH - 1
    keep = np.arange(LENGTH + SPREAD) <= length[:, None]
    text = np.where(np.arange(LENGTH + SPREAD) < length[:, None], whole + np.uint8(1), np.uint8(0))[keep]  # UTF-8 has no byte 255
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    ends = np.repeat(begin[1:] - 1, length + 1)
    part = np.repeat(np.arange(len(x)), length + 1)
    place = np.arange(len(text))
    # the same place of a document may be in two pieces: equal places have equal order
    doc = np.unique(x["doc"], return_inverse=True)[1][part].astype(np.int64)
    earlier = (doc << 32) | (x["start"][part] + place - begin[part])
    copy = RunIndex(text, ends).copies(LENGTH, earlier) & (place + LENGTH <= ends)
    at = np.flatnonzero(copy)
    return packed(ONE, x["doc"][part[at]], x["start"][part[at]] + at - begin[part[at]], np.ones(len(at), np.int64))


def copied(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Blobs (tag 1) of the stretches to remove, dealt out by document; and what can be deleted after use. docs: doc_id unique, not null."""
    spark = docs.sparkSession
    nb = partitions(spark) * 2

    @lean
    def survey(batches):
        held = []
        for _, off, doc, row, start, size, anchor, kind in _found(batches):
            held.append(packed(SEGMENT, anchor, kind, doc, start - off[row], size))
            if sum(map(len, held)) > HELD:
                yield from passed(held)
                held = []
        if held:
            yield from passed(held)

    def passed(held):
        x, first = _earliest(np.concatenate(held))
        yield from _spans(x[~first], nb)
        x = x[first]
        yield from dealt(x, (mix64(x["anchor"]) % np.uint64(nb)).astype(np.int64), 0)

    surveyed = kept(docs.mapInArrow(survey, BLOBS), "segments")

    @lean
    def compare(batches):
        x, first = _earliest(gathered(batches, {0: SEGMENT})[0])
        yield from _spans(x[~first], nb)
        x = x[first]
        tie = np.zeros(len(x), bool)
        tie[1:] = x["anchor"][1:] == x["anchor"][:-1]
        new = np.flatnonzero(tie & ~np.concatenate([[False], tie[:-1]])) if len(x) else np.zeros(0, int)
        yield from dealt(x["anchor"][new].astype("<u8"), np.zeros(len(new), int), 2)
        anchors, n = np.unique(x["anchor"], return_counts=True)
        yield from dealt(anchors[n > TOGETHER], np.zeros((n > TOGETHER).sum(), int), 4)

    compared = kept(surveyed.where("tag = 0").repartition(partitions(spark), "bucket").mapInArrow(compare, BLOBS), "compared")
    many = compared.where("tag = 2").select(F.sum(F.length("blob") / 8)).first()[0] or 0
    bits = min(MOST_BITS, 1 << max(16, int(np.ceil(np.log2(max(1, many * BITS_EACH))))))

    @lean
    def cells(batches):
        x = [np.zeros(0, np.int64)]
        for b in batches:
            x += [np.unique((np.frombuffer(y, "<u8") % np.uint64(bits)).astype(np.int64)) for y in b.column("blob").to_pylist()]
        yield from slices_of(np.concatenate(x), bits)

    filter_ = bitmap(compared.where("tag = 2").mapInArrow(cells, BLOBS), bits)
    # at most one of TOGETHER segments has such an anchor
    frequent = gathered(compared.where("tag = 4").toArrow().to_batches(), {4: np.dtype("<u8")})[4]
    shared = spark.sparkContext.broadcast((filter_, np.sort(frequent)))

    @lean
    def fetch(batches):
        held, strings = [], []
        marks, hot = shared.value
        for data, off, doc, row, start, size, anchor, kind in _found(batches):
            cell = (anchor % np.uint64(bits)).astype(np.int64)
            some = np.flatnonzero(marks[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
            if not len(some):
                continue
            if len(hot):
                of_hot = np.isin(anchor[some], hot)
                if of_hot.any():
                    pick = some[of_hot]
                    many = size[pick]
                    at = np.repeat(start[pick], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    own = np.repeat(pick, many)
                    strings.append(packed(STRING, anchor[own], _hash(data, at, LENGTH), doc[own], at - off[row[own]]))
                    if sum(map(len, strings)) > HELD:
                        yield from strung(strings)
                        strings = []
                some = some[~of_hot]
                if not len(some):
                    continue
            padded = np.concatenate([data, np.zeros(LENGTH + SPREAD, np.uint8)])
            at = start[some]
            raw = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, LENGTH + SPREAD)[at]).view(f"V{LENGTH + SPREAD}").ravel()
            held.append(packed(PIECE, anchor[some], kind[some], doc[some], at - off[row[some]], size[some], raw))
            if sum(map(len, held)) > 60_000:
                yield from sent(held)
                held = []
        if held:
            yield from sent(held)
        if strings:
            yield from strung(strings)

    def later(x):
        """Strings in order, and which have an equal before them."""
        x = x[np.lexsort((x["start"], x["doc"], x["hash"], x["anchor"]))]
        again = np.zeros(len(x), bool)
        again[1:] = (x["anchor"][1:] == x["anchor"][:-1]) & (x["hash"][1:] == x["hash"][:-1])
        return x, again

    def strung(strings):
        x, again = later(np.concatenate(strings))
        yield from _spans(packed(ONE, x["doc"][again], x["start"][again], np.ones(again.sum(), int)), nb)
        x = x[~again]
        yield from dealt(x, (mix64(x["hash"]) % np.uint64(nb)).astype(np.int64), 5)

    def sent(held):
        x, first = _earliest(np.concatenate(held))
        x = x[first]
        yield from dealt(x, (mix64(x["anchor"]) % np.uint64(nb)).astype(np.int64), 3)

    @lean
    def index(batches):
        got = gathered(batches, {1: SPAN, 3: PIECE, 5: STRING})
        yield from dealt(got[1], _doc_bucket(got[1]["doc"], nb), 1)  # stretches that were found on the way here
        x, again = later(got[5])
        yield from _spans(packed(ONE, x["doc"][again], x["start"][again], np.ones(again.sum(), int)), nb)
        x = got[3]
        if not len(x):
            return
        x, first = _earliest(x)  # later ones of a kind are known as copies
        x = x[first]
        cuts = np.flatnonzero(np.concatenate([[True], x["anchor"][1:] != x["anchor"][:-1]]))
        portion, size = [], 0
        for a, b in zip(cuts, [*cuts[1:], len(x)]):
            if b - a > 1:
                portion.append(x[a:b])
                size += b - a
            if size > 5_000:
                yield from told(portion)
                portion, size = [], 0
        if portion:
            yield from told(portion)

    def told(portion):
        y = marked(np.concatenate(portion))
        yield from _spans(y, nb)

    indexed = docs.mapInArrow(fetch, BLOBS).repartition(partitions(spark), "bucket").mapInArrow(index, BLOBS)
    return surveyed.where("tag = 1").unionByName(compared.where("tag = 1")).unionByName(indexed), [surveyed, compared]


def _numbered(docs: DataFrame, more: tuple[str, ...]) -> DataFrame:
    """docs with a column ord, their place by doc_id (nulls last), then by a hash of the text."""
    spark = docs.sparkSession
    own = ["doc_id", "text", *more]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    @lean
    def number(batches):
        k, part = 0, TaskContext.get().partitionId()
        for b in batches:
            n = len(b)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array([part] * n, pa.int32()), pa.array(np.arange(k, k + n))], [*own, "part", "k"])
            k += n

    ranged = docs.withColumn("x", F.xxhash64("text")).repartitionByRange(partitions(spark), F.asc_nulls_last("doc_id"), "x").sortWithinPartitions(F.asc_nulls_last("doc_id"), "x").drop("x")
    rows = kept(ranged.mapInArrow(number, schema + ", part int, k long"), "numbered")
    size = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each task
    at, offsets = 0, []
    for p in sorted(size):
        offsets.append((p, at))
        at += size[p]
    if not offsets:
        return rows.select(*own, F.col("k").alias("ord"))
    return rows.join(F.broadcast(spark.createDataFrame(offsets, "part int, at long")), "part").select(*own, (F.col("at") + F.col("k")).alias("ord"))


def remove_repeats(docs: DataFrame, with_texts: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with_texts adds text, the bytes that are left
    (characters that a cut left broken are dropped from it), and the columns named in more."""
    import zstandard

    spark = docs.sparkSession
    docs = id_text(docs, *more)
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() > 0
    docs = _numbered(docs, more) if odd else docs.withColumn("ord", F.col("doc_id"))
    spans, _ = copied(docs.select(F.col("ord").alias("doc_id"), "text"))
    nb = partitions(spark) * 2
    types = dict(docs.dtypes)
    own = ["doc_id", "ord", *more]
    names = ["bucket", "tag", "blob", *own]

    @lean
    def place(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            n = len(b)
            yield pa.RecordBatch.from_arrays([pa.array(_doc_bucket(b.column("ord").to_numpy(), nb).astype(np.int32)), pa.array([0] * n, pa.int32()), pa.array([z.compress(t or b"") for t in texts], pa.binary()), *(b.column(c) for c in own)], names)

    placed = docs.mapInArrow(place, ", ".join([BLOBS, *(f"`{c}` {types[c]}" for c in own)]))

    @lean
    def cut(batches):
        z = zstandard.ZstdDecompressor()
        spans, held = [], []
        for b in batches:
            tag = b.column("tag").to_numpy()
            spans += b.column("blob").filter(pa.array(tag != 0)).to_pylist()
            held.append(b.filter(pa.array(tag == 0)))
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by("ord")
        s = np.frombuffer(b"".join(spans), SPAN)
        s = s[np.lexsort((s["start"], s["doc"]))]
        low, high = (np.searchsorted(s["doc"], rows.column("ord").to_numpy(), side) for side in ("left", "right"))
        k = 0
        for b in rows.to_batches(max_chunksize=1000):
            out = []
            for x, a, e in zip(b.column("blob").to_pylist(), low[k : k + len(b)], high[k : k + len(b)]):
                text = z.decompress(x)
                left, n_spans = without(text, s["start"][a:e].tolist(), s["size"][a:e].tolist())
                out.append((len(text), len(text) - len(left), n_spans, hashlib.sha256(left).hexdigest(), *([left.decode(errors="ignore")] * with_texts)))
            k += len(b)
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, *(b.column(c) for c in more)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * with_texts, *more])

    both = placed.unionByName(spans.select("bucket", "tag", "blob", *(F.lit(None).cast(types[c]).alias(c) for c in own)))
    return both.repartition(partitions(spark), "bucket").mapInArrow(cut, ", ".join([SCHEMA, *["text string"] * with_texts, *(f"`{c}` {types[c]}" for c in more)]))


def without(text: bytes, starts: list[int], sizes: list[int]) -> tuple[bytes, int]:
    """A text without the stretches named (ascending by start, they may overlap), and how many runs went."""
    parts, at, runs, end = [], 0, 0, -1
    for p, w in zip(starts, sizes):
        if p > end:
            parts.append(text[at:p])
            runs += 1
        at = end = max(end, p + w)
    return b"".join([*parts, text[at:]]), runs
