"""MinHash near-duplicates by a signature-coordinate inverted join.

Words are `[^ \\t-\\r]+` with A-Z lower-cased; a document's set holds its distinct five-word shingles (with fewer
words the whole sequence; without words nothing), each as a 64-bit hash. Equal sets are one node, known by a 64-bit
hash of the set. A node's signature has COORDINATES minima. Two sets of similarity 0.75 or more agree in at least
MATCH of them (up to a chance of about 2e-6), so they share a coordinate-value pair among the COORDINATES - MATCH + 1
that come first in any one order of such pairs. That order is by how often pairs occur (from a counting sketch of
fixed size), rarest first, so frequent pairs are posted only by nodes that have little else.

Posts carry the signature's low half-bytes. Members of a posting list whose half-bytes agree in at least MATCH places
(whatever coordinates agree, their half-bytes do, so no match is lost) are linked. A list with more than WHOLE members
within a task, or LIST in all, is linked as a whole, which loses nothing either; of the former a task passes on one
member, so a frequent pair is no hot key. Nodes that links connect form a cluster, which so holds every pair that may
match. Within a cluster signatures are matched, pairs that agree in at least MATCH coordinates and are not yet connected
are confirmed on their full sets (100 * intersection >= 75 * union), and only links that connect something new are
passed on. A cluster of more than BLOCK nodes first meets in blocks of nodes that stand side by side; nodes that are still apart
then visit the blocks with which they share one of their rarest shingles. Components of those links are the
answer; no pair of a large group is written out.

Null texts are empty texts, and empty texts are linked with nothing. Repeated rows are linked if they have words; a
null doc_id is larger than any other. An empty table gives an empty table; columns other than doc_id and text are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, bitmap, dealt, gathered, id_text, kept, lean, merged_slices, mix64, packed, partitions, pieces, slices_of
from .graph import components

SHINGLE, COORDINATES, MATCH = 5, 64, 32
#: Cells of the counting sketch, bits of the filter of wanted documents, nodes of a block.
SKETCH, WANTED_BITS, BLOCK = 1 << 20, 1 << 27, 512
#: Coordinates by whose order a large cluster's nodes stand side by side.
PASSES = (0, 16, 32, 48)
#: Parts that a root's rows are dealt to where they meet the root's one row.
SALTS = 8
WHOLE, LIST = 2_000, 8_000
#: Words that a worker remembers, places that a task holds before it passes them on.
REMEMBERED, HELD = 250_000, 4_000_000
POST = np.dtype([("key", "<i8"), ("node", "<i8"), ("whole", "u1"), ("low", "u1", (COORDINATES // 2,))])
LINK = np.dtype([("u", "<i8"), ("v", "<i8")])
SCHEMA = "doc_id long, n_shingles long, component_id long, kept boolean"

_multiply = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_add = mix64(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))


class Words(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        x = self[w] = xxhash.xxh3_64_intdigest(w)
        return x


def shingles(text: bytes, words: Words) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    seq = text.lower().split()
    if not seq:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, seq), np.uint64, len(seq))
    n = max(1, len(h) - SHINGLE + 1)
    if len(h) < SHINGLE:
        x = np.array([len(h)], np.uint64)
        for w in h:
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + w)
        return x
    x = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    x = np.sort(mix64(x))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def signature(s: np.ndarray) -> np.ndarray:
    """The least of each coordinate's hash over a set."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 4096):
        x = s[i : i + 4096, None] * _multiply + _add
        np.minimum(out, (x >> np.uint64(32)).min(0).astype(np.uint32), out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, node, sig of every row; node and sig are null where there are no words."""

    @lean
    def run(batches):
        words = Words()
        for b in batches:
            n, node, sig = [], [], []
            for _, _, data, off in pieces(b):
                raw = data.tobytes()
                for a, e in zip(off[:-1], off[1:]):
                    s = shingles(raw[a:e], words)
                    n.append(len(s))
                    node.append(xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "n", "node", "sig"])

    hashed = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")
    return id_text(docs, hashed).mapInArrow(run, "doc_id long, text_hash long, n long, node long, sig binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _keys(sig: np.ndarray) -> np.ndarray:
    """The coordinate-value pairs as numbers."""
    return mix64((np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | sig.astype(np.uint64))


def _sketch(rows: DataFrame, numbers) -> np.ndarray:
    """How often the 64-bit numbers that numbers() finds in a batch occur, by the cell they fall in."""
    width = SKETCH // 64

    @lean
    def count(batches):
        cells = None
        for b in batches:
            if len(b):
                x = np.bincount((numbers(b) & np.uint64(SKETCH - 1)).astype(np.int64).ravel(), minlength=SKETCH)
                cells = x if cells is None else cells + x
        if cells is not None:
            for k in range(64):
                yield from dealt(cells[k * width : (k + 1) * width].astype("<i8"), np.full(width, k))

    out = np.zeros(SKETCH, np.int64)
    for k, x in merged_slices(rows.mapInArrow(count, BLOBS), np.add):
        out[k * width : (k + 1) * width] = x
    return np.minimum(out, (1 << 23) - 1)


def _half_bytes(sig: np.ndarray) -> np.ndarray:
    low = (sig & np.uint32(15)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def _lists(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posts in order by pair and node, and where each list of two or more begins and ends."""
    order = np.lexsort((node, key))
    key = key[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    many = np.diff(cut) > 1
    return order, cut[:-1][many], cut[1:][many]


_both = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def _alike(low: np.ndarray, whole: np.ndarray) -> list[tuple[int, int]]:
    """Links within a posting list, in numbers of its members."""
    n = len(low)
    if n > LIST or whole.any():  # a member that stands for a whole list is linked with all
        return [(i, 0) for i in range(1, n)]
    root = np.arange(n)
    for i in range(n - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if len(rest):
            hit = rest[_both[low[rest] ^ low[i]].sum(1) >= MATCH]
            if len(hit):
                joined = np.unique(np.append(root[hit], root[i]))
                root[np.isin(root, joined)] = joined[0]
    return [(i, int(r)) for i, r in enumerate(root.tolist()) if r != i]


def _stars(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Links as few: each node of a component of these links with one of it."""
    root: dict[int, int] = {}

    def find(i):
        while (r := root.setdefault(i, i)) != i:
            root[i] = i = root[r]
        return i

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    out = [(i, find(i)) for i in [*root]]
    return np.array([x for x in out if x[0] != x[1]], LINK)


def links(nodes: DataFrame) -> DataFrame:
    """u, v: links between members of posting lists that may match."""
    spark = nodes.sparkSession
    nb = partitions(spark) * 2
    often = spark.sparkContext.broadcast(_sketch(nodes.select("sig"), lambda b: _keys(_matrix(b.column("sig")))))

    @lean
    def post(batches):
        held = []
        for b in batches:
            if not len(b):
                continue
            sig = _matrix(b.column("sig"))
            key = _keys(sig)
            rank = (often.value[(key & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
            posted = COORDINATES - MATCH + 1
            prefix = np.argpartition(rank, posted - 1, 1)[:, :posted]
            x = np.zeros(len(b) * posted, POST)
            x["key"] = np.take_along_axis(key, prefix, 1).astype(np.int64).ravel()
            x["node"] = np.repeat(b.column("node").to_numpy(), posted)
            x["low"] = np.repeat(_half_bytes(sig), posted, 0)
            held.append(x)
            if sum(map(len, held)) > 300_000:
                yield from out(held)
                held = []
        if held:
            yield from out(held)

    def out(held):
        x = np.concatenate(held)
        order, begin, end = _lists(x["key"], x["node"])
        x = x[order]
        keep = np.ones(len(x), bool)
        found = []
        for a, e in zip(begin.tolist(), end.tolist()):
            if e - a > WHOLE:
                found.append(packed(LINK, x["node"][a + 1 : e], np.full(e - a - 1, x["node"][a])))
                keep[a + 1 : e] = False
                x["whole"][a] = 1
        yield from told(found)
        x = x[keep]
        yield from dealt(x, (mix64(x["key"]) % np.uint64(nb)).astype(np.int64), 0)

    def told(found):
        if found:
            x = np.concatenate(found)
            x = _stars(x["u"], x["v"])
            yield from dealt(x, (mix64(x["u"]) % np.uint64(nb)).astype(np.int64), 1)

    @lean
    def meet(batches):
        got = gathered(batches, {0: POST, 1: LINK})
        x = got[0]
        order, begin, end = _lists(x["key"], x["node"])
        found = [got[1]]
        node, low, whole = x["node"][order], x["low"], x["whole"]
        for a, e in zip(begin.tolist(), end.tolist()):
            own = order[a:e]
            links = _alike(low[own], whole[own])
            if links:
                i, j = np.array(links).T
                found.append(packed(LINK, node[a + i], node[a + j]))
        yield from told(found)

    @lean
    def rows(batches):
        for b in batches:
            for x in b.column("blob").to_pylist():
                x = np.frombuffer(x, LINK)
                for i in range(0, len(x), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x["u"][i : i + 50_000]), pa.array(x["v"][i : i + 50_000])], ["u", "v"])

    met = nodes.select("node", "sig").mapInArrow(post, BLOBS).repartition(partitions(spark), "bucket").mapInArrow(meet, BLOBS)
    return met.mapInArrow(rows, "u long, v long").distinct()


def _confirmed(node: np.ndarray, sig: np.ndarray, sets: list[bytes], half: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Links, as stars, that connect the nodes of one or two blocks (half: 0 or 1; with two, only pairs across are
    looked at). Nodes of one part are connected already."""
    n = len(node)
    arrays = [np.frombuffer(s, np.uint64) for s in sets]
    size = np.array([len(a) for a in arrays])
    flat = np.concatenate(arrays)
    number = np.unique(flat, return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(size)])
    mask: list[int | None] = [None] * n

    def bits(i: int) -> int:
        if mask[i] is None:
            own = number[ends[i] : ends[i + 1]]
            x = np.zeros(int(own.max()) + 1, np.uint8)
            x[own] = 1
            mask[i] = int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
        return mask[i]

    root = np.unique(part, return_index=True)[1][np.unique(part, return_inverse=True)[1]].tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    two = half.any() and not half.all()
    for i in range(n):
        rest = np.flatnonzero(half[i + 1 :] != half[i]) + i + 1 if two else np.arange(i + 1, n)
        if not len(rest):
            continue
        low, high = np.minimum(size[rest], size[i]), np.maximum(size[rest], size[i])
        rest = rest[100 * low >= 75 * high]
        same = (sig[rest] == sig[i]).sum(1)
        order = np.argsort(-same, kind="stable")
        for j, s in zip(rest[order].tolist(), same[order].tolist()):
            if s < MATCH:
                break
            a, b = find(i), find(j)
            if a == b:
                continue
            both = (bits(i) & bits(j)).bit_count()
            if 100 * both >= 75 * (int(size[i]) + int(size[j]) - both):
                root[max(a, b)] = min(a, b)
    return [(int(node[i]), int(node[r])) for i in range(n) if (r := find(i)) != i]


def _wanted(rows: DataFrame) -> np.ndarray:
    """A bitmap of the documents of rows (column doc), of a fixed size."""

    @lean
    def mark(batches):
        places = np.zeros(0, np.int64)
        for b in batches:
            new = (mix64(b.column("doc").fill_null(0).to_numpy()) % np.uint64(WANTED_BITS)).astype(np.int64)
            places = np.concatenate([places, new])
            if len(places) > HELD:
                yield from slices_of(places, WANTED_BITS)
                places = np.zeros(0, np.int64)
        yield from slices_of(places, WANTED_BITS)

    return bitmap(rows.select("doc").mapInArrow(mark, BLOBS), WANTED_BITS)


def clustered(docs: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """root, node, members, sig, shingles (the full set) of the nodes (node, doc, sig) of clusters (node, root) of two or more."""
    spark = docs.sparkSession
    sizes = clusters.groupBy("root").agg(F.count("*").alias("members")).where("members > 1")
    wanted = kept(clusters.select("node", "root", salt()).join(salted(sizes), ["root", "salt"]).drop("salt").join(nodes.select("node", "doc", "sig"), "node"), "clusters")
    shared = spark.sparkContext.broadcast(_wanted(wanted))

    @lean
    def fetch(batches):
        words = Words()
        for b in batches:
            ids = b.column("doc_id").fill_null(0).to_numpy()
            cell = (mix64(ids) % np.uint64(WANTED_BITS)).astype(np.int64)
            keep = np.flatnonzero(shared.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
            if not len(keep):
                continue
            b = b.take(pa.array(keep))
            for i, j, data, off in pieces(b):
                raw = data.tobytes()
                sets = [shingles(raw[a:e], words) for a, e in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "got", "shingles"])

    sets = id_text(docs).mapInArrow(fetch, "doc_id long, got long, shingles binary")
    return wanted.join(sets, (F.col("doc").eqNullSafe(F.col("doc_id"))) & (F.col("node") == F.col("got"))).select("root", "node", "members", "sig", "shingles")


def _matched(rows: pa.Table) -> pa.Table:
    """u, v: links that _confirmed finds among rows (node, sig, shingles; maybe half and part); a node that repeated rows have comes once."""
    names = rows.column_names
    half = rows.column("half").to_numpy() if "half" in names else np.zeros(len(rows), np.int32)
    _, one = np.unique(np.rec.fromarrays([rows.column("node").to_numpy(), half]), return_index=True)
    rows, half = rows.take(pa.array(one)), half[one]
    node = rows.column("node").to_numpy()
    got = _confirmed(node, _matrix(rows.column("sig")), rows.column("shingles").to_pylist(), half, rows.column("part").to_numpy() if "part" in names else node)
    got = [x for x in got if x[0] != x[1]]
    return pa.table({"u": pa.array([x[0] for x in got], pa.int64()), "v": pa.array([x[1] for x in got], pa.int64())})


def _side_by_side(large: DataFrame) -> DataFrame:
    """u, v: links among each BLOCK rows that follow each other within a cluster, in the order of each of PASSES coordinates of
    the signature: copies that are near stand together, whatever the size of the cluster."""

    @lean
    def walk(batches):
        held: list[pa.RecordBatch] = []

        def found():
            rows = pa.Table.from_batches(held)
            held.clear()
            root, at = rows.column("root").to_numpy(), rows.column("pass").to_numpy()
            cut = np.flatnonzero((root[1:] != root[:-1]) | (at[1:] != at[:-1])) + 1
            for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(root)]):
                if e - a > 1:
                    yield from _matched(rows.slice(a, e - a)).to_batches()

        for b in batches:
            for i in range(0, len(b), BLOCK):
                held.append(b.slice(i, BLOCK))
                if sum(map(len, held)) >= BLOCK:
                    yield from found()
        if held:
            yield from found()

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("pass"), F.substring("sig", 4 * c + 1, 4).alias("value")) for c in PASSES])).alias("x")
    rows = large.select("root", "node", "sig", "shingles", each).select("x.*", "root", "node", "sig", "shingles")
    order = ["pass", "root", "value", "node"]
    return rows.repartitionByRange(partitions(large.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(walk, "u long, v long")


def _beyond(open_: DataFrame) -> DataFrame:
    """u, v: links between parts of clusters (root, node, part, blocks, sig, shingles) that are still apart.

    A node outside its cluster's largest part visits the blocks that hold a node of another part with which it shares one of
    its first shingles (as many as a set of similarity 0.75 cannot miss all of), in one order of all shingles, rarest
    first. So nodes whose common part is what all share, and is too little, visit nobody.
    """
    spark = open_.sparkSession
    often = spark.sparkContext.broadcast(_sketch(open_.select("shingles"), lambda b: np.frombuffer(b"".join(b.column("shingles").to_pylist()), np.uint64)))

    @lean
    def post(batches):
        for b in batches:
            for root, node, part, block, s in zip(*(b.column(c).to_pylist() for c in ("root", "node", "part", "block", "shingles"))):
                s = np.frombuffer(s, np.uint64)
                first = len(s) - (75 * len(s) + 99) // 100 + 1
                rank = (often.value[(s & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))
                own = s[np.lexsort((s, rank))[:first]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x)) for x in (root, node, part, block)] + [pa.array(own)], ["root", "node", "part", "block", "shingle"])

    block = F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")
    rows = kept(open_.select("root", "node", "part", block, "sig", "shingles"), "open")
    posts = kept(rows.select("root", "node", "part", F.col("block").cast("long").alias("block"), "shingles").mapInArrow(post, "root long, node long, part long, block long, shingle long"), "posts")
    largest = rows.groupBy("root", "part").count().groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    hosts = posts.groupBy("root", "shingle", "block").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    callers = posts.join(largest, "root").where("part != main").select("root", "shingle", "node", "part")
    visits = kept(callers.join(hosts, ["root", "shingle"]).where("low != part OR high != part").select("root", "node", F.col("block").cast("int").alias("block")).distinct(), "visits")
    chunks = kept(visits.groupBy("root", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")), "chunks")
    row = ["root", "node", "part", "sig", "shingles"]
    at_home = rows.join(chunks, ["root", "block"]).select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("half"), *row)
    calling = visits.join(chunks, ["root", "block"]).join(rows.drop("block"), ["root", "node"]).select("block", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), F.lit(1).alias("half"), *row)
    return at_home.unionByName(calling).groupBy("root", "block", "chunk").applyInArrow(_matched, "u long, v long")


def confirmed(docs: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """u, v: links between nodes confirmed on full sets, enough to connect all that are linked within each cluster.

    A cluster of at most BLOCK nodes is one group. In a larger one, rows that stand side by side in the order of each of
    PASSES coordinates are looked at first; what is still apart then meets by its rarest shingles (_beyond)."""
    full = kept(clustered(docs, nodes, clusters), "sets")
    small = full.where(F.col("members") <= BLOCK).groupBy("root").applyInArrow(_matched, "u long, v long")
    large = full.where(F.col("members") > BLOCK)
    if not large.limit(1).count():
        return small
    beside = kept(_side_by_side(large), "beside")
    joined = components(beside).withColumnRenamed("root", "part")
    where = kept(large.select("root", "node").distinct().join(joined, "node", "left").select("root", "node", F.coalesce("part", "node").alias("part")), "parts")
    apart = where.groupBy("root").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("root")
    rest = where.join(apart, "root", "left_semi")
    if not rest.limit(1).count():
        return small.unionByName(beside)
    open_ = large.join(rest, ["root", "node"]).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).dropDuplicates(["node"])
    return small.unionByName(beside).unionByName(_beyond(open_))


def salted(few: DataFrame) -> DataFrame:
    """A row for each of SALTS salts, to meet many rows with the same root in several tasks."""
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt() -> Column:
    return F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, root (null where there are no words) and component_id of every row."""
    rows = kept(signatures(docs), "signatures")
    nodes = kept(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig")), "nodes")
    clusters = components(links(nodes))
    found = components(confirmed(docs, nodes, clusters))
    roots = nodes.select("node", "doc").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    labelled = roots.select("node", "root", salt()).join(salted(label), ["root", "salt"]).select("node", "root", "component_id")
    out = rows.drop("sig").join(labelled, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "root", component.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
