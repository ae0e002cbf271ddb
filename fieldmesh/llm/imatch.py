"""I-Match document fingerprints over randomised lexicon subsets.

Terms are words `[^ \\t-\\r]+` with A-Z lower-cased. The lexicon holds the terms whose share of documents lies in a
band (equivalently: whose inverse document frequency does). A text's distinct lexicon terms are sorted, and for each
of SUBSETS randomised subsets of the lexicon those of its terms that fall in the subset are hashed together. A text
with fewer than FEW lexicon terms takes all its distinct terms instead.

A subset that is hit by about one term of a text is kept whole by a light edit far oftener than the whole lexicon
is, so subsets are thinned with the number of terms: level L takes one of 2**L parts of the lexicon for each subset,
and a fingerprint holds the three levels around its number of terms. Likeness is the share of subsets with equal
hashes among those that either text hits, at the densest level both have where a quarter of the subsets or more are
hit by neither (else at the sparsest that both have); it estimates the share of terms in common.

Null texts are empty texts; two texts without any term have likeness 1 if equal. The next document of a row is that
with the next smaller doc_id (a null doc_id is the smallest; equal ids go by text, descending), and for the last the
first. Repeated rows count each; an empty table gives an empty table; other columns are left behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOBS, dealt, gathered, id_text, lean, mix64, packed, partitions, summed, texts_of

#: Shares of documents that a lexicon term occurs in; the lower one bounds the lexicon (terms of a document / BAND[0]).
BAND = (5e-4, 0.1)
SUBSETS, FEW = 48, 3
REMEMBERED, HELD = 250_000, 1_500_000
COUNT = np.dtype([("key", "<i8"), ("n", "<i4")])
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Terms(dict):
    """Term to 63-bit hash, remembered."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        x = self[w] = xxhash.xxh3_64_intdigest(w) >> 1
        return x


def terms_of(text: str, terms: Terms) -> np.ndarray:
    """Hashes of the distinct terms, sorted."""
    words = set(text.encode().lower().split())
    return np.sort(np.fromiter(map(terms.__getitem__, words), np.int64, len(words)))


def lexicon(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashes of the terms in the band, sorted, and the number of documents."""
    nb = partitions(docs.sparkSession)

    @lean
    def count(batches):
        terms, parts, held = Terms(), [], 0
        for b in batches:
            for t in texts_of(b):
                parts.append(terms_of(t, terms))
                held += len(parts[-1])
                if held > HELD:
                    yield from pack(parts)
                    parts, held = [], 0
        yield from pack(parts)

    def pack(parts):
        keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        keys, n = summed(keys, np.ones(len(keys), np.int32))
        yield from dealt(packed(COUNT, keys, n), (mix64(keys) % np.uint64(nb * 4)).astype(np.int64))

    total = docs.count()
    low, high = BAND[0] * total, BAND[1] * total

    @lean
    def band(batches):
        x = gathered(batches, {0: COUNT})[0]
        keys, n = summed(x["key"], x["n"].astype(np.int64))
        keys = keys[(n >= low) & (n <= max(high, 1))]
        yield from dealt(packed(COUNT, keys, np.ones(len(keys), np.int32)), np.zeros(len(keys), int))

    found = docs.mapInArrow(count, BLOBS).repartition(nb, "bucket").mapInArrow(band, BLOBS).toArrow()
    return np.sort(gathered(found.to_batches(), {0: COUNT})[0]["key"]), total


def subset_hashes(terms: np.ndarray, level: int) -> np.ndarray:
    """For each subset of a level, the hash of the sorted terms in it; 0 where there are none."""
    parts = 1 << level
    out = np.zeros(SUBSETS, np.uint32)
    done = 0
    for deal in range(-(-SUBSETS // parts)):
        group = (mix64(terms.astype(np.uint64) + np.uint64((level * 64 + deal + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(parts - 1)).astype(np.int64)
        some = group < SUBSETS - done
        own, group = terms[some], group[some]
        order = np.argsort(group, kind="stable")
        own, group = own[order], group[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(group)]):
            out[done + group[a]] = xxhash.xxh32_intdigest(own[a:b].tobytes()) or 1
        done += parts
    return out


Print = dict[int, np.ndarray]


def fingerprint(terms: np.ndarray, lexicon: np.ndarray) -> Print:
    """Subset hashes by level."""
    at = np.minimum(np.searchsorted(lexicon, terms), max(0, len(lexicon) - 1))
    own = terms[lexicon[at] == terms] if len(lexicon) else terms[:0]
    if len(own) < FEW:
        own = terms
    middle = max(2, int(np.ceil(np.log2(max(1, len(own))))))
    return {level: subset_hashes(own, level) for level in (middle - 1, middle, middle + 1)}


def shown(p: Print) -> str:
    return ";".join(f"{level}:" + x.astype(">u4").tobytes().hex() for level, x in sorted(p.items()))


def likeness(p: Print, q: Print) -> float:
    best = 0.0
    for level in sorted(p.keys() & q.keys()):
        a, b = p[level], q[level]
        either = int(((a != 0) | (b != 0)).sum())
        if not either:
            return best if best else float(shown(p) == shown(q))
        best = float(((a == b) & (a != 0)).sum() / either)
        if either <= 0.75 * SUBSETS:
            break
    return best


def edited(text: str, following: str) -> str:
    """text with its last half (floor) replaced by as many characters from the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """The rows in blocks by descending doc_id, each block followed by the row after its last (tail true)."""
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    docs = docs.withColumn("k", key)
    n = partitions(spark)
    cuts = sorted(set(docs.select("k").approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)))
    block = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c < F.col("k"))) if cuts else F.lit(0)
    docs = docs.withColumn("block", block)
    ends = sorted((r["block"], r["high"]) for r in docs.select("block", "k").groupBy("block").agg(F.max("k").alias("high")).collect())  # a row for each block
    if not ends:
        return docs.withColumn("tail", F.lit(False))
    # the first row of a block comes again at the end of the block above, that of the top block at the end of the lowest
    again = [(high, above) for (_, high), (above, _) in zip(ends, [*ends[1:], ends[0]])]
    extra = docs.join(F.broadcast(spark.createDataFrame(again, "k long, above int")), "k").withColumn("block", F.col("above").cast("int")).drop("above").withColumn("tail", F.lit(True))
    return docs.withColumn("tail", F.lit(False)).unionByName(extra)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each document, with the fingerprints of its text and of its edited text and how like they are."""
    spark = docs.sparkSession
    docs = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    words, _ = lexicon(docs.select("text"))
    shared = spark.sparkContext.broadcast(words)
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    @lean
    def run(batches):
        terms, lex = Terms(), shared.value
        before = None  # (block, doc_id, text, fingerprint) of the row above
        rows = []
        for b in batches:
            for block, i, text, tail in zip(*(b.column(c).to_pylist() for c in ("block", "doc_id", "text", "tail"))):
                own = fingerprint(terms_of(text, terms), lex)
                if before is not None and before[0] == block:
                    _, at, above, print_ = before
                    changed = edited(above, text)
                    other = fingerprint(terms_of(changed, terms), lex)
                    rows.append((at, len(above), hashlib.sha256(changed.encode()).hexdigest(), shown(print_), shown(other), likeness(print_, other), likeness(print_, own)))
                before = None if tail else (block, i, text, own)
            yield pack(rows)
            rows = []

    def pack(rows):
        cols = [*zip(*rows)] if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], columns)

    # where a key repeats, its first row by text is the one that follows the block above
    lined = in_order(docs).repartitionByRange(partitions(spark), "block").sortWithinPartitions("block", "tail", F.desc("k"), F.desc("text"))
    return lined.select("block", "doc_id", "text", "tail").mapInArrow(run, SCHEMA)
