"""Spelling variants: words at one edit from each other, found by a self-join of the vocabulary's trie.

Runs are `[A-Za-z\\u00C0-\\u00FF]+` of whole texts with A-Z lower-cased; a run whose key crc32("<doc_id>:<run>") is a
multiple of SLIP loses one letter (a stated slip, so that variants occur). Words have LEAST_LENGTH letters and
LEAST_COUNT occurrences at least.

The trie is cut by prefix: a prefix that more than PART words begin with is cut a letter deeper, up to DEEPEST (words
that share so long a beginning stay together, however many they are). A task holds one subtrie and walks down it level
by level with each node's active nodes, those at a distance of at most one. Distance nought is the node itself; at distance one
are its siblings, its parent, and whatever equal letters lead to from such a pair: after the edit is spent an active
node follows one path. Ends of words that are active for each other are neighbours. Only the present level is held,
as arrays. Where the edit is spent above the cut, the two words lie in different subtries and the one path left is an equality of
all other letters: words meet under "this letter left open" and under "this letter left out", for the letters above the
cut alone. So every pair comes up once: below the cut in its subtrie, above it by its first differing letter.

A word under "left open" meets as many words as the alphabet has letters, so no pair of a group is written out there:
counts and the two largest serve. In subtries a task keeps a count and the largest neighbour for each word.

Null and empty texts have no words, a null doc_id counts as the empty text in a run's key, repeated rows count again, ties
of the largest neighbour go to the smaller word, an empty table gives an empty table, and columns other than doc_id and
text are left behind. Texts are read whole, a portion at a time; counts leave a task when it holds COUNTED words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, kept, lean

LEAST_LENGTH, LEAST_COUNT, SLIP, TIMES = 7, 2, 31, 10
#: Words of a subtrie, and letters that a cut may lie below the root.
PART, DEEPEST = 50_000, 32
#: Words that a task counts before it passes them on.
COUNTED = 400_000
#: Prefixes that may be cut deeper; beyond that many, subtries grow instead (twice as many words each).
CUTS = 100_000
NEAR = "word string, n_near long, rank struct<less:long,near:string>"

_run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)


def slipped(doc_id: int | None, text: str) -> Counter:
    """The words of a text, as latin-1 bytes, with their occurrences; shorter ones are left out."""
    runs = Counter(_run.findall(text.encode("latin-1", "replace").lower()))  # letters beyond latin-1 end a run, as "?" does
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    out = Counter()
    for run, n in runs.items():
        key = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if key % SLIP == 0:
            at = key % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of words with enough occurrences."""

    @lean
    def count(batches):
        held: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = text.as_py()
                if text:
                    held.update(slipped(doc, text))
                if len(held) > COUNTED:
                    yield from rows(held)
                    held = Counter()
        yield from rows(held)

    def rows(held):
        words, counts = [*held], [*held.values()]
        for i in range(0, len(words), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words[i : i + 20_000]]), pa.array(counts[i : i + 20_000], pa.int64())], ["word", "n"])

    found = id_text(docs).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def cuts(words: DataFrame, part: int | None = None) -> set[str]:
    """Prefixes that too many words begin with, level by level (CUTS at most). The root always is one."""
    part = part or PART
    out, last = {""}, [""]
    for depth in range(1, DEEPEST):
        begins = words.where(F.length("word") >= depth).select(F.substring("word", 1, depth).alias("p"))
        if depth > 1:  # only what lies below a prefix that is cut can need a cut
            above = words.sparkSession.createDataFrame([(x,) for x in last], "above string")
            begins = begins.join(F.broadcast(above), F.expr(f"substring(p, 1, {depth - 1})") == F.col("above"), "left_semi")
        last = [r["p"] for r in begins.groupBy("p").count().where(F.col("count") > part).limit(CUTS + 1).collect()]
        if len(last) + len(out) > CUTS:
            return cuts(words, 2 * part)
        if not last:
            break
        out.update(last)
    return out


def depth_of(word: str, cut: set[str]) -> int:
    """Letters from the root to where a word's subtrie begins."""
    d = 1
    while d < DEEPEST and d <= len(word) and word[:d] in cut:
        d += 1
    return d


class Level:
    """The nodes of one depth of a trie over sorted words: parent and letter of each, the word that ends there (or -1)."""

    def __init__(self, parent: np.ndarray, letter: np.ndarray, ends: np.ndarray):
        self.key = parent * 256 + letter  # ascending
        self.ends = ends
        self.size = len(parent)

    def children(self, above: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of each of so many nodes above begin and end."""
        at = np.arange(above, dtype=np.int64) * 256
        return np.searchsorted(self.key, at), np.searchsorted(self.key, at + 256)


def levels(words: list[bytes]):
    """The levels of the trie over distinct words in ascending order, from the root down."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    alive, node, depth = np.arange(len(words)), np.zeros(len(words), np.int64), 0
    while len(alive):
        letter = flat[start[alive] + depth]
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])])
        parent, letter = node[new], letter[new]
        node = np.cumsum(new) - 1
        depth += 1
        done = size[alive] == depth
        ends = np.full(len(parent), -1)
        ends[node[done]] = alive[done]
        yield Level(parent, letter, ends)
        alive, node = alive[~done], node[~done]


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the number of each range, as often as it has members, and the members."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def _follow(u: np.ndarray, v: np.ndarray, below_u: Level, size_u: int, below_v: Level) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children by equal letters of pairs of nodes."""
    begin, end = below_u.children(size_u)
    which, child = _spread(begin[u], end[u])
    want = v[which] * 256 + below_u.key[child] % 256
    at = np.searchsorted(below_v.key, want)
    found = np.flatnonzero(np.append(below_v.key, -1)[at] == want)
    return child[found], at[found]


def neighbours(words: list[bytes]):
    """Pairs (i, j) of distinct words, in ascending order, that differ by exactly one letter more, less or other, as arrays, level by level."""
    same = (np.zeros(0, np.int64),) * 2  # pairs of nodes of one depth that are active for each other
    longer = None  # pairs of a node and an active node one level down
    walk = levels(words)
    here = Level(np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1))  # the root
    below = next(walk, None)
    while below is not None:
        after = next(walk, None)
        # children of `here` are `below`, theirs are `after`
        begin, end = below.children(here.size)
        fresh_parent = below.key // 256
        apart = _follow(*same, below, here.size, below)
        which, child = _spread(np.arange(below.size) + 1, end[fresh_parent])  # later siblings
        same = np.concatenate([apart[0], which]), np.concatenate([apart[1], child])
        step = (fresh_parent, np.arange(below.size))  # (parent, child) pairs: here against below
        if longer is not None:
            step = np.concatenate([longer[0], step[0]]), np.concatenate([longer[1], step[1]])
            step = np.divmod(np.unique(step[0] * below.size + step[1]), below.size)
        a, b = here.ends[step[0]], below.ends[step[1]]
        both = (a >= 0) & (b >= 0)
        yield a[both], b[both]
        a, b = below.ends[same[0]], below.ends[same[1]]
        both = (a >= 0) & (b >= 0)
        yield a[both], b[both]
        if after is None:
            break
        longer = _follow(step[0], step[1], below, here.size, after)
        here, below = below, after


def _best(i: np.ndarray, j: np.ndarray, n: np.ndarray, count: np.ndarray, best: np.ndarray) -> None:
    """Counts j as a neighbour of i, and keeps the neighbour of largest n (ties: the smaller number, as words ascend)."""
    np.add.at(count, i, 1)
    order = np.lexsort((j, -n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
    i, j = i[first], j[first]
    old = best[i]
    better = (old < 0) | (n[j] > n[old]) | ((n[j] == n[old]) & (j < old))
    best[i[better]] = j[better]


def _subtries(parts: DataFrame) -> DataFrame:
    """word, n_near, rank within each subtrie (columns cut, word, n)."""

    def walk(group: pa.Table) -> pa.Table:
        order = np.argsort(words := np.array([w.encode("latin-1") for w in group.column("word").to_pylist()], object))
        words, n = words[order].tolist(), group.column("n").to_numpy()[order]
        count, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
        for i, j in neighbours(words):
            _best(np.concatenate([i, j]), np.concatenate([j, i]), n, count, best)
        has = np.flatnonzero(count)
        rank = pa.StructArray.from_arrays([pa.array(-n[best[has]]), pa.array([words[k].decode("latin-1") for k in best[has]], pa.string())], ["less", "near"])
        return pa.table({"word": pa.array([words[k].decode("latin-1") for k in has], pa.string()), "n_near": pa.array(count[has]), "rank": rank})

    return parts.groupBy("cut").applyInArrow(walk, NEAR)


def _across(words: DataFrame) -> DataFrame:
    """word, n_near, rank of pairs whose first differing letter lies above the cut (columns word, n, depth)."""
    at = words.withColumn("p", F.explode(F.sequence(F.lit(1), F.least("depth", F.length("word")))))
    head, tail = F.expr("substring(word, 1, p - 1)"), F.expr("substring(word, p + 1)")
    rank = F.struct((-F.col("n")).alias("less"), F.col("word").alias("near"))
    # one letter left open: all words of a key are neighbours, as many as there are letters
    open_key = Window.partitionBy("p", "key")
    by = open_key.orderBy(F.desc("n"), "word")
    met = at.select("word", "n", "p", F.concat(head, F.lit("*"), tail).alias("key"))
    met = met.select("word", F.count("*").over(open_key).alias("m"), F.row_number().over(by).alias("k"), *[F.nth_value(rank, i).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"r{i}") for i in (1, 2)])
    other = met.where("m > 1").select("word", (F.col("m") - 1).alias("n_near"), F.when(F.col("k") == 1, F.col("r2")).otherwise(F.col("r1")).alias("rank"))
    # one letter left out: of equal letters in a row the last one stands for all
    last = F.expr("substring(word, p, 1) != substring(word, p + 1, 1)")
    out = at.where(last).select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.concat(head, tail).alias("word"))
    met = out.join(words.select("word", "n"), "word")
    less = met.select("word", F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("long_n")).alias("less"), F.col("long").alias("near")).alias("rank"))
    more = met.select(F.col("long").alias("word"), F.lit(1).cast("long").alias("n_near"), rank.alias("rank"))
    return other.unionByName(less).unionByName(more)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, near, near_n of every word (word, n: distinct words of letters up to U+00FF): its neighbours'
    number and the one of largest n."""
    cut = words.sparkSession.sparkContext.broadcast(cuts(words))

    def place(batches):
        for b in batches:
            got = b.column("word").to_pylist()
            depth = [depth_of(w, cut.value) for w in got]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(depth, pa.int32()), pa.array([w[:d] for w, d in zip(got, depth)], pa.string())], ["word", "n", "depth", "cut"])

    placed = kept(words.select("word", "n").mapInArrow(place, "word string, n long, depth int, cut string"), "subtries")
    found = _subtries(placed.select("cut", "word", "n")).unionByName(_across(placed.select("word", "n", "depth")))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("rank").alias("rank"))
    return words.select("word", "n").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("rank.near").alias("near"), (-F.col("rank.less")).alias("near_n"))


def rooted(words: DataFrame) -> DataFrame:
    """word, form of each word with a form, and root, the end of its chain of forms. Chains are short, as each form has
    TIMES the occurrences; each round doubles the forms passed."""
    forms = kept(words.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = kept(forms.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "forms")
        forms = step.select("word", "root")
        if not step.where("went").limit(1).count():
            return forms


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: form is its neighbour of largest n (ties: the smaller word) if
    that is at least TIMES its own n, root the last of its chain of forms (itself if none)."""
    words = kept(vocabulary(docs), "vocabulary")
    near = near_words(words)
    form = F.col("near_n") >= TIMES * F.col("n")
    near = kept(near.select("word", "n", "n_near", F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")), "near-words")
    return near.join(rooted(near), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
