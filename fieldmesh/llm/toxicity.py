"""Toxicity by weak supervision.

Voters look at a text: a fixed list of insults, word and word-beginning lists taken from labelled rows, and
patterns (shouting, runs of exclamation marks, insults in the second person). A generative label model holds, for
either class, how often each voter fires (its accuracy) and how voters hang together (a Chow-Liu tree over their
correlations), fitted by expectation-maximisation. Its posterior labels train a linear classifier over what the
lists and patterns find; that classifier scores every whole text.

Given labels are one more voter: how often it is right is estimated with the others, and rows that lack a label are
judged by the rest. Words are learned from one half of the labelled training rows (by hash), so that the label model
sees voters' true accuracies on the other. The classifier sees entries, patterns and voters, so a listed insult that no
training row has gets its list's weight. All of it takes a bounded sample of labelled rows, and counts over the whole of
it; labels of held-out rows are never read, and of near copies one is learned from.

Null texts are empty texts and get the score that goes with no findings; repeated rows give repeated rows, and of rows
that share a doc_id learning takes one text; an empty table gives an empty table; a doc_id with two different labels
counts as each of them once and has none in the label model; without labels the fixed list and the patterns alone vote.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, dropped, fold_column, id_text, kept, lean, one_each, texts_of

# Common insults of English.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb", "jerk", "filth", "vermin", "bastard"]
PATTERNS = [r"!{3,}", r"\b[A-Z]{5,}(?:\s+[A-Z]{3,}){2,}", r"(?i)\b(?:you|u)\s+(?:are|r)\s+(?:an?|so|such)\b", r"(?i)\b(?:shut up|go to hell|hate you|kill yourself)\b"]
#: Labelled documents that learning takes at most (those first by a hash of their id).
TRAIN_ROWS = 12_000
#: The chance up to which an entry of a learned list may be one by accident, before the other half of the rows is asked.
CHANCE = 0.005
STEMS = (4, 5, 6)
GROUPS = 4
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def entries_of(text: str) -> set[str]:
    """Words ('w:') and word beginnings ('4:', '5:', '6:') of a text."""
    words = set(WORD.findall(text.lower()))
    return {f"w:{w}" for w in words if len(w) > 2} | {f"{n}:{w[:n]}" for w in words for n in STEMS if len(w) >= n}


class Finder:
    """Finds list entries and patterns in texts."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.size = len(entries) + len(PATTERNS)
        self.patterns = [re.compile(p) for p in PATTERNS]
        self.auto = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, e in enumerate(entries):
            by.setdefault(e[2:], []).append(i)
        for s, ids in by.items():
            self.auto.add_word(s, (len(s), [i for i in ids if entries[i][0] == "w"], [i for i in ids if entries[i][0] != "w"]))
        if by:
            self.auto.make_automaton()

    def find(self, text: str) -> list[int]:
        """The numbers of the entries that occur; patterns come after the entries."""
        low, got = text.lower(), set()
        if self.entries:
            for end, (n, words, stems) in self.auto.iter(low):
                at = end - n
                if at >= 0 and (low[at].isalpha()):
                    continue
                got.update(stems)
                if words and not (end + 1 < len(low) and low[end + 1].isalpha()):
                    got.update(words)
        got.update(len(self.entries) + k for k, p in enumerate(self.patterns) if p.search(text))
        return sorted(got)


def voters(entries: list[str], kinds: list[str]) -> tuple[np.ndarray, int]:
    """The voter that each entry and pattern belongs to: the fixed list, GROUPS of word lists, one list for each
    length of stem and half, each pattern."""
    out = []
    for e, kind in zip(entries, kinds):
        half = crc_fold(None, 1) if kind == "fixed" else sum(e[2:].encode()) % 2
        out.append(0 if kind == "fixed" else 1 + sum(e.encode()) % GROUPS if e[0] == "w" else 1 + GROUPS + 2 * STEMS.index(int(e[0])) + half)
    n = 1 + GROUPS + 2 * len(STEMS)
    return np.array([*out, *range(n, n + len(PATTERNS))], int), n + len(PATTERNS)


def label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """P(class 1) of each row from its votes (rows x voters, 0/1). known: 1, 0 or -1 where no label is given. Within a
    class, voters follow a tree of their strongest correlations; the labels' own accuracy is estimated beside them."""
    n, m = votes.shape
    given = known >= 0
    start = 1.5 * votes.sum(1) - 2.5 + 1.5 * given * (2 * known - 1)
    q = 1 / (1 + np.exp(-start))
    model: dict = {}
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        logit = np.full(n, np.log(prior / (1 - prior)))
        # how often a given label is 1 in either class, as if two more rows of each had agreed with it in 9 of 10 cases
        says = [np.clip((w[given & (known == 1)].sum() + 2 * hit) / (w[given].sum() + 2), 1e-3, 1 - 1e-3) for w, hit in ((1 - q, 0.1), (q, 0.9))]
        logit += np.where(known == 1, np.log(says[1] / says[0]), np.where(known == 0, np.log((1 - says[1]) / (1 - says[0])), 0))
        mutual, tables = np.zeros((m, m)), []
        for y in (0, 1):
            w = q if y else 1 - q
            both = (votes * w[:, None]).T @ votes + 0.25  # P(a and b | y), smoothed
            one = (votes * w[:, None]).sum(0) + 0.5
            total = w.sum() + 1
            p11, p1 = both / total, one / total
            for a, pa_ in ((1, p1), (0, 1 - p1)):
                for b, pb in ((1, p1), (0, 1 - p1)):
                    joint = np.clip(p11 if a and b else p1[:, None] - p11 if a else p1[None] - p11 if b else 1 - p1[:, None] - p1[None] + p11, 1e-9, 1)
                    mutual += total / n * joint * np.log(joint / np.clip(pa_[:, None] * pb[None], 1e-12, 1))
            tables.append((p1, p11))
        parent, best = np.full(m, -1), np.full(m, -np.inf)
        inside = np.zeros(m, bool)
        for _k in range(m):  # Prim
            j = int(np.where(inside, -np.inf, best).argmax()) if _k else 0
            inside[j] = True
            better = ~inside & (mutual[j] > best)
            best[better], parent[better] = mutual[j][better], j
        for y, (p1, p11) in enumerate(tables):
            sign = 1 if y else -1
            for j in range(m):
                v = votes[:, j]
                if parent[j] < 0:
                    p = np.where(v, p1[j], 1 - p1[j])
                else:
                    k = parent[j]
                    on = np.clip(p11[j, k] / p1[k], 1e-3, 1 - 1e-3)
                    off = np.clip((p1[j] - p11[j, k]) / np.maximum(1 - p1[k], 1e-9), 1e-3, 1 - 1e-3)
                    one = np.where(votes[:, k], on, off)
                    p = np.where(v, one, 1 - one)
                logit += sign * np.log(np.clip(p, 1e-6, 1))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        model = {"prior": prior, "fires": [t[0] for t in tables], "parent": parent, "labels": says}
        if np.abs(new - q).max() < 1e-4:
            q = new
            break
        q = new
    return q, model


def linear(rows: list[list[int]], target: np.ndarray, size: int, l2: float = 5e-5, steps: int = 600, rate: float = 0.1) -> np.ndarray:
    """Logistic regression on sparse 0/1 findings and soft labels; the last weight is the bias."""
    flat = np.array([k for r in rows for k in r], int)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w = np.zeros(size + 1)
    w[size] = np.log(np.clip(target.mean(), 1e-3, 1 - 1e-3) / np.clip(1 - target.mean(), 1e-3, 1)) if len(target) else -3
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1 if len(rows) else 1):
        z = np.bincount(row, w[flat], len(rows)) + w[size]
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(flat, d[row], size) / len(rows), d.mean()) + l2 * np.append(w[:size], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sampled(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """doc_id, text, low, high (least and largest label) of the labelled documents that learning takes."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_column(5) != 0))
    chosen = given.groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # near copies mostly share the least hashes of their word pairs: one of them is learned from, so that what a copied text says counts once
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    words = F.array_sort(F.array_distinct(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.xxhash64(a, b))))
    rows = one_each(id_text(docs), chosen).withColumn("like", F.slice(words, 1, 2))
    return kept(rows.groupBy("like", "low", "high").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("x")).select("x.doc_id", "x.text", "low", "high"), "labelled")


def lists(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Entries and their kinds: the fixed list, and what is eight times as frequent in toxic rows as in others, and not by chance."""

    @lean
    def count(batches):
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for i, t, low, high in zip(b.column("doc_id").to_pylist(), texts_of(b), b.column("low").to_pylist(), b.column("high").to_pylist()):
                if crc_fold(i, 2) == 0:
                    for y in {low, high}:
                        n[y].update(entries_of(t))
                        n[y][""] += 1  # rows
        seen = sorted(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([n[1][e] for e in seen], pa.int64()), pa.array([n[0][e] for e in seen], pa.int64())], ["e", "t", "c"])

    parts = kept(sample.mapInArrow(count, "e string, t long, c long").groupBy("e").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "entries")
    totals = parts.where("e = ''").collect()
    nt, nc = (totals[0]["t"], totals[0]["c"]) if totals else (0, 0)
    fixed = [f"w:{w}" for w in INSULTS]
    learned = []
    if nt and nc:
        # Chernoff's bound on seeing an entry in so many toxic rows by chance
        share, toxic = F.col("t") / (F.col("t") + F.col("c")), nt / (nt + nc)
        clean = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - toxic))).otherwise(0.0)
        sure = (F.col("t") + F.col("c")) * (share * F.log(share / toxic) + clean) > -math.log(CHANCE)
        learned = sorted(r["e"] for r in parts.where((F.col("e") != "") & (F.col("t") > 0)).where((F.col("t") / nt > 8 * F.col("c") / nc) & sure).select("e").collect())  # bounded by the sample's words
    dropped(sample.sparkSession, parts)
    learned = [e for e in learned if e not in fixed]
    return fixed + learned, ["fixed"] * len(fixed) + ["learned"] * len(learned)


def features(found: list[int], voter: np.ndarray, size: int) -> list[int]:
    """Findings, and the voters they make fire as findings from size on."""
    return [*found, *{size + int(v) for v in voter[found]}]


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Lists and weights from a bounded sample of labelled rows that are not held out."""
    spark = docs.sparkSession
    sample = sampled(docs, labels, train_rows)
    entries, kinds = lists(sample)
    finder = Finder(entries)
    used = spark.sparkContext.broadcast(entries)

    @lean
    def findings(batches):
        f = Finder(used.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("low"), b.column("high"), pa.array([f.find(t) for t in texts_of(b)], pa.list_(pa.int32()))], ["doc_id", "low", "high", "found"])

    got = sample.mapInArrow(findings, "doc_id long, low int, high int, found array<int>").toPandas().sort_values("doc_id")
    dropped(spark, sample)
    rows = [list(map(int, r)) for r in got["found"]]
    y = np.where(got["low"] == got["high"], got["low"], -1).astype(int)
    # learned entries stay if the rows they were not learned from bear them out
    apart = np.array([crc_fold(int(i), 2) for i in got["doc_id"]], int)
    fires, clean = np.zeros(finder.size), np.zeros(finder.size)
    for r, k, a in zip(rows, y, apart):
        if k >= 0 and a:
            (fires if k else clean)[r] += 1
    good = (fires >= 1) & (fires >= 2 * clean)
    good[: len(INSULTS)] |= fires[: len(INSULTS)] + clean[: len(INSULTS)] < 3
    good[len(entries) :] = True
    rows = [[k for k in r if good[k]] for r in rows]
    voter, m = voters(entries, kinds)
    votes = np.zeros((len(rows), m))
    for k, r in enumerate(rows):
        votes[k, voter[r]] = 1
    model: dict = {}
    if rows:
        q, model = label_model(votes, np.where(apart == 1, y, -1))
        w = linear([features(r, voter, finder.size) for r in rows], q, finder.size + m)
    else:  # the fixed list decides
        w = np.zeros(finder.size + m + 1)
        w[[finder.size, -1]] = 5.0, -3.0
    keep = np.flatnonzero(good[: len(entries)])
    return {"entries": [entries[k] for k in keep], "weights": np.concatenate([w[keep], w[len(entries) : -1]]), "voter": np.concatenate([voter[keep], voter[len(entries) :]]), "bias": float(w[-1]), "label_model": model}


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, train_rows))

    @lean
    def run(batches):
        model = shared.value
        f, w = Finder(model["entries"]), model["weights"]
        for b in batches:
            z = np.array([model["bias"] + w[features(f.find(t), model["voter"], f.size)].sum() for t in texts_of(b)])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array([crc_fold(i, 5) == 0 for i in ids.to_pylist()], pa.bool_()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return id_text(docs).mapInArrow(run, SCHEMA)
