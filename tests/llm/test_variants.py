"""Spelling variants against a brute-force version, with subtries of several sizes, and on odd tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("fieldmesh.llm")
from fieldmesh.llm import variants  # noqa: E402

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * k else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), k, len(near[w]), n[form[w]] if form[w] is not None else None) for w, k in n.items()}


def table():
    rng = random.Random(7)
    letters = "abAé×ÿz"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(28)] + ["aaaaaaaa", "aaaaaaab", "international", "Internation"]
    rows = []
    for i in range(500):
        words = []
        for _ in range(rng.randrange(0, 60)):
            w = stems[min(rng.randrange(32), rng.randrange(32), rng.randrange(32))]
            while rng.random() < 0.3:
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", rng.choice(letters)]) + w[k + rng.randrange(2) :]
            words.append(w)
        rows.append((i - 5, rng.choice([" ", "-", "\n", "日", "1"]).join(words)))
    return rows + [(500, None), (501, ""), (None, "aaaaaaaa aaaaaaaa aaaaaaaaa"), (3, rows[8][1]), (3, rows[8][1])]


@pytest.mark.parametrize("part", [50_000, 40, 3])
def test_variants_are_exact(spark, monkeypatch, part):
    monkeypatch.setattr(variants, "PART", part)
    monkeypatch.setattr(variants, "COUNTED", 50)
    rows = table()
    got = variants.variants(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert len(want) > 300 and sum(x[0] is not None for x in want.values()) > 20
    found = got.collect()
    assert len(found) == len(want)
    assert {r["word"]: tuple(r)[1:] for r in found} == want


def test_too_many_cuts_make_larger_subtries(spark, monkeypatch):
    monkeypatch.setattr(variants, "CUTS", 4)
    words = spark.createDataFrame([(f"{a}{b}common{c}", 2) for a in "abc" for b in "abc" for c in "abcd"], "word string, n long")
    assert 1 < len(variants.cuts(words, 3)) <= 4


def test_chains_of_forms(spark):
    """n of 2, 20, 200, 2000 and 20000 in a row of single edits: the root is four forms away."""
    words = ["wordaaa", "wordaab", "wordabb", "wordbbb", "worbbbb"]
    df = spark.createDataFrame([(w, words[i + 1] if i < 4 else None) for i, w in enumerate(words)], "word string, form string")
    assert {r["word"]: r["root"] for r in variants.rooted(df).collect()} == dict.fromkeys(words[:4], words[4])


def test_odd_tables(spark):
    long = "verylongword" * 4000 + " " + "shorter " * 20000
    rows = [(1, None), (2, ""), (None, None), (None, "lettersonly lettersonly"), (5, long), (5, long), (6, "日本 123 \x00")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("word", "n", "cut", "depth", "key", "p")})
    got = {r["word"]: r["n"] for r in variants.variants(df).collect()}
    want = {w: x[2] for w, x in brute(rows).items()}
    assert got == want
    assert variants.variants(spark.createDataFrame([], SCHEMA)).count() == 0
