"""Mixing against its SQL and a plain version, and on odd tables."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

pytest.importorskip("fieldmesh.llm")
from fieldmesh.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, source string"


def brute(rows):
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    order = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in order}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(size)
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += unit * weight[s]
        above = {s for s in open_ if target[s] >= 2 * total[s]}
        left = sum(target[s] - 2 * total[s] for s in above)
        for s in above:
            target[s] = 2.0 * total[s]
        open_ -= above
    key = [hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).digest() for i, t, _ in rows]
    taken = [0] * len(rows)
    for s in order:
        mine = sorted((k for k in range(len(rows)) if rows[k][2] == s), key=lambda k: (key[k], size[k]))
        left = int(target[s] + 1e-6)
        while left > 0:
            for k in mine:
                take = min(left, size[k])
                taken[k] += take
                left -= take
    return sorted(((i, n, total[s], round(target[s], 4), t) for (i, _, s), n, t in zip(rows, size, taken)), key=repr)


def plain(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4), r["taken"]) for r in df.collect()), key=repr)


def table(seed, sources):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(int(rng.expovariate(0.02)))), rng.choice(sources) if rng.random() < 0.6 else sources[0]) for i in range(400)]
    return rows + [(900, None, "b"), (901, "", None), (902, " \t\n\x0b", "only blanks"), (903, "a\x0bb\x1cc d  e", "é"), (904, "x", "é"), (None, "no id", "a"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]


@pytest.mark.parametrize("seed,sources", [(1, ["a", "b", "c", None]), (2, ["zz", "a", "", "é", "B", "日", "😀", "￿"]), (3, [f"s{i}" for i in range(90)])])
def test_mix(spark, monkeypatch, seed, sources):
    monkeypatch.setattr(mixing, "BUCKET", 20)
    rows = table(seed, sources)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("size", "key", "bucket", "name", "place", "target", "part")}).repartition(3)
    got = plain(mixing.mix(df))
    assert got == brute(rows)
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841  DuckDB reads it by name
    names = ["doc_id", "size", "source_size", "target", "taken"]
    sql = sorted(((*x[:3], round(x[3], 4), x[4]) for x in duckdb.sql(f"SELECT {', '.join(names)} FROM ({mixing.ORACLE})").fetchall()), key=repr)
    assert sql == got


def test_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert plain(mixing.mix(spark.createDataFrame([(1, None, None), (1, " ", "a")], SCHEMA))) == [(1, 0, 0, 0.0, 0)] * 2
    rows = [(1, "w " * 300_000, "a"), (2, "w", "b")]
    assert plain(mixing.mix(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
