"""Language identification by a byte convolutional network in numpy.

Every text is cut into windows of a fixed number of bytes (a few bytes overlap, so that no n-gram is lost at a
cut). Byte embeddings go through filters of several widths, each filter keeps its largest response in the window,
and softmax over those gives the window's language; a document's answer is the mean over all its windows,
weighted by their lengths; of languages with equal scores the first by name is taken. The network is trained on a bounded
sample of labelled rows.

Null texts and texts without a letter get lang_pred 'und' and score 0; so do all texts if nothing is labelled.
Repeated rows give repeated rows; an empty table gives an empty table; other columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, fold_column, id_text, lean, one_each, pieces

WINDOW, DIM, FILTERS, WIDTHS = 128, 8, 16, (2, 3, 4, 5)
#: Labelled documents that training takes at most (those first by a hash of their id), and windows of each: of a longer
#: one as many, spread evenly over its whole text. So the sample is bounded in bytes as well.
TRAIN_ROWS, TRAIN_WINDOWS = 1500, 1000
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def responses(e: np.ndarray, filters: list[np.ndarray]) -> list[np.ndarray]:
    """e: windows x bytes x DIM. For each width: windows x positions x FILTERS."""
    n, size, dim = e.shape
    out = []
    for w, f in zip(WIDTHS, filters, strict=True):
        view = np.lib.stride_tricks.as_strided(e, (n, size - w + 1, w * dim), (e.strides[0], e.strides[1], e.strides[2]), writeable=False)
        out.append(view.reshape(-1, w * dim) @ f)
        out[-1] = out[-1].reshape(n, size - w + 1, -1)
    return out


def forward(windows: np.ndarray, net: dict) -> np.ndarray:
    """Probabilities of each window (bytes, 0 where there is no text)."""
    e = net["embed"][windows]
    h = np.concatenate([r.max(1) for r in responses(e, net["filters"])], 1)
    z = np.maximum(h + net["bias"], 0) @ net["out"] + net["out_bias"]
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, n_labels: int, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 1) -> dict:
    """Adam on cross-entropy, with a rate that falls to a twentieth; the gradient of a maximum flows to the place it was taken from."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, DIM)), "bias": np.zeros(FILTERS * len(WIDTHS)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_labels)), "out_bias": np.zeros(n_labels)}
    p |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embed"][0] = 0
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        pace = rate * 20 ** (-epoch / max(1, epochs - 1))
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            x, n = windows[at], len(at)
            e = p["embed"][x]
            rs = responses(e, [p[f"f{w}"] for w in WIDTHS])
            where = [r.argmax(1) for r in rs]
            h = np.concatenate([np.take_along_axis(r, a[:, None], 1)[:, 0] for r, a in zip(rs, where)], 1) + p["bias"]
            a = np.maximum(h, 0)
            z = a @ p["out"] + p["out_bias"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(n), labels[at]] -= 1
            q /= n
            g = {"out": a.T @ q, "out_bias": q.sum(0)}
            dh = (q @ p["out"].T) * (h > 0)
            g["bias"] = dh.sum(0)
            de = np.zeros_like(p["embed"])
            for k, w in enumerate(WIDTHS):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                pos = where[k][:, :, None] + np.arange(w)  # windows x filters x w
                sym = x[np.arange(n)[:, None, None], pos]
                patch = p["embed"][sym].reshape(n, FILTERS, w * DIM)
                g[f"f{w}"] = np.einsum("nfk,nf->kf", patch, d)
                np.add.at(de, sym, (d[:, :, None] * p[f"f{w}"].T).reshape(n, FILTERS, w, DIM))
            de[0] = 0
            g["embed"] = de
            t += 1
            for k, x_ in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x_
                v[k] = 0.999 * v[k] + 0.001 * x_ * x_
                p[k] -= (pace * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return {"embed": p["embed"], "filters": [p[f"f{w}"] for w in WIDTHS], "bias": p["bias"], "out": p["out"], "out_bias": p["out_bias"]}


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a piece, the row each belongs to, and its bytes."""
    step = WINDOW - max(WIDTHS) + 1
    size = np.diff(off)
    many = np.where(size > 0, np.maximum(1, -(-(size - max(WIDTHS) + 1) // step)), 0)
    row = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = off[row] + k * step
    length = np.minimum(off[row + 1] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)] if len(data) else 0, 0).astype(np.uint8), row, length


def sample_windows(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of at most that many labelled documents, and their labels; of rows that share a doc_id one counts."""
    spark = docs.sparkSession
    labelled = id_text(docs, F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold_column(3) != 1))
    chosen = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    @lean
    def run(batches):
        for b in batches:
            ids, langs = b.column("doc_id").to_pylist(), b.column("lang").to_pylist()
            for i, j, data, off in pieces(b):
                win, row, length = cut(data, off)
                at = np.searchsorted(row, np.arange(j - i + 1))
                w_out = []
                for r in range(j - i):
                    use = np.arange(at[r], at[r + 1])
                    if len(use) > TRAIN_WINDOWS:
                        use = use[np.arange(TRAIN_WINDOWS) * len(use) // TRAIN_WINDOWS]
                    rng, own = np.random.default_rng(crc_fold(ids[i + r], 1 << 31)), win[use].copy()
                    for x, size in zip(own, length[use]):
                        if rng.random() < 0.3 and size > 16:  # short texts are learned too
                            n = int(rng.integers(8, size))
                            x[:n], x[n:] = x[size - n : size].copy(), 0
                    w_out.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(w_out, pa.binary()), pa.array(langs[i:j], pa.string())], ["doc_id", "w", "lang"])

    got = one_each(labelled, chosen).mapInArrow(run, "doc_id long, w binary, lang string").toArrow().sort_by("doc_id")  # the same whatever order the rows arrive in
    names = sorted(set(got.column("lang").to_pylist()))
    size = [len(x) // WINDOW for x in got.column("w").to_pylist()]
    w = np.frombuffer(b"".join(got.column("w").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return w, np.repeat([names.index(x) for x in got.column("lang").to_pylist()], size).astype(int), names


def predict(batch: pa.RecordBatch, net: dict | None, names: list[str]) -> tuple[list[str], np.ndarray]:
    """The language and score of each row of a batch with a text column."""
    n = len(batch)
    total, weight = np.zeros((n, max(1, len(names)))), np.zeros(n)
    if net is not None:
        for i, _, data, off in pieces(batch, 1 << 18):
            win, row, length = cut(data, off)
            for k in range(0, len(win), 512):
                p = forward(win[k : k + 512], net)
                np.add.at(total, i + row[k : k + 512], p * length[k : k + 512, None])
                np.add.at(weight, i + row[k : k + 512], length[k : k + 512])
    letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
    ok = letters & (weight > 0)
    best = total.argmax(1)
    score = np.where(ok, total[np.arange(n), best] / np.maximum(weight, 1), 0.0)
    return [names[k] if o else "und" for k, o in zip(best, ok)], np.clip(score, 0, 1)


def trained(docs: DataFrame, train_rows: int = TRAIN_ROWS):
    """The network, broadcast, and the languages it knows."""
    x, y, names = sample_windows(docs, train_rows)
    return docs.sparkSession.sparkContext.broadcast(train(x, y, len(names)) if len(x) else None), names


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    net, names = trained(docs, train_rows)

    @lean
    def run(batches):
        for b in batches:
            lang, score = predict(b, net.value, names)
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array([crc_fold(i, 3) == 1 for i in ids.to_pylist()], pa.bool_()), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return id_text(docs).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, least: float, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows, with all their columns, whose text has a language, with a score of at least least."""
    net, names = trained(docs, train_rows)

    @lean
    def run(batches):
        for b in batches:
            lang, score = predict(b, net.value, names)
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
