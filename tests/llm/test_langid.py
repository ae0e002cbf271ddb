"""The byte network against plain loops and numerical gradients; its training sample is bounded."""

import math

import numpy as np
import pytest

pytest.importorskip("fieldmesh.llm")
from fieldmesh.llm import langid  # noqa: E402


def start(n_labels, seed=1):
    """The parameters that training starts from."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, langid.DIM)), "bias": np.zeros(langid.FILTERS * len(langid.WIDTHS)), "out": rng.normal(0, 0.1, (langid.FILTERS * len(langid.WIDTHS), n_labels)), "out_bias": np.zeros(n_labels)}
    p |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * langid.DIM), (w * langid.DIM, langid.FILTERS)) for w in langid.WIDTHS}
    p = {k: v.astype(np.float32).astype(float) for k, v in p.items()}
    p["embed"][0] = 0
    return p


def plain(windows, p):
    """Probabilities by loops over windows, widths, filters and places."""
    out = []
    for x in windows:
        e, h = p["embed"][x], []
        for w in langid.WIDTHS:
            for f in range(langid.FILTERS):
                h.append(max(float(e[i : i + w].ravel() @ p[f"f{w}"][:, f]) for i in range(len(x) - w + 1)))
        z = np.maximum(np.array(h) + p["bias"], 0) @ p["out"] + p["out_bias"]
        out.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
    return np.array(out)


def windows():
    rng = np.random.default_rng(5)
    x = rng.integers(1, 256, (4, 24)).astype(np.uint8)
    x[0, 15:] = 0
    return x


def test_forward_is_what_loops_give():
    p = start(3)
    p["bias"] += 0.1
    net = {"embed": p["embed"], "filters": [p[f"f{w}"] for w in langid.WIDTHS], "bias": p["bias"], "out": p["out"], "out_bias": p["out_bias"]}
    assert np.abs(langid.forward(windows(), net) - plain(windows(), p)).max() < 1e-9


def test_first_step_follows_the_gradient():
    """The first step of Adam moves every number by the rate against the sign of its gradient."""
    x, y = windows(), np.array([0, 2, 1, 2])
    got = langid.train(x, y, 3, epochs=1)
    got |= {f"f{w}": f for w, f in zip(langid.WIDTHS, got.pop("filters"))}
    p = start(3)

    def loss():
        return -math.fsum(math.log(q[k]) for q, k in zip(plain(x, p), y)) / len(x)

    rng, checked = np.random.default_rng(2), 0
    for name, value in p.items():
        for _ in range(12):
            at = tuple(rng.integers(n) for n in value.shape)
            if name == "embed":
                at = (int(rng.choice(x[x > 0])), at[1])
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            slope = (up - loss()) / 2e-5
            value[at] = old
            if abs(slope) > 1e-4:
                assert got[name][at] - old == pytest.approx(-0.01 * np.sign(slope), rel=0.02), name
                checked += 1
            elif slope == 0:
                assert got[name][at] == pytest.approx(old)
    assert checked > 20


def test_a_long_document_gives_a_bounded_sample(spark, monkeypatch):
    rows = [(k, f"{w} " * n, w) for k, (w, n) in enumerate([("alpha", 60_000), ("beta", 40), ("alpha", 9), ("beta", 70_000)] * 2)]
    x, y, names = langid.sample_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 1500)
    assert names == ["alpha", "beta"] and len(x) == len(y) <= 8 * langid.TRAIN_WINDOWS and len(x) > langid.TRAIN_WINDOWS
