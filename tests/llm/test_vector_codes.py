"""Vector code compression against plain Lloyd rounds in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from quire.llm.vector_codes import Codebook, compress_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, __label int"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(float(np.float32(x)) * 256) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) or 1
    kept = [(i, v + [0] * (width * parts - len(v)), k) for i, v, k in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(near(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(z) // len(held[e]) for z in zip(*held[e])] if e in held else old for e, old in enumerate(books[p])]
    out, by = [], {}
    for (i, _, k), c in zip(kept, cut):
        found = [near(p, c[p]) for p in range(parts)]
        d = sum(x for x, _ in found)
        by[k] = by.get(k, 0) + d
        out.append((i, "".join(f"{e:02x}" for _, e in found), d, k))
    digest = hashlib.sha256(",".join(str(z) for b in books for c in b for z in c).encode()).hexdigest()
    return sorted(((i, code, d, by[k], digest) for i, code, d, k in out), key=str)


def rows_of(n, width, seed=5):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(0, 0.2, (n, width)), 1)  # rounding makes ties
    return [(i, [float(x) for x in v[i]], None if i % 7 == 0 else i % 3) for i in range(n)]


@pytest.mark.parametrize("width,n", [(64, 300), (16, 150), (50, 90), (112, 40)])
def test_equals_plain_rounds(spark, width, n):
    rows = rows_of(n, width)
    got = compress_vectors(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_degenerate_vectors(spark):
    rows = rows_of(80, 32)
    rows += [(90, None, 1), (91, [1.0, None], 1), (92, [float("nan")] * 32, 2), (93, [float("inf")] + [0.0] * 31, 2), (None, [0.5] * 32, 1)]
    rows += [(94, [], 1), (95, [0.25] * 20, None), rows[3], rows[3]]
    got = compress_vectors(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    huge = compress_vectors(spark.createDataFrame([(1, [3e38, -3e38], 1, "", "", 1)] * 2, SCHEMA)).collect()
    assert [r["error"] for r in huge] == [0, 0]
    none = compress_vectors(spark.createDataFrame([(1, None, 1, "", "", 1)], SCHEMA))
    assert none.columns == got.columns and none.collect() == []


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (500, 8)) + rng.integers(-4, 5, 500)[:, None] * 300
    entries, tally = x[:64], []
    index, dist = Codebook.of(entries).nearest(x, tally)
    every = ((x[:, None, :] - entries) ** 2).sum(2)
    assert (every.argmin(1) == index).all() and (every.min(1) == dist).all()
    assert tally[0] < 0.25 * every.size


def test_bounds_hold_for_large_components():
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 23), 1 << 23, (200, 48))
    x[100:] = x[:100] + rng.integers(-1, 2, (100, 48))
    every = ((x[:, None, :] - x[:64]) ** 2).sum(2)
    index, dist = Codebook.of(x[:64]).nearest(x)
    assert (every.argmin(1) == index).all() and (every.min(1) == dist).all()
