"""Vectors with every case: null, zero, non-finite, null components, other dimensions, copies, hot labels."""

import numpy as np

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, score string"


def rows(n=400, dim=16, seed=2):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 8, dim))
    out = []
    for i in range(n):
        v = base[i % len(base)] + r.normal(size=dim) * r.choice([0.02, 0.3, 3.0])
        out.append((i, [float(np.float32(x)) for x in v], [0, 0, 1, 2][i % 4], "x", None))
    out += [(1000 + i, out[7][1], 0, None, None) for i in range(60)] + [(1100, out[7][1], 1, None, None)]
    out += [(2000, None, 0, None, None), (2001, [0.0] * dim, 0, None, None), (2002, [float("nan")] + [1.0] * (dim - 1), 0, None, None)]
    out += [(2003, [None] + [1.0] * (dim - 1), 0, None, None), (2004, [float("inf")] * dim, 0, None, None), (2100, out[3][1], None, None, None)]
    out += [(2005, [1.0, 2.0], 0, None, None), (2006, [1.0, 2.001], 0, None, None), (2007, [], 0, None, None)]
    return out + [out[9]]


def valid(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
