"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Every entry c becomes the integer ``floor(64 * c) + 1000000``; the fit list is each distinct integer vector once.
Tasks sum the list, then the products of its entries less the rounded mean (small integers, so the sums are exact
and do not depend on the order; the rest of the mean, at most a half, is taken off afterwards, exactly). The sums
are added row by row of the matrix. ``V = L L'`` by Cholesky with the largest remaining diagonal
entry as pivot, stopped where that is rounding noise; the columns of L are rotated in pairs until all are
orthogonal. Their squared norms are the eigenvalues of V and the normalised columns its eigenvectors, found
without squaring the factor again. Only components above the noise are returned, at most ``COMPONENTS``.

Vectors of different lengths are fitted and whitened apart, each length by its own list. Rows drop out whose
vector is null, holds null or non-finite entries, or an entry whose integer passes 64 bits. An empty vector, and
a list with one vector only, have no component, so no rows. Repeated rows are each returned, and count once in the
fit; a null vec_id is kept as it is. Equal eigenvalues leave the choice of components open; each component's
largest entry (the first of equals) is positive. ``deviation`` is exact, and null where it passes 64 bits. An empty table gives an empty
result; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store
from .vectors import matrix

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
#: Most numbers that all models may hold together (they are sent to every task): 32 MB. More raise an error.
MOST_SENT = 1 << 22
SWEEPS = 60
_HALF = 1 << 31


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x: usable vectors as integers."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    scaled = F.transform("v", lambda c: F.floor(c * SCALE + 0.0))
    fits = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= F.lit(2.0 ** 56)), F.lit(False)))
    return (v.where(F.col("v").isNotNull() & F.coalesce(fits, F.lit(False)))
            .select("vec_id", F.size("v").alias("dim"), F.transform(scaled, lambda c: c.cast("long") + SHIFT).alias("x")))


def _by_dim(batches, at: int):
    """(dim, integer matrix, rows) of each length in each batch."""
    for b in batches:
        dims = pc.list_value_length(b.column(at)).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            yield int(dim), matrix(b.column(at).take(pa.array(rows))).astype(np.int64).reshape(len(rows), int(dim)), rows, b


def _sums(batches):
    """dim, n, high, low: sums of the entries, in halves that cannot overflow."""
    got: dict[int, list] = {}
    for dim, x, _, _ in _by_dim(batches, 0):
        have = got.setdefault(dim, [0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)])
        have[0] += len(x)
        have[1] += (x >> 32).sum(axis=0)
        have[2] += (x & 0xFFFFFFFF).sum(axis=0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(got), pa.int32()), pa.array([g[0] for g in got.values()], pa.int64()),
         pa.array([g[1].tolist() for g in got.values()], pa.list_(pa.int64())), pa.array([g[2].tolist() for g in got.values()], pa.list_(pa.int64()))],
        names=["dim", "n", "high", "low"])


def _products(centres: dict[int, np.ndarray]):
    """dim, i, products, first: rows of the sum of outer products around the rounded means, and of the sum itself."""
    def run(batches):
        got: dict[int, list] = {}
        for dim, x, _, _ in _by_dim(batches, 0):
            y = (x - centres[dim]).astype(np.float64)
            have = got.setdefault(dim, [np.zeros((dim, dim)), np.zeros(dim)])
            have[0] += y.T @ y
            have[1] += y.sum(axis=0)
        for dim, (p, s) in got.items():
            for at in range(0, dim, 256):
                part = range(at, min(at + 256, dim))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array(p[at:at + 256].tolist(), pa.list_(pa.float64())),
                     pa.array(s[at:at + 256], pa.float64())], names=["dim", "i", "products", "first"])
    return run


def _add_rows(key, t):
    p = matrix(t["products"]).sum(axis=0)
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()),
                     "products": pa.array([p.tolist()], pa.list_(pa.float64())), "first": pa.array([t["first"].to_numpy().sum()])})


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with ``v = L L'`` up to rounding; a column for each pivot, rows in the order of ``v``."""
    d = np.diag(v).astype(np.float64).copy()
    noise = len(d) * np.finfo(float).eps * max(d.max(initial=0.0), 0.0)
    cols: list[np.ndarray] = []
    done = np.zeros(len(d), bool)
    for _ in range(len(d)):
        p = int(np.where(done, -np.inf, d).argmax())
        if not d[p] > noise:
            break
        col = v[:, p].astype(np.float64).copy()
        for c in cols:
            col -= c * c[p]
        col /= np.sqrt(d[p])
        col[done], col[p] = 0.0, np.sqrt(d[p])
        done[p] = True
        cols.append(col)
        d -= col * col
    return np.stack(cols, axis=1) if cols else np.zeros((len(d), 0))


def one_sided_jacobi(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms (falling) and unit columns after rotating pairs of columns until all are orthogonal."""
    a = columns.astype(np.float64).copy()
    r = a.shape[1]
    players = list(range(r)) + ([-1] if r % 2 else [])
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(players) - 1):              # every pair once, disjoint pairs together
            half = len(players) // 2
            pairs = [(p, q) for p, q in zip(players[:half], players[:half - 1:-1], strict=True) if p >= 0 and q >= 0]
            if pairs:
                p, q = np.array([min(x) for x in pairs]), np.array([max(x) for x in pairs])
                ap, aq = a[:, p], a[:, q]
                alpha, beta, gamma = (ap * ap).sum(axis=0), (aq * aq).sum(axis=0), (ap * aq).sum(axis=0)
                size = np.sqrt(alpha * beta)
                turn = np.abs(gamma) > 1e-15 * size
                worst = max(worst, float((np.abs(gamma) / np.where(size > 0, size, 1.0)).max()))
                zeta = (beta - alpha) / np.where(turn, 2.0 * gamma, 1.0)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = np.where(turn, 1.0 / np.hypot(1.0, t), 1.0)
                s = np.where(turn, c * t, 0.0)
                a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            players = [players[0], players[-1], *players[1:-1]]
        if worst <= 1e-15:
            break
    e = (a * a).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    e, a = e[order], a[:, order]
    return e, a / np.sqrt(np.where(e > 0, e, 1.0))


def _factor(n_of: dict[int, int], most: int):
    """The model of one length from the rows of its scatter matrix."""
    def run(key, t):
        dim = key[0].as_py()
        order = np.argsort(t["i"].to_numpy())
        n = n_of[dim]
        rest = t["first"].to_numpy()[order] / n                # the mean less the rounded mean
        v = matrix(t["products"])[order] / n - np.outer(rest, rest)
        trace = float(np.trace(v))
        e, c = one_sided_jacobi(pivoted_cholesky(v))
        keep = np.flatnonzero(e > dim * np.finfo(float).eps * e.max(initial=0.0))[:most]
        e, c = e[keep], c[:, keep]
        if len(keep):
            c = c * np.where(c[np.abs(c).argmax(axis=0), np.arange(len(keep))] < 0, -1.0, 1.0)
        return pa.table({"dim": pa.array([dim], pa.int32()), "rest": pa.array([rest.tolist()], pa.list_(pa.float64())),
                         "e": pa.array([e.tolist()], pa.list_(pa.float64())), "trace": pa.array([trace]),
                         "c": pa.array([(c / np.sqrt(np.where(e > 0, e, 1.0))).ravel().tolist()], pa.list_(pa.float64()))})
    return run


def _whiten(x: np.ndarray, m: dict) -> np.ndarray:
    return ((x - m["centre"]).astype(np.float64) - m["rest"]) @ m["c"].reshape(len(m["centre"]), len(m["e"]))


def _deviation(x: np.ndarray, m: dict) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 as whole numbers; None beyond 64 bits."""
    n, y, short = m["n"], x - m["centre"], [int(s) for s in m["short"]]
    top = (int(np.abs(y).max(initial=0)) * n + max((abs(s) for s in short), default=0)) ** 2 * max(1, x.shape[1])
    if top < 1 << 63:
        d = y * np.int64(n) - np.array(short, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, short, strict=True)) for row in y.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def _identity(models: dict[int, dict]):
    """dim, i, products, first: rows of the sums over whitened vectors of the fit list."""
    def run(batches):
        got: dict[int, list] = {}
        for dim, x, _, _ in _by_dim(batches, 0):
            w = _whiten(x, models[dim])
            have = got.setdefault(dim, [np.zeros((w.shape[1], w.shape[1])), np.zeros(w.shape[1])])
            have[0] += w.T @ w
            have[1] += w.sum(axis=0)
        for dim, (p, s) in got.items():
            if len(s):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(s)],
                    names=["dim", "i", "products", "first"])
    return run


def _apply(models: dict[int, dict]):
    """vec_id, n, deviation, whitened, explained, identity_error of every row."""
    def run(batches):
        for dim, x, rows, b in _by_dim(batches, 1):
            m = models[dim]
            w, k = _whiten(x, m), len(m["e"])
            if not k:
                continue
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * k, k), pa.int32()), pa.array(w.ravel()))
            same = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * k, k), pa.int32()), pa.array(np.tile(m["e"] / m["trace"], len(x))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array([m["n"]] * len(x), pa.int64()), pa.array(_deviation(x, m), pa.int64()), flat, same,
                 pa.array([m["error"]] * len(x), pa.float64())], names=["vec_id", "n", "deviation", "w", "explained", "identity_error"])
    return run


_SCATTER = "dim int, i int, products array<double>, first double"


def fit(rows: DataFrame, most: int = COMPONENTS) -> tuple[DataFrame, dict[int, dict]]:
    """The fit list and, by length, its model: n, centre, short (S - n * centre), rest, e, c, trace, error.

    What reaches the driver is, for each length, its mean and at most ``most`` components.
    """
    listed = store(rows.select("dim", "x").distinct().select("x"), "fit-list")
    halves = listed.mapInArrow(_sums, "dim int, n long, high array<long>, low array<long>")
    sums = (halves.select("dim", "n", F.posexplode_outer(F.arrays_zip("high", "low")).alias("i", "h"))
            .groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum((F.col("h.high").cast("decimal(38,0)") * _HALF * 2 + F.col("h.low"))
                                                                .cast("decimal(38,0)")).alias("s")))
    sums = store(sums, "sums")
    if sums.count() * (most + 2) > MOST_SENT:
        raise ValueError("the models of all vector lengths together pass the bound on what is sent to every task")
    models: dict[int, dict] = {}
    for r in sums.orderBy("dim", "i").collect():
        m = models.setdefault(r["dim"], {"n": r["n"], "sums": []})
        if r["s"] is not None:
            m["sums"].append(int(r["s"]))
    for m in models.values():
        centre = [(2 * s + m["n"]) // (2 * m["n"]) for s in m["sums"]]
        m["short"] = [s - m["n"] * c for s, c in zip(m["sums"], centre, strict=True)]
        m["centre"] = np.array(centre, np.int64)
        m.update(e=np.empty(0), c=np.empty(0), trace=0.0, error=0.0, rest=np.zeros(len(centre)))
    scatter = (listed.mapInArrow(_products({d: m["centre"] for d, m in models.items()}), _SCATTER)
               .groupBy("dim", "i").applyInArrow(_add_rows, _SCATTER))
    made = scatter.groupBy("dim").applyInArrow(_factor({d: m["n"] for d, m in models.items()}, most),
                                               "dim int, rest array<double>, e array<double>, trace double, c array<double>")
    for r in made.collect():
        models[r["dim"]].update({k: np.array(r[k], dtype=np.float64) for k in ("rest", "e", "c")}, trace=r["trace"])
    errors = (listed.mapInArrow(_identity(models), _SCATTER).groupBy("dim", "i").applyInArrow(_add_rows, _SCATTER)).collect()
    means = {(r["dim"], r["i"]): r["first"] / models[r["dim"]]["n"] for r in errors}
    for r in errors:
        m, k = models[r["dim"]], len(r["products"])
        cov = np.array(r["products"]) / m["n"] - means[r["dim"], r["i"]] * np.array([means[r["dim"], j] for j in range(k)])
        m["error"] = max(m["error"], float(np.abs(cov - (np.arange(k) == r["i"])).max()))
    return listed, models


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    small_batches(vectors.sparkSession)
    rows = coded(vectors)
    _, models = fit(rows, most)
    made = rows.select("vec_id", "x").mapInArrow(
        _apply(models), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, n long, deviation long, w array<double>, explained array<double>, identity_error double")
    return made.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("w", "explained")).alias("at", "o")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("o.w").alias("whitened"), F.col("o.explained").alias("explained"), "identity_error")
