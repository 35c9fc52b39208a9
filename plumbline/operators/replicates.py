"""Bootstrap draws and permutations carried out where the items' numbers lie: a task holds the columns of all items as arrays and makes its share of the replicates.

No row a replicate is made, shuffled or written: what travels is the items, packed, once to each task. Draws and permutations are those of ``stats``
(md5 of seed, replicate and index). A task holds at most ``NUMBERS`` numbers; tables with more, and those with nulls, are resampled by the joins of ``stats``, with the same results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers (items by columns) that a task may hold, of 8 bytes each.
NUMBERS = 40_000_000
#: Messages hashed at once.
_HASHED = 1 << 15

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(np.sin(k + 1)) * 2**32) for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_block(prefix: bytes, low: int, high: int) -> np.ndarray:
    """md5 of ``prefix`` and each number, all with as many digits; four rows of 32 bits, the first bytes of a digest being the highest."""
    digits = len(str(low))
    length = len(prefix) + digits
    if length > 55:
        raw = b"".join(hashlib.md5(prefix + str(k).encode()).digest() for k in range(low, high))
        return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 4).T
    message = (prefix + b"0" * digits + b"\x80").ljust(56, b"\0") + (8 * length).to_bytes(8, "little")
    words: list = [int(w) for w in np.frombuffer(message, "<u4")]
    left = np.arange(low, high, dtype=np.uint32 if high < 2**32 else np.uint64)
    for at in range(length - 1, len(prefix) - 1, -1):
        upper = left // 10
        words[at // 4] = words[at // 4] + ((left - upper * 10).astype(np.uint32) << np.uint32(8 * (at % 4)))
        left = upper
    a, b, c, d = (np.full(high - low, s, np.uint32) for s in _START)
    for k in range(64):
        if k < 16:
            f, g = d ^ (b & (c ^ d)), k
        elif k < 32:
            f, g = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            f, g = b ^ c ^ d, (3 * k + 5) % 16
        else:
            f, g = c ^ (b | ~d), (7 * k) % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((words[g] + _SINES[k]) % 2**32)
        else:
            f += words[g]
            f += np.uint32(_SINES[k])
        turned = f << np.uint32(_SHIFTS[k])
        turned |= f >> np.uint32(32 - _SHIFTS[k])
        turned += b
        a, d, c, b = d, c, b, turned
    return np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)]).byteswap()


def hashes(prefix: str, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(first number, four rows of 32 bits)`` of the md5 of ``prefix`` and the numbers from 0 to ``n`` - 1."""
    low = 0
    while low < n:
        high = min(n, low + _HASHED, 10 ** len(str(low)))
        yield low, _md5_block(prefix.encode(), low, high)
        low = high


def places(seed: int, r: int, n: int) -> np.ndarray:
    """The numbers from 0 to ``n`` - 1 in order of their md5 in replicate ``r``."""
    one, two = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for low, h in hashes(f"{seed}|{r}|", n):
        h = h.astype(np.uint64)
        one[low : low + h.shape[1]], two[low : low + h.shape[1]] = h[0] << np.uint64(32) | h[1], h[2] << np.uint64(32) | h[3]
    order = np.argsort(one, kind="stable")
    held = one[order]
    return np.lexsort((two, one)) if (held[1:] == held[:-1]).any() else order


def weights(seed: int, r: int, sizes: list[tuple[str, int]]) -> np.ndarray:
    """How often replicate ``r`` draws each item; ``sizes`` has the groups' keys (empty without groups) and numbers of items, whose items lie one group after the other."""
    out = []
    for key, n in sizes:
        picked = np.empty(n, np.int64)
        for low, h in hashes("|".join([str(seed), *([key] if key else []), str(r), ""]), n):
            picked[low : low + h.shape[1]] = h[0] % np.uint64(n)
        out.append(np.bincount(picked, minlength=n).astype(float))
    return np.concatenate(out)


def _inside(order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items by group, and the items that come there in ``order``."""
    return np.argsort(group, kind="stable"), order[np.argsort(group[order], kind="stable")]


# What is measured in each replicate: of(columns) is called once a task and returns a function of the permuted column or of the weights.


def _codes(x: np.ndarray) -> tuple[np.ndarray, int]:
    values, codes = np.unique(x, return_inverse=True)
    return codes.astype(np.int32), len(values)


def _ranks(codes: tuple[np.ndarray, int], w: np.ndarray | None = None) -> np.ndarray:
    n = np.bincount(codes[0], w, codes[1])
    return (np.cumsum(n) - (n - 1) / 2)[codes[0]]


def _centred(x: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Deviations from the mean, and their standard deviation; exactly 0 of equal numbers."""
    if len(x) and x.min() == x.max():
        return np.zeros(len(x)), 0.0
    d = x - (x.mean() if w is None else w @ x / w.sum())
    return d, float(np.sqrt(d @ d / len(d) if w is None else w @ (d * d) / w.sum()))


def _corr(x: tuple[np.ndarray, float], y: tuple[np.ndarray, float], w: np.ndarray | None = None) -> float:
    scale = x[1] * y[1]
    return float((x[0] @ y[0] / len(y[0]) if w is None else (w * x[0]) @ y[0] / w.sum()) / scale) if scale > 0 else 0.0


def _partial(xy: float, xz: float, yz: float) -> float:
    scale = np.sqrt(max(0.0, (1 - xz * xz) * (1 - yz * yz)))
    return float((xy - xz * yz) / scale) if scale > 0 else 0.0


def correlations(xs: list[str], z: str | None = None) -> Callable:
    """Pearson of each x with the permuted column, given z if there is one."""

    def of(v):
        held = {x: _centred(v[x]) for x in xs}
        control = None if z is None else _centred(v[z])
        xz = {} if z is None else {x: _corr(held[x], control) for x in xs}

        def one(y):
            y = _centred(y)
            if control is None:
                return [_corr(held[x], y) for x in xs]
            yz = _corr(y, control)
            return [_partial(_corr(held[x], y), xz[x], yz) for x in xs]

        return one

    return of


def rank_correlations(xs: list[str], y: str, z: str | None = None) -> Callable:
    """Spearman of each x with y in the weighted items, given z if there is one."""

    def of(v):
        codes = {c: _codes(v[c]) for c in dict.fromkeys([*xs, y, *([z] if z else [])])}

        def one(w):
            r = {c: _centred(_ranks(codes[c], w), w) for c in codes}
            if z is None:
                return [_corr(r[x], r[y], w) for x in xs]
            yz = _corr(r[y], r[z], w)
            return [_partial(_corr(r[x], r[y], w), _corr(r[x], r[z], w), yz) for x in xs]

        return one

    return of


def group_correlations(xs: list[str], group: str, keys: list[int], digits: int) -> Callable:
    """Pearson of each x with the permuted column in each group, rounded."""

    def of(v):
        at = [np.flatnonzero(v[group] == k) for k in keys]
        held = [[_centred(v[x][a]) for x in xs] for a in at]
        return lambda y: [round(_corr(x, own), digits) for a, row in zip(at, held, strict=True) for own in [_centred(y[a])] for x in row]

    return of


def stratified(x: str, group: str, least: int) -> Callable:
    """Size-weighted mean over groups of the Pearson of x and the permuted column; small and constant groups do not count."""

    def of(v):
        at = [a for k in np.unique(v[group]) if len(a := np.flatnonzero(v[group] == k)) >= least]
        held = [_centred(v[x][a]) for a in at]

        def one(y):
            inside = [(len(a), h, _centred(y[a])) for a, h in zip(at, held, strict=True)]
            good = [(n, _corr(h, own)) for n, h, own in inside if h[1] * own[1] > 0]
            return [sum(n * c for n, c in good) / sum(n for n, _ in good) if good else None]

        return one

    return of


def mean_difference(x: str) -> Callable:
    """Mean of x where the permuted column is 1, less its mean where that is 0."""

    def of(v):
        def one(y):
            a, b = v[x][y == 1], v[x][y == 0]
            return [float(a.sum() / len(a) - b.sum() / len(b)) if len(a) and len(b) else None]

        return one

    return of


def auc(x: str, label: str) -> Callable:
    def of(v):
        codes, n = _codes(v[x])

        def one(w):
            p, m = np.bincount(codes, w * v[label], n), np.bincount(codes, w * (1 - v[label]), n)
            both = p.sum() * m.sum()
            return [float(p @ (np.cumsum(m) - m / 2) / both) if p.sum() > 0 and m.sum() > 0 else None]

        return one

    return of


def _cubic(c: np.ndarray, w: np.ndarray | None = None) -> Callable[[np.ndarray, int], np.ndarray]:
    """Residuals on 1, z, z^2, z^3 with z the standardised control, rounded and ranked."""
    d, s = _centred(c, w)
    z = d / (s if s > 0 else 1.0)
    powers = np.stack([np.ones(len(z)), z, z * z, z * z * z])
    own = powers if w is None else powers * w
    inverse = np.linalg.pinv(own @ powers.T, rcond=1e-12, hermitian=True)

    def ranked(y: np.ndarray, digits: int) -> tuple[np.ndarray, float]:
        left = np.rint((y - (inverse @ (own @ y)) @ powers) * 10.0**digits)
        return _centred(_ranks(_codes(left), w), w)

    return ranked


def permuted_cubic(xs: list[str], c: str, digits: tuple[int, int]) -> Callable:
    """Spearman of what a cubic of c leaves of each x and of the permuted column."""

    def of(v):
        fit = _cubic(v[c])
        held = [fit(v[x], digits[0]) for x in xs]
        return lambda y: [_corr(x, own) for own in [fit(y, digits[1])] for x in held]

    return of


def drawn_cubic(xs: list[str], y: str, c: str, digits: tuple[int, int]) -> Callable:
    """The same of the weighted items."""

    def of(v):
        def one(w):
            drawn = np.flatnonzero(w)
            w = w[drawn]
            fit = _cubic(v[c][drawn], w)
            own = fit(v[y][drawn], digits[1])
            return [_corr(fit(v[x][drawn], digits[0]), own, w) for x in xs]

        return one

    return of


# How the items come to the tasks


def fits(items: DataFrame, columns: list[str], by: str | None = None) -> bool:
    """Whether a task can hold these columns of a kept table: few enough numbers, none of them null; ``by`` is of whole numbers."""
    if by is not None and items.schema[by].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    bad = [F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("long")) for c in {*columns, *([by] if by else [])}]
    n, *found = items.agg(F.count("*"), *bad).first()
    return n * (len(columns) + 1) <= NUMBERS and not any(found)


def _carried(items: DataFrame, columns: list[str], replicates: int, of: Callable, names: list[tuple], schema: str, prepare: Callable, by: str | None = None, apart: bool = False) -> DataFrame:
    """``(r, names..., value)``; ``prepare(columns)`` gives what a replicate passes to the measure. ``apart``: ``i`` counts inside ``by``."""
    groups = [(int(k), n) for k, n in items.groupBy(by).agg(F.count("*").alias("n")).orderBy(by).collect()] if apart else [(0, items.count())]
    keys, sizes = np.array([k for k, _ in groups]), np.array([n for _, n in groups], np.int64)
    begin, n, k = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), int(sizes.sum()), len(columns)
    tasks = max(1, min(replicates, 2 * items.sparkSession.sparkContext.defaultParallelism))
    fields = pa.schema([("r", pa.int32()), *[(f.split()[0], pa.string() if f.split()[1] == "string" else pa.int64()) for f in schema.split(", ") if f], ("value", pa.float64())])

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]).tobytes()], pa.binary())], ["packed"])

    def run(batches):
        held, mine = np.empty((k, n)), set()
        for batch in batches:
            for raw, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                block = np.frombuffer(raw.as_buffer()).reshape(k + 2, -1)
                held[:, begin[np.searchsorted(keys, block[1])] + block[0].astype(np.int64)] = block[2:]
                mine.add(t)
        v = dict(zip(columns, held, strict=True))
        measure, given = (of(v), prepare(v)) if mine else (None, None)
        for r in sorted(r for t in mine for r in range(t, replicates, tasks)):
            rows = [[r] * len(names), *[list(c) for c in zip(*names, strict=True)], measure(given(r))]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for f, x in zip(fields, rows, strict=True)], schema=fields)

    own = (F.col(by) if apart else F.lit(0)).cast("double").alias("_of")
    rows = items.select(F.col("i").cast("double").alias("i"), own, *[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(pack, "packed binary")
    each = rows.select("packed", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("t")).repartitionById(tasks, "t")
    return each.mapInArrow(run, ", ".join(x for x in ("r int", schema, "value double") if x))


def permutations(items: DataFrame, column: str, columns: list[str], replicates: int, seed: int, of: Callable, names: list[tuple], schema: str = "", by: str | None = None) -> DataFrame:
    """``(r, names..., value)`` of items with ``i`` from 0: ``column`` permuted in each replicate (inside ``by``) as ``stats.permuted`` does."""

    def prepare(v):
        y = v[column]

        def given(r):
            order = places(seed, r, len(y))
            if by is None:
                return y[order]
            out, (to, source) = np.empty_like(y), _inside(order, v[by])
            out[to] = y[source]
            return out

        return given

    return _carried(items, list(dict.fromkeys([column, *columns, *([by] if by else [])])), replicates, of, names, schema, prepare)


def draws(items: DataFrame, columns: list[str], replicates: int, seed: int, of: Callable, names: list[tuple], schema: str = "", by: str | None = None) -> DataFrame:
    """``(r, names..., value)`` of items with ``i`` from 0 (inside ``by``): drawn with replacement in each replicate as ``stats.resampled`` does."""
    sizes = [(str(k), n) for k, n in items.groupBy(by).agg(F.count("*").alias("n")).orderBy(by).collect()] if by else [("", items.count())]
    return _carried(items, columns, replicates, of, names, schema, lambda v: lambda r: weights(seed, r, sizes), by, by is not None)
