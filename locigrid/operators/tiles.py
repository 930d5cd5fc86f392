"""Comparisons of two sets of vectors that fit a task, tile by tile.

Rows are cut at medians into tiles of near rows. The boxes around two tiles tell
whether they can matter to each other. Of a pair of tiles one matrix product
gives all squared distances but for a rounding error with a known bound; pairs
that it cannot rule out are measured one by one, so results are exact.
"""

from __future__ import annotations

import numpy as np

# Rows of a tile on either side, and pairs that are measured at a time.
TILE = 512
BASE_TILE = 1_024
# The same where costs are worked out for whole tiles, so that their tables stay in the cache.
COST_TILE = 128
PAIRS = 1 << 10
# Measured pairs that are merged with the best known ones at a time.
MERGED = 1 << 18
# Products are made of short numbers where their error is at most this share of the squared distance looked for.
SHARE = 0.02
# Coordinates from which on sums of cubes are bounded by products of their own.
CUBED = 8


def _distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances of all rows of ``a`` to all rows of ``b``; equal rows
    are at distance 0 exactly."""
    out = np.zeros((len(a), len(b)))
    step, power = np.empty_like(out), np.empty_like(out)
    for j in range(a.shape[1]):
        np.subtract(a[:, j, None], b[None, :, j], out=step)
        np.abs(step, out=step)
        if p in (1, 2, 3):
            # products are far cheaper than a general power
            np.copyto(power, step)
            for _ in range(int(p) - 1):
                power *= step
        else:
            np.power(step, p, out=power)
        out += power
    return np.sqrt(out) if p == 2 else out ** (1.0 / p)


def pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, p: float) -> np.ndarray:
    """Distances of the rows ``a[i]`` from the rows ``b[j]``, the same numbers as ``_distances`` gives."""
    out = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        step = np.ascontiguousarray((a[i[part]] - b[j[part]]).T)
        np.abs(step, out=step)
        if p in (1, 2, 3):
            power = step.copy() if p > 1 else step
            for _ in range(int(p) - 1):
                power *= step
        else:
            power = step**p
        total = np.zeros(step.shape[1])
        for row in power:
            total += row
        out[part] = np.sqrt(total) if p == 2 else total ** (1.0 / p)
    return out


def cut(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in tiles of at most ``size`` near rows, cut at the median of the widest coordinate."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(np.sort(rows))
            continue
        spread = np.ptp(x[rows], axis=0) if x.shape[1] else np.zeros(1)
        widest = int(np.nan_to_num(spread, nan=-1.0).argmax())
        half = len(rows) // 2
        order = np.argpartition(x[rows, widest], half) if x.shape[1] else np.arange(len(rows))
        stack += [rows[order[:half]], rows[order[half:]]]
    return out


class Side:
    """Tiles of a set of rows with the boxes around them."""

    def __init__(self, x: np.ndarray, size: int, groups: list[np.ndarray] | None = None) -> None:
        """``groups``, row numbers, are not mixed in a tile."""
        whole = [np.arange(len(x))] if groups is None else groups
        self.x, self.rows = x, [rows[part] for rows in whole if len(rows) for part in cut(x[rows], size)]
        shape = (len(self.rows), x.shape[1])
        self.low = np.array([x[r].min(axis=0) for r in self.rows]).reshape(shape)
        self.high = np.array([x[r].max(axis=0) for r in self.rows]).reshape(shape)


def box_gaps(a: Side, t: int, b: Side, p: float) -> np.ndarray:
    """Distances that rows of tile ``t`` keep at least from those of each tile of ``b``; 0 where numbers are missing."""
    apart = np.maximum(np.maximum(b.low - a.high[t], a.low[t] - b.high), 0)
    return np.nan_to_num((apart**p).sum(axis=1) ** (1.0 / p), nan=0.0)


def nearest_first(a: Side, t: int, b: Side, gap: np.ndarray) -> np.ndarray:
    """Tiles of ``b`` by their gap, then by the distance of the middles of the boxes."""
    middle = ((a.low[t] + a.high[t]) / 2 - (b.low + b.high) / 2) ** 2
    return np.lexsort((middle.sum(axis=1), gap))


class Products:
    """Squared distances of tiles from matrix products."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        # moved to the middle of one side, which keeps the error small
        with np.errstate(all="ignore"):
            middle = b.mean(axis=0)
            a, b = a - middle, b - middle
            aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
            # without finite products every pair has to be measured
            self.finite = bool(np.isfinite(aa).all() and np.isfinite(bb).all() and (aa.max(initial=0) + bb.max(initial=0)) < 1e300)
            far = np.sqrt(aa) + np.sqrt(bb.max(initial=0))
            self.error = 4 * (a.shape[1] + 8) * np.finfo(float).eps * far * far
            # short numbers are brought to the size of one, so that they neither overflow nor vanish
            top = far.max(initial=0) if self.finite else 0.0
            self.scale = 2.0 ** np.ceil(np.log2(top)) if top > 0 else 1.0
        self.short_error = (a.shape[1] + 8) * np.finfo(np.float32).eps * far * far
        self.left = np.column_stack((a, aa, np.ones(len(a))))
        self.right = np.column_stack((-2 * b, np.ones(len(b)), bb))
        if self.finite:
            s = self.scale
            self.short_left = np.column_stack((a / s, aa / s / s, np.ones(len(a)))).astype(np.float32)
            self.short_right = np.column_stack((b / s * -2, np.ones(len(b)), bb / s / s)).astype(np.float32)

    def squares(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Within ``error`` of the squared distances."""
        return self.left[rows] @ self.right[columns].T

    def fits(self, rows: np.ndarray, limit: np.ndarray) -> bool:
        """Whether short numbers tell squared distances around ``limit`` apart for nearly all ``rows``."""
        return bool(np.count_nonzero(self.short_error[rows] > SHARE * limit) * 16 <= len(rows))

    def below(self, rows: np.ndarray, columns: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the table of ``rows`` and ``columns`` whose squared distance can be at most ``limit``, these squares, and what they are off by per row."""
        if self.fits(rows, limit):
            squares = self.short_left[rows] @ self.short_right[columns].T
            off, unit = self.short_error[rows], self.scale * self.scale
            most = np.nextafter(((limit + off) / unit).astype(np.float32), np.float32(np.inf))
        else:
            squares, off, unit = self.squares(rows, columns), self.error[rows], 1.0
            most = limit + off
        # hits are few, so they are looked for eight pairs at a time
        mask = np.zeros(-(-squares.size // 8) * 8, bool)
        np.less_equal(squares, most[:, None], out=mask[: squares.size].reshape(squares.shape))
        words = np.flatnonzero(mask.view(np.uint64))
        hits = mask.reshape(-1, 8)[words].ravel()
        hits = (words[:, None] * 8 + np.arange(8)).ravel()[hits]
        return hits, squares.ravel()[hits].astype(float) * unit, off


class Cubes:
    """Lower bounds of the sums of the cubes of the differences of two sides, by products of short numbers.

    With u the square of a difference, u ** 1.5 is nowhere in [0, top] under the parabola that touches it at ``at`` and
    meets it at ``top``, the greatest square there is. The sum of the parabola over the coordinates is a sum of
    powers of both sides, and so a matrix product.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, near: float) -> None:
        """``near`` is a distance of order 3 that pairs are to be told apart at; any gives bounds, some better ones."""
        d = a.shape[1]
        middle = (np.minimum(a.min(axis=0), b.min(axis=0)) + np.maximum(a.max(axis=0), b.max(axis=0))) / 2
        wide = max(np.abs(a - middle).max(), np.abs(b - middle).max())
        # brought to the size of one
        self.scale = 2.0 ** np.ceil(np.log2(wide)) if wide > 0 else 1.0
        a, b = (a - middle) / self.scale, (b - middle) / self.scale
        top = 1.0001 * float((np.maximum(a.max(axis=0) - b.min(axis=0), b.max(axis=0) - a.min(axis=0)) ** 2).max())
        # the mean square of differences that are normal and whose cubes add up to that of ``near``
        at = min(max((near / self.scale) ** 2 / (1.6 * d) ** (2 / 3), 1e-6), 0.5 * top) if top > 0 else 0.0
        bend = (top**1.5 - at**1.5 - 1.5 * at**0.5 * (top - at)) / (top - at) ** 2 if top > 0 else 0.0
        # the parabola is level + slope u + bend u u
        slope, level = 1.5 * at**0.5 - 2 * bend * at, -0.5 * at**1.5 + bend * at * at
        ones = lambda x: np.ones((len(x), 1))
        aa, bb = a * a, b * b
        whole = lambda xx: (xx * (slope + bend * xx)).sum(axis=1, keepdims=True)
        left = np.hstack((a * (-2 * slope - 4 * bend * aa), 6 * bend * aa, -4 * bend * a, whole(aa) + level * d, ones(a)))
        right = np.hstack((b, bb, b * bb, ones(b), whole(bb)))
        self.left, self.right = left.astype(np.float32), right.astype(np.float32)
        # products of short numbers that are off by a share each, and sums of them
        size = np.sqrt((left * left).sum(axis=1) * (right * right).sum(axis=1).max(initial=0))
        self.error = (left.shape[1] + 8) * np.finfo(np.float32).eps * size

    def below(self, rows: np.ndarray, columns: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Places in the table of ``rows`` and ``columns`` whose distance can be at most ``limit``."""
        sums = self.left[rows] @ self.right[columns].T
        most = (limit / self.scale) ** 3 * (1 + 1e-9) + self.error[rows]
        return np.flatnonzero(sums <= np.nextafter(most.astype(np.float32), np.float32(np.inf))[:, None])


def _most(p: float, d: int) -> float:
    """The most by which a squared Euclidean distance exceeds the square of that of order ``p``."""
    return d ** max(0.0, 1 - 2 / p)


Probed = tuple[np.ndarray, np.ndarray]


def _open(probed: Probed | None, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Whether the rows may meet the columns, entry by entry."""
    return np.ones(np.broadcast_shapes(rows.shape, columns.shape), bool) if probed is None else probed[0][rows, probed[1][columns]]


def closest(q: np.ndarray, b: np.ndarray, k: int, p: float, cap: np.ndarray | None = None, probed: Probed | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in ``b`` and distances of the ``k`` nearest rows of each row of ``q``, equal ones by row number.

    Rows farther than ``cap`` need not be found; places left free hold the number of rows of ``b``. ``probed`` says which
    groups each row of ``q`` looks at, and the group of each row of ``b``.
    """
    k = min(k, len(b))
    place, distance = np.zeros((len(q), k), np.int64), np.zeros((len(q), k))
    asked, base, product = Side(q, TILE), Side(b, BASE_TILE), Products(q, b)
    most = _most(p, b.shape[1])
    if cap is None:
        cap = np.full(len(q), np.inf)
    if p == 2 and product.finite and k:
        return _closest_by_squares(q, b, k, cap, asked, base, product, probed)
    if p != 2 and product.finite and k and np.isinf(cap).any():
        # no row's k nearest are farther than the k that are nearest by Euclid
        by_euclid, _ = closest(q, b, k, 2.0, probed=probed)
        full = np.flatnonzero((by_euclid < len(b)).all(axis=1))
        i = np.repeat(full, k)
        cap = cap.copy()
        cap[full] = np.fmin(cap[full], pair_distances(q, b, i, by_euclid[full].ravel(), p).reshape(len(full), k).max(axis=1))
    # bounds by cubes are far closer than those by squares
    known = cap[np.isfinite(cap)]
    cubes = Cubes(q, b, float(np.median(known))) if p == 3 and product.finite and len(known) and b.shape[1] >= CUBED else None
    for t, rows in enumerate(asked.rows):
        gap = box_gaps(asked, t, base, p)
        # free places come last, also after distances that are no numbers
        d, at = np.full((len(rows), k), np.nan), np.full((len(rows), k), len(b), np.int64)
        for other in nearest_first(asked, t, base, gap):
            columns = base.rows[other]
            worst = np.fmin(np.nan_to_num(d[:, -1], nan=np.inf, posinf=np.inf), cap[rows])
            if gap[other] > worst.max() * (1 + 1e-9):
                continue
            if not product.finite:
                i, j = (v.ravel() for v in np.indices((len(rows), len(columns))))
                met = _open(probed, rows[i], columns[j])
                _insert(d, at, i[met], columns[j[met]], _distances(q[rows], b[columns], p).ravel()[met])
                continue
            if np.isinf(worst).any():
                # some bound to begin with
                squares = product.squares(rows, columns)
                squares[~_open(probed, rows[:, None], columns[None, :])] = np.inf
                few = np.argpartition(squares, min(k, len(columns)) - 1, axis=1)[:, :k]
                i, j = np.repeat(np.arange(len(rows)), few.shape[1]), few.ravel()
                met = squares[i, j] < np.inf
                i, j = i[met], j[met]
                squares[i, j] = np.inf
                _insert(d, at, i, columns[j], pair_distances(q, b, rows[i], columns[j], p))
                worst = np.nan_to_num(d[:, -1], nan=np.inf, posinf=np.inf)
                limit = worst**2 * most * (1 + 1e-9) + product.error[rows]
                near = np.flatnonzero((squares <= limit[:, None]) & (squares < np.inf))
            else:
                near = cubes.below(rows, columns, worst) if cubes else product.below(rows, columns, worst**2 * most * (1 + 1e-9))[0]
                if probed is not None:
                    i, j = np.divmod(near, len(columns))
                    near = near[_open(probed, rows[i], columns[j])]
            for s in range(0, len(near), MERGED):
                i, j = np.divmod(near[s : s + MERGED], len(columns))
                new = pair_distances(q, b, rows[i], columns[j], p)
                keep = new <= worst[i]
                if keep.any():
                    _insert(d, at, i[keep], columns[j[keep]], new[keep])
        place[rows], distance[rows] = at, d
    return place, distance


def _closest_by_squares(q, b, k: int, cap: np.ndarray, asked: Side, base: Side, product: Products, probed: Probed | None) -> tuple[np.ndarray, np.ndarray]:
    """``closest`` by Euclid. Squares with a known error choose who stays; only rows that may be among the ``k`` are measured."""
    place, distance = np.full((len(q), k), len(b), np.int64), np.full((len(q), k), np.nan)
    for t, rows in enumerate(asked.rows):
        gap = box_gaps(asked, t, base, 2.0)
        # squares that k rows are known to be within, by their upper bounds
        limit = cap[rows] ** 2 * (1 + 1e-9)
        held, waiting, fresh = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        for other in nearest_first(asked, t, base, gap):
            columns = base.rows[other]
            if gap[other] ** 2 > limit.max() * (1 + 1e-9):
                continue
            if np.isinf(limit).any():
                squares, off = product.squares(rows, columns), product.error[rows]
                squares[~_open(probed, rows[:, None], columns[None, :])] = np.inf
                if len(columns) >= k:
                    limit = np.minimum(limit, np.partition(squares, k - 1, axis=1)[:, k - 1] + off)
                hits = np.flatnonzero((squares <= (limit + off)[:, None]) & (squares < np.inf))
                found = squares.ravel()[hits]
                i, j = np.divmod(hits, len(columns))
            else:
                hits, found, off = product.below(rows, columns, limit)
                i, j = np.divmod(hits, len(columns))
                if probed is not None:
                    met = _open(probed, rows[i], columns[j])
                    i, j, found = i[met], j[met], found[met]
            if not len(i):
                continue
            # the least and the greatest the square can be
            waiting.append((i, columns[j], found - off[i], found + off[i]))
            fresh += len(i)
            if fresh > 2 * k * len(rows):
                held, limit = _narrowed(held, waiting, limit, k, len(rows))
                waiting, fresh = [], 0
        held, limit = _narrowed(held, waiting, limit, k, len(rows))
        i, j = held[0], held[1]
        new = pair_distances(q, b, rows[i], j, 2.0)
        order = np.lexsort((j, new, i))
        i, j, new = i[order], j[order], new[order]
        starts = np.searchsorted(i, np.arange(len(rows)))
        slot = np.arange(len(i)) - starts[i]
        keep = (slot < k) & (new <= cap[rows[i]])
        place[rows[i[keep]], slot[keep]], distance[rows[i[keep]], slot[keep]] = j[keep], new[keep]
    return place, distance


def _narrowed(held: tuple, waiting: list, limit: np.ndarray, k: int, n: int) -> tuple[tuple, np.ndarray]:
    """Candidates (row, place, least square, greatest square) that can still be among the ``k`` of their row, and the limits."""
    parts = ([held] if len(held) == 4 else []) + waiting
    if not parts:
        return (*[np.zeros(0, np.int64)] * 2, *[np.zeros(0)] * 2), limit
    i, j, low, high = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((high, i))
    i, j, low, high = i[order], j[order], low[order], high[order]
    starts = np.searchsorted(i, np.arange(n + 1))
    full = np.flatnonzero(np.diff(starts) >= k)
    limit = limit.copy()
    limit[full] = np.minimum(limit[full], high[starts[full] + k - 1])
    keep = low <= limit[i] * (1 + 1e-12)
    return (i[keep], j[keep], low[keep], high[keep]), limit


def _insert(d: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, new: np.ndarray) -> None:
    """Keep the best of each row of ``d`` and ``at`` and of the new entries (i, j)."""
    k = d.shape[1]
    touched, i = np.unique(i, return_inverse=True)
    row = np.concatenate((np.repeat(np.arange(len(touched)), k), i))
    every, where = np.concatenate((d[touched].ravel(), new)), np.concatenate((at[touched].ravel(), j))
    order = np.lexsort((where, every, row))
    starts = np.searchsorted(row[order], np.arange(len(touched)))
    best = order[starts[:, None] + np.arange(k)[None, :]]
    d[touched], at[touched] = every[best], where[best]


def _within(a: np.ndarray, b: np.ndarray, product: Products, rows: np.ndarray, columns: np.ndarray, eps: float, p: float) -> np.ndarray:
    """Which rows of two tiles are at most ``eps`` apart."""
    if not product.finite:
        return _distances(a[rows], b[columns], p) <= eps
    squares, error = product.squares(rows, columns), product.error[rows][:, None]
    sure = eps * eps * (1 - 1e-9) / a.shape[1] ** max(0.0, 2 / p - 1) - error
    hit = squares <= sure
    i, j = np.divmod(np.flatnonzero((squares <= eps * eps * _most(p, a.shape[1]) * (1 + 1e-9) + error) & ~hit), len(columns))
    hit[i, j] = pair_distances(a, b, rows[i], columns[j], p) <= eps
    return hit


def weight_within(q: np.ndarray, b: np.ndarray, w: np.ndarray, eps: float, p: float) -> np.ndarray:
    """For each row of ``q`` the sum of ``w`` over the rows of ``b`` within ``eps``."""
    out = np.zeros(len(q))
    asked, base, product = Side(q, TILE), Side(b, BASE_TILE), Products(q, b)
    for t, rows in enumerate(asked.rows):
        gap = box_gaps(asked, t, base, p)
        for other in np.flatnonzero(gap <= eps * (1 + 1e-9)):
            columns = base.rows[other]
            out[rows] += _within(q, b, product, rows, columns, eps, p).astype(float) @ w[columns]
    return out


def linked(q: np.ndarray, b: np.ndarray, q_ids: np.ndarray, b_ids: np.ndarray, eps: float, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of either side that have a row of the other within ``eps``, each with one row of its component."""
    n = len(q)
    label = np.arange(n + len(b))
    if not n or not len(b):
        return q_ids[:0], q_ids[:0]
    ids = np.concatenate((q_ids, b_ids))
    asked, base, product = Side(q, TILE), Side(b, BASE_TILE), Products(q, b)
    for t, rows in enumerate(asked.rows):
        gap = box_gaps(asked, t, base, p)
        for other in nearest_first(asked, t, base, gap):
            columns = base.rows[other]
            mine, theirs = label[rows], label[n + columns]
            # rows that are tied already need not be compared
            if gap[other] > eps * (1 + 1e-9) or (mine[0] == mine).all() and (mine[0] == theirs).all():
                continue
            hit = _within(q, b, product, rows, columns, eps, p) & (mine[:, None] != theirs[None, :])
            if hit.any():
                i, j = np.nonzero(hit)
                _unite(label, mine[i], theirs[j])
    tied = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
    return ids[tied], ids[label[tied]]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give components joined by the label pairs (a, b) their least label."""
    pairs = np.unique(np.column_stack((a, b)), axis=0)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    now = np.arange(len(label))
    for c in list(parent):
        now[c] = root(c)
    label[:] = now[label]


def cheapest(
    q: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], q_ids: np.ndarray, b_ids: np.ndarray, cost
) -> tuple[np.ndarray, np.ndarray]:
    """The row of ``b`` of least cost for each row of ``q``, of equal ones that of the least id, and the cost.

    Each side holds centres, weights and scatters; ``cost`` (gap, both weights,
    both scatters) grows with the gap and the weights. A row does not meet its own id.
    """
    (x, wa, sa), (y, wb, sb) = q, b
    best, mate = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max)
    asked, base, product = Side(x, COST_TILE), Side(y, BASE_TILE), Products(x, y)
    floor = np.array([wb[r].min() for r in base.rows])
    order = np.argsort(b_ids)
    own = order[np.minimum(np.searchsorted(b_ids, q_ids, sorter=order), len(b_ids) - 1)]
    own = np.where(b_ids[own] == q_ids, own, -1)
    tile_of, place_of = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
    for t, columns in enumerate(base.rows):
        tile_of[columns], place_of[columns] = t, np.arange(len(columns))

    def measure(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for at in range(0, len(i), PAIRS):
            part = slice(at, at + PAIRS)
            a, c = i[part], j[part]
            gap = np.zeros(len(a))
            for step in np.ascontiguousarray((x[a] - y[c]).T):
                gap += step**2
            out[part] = cost(gap, wa[a], wb[c], sa[a], sb[c])
        return out

    def take(i: np.ndarray, j: np.ndarray) -> None:
        new, names = measure(i, j), b_ids[j]
        keep = np.lexsort((names, new, i))
        keep = keep[np.unique(i[keep], return_index=True)[1]]
        i, new, names = i[keep], new[keep], names[keep]
        better = (new < best[i]) | (new == best[i]) & (names < mate[i])
        best[i[better]], mate[i[better]] = new[better], names[better]

    for t, rows in enumerate(asked.rows):
        gap = box_gaps(asked, t, base, 2.0) ** 2
        # scatters only add to a cost
        least = cost(gap, wa[rows].min(), floor, 0.0, 0.0)
        for other in nearest_first(asked, t, base, gap):
            if least[other] > best[rows].max() * (1 + 1e-9):
                continue
            columns = base.rows[other]
            if product.finite:
                low = product.squares(rows, columns)
                low -= product.error[rows][:, None]
                low = cost(low, wa[rows][:, None], wb[columns][None, :], sa[rows][:, None], sb[columns][None, :])
            else:
                low = np.zeros((len(rows), len(columns)))
            mine = np.flatnonzero((own[rows] >= 0) & (tile_of[own[rows]] == other))
            low[mine, place_of[own[rows[mine]]]] = np.inf
            if np.isinf(best[rows]).any():
                pick = low.argmin(axis=1)
                some = np.flatnonzero(low[np.arange(len(rows)), pick] < np.inf)
                take(rows[some], columns[pick[some]])
            i, j = np.divmod(np.flatnonzero((low <= (best[rows] * (1 + 1e-12))[:, None]) & (low < np.inf)), len(columns))
            if len(i):
                take(rows[i], columns[j])
    return mate, best


def cheapest_few(
    q: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], q_ids: np.ndarray, b_ids: np.ndarray, cost, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers in ``b`` of about the ``k`` rows of least cost for each row of ``q``, their costs, and a cost that no other row is under.

    Sides and ``cost`` are those of ``cheapest``; places left free hold the number of rows of ``b``.
    """
    (x, wa, sa), (y, wb, sb) = q, b
    place, least, bound = np.full((len(x), k), len(y), np.int64), np.full((len(x), k), np.inf), np.full(len(x), np.inf)
    asked, base, product = Side(x, COST_TILE), Side(y, BASE_TILE), Products(x, y)
    floor = np.array([wb[r].min() for r in base.rows])
    where = {c: n for n, c in enumerate(b_ids.tolist())}
    own = np.array([where.get(c, -1) for c in q_ids.tolist()], np.int64)
    tile_of, place_of = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
    for t, columns in enumerate(base.rows):
        tile_of[columns], place_of[columns] = t, np.arange(len(columns))
    for t, rows in enumerate(asked.rows):
        gap = box_gaps(asked, t, base, 2.0) ** 2
        under = cost(gap, wa[rows].min(), floor, 0.0, 0.0)
        d, at = np.full((len(rows), k + 1), np.inf), np.full((len(rows), k + 1), len(y), np.int64)
        for other in nearest_first(asked, t, base, gap):
            if under[other] > d[:, -1].max() * (1 + 1e-9):
                continue
            columns = base.rows[other]
            if product.finite:
                low = product.squares(rows, columns)
                low -= product.error[rows][:, None]
            else:
                low = np.nan_to_num(_distances(x[rows], y[columns], 2.0) ** 2, nan=np.inf)
            low = cost(low, wa[rows][:, None], wb[columns][None, :], sa[rows][:, None], sb[columns][None, :])
            mine = np.flatnonzero((own[rows] >= 0) & (tile_of[own[rows]] == other))
            low[mine, place_of[own[rows[mine]]]] = np.inf
            near = np.flatnonzero(low < d[:, -1:])
            if len(near) > 4 * (k + 1) * len(rows):
                few = np.argpartition(low, min(k, len(columns) - 1), axis=1)[:, : k + 1]
                near = (few + np.arange(len(rows))[:, None] * len(columns)).ravel()
                near = near[low.ravel()[near] < np.inf]
            if len(near):
                i, j = np.divmod(near, len(columns))
                _insert(d, at, i, columns[j], low[i, j])
        bound[rows], place[rows] = d[:, k], at[:, :k]
    i, n = np.nonzero(place < len(y))
    j = place[i, n]
    gap = np.zeros(len(i))
    for step in range(x.shape[1]):
        gap += (x[i, step] - y[j, step]) ** 2
    least[i, n] = cost(gap, wa[i], wb[j], sa[i], sb[j])
    return place, least, bound


def lightest(
    q: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], limit: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the id of the row of ``b`` in another component that it reaches at the least height, and
    the height, or infinity if none is within ``limit``.

    Each side holds ids, vectors, core distances and components. A height is the
    greatest of the distance and both core distances; of equal ones that of the
    smaller lower id, then of the smaller upper id counts.
    """
    (q_ids, x, core_a, comp_a), (b_ids, y, core_b, comp_b) = q, b
    none = np.iinfo(np.int64).max
    best, lo, hi = limit.astype(float).copy(), np.full(len(x), none), np.full(len(x), none)
    # rows of the most frequent component are kept apart, as most of their tiles need not meet
    names, counts = np.unique(np.concatenate((comp_a, comp_b)), return_counts=True)
    main = names[counts.argmax()]
    apart = [[np.flatnonzero(c == main), np.flatnonzero(c != main)] for c in (comp_a, comp_b)]
    asked, base, product = Side(x, TILE, apart[0]), Side(y, BASE_TILE, apart[1]), Products(x, y)
    single = [comp_b[r[0]] if (comp_b[r] == comp_b[r[0]]).all() else None for r in base.rows]
    floor = np.array([core_b[r].min() for r in base.rows])
    for t, rows in enumerate(asked.rows):
        gap = np.maximum(box_gaps(asked, t, base, 2.0), floor)
        own = comp_a[rows]
        alone = own[0] if (own == own[0]).all() else None
        for other in nearest_first(asked, t, base, gap):
            columns = base.rows[other]
            if gap[other] > best[rows].max() * (1 + 1e-9) or alone is not None and alone == single[other]:
                continue
            if product.finite:
                if np.isinf(best[rows]).any():
                    foreign = own[:, None] != comp_b[columns][None, :]
                    squares = product.squares(rows, columns)
                    squares[~foreign] = np.inf
                    pick = np.maximum(squares, core_b[columns][None, :] ** 2).argmin(axis=1)
                    some = np.flatnonzero(np.isinf(best[rows]) & foreign[np.arange(len(rows)), pick])
                    _lighter(best, lo, hi, q, b, rows[some], columns[pick[some]])
                hits, _, _ = product.below(rows, columns, best[rows] ** 2 * (1 + 1e-9))
                i, j = np.divmod(hits, len(columns))
                foreign = own[i] != comp_b[columns[j]]
                i, j = i[foreign], j[foreign]
            else:
                i, j = np.nonzero(own[:, None] != comp_b[columns][None, :])
            fair = core_b[columns[j]] <= best[rows[i]]
            if fair.any():
                _lighter(best, lo, hi, q, b, rows[i[fair]], columns[j[fair]])
    found = lo < none
    return np.where(found, np.where(lo == q_ids, hi, lo), -1), np.where(found, best, np.inf)


def _lighter(best, lo, hi, q, b, i: np.ndarray, j: np.ndarray) -> None:
    """Enter the pairs (i, j) that are lighter than the best of their row of ``q``."""
    (q_ids, x, core_a, _), (b_ids, y, core_b, _) = q, b
    new = np.maximum(pair_distances(x, y, i, j, 2.0), np.maximum(core_a[i], core_b[j]))
    low, high = np.minimum(q_ids[i], b_ids[j]), np.maximum(q_ids[i], b_ids[j])
    keep = np.lexsort((high, low, new, i))
    keep = keep[np.unique(i[keep], return_index=True)[1]]
    i, new, low, high = i[keep], new[keep], low[keep], high[keep]
    better = (new < best[i]) | (new == best[i]) & ((low < lo[i]) | (low == lo[i]) & (high < hi[i]))
    best[i[better]], lo[i[better]], hi[i[better]] = new[better], low[better], high[better]
