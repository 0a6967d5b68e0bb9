"""Small numpy helpers, each on one bounded block: a grid, a batch of rows or one image's masks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def top_k(similarity: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of each row's k greatest, by value, then by id. Only rows with equal values at the edge are looked at one by one."""
    n = similarity.shape[1]
    k = min(k, n)
    at = np.argpartition(-similarity, k - 1, axis=1)[:, :k] if 0 < k < n else np.broadcast_to(np.arange(k), (len(similarity), k))
    value = np.take_along_axis(similarity, at, 1)
    if 0 < k < n:
        edge = value.min(1, keepdims=True)
        for i in np.flatnonzero((similarity >= edge).sum(1) > k):
            c = np.flatnonzero(similarity[i] >= edge[i])
            at[i] = c[np.lexsort((ids[c], -similarity[i, c]))[:k]]
        value = np.take_along_axis(similarity, at, 1)
    order = np.lexsort((ids[at], -value), axis=-1)
    return np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)


#: Bank rows that a chunk of queries meets at once.
BANK_ROWS = 4096


def nearest_rows(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values of the k greatest products of each row of ``x`` with the rows of ``y``, to 12 decimals, by value, then by id.

    ``ids`` ascend. ``y`` comes in blocks of bounded rows, whatever its size; of a later block only products above a row's
    k-th so far are looked at, since equal ones have greater ids.
    """
    k, step = min(k, len(y)), max(BANK_ROWS, k)
    at, value = top_k(np.round(x @ y[:step].T, 12), k, ids[:step])
    found = ids[:step][at]
    for start in range(step, len(y), step):
        s = x @ y[start : start + step].T
        row, col = np.nonzero(s > (value[:, -1] + 4e-13)[:, None])
        if not len(row):
            continue
        v = np.round(s[row, col], 12)
        new = v > value[row, -1]
        row, more, v = row[new], ids[start + col[new]], v[new]
        own = np.unique(row)
        rows, every, values = np.concatenate((np.repeat(own, k), row)), np.concatenate((found[own].ravel(), more)), np.concatenate((value[own].ravel(), v))
        order = np.lexsort((every, -values, rows))
        first = np.searchsorted(rows[order], own)[:, None] + np.arange(k)
        found[own], value[own] = every[order][first], values[order][first]
    return found, value


def greatest(x: np.ndarray, parts: Iterable[np.ndarray], k: int) -> np.ndarray:
    """The k greatest products of each row of ``x`` with the rows of all ``parts``, to 12 decimals; one part is held at a time.

    A block of products is small enough for a cache; only rows with one above their k-th so far are looked at again.
    Products that are no numbers are left out; with fewer than k others, the rest is minus infinity.
    """
    value = np.full((len(x), k), -np.inf)  # ascending
    for y in parts:
        y = y[~np.isnan(y).any(1)]
        for i in range(0, len(x), 128):
            q, own = x[i : i + 128], value[i : i + 128]
            for start in range(0, len(y), 1024):
                s = q @ y[start : start + 1024].T
                new = np.flatnonzero(s.max(1) > own[:, 0])
                if len(new):
                    own[new] = np.sort(np.partition(np.hstack((own[new], s[new])), -k, axis=1)[:, -k:], axis=1)
    return np.round(value[:, ::-1], 12)


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of doubles."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def k_centre(x: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """Greedy k-centre on cosine distance of unit rows: positions of n rows; ties go to the first."""
    if n >= len(x):
        return np.arange(len(x))
    chosen = [first]
    far = 1 - x @ x[first]
    for _ in range(n - 1):
        far[chosen[-1]] = -1
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    return np.array(chosen)


def k_centre_cover(x: np.ndarray, n: int, weight: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, ...]:
    """Greedy k-centre of unit rows from the first, on cosine distance to 12 decimals; ties go to the first.

    Positions of the centres, the distance at which each was chosen (2 for the first), the sum of ``weight`` over the rows
    nearest to it, and the largest angle of these plus their own ``cover``.
    """
    n = min(n, len(x))
    if not n:
        return np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0)
    chosen, far = [0], [2.0]
    least, owner = np.round(1 - x @ x[0], 12), np.zeros(len(x), int)
    free = least.copy()
    free[0] = -1
    for k in range(1, n):
        i = int(free.argmax())
        chosen.append(i)
        far.append(max(0.0, float(free[i])))
        d = np.round(1 - x @ x[i], 12)
        closer = d < least
        owner[closer] = k
        least = np.minimum(least, d)
        free = np.minimum(free, d)
        free[i] = -1
    angle = np.arccos(np.clip(1 - least, -1, 1))
    owner[chosen], angle[chosen] = np.arange(n), 0
    radius = np.zeros(n)
    np.maximum.at(radius, owner, angle + cover)
    return np.array(chosen), np.array(far), np.bincount(owner, weight, n), radius


def box_smooth(grid: np.ndarray, size: int = 3) -> np.ndarray:
    """Mean over the in-bounds part of a size x size box, for an (H, W, D) grid."""
    h, w = grid.shape[:2]
    r = size // 2
    c = np.zeros((h + 1, w + 1, *grid.shape[2:]))
    c[1:, 1:] = grid.cumsum(0).cumsum(1)
    a, b = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    p, q = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    total = c[np.ix_(b, q)] - c[np.ix_(a, q)] - c[np.ix_(b, p)] + c[np.ix_(a, p)]
    return total / ((b - a)[:, None] * (q - p)[None, :])[..., None]


def _near(eps: float, chebyshev: bool = False) -> list[tuple[int, int]]:
    """Offsets of the grid cells within ``eps`` of a cell, itself included."""
    r = int(np.floor(eps))
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if (max(abs(a), abs(b)) if chebyshev else np.hypot(a, b)) <= eps]


def link_cells(cells: np.ndarray, eps: float, chebyshev: bool = False) -> np.ndarray:
    """Component number of each (row, col) cell, cells within ``eps`` linked; numbered by first cell."""
    return _spread(cells, _near(eps, chebyshev), np.ones(len(cells), bool))


def dbscan_cells(cells: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """DBSCAN of grid cells: -1 is noise; a border cell joins the first core cell that reaches it. Neighbours are looked up by cell."""
    near, where = _near(eps), {tuple(c) for c in cells.tolist()}
    core = np.array([sum((y + a, x + b) in where for a, b in near) >= min_samples for y, x in cells.tolist()], bool)
    return _spread(cells, near, core)


def _spread(cells: np.ndarray, near: list[tuple[int, int]], core: np.ndarray) -> np.ndarray:
    """Numbers of clusters grown from core cells, by first core cell; -1 for cells that none reaches."""
    label, n = np.full(len(cells), -1), 0
    at = cells.tolist()
    where = {tuple(c): i for i, c in enumerate(at)}
    for i in np.flatnonzero(core).tolist():
        if label[i] >= 0:
            continue
        label[i], todo = n, [i]
        while todo:
            k = todo.pop()
            if not core[k]:
                continue
            y, x = at[k]
            for a, b in near:
                j = where.get((y + a, x + b))
                if j is not None and label[j] < 0:
                    label[j] = n
                    todo.append(j)
        n += 1
    return label


def linkage_labels(distance: np.ndarray, method: str, threshold: float | None = None, k: int | None = None) -> np.ndarray:
    """Agglomerative clusters (single, average or complete) down to ``k`` clusters or up to a distance threshold, by first member.

    Chains of nearest neighbours find the merges in quadratic time: a pair that is each other's nearest merges at once,
    whatever else is nearer elsewhere, and the merges are taken by height afterwards. An infinite distance is never merged.
    """
    d = distance.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, height, alive = np.ones(n), np.full(n, -np.inf), np.ones(n, bool)
    merges, chain = [], []
    for _ in range(n - 1):
        chain = chain or [int(alive.argmax())]
        while True:
            row = d[chain[-1]]
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                break
            chain.append(j)
        j, i = sorted((chain.pop(), chain.pop()), reverse=True)
        h = max(d[i, j], height[i], height[j])
        merges.append((h, i, j))
        merged = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])}[method]
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        alive[j], height[i] = False, h
        size[i] += size[j]
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for h, i, j in sorted(merges, key=lambda m: m[0])[: n - (k or 1)]:
        if not np.isfinite(h) or (threshold is not None and h > threshold):
            break
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    _, label = np.unique([root(i) for i in range(n)], return_inverse=True)  # roots are first members
    return label.astype(np.int64).reshape(n)


def spectral_labels(x: np.ndarray, k: int, neighbours: int, rounds: int = 60) -> np.ndarray:
    """Spectral clusters of unit rows, by first member: ``k`` groups in the leading vectors of a sparse neighbour graph.

    Each row is linked to its ``neighbours`` nearest (cosine, never negative), either way; subspace iteration from a fixed
    start finds the leading vectors of the degree-normalised graph, whose rows are grouped by k-means from spread starts.
    """
    n = len(x)
    if n <= k:
        return np.arange(n)
    links: dict[tuple[int, int], float] = {}
    for a in range(0, n, 512):
        s = np.round(x[a : a + 512] @ x.T, 12)
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        at, value = top_k(s, min(neighbours, n - 1), np.arange(n))
        for i, (row, v) in enumerate(zip(at.tolist(), value.tolist(), strict=True), a):
            for j, w in zip(row, v, strict=True):
                links[min(i, j), max(i, j)] = max(w, 0.0)
    ij, w = np.array(list(links)), np.array(list(links.values()))
    degree = np.bincount(ij[:, 0], w, n) + np.bincount(ij[:, 1], w, n) + 1e-12
    w = w / np.sqrt(degree[ij[:, 0]] * degree[ij[:, 1]])
    order = np.concatenate((ij, ij[:, ::-1]))
    weight = np.concatenate((w, w))
    by = np.lexsort((order[:, 1], order[:, 0]))
    order, weight = order[by], weight[by]
    starts = np.searchsorted(order[:, 0], np.arange(n))
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(n, k)))
    for _ in range(rounds):
        step = np.add.reduceat(np.vstack((weight[:, None] * q[order[:, 1]], np.zeros((1, k)))), starts, axis=0)
        step[np.diff(np.append(starts, len(order))) == 0] = 0
        q, _ = np.linalg.qr(step + q)  # shifted, so that no vector of a negative value leads
    rows = unit_rows(q)
    centres = rows[k_centre_cover(rows, k, np.ones(n), np.zeros(n))[0]]
    label = np.zeros(n, int)
    for _ in range(50):
        label = ((rows[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        new = np.array([rows[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse.reshape(n)]


def open_mask(mask: np.ndarray, k: int, inside: np.ndarray | None = None) -> np.ndarray:
    """Binary opening with a k x k square; cells that are not ``inside`` count as those beyond the edge, and are false."""
    inside = np.ones(mask.shape, bool) if inside is None else inside
    return _window(_window(mask | ~inside, k, np.min, False) & inside, k, np.max, True) & inside


def close_mask(mask: np.ndarray, times: int, inside: np.ndarray | None = None) -> np.ndarray:
    """Binary closing with a 3 x 3 square: so many dilations, then so many erosions; ``inside`` is as in open_mask()."""
    inside = np.ones(mask.shape, bool) if inside is None else inside
    for _ in range(times):
        mask = _window(mask & inside, 3, np.max, True) & inside
    for _ in range(times):
        mask = _window(mask | ~inside, 3, np.min, True, pad=True) & inside
    return mask


def _window(mask: np.ndarray, k: int, f, flip: bool, pad: bool = False) -> np.ndarray:
    """Separable running minimum or maximum; beyond the edge lies ``pad`` (minimum: true)."""
    before = (k - 1) // 2 if not flip else k // 2
    fill = f is np.min if not pad else True
    for axis in (0, 1):
        width = [(0, 0), (0, 0)]
        width[axis] = (before, k - 1 - before)
        mask = f(np.lib.stride_tricks.sliding_window_view(np.pad(mask, width, constant_values=fill), k, axis=axis), axis=-1)
    return mask


def rle_encode(mask: np.ndarray) -> list[int]:
    """Row-major run lengths from the false count on; empty -> []."""
    flat = np.asarray(mask, bool).ravel()
    if not flat.size:
        return []
    cuts = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate(([0], cuts, [flat.size]))).tolist()
    return ([0] if flat[0] else []) + runs


def rle_decode(shape: tuple[int, int], runs: list[int]) -> np.ndarray:
    return np.repeat(np.arange(len(runs)) % 2 == 1, runs).reshape(shape)


def resize_nearest(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest source pixel of each target pixel's centre."""
    h, w = mask.shape
    y = np.minimum(((np.arange(height) + 0.5) * h / height).astype(int), h - 1)
    x = np.minimum(((np.arange(width) + 0.5) * w / width).astype(int), w - 1)
    return mask[np.ix_(y, x)]


def resize_bilinear(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with half-pixel centres, clamped at the border."""

    def axis(n, to):
        at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n - 1), at - lo

    (a, b, t), (c, d, u) = axis(grid.shape[0], height), axis(grid.shape[1], width)
    top = grid[np.ix_(a, c)] * (1 - u) + grid[np.ix_(a, d)] * u
    low = grid[np.ix_(b, c)] * (1 - u) + grid[np.ix_(b, d)] * u
    return top * (1 - t[:, None]) + low * t[:, None]


def mask_share(mask: np.ndarray, grid_h: int, grid_w: int) -> np.ndarray:
    """Share of true pixels in each cell of a mask whose sides the grid divides."""
    h, w = mask.shape
    return mask.reshape(grid_h, h // grid_h, grid_w, w // grid_w).mean((1, 3))


def greedy_keep(iou: dict[tuple[int, int], float], order: list[int], limit: float, strict: bool) -> list[int]:
    """Keep in order what overlaps no kept one by more than (or, if strict, at least) ``limit``."""
    kept: list[int] = []
    for i in order:
        over = [iou.get((min(i, j), max(i, j)), 0.0) for j in kept]
        if all(v < limit if strict else v <= limit for v in over):
            kept.append(i)
    return kept


def greedy_match(pred: list[int], truth: list[int], iou: dict[tuple[int, int], float], accept: float) -> list[tuple[int, int, float]]:
    """Predictions in order take the unmatched truth of greatest IoU (the first of equals), if it reaches ``accept``."""
    free, out = list(truth), []
    for p in pred:
        best, value = None, 0.0
        for t in free:
            v = iou.get((p, t), 0.0)
            if v > value:
                best, value = t, v
        if best is not None and value >= accept:
            out.append((p, best, value))
            free.remove(best)
    return out


def principal(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, k components (rows; the greatest loading positive) and variances of rows."""
    mean = x.mean(0)
    _, s, v = np.linalg.svd(x - mean, full_matrices=False)
    v = v[:k] * np.sign(v[:k][np.arange(len(v[:k])), np.abs(v[:k]).argmax(1)])[:, None]
    return mean, v, s[:k] ** 2 / max(len(x) - 1, 1)
