"""Small dense kernels in numpy for one group at a time: linkage, spectral embedding, k-means, silhouette, merging, cliques.

They take what a query has aggregated to at most a few hundred items (signs, signatures, profiles), never rows of a corpus.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np


def canonical(labels: np.ndarray) -> np.ndarray:
    """Labels numbered by their first member."""
    seen: dict = {}
    return np.array([seen.setdefault(x, len(seen)) for x in labels], np.int64)


def linkage(distance: np.ndarray, k: int, method: str = "average") -> np.ndarray:
    """Agglomeration to k clusters by average, complete or Ward linkage (Lance and Williams); ties go to the first pair."""
    n = len(distance)
    d = distance.astype(float).copy() ** (2 if method == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    size, labels, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(max(0, n - max(1, k))):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        a, b = size[i], size[j]
        if method == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        else:
            new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)
        new[~alive] = np.inf
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        labels[labels == j] = i
    return canonical(labels)


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    groups = np.unique(labels)
    if not 1 < len(groups) < len(labels):
        return 0.0
    member = labels[:, None] == groups[None]
    sums, sizes = distance @ member, member.sum(0)
    own = np.argmax(member, 1)
    rows = np.arange(len(labels))
    alone = sizes[own] == 1
    a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[rows, own] = np.inf
    b = means.min(1)
    s = np.where(alone, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-12))
    return float(s.mean())


def kmeans(x: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Deterministic: starts from the point nearest the mean, then always the farthest from those chosen."""
    centres = [x[np.argmin(((x - x.mean(0)) ** 2).sum(1))]]
    while len(centres) < k:
        centres.append(x[np.argmax(np.min([((x - c) ** 2).sum(1) for c in centres], 0))])
    c, labels = np.array(centres), np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if (new == labels).all():
            break
        labels = new
        c = np.array([x[labels == i].mean(0) if (labels == i).any() else c[i] for i in range(k)])
    return canonical(labels)


def laplacian_axes(affinity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the normalised Laplacian, smallest first; each vector's largest entry is positive."""
    degree = affinity.sum(1)
    root = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-12)), 0)
    values, vectors = np.linalg.eigh(np.eye(len(affinity)) - root[:, None] * affinity * root[None])
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(vectors))] + 1e-300)


def spectral(affinity: np.ndarray, k: int | None = None, least: int = 3, most: int = 20) -> tuple[np.ndarray, int]:
    """Labels and the number of clusters: the largest gap of the eigenvalues between least and most, unless the silhouette's choice is
    more than three away from it."""
    n = len(affinity)
    if n <= 2:
        return np.zeros(n, np.int64), min(n, 1)
    values, vectors = laplacian_axes(affinity)

    def cut(m: int) -> np.ndarray:
        x = vectors[:, :m]
        return kmeans(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), m)

    if k is None:
        choices = range(min(least, n - 1), min(most, n - 1) + 1)
        gap = max(choices, key=lambda m: (values[min(m, n - 1)] - values[m - 1], -m))
        distance = affinity.max() - affinity
        best = max(choices, key=lambda m: (round(silhouette(distance, cut(m)), 12), -m))
        k = gap if abs(gap - best) <= 3 else best
    return cut(k), k


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted for chance; 0 for fewer than two items."""
    if len(a) < 2:
        return 0.0
    table = np.zeros((len(set(a)), len(set(b))))
    np.add.at(table, (canonical(a), canonical(b)), 1)
    pairs = lambda x: float((x * (x - 1) / 2).sum())
    both, ra, rb, every = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    chance = ra * rb / every
    return 0.0 if (ra + rb) / 2 == chance else (both - chance) / ((ra + rb) / 2 - chance)


def merge_groups(groups: list[frozenset], threshold: float, most: int) -> list[int]:
    """Greedy: the most alike two groups (Jaccard; two empty ones are alike) are united while they reach the threshold or more than
    `most` are left. Gives each group's number in the end."""
    n, members = len(groups), {i: [i] for i in range(len(groups))}
    at = {x: k for k, x in enumerate(sorted(set().union(*groups)))}
    has = np.zeros((n, -(-len(at) // 64)), np.uint64)  # a bit an element
    for i, g in enumerate(groups):
        bits = np.zeros(has.shape[1] * 64, np.uint8)
        bits[[at[x] for x in g]] = 1
        has[i] = np.packbits(bits).view(np.uint64)
    size = np.array([len(g) for g in groups])

    def alike(rows: np.ndarray, i: int) -> np.ndarray:
        both = np.bitwise_count(has[rows] & has[i]).sum(1, dtype=int)
        either = size[rows] + size[i] - both
        return np.where(either > 0, both / np.maximum(either, 1), 1.0)

    score = np.full((n, n), -1.0)  # of pairs i < j that are left
    for i in range(n - 1):
        score[i, i + 1 :] = alike(np.arange(i + 1, n), i)
    best, first = (score.max(1), score.argmax(1)) if n else (np.zeros(0), np.zeros(0, int))  # of each row, and where
    alive = np.ones(n, bool)
    while len(members) > 1:
        i = int(np.argmax(best))
        if best[i] < threshold and len(members) <= most:
            break
        j = int(first[i])
        has[i] |= has[j]
        size[i] = np.bitwise_count(has[i]).sum()
        members[i] += members.pop(j)
        alive[j], best[j] = False, -1
        score[j], score[:, j] = -1, -1
        left = np.flatnonzero(alive)
        new = alike(left, i)
        score[left[left < i], i], score[i, left[left > i]] = new[left < i], new[left > i]
        stale = alive & ((first == i) | (first == j))  # only these rows have lost their best
        stale[i] = True
        best[stale], first[stale] = score[stale].max(1), score[stale].argmax(1)
        nearer = alive & ((score[:, i] > best) | ((score[:, i] == best) & (i < first)))
        best[nearer], first[nearer] = score[nearer, i], i
    members = list(members.values())
    out = [0] * len(groups)
    for number, m in enumerate(members):
        for i in m:
            out[i] = number
    return out


def densest_clique(items: list, weight: dict, enrichment: dict, least: int = 3, most: int = 7, exhaustive: int = 16) -> tuple[tuple, float]:
    """The set of least..most items of highest density times geometric mean of enrichment; all sets are tried for few items, else
    sets grow greedily from the fifteen most enriched."""

    def value(s: tuple) -> float:
        edges = sum((min(p), max(p)) in weight for p in combinations(s, 2))
        density = edges / (len(s) * (len(s) - 1) / 2)
        return density * float(np.exp(np.mean([np.log(max(enrichment.get(x, 0.01), 0.01)) for x in s])))

    items = sorted(items)
    if len(items) < least:
        return tuple(items), 0.0
    if len(items) <= exhaustive:
        found = (s for size in range(least, most + 1) for s in combinations(items, size))
    else:
        found = []
        for seed in sorted(items, key=lambda x: (-enrichment.get(x, 0), x))[:15]:
            s = (seed,)
            while len(s) < most:
                s = tuple(sorted((*s, max((x for x in items if x not in s), key=lambda x: (value((*s, x)), x)))))
                if len(s) >= least:
                    found.append(s)
    best = max(found, key=lambda s: (round(value(s), 12), s))
    return best, value(best)


def pack_rows(order: list, column: dict, weight: dict, least: float = 1.0) -> dict:
    """Greedy rows: each item in turn joins the row it has most weight with that lacks its column, if that is at least `least`, else
    it opens one."""
    rows: list[list] = []
    out = {}
    for x in order:
        fits = [(sum(weight.get((min(x, y), max(x, y)), 0) for y in r), -i) for i, r in enumerate(rows) if column[x] not in {column[y] for y in r}]
        top = max(fits, default=(0, 0))
        if fits and top[0] >= least:
            rows[-top[1]].append(x)
            out[x] = -top[1]
        else:
            out[x] = len(rows)
            rows.append([x])
    return out


def anti_correlation(right: np.ndarray, left: np.ndarray, weight: float = 0.15) -> np.ndarray:
    """Affinity of signs that share a vowel: alike in what follows, less so in what precedes; put between 0 and 1, diagonal 0."""
    signed = right - weight * left
    spread = signed.max() - signed.min() if len(signed) else 0
    out = (signed - signed.min()) / spread if spread > 0 else np.ones_like(signed)
    np.fill_diagonal(out, 0)
    return out


def anchored_columns(rows: np.ndarray, affinity: np.ndarray, anchors: dict[int, int], columns: int, isolated: np.ndarray | None = None, frequency: np.ndarray | None = None) -> np.ndarray:
    """The column (vowel) of each sign, -1 for isolated ones and those without a row.

    An anchor's column is given. Any other sign goes, in order, by the first of these that says anything: least mean alternation with the
    anchors of its own row (columns without such anchors count as no alternation); largest sum of weighted Jaccards with the anchors of other
    rows; the column least filled so far. Ties go to the lower column. Without any anchors signs of a row are dealt in turn by
    frequency, the earlier sign first among equals.
    """
    n = len(rows)
    apart = np.zeros(n, bool) if isolated is None else isolated
    found = np.full(n, -1)
    fixed = {i: c for i, c in anchors.items() if not apart[i] and 0 <= c < columns}
    if not fixed:
        seen = np.zeros(n) if frequency is None else frequency
        for row in sorted(set(rows[(rows >= 0) & ~apart].tolist())):
            members = sorted(np.flatnonzero((rows == row) & ~apart).tolist(), key=lambda i: (-seen[i], i))
            found[members] = np.arange(len(members)) % columns
        return found
    at, of = np.array(sorted(fixed)), np.array([fixed[i] for i in sorted(fixed)])
    found[at] = of
    for i in np.flatnonzero((found < 0) & (rows >= 0) & ~apart):
        mine = rows[at] == rows[i]
        met = np.bincount(of[mine], affinity[i, at[mine]], columns) / np.maximum(np.bincount(of[mine], minlength=columns), 1)
        if met.sum() > 0:
            found[i] = met.argmin()
            continue
        other = at[~mine]
        whole = np.maximum(affinity[i], affinity[other]).sum(1)
        alike = np.where(whole > 0, np.minimum(affinity[i], affinity[other]).sum(1) / np.where(whole > 0, whole, 1), 0)
        near = np.bincount(of[~mine], alike, columns)
        found[i] = near.argmax() if near.sum() > 0 else np.bincount(found[found >= 0], minlength=columns).argmin()
    return found
