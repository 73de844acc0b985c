"""Gaussian one-class boundary (support vector data description) inside one task.

Only the arithmetic of a bounded block of rows lives here; Spark decides which
rows meet which model. Rows are tested against the current model a block at a
time, so that the many rows already inside the boundary cost one matrix product
and only the few that lie outside touch the model.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Similarity limits and the guard against division by zero.
EPS_NEAR = 1e-8
EPS_FAR = 1e-8
TINY = 1e-12

_MIN_BLOCK, _MAX_BLOCK = 128, 4096
# From this many support vectors on, changes of the inverse are applied a block of rows at a time ...
WIDE = 512
_WIDE_BLOCK, _STRIP = 64, 128
# ... and above this many a model row leaves it out: whoever continues the model inverts its similarities anew.
INVERSE_ROWS = 2048
# Bytes of an inverse that stay in memory; a larger one lies in a file, of which blocks of more rows make fewer passes.
HELD_BYTES = 160 << 20
_FILE_BLOCK, _LIKELY = 256, 96
# Similarities of a block of rows to many support vectors.
_BLOCK_CELLS = 2_500_000


def similarity(x: np.ndarray, sv: np.ndarray, sigma: float) -> np.ndarray:
    """exp(-|x - s|^2 / (2 sigma^2)) for every row of ``x`` and of ``sv``."""
    if x.shape[1] <= 12:
        gap = np.zeros((len(x), len(sv)))
        for j in range(x.shape[1]):
            step = x[:, j, None] - sv[None, :, j]
            gap += step * step
    else:
        mid = sv.mean(axis=0)
        a, b = x - mid, sv - mid
        gap = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
        np.maximum(gap, 0.0, out=gap)
    gap *= -0.5 / (sigma * sigma)
    return np.exp(gap, out=gap)


def judge(sims: np.ndarray, alpha: np.ndarray, radius: float, near=EPS_NEAR, far=EPS_FAR):
    """(score, raw score, best similarity); very distant and duplicate rows score -1."""
    best = sims.max(axis=1)
    raw = radius - sims @ alpha
    return np.where((best < far) | (best > 1.0 - near), -1.0, raw), raw, best


class Strips:
    """A symmetric matrix in strips of rows, each up to the end of its diagonal block; above ``HELD_BYTES`` in a file.

    The file has no name and goes with its owner; one strip of it is in memory at a time. Places past the matrix are zero.
    """

    def __init__(self, square: np.ndarray | None = None):
        self.parts: list[np.ndarray] = []
        self.count, self.file = 0, None
        if square is not None:
            self._reach(len(square))
            for i, a, z in self._spans(len(square)):
                strip = np.zeros((_STRIP, a + _STRIP))
                strip[: z - a, :z] = square[a:z, :z]
                self._put(i, strip)

    @staticmethod
    def _spans(size: int) -> Iterator[tuple[int, int, int]]:
        return ((i, a, min(a + _STRIP, size)) for i, a in enumerate(range(0, size, _STRIP)))

    @staticmethod
    def _start(i: int) -> int:
        """Bytes before strip ``i``."""
        return 4 * _STRIP * _STRIP * i * (i + 1)

    def _reach(self, size: int) -> None:
        count = -(-size // _STRIP)
        if self.file is None and self._start(count) > HELD_BYTES:
            self.file = tempfile.TemporaryFile(buffering=0)
            for i, strip in enumerate(self.parts):
                self._put(i, strip)
            self.parts = []
        if self.file is not None:
            self.file.truncate(self._start(max(count, self.count)))
        else:
            self.parts += [np.zeros((_STRIP, (i + 1) * _STRIP)) for i in range(self.count, count)]
        self.count = max(count, self.count)

    def _read(self, at: int, n: int) -> np.ndarray:
        out = np.empty(n)
        left = memoryview(out).cast("B")
        self.file.seek(at)
        while left:
            got = self.file.readinto(left)
            if not got:
                raise OSError("the file of an inverse ends early")
            left = left[got:]
        return out

    def _get(self, i: int) -> np.ndarray:
        if self.file is None:
            return self.parts[i]
        return self._read(self._start(i), _STRIP * _STRIP * (i + 1)).reshape(_STRIP, -1)

    def _put(self, i: int, strip: np.ndarray) -> None:
        if self.file is None:
            self.parts[i] = strip
            return
        left = memoryview(strip).cast("B")
        self.file.seek(self._start(i))
        while left:
            left = left[self.file.write(left) :]

    def copy(self) -> Strips:
        out = Strips()
        out._reach(self.count * _STRIP)
        for i in range(self.count):
            out._put(i, self._get(i).copy())
        return out

    def square(self, size: int) -> np.ndarray:
        out = np.empty((size, size))
        for i, a, z in self._spans(size):
            out[a:z, :z] = self._get(i)[: z - a, :z]
            out[:a, a:z] = out[a:z, :a].T
        return out

    def times(self, x: np.ndarray, wanted: np.ndarray | None = None):
        """``x`` times the matrix, and the rows ``wanted`` of it; one pass."""
        size = x.shape[1]
        wanted = np.zeros(0, int) if wanted is None else wanted
        out, rows = np.zeros(x.shape), np.zeros((len(wanted), size))
        for i, a, z in self._spans(size):
            part = self._get(i)[: z - a, :z]
            out[:, a:z] += x[:, :z] @ part.T
            out[:, :a] += x[:, a:z] @ part[:, :a]
            mine = (wanted >= a) & (wanted < z)
            rows[mine, :z] = part[wanted[mine] - a]
            above = wanted < a
            rows[above, a:z] = part[:, wanted[above]].T
        return out, rows

    def row(self, j: int, size: int) -> np.ndarray:
        out = np.empty(size)
        for i, a, z in self._spans(size):
            wide = (i + 1) * _STRIP
            if z <= j:
                continue
            if a <= j:
                own = self.parts[i][j - a] if self.file is None else self._read(self._start(i) + 8 * (j - a) * wide, wide)
                out[:z] = own[:z]
            elif self.file is None:
                out[a:z] = self.parts[i][: z - a, j]
            else:
                with mmap.mmap(self.file.fileno(), 8 * _STRIP * wide, offset=self._start(i), access=mmap.ACCESS_READ) as held:
                    out[a:z] = np.ndarray((_STRIP, wide), buffer=held)[: z - a, j]
        return out

    def sums(self, size: int) -> np.ndarray:
        out = np.zeros(size)
        for i, a, z in self._spans(size):
            part = self._get(i)[: z - a, :z]
            out[a:z] += part.sum(axis=1)
            out[:a] += part[:, :a].sum(axis=0)
        return out

    def add(self, u: np.ndarray, d: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Add u^T diag(d) u, empty the places ``gone``; the sums of the rows."""
        size = u.shape[1]
        self._reach(size)
        sums = np.zeros(size)
        for i, a, z in self._spans(size):
            strip = self._get(i)
            part = strip[: z - a, :z]
            part += (u[:, a:z] * d[:, None]).T @ u[:, :z]
            part[gone[(gone >= a) & (gone < z)] - a] = 0.0
            part[:, gone[gone < z]] = 0.0
            self._put(i, strip)
            sums[a:z] += part.sum(axis=1)
            sums[:a] += part[:, :a].sum(axis=0)
        return sums

    def close(self, at: np.ndarray) -> None:
        """Keep the places ``at``, in rising order."""
        for i in range(self.count):
            lo, hi = np.searchsorted(at, [i * _STRIP, (i + 1) * _STRIP])
            if lo == hi:
                continue
            taken = self._get(i)[at[lo:hi] - i * _STRIP][:, at[:hi]]
            while lo < hi:  # rows only move up, to strips already read
                j, n = lo // _STRIP, lo % _STRIP
                end = min((j + 1) * _STRIP, hi)
                if not n:
                    fresh = np.zeros((_STRIP, (j + 1) * _STRIP))
                fresh[n : n + end - lo, :end] = taken[: end - lo, :end]
                if end == (j + 1) * _STRIP or end == len(at):
                    own = fresh[:, j * _STRIP :]
                    own[:] = np.tril(own) + np.tril(own, -1).T
                    self._put(j, fresh)
                taken, lo = taken[end - lo :], end
        self.count = -(-len(at) // _STRIP)
        if self.file is None:
            del self.parts[self.count :]
        else:
            self.file.truncate(self._start(self.count))

    @classmethod
    def inverse_of(cls, sv: np.ndarray, sigma: float) -> Strips:
        """The inverse of the similarities of ``sv``, bordered by a strip of rows at a time."""
        out = cls()
        for a in range(0, len(sv), _STRIP):
            new = sv[a : a + _STRIP]
            z = a + len(new)
            corner = similarity(new, new, sigma)
            turned = np.zeros((len(new), 0))
            if a:
                known = similarity(new, sv[:a], sigma)
                turned = out.times(known)[0]
                corner = corner - turned @ known.T
            # eigenvectors of the corner make the border a sum of outer products, as any other change
            values, axes = np.linalg.eigh((corner + corner.T) / 2)
            values = np.where(np.abs(values) < TINY, TINY, values)
            out.add(np.hstack([axes.T @ turned, -axes.T]), 1.0 / values, np.zeros(0, int))
        return out


@dataclass
class Boundary:
    """Support vectors, weights, inverse similarity matrix (:class:`Strips` of many vectors) and radius term."""

    sv: np.ndarray
    sigma: float
    alpha: np.ndarray = field(default_factory=lambda: np.ones(1))
    inverse: np.ndarray | Strips = field(default_factory=lambda: np.ones((1, 1)))
    radius: float = 1.0
    seen: int = 1
    near: float = EPS_NEAR
    far: float = EPS_FAR

    @classmethod
    def start(cls, first_row, sigma: float, near: float = EPS_NEAR, far: float = EPS_FAR) -> Boundary:
        return cls(sv=np.array(first_row, dtype=float).reshape(1, -1), sigma=float(sigma), near=near, far=far)

    @property
    def size(self) -> int:
        return len(self.alpha)

    def copy(self) -> Boundary:
        return Boundary(
            self.sv.copy(), self.sigma, self.alpha.copy(), self.inverse.copy(), self.radius, self.seen, self.near, self.far
        )

    def sims(self, x: np.ndarray) -> np.ndarray:
        return similarity(np.atleast_2d(x), self.sv, self.sigma)

    def score(self, x: np.ndarray) -> np.ndarray:
        return judge(self.sims(x), self.alpha, self.radius, self.near, self.far)[0]

    # -- structure changes -------------------------------------------------

    def grow(self, row: np.ndarray, sims: np.ndarray) -> None:
        """Border the inverse with a new support vector; weights become row sums."""
        self._whole()
        col = self.inverse @ sims
        gain = 1.0 - sims @ col
        if abs(gain) < TINY:
            gain = TINY
        k = self.size
        bigger = np.empty((k + 1, k + 1))
        bigger[:k, :k] = self.inverse + np.outer(col, col) / gain
        bigger[k, :k] = bigger[:k, k] = -col / gain
        bigger[k, k] = 1.0 / gain
        self.inverse = bigger
        self.alpha = bigger.sum(axis=1)
        self.sv = np.vstack([self.sv, row])

    def _whole(self) -> None:
        if isinstance(self.inverse, Strips):
            self.inverse = self.inverse.square(self.size)

    def prune(self) -> list[int]:
        """Drop the most negative weight until none is left; positions at drop time."""
        self._whole()
        dropped: list[int] = []
        while self.size:
            worst = int(self.alpha.argmin())
            if self.alpha[worst] >= 0:
                break
            keep = np.delete(np.arange(self.size), worst)
            pivot = self.inverse[worst, worst]
            if abs(pivot) < TINY:
                pivot = TINY
            edge = self.inverse[keep, worst]
            self.inverse = self.inverse[np.ix_(keep, keep)] - np.outer(edge, edge) / pivot
            self.alpha = self.inverse.sum(axis=1)
            self.sv = self.sv[keep]
            dropped.append(worst)
        return dropped

    def settle(self) -> None:
        """Radius from the weight total, then weights scaled to sum to one."""
        total = self.alpha.sum()
        if abs(total) < TINY:
            self.radius = 0.0
        else:
            self.radius = 1.0 / total
            self.alpha = self.alpha / total

    def accept(self, row: np.ndarray, sims: np.ndarray | None = None):
        """Take ``row`` in: grow, prune, retry what was pruned, settle.

        Returns (positions pruned, rows retried successfully).
        """
        self.grow(row, self.sims(row)[0] if sims is None else sims)
        pruned: list[int] = []
        back: list[np.ndarray] = []
        if self.alpha.min() < 0:
            held = self.sv
            order = np.arange(self.size)
            pruned = self.prune()
            gone = []
            for at in pruned:
                gone.append(order[at])
                order = np.delete(order, at)
            for i in gone:
                sims_i = self.sims(held[i])
                if judge(sims_i, self.alpha, self.radius, self.near, self.far)[0][0] > 0:
                    self.grow(held[i], sims_i[0])
                    back.append(held[i])
        self.settle()
        return pruned, back

    # -- a pass over rows --------------------------------------------------

    def learn(self, rows: np.ndarray, trace: list | None = None) -> dict[str, int]:
        """Offer ``rows`` in order: those scoring above zero are accepted.

        ``trace`` collects the radius after every row. Counters describe the pass.
        """
        counts = {"processed": len(rows), "added": 0, "removed": 0, "sv_before": self.size}
        at, block = 0, _MIN_BLOCK
        while at < len(rows):
            if self.size >= WIDE:
                _Wide(self, len(rows) - at).learn(rows[at:], counts, trace)
                break
            part = rows[at : at + block]
            sims = self.sims(part)
            i, hits = 0, 0
            while i < len(part):
                outside = judge(sims[i:], self.alpha, self.radius, self.near, self.far)[0] > 0
                step = int(outside.argmax()) if outside.any() else len(part) - i
                if trace is not None:
                    trace.extend([self.radius] * step)
                i += step
                if i == len(part):
                    break
                pruned, back = self.accept(part[i], sims[i])
                hits += 1
                counts["added"] += 1 + len(back)
                counts["removed"] += len(pruned)
                if trace is not None:
                    trace.append(self.radius)
                # keep the block's similarity columns in step with the support vectors
                sims = np.column_stack([sims, similarity(part, part[i : i + 1], self.sigma)])
                for gone in pruned:
                    sims = np.delete(sims, gone, axis=1)
                if back:
                    sims = np.column_stack([sims, similarity(part, np.array(back), self.sigma)])
                i += 1
            at += len(part)
            block = min(_MAX_BLOCK, block * 2) if hits <= 2 else max(_MIN_BLOCK, block // 2)
        self.seen += len(rows)
        counts["sv_after"] = self.size
        counts["total_seen"] = self.seen
        return counts


class _Wide:
    """A boundary of many support vectors during a pass: the same steps, with fewer passes over its inverse.

    Every step of ``grow`` and ``prune`` adds a multiple of an outer product u u^T to the inverse. Here the vectors
    u of a block of rows are collected, products with the inverse are the matrix as it was plus those of the
    vectors, and the block is applied as one matrix product. A dropped vector leaves a place of zeros,
    closed when a sixteenth of the places are empty.
    """

    def __init__(self, model: Boundary, coming: int):
        self.model, self.k = model, model.size
        self._room(self.k, coming)
        self.live[: self.k] = True
        self.sv[: self.k] = model.sv
        self.inverse = model.inverse if isinstance(model.inverse, Strips) else Strips(model.inverse)
        model.inverse = None
        self._fresh()
        self.raw[: self.k] = self.inverse.sums(self.k)

    def _room(self, k: int, coming: int) -> None:
        """Arrays with places for the vectors to come; pages that are not touched take no memory."""
        old = self.__dict__.get("cap", 0)
        self.cap = k + 4 * _FILE_BLOCK + min(coming, max(k, 12_000))
        held = [(n, getattr(self, n)) for n in ("live", "raw", "sv")] if old else []
        self.live, self.raw, self.sv = np.zeros(self.cap, bool), np.zeros(self.cap), np.zeros((self.cap, self.model.sv.shape[1]))
        for n, a in held:
            getattr(self, n)[:k] = a[:k]
        if old:
            self._fresh()

    def _fresh(self) -> None:
        self.u, self.d, self.r, self.base = np.zeros((2 * _WIDE_BLOCK, self.cap)), np.zeros(2 * _WIDE_BLOCK), 0, self.k
        # places with a vector when the block began, rows of the inverse as it was then, and what later places stand for
        self.begun, self.rows, self.origin = self.live[: self.k].copy(), {}, {}

    def _push(self, vector: np.ndarray, factor: float) -> None:
        if self.r == len(self.d):
            self.u, self.d = np.vstack([self.u, np.zeros_like(self.u)]), np.concatenate([self.d, np.zeros_like(self.d)])
        self.u[self.r, : len(vector)], self.d[self.r] = vector, factor
        self.r += 1
        self.raw[: len(vector)] += factor * vector.sum() * vector

    def _spread(self, weights: np.ndarray) -> np.ndarray:
        return (self.d[: self.r] * weights) @ self.u[: self.r, : self.k]

    def _grow(self, row: np.ndarray, sims: np.ndarray, before: np.ndarray, product: np.ndarray | None = None) -> None:
        """``sims`` to every place (0 at empty ones); ``before``: those to the places as the block began, ``product``: the inverse then times it."""
        b = self.base
        if product is None:
            product = self.inverse.times(before[None, :])[0][0]
        # places emptied in this block still count in the product; the vectors take that back
        col = self._spread(self.u[: self.r, :b] @ before + self.u[: self.r, b : self.k] @ sims[b:])
        col[:b] += product
        col[~self.live[: self.k]] = 0.0
        gain = 1.0 - sims @ col
        if abs(gain) < TINY:
            gain = TINY
        self.sv[self.k], self.live[self.k], self.raw[self.k] = row, True, 0.0
        self.k += 1
        self._push(np.append(col, -1.0), 1.0 / gain)

    def _prune(self) -> list[int]:
        dropped = []
        while True:
            raw = np.where(self.live[: self.k], self.raw[: self.k], np.inf)
            worst = int(raw.argmin())
            if not raw[worst] < 0:
                return dropped
            edge = self._spread(self.u[: self.r, worst])
            if worst < self.base:
                edge[: self.base] += self.rows[worst] if worst in self.rows else self.inverse.row(worst, self.base)
            edge[~self.live[: self.k]] = 0.0
            pivot = edge[worst]
            if abs(pivot) < TINY:
                pivot = TINY
            self._push(edge, -1.0 / pivot)
            self.live[worst], self.raw[worst] = False, 0.0
            dropped.append(worst)

    def _sims(self, x: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        live = self.live[: self.k] if live is None else live
        out = np.zeros((len(x), len(live)))
        at = np.flatnonzero(live)
        got = similarity(x, self.sv[at], self.model.sigma)
        if len(at) == len(live):
            return got
        out[:, at] = got
        return out

    def _apply(self, last: bool = False) -> None:
        """Bring the inverse up to date with the collected vectors; close empty places when they are many."""
        k = self.k
        gone = np.flatnonzero(~self.live[:k])
        if self.r:
            self.raw[:k] = self.inverse.add(self.u[: self.r, :k], self.d[: self.r], gone)
        if len(gone) and (last or 16 * len(gone) >= k):
            at = np.flatnonzero(self.live[:k])
            size = len(at)
            self.inverse.close(at)
            self.sv[:size], self.raw[:size] = self.sv[at], self.raw[at]
            self.live[:size], self.live[size:k] = True, False
            self.k = size
        self._fresh()

    def _most(self) -> int:
        """Rows of a block, so that their similarities stay in bounds."""
        return max(_WIDE_BLOCK, min(_MAX_BLOCK, _BLOCK_CELLS // self.k))

    def _least(self) -> int:
        return _WIDE_BLOCK if self.inverse.file is None else min(_FILE_BLOCK, self._most())

    def learn(self, rows: np.ndarray, counts: dict[str, int], trace: list | None) -> None:
        m = self.model
        at, block = 0, self._least()
        self._settle()
        while at < len(rows):
            least = self._least()
            part = rows[at : at + block]
            known = self._sims(part)
            spare = known.shape[1] + 2 * len(part)
            sims = np.zeros((len(part), spare))
            sims[:, : self.k] = known
            outside = self._outside(sims)
            # products with the inverse of the rows that are outside now, in one go; of others when they turn out so
            ahead = outside.nonzero()[0][:least]
            if len(ahead) and self.inverse.file is not None:
                # a pass over the file is dear: all rows of a short block, and rows of the inverse that may be dropped
                ahead = np.arange(len(part)) if len(part) <= least else ahead
                likely = np.argsort(np.where(self.live[: self.k], self.raw[: self.k], np.inf))[:_LIKELY]
            else:
                likely = np.zeros(0, int)
            products = None
            if len(ahead):
                products, lines = self.inverse.times(known[ahead], likely)
                self.rows = dict(zip(likely.tolist(), lines))
            places = {int(j): n for n, j in enumerate(ahead)}

            def begun(of):
                """(similarities to the places as the block began, their product with the inverse then) of a row, or of a place."""
                kind, j = of
                if kind == "place":
                    # the inverse times a column of what it inverts is known without a pass over the file
                    return self._sims(self.sv[j : j + 1], self.begun)[0], None if self.inverse.file is None else np.eye(1, self.base, j)[0]
                return known[j], products[places[j]] if j in places else None

            i, hits, look = 0, 0, len(part)
            while i < len(part):
                if hits:
                    outside = self._outside(sims[i : i + look])
                hit = outside.nonzero()[0]
                step = int(hit[0]) if len(hit) else len(outside)
                if trace is not None:
                    trace.extend([m.radius] * step)
                i += step
                if not len(hit):
                    look *= 2
                    continue
                look = 4
                self.origin[self.k] = ("row", i)
                self._grow(part[i], sims[i, : self.k].copy(), *begun(("row", i)))
                pruned, back = self._prune(), []
                new = [part[i]]
                for j in pruned:
                    again = self._sims(self.sv[j : j + 1])
                    live = self.live[: self.k]
                    if judge(again[:, live], self.raw[: self.k][live], m.radius, m.near, m.far)[0][0] > 0:
                        self.origin[self.k] = of = self.origin.get(j, ("place", j))
                        self._grow(self.sv[j].copy(), again[0], *begun(of))
                        back.append(j)
                        new.append(self.sv[j])
                self._settle()
                hits += 1
                counts["added"] += 1 + len(back)
                counts["removed"] += len(pruned)
                if trace is not None:
                    trace.append(m.radius)
                if self.k > sims.shape[1]:
                    sims = np.column_stack([sims, np.zeros((len(part), self.k + len(part) - sims.shape[1]))])
                sims[:, self.k - len(new) : self.k] = similarity(part, np.array(new), m.sigma)
                sims[:, np.flatnonzero(~self.live[: self.k])] = 0.0
                i += 1
                if self.k + 2 * _WIDE_BLOCK >= self.cap:  # more came back than there are places for
                    break
            at += i
            self._apply()
            self._settle()
            block = min(self._most(), block * 2) if hits <= 2 else max(self._least(), block // 2)
            if self.k + 4 * block >= self.cap:
                self._room(self.k, len(rows) - at)
        self._apply(last=True)
        m.sv = self.sv[: self.k].copy()
        m.inverse = self.inverse if self.k > INVERSE_ROWS else self.inverse.square(self.k)
        m.alpha = self.raw[: self.k].copy()
        m.settle()

    def _outside(self, sims: np.ndarray) -> np.ndarray:
        m = self.model
        return judge(sims[:, : self.k], m.alpha, m.radius, m.near, m.far)[0] > 0

    def _settle(self) -> None:
        """As :meth:`Boundary.settle`, by place."""
        self.model.alpha = np.where(self.live[: self.k], self.raw[: self.k], 0.0)
        self.model.settle()


def fit(rows: np.ndarray, sigma: float, seed: str = "first", trace: list | None = None, near=EPS_NEAR, far=EPS_FAR):
    """Boundary of ``rows`` taken in order. The seed is the first row, or the one nearest the means."""
    if seed == "central":
        gap = rows - rows.mean(axis=0)
        s = int((gap * gap).sum(axis=1).argmin())
        rows = np.concatenate([rows[s : s + 1], rows[:s], rows[s + 1 :]])
    elif seed != "first":
        raise ValueError(f"Unknown seed '{seed}'. Available: first, central")
    model = Boundary.start(rows[0], sigma, near, far)
    return model, model.learn(rows[1:], trace)


# -- models as table rows ----------------------------------------------------

MODEL_FIELDS = (
    "sv array<double>, alpha array<double>, inverse array<double>, radius double, sigma double, "
    "eps_near double, eps_far double, seen bigint, n_sv int, dim int"
)


def to_fields(m: Boundary) -> dict:
    """One model as the flat arrays and numbers of ``MODEL_FIELDS``."""
    return {
        "sv": m.sv.ravel(),
        "alpha": m.alpha,
        "inverse": m.inverse.ravel() if m.size <= INVERSE_ROWS and isinstance(m.inverse, np.ndarray) else np.zeros(0),
        "radius": float(m.radius),
        "sigma": float(m.sigma),
        "eps_near": float(m.near),
        "eps_far": float(m.far),
        "seen": int(m.seen),
        "n_sv": m.size,
        "dim": m.sv.shape[1],
    }


def from_fields(r) -> Boundary:
    """Rebuild a model from a row, dict or pandas record holding ``MODEL_FIELDS``."""
    k, d = int(r["n_sv"]), int(r["dim"])
    sv, inverse = np.array(r["sv"], dtype=float).reshape(k, d), np.array(r["inverse"], dtype=float)
    if k > INVERSE_ROWS and not inverse.size:
        inverse = Strips.inverse_of(sv, float(r["sigma"]))
    elif k and not inverse.size:
        inverse = np.linalg.inv(similarity(sv, sv, float(r["sigma"])))
    return Boundary(
        sv=sv,
        sigma=float(r["sigma"]),
        alpha=np.array(r["alpha"], dtype=float),
        inverse=inverse if isinstance(inverse, Strips) else inverse.reshape(k, k),
        radius=float(r["radius"]),
        seen=int(r["seen"]),
        near=float(r["eps_near"]),
        far=float(r["eps_far"]),
    )
