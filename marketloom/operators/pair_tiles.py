"""Statistics of all pairs of two sets of series on the same dates, by products of matrices.

Every statistic of a pair's spread a - alpha - beta b is a polynomial in beta whose coefficients are sums of products of the two
series, so a tile of pairs is a few products of matrices and no spread is ever written down.  Where such sums lose their digits (one series nearly a
multiple of the other, say) a pair is unsure, and is left to ``pair_blocks.statistics``.
"""

from __future__ import annotations

import numpy as np

#: Observations that an adaptive lookback has at least.
LEAST_LOOKBACK = 10
#: Shares of the whole that differences of sums must leave for a pair to be sure; the second where sixth powers are summed.
LEFT, LEFT_OF_POWERS = 1e-6, 0.02
#: Dates after which pairs that have had their first entry are left out.
STRIDE = 8

Sides = tuple[np.ndarray, np.ndarray]


def half_lives(phi: np.ndarray) -> np.ndarray:
    """Steps in which a spread halves whose autoregression has the slope phi; NaN unless it is between 0 and 1."""
    inside = (phi > 0) & (phi < 1)
    return np.where(inside, np.log(0.5) / np.log(np.where(inside, phi, 0.5)), np.nan)


def lookbacks(half_life: np.ndarray, available: int) -> np.ndarray:
    """Observations 2 / theta - 1 with theta = ln 2 / half-life, between ``LEAST_LOOKBACK`` and those there are (0 without a half-life)."""
    wanted = np.rint(2 * half_life / np.log(2) - 1)
    return np.where(np.isnan(wanted), 0, np.clip(np.nan_to_num(wanted), LEAST_LOOKBACK, available)).astype(np.int64)


class Tile:
    """Pairs of the rows of ``a`` and ``b``: statistics by name, each a matrix, and ``unsure``, where they don't hold."""

    def __init__(self, a: np.ndarray, b: np.ndarray, window: int, wanted: frozenset[str]) -> None:
        self.mean = a.mean(axis=1)[:, None], b.mean(axis=1)[None, :]
        self.c = a - self.mean[0], b - self.mean[1].T
        saa, sbb = ((x * x).sum(axis=1) for x in self.c)
        saa[np.ptp(a, axis=1) == 0] = np.nan
        sbb[np.ptp(b, axis=1) == 0] = np.nan
        sab = self.c[0] @ self.c[1].T
        self.beta = beta = sab / sbb
        powers = "kss_t" in wanted
        self.unsure = ~(saa[:, None] - beta * sab > (LEFT_OF_POWERS if powers else LEFT) * saa[:, None])
        last = a[:, -1:], b[:, -1][None, :]
        self.numbers = {"beta": beta, "alpha": self.mean[0] - beta * self.mean[1]}
        self.numbers |= {k: np.broadcast_to(x, beta.shape) for k, x in zip(("la", "lb"), last, strict=True)}
        self.numbers["s"] = self.c[0][:, -1:] - beta * self.c[1][:, -1]
        if "cor" in wanted:
            self.numbers["cor"] = sab / np.sqrt(saa[:, None] * sbb)
        if "diff_r" in wanted:
            da, db = (self._centred(np.diff(x, axis=1)) for x in self.c)
            self.numbers["diff_r"] = (da @ db.T) / np.sqrt((da * da).sum(axis=1)[:, None] * (db * db).sum(axis=1))
            self.unsure |= (np.ptp(da, axis=1) == 0)[:, None] | (np.ptp(db, axis=1) == 0)
        if not wanted.isdisjoint(("phi", "life_z", "life_gap")):
            now, past = (tuple(self._centred(x[:, cut]) for x in self.c) for cut in (slice(1, None), slice(-1)))
            self.numbers["phi"] = self._form(now, past) / self._form(past, past)
        if not wanted.isdisjoint(("life_z", "life_gap")):
            self.numbers["life_z"], self.numbers["life_gap"] = self._trailing(lookbacks(half_lives(self.numbers["phi"]), a.shape[1]))
        if not wanted.isdisjoint(("adf_t", "kss_t")):
            s1 = tuple(x[:, 1:-1] for x in self.c)
            d1, d2 = (tuple(np.diff(x, axis=1)[:, cut] for x in self.c) for cut in (slice(-1), slice(1, None)))
            s22, t2, yy = self._form(d1, d1), self._form(d1, d2), self._form(d2, d2)
            if "adf_t" in wanted:
                self.numbers["adf_t"] = self._t_of_first(self._form(s1, s1), s22, self._form(s1, d1), self._form(s1, d2), t2, yy, s1[0].shape[1])
            if powers:
                cubes = self._cubes(s1)
                self.numbers["kss_t"] = self._t_of_first(self._sixth(s1), s22, cubes(d1), cubes(d2), t2, yy, s1[0].shape[1])
        if "z" in wanted:
            w = tuple(self._centred(x[:, -window:]) for x in self.c)
            square = self._form(w, w)
            self.unsure |= ~(square / window > LEFT * (saa[:, None] - beta * sab) / a.shape[1])
            self.numbers["z"] = (w[0][:, -1:] - beta * w[1][:, -1]) / np.sqrt(square / (window - 1)) if a.shape[1] >= window else np.full(beta.shape, np.nan)

    @staticmethod
    def _centred(x: np.ndarray) -> np.ndarray:
        return x - x.mean(axis=1, keepdims=True)

    def _form(self, u: Sides, v: Sides) -> np.ndarray:
        """Sums of (ua - beta ub) (va - beta vb); pairs whose squares leave too little are unsure."""
        a, b = (x * y for x, y in zip(u, v, strict=True))
        a, b = a.sum(axis=1)[:, None], self.beta * self.beta * b.sum(axis=1)
        mixed = 2 * (u[0] @ u[1].T) if u is v else u[0] @ v[1].T + v[0] @ u[1].T
        made = a - self.beta * mixed + b
        if u is v:
            self.unsure |= ~(made > LEFT * (a + b))
        return made

    def _sixth(self, s: Sides) -> np.ndarray:
        """Sums of (sa - beta sb) ** 6."""
        (a, b), x = s, -self.beta
        a2, b2 = a * a, b * b
        left, right = [a, a2, a2 * a, a2 * a2, a2 * a2 * a], [b, b2, b2 * b, b2 * b2, b2 * b2 * b]
        made = (right[2] * right[2]).sum(axis=1)[None, :] * x
        for k, n in zip(range(5), (6, 15, 20, 15, 6), strict=True):  # powers of beta from 5 down
            made = (made + n * (left[k] @ right[4 - k].T)) * x
        return made + (left[2] * left[2]).sum(axis=1)[:, None]

    def _cubes(self, s: Sides):
        """The function of d that gives sums of (sa - beta sb) ** 3 (da - beta db)."""
        (a, b), x = s, -self.beta
        a2, b2 = a * a, b * b
        a3, b3 = a2 * a, b2 * b

        def sums(d: Sides) -> np.ndarray:
            da, db = d
            made = (b3 * db).sum(axis=1)[None, :] * x + 3 * (a @ (b2 * db).T) + da @ b3.T
            made = made * x + 3 * (a2 @ (b * db).T + (a * da) @ b2.T)
            made = made * x + 3 * ((a2 * da) @ b.T) + a3 @ db.T
            return made * x + (a3 * da).sum(axis=1)[:, None]

        return sums

    def _t_of_first(self, s11: np.ndarray, s22: np.ndarray, s12: np.ndarray, t1: np.ndarray, t2: np.ndarray, yy: np.ndarray, n: int) -> np.ndarray:
        det = s11 * s22 - s12 * s12
        b1, b2 = (s22 * t1 - s12 * t2) / det, (s11 * t2 - s12 * t1) / det
        rest = yy - b1 * t1 - b2 * t2
        self.unsure |= ~((det > LEFT * s11 * s22) & (rest > LEFT * yy))
        return b1 / np.sqrt(rest / (n - 2) * s22 / det)

    def _trailing(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(z, distance from the mean) of the last spread over the last n; pairs of one n at once."""
        z, gap = np.full(n.shape, np.nan), np.full(n.shape, np.nan)
        for size in np.unique(n[(n > 1) & ~self.unsure]).tolist():
            i, j = np.nonzero((n == size) & ~self.unsure)
            for k in range(0, len(i), most := max(1, 200_000 // size)):
                p, q = i[k : k + most], j[k : k + most]
                s = self.c[0][p, -size:] - self.beta[p, q][:, None] * self.c[1][q, -size:]
                s -= (mean := s.mean(axis=1))[:, None]
                deviation = np.sqrt((s * s).sum(axis=1) / (size - 1))
                gap[p, q] = self.numbers["s"][p, q] - mean
                z[p, q] = s[:, -1] / np.where(deviation == 0, np.nan, deviation)
        return z, gap

    def first_entries(self, wanted: np.ndarray, window: int) -> None:
        """first_entry (place of the first |z| >= 2 after one below, from 1; else 0) and first_z of the pairs ``wanted``, over running sums."""
        a, b = (np.ascontiguousarray(x.T) for x in self.c)  # a row a date
        sums = [np.cumsum(np.pad(x, ((1, 0), (0, 0))), axis=0) for x in (a, a * a, b, b * b)]
        ma, sa, mb, sb = ((s[window:] - s[:-window]) / window for s in sums)
        first, first_z = np.zeros(self.beta.shape, np.int64), np.full(self.beta.shape, np.nan)
        i, j = np.nonzero(wanted & ~self.unsure)
        beta, total = self.beta[i, j], (a[:window].T @ b[:window])[i, j]
        least = LEFT * (self._form(self.c, self.c) / len(a))[i, j]
        below, found, lost = np.zeros(len(i), bool), np.zeros(len(i), bool), np.zeros(len(i), bool)
        for t in range(window - 1, len(a)):
            if t >= window:
                total += a[t][i] * b[t][j] - a[t - window][i] * b[t - window][j]
            k = t - window + 1
            mi, mj = ma[k][i], mb[k][j]
            va, vb = sa[k][i] - mi * mi, (sb[k][j] - mj * mj) * (beta * beta)
            variance = va - 2 * beta * (total / window - mi * mj) + vb
            lost |= ~(variance > np.maximum(least, LEFT * (va + vb))) & ~found
            z = (a[t][i] - mi - beta * (b[t][j] - mj)) / np.sqrt(variance * (window / (window - 1)))
            high = np.abs(z) >= 2
            new = below & high & ~found & ~lost
            first[i[new], j[new]], first_z[i[new], j[new]] = t + 1, z[new]
            found |= new
            below = np.abs(z) < 2
            if k % STRIDE == STRIDE - 1:
                self.unsure[i[lost], j[lost]] = True
                left = np.flatnonzero(~found & ~lost)
                i, j, beta, total, least, below, found, lost = (x[left] for x in (i, j, beta, total, least, below, found, lost))
        self.unsure[i[lost], j[lost]] = True
        self.numbers |= {"first_entry": first, "first_z": first_z}
