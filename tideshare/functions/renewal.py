"""Numbers for the fits inside a task: model with derivatives, likelihood, scoring steps.

All functions work on a batch of fits at once (first axis of the parameters), so that NumPy runs
over thousands of small problems per call. Parameters are logarithms, in the order rates per
block, start shares, time scales (if free), concentration (if any). Spark decides which fits
share a task; see ``plans.fit``.
"""

from __future__ import annotations

import math

import numpy as np

# Parameter bounds and start values.
RATE_BOUNDS = (1e-10, 10.0)
SHARE_BOUNDS = (1e-10, 1.0)
SCALE_BOUNDS = (1e-10, 10.0)
CONCENTRATION_BOUNDS = (1e-10, 1e5)
START_RATE, START_SHARE, START_SCALE, START_CONCENTRATION = 1.0, 0.001, 1.0, 10.0

# Distance of two starts that have met, in log units; 1e-6 changed the fourth decimal of a likelihood.
MET = 1e-8

MEMORY = 8 * 2**20  # bytes of derivatives that fits evaluated together may hold, about what a core's cache keeps


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(8):
        shift += np.log(x)
        x = x + 1
    y = 1 / (x * x)
    tail = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + tail - shift


def digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(8):
        out -= 1 / x
        x = x + 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def gamma_cdf(z: np.ndarray, alpha: float) -> np.ndarray:
    inside = (z > 0) & (z <= 100 + 2 * alpha)
    x = np.where(inside, z, 1.0)
    term = np.ones_like(x)
    total = np.ones_like(x)
    last = float(x.max(initial=1.0))
    for n in range(1, math.ceil(last + 12 * math.sqrt(last) + 60)):
        term = term * x / (alpha + n)
        total += term
    value = np.exp(alpha * np.log(x) - x - math.lgamma(alpha + 1)) * total
    return np.where(z <= 0, 0.0, np.where(inside, np.minimum(value, 1.0), 1.0))


class Fits:
    """Fits with the same number of categories; days and bins are padded to the longest.

    ``block`` [fit, subject] (0 = rate of the baseline), ``intro`` [fit, subject],
    ``d1``, ``d2`` [bin, fit] and ``n`` [bin, fit, category], baseline last. Inside, fits are the
    last axis, so that NumPy's inner loops run over fits, and they are evaluated in pieces whose
    derivatives stay in the cache.
    """

    def __init__(self, block, intro, d1, d2, n, weights, alpha, theta, time_scale, dirichlet):
        self.block, self.intro, self.d1, self.d2 = block, intro, d1, d2
        self.n = np.ascontiguousarray(n.transpose(0, 2, 1))
        self.weights, self.alpha, self.theta = weights, alpha, theta
        self.time_scale, self.dirichlet = time_scale, dirichlet
        self.b, self.s = block.shape
        self.k = int(block.max(initial=0))
        self.days = int(d2.max(initial=1))
        # bins up to the last one with a count; what follows adds nothing to a likelihood
        self.bins = ((self.n > 0).any(axis=1) * np.arange(1, len(d1) + 1)[:, None]).max(axis=0, initial=1)
        extra = self.s * time_scale
        self.model_size = self.k + self.s + extra
        self.size = self.model_size + dirichlet
        bounds = [RATE_BOUNDS] * self.k + [SHARE_BOUNDS] * self.s + [SCALE_BOUNDS] * extra
        bounds += [CONCENTRATION_BOUNDS] * dirichlet
        self.low, self.high = np.array(bounds, dtype=float).T
        self.lo, self.hi = np.log(self.low), np.log(self.high)
        self.used = np.ones((self.b, self.size), dtype=bool)
        self.used[:, : self.k] = np.arange(self.k) < block.max(axis=1, initial=0)[:, None]
        self.single = bool((d1 == d2).all())
        self.constant = (log_gamma(self.n.sum(axis=1) + 1) - log_gamma(self.n + 1).sum(axis=1)).sum(axis=0)
        per_fit = 8 * (self.days + len(weights)) * (self.s + 1) * self.model_size
        self.piece, self.shared = max(1, MEMORY // per_fit), []

    def take(self, rows: np.ndarray) -> Fits:
        """Some of the fits, with the parameter layout of all."""
        out = object.__new__(Fits)
        out.__dict__.update(self.__dict__)
        out.b = len(rows)
        for name in ("block", "intro", "used", "constant", "bins"):
            setattr(out, name, getattr(self, name)[rows])
        bins = int(self.bins[rows].max(initial=1))
        for name in ("d1", "d2", "n"):
            setattr(out, name, np.take(getattr(self, name)[:bins], rows, axis=-1))
        out.days = int(out.d2.max(initial=1))
        return out

    def room(self, *shape: int) -> np.ndarray:
        """An array whose memory the evaluations of all pieces share: fresh pages cost more than the arithmetic."""
        size = math.prod(shape)
        if not self.shared or self.shared[0].size < size:
            self.shared[:] = [np.empty(size)]
        return self.shared[0][:size].reshape(shape)

    def pack(self, k, qt, c=None, d=None) -> np.ndarray:
        """Parameters [fit, parameter] from rates, shares and scales per subject."""
        rates = np.ones((self.b, self.k))
        for j in range(self.s):
            rows = np.flatnonzero(self.block[:, j] > 0)
            rates[rows, self.block[rows, j] - 1] = k[rows, j]
        parts = [rates, qt]
        if self.time_scale:
            parts.append(c)
        if self.dirichlet:
            parts.append(np.reshape(d, (-1, 1)))
        raw = np.concatenate(parts, axis=1)
        return np.log(np.clip(raw, self.low, self.high))

    def unpack(self, par: np.ndarray):
        v = np.clip(np.exp(par), self.low, self.high)
        rates = np.concatenate([np.ones((self.b, 1)), v[:, : self.k]], axis=1)
        rates = np.take_along_axis(rates, self.block, axis=1)
        c = v[:, self.k + self.s : self.model_size] if self.time_scale else np.ones((self.b, self.s))
        return rates, v[:, self.k : self.k + self.s], c, v[:, -1] if self.dirichlet else None

    def lag_weights(self, c: np.ndarray) -> np.ndarray:
        """[lag, category, fit]"""
        lags = np.arange(len(self.weights) + 1.0)[:, None, None]
        scale = np.concatenate([c.T, np.ones((1, self.b))]) * self.theta
        cdf = gamma_cdf(lags / scale, self.alpha)
        return np.diff(cdf, axis=0) / cdf[-1]

    def shares(self, par: np.ndarray, slopes: bool = True):
        """Daily shares [day, category, fit] and their derivatives [day, category, parameter, fit]."""
        s, k, b, lags = self.s, self.k, self.b, len(self.weights)
        rates, qt, c, _ = self.unpack(par)
        qt, intro = np.ascontiguousarray(qt.T), self.intro.T
        rate = np.concatenate([rates.T, np.ones((1, b))])
        # newest lag last, to match the order of the days
        w = np.ascontiguousarray((self.lag_weights(c) if self.time_scale else self.weights)[::-1])

        def lagged(weights, x):
            if weights.ndim == 1:
                return (weights @ x.reshape(lags, -1)).reshape(x.shape[1:])
            return np.einsum("lsb,ls...b->s...b", weights, x)

        q = np.empty((self.days + lags, s + 1, b))
        dq = self.room(self.days + lags, s + 1, self.model_size, b) if slopes else None
        if slopes:
            same_blocks = (self.block == self.block[0]).all()
            named = np.flatnonzero(self.block[0])
            own = self.block[0, named] - 1
            unit_k = None if same_blocks else (self.block.T[:, None] == np.arange(1, k + 1)[:, None]).astype(float)
            unit_q = np.zeros((s, self.model_size, b))
            unit_q[np.arange(s), k + np.arange(s)] = qt
            if self.time_scale:
                h, one = 1e-4, np.arange(s)
                up, down = self.lag_weights(c * math.exp(h)), self.lag_weights(c * math.exp(-h))
                slope_c = ((up - down) / (2 * h))[::-1] * rate
        begins = set(np.maximum(np.unique(intro), 0).tolist())
        for t in range(self.days):
            at = t + lags
            if t == 0:
                raw = np.zeros((s, b))
                if slopes:
                    dq[at], draw = 0.0, dq[at, :s]
            else:
                past = q[at - lags : at]
                num = rate * lagged(w, past)
                total = num.sum(axis=0)
                raw = num[:s] / total
                if slopes:
                    dnum = lagged(w, dq[at - lags : at])
                    dnum *= (rate / total)[:, None]
                    if same_blocks:
                        dnum[named, own] += raw[named]
                    else:
                        dnum[:s, :k] += raw[:, None] * unit_k
                    if self.time_scale:
                        dnum[one, k + s + one] += (slope_c * past).sum(axis=0)[:s] / total
                    draw = dq[at, :s]
                    np.multiply(raw[:, None], dnum.sum(axis=0), out=draw)
                    np.subtract(dnum[:s], draw, out=draw)
            if t in begins:
                here = intro <= 0 if t == 0 else intro == t
                raw = np.where(here, qt, raw)
                if slopes:
                    dq[at, :s] = draw = np.where(here[:, None], unit_q, draw)
            sub = raw.sum(axis=0)
            q[at, :s] = raw
            np.subtract(1.0, sub, out=q[at, s])
            if slopes:
                np.negative(draw.sum(axis=0), out=dq[at, s])
            if sub.max() > 1:
                over = np.flatnonzero(sub > 1)
                part = raw[:, over] / sub[over]
                q[at, :s, over], q[at, s, over] = part.T, 0.0
                if slopes:
                    slope = draw[..., over]
                    slope = (slope - part[:, None] * slope.sum(axis=0)) / sub[over]
                    dq[at, :s, :, over], dq[at, s, :, over] = slope.transpose(2, 0, 1), 0.0
            if t == 0:
                q[:lags] = q[at]
                if slopes:
                    dq[:lags] = dq[at]
        return q[lags:], dq[lags:] if slopes else None

    def bin_means(self, x: np.ndarray) -> np.ndarray:
        """Means [bin, ..., fit] of daily values [day, ..., fit]."""
        if self.single:
            return self.at_days(x, self.d1 - 1)
        run = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        width = (self.d2 - self.d1 + 1).reshape(len(self.d1), *[1] * (x.ndim - 2), self.b)
        return (self.at_days(run, self.d2) - self.at_days(run, self.d1 - 1)) / width

    def at_days(self, x: np.ndarray, day: np.ndarray) -> np.ndarray:
        # fits without a bin do not count there, so they may show another day
        first = day[:, np.argmax(self.d2.max(axis=0))]
        if ((day == first[:, None]) | ~self.n.any(axis=1)).all():
            return x[: len(first)] if (first == np.arange(len(first))).all() else x[first]
        return np.take_along_axis(x, day.reshape(len(day), *[1] * (x.ndim - 2), self.b), axis=0)

    def evaluate(self, par: np.ndarray, rows: np.ndarray | None = None, slopes: bool = True):
        """Log-likelihood, gradient and expected information of every fit, or of some; without ``slopes`` only the first.

        A point that leaves a counted category without probability is out of reach for a fit,
        with either observation model (up to rounding: start shares that sum to more than 1
        leave about 1e-16 to the baseline).
        """
        rows = np.arange(self.b) if rows is None else rows
        ll = np.empty(len(rows))
        grad = np.empty((len(rows), self.size)) if slopes else None
        info = np.empty((len(rows), self.size, self.size)) if slopes else None
        piece = self.piece if slopes else self.piece * self.model_size
        for i in range(0, len(rows), piece):
            here = slice(i, i + piece)
            out = self.take(rows[here]).evaluate_piece(par[here], slopes)
            ll[here] = out[0]
            if slopes:
                grad[here], info[here] = out[1:]
        return (ll, grad, info) if slopes else ll

    def evaluate_piece(self, par: np.ndarray, slopes: bool):
        q, dq = self.shares(par, slopes)
        p = np.maximum(self.bin_means(q), 0.0)
        on = p > 0
        safe = np.where(on, p, 1.0)
        if self.dirichlet:
            d = np.exp(par[:, -1])
            obs, alpha = np.where(on, self.n, 0.0), np.where(on, p * d, 1.0)
            total = obs.sum(axis=1)
            mass = np.where(on, alpha, 0.0).sum(axis=1)
            ll = (log_gamma(total + 1) + log_gamma(mass) - log_gamma(total + mass)).sum(axis=0)
            cells = log_gamma(obs + alpha) - log_gamma(alpha) - log_gamma(obs + 1)
            ll = ll + np.where(on, cells, 0.0).sum(axis=(0, 1))
        else:
            ll = self.constant + (self.n * np.log(safe)).sum(axis=(0, 1))
        ll = np.where((self.n * (p < 1e-14)).sum(axis=(0, 1)) > 0, -np.inf, ll)
        if not slopes:
            return (ll,)
        grad = np.zeros((self.b, self.size))
        info = np.zeros((self.b, self.size, self.size))
        m = slice(0, self.model_size)
        if self.dirichlet:
            cell = self.concentration_slopes(obs, alpha, on)
            score, weight = cell * d, (total * (1 + d) / (total + d))[:, None] / safe
            grad[:, -1] = np.where(on, alpha * cell, 0.0).sum(axis=(0, 1))
            h = 1e-3
            up, down = (np.where(on, alpha * f * self.concentration_slopes(obs, np.where(on, alpha * f, 1.0), on), 0.0)
                        .sum(axis=(0, 1)) for f in (math.exp(h), math.exp(-h)))
            info[:, -1, -1] = np.maximum(np.abs(up - down) / (2 * h), 1e-8)
        else:
            score, weight = self.n / safe, self.n.sum(axis=1)[:, None] / safe
        score, root = np.where(on, score, 0.0), np.sqrt(np.where(on, weight, 0.0))
        dp = self.bin_means(dq)
        grad[:, m] = np.einsum("tspb,tsb->pb", dp, score).T
        dp *= root[:, :, None]
        if self.b < self.model_size:
            # few fits with many parameters: a matrix product for each
            dp = np.ascontiguousarray(dp.transpose(3, 0, 1, 2)).reshape(self.b, -1, self.model_size)
            info[:, m, m] = dp.transpose(0, 2, 1) @ dp
        else:
            for j in range(self.model_size):
                part = np.einsum("tspb,tsb->bp", dp[:, :, j:], dp[:, :, j])
                info[:, j, j : self.model_size] = info[:, j : self.model_size, j] = part
        return ll, grad, info

    @staticmethod
    def concentration_slopes(obs, alpha, on):
        mass = np.where(on, alpha, 0.0).sum(axis=1)
        head = digamma(mass) - digamma(obs.sum(axis=1) + mass)
        return np.where(on, digamma(obs + alpha) - digamma(alpha) + head[:, None], 0.0)

    def free(self, par: np.ndarray, grad: np.ndarray, rows: np.ndarray) -> np.ndarray:
        stuck = ((par <= self.lo) & (grad < 0)) | ((par >= self.hi) & (grad > 0))
        return self.used[rows] & ~stuck

    @staticmethod
    def system(info: np.ndarray, free: np.ndarray, damp: np.ndarray) -> np.ndarray:
        """Damped information of the free parameters, identity for the others."""
        sub = np.where(free[:, :, None] & free[:, None, :], info, 0.0)
        diag = np.maximum(np.einsum("bii->bi", info), 1e-10)
        extra = np.where(free, damp[:, None] * diag + 1e-12, 1.0)
        return sub + extra[:, :, None] * np.eye(info.shape[1])

    def maximise(self, par: np.ndarray, fixed: np.ndarray | None = None, rounds: int = 200,
                 problem: np.ndarray | None = None):
        """Damped scoring within the bounds; ``fixed`` holds one parameter per fit.

        Fits that are next to each other with the same ``problem`` are starts of one fit: where two have
        met, only the likelier goes on, and the other stays where it was, unsettled.
        Returns parameters, log-likelihood and whether each fit has settled.
        """
        par, out_ll, ok = par.copy(), np.full(self.b, -np.inf), np.zeros(self.b, dtype=bool)
        rows, x = np.arange(self.b), par.copy()
        ll, grad, info = self.evaluate(x)
        damp = np.full(self.b, 1e-4)
        done = ~np.isfinite(ll)
        left = done.copy()
        for turn in range(rounds):
            free = self.free(x, grad, rows)
            if fixed is not None:
                free[np.arange(len(rows)), fixed[rows]] = False
            g = np.where(free, grad, 0.0)
            step = np.linalg.solve(self.system(info, free, damp), g[..., None])[..., 0]
            gain = (g * step).sum(axis=1)
            settled = np.isfinite(ll) & (((gain < 1e-11) & (damp <= 1e-3)) | ((damp > 1e8) & (gain < 1e-6)))
            done |= settled | (damp > 1e8)
            par[rows], out_ll[rows], ok[rows] = x, ll, settled
            if problem is not None and turn and turn % 2 == 0:
                self.leave_met(problem, rows, done, left, par, out_ll, ok, info)
            if done.any():
                keep = np.flatnonzero(~done)
                rows, done = rows[keep], done[keep]
                x, ll, grad, info, damp, step = x[keep], ll[keep], grad[keep], info[keep], damp[keep], step[keep]
            if not len(rows):
                break
            reach = np.abs(step).max(axis=1, keepdims=True)
            trial = np.clip(x + step * np.minimum(1.0, 2.0 / np.maximum(reach, 1e-300)), self.lo, self.hi)
            # only a trial that is taken needs its derivatives
            better = np.flatnonzero(self.evaluate(trial, rows, slopes=False) > ll)
            x[better] = trial[better]
            ll[better], grad[better], info[better] = self.evaluate(trial[better], rows[better])
            lower = np.maximum(damp[better] / 10, 1e-8)
            damp = np.maximum(damp * 10, 1e-4)
            damp[better] = lower
        return par, out_ll, ok

    @staticmethod
    def leave_met(problem, rows, done, left, par, ll, ok, info):
        """Mark in ``done`` and ``left`` the starts that have met a likelier start of the same problem.

        They have met when the information of those still running takes their distance for less than ``MET``.
        """
        place = np.full(len(problem), -1)
        place[rows] = np.arange(len(rows))
        running = np.zeros(len(problem), dtype=bool)
        running[rows] = ~done
        near = np.flatnonzero(~left)
        near = near[np.isin(problem[near], problem[running])]
        for shift in range(1, len(near)):
            a, b = near[:-shift], near[shift:]
            same = problem[a] == problem[b]
            if not same.any():
                return
            a, b = a[same], b[same]
            far = np.full(len(a), -np.inf)
            apart = par[a] - par[b]
            for one in (a, b):
                known = np.flatnonzero(place[one] >= 0)
                d = apart[known]
                far[known] = np.maximum(far[known], np.einsum("bp,bpq,bq->b", d, info[place[one[known]]], d))
            met = (far < MET) & (np.abs(apart).max(axis=1) < 1) & (running[a] | running[b])
            for i, j in zip(a[met], b[met]):
                low, high = (j, i) if ll[j] <= ll[i] + 1e-9 else (i, j)
                if running[low] and (running[high] or ok[high]):
                    running[low], left[low], done[place[low]] = False, True, True

    def extreme(self, best: np.ndarray, ll_max: np.ndarray, which: np.ndarray, side: np.ndarray,
                cut: np.ndarray):
        """Smallest (side -1) or largest (+1) value of one parameter per fit with ll >= cut.

        Each step solves the quadratic model of the constraint exactly. A fit that runs into the
        bound of its parameter, or does not settle, is finished by bisecting the profile.
        """
        out, out_ll = best.copy(), ll_max.copy()
        rest = []
        rows, x = np.arange(self.b), best.copy()
        for _ in range(60):
            one = np.arange(len(rows))
            i, sgn = which[rows], side[rows]
            ll, grad, info = self.evaluate(x, rows)
            free = self.free(x, grad, rows)
            free[one, i] = True
            unit = np.zeros_like(x)
            unit[one, i] = 1.0
            both = np.stack([unit, np.where(free, grad, 0.0)], axis=2)
            sub = self.system(info, free, np.full(len(rows), 1e-9))
            v, u = np.moveaxis(np.linalg.solve(sub, both), 2, 0)
            room = 2 * (ll - cut[rows]) + (both[..., 1] * u).sum(axis=1)
            pull = sgn * np.sqrt(np.maximum(np.nan_to_num(room), 0.0) / np.maximum(v[one, i], 1e-300))
            step = u + pull[:, None] * v
            reach = np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-300)
            new = np.clip(x + step * np.minimum(1.0, 1.0 / reach), self.lo, self.hi)
            settled = (np.abs(ll - cut[rows]) < 1e-6) & (np.abs(new - x).max(axis=1) < 1e-6)
            out[rows[settled]], out_ll[rows[settled]] = x[settled], ll[settled]
            edge = np.where(sgn < 0, new[one, i] <= self.lo[i], new[one, i] >= self.hi[i])
            lost = ~settled & (edge | ~np.isfinite(ll))
            rest.append(rows[lost])
            keep = np.flatnonzero(~settled & ~lost)
            rows, x = rows[keep], new[keep]
            if not len(rows):
                break
        rest = np.concatenate([*rest, rows])
        if len(rest):
            part = self.take(rest)
            out[rest], out_ll[rest] = part.bisect(best[rest], ll_max[rest], which[rest], side[rest], cut[rest])
        return out, out_ll

    def bisect(self, best, ll_max, which, side, cut):
        """The same by steps outwards and halving, with the other parameters refitted."""
        one = np.arange(self.b)
        bound = np.where(side < 0, self.lo[which], self.hi[which])
        good, good_ll = best.copy(), ll_max.copy()
        bad, width = np.full(self.b, np.nan), np.full(self.b, 0.05)
        end = np.zeros(self.b, dtype=bool)
        while True:
            open_ = np.isnan(bad) & ~end
            near = np.abs(bad - good[one, which]) > 1e-8
            rows = np.flatnonzero(open_ | (~end & ~np.isnan(bad) & near))
            if not len(rows):
                return good, good_ll
            w, r = which[rows], np.arange(len(rows))
            trial = good[rows].copy()
            out = trial[r, w] + side[rows] * width[rows]
            out = np.where(side[rows] < 0, np.maximum(out, bound[rows]), np.minimum(out, bound[rows]))
            trial[r, w] = np.where(np.isnan(bad[rows]), out, (trial[r, w] + bad[rows]) / 2)
            at_bound = np.isnan(bad[rows]) & (trial[r, w] == bound[rows])
            par, ll, _ = self.take(rows).maximise(trial, fixed=w)
            inside = ll >= cut[rows]
            bad[rows] = np.where(inside, bad[rows], trial[r, w])
            good[rows] = np.where(inside[:, None], par, good[rows])
            good_ll[rows] = np.where(inside, ll, good_ll[rows])
            end[rows] |= inside & at_bound
            width[rows] *= 2
