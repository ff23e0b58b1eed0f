"""Dense numpy counterparts of the factorization, written from the derivation, for small matrices."""

import math

import numpy as np

from tagweave.functions.mathx import digamma_np, log_gamma_np
from tagweave.plans import factors


def expectations(g, r):
    return g / r, digamma_np(g) - np.log(r)


def arrays(table, key, column):
    return np.array(table.orderBy(key).select(column).toPandas()[column].tolist())


def gamma_term(a, b, g, r):
    e, el = expectations(g, r)
    return np.sum((a - g) * el - (b - r) * e + log_gamma_np(g) - g * np.log(r))


class Twin:
    def __init__(self, x, rows, cols, params):
        self.x, self.p = x, params
        theta = factors.init_factors(rows, "i", "theta", params)
        beta = factors.init_factors(cols, "d", "beta", params)
        self.g0, self.r0 = arrays(theta, "i", "g"), arrays(theta, "i", "r")
        self.gb, self.rb = arrays(beta, "d", "g").T, arrays(beta, "d", "r").T

    def start(self, which=slice(None)):
        self.g, self.r = self.g0[which], self.r0[which]
        self.c = 1 / np.mean(self.g / self.r)

    def rates(self):
        return np.exp(expectations(self.g, self.r)[1]) @ np.exp(expectations(self.gb, self.rb)[1])

    def theta(self, x):
        (_, el), (eb, elb) = expectations(self.g, self.r), expectations(self.gb, self.rb)
        new = self.p.a + np.exp(el) * ((x / self.rates()) @ np.exp(elb).T)
        self.g, self.r = new, np.broadcast_to(self.p.a * self.c + eb.sum(axis=1), new.shape)
        self.c = 1 / np.mean(self.g / self.r)

    def beta_stat(self, x):
        (e, el), (_, elb) = expectations(self.g, self.r), expectations(self.gb, self.rb)
        return np.exp(elb) * (np.exp(el).T @ (x / self.rates())), e.sum(axis=0)[:, None]

    def beta(self, x):
        stat, total = self.beta_stat(x)
        self.gb = self.p.b + stat
        self.rb = np.broadcast_to(self.p.b + total, stat.shape)

    def local(self, x):
        e, eb = self.g / self.r, self.gb / self.rb
        n, k = self.g.shape
        return (
            np.sum(x * np.log(self.rates()) - e @ eb)
            + gamma_term(self.p.a, self.p.a * self.c, self.g, self.r)
            + n * k * self.p.a * math.log(self.c)
        )

    def bound(self, x, scale=1.0):
        return scale * self.local(x) + gamma_term(self.p.b, self.p.b, self.gb, self.rb)

    def loop(self, x, learn_beta):
        bounds, old = [], -math.inf
        for _ in range(self.p.max_iter):
            self.theta(x)
            if learn_beta:
                self.beta(x)
            bounds.append(self.bound(x))
            if not math.isinf(old) and (bounds[-1] - old) / abs(old) < self.p.tol:
                break
            old = bounds[-1]
        return bounds

    def fit(self):
        self.start()
        return self.loop(self.x, True)

    def gradient_step(self, which, rho, scale):
        x = self.x[which]
        self.start(which)
        self.loop(x, False)
        stat, total = self.beta_stat(x)
        self.gb = (1 - rho) * self.gb + rho * (self.p.b + scale * stat)
        self.rb = (1 - rho) * self.rb + rho * (self.p.b + scale * total)
        return self.bound(x, scale)
