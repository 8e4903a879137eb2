"""Plain Python versions of the definitions, for small inputs."""

import itertools
import math


def relabel(labels):
    seen = []
    for x in labels:
        if x not in seen:
            seen.append(x)
    return [seen.index(x) for x in labels]


def partitions(n):
    """All label strings of length n."""
    return sorted({tuple(relabel(p)) for p in itertools.product(range(n), repeat=n)})


def coarser(y, x):
    return all(y[i] == y[j] for i in range(len(x)) for j in range(len(x)) if x[i] == x[j])


def finest_common(a, b):
    return min((p for p in partitions(len(a)) if coarser(p, a) and coarser(p, b)), key=lambda p: -max(p))


def shares(k, qt, intro, days, weights, division=1):
    """Daily shares, subjects first and baseline last; weights[j][m] per category and lag."""
    s = len(k)

    def close(raw):
        total = sum(raw)
        return [x / total for x in raw] + [0.0] if total > 1 else raw + [1 - total]

    q = [close([qt[j] if intro[j] <= 0 else 0.0 for j in range(s)])]
    rate = [*k, 1.0]
    for i in range(2, (days - 1) * division + 2):
        day = i - 1 if division == 1 else i // division
        num = [
            rate[j] * sum(w * q[max(0, i - 1 - m)][j] for m, w in enumerate(weights[j], start=1))
            for j in range(s + 1)
        ]
        q.append(close([qt[j] if intro[j] == day else num[j] / sum(num) for j in range(s)]))
    return q[::division]


def multinomial(n, p):
    out = math.lgamma(sum(n) + 1) - sum(math.lgamma(x + 1) for x in n)
    for x, y in zip(n, p):
        if x and y <= 0:
            return -math.inf
        out += x * math.log(y) if x else 0.0
    return out


def dirichlet(n, p, d):
    cells = [(x, y * d) for x, y in zip(n, p) if y != 0]
    total, mass = sum(x for x, _ in cells), sum(a for _, a in cells)
    out = math.lgamma(total + 1) + math.lgamma(mass) - math.lgamma(total + mass)
    return out + sum(math.lgamma(x + a) - math.lgamma(a) - math.lgamma(x + 1) for x, a in cells)


def rows(spark, columns, data):
    """A small table with given types, ``columns`` as a DDL string."""
    return spark.createDataFrame(data, columns)
