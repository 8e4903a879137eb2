"""Maximum likelihood and interval ends by rounds over a table of fits, all in the JVM.

A fit is one row. Its parameters are logarithms in one array: rates per block, start shares, time
scales (if free), concentration (if any). A round takes the daily shares at the point to try and at
one neighbour per parameter, so it costs one trajectory per parameter and no grid is spanned; the
expected information comes from the differences, and a small linear system gives the next point. All
fits of a job go through their rounds together, as projections without an exchange; every few rounds
the table is cut by a reliable checkpoint, and the rounds end when all rows have settled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideshare.functions.linear import axpy, dot, largest, solve
from tideshare.functions.numbers import (
    array_sum,
    digamma,
    dirichlet_head,
    dirichlet_term,
    let,
    multinomial_term,
)
from tideshare.plans.likelihood import bin_probabilities
from tideshare.plans.series import materialise
from tideshare.plans.trajectory import scaled_weights, trajectory_column

# Parameter bounds.
RATE_BOUNDS = (1e-10, 10.0)
SHARE_BOUNDS = (1e-10, 1.0)
SCALE_BOUNDS = (1e-10, 10.0)
CONCENTRATION_BOUNDS = (1e-10, 1e5)

#: Relative step of the differences.
STEP = 1e-6
#: Rounds of a fit, of an interval end, and of bracketing one; a row that has settled takes no more.
FIT_ROUNDS, END_ROUNDS, BRACKET_ROUNDS = 200, 60, 400
#: Rounds between two checkpoints.
ROUNDS_A_JOB = 2
#: Damping of the first step.
FIRST_DAMP = 1e-4
#: What a further round may gain in log-likelihood for a fit to count as settled.
SETTLED = 1e-9
#: A counted category below this share puts a point out of reach.
LEAST_SHARE = 1e-14


@dataclass(frozen=True)
class Model:
    """The columns of one row that the likelihood needs.

    ``options`` has ``alpha, theta, weights, time_scale, dirichlet``, ``block`` is the rate block per subject (0 = rate of the baseline), ``intro`` the first day per
    subject, ``bins`` the days and counts, baseline last.
    """

    options: object
    block: Column
    intro: Column
    n_days: Column
    bins: Column

    @property
    def rates(self) -> Column:
        return F.coalesce(F.array_max(self.block), F.lit(0))

    @property
    def subjects(self) -> Column:
        return F.size(self.block)

    @property
    def model_size(self) -> Column:
        """Parameters of the daily shares: all but the concentration."""
        return self.rates + self.subjects * (2 if self.options.time_scale else 1)

    @property
    def size(self) -> Column:
        return self.model_size + (1 if self.options.dirichlet else 0)

    def bounds(self, side: int) -> Column:
        """Logarithms of the lower (0) or upper (1) bounds."""
        ln = lambda b: F.ln(F.lit(b[side]))
        parts = [F.array_repeat(ln(RATE_BOUNDS), self.rates), F.array_repeat(ln(SHARE_BOUNDS), self.subjects)]
        if self.options.time_scale:
            parts.append(F.array_repeat(ln(SCALE_BOUNDS), self.subjects))
        if self.options.dirichlet:
            parts.append(F.array(ln(CONCENTRATION_BOUNDS)))
        return F.concat(*parts)

    def clipped(self, x: Column) -> Column:
        low = F.zip_with(x, self.bounds(0), lambda a, b: F.greatest(a, b))
        return F.zip_with(low, self.bounds(1), lambda a, b: F.least(a, b))

    def pack(self, k: Column, qt: Column, c: Column | None = None, d: Column | None = None) -> Column:
        """Parameters from values per subject; the rate of a block is that of its first subject."""
        firsts = F.when(self.rates > 0, F.transform(
            F.sequence(F.lit(1), F.greatest(self.rates, F.lit(1))),
            lambda b: F.element_at(k, F.array_position(self.block, b).cast("int")))).otherwise(F.array().cast("array<double>"))
        parts = [firsts, qt]
        if self.options.time_scale:
            parts.append(c)
        if self.options.dirichlet:
            parts.append(F.array(d))
        # a value of zero lies under every bound
        logs = F.transform(F.concat(*parts), lambda v: F.when(v > 0, F.ln(v)).otherwise(F.lit(-1e3)))
        return self.clipped(logs)

    def unpack(self, x: Column) -> Column:
        """Struct of ``k, qt, c`` per subject and ``d`` (NaN without a concentration)."""
        s, n = self.subjects, self.rates
        k = F.transform(self.block, lambda b: F.when(b == 0, F.lit(1.0)).otherwise(F.exp(F.element_at(x, F.greatest(b, F.lit(1))))))
        qt = F.transform(F.slice(x, n + 1, s), lambda v: F.exp(v))
        c = F.transform(F.slice(x, n + s + 1, s), lambda v: F.exp(v)) if self.options.time_scale else F.transform(self.block, lambda b: F.lit(1.0))
        d = F.exp(F.element_at(x, -1)) if self.options.dirichlet else F.lit(float("nan"))
        return F.struct(k.alias("k"), qt.alias("qt"), c.alias("c"), d.alias("d"))

    def probabilities(self, x: Column) -> Column:
        """Share per category, bin by bin."""
        o = self.options

        def of(u: Column) -> Column:
            def bins(w: list[float] | Column) -> Column:
                traj = trajectory_column(u["k"], u["qt"], self.intro, self.n_days, w, len(o.weights))
                return let(traj, lambda t: F.transform(self.bins, lambda b: bin_probabilities(t, b)))

            if not o.time_scale:
                return bins(o.weights)
            return let(scaled_weights(u["c"], o.alpha, o.theta, len(o.weights)), bins)

        return let(self.unpack(x), of)

    def loglik(self, p: Column, x: Column) -> Column:
        """Log-likelihood without the part that no parameter changes; null out of reach."""
        d = F.exp(F.element_at(x, -1))

        def one_bin(q: Column, b: Column) -> Column:
            n = b["n"]
            lost = F.exists(F.zip_with(q, n, lambda a, m: (m > 0) & (a < LEAST_SHARE)), lambda bad: bad)
            if not self.options.dirichlet:
                value = array_sum(F.zip_with(n, q, lambda m, a: multinomial_term(m, a)))
            else:
                value = self._dirichlet_bin(q, n, d)
            return F.when(~lost, value)

        return array_sum(F.zip_with(p, self.bins, one_bin))

    @staticmethod
    def _dirichlet_bin(q: Column, n: Column, d: Column) -> Column:
        total = F.aggregate(n, F.lit(0).cast("bigint"), lambda a, m: a + m)
        terms = array_sum(F.zip_with(n, q, lambda m, a: F.when(a > 0, dirichlet_term(m, a * d)).otherwise(F.lit(0.0))))
        mass = array_sum(q) * d
        return F.when(total == 0, F.lit(0.0)).otherwise(
            let(total, lambda m: let(mass, lambda a: dirichlet_head(m, a))) + terms)

    def cells(self, p: Column, x: Column) -> Column:
        """Struct of arrays over all cells: root ``r`` of the weight and score ``z`` divided by it."""
        d = F.exp(F.element_at(x, -1))

        def one_bin(q: Column, b: Column) -> Column:
            total = F.aggregate(b["n"], F.lit(0).cast("bigint"), lambda a, m: a + m).cast("double")

            def cell(t: Column, head: Column | None) -> Column:
                if head is None:
                    weight, score = (lambda a: t / a), (lambda m, a: m / a)
                else:
                    weight = lambda a: t * (1 + d) / (t + d) / a
                    score = lambda m, a: d * (digamma(m + a * d) - digamma(a * d) + head)
                return F.zip_with(b["n"], q, lambda m, a: F.when((a > 0) & (t > 0), let(
                    F.sqrt(weight(a)), lambda r: F.struct(r.alias("r"), (score(m, a) / r).alias("z")))).otherwise(
                        F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("z"))))

            if not self.options.dirichlet:
                return let(total, lambda t: cell(t, None))
            mass = array_sum(q) * d
            return let(total, lambda t: let(let(mass, lambda a: digamma(a) - digamma(t + a)), lambda head: cell(t, head)))

        flat = F.flatten(F.zip_with(p, self.bins, one_bin))
        return let(flat, lambda f: F.struct(F.transform(f, lambda v: v["r"]).alias("r"), F.transform(f, lambda v: v["z"]).alias("z")))

    def concentration_slope(self, p: Column, x: Column, factor: float) -> Column:
        """Derivative by the logarithm of the concentration, at ``factor`` times it."""
        d = F.exp(F.element_at(x, -1)) * factor

        def one_bin(q: Column, b: Column) -> Column:
            total = F.aggregate(b["n"], F.lit(0).cast("bigint"), lambda a, m: a + m).cast("double")
            mass = array_sum(q) * d
            head = let(mass, lambda a: digamma(a) - digamma(total + a))
            return let(head, lambda h: array_sum(F.zip_with(b["n"], q, lambda m, a: F.when(
                a > 0, a * d * (digamma(m + a * d) - digamma(a * d) + h)).otherwise(F.lit(0.0)))))

        return array_sum(F.zip_with(p, self.bins, one_bin))

    def sums(self, rows: Column, z: Column, bend: Column | None) -> Column:
        """Struct of the gradient ``g`` and the expected information ``h`` from weighted slopes per parameter.

        The concentration has a slope and a curvature of its own (``bend``) and no part in the rest.
        """
        g = F.transform(rows, lambda a: dot(a, z))
        h = F.transform(rows, lambda a: F.transform(rows, lambda b: dot(a, b)))
        if bend is not None:
            last = F.array_append(F.array_repeat(F.lit(0.0), self.model_size), bend["h"])
            g, h = F.array_append(g, bend["g"]), F.array_append(F.transform(h, lambda r: F.array_append(r, F.lit(0.0))), last)
        return F.struct(g.alias("g"), h.alias("h"))

    def bend(self, p: Column, x: Column) -> Column:
        """Struct of slope ``g`` and curvature ``h`` by the logarithm of the concentration."""
        step = 1e-3
        up, down = (self.concentration_slope(p, x, math.exp(f)) for f in (step, -step))
        return F.struct(self.concentration_slope(p, x, 1.0).alias("g"),
                        F.greatest(F.abs(up - down) / (2 * step), F.lit(1e-8)).alias("h"))

    def free(self, x: Column, g: Column) -> Column:
        """Whether a parameter may move: not where its bound holds it."""
        at = F.arrays_zip(x.alias("x"), g.alias("g"), self.bounds(0).alias("lo"), self.bounds(1).alias("hi"))
        return F.transform(at, lambda v: ~(((v["x"] <= v["lo"]) & (v["g"] < 0)) | ((v["x"] >= v["hi"]) & (v["g"] > 0))))

    @staticmethod
    def system(h: Column, free: Column, damp: Column) -> Column:
        """Damped information of the free parameters, identity for the others."""
        def row(r: Column, i: Column) -> Column:
            return F.when(free[i], F.transform(r, lambda v, j: F.when(
                j == i, v + damp * F.greatest(v, F.lit(1e-10)) + 1e-12).when(free[j], v).otherwise(F.lit(0.0)))).otherwise(
                    F.transform(r, lambda v, j: F.when(j == i, F.lit(1.0)).otherwise(F.lit(0.0))))

        return F.transform(h, row)


def first_of(rows: Column) -> Column:
    """First right side of every row."""
    return F.transform(rows, lambda r: r[0])


def neighbours(model: Model) -> Column:
    """The point to try and one point beside it per parameter of the shares."""
    moved = F.transform(F.sequence(F.lit(1), F.greatest(model.model_size, F.lit(1))), lambda i: F.transform(
        "trial", lambda v, j: F.when(j == i - 1, v + STEP).otherwise(v)))
    return F.concat(F.array(F.col("trial")), F.slice(moved, F.lit(1), model.model_size))


def begun(rows: DataFrame, start: Column) -> DataFrame:
    """Rows that have tried nothing yet: ``start`` is the first point."""
    nothing = F.array().cast("array<double>")
    return rows.withColumn("trial", start).withColumns({
        "x": F.col("trial"), "ll": F.lit(None).cast("double"), "g": nothing, "h": F.array().cast("array<array<double>>"),
        "damp": F.lit(FIRST_DAMP), "boost": F.lit(1.0), "last": F.lit(1e300), "ok": F.lit(False), "done": F.lit(False)})


class Steps:
    """The projections of a round, one after the other. They are built once and used in every round: putting
    the expressions together takes longer than analysing them."""

    def __init__(self) -> None:
        self.columns: list[dict[str, Column]] = []

    def withColumns(self, columns: dict[str, Column]) -> Steps:  # noqa: N802
        self.columns.append(columns)
        return self

    def withColumn(self, name: str, column: Column) -> Steps:  # noqa: N802
        return self.withColumns({name: column})

    def of(self, rows: DataFrame) -> DataFrame:
        """The rows after the round, with the columns they had."""
        kept = rows.columns
        for columns in self.columns:
            rows = rows.withColumns(columns)
        return rows.select(*kept)


def one_round(model: Model, climbs: bool, decide: Callable[[Steps], Steps]) -> Steps:
    """Evaluate the point to try and its neighbours, take it or not, and let ``decide`` give the next.

    If the rounds must climb, a point that is not better than the last is given up: the damping grows,
    and the slopes of the last give another step. Columns of rows that are done stay as they are and
    cost nothing. Only projections: the rows stay where they are.
    """
    df = Steps()
    open_ = ~F.col("done")
    first = F.col("ll").isNull()
    better = F.col("_t").isNotNull() & (first | (F.col("_t") > F.col("ll"))) if climbs else F.col("_t").isNotNull()
    df = df.withColumn("_p", F.when(open_, F.transform(neighbours(model), model.probabilities)))
    df = df.withColumn("_t", F.when(open_, model.loglik(F.col("_p")[0], F.col("trial"))))
    df = df.withColumns({"_better": open_ & F.coalesce(better, F.lit(False)), "_base": F.when(open_, F.flatten(F.col("_p")[0]))})
    df = df.withColumns({"_c": F.when(F.col("_better"), model.cells(F.col("_p")[0], F.col("trial"))),
                         "_bend": F.when(F.col("_better"), model.bend(F.col("_p")[0], F.col("trial"))) if model.options.dirichlet else F.lit(None)})
    slopes = F.transform(F.slice("_p", F.lit(2), model.model_size), lambda q: F.zip_with(
        F.zip_with(F.flatten(q), "_base", lambda a, b: (a - b) / STEP), F.col("_c.r"), lambda a, r: a * r))
    df = df.withColumn("_rows", F.when(F.col("_better"), slopes))
    sums = model.sums(F.col("_rows"), F.col("_c.z"), F.col("_bend") if model.options.dirichlet else None)
    df = df.withColumn("_s", F.when(F.col("_better"), sums))
    lost = open_ & ~F.col("_better") & (first if climbs else F.lit(True))
    damp = F.when(~open_ | (F.col("_better") & first), F.col("damp")).when(
        F.col("_better"), F.greatest(F.col("damp") / 10, F.lit(1e-8))).otherwise(F.greatest(F.col("damp") * 10, F.lit(FIRST_DAMP)))
    taken = {"x": "trial", "ll": "_t", "g": "_s.g", "h": "_s.h"}
    df = df.withColumns({n: F.when(F.col("_better"), F.col(c)).otherwise(F.col(n)) for n, c in taken.items()} | {"damp": damp, "done": ~open_ | lost})
    return decide(df)


def rounds(rows: DataFrame, model: Model, climbs: bool, decide: Callable[[Steps], Steps], most: int) -> DataFrame:
    """Rounds until every row is done, a checkpoint after every ``ROUNDS_A_JOB``. The driver sees whether rows are open."""
    steps = one_round(model, climbs, decide)
    for at in range(0, most, ROUNDS_A_JOB):
        for _ in range(min(ROUNDS_A_JOB, most - at)):
            rows = steps.of(rows)
        rows = materialise(rows)
        if rows.filter("not done").isEmpty():
            break
    return rows


def verdict(df: Steps, value: Column) -> Steps:
    """Take ``trial, ok, done`` from a struct for the rows that are open."""
    df = df.withColumn("_v", F.when(~F.col("done"), value))
    return df.withColumns({n: F.when(F.col("done"), F.col(n)).otherwise(F.col(f"_v.{n}")) for n in ("trial", "ok", "done")})


def scoring_step(df: Steps, model: Model, fixed: Column | None = None) -> Steps:
    """Add ``_gain`` and ``_step`` of the damped scoring step at ``x``."""
    free = model.free(F.col("x"), F.col("g"))
    if fixed is not None:
        free = F.transform(free, lambda f, j: f & (j != fixed - 1))
    df = df.withColumn("_free", F.when(~F.col("done"), free))
    df = df.withColumn("_g", F.zip_with("g", "_free", lambda a, on: F.when(on, a).otherwise(F.lit(0.0))))
    solved = first_of(solve(model.system(F.col("h"), F.col("_free"), F.col("damp")), F.transform("_g", lambda v: F.array(v))))
    # a row that starts out of reach has no slopes yet
    df = df.withColumn("_step", F.when(~F.col("done") & (F.size("h") > 0), solved))
    df = df.withColumn("_gain", dot(F.col("_g"), F.col("_step")))
    # gains that hardly fall tell of a parameter on its way to a bound: its steps get longer
    slow = F.col("_better") & (F.col("_gain") > 0.2 * F.col("last"))
    return df.withColumn("boost", F.when(F.coalesce(slow, F.lit(False)), F.least(F.col("boost") * 2, F.lit(16.0))).otherwise(F.lit(1.0))).withColumn(
        "last", F.coalesce("_gain", "last"))


def lengthened() -> Column:
    """The next point of a scoring round."""
    step = F.transform("_step", lambda v: v * F.col("boost"))
    return stepped(F.col("x"), step, 3.0 * F.col("boost"))


def settled() -> Column:
    """Nothing more to gain, or no way found to what little is left."""
    gain, damp = F.col("_gain"), F.col("damp")
    return F.coalesce((damp <= 1e-3) & ((gain < SETTLED) | (~F.col("_better") & (gain < 1e-7))) | (damp > 1e8) & (gain < 1e-6), F.lit(False))


def maximise(rows: DataFrame, model: Model, start: Column) -> DataFrame:
    """Add ``x, ll, ok``: the end of damped scoring rounds within the bounds.

    ``ll`` lacks the constant part and is null where the start is out of reach; ``ok`` says whether the fit has
    settled.
    """
    def decide(df: Steps) -> Steps:
        df = scoring_step(df, model).withColumn("_ok", settled())
        return verdict(df, F.struct(model.clipped(lengthened()).alias("trial"), F.col("_ok").alias("ok"),
                                    (F.col("_ok") | (F.col("damp") > 1e8)).alias("done")))

    return rounds(begun(rows, start), model, True, decide, FIT_ROUNDS)


def extreme(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``x, ll, ok``: smallest (``side`` -1) or largest (+1) value of parameter ``place`` with ll >= ``cut``.

    Rows start at ``best``, whose value is ``top``. Each round solves the quadratic model of the constraint exactly. Not ``ok``
    where a row runs into the bound of its parameter, leaves the reach of the model or does not settle.
    """
    place, side, cut = F.col("place"), F.col("side"), F.col("cut")

    def decide(df: Steps) -> Steps:
        free = F.transform(model.free(F.col("x"), F.col("g")), lambda f, j: f | (j == place - 1))
        df = df.withColumn("_free", F.when(~F.col("done"), free))
        df = df.withColumn("_g", F.zip_with("g", "_free", lambda a, on: F.when(on, a).otherwise(F.lit(0.0))))
        sides = F.transform("_g", lambda a, j: F.array(F.when(j == place - 1, F.lit(1.0)).otherwise(F.lit(0.0)), a))
        df = df.withColumn("_z", F.when(~F.col("done"), solve(model.system(F.col("h"), F.col("_free"), F.lit(1e-9)), sides)))
        room = 2 * (F.col("ll") - cut) + dot(F.col("_g"), F.transform("_z", lambda r: r[1]))
        pull = side * F.sqrt(F.greatest(room, F.lit(0.0)) / F.greatest(F.element_at("_z", place)[0], F.lit(1e-300)))
        df = df.withColumn("_pull", pull).withColumn("_step", F.transform("_z", lambda r: r[1] + F.col("_pull") * r[0]))
        df = df.withColumn("_x", model.clipped(stepped(F.col("x"), F.col("_step"), 1.0)))
        near = (F.abs(F.col("ll") - cut) < 1e-6) & (largest(F.zip_with("_x", "x", lambda a, b: a - b)) < 1e-6)
        own = F.element_at("_x", place)
        edge = F.when(side < 0, own <= F.element_at(model.bounds(0), place)).otherwise(own >= F.element_at(model.bounds(1), place))
        df = df.withColumns({"_ok": F.coalesce(near, F.lit(False)), "_edge": F.coalesce(edge, F.lit(True))})
        return verdict(df, F.struct(F.col("_x").alias("trial"), F.col("_ok").alias("ok"), (F.col("_ok") | F.col("_edge")).alias("done")))

    return rounds(begun(rows, F.col("best")), model, False, decide, END_ROUNDS)


def bracketed(rows: DataFrame, model: Model) -> DataFrame:
    """The same by steps outwards and a shrinking bracket, the other parameters refitted for each value.

    ``good`` is the last point inside, ``bad`` the nearest value known to be outside. When the refit of a value
    has settled, the bracket moves and the next value is tried: where the root of the fall below the maximum
    ``top``, nearly a straight line, meets that of the cut. The bound counts as the end where the likelihood does
    not fall under the cut before it; ``ok`` unless rounds run out.
    """
    # aimed at a little above the cut: an end that rounding puts below the aim is still inside
    place, side, cut = F.col("place"), F.col("side"), F.col("cut") + 5e-7
    bound = F.element_at(F.when(side < 0, model.bounds(0)).otherwise(model.bounds(1)), place)

    def fall(ll: Column) -> Column:
        return F.sqrt(F.greatest(F.col("top") - ll, F.lit(0.0)))

    def following(good: Column, good_ll: Column, bad: Column, bad_ll: Column, width: Column) -> Column:
        """The next value to try."""
        own = F.element_at(good, place)
        out = F.when(side < 0, F.greatest(own - width, bound)).otherwise(F.least(own + width, bound))
        # a little beyond the meeting point, so that the bracket closes from both sides
        part = (fall(cut) - fall(good_ll)) / F.greatest(fall(bad_ll) - fall(good_ll), F.lit(1e-12))
        between = own + (bad - own) * F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.coalesce(part, F.lit(0.5))))
        return F.when(bad.isNull(), out).otherwise(between)

    def at(x: Column, value: Column) -> Column:
        return F.transform(x, lambda a, j: F.when(j == place - 1, value).otherwise(a))

    def decide(df: Steps) -> Steps:
        # a value where the model has no likelihood at all lies outside
        df = df.withColumn("_lost", F.col("done") & F.col("ll").isNull()).withColumn("done", F.col("done") & ~F.col("_lost"))
        df = scoring_step(df, model, place).withColumn("_end", F.col("_lost") | settled() | (F.col("damp") > 1e8))
        value, own = F.element_at("trial", place), F.element_at("good", place)
        df = df.withColumns({"_value": value, "_own": own, "_in": F.coalesce(F.col("ll") >= cut - 5e-7, F.lit(False)) & F.col("_end"),
                             "_out": F.coalesce(F.col("ll") < cut - 5e-7, F.lit(True)) & F.col("_end")})
        last = F.col("_in") & F.col("bad").isNull() & (F.col("_value") == bound)
        narrow = F.coalesce(F.abs(F.coalesce(F.when(F.col("_out"), F.col("_value")), F.col("bad"))
                                  - F.when(F.col("_in"), F.col("_value")).otherwise(F.col("_own"))) <= 1e-7, F.lit(False))
        close = narrow | (F.col("_in") & F.coalesce(F.col("ll") - cut < 1e-6, F.lit(False)))
        df = df.withColumn("_closed", F.col("_end") & (last | close))
        open_ = ~F.col("done")
        df = df.withColumns({
            "good": F.when(open_ & F.col("_in"), F.col("x")).otherwise(F.col("good")),
            "good_ll": F.when(open_ & F.col("_in"), F.col("ll")).otherwise(F.col("good_ll")),
            "bad": F.when(open_ & F.col("_out"), F.col("_value")).otherwise(F.col("bad")),
            "bad_ll": F.when(open_ & F.col("_out"), F.col("ll")).otherwise(F.col("bad_ll")),
            "width": F.when(open_ & F.col("_in"), F.col("width") * 2).otherwise(F.col("width"))})
        df = df.withColumn("_next", at(F.col("good"), following(F.col("good"), F.col("good_ll"), F.col("bad"), F.col("bad_ll"), F.col("width"))))
        trial = F.when(F.col("_end"), F.col("_next")).otherwise(model.clipped(lengthened()))
        df = verdict(df, F.struct(trial.alias("trial"), F.col("_closed").alias("ok"), F.col("_closed").alias("done")))
        # a new value starts a fit of its own
        return df.withColumns({"ll": F.when(open_ & F.col("_end"), F.lit(None)).otherwise(F.col("ll")),
                               "damp": F.when(open_ & F.col("_end"), F.lit(FIRST_DAMP)).otherwise(F.col("damp"))})

    none = F.lit(None).cast("double")
    first = rows.withColumns({"good": F.col("best"), "good_ll": F.col("top"), "bad": none, "bad_ll": none, "width": F.lit(0.4)})
    start = at(F.col("best"), following(F.col("best"), F.col("top"), none, none, F.lit(0.4)))
    done = rounds(begun(first, start), model, True, decide, BRACKET_ROUNDS)
    return done.withColumns({"x": F.col("good"), "ll": F.col("good_ll")})


def stepped(x: Column, step: Column, most: Column | float) -> Column:
    """``x`` plus the step, shortened so that no parameter moves by more than ``most``."""
    return let(F.least(F.lit(1.0), most / F.greatest(largest(step), F.lit(1e-300))), lambda r: axpy(r, step, x))


def concentration(model: Model, p: Column, cut: float) -> Column:
    """Struct ``d, d_lb, d_ub, ll``: best concentration for given shares and where the likelihood falls by ``cut``.

    The shares stay, so the trajectory is folded once. The slope by the logarithm changes its sign once:
    halving finds the best value between the bounds, and halving on either side of it the ends.
    """
    low, high = (math.log(b) for b in CONCENTRATION_BOUNDS)
    slope = lambda v: model.concentration_slope(p, F.array(v), 1.0)
    ll = lambda v: F.coalesce(model.loglik(p, F.array(v)), F.lit(float("-inf")))

    def halved(a: Column, b: Column, goes_up: Callable[[Column], Column]) -> Column:
        def half(s: Column, _: Column) -> Column:
            return let((s["a"] + s["b"]) / 2, lambda m: F.when(goes_up(m), F.struct(m.alias("a"), s["b"].alias("b")))
                       .otherwise(F.struct(s["a"].alias("a"), m.alias("b"))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("a"), b.alias("b")), half, lambda s: (s["a"] + s["b"]) / 2)

    def ends(best: Column) -> Column:
        def of(top: Column) -> Column:
            inside = lambda v: ll(v) >= top - cut
            lower = F.when(inside(F.lit(low)), F.lit(low)).otherwise(halved(F.lit(low), best, lambda v: ~inside(v)))
            upper = F.when(inside(F.lit(high)), F.lit(high)).otherwise(halved(best, F.lit(high), inside))
            return F.struct(F.exp(best).alias("d"), F.exp(lower).alias("d_lb"), F.exp(upper).alias("d_ub"), top.alias("ll"))

        return let(ll(best), of)

    return let(F.when(slope(F.lit(high)) > 0, F.lit(high)).otherwise(halved(F.lit(low), F.lit(high), lambda v: slope(v) > 0)), ends)
