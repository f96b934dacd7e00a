"""Adjusted odds ratios: binomial models with a logit link, all of them fitted at once by keyed sums.

A model's rows are its distinct combinations of categories. A pass over the rows of all models rates each row at its
model's present coefficients and sums, in expressions, the score by (model, category) and the information by
(model, pair of categories); what is solved afterwards is one small matrix for each model. No model's rows come
together in one task, and any number of models takes the same passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import logit
from cohortspark.functions.exposure import reference_of
from cohortspark.functions.text import array, quoted, struct
from cohortspark.operators.counts import COVARIATES, FIT_KEYS
from cohortspark.session import at_most, small_side, written

# Executors need no copy of this package: the solver travels with its tasks.
cloudpickle.register_pickle_by_value(logit)

_POINT = (
    "model long, at array<double>, accepted array<double>, best double, status int, passes int, "
    "variance array<double>, independent array<boolean>, loose array<boolean>, certain boolean"
)
#: Categories of all models up to which their coefficients, some kilobytes a model, are sent to every task.
FEW_CATEGORIES = 100_000
#: A model's number: a 64-bit hash of its keys, a null apart from every text. Models are some hundreds.
_MODEL = f"xxhash64(concat_ws('|', {', '.join(f'coalesce(string({k}), chr(0))' for k in FIT_KEYS)})) AS model"


def _categories(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``model``, ``term``, ``value`` and ``number`` of every category; a base has no number.

    Bases: the reference of the measure, the last year, else the category of most births, the first in text among
    equals. A model without its reference has no categories.
    """
    values = array(struct(place=str(i), term=quoted(t), value=f"string({t})") for i, t in enumerate(terms))
    sums = (
        rows.selectExpr("model", "measure", "births", f"inline({values})")
        .groupBy("model", "measure", "place", "term", "value")
        .agg(F.sum("births").alias("births"))
    )
    rank = (
        f"CASE term WHEN {quoted(terms[0])} THEN if(value = {reference_of()}, 0, 1) "
        "WHEN 'year' THEN -int(value) ELSE -births END"
    )
    return written(
        sums.selectExpr(
            "model", "place", "term", "value",
            f"row_number() OVER (PARTITION BY model, term ORDER BY {rank}, value) = 1 AS base",
            f"max(place = 0 AND value = {reference_of()}) OVER (PARTITION BY model) AS whole",
        )
        .filter("whole")
        .selectExpr(
            "model", "term", "value",
            "CASE WHEN NOT base THEN CAST(row_number() OVER "
            "(PARTITION BY model, base ORDER BY place, value) AS int) END AS number",
        ),
        "categories",
    )


def _design(rows: DataFrame, categories: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The rows with the number of each term's category, ``c1``, ``c2``, ..., null for a base."""
    found = categories.groupBy("model").agg(
        F.expr("map_from_entries(collect_list(struct(concat(term, ':', value), number))) AS numbers")
    )
    return written(
        rows.join(found, "model").selectExpr(
            "model", "measure", *terms, "births", "preterm",
            *[f"numbers[concat({quoted(f'{t}:')}, {t})] AS c{i}" for i, t in enumerate(terms, 1)],
        ),
        "design",
    )


def _pair_sums(rated: DataFrame, terms: int, values: Sequence[str], whole: tuple[str, str] = ()) -> DataFrame:
    """A row for each model: arrays ``a``, ``b``, ``s0``, ``s1``, ... of its pairs of categories and their sums.

    ``total`` and ``most`` are a sum and a maximum over all rows, if asked for by ``whole``.
    """
    numbers = ["0", *[f"c{i}" for i in range(1, terms + 1)]]
    names = [f"s{i}" for i in range(len(values))]
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i:]]
    entries = [struct(a=a, b=b, **{n: f"_{n}" for n in names}) for a, b in pairs]
    if whole:
        apart = dict(zip(names, whole))
        entries.insert(0, struct(a="-1", b="-1", **{n: apart.get(n, "0D") for n in names}))
    sums = (
        rated.selectExpr("*", *[f"CAST({v} AS double) AS _{n}" for n, v in zip(names, values)])
        .selectExpr("model", f"inline({array(entries)})")
        .filter("a IS NOT NULL AND b IS NOT NULL")
        .groupBy("model", "a", "b")
        .agg(*[F.sum(n).alias(n) for n in names], F.max(names[-1]).alias("most"))
    )
    listed = sums.groupBy("model").agg(
        F.expr(f"collect_list(CASE WHEN a >= 0 THEN struct(a, b, {', '.join(names)}) END) AS pairs"),
        F.expr("max(CASE WHEN a < 0 THEN s0 END) AS total"),
        F.expr("max(CASE WHEN a < 0 THEN most END) AS most"),
    )
    return listed.selectExpr("model", *[f"pairs.{x} AS {x}" for x in ("a", "b", *names)], "total", "most")


def _rated(design: DataFrame, points: DataFrame, terms: int, point: str) -> DataFrame:
    """The rows with ``eta`` and ``mean`` at their model's coefficients."""
    eta = " + ".join([f"{point}[0]", *[f"coalesce(get({point}, c{i}), 0D)" for i in range(1, terms + 1)]])
    return (
        design.join(points, "model")
        .withColumn("eta", F.expr(eta))
        .withColumn("mean", F.expr("1 / (1 + exp(-eta))"))
    )


def _fitted(design: DataFrame, terms: int, few: bool) -> DataFrame:
    """The last point of every model of a design; ``few``: the models were counted and may be broadcast."""
    mixed = "if(preterm > 0 AND preterm < births, 1, 0)"
    crossed = _pair_sums(design, terms, ("1", mixed, "births", "preterm"))
    points, ended = written(crossed.mapInPandas(logit.begin_all, _POINT), "points"), []
    likelihood = "preterm * eta - births * (greatest(eta, 0D) + log1p(exp(-abs(eta))))"
    while True:
        ended.append(points.filter(F.col("status") != logit.ACTIVE))
        points = points.filter(F.col("status") == logit.ACTIVE)
        if points.isEmpty():
            return written(reduce(DataFrame.unionByName, ended), "fitted_points")
        points = F.broadcast(points) if few else points
        rated = _rated(design, points.select("model", "at"), terms, "at")
        sums = _pair_sums(
            rated, terms, ("births * mean * (1 - mean)", "preterm - births * mean"), (likelihood, "abs(eta)")
        )
        points = written(sums.join(points, "model").mapInPandas(logit.move_all, _POINT), "points")


class Fits:
    """All models of a long table, fitted: ``rows`` that were fitted, ``points``, ``exact`` rows, and the rest.

    Set aside are rows without a value in some term, then categories of one outcome, then rows predicted exactly.
    """

    def __init__(self, tables: DataFrame, covariates: Sequence[str] = COVARIATES) -> None:
        self.terms = ("level", *covariates)
        count, kept = len(self.terms), ["model", "measure", *self.terms, "births", "preterm"]
        self.all_rows = written(tables.selectExpr(_MODEL, *FIT_KEYS, *self.terms, "births", "preterm"), "model_rows")
        self.once = drop_one_outcome(self.all_rows.select(*kept), self.terms, ("model",))
        left, parts = self.once, []
        while True:
            categories = _categories(left, self.terms)
            # Models are analyses times strata; their coefficients are sent to all tasks where they are few.
            few = at_most(categories, FEW_CATEGORIES)
            design = _design(left, categories, self.terms)
            points = _fitted(design, count, few)
            unsure = points.filter("NOT certain").select("model", "accepted")
            exact = written(
                _rated(design, unsure, count, "accepted")
                .filter("preterm = 0 OR preterm = births")
                .filter(f"abs(preterm / births - mean) < {logit.EXACT}D")
                .select(*kept),
                "exact",
            )
            if exact.isEmpty():
                parts.append((design, points, categories, exact))
                break
            again = exact.select("model").distinct()
            parts.append((*(x.join(again, "model", "left_anti") for x in (design, points, categories)), exact))
            same = [F.col(f"l.{t}") == F.col(f"e.{t}") for t in ("model", *self.terms)]
            rest = left.join(again, "model", "left_semi").alias("l").join(exact.alias("e"), same, "left_anti")
            left = written(rest, "left")
        self.design, self.points, self.categories, self.exact = (
            reduce(DataFrame.unionByName, frames) for frames in zip(*parts)
        )

    def aside(self) -> DataFrame:
        """``model`` and ``set_aside``, the births that no fit counts, ``exact`` of them predicted exactly."""
        sums = [
            x.groupBy("model").agg(F.sum("births").alias(name))
            for x, name in ((self.all_rows, "whole"), (self.once, "once"), (self.exact, "gone"))
        ]
        joined = sums[0].join(sums[1], "model", "left").join(sums[2], "model", "left")
        return joined.selectExpr(
            "model",
            "whole - coalesce(once, 0) + coalesce(gone, 0) AS set_aside",
            "coalesce(gone, 0) AS exact",
        )

    def fitted(self) -> DataFrame:
        """``model``, ``term``, ``value``, ``births``, ``preterm`` and ``fitted`` of every category of a fit.

        Rows predicted exactly count as they are. At the best coefficients fitted and preterm births are equal.
        """
        rated = _rated(self.design, self.points.select("model", "accepted"), len(self.terms), "accepted")
        rows = rated.selectExpr("model", *self.terms, "births", "preterm", "births * mean AS fitted").unionByName(
            self.exact.join(self.points.select("model"), "model", "left_semi").selectExpr(
                "model", *self.terms, "births", "preterm", "double(preterm) AS fitted"
            )
        )
        values = array(struct(term=quoted(t), value=f"string({t})") for t in self.terms)
        return (
            rows.selectExpr("model", "births", "preterm", "fitted", f"inline({values})")
            .groupBy("model", "term", "value")
            .agg(*[F.sum(c).alias(c) for c in ("births", "preterm", "fitted")])
        )

    def level_odds(self) -> DataFrame:
        """``model``, ``level`` and ``odds_ratio`` from the births fitted to each level and to the reference.

        Without covariates they are the odds ratios of the coefficients. Fitted births of a category are whole numbers;
        rounded, they are free of what the solver leaves in the last digits, which decides how a tie is rounded.
        """
        measures = self.all_rows.select("model", "measure").distinct()
        odds = "ln(round(fitted, 6) / (births - round(fitted, 6)))"
        reference = f"max(if(value = {reference_of()}, {odds}, NULL)) OVER (PARTITION BY model)"
        return (
            self.fitted().filter("term = 'level'").join(measures, "model")
            .selectExpr("model", "value AS level", f"exp({odds} - {reference}) AS odds_ratio")
        )

    def coefficients(self) -> DataFrame:
        """``model``, ``term``, ``value``, ``beta``, ``variance`` and ``loose`` of every category but the bases."""
        return self.categories.filter("number IS NOT NULL").join(self.points, "model").selectExpr(
            "model", "term", "value", "get(accepted, number) AS beta", "get(variance, number) AS variance",
            "get(loose, number) AS loose", f"status = {logit.DONE} AS converged",
        )

    def estimates(self, with_fitted: bool = True) -> DataFrame:
        """A row for each level of each model but its reference; ``fitted`` only if asked for."""
        levels = (
            self.all_rows.filter(f"level <> {reference_of()}")
            .select("model", F.col("level").cast("string").alias("level"))
            .distinct()
        )
        of_level = F.col("term") == "level"
        found = (
            self.coefficients()
            .filter(of_level & ~F.col("loose") & F.col("converged"))
            .selectExpr(
                "model", "value AS level", "exp(beta) AS odds_ratio",
                *[f"exp(beta {sign} {logit.Z}D * sqrt(variance)) AS {name}_limit" for sign, name in (("-", "lower"), ("+", "upper"))],
            )
        )
        rows = (
            levels.join(self.aside(), "model")
            .join(self.all_rows.select("model", *FIT_KEYS).distinct(), "model")
            .join(found, ["model", "level"], "left")
            .join(self.points.selectExpr("model", f"status = {logit.DONE} AS converged"), "model", "left")
            .withColumn("converged", F.expr("coalesce(converged, true)"))
        )
        limits = ["odds_ratio", "lower_limit", "upper_limit"]
        if with_fitted:
            fitted = self.fitted().filter(of_level).select("model", F.col("value").alias("level"), "fitted")
            rows, limits = rows.join(fitted, ["model", "level"], "left"), [*limits, "fitted"]
        return rows.select(*FIT_KEYS, "level", *limits, "set_aside", "converged")


def tradable(tables: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``term`` and ``value`` of every category whose coefficient others of its model can take over."""
    rows = written(tables.selectExpr(_MODEL, *FIT_KEYS, *terms, "births", "preterm"), "model_rows")
    left = drop_one_outcome(rows.select("model", "measure", *terms, "births", "preterm"), terms, ("model",))
    categories = _categories(left, terms)
    crossed = _pair_sums(_design(left, categories, terms), len(terms), ("1", "1", "births", "preterm"))
    points = crossed.mapInPandas(logit.begin_all, _POINT).select("model", "loose")
    return (
        categories.filter("number IS NOT NULL")
        .join(points, "model")
        .filter("get(loose, number)")
        .join(rows.select("model", *FIT_KEYS).distinct(), "model")
        .select(*FIT_KEYS, "term", "value")
    )


def fit_all(tables: DataFrame, covariates: Sequence[str] = COVARIATES, with_fitted: bool = True) -> DataFrame:
    """Every model of a long table of models: a row for each level but the reference.

    A level that is set aside, or whose coefficient others can take over, has no odds ratio. ``fitted`` is the preterm
    births fitted to a level.
    """
    return Fits(tables, covariates).estimates(with_fitted)


def single_outcome_values(tables: DataFrame, terms: Sequence[str], keys: Sequence[str] = FIT_KEYS) -> DataFrame:
    """The values of each term of each model whose births are all preterm or all term."""
    values = array(struct(term=quoted(t), value=f"string({t})") for t in terms)
    return (
        tables.selectExpr(*keys, "births", "preterm", f"inline({values})")
        .groupBy(*keys, "term", "value")
        .agg(F.expr("sum(births) AS b"), F.expr("sum(preterm) AS p"))
        .filter("p = 0 OR p = b")
    )


def drop_one_outcome(tables: DataFrame, terms: Sequence[str], keys: Sequence[str] = FIT_KEYS) -> DataFrame:
    """The models without the values of one outcome, repeated until no model holds one.

    A row without a value in some term belongs to no category and goes first. Each round finds at least one value, so
    there are no more rounds than values. A round sums the values of all models in one shuffle; what it finds is few
    and written, one list for each model, and the rows are written once, at the end.
    """
    tables = tables.na.drop(subset=list(terms))
    own = array(f"concat({quoted(f'{t}:')}, {t})" for t in terms)
    left, gone = tables, None
    while True:
        found = single_outcome_values(left, terms, keys)
        listed = found.groupBy(*keys).agg(F.expr("collect_list(concat(term, ':', value)) AS _gone"))
        listed = written(listed, "one_outcome")
        if listed.isEmpty():
            return written(left, "left")
        gone = listed if gone is None else gone.unionByName(listed)
        lists = gone.groupBy(*keys).agg(F.expr("flatten(collect_list(_gone)) AS _gone"))
        left = (
            tables.join(small_side(lists), list(keys), "left")
            .filter(f"_gone IS NULL OR NOT arrays_overlap(_gone, {own})")
            .drop("_gone")
        )


def reference_values(tables: DataFrame, term: str) -> DataFrame:
    """The reference of a covariate in each model: latest year, or most births with ties by text."""
    sums = tables.groupBy(*FIT_KEYS, term).agg(F.sum("births").alias("births"))
    if term == "year":
        chosen = F.max(term)
    else:
        text = F.col(term).cast("string")
        chosen = F.expr("min_by(value, rank)")
        sums = sums.withColumn("value", F.col(term)).withColumn(
            "rank", F.struct((-F.col("births")).alias("b"), text.alias("t"))
        )
    return sums.groupBy(*FIT_KEYS).agg(chosen.cast("string").alias("reference")).withColumn(
        "term", F.lit(term)
    )


def estimate_rows(counts: DataFrame, crude: DataFrame, fitted: DataFrame) -> DataFrame:
    """One row per non-reference level and model, in the published columns.

    The crude model has no strata, so stratum rows come from the adjusted model alone.
    """
    keys = [*FIT_KEYS, "level"]
    base = counts.filter(F.expr(f"level <> {reference_of()}")).selectExpr(
        *keys, f"{reference_of()} AS reference", "births", "preterm AS preterm_births"
    )
    limits = ["odds_ratio", "lower_limit", "upper_limit"]
    plain = crude.filter("stratum_variable = ''").selectExpr(
        *keys, "reference", "births", "preterm AS preterm_births", "'crude' AS model", *limits
    )
    with_covariates = base.join(fitted.select(*keys, *limits), keys, "left").selectExpr(
        *keys, "reference", "births", "preterm_births", "'adjusted' AS model", *limits
    )
    return plain.unionByName(with_covariates).withColumn("source", F.lit("observed"))
