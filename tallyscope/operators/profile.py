"""One wide pass over the facts for everything that is a sum, count or extreme.

``GROUPING SETS`` over (by), (by, day), (by, category) and, on demand, (by, product) give all aggregates
that the judgments, the detectors and the metrics share from a single scan; the result is as small as its
days, categories and products and is landed once.  Months, weekdays and gaps between days are derived
from the days.  A second scan (``tails``) counts what depends on a group's own mean, deviation and 95th
percentile.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_key, epoch_micros
from ..model import AMOUNT, CATEGORY, OUTLIER, PRODUCT, QTY, TS, Roles
from .common import Facts, attach

Z = 3.5


def negative() -> Column:
    return F.coalesce(F.col(AMOUNT) < 0, F.lit(False)) | F.coalesce(F.col(QTY) < 0, F.lit(False))


def aggregates() -> dict[str, Column]:
    """Name -> aggregate over fact rows; the same for every grouping set."""
    amt = F.coalesce(F.col(AMOUNT), F.lit(0.0))
    kept = ~F.col(OUTLIER) & F.col(AMOUNT).isNotNull()
    return {
        "rows": F.count("*"),
        "amounts": F.count(AMOUNT),
        "quantities": F.count(QTY),
        "amount_sum": F.sum(amt),
        "quantity_sum": F.sum(F.coalesce(F.col(QTY), F.lit(0.0))),
        # a missing or zero amount counts as one
        "ones_sum": F.sum(F.when(F.col(AMOUNT).isNull() | (F.col(AMOUNT) == 0), F.lit(1.0)).otherwise(F.col(AMOUNT))),
        "mean": F.avg(AMOUNT),
        "deviation": F.stddev_pop(AMOUNT),
        "outliers": F.count_if(F.col(OUTLIER)),
        "outlier_sum": F.sum(F.when(F.col(OUTLIER), amt)),
        "kept": F.count_if(kept),
        "kept_sum": F.sum(F.when(kept, F.col(AMOUNT))),
        "negatives": F.count_if(negative()),
        "negative_sum": F.sum(F.when(negative(), amt)),
        "zeros": F.count_if(F.col(AMOUNT) == 0),
        "first_us": F.min(epoch_micros(TS)),
        "last_us": F.max(epoch_micros(TS)),
    }


COUNTS = ("rows", "amounts", "quantities", "outliers", "kept", "negatives", "zeros")


def totals_of(facts: DataFrame, by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """The named aggregates per group by a pass of their own (for a single analysis)."""
    aggs = aggregates()
    return facts.groupBy(*by).agg(*[aggs[n].alias(n) for n in (names or aggs)])


@dataclass
class Profile:
    """``cube``: the landed aggregates of every grouping set; the properties are views of it."""

    cube: DataFrame
    by: list[str]
    facts: DataFrame
    roles: Roles
    cut: Callable[[DataFrame], DataFrame]

    def _set(self, name: str) -> DataFrame:
        return self.cube.where(F.col("_set") == name)

    @cached_property
    def totals(self) -> DataFrame:
        """One row per group (exactly one without groups)."""
        own = self._set("total").select(*self.by, *aggregates())
        if self.by:
            return own
        return own.agg(*[(F.coalesce(F.max(c), F.lit(0)) if c in COUNTS else F.max(c)).alias(c) for c in aggregates()])

    @cached_property
    def days(self) -> DataFrame:
        return self._set("day").where(F.col("day").isNotNull()).select(*self.by, "day", *aggregates())

    @cached_property
    def categories(self) -> DataFrame:
        return self._set("category").select(*self.by, CATEGORY, *aggregates())

    @cached_property
    def products(self) -> DataFrame:
        return self._set("product").select(*self.by, PRODUCT, *aggregates())

    @cached_property
    def months(self) -> DataFrame:
        return self.days.groupBy(*self.by, F.substring("day", 1, 7).alias("month")).agg(
            *[F.sum(c).alias(c) for c in ("rows", "amount_sum", "quantity_sum")])

    def tails(self, stats: DataFrame) -> DataFrame:
        """Per group, in one scan: rows beyond ``Z`` deviations (at least 10 amounts) and the mean of the amounts
        up to the 95th percentile of ``stats``."""
        own = attach(self.totals.select(*self.by, F.col("amounts").alias("_n"), F.col("mean").alias("_mean"),
                                        F.col("deviation").alias("_sd")),
                     stats.select(*self.by, F.col("p95").alias("_p95")), self.by, "left")
        a = F.col(AMOUNT)
        far = F.coalesce((F.col("_n") >= 10) & (F.col("_sd") > 0) & (F.abs((a - F.col("_mean")) / F.col("_sd")) > Z), F.lit(False))
        g = attach(self.facts.select(*self.by, AMOUNT), own, self.by, "inner").groupBy(*self.by).agg(
            F.count_if(far).alias("far"), F.sum(F.when(far, a)).alias("far_sum"),
            F.avg(F.when(a <= F.col("_p95"), a)).alias("mean_up_to_p95"))
        return self.cut(g)


def build_profile(facts: Facts, products: bool = False, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> Profile:
    """One scan of the facts; ``cut`` lands the result."""
    by, roles = list(facts.by), facts.roles
    # keys as columns of their own, so that the aggregates never read a key that a set leaves out
    keys = {"day": day_key(TS), "category": F.col(CATEGORY), "product": F.col(PRODUCT)}
    sets = {"total": []} | {k: [k] for k, wanted in (("day", roles.date), ("category", roles.category),
                                                      ("product", roles.product and products)) if wanted}
    extra = [k for k in keys if [k] in sets.values()]
    src = facts.df.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], *[keys[k].alias(f"_{k}") for k in extra],
                          AMOUNT, TS, QTY, OUTLIER)
    own = [f"_by{i}" for i in range(len(by))]
    aggs = [c.alias(n) for n, c in aggregates().items()]
    if extra:
        flags = [F.when(F.grouping(f"_{k}") == 0, k) for k in extra]
        cube = src.groupingSets([own + [f"_{k}" for k in ks] for ks in sets.values()], *own, *[f"_{k}" for k in extra]).agg(
            F.coalesce(*flags, F.lit("total")).alias("_set"), *aggs)
    else:
        cube = src.groupBy(*own).agg(F.lit("total").alias("_set"), *aggs)
    cols = [F.col(f"_by{i}").alias(k) for i, k in enumerate(by)] + ["_set", *aggregates()]
    cols += [(F.col(f"_{k}") if k in extra else F.lit(None).cast("string")).alias(
        {"day": "day", "category": CATEGORY, "product": PRODUCT}[k]) for k in keys]
    return Profile(cut(cube.select(*cols)), by, facts.df, roles, cut)
