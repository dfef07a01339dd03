"""Moments of the last rows of each series: constant work a row, however many rows are looked back on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def _moments(x: str, y: str | None, w: WindowSpec) -> Column:
    """Count, mean, sum of squared deviations and ends of each column, and the co-moment of the rows that have both."""
    zero = lambda c: F.coalesce(c.over(w), F.lit(0.0))
    fields = {}
    for name, c in (("x", x), *([("y", y)] if y else [])):
        n = F.count(c).over(w)
        fields |= {f"n{name}": n, f"m{name}": zero(F.avg(c)), f"s{name}": zero(F.var_pop(c)) * n, f"low{name}": F.min(c).over(w), f"high{name}": F.max(c).over(w)}
    if y:
        both_x, both_y = (F.when(F.col(other).isNotNull(), F.col(c)) for c, other in ((x, y), (y, x)))
        n = F.count(both_x).over(w)
        fields |= {"n": n, "px": zero(F.avg(both_x)), "py": zero(F.avg(both_y)), "sxy": zero(F.covar_pop(x, y)) * n}
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def _merged(a: str, b: str, pairs: bool) -> Column:
    """The moments of two runs of rows together."""
    def share(n: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"{b}.{n}"), F.col(f"{a}.{n}") + F.col(f"{b}.{n}")), F.lit(0.0))

    def apart(m: str) -> Column:
        return F.col(f"{b}.{m}") - F.col(f"{a}.{m}")

    def added(f: str) -> Column:
        return F.col(f"{a}.{f}") + F.col(f"{b}.{f}")
    fields = {}
    for v in "xy" if pairs else "x":
        n, m, s = f"n{v}", f"m{v}", f"s{v}"
        fields |= {n: added(n), m: F.col(f"{a}.{m}") + apart(m) * share(n), s: added(s) + apart(m) * apart(m) * F.col(f"{a}.{n}") * share(n),
                   f"low{v}": F.least(f"{a}.low{v}", f"{b}.low{v}"), f"high{v}": F.greatest(f"{a}.high{v}", f"{b}.high{v}")}
    if pairs:
        fields |= {"n": added("n"), **{p: F.col(f"{a}.{p}") + apart(p) * share("n") for p in ("px", "py")},
                   "sxy": added("sxy") + apart("px") * apart("py") * F.col(f"{a}.n") * share("n")}
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def trailing(df: DataFrame, entity: str, date: str, n: int, x: str, y: str | None, name: str) -> DataFrame:
    """Adds the moments of ``x``, and of ``y`` if there is one, over the last ``n`` rows of each entity (a row per date) as one column.

    Rows are cut in blocks of ``n``; moments are kept up from a block's start to a row, and from a row to the block's end. The last ``n`` rows
    are the end of one block and the start of the next, so two values are merged. Nothing is taken away again, so no digits are lost.
    """
    series = Window.partitionBy(entity).orderBy(date)
    cut = df.withColumn("_row", F.row_number().over(series) - 1).withColumn("_block", F.floor(F.col("_row") / n))
    block = Window.partitionBy(entity, "_block")
    runs = (cut.withColumn("_on", _moments(x, y, block.orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_back", _moments(x, y, block.orderBy(F.col("_row").desc()).rowsBetween(Window.unboundedPreceding, 0))))
    both = runs.withColumn("_end", F.lag("_back", n - 1).over(series)).drop("_back")
    whole = (F.col("_row") % n == n - 1) | (F.col("_block") == 0)
    return both.withColumn(name, F.when(whole, F.col("_on")).otherwise(_merged("_end", "_on", y is not None))).select(*df.columns, name)


def mean(of: str, v: str) -> Column:
    return F.when(F.col(f"{of}.n{v}") > 0, F.col(f"{of}.m{v}"))


def _constant(of: str, v: str) -> Column:
    return F.col(f"{of}.low{v}") == F.col(f"{of}.high{v}")


def variance(of: str, v: str) -> Column:
    """Of the sample; exactly zero where all values are the same."""
    spread = F.when(_constant(of, v), 0.0).otherwise(F.col(f"{of}.s{v}"))
    return F.when(F.col(f"{of}.n{v}") > 1, F.try_divide(spread, F.col(f"{of}.n{v}") - 1))


def covariance(of: str) -> Column:
    """Of the sample, over rows that have both."""
    together = F.when(_constant(of, "x") | _constant(of, "y"), 0.0).otherwise(F.col(f"{of}.sxy"))
    return F.when(F.col(f"{of}.n") > 1, F.try_divide(together, F.col(f"{of}.n") - 1))
