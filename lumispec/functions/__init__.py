"""Column expressions that the operators share: all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Consistency constant of the median absolute deviation for normal data.
MAD = 1.4826


def natural_key(c: Column) -> Column:
    """Sorts digits inside strings by their value: runs of digits are padded with zeros."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(F.regexp_like(x, F.lit(r"^\d")), F.lpad(x, 20, "0")).otherwise(x)), "")


def signif(c: Column, digits: int) -> Column:
    """c rounded half to even to so many significant digits."""
    k = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.bround(c * k) / k)


def lorentzian(x: Column, x0: Column, gamma: Column, area: Column) -> Column:
    return area / (F.lit(3.141592653589793) * gamma) * gamma * gamma / ((x - x0) * (x - x0) + gamma * gamma)


def average_rank(value: Column, descending: bool, *keys) -> Column:
    """The rank of value among rows of equal keys, ties sharing the mean of their ranks."""
    from pyspark.sql import Window

    order = value.desc() if descending else value.asc()
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def mapped_pulse(experiment: Column) -> Column:
    """The pulse sequence that an experiment's name tells of; the first that fits, in this order."""
    # Parts of names, as instruments write them.
    ladder = (("NOESY", ("NOESY", "NOEZY")), ("CPMG", ("CPMG",)), ("DIFF", ("DIFF",)), ("JRES", ("JRES",)), ("PROTON", ("PROTON",)), ("COSY", ("COSY",)), ("TOCSY", ("TOCSY", "MLEV", "DIPSI")), ("HSQC", ("HSQC",)), ("HMBC", ("HMBC",)))
    out = F.lit(None).cast("string")
    for name, parts in reversed(ladder):
        fits = F.contains(F.upper(experiment), F.lit(parts[0]))
        for p in parts[1:]:
            fits |= F.contains(F.upper(experiment), F.lit(p))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def rounded(c: Column, digits: int) -> Column:
    """F.round(c, digits), which goes by decimals, only where a tie may be near; else by doubles, with the same results."""
    y = c * F.lit(10.0**digits)
    plain = (F.abs(y) < 1e9) & (F.abs(y - F.floor(y) - 0.5) > 1e-3)
    return F.when(plain, F.rint(y) / F.lit(10.0**digits)).otherwise(F.round(c, digits))
