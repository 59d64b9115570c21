"""Points in intervals by length classes (J6, J13), and dated entries as intervals.

An interval of n positions belongs to the class of cells of 2^c >= n positions, so it
touches one or two cells of its class and is filed there once each. A point asks for
the one cell per class that holds it, and (class, cell) is an equi-join key. Exponents
are widened so that at most `CLASSES` classes lie between the shortest and the longest
interval; no data are read while the plan is built.

What is repeated per class is the key and the position of a point, once per distinct
pair; its other columns are joined to the matches. A point whose other columns are a few
numbers or times is repeated as it is, which is less than a second join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.operators.scan import lead, ordered_scan
from opsight.session import stable

#: Classes a point is asked with at most.
CLASSES = 7
#: Other columns, all of fixed width, with which a point is repeated as it is.
NARROW = 2
FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def shift_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def exponent(length: Column) -> Column:
    """The least c with 2^c >= length, for length of 1 or more."""
    bits = F.length(F.bin(length - 1))
    return F.when(length <= 1, 0).otherwise(bits).cast("int")


def _classes(lengths: DataFrame) -> Column:
    """(lo, step) of the classes of a table of exponents `_c`, as a scalar subquery."""
    low, high = F.min("_c"), F.max("_c")
    step = F.greatest(F.lit(1), F.ceil((high - low) / (CLASSES - 1))).cast("int")
    return lengths.agg(F.struct(low.alias("lo"), high.alias("hi"), step.alias("step")).alias("s")).scalar()


def match_points(
    points: DataFrame, intervals: DataFrame, on: Sequence[tuple[str, str]], compared: Sequence[str],
    position: Column, low: Column, high: Column, inside: Callable[[Callable[[str], Column]], Column],
) -> DataFrame:
    """Points with all intervals of the same key that hold them.

    position is a long over points, low and high are longs over intervals; neither may
    fall as the values they stand for rise. `inside`, given a function from names of
    points' columns in `compared` to columns, is the exact condition, for values finer
    than positions. Null keys, positions and bounds match nothing. Columns of the two
    sides need different names.
    """
    needed = list(dict.fromkeys([*[k for k, _ in on], *compared]))
    rest = [f for f in points.schema if f.name not in needed]
    narrow = len(rest) <= NARROW and all(isinstance(f.dataType, FIXED) for f in rest)
    names = points.columns if narrow else needed
    own = lambda c: F.col(f"_m_{c}")
    slim = points.select(*[F.col(c).alias(f"_m_{c}") for c in names], position.alias("_p")).where("_p IS NOT NULL")
    slim = slim if narrow else slim.distinct()
    filed = intervals.select("*", low.alias("_lo"), high.alias("_hi")).where("_lo <= _hi")
    filed = filed.withColumn("_c", exponent(F.col("_hi") - F.col("_lo") + 1))
    classes = _classes(filed)
    asked = slim.withColumn("_k", classes).where("_k.lo IS NOT NULL")
    asked = asked.withColumn("_class", F.explode(F.sequence(F.col("_k.lo"), F.col("_k.hi") + F.col("_k.step") - 1, F.col("_k.step"))))
    asked = asked.withColumn("_cell", shift_right(F.col("_p"), F.col("_class"))).drop("_k")
    filed = filed.withColumn("_k", classes)
    rounds = F.ceil((F.col("_c") - F.col("_k.lo")) / F.col("_k.step")).cast("int")
    filed = filed.withColumn("_own", F.col("_k.lo") + rounds * F.col("_k.step"))
    cells = F.array_distinct(F.array(shift_right(F.col("_lo"), F.col("_own")), shift_right(F.col("_hi"), F.col("_own"))))
    filed = filed.withColumn("_filed", F.explode(cells)).drop("_c", "_k")
    cond = (F.col("_class") == F.col("_own")) & (F.col("_cell") == F.col("_filed"))
    for left, right in on:
        cond = cond & (own(left) == filed[right])
    met = asked.join(filed, cond & F.col("_p").between(F.col("_lo"), F.col("_hi")) & inside(own))
    met = met.select(*[own(c) for c in names], *intervals.columns)
    if narrow:
        return met.select(*[own(c).alias(c) for c in names], *intervals.columns)
    same = F.lit(True)
    for c in names:
        same = same & (points[c] == own(c))
    return points.join(met, same).select(*points.columns, *intervals.columns)


@dataclass(frozen=True)
class Validity:
    """Dated entries turned into intervals once: an entry holds from its date until the next of its code.

    `rows` has _code, _from and _until (seconds, the latter null while the entry is the
    last), _label (null where the entry is not active) and, for closed ones, _class and
    _cell. `classes` are the classes that occur, at most `CLASSES`.
    """

    rows: DataFrame
    classes: tuple[int, ...]

    @staticmethod
    def of(
        dated: DataFrame, value: str = "fieldvalue", effdt: str = "effdt", status: str = "eff_status",
        label: str = "xlatshortname",
    ) -> Validity:
        """Of entries with one code and date the one with the largest status and label counts. The
        number of classes, not the entries, is read here."""
        second = F.unix_micros(F.col(effdt).cast("timestamp"))
        entries = dated.where(F.col(effdt).isNotNull()).groupBy(F.col(value).alias("_code"), second.alias("_from")).agg(
            F.max(F.struct(F.col(status).alias("st"), F.col(label).alias("text"))).alias("_e"))
        spans = ordered_scan(entries, ["_code"], ["_from"], [lead("_until", "_from")])
        spans = spans.select("_code", "_from", "_until", F.when(F.col("_e.st") == "A", F.col("_e.text")).alias("_label"))
        closed = spans.withColumn("_c", exponent(F.col("_until") - F.col("_from")))
        known = stable(closed)
        exponents = sorted(r[0] for r in known.where("_c IS NOT NULL").select("_c").distinct().collect())  # 63 at most
        if not exponents:
            return Validity(known.withColumns({"_class": F.lit(None).cast("int"), "_cell": F.lit(None).cast("long")}), ())
        step = max(1, -(-(exponents[-1] - exponents[0]) // (CLASSES - 1)))
        classes = sorted({exponents[0] + -(-(c - exponents[0]) // step) * step for c in exponents})
        own = F.lit(exponents[0]) + F.ceil((F.col("_c") - exponents[0]) / step).cast("int") * step
        filed = known.withColumn("_class", own)
        cells = F.array_distinct(F.array(
            shift_right(F.col("_from"), F.col("_class")), shift_right(F.col("_until") - 1, F.col("_class"))))
        return Validity(filed.withColumn("_cell", F.explode_outer(F.when(F.col("_c").isNotNull(), cells))), tuple(classes))

    def at(self, rows: DataFrame, code: str, ts: str, name: str) -> DataFrame:
        """rows with the label of the entry valid at their time; null if there is none, or it is not active.

        One left equi-join per class, and one for entries that are still open. No row is
        repeated, since intervals of a code do not overlap; works on a stream.
        """
        second = F.unix_micros(F.col(ts).cast("timestamp"))
        out = rows.withColumn("_at", second)
        found = []
        for c in (*self.classes, None):
            mine = self.rows.where(F.col("_until").isNull() if c is None else F.col("_class") == c).select(
                *[F.col(n).alias(f"{n}_{c}") for n in ("_code", "_from", "_until", "_label", "_cell")])
            cond = (out[code] == mine[f"_code_{c}"]) & (out["_at"] >= mine[f"_from_{c}"])
            if c is not None:
                cond = cond & (F.shiftright(out["_at"], c) == mine[f"_cell_{c}"]) & (out["_at"] < mine[f"_until_{c}"])
            out = out.join(mine, cond, "left")
            found.append(F.col(f"_label_{c}"))
        return out.select(*rows.columns, F.coalesce(*found).alias(name))
