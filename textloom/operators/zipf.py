"""Term frequencies, rank tables and Zipf fits.

Ranks come from counts of counts: terms of one frequency take consecutive ranks, so a running sum over
the distinct frequencies, of which there are about the root of the number of tokens, gives each
frequency its range of ranks. The vocabulary itself is never sorted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import ascii_lower
from textloom.plans.scratch import settle

RANKS_A_ROW = 1 << 14
#: Values by which the median is looked for at once, and ranks of which the last search takes all.
CUTS, FEW = 32, 1 << 12


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """``term, freq`` over all tokens, in lower ASCII case."""
    return tokens.groupBy(ascii_lower(F.col("token")).alias("term")).agg(F.count("*").alias("freq"))


def frequency_ranges(freqs: DataFrame) -> DataFrame:
    """``freq, first, last``: the ranks of each frequency. The window runs over distinct frequencies alone."""
    falling = Window.orderBy(F.col("freq").desc())
    counted = freqs.groupBy("freq").agg(F.count("*").alias("n"))
    last = F.sum("n").over(falling)
    return counted.select("freq", (last - F.col("n") + 1).alias("first"), last.alias("last"))


def _ranked(ranges: DataFrame) -> DataFrame:
    """``rank, freq``. Half of a vocabulary may have one frequency, so ranges are cut and dealt before they become rows."""
    ends = F.explode(F.sequence("first", "last", F.lit(RANKS_A_ROW).cast("long"))).alias("at")
    pieces = ranges.select("freq", "last", ends).repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pieces.select(F.explode(F.sequence("at", F.least(F.col("at") + RANKS_A_ROW - 1, "last"))).alias("rank"), "freq")


def _value(freq: Column, rank: Column, s: float) -> Column:
    return freq * F.pow(rank, F.lit(s))


def _up_to(v: Column, s: float) -> Column:
    """Ranks of a range ``freq, first, last`` at which ``freq * rank ** s`` is at most ``v``; values rise within a range."""
    freq = F.col("freq")
    guess = F.floor(F.pow(v / freq, F.lit(1 / s)))
    # the power of a root may be off by a rounding
    rank = guess + F.when(_value(freq, guess + 1, s) <= v, 1).when(_value(freq, guess, s) > v, -1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.col("last"), rank) - F.col("first") + 1)


def median_level(ranges: DataFrame, s: float) -> float | None:
    """The median of ``freq * rank ** s`` over ranges of ranks, without a row for each rank.

    What lies below a value is counted range by range. The values between which the middle ones lie are drawn closer, ``CUTS`` at a time,
    until no more than ``FEW`` ranks are between them; only these are made. ``ranges`` is read several times and should be a written table.
    """
    ends = ranges.agg(F.sum(F.col("last") - F.col("first") + 1), F.min(_value(F.col("freq"), F.col("first"), s)), F.max(_value(F.col("freq"), F.col("last"), s)))
    n, least, most = ends.first()
    if not n:
        return None

    def about(place: int) -> tuple[int, int, list[float]]:
        """``below, upto, values``: the values of places ``below`` to ``upto``, around ``place``."""
        low, high, below, upto = float(np.nextafter(least, -np.inf)), most, 0, n
        while upto - below > FEW and np.nextafter(low, np.inf) < high:
            cuts = F.array(*[F.lit(float(x)) for x in np.linspace(low, high, CUTS + 1)[1:-1]])
            counted = ranges.withColumn("v", F.explode(cuts)).groupBy("v").agg(F.sum(_up_to(F.col("v"), s)).alias("n"))
            for v, count in sorted(counted.collect()):
                if count > place:
                    high, upto = v, count
                    break
                low, below = v, count
        if upto - below > FEW:  # so many equal values
            return below, upto, [high]
        first, last = F.col("first") + _up_to(F.lit(low), s), F.col("first") + _up_to(F.lit(high), s) - 1
        few = ranges.select("freq", first.alias("a"), last.alias("b")).filter("a <= b")
        ranks = few.select("freq", F.explode(F.sequence("a", "b")).alias("rank"))
        return below, upto, sorted(r[0] for r in ranks.select(_value(F.col("freq"), F.col("rank"), s)).collect())

    below, upto, values = about((n - 1) // 2)
    one = values[0 if len(values) == 1 else (n - 1) // 2 - below]
    if n // 2 >= upto:
        below, upto, values = about(n // 2)
    return (one + values[0 if len(values) == 1 else n // 2 - below]) / 2


def _slope(ranges: DataFrame) -> float:
    """The slope of ln freq over ln rank; a range adds its sums of logarithms, in pieces."""
    ends = F.explode(F.sequence("first", "last", F.lit(RANKS_A_ROW).cast("long"))).alias("a")
    pieces = ranges.select("freq", "last", ends).select("freq", "a", F.least(F.col("a") + RANKS_A_ROW - 1, "last").alias("b"))
    pieces = pieces.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    logs = F.transform(F.sequence("a", "b"), lambda r: F.log(r.cast("double")))
    sums = F.aggregate(
        logs, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("xx")), lambda acc, x: F.struct((acc["x"] + x).alias("x"), (acc["xx"] + x * x).alias("xx"))
    )
    each = pieces.select((F.col("b") - F.col("a") + 1).cast("double").alias("n"), F.log(F.col("freq").cast("double")).alias("y"), sums.alias("t"))
    n, x, y, xx, xy = each.agg(F.sum("n"), F.sum("t.x"), F.sum(F.col("n") * F.col("y")), F.sum("t.xx"), F.sum(F.col("t.x") * F.col("y"))).first()
    spread = 0.0 if not n else xx - x * x / n
    return (xy - x * y / n) / spread if spread > 1e-12 else 0.0


def zipf_fit(freqs: DataFrame) -> DataFrame:
    """One row ``vocabulary, tokens, top, r1, r2, s, c``: the fit of ``freq = c / rank ** s``.

    The slope is fitted on ranks r1 = max(10, V/100) to r2 = max(r1 + 10, V/2), cut at V; s outside of
    (0.1, 3) counts as 1, and c is the median of ``freq * rank ** s`` there, or the top frequency.
    """
    return _fit(settle(frequency_ranges(freqs), "frequency-ranges"))


def _fit(ranges: DataFrame) -> DataFrame:
    vocabulary, tokens, top = ranges.agg(
        F.max("last"), F.sum(F.col("freq") * (F.col("last") - F.col("first") + 1)), F.max("freq")
    ).first()
    schema = "vocabulary long, tokens long, top long, r1 long, r2 long, s double, c double"
    if not vocabulary:
        return ranges.sparkSession.createDataFrame([(None,) * 5 + (1.0, None)], schema)
    r1 = max(10, vocabulary // 100)
    r2 = min(vocabulary, max(r1 + 10, vocabulary // 2))
    inside = ranges.filter((F.col("last") >= r1) & (F.col("first") <= r2))
    inside = inside.select("freq", F.greatest("first", F.lit(r1)).alias("first"), F.least("last", F.lit(r2)).alias("last"))
    s = -_slope(inside)
    s = s if 0.1 < s < 3.0 else 1.0
    level = median_level(inside, s)
    row = (vocabulary, tokens, top, r1, r2, s, float(top) if level is None else level)
    return ranges.sparkSession.createDataFrame([row], schema)


def zipf_table(freqs: DataFrame) -> DataFrame:
    """``rank, freq, zipf_fit`` for every rank; of the frequencies only their ranges are kept."""
    ranges = settle(frequency_ranges(freqs), "frequency-ranges")
    s, c = _fit(ranges).select("s", "c").first()
    return _ranked(ranges).select("rank", "freq", (F.lit(c) / F.pow("rank", F.lit(s))).alias("zipf_fit"))
