"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

A source's weight is a piecewise linear function of training time, from 0 to 1. Its integral is the source's share; what
a share asks of a source beyond a number of repeats goes to the others. A document's place in its source, in words and in
the order of a hash, is a point of the source's cumulative demand: the inverse of the integrated schedule gives the time at
which training reaches it. Documents sorted by that time, by ranges, are the training order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.prefix import exclusive_sums
from kmerloom.storage import materialize, spread

#: (time, weight) knots of the sources in turn: the first fades, the second is constant, the third grows. Integrals 5, 2, 1.
SCHEDULES = (((0.0, 8.0), (1.0, 2.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.0), (1.0, 2.0)))
Knots = tuple[tuple[float, float], ...]
BLANK = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Runs of other characters than blanks: every run is cut to its first character, then the blanks go."""
    firsts = F.regexp_replace(text, r"([^\x20\x09-\x0D])[^\x20\x09-\x0D]*", "$1")
    return F.coalesce(F.length(F.translate(firsts, BLANK, "")), F.lit(0)).cast("long")


def _areas(knots: Knots) -> list[float]:
    return [(b - a) * (v + w) / 2 for (a, v), (b, w) in zip(knots, knots[1:])]


def integral(knots: Knots) -> float:
    """The weight of a schedule: its integral over time."""
    times = [t for t, _ in knots]
    if len(knots) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in knots) < 0 or not sum(_areas(knots)) > 0:
        raise ValueError("a schedule has rising times from 0 to 1, no negative weight and some positive one")
    return math.fsum(_areas(knots))


def time_of(demand: Column, knots: Knots) -> Column:
    """The time at which the integrated weight has reached ``demand``, from 0 to the integral.

    On a piece that begins with weight v and slope g, y more is reached after the root of v * x + g * x * x / 2 = y.
    """
    pieces, done = [], 0.0
    for (a, v), (b, w), area in zip(knots, knots[1:], _areas(knots)):
        if area > 0:
            y, g = demand - F.lit(done), (w - v) / (b - a)
            root = F.sqrt(F.greatest(F.lit(v * v) + F.lit(2 * g) * y, F.lit(0.0)))
            pieces.append((done + area, F.lit(a) + F.when(y > 0, F.lit(2.0) * y / (F.lit(v) + root)).otherwise(0.0)))
            done += area
    out = F.lit(1.0)
    for end, time in reversed(pieces):
        out = F.when(demand < end, time).otherwise(out)
    return out


def source_targets(sources: DataFrame, weights: list[float], share: float, repeats: int) -> DataFrame:
    """sources (a stored table: no, size) with weight and target: of ``share`` of all sizes by weight, ``repeats`` times the
    size at most, and what that leaves over shared by weight again until no target is above its bound.

    Every round is an aggregate of one row; the level that the weights are multiplied with only rises, and a round that
    bounds no further source is the last.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("most", F.col("size") * F.lit(float(repeats)))
    total, open_weight = s.agg(F.sum("size"), F.sum("weight")).first()
    room, bound, count = share * (total or 0), 0.0, -1
    while True:
        above = F.col("most") * F.lit(open_weight) <= F.col("weight") * F.lit(room - bound) if open_weight else F.lit(True)
        now, left, spent = s.agg(F.count_if(above), F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, F.col("most")))).first()
        if now == count or not left:
            break
        count, open_weight, bound = now, left, spent or 0.0
    target = F.col("weight") * F.lit(room - bound) / F.lit(open_weight) if open_weight else F.lit(0.0)
    return s.withColumn("target", F.when(above, F.col("most")).otherwise(target)).drop("most")


def placed_documents(docs: DataFrame, schedules: tuple[Knots, ...] = SCHEDULES, share: float = 1.0, repeats: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, schedule, key, tie, begin): ``begin`` is the number of words before the
    document in its source, whose documents are ordered by the md5 of their doc_id.

    Sums go over ranges of (source, md5), so a source of any size is spread over tasks.
    """
    ident = F.col("doc_id").cast("long")
    key = F.unhex(F.md5(F.coalesce(ident.cast("string"), F.lit(""))))
    name = F.col("source").cast("string")
    rows = spread(docs.select("doc_id", "text", "source")).select(ident.alias("doc_id"), name.isNull().alias("absent"), F.coalesce(name, F.lit("")).alias("source"), word_count(F.col("text")).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("tie"))
    rows = materialize(rows, "sizes")
    sources = exclusive_sums(rows.groupBy("absent", "source").agg(F.sum("size").alias("size")), ["absent", "source"], {"no": None, "base": "size"})
    weights = [integral(k) for k in schedules]
    sources = source_targets(materialize(sources, "sources"), weights, share, repeats)
    sources = sources.select("absent", "source", F.col("size").alias("source_size"), "target", "base", (F.col("no") % len(weights)).alias("schedule"))
    placed = exclusive_sums(rows, ["absent", "source", "key", "doc_id", "size", "tie"], {"before": "size"}).join(sources, ["absent", "source"])
    shown = F.when(~F.col("absent"), F.col("source")).alias("source")
    return placed.select("doc_id", shown, "size", "source_size", "target", "schedule", "key", "tie", (F.col("before") - F.col("base")).alias("begin"))


def _words(turn: int) -> Column:
    """Words that the mix takes of a document in the turn-th repeat of its source: the budget may end inside it."""
    budget = F.floor(F.col("target") + 0.5)
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - turn * F.col("source_size") - F.col("begin")))


def _time(turn: int, schedules: tuple[Knots, ...]) -> Column:
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        demand = F.try_divide(F.lit(integral(knots)) * (turn * F.col("source_size") + F.col("begin")), F.col("target"))
        out = F.when(F.col("schedule") == i, time_of(demand, knots)).otherwise(out)
    return out


def mix(docs: DataFrame, schedules: tuple[Knots, ...] = SCHEDULES, share: float = 1.0, repeats: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position), a row per input row, sorted by position.

    size is the number of words, source_size that of the row's source. Sources, by code point and null last, take the
    schedules in turn; the integral of a schedule is the weight of its source. target is the source's part of ``share``
    of all words, ``repeats`` times its size at most. taken is the words that the mix takes of the row, repeats counted:
    the target, rounded, is filled turn by turn with whole documents in the order of their hashes, and the last one of a
    source is cut where the target ends. So the words taken of a source differ from its target by a half at most, and a
    row gives ``repeats`` times its size at most. position is the time (0 to 1) at which training first reads the row,
    null (and last) for rows that it doesn't take, as those without words.

    Null texts have no words; null sources are one source, apart from the empty one; null doc_ids and repeated rows are
    taken like any other; an empty table gives an empty result; other columns are ignored. Reruns agree.
    """
    placed = placed_documents(docs, schedules, share, repeats)
    taken = sum((_words(i) for i in range(1, repeats)), _words(0))
    timed = placed.withColumn("taken", taken).withColumn("position", F.when(F.col("taken") > 0, _time(0, schedules)))
    ordered = timed.orderBy(F.col("position").asc_nulls_last(), "key", "tie")
    return ordered.select("doc_id", "source", "size", "source_size", "target", "taken", "position")


def training_order(docs: DataFrame, schedules: tuple[Knots, ...] = SCHEDULES, share: float = 1.0, repeats: int = 3) -> DataFrame:
    """(doc_id, source, turn, words, position): what training reads, sorted by position; a document that is repeated has a
    row per turn, of which the last of its source may be cut to fewer words than it has. Edge cases as in mix."""
    placed = placed_documents(docs, schedules, share, repeats)
    turns = F.array(*(F.struct(F.lit(i).alias("turn"), _words(i).alias("words"), _time(i, schedules).alias("position")) for i in range(repeats)))
    read = placed.select("doc_id", "source", "key", "tie", F.explode(F.filter(turns, lambda x: x["words"] > 0)).alias("x"))
    return read.select("doc_id", "source", "key", "tie", "x.*").orderBy("position", "key", "tie").drop("key", "tie")
