"""Mixing against a plain simulation of weights, turns and schedules."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from kmerloom.llm.mixing import SCHEDULES, integral, mix, time_of, training_order

SCHEMA = "doc_id long, text string, source string, size int, target string"
WEIGHTS = (5, 2, 1)


def targets(sizes, share=1.0, repeats=3):
    """By rounds: the excess over a bound is shared by weight among those below theirs."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, room = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in out]
        level = (room - sum(out.values())) / (sum(weight[s] for s in open_) or 1)
        full = [s for s in open_ if repeats * sizes[s] <= weight[s] * level]
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: float(repeats * sizes[s]) for s in full}


def brute(rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((hashlib.md5(("" if i is None else str(i)).encode()).digest(), -1 if i is None else i, words(t)))
    sizes = {s: sum(n for *_, n in own) for s, own in by.items()}
    goal, out = targets(sizes), []
    for s, own in by.items():
        left, taken = int(goal[s] + 0.5), [0] * len(own)
        own.sort()
        for _ in range(3):
            for j, (*_, n) in enumerate(own):
                taken[j] += min(n, left)
                left -= min(n, left)
        out += [(i, s, n, sizes[s], goal[s], k) for (_, i, n), k in zip(own, taken)]
    return out


def rows_of(seed, n=300):
    g = random.Random(seed)
    text = lambda k: "".join(g.choice(["w", "é", "🙂x"]) + g.choice([" ", "\n", "\t ", "\x0b", "   "]) for _ in range(k))
    source = lambda: g.choice(["hot"] * 6 + ["a", "b", "", None, "Z", "é", "tiny"])
    rows = [(g.randrange(250), text(g.randrange(1 if s == "tiny" else 12)), s) for s in (source() for _ in range(n))]
    return rows + [(1000, None, "a"), (1001, "", "b"), (1002, " \n ", None), (None, "x y", "hot"), (None, "x y", "hot"), (1003, "only words", "last")] + rows[:9]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA)


def key(r):
    return repr(tuple(r)[:4]), r[5]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_words_taken(spark, seed):
    rows = rows_of(seed)
    got = [((-1 if r.doc_id is None else r.doc_id), r.source, r.size, r.source_size, r.target, r.taken) for r in mix(frame(spark, rows)).collect()]
    want = brute(rows)
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x[:4] + x[5:] == y[:4] + y[5:] and x[4] == pytest.approx(y[4], abs=1e-9)
    by, goal = defaultdict(int), {}
    for _, s, n, _, t, k in got:
        assert 0 <= k <= 3 * n
        by[s] += k
        goal[s] = t
    assert all(abs(by[s] - goal[s]) <= 0.5 for s in by)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = frame(spark, rows_of(4))
    once = sorted(map(repr, mix(docs).collect()))
    assert once == sorted(map(repr, mix(docs.repartition(13)).collect())) == sorted(map(repr, mix(docs.coalesce(1)).collect()))


def test_positions_follow_the_schedules(spark):
    """At every time the words read of a source are its integrated schedule, up to one document."""
    rows = [(i, "w " * (1 + i % 7), s) for i in range(3000) for s in ("abc"[i % 3],)]
    read = training_order(frame(spark, rows)).collect()
    times = [r.position for r in read]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1
    total = sum(1 + i % 7 for i in range(3000))
    for k, (source, knots) in enumerate(zip("abc", SCHEDULES)):
        own = [r for r in read if r.source == source]
        target = sum(r.words for r in own)
        assert abs(target - targets({s: sum(1 + i % 7 for i in range(3000) if "abc"[i % 3] == s) for s in "abc"})[source]) <= 0.5
        (_, v), (_, w) = knots
        done = 0
        for r in own:
            t = r.position
            assert abs((v * t + (w - v) * t * t / 2) / integral(knots) * target - done) < 1e-6 * total + 0.5
            done += r.words


def test_training_order_holds_what_the_mix_takes(spark):
    docs = frame(spark, rows_of(5))
    count = lambda found, value: {k: v for k, v in found.items() if v} | value
    taken, read = defaultdict(int), defaultdict(int)
    for r in mix(docs).collect():
        taken[r.doc_id, r.source] += r.taken
    for r in training_order(docs).collect():
        read[r.doc_id, r.source] += r.words
    assert count(taken, {}) == count(read, {})


def test_sorted_by_position(spark):
    at = [r.position for r in mix(frame(spark, rows_of(6))).collect()]
    known = [p for p in at if p is not None]
    assert known == sorted(known) and all(p is None for p in at[len(known) :])


def test_degenerate_tables(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    none = mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken, r.position) for r in none] == [(0, 0, 0.0, 0, None)] * 2
    one = mix(frame(spark, [(1, "a b c", "x")])).collect()
    assert [(r.target, r.taken, r.position) for r in one] == [(3.0, 3, 0.0)]


def test_schedules(spark):
    assert [integral(k) for k in SCHEDULES] == list(map(float, WEIGHTS))
    for bad in [((0.0, 1.0),), ((0.1, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.0, 1.0), (1.0, 1.0)), ((0.0, -1.0), (1.0, 3.0)), ((0.0, 0.0), (1.0, 0.0))]:
        with pytest.raises(ValueError):
            integral(bad)
    knots = ((0.0, 0.0), (0.25, 0.0), (0.5, 4.0), (0.75, 4.0), (1.0, 0.0))
    steps = [integral(knots) * i / 50 for i in range(51)]
    times = [r[0] for r in spark.createDataFrame([(y,) for y in steps], "y double").select(time_of(__import__("pyspark").sql.functions.col("y"), knots)).collect()]
    area = lambda t: sum(max(0, min(t, b) - a) * (v + (v + (w - v) * max(0, min(t, b) - a) / (b - a))) / 2 for (a, v), (b, w) in zip(knots, knots[1:]))
    assert all(abs(area(t) - y) < 1e-9 for t, y in zip(times, steps))


def test_no_python_in_the_plan(spark):
    plan = mix(frame(spark, rows_of(7)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
