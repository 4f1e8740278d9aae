import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.llm import linededup

SCHEMA = "doc_id long, text string, n_chars long, drop string"
BLANK = r"[\x20\x09-\x0D]"


def brute_signatures(line):
    tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.split(f"{BLANK}+", line) if t]
    n, rest = len(tokens), tuple(tokens[3:])
    if n < 3 and len(" ".join(tokens)) < 50:
        return []
    found = [(n, *tokens[:3], -1, rest)]
    if n >= 12:
        m = n - 3
        for i in range(4):
            found.append((n, *tokens[:3], i, rest[: m * i // 4], rest[m * (i + 1) // 4 :]))
    return found


def brute_lines(rows, min_docs=3):
    """(doc_id, line, template or None, dropped) of every line."""
    support = Counter(s for _, t in rows for s in {s for x in (t or "").split("\n") for s in brute_signatures(x)})

    def template(x):
        able = [s for s in brute_signatures(x) if support[s] >= min_docs]
        return max(able, key=support.__getitem__) if able else None  # of equal ones the first

    lines = [(i, x, template(x)) for i, t in rows if t is not None for x in t.split("\n")]
    first = {}
    for i, _, s in lines:
        first[s] = min(first.get(s, i), i)
    return [(i, x, s, s is not None and first[s] != i) for i, x, s in lines]


def brute(rows, min_docs=3):
    kept = {i: None if t is None else [] for i, t in rows}
    for i, x, _, dropped in brute_lines(rows, min_docs):
        if not dropped:
            kept[i].append(x)
    return {i: None if x is None else "\n".join(x) for i, x in kept.items()}


ROWS = [
    (0, None),
    (1, ""),
    (2, "All rights reserved.\nown line of two\nAll rights reserved."),
    (3, "x\nAll rights reserved."),
    (4, "All rights reserved.\n\n"),
    (5, "posted on 2024-01-02 by a1\nshort one\nzwölf boxers jump over the lazy dog and run home again today"),
    (6, "posted on 1999-12-31 by b22\nshort one\nzwölf boxers jump over the eager cat and run home again today"),
    (7, "posted on 7 by 9\nshort one\nzwölf boxers jump over the quick fox and run home again today"),
    (8, " tab\tseparated \x0b line 5\r\nend"),
    (9, "tab separated line 77\n" * 3),
    (10, "tab separated line 8"),
    (11, "word " * 30000),
    *((20 + i, "这是一个没有空格的长句子，" * 5 + f"\n第{i}行") for i in range(3)),
]


def test_lines_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, 0, "other") for i, t in ROWS], SCHEMA)
    out = linededup.drop_recurring_lines(df)
    assert out.columns == df.columns
    got = out.collect()
    assert {r.doc_id: r.text for r in got} == brute(ROWS)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r["drop"] == "other" for r in got)
    assert {r.doc_id for r in got if r.text == ""} >= {1, 10}


@pytest.mark.parametrize("seed", range(3))
def test_every_dropped_line_has_one_that_stays(spark, seed):
    """Chains of lines that differ in one span from neighbour to neighbour."""
    rng = random.Random(seed)
    rows, line = [], [f"w{chr(97 + i)}" for i in range(15)]
    for i in range(40):
        if rng.random() < 0.7:
            at = rng.randrange(3, 15)
            line = [*line[:at], rng.choice("pqrst") * 3, *line[at + 1 :]]
        rows.append((i, " ".join(line)))
        if rng.random() < 0.3:
            line = rows[rng.randrange(len(rows))][1].split(" ")
    found = brute_lines(rows)
    stays = {(s, i) for i, _, s, dropped in found if not dropped}
    lost = [(i, s) for i, _, s, dropped in found if dropped]
    assert len(lost) > 5 and all(any(s == own and i != j for own, j in stays) for i, s in lost)
    got = linededup.drop_recurring_lines(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)


def test_clashing_names(spark):
    names = ["own", "OTHER_ID", "sig", "lost", "new_text", "new_size", "template", "pos", "__own", "__text", "a.b", "x`y"]
    rows = [(i, f"a line of number {i}", *range(len(names))) for i in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = linededup.drop_recurring_lines(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(i, t if i == 0 else "", *rest) for i, t, *rest in rows]


def test_repeated_rows_null_ids_and_empty(spark):
    line = "a template with the number 5"
    rows = [(1, line, 0, "x"), (2, line, 0, "x"), (2, line, 0, "x"), (None, line + "\nkept here", 0, "x")]
    got = linededup.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "kept here"), (1, line), (2, ""), (2, "")]
    assert linededup.drop_recurring_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    assert linededup.line_report(spark.createDataFrame(rows, SCHEMA)).count() == 4


def test_text_of_very_many_recurring_lines(spark):
    line = lambda i: "a line of its own words " + " ".join("abcdefghij"[int(x)] * 3 for x in str(i))
    shared = [line(i) for i in range(20_000)]
    rows = [(i, "\n".join(x for y in shared for x in (y, f"own{i}")), 0, "x") for i in range(3)]
    got = {r.doc_id: r.text for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: rows[0][1], 1: "\n".join(["own1"] * 20_000), 2: "\n".join(["own2"] * 20_000)}


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(i, t, 0, "other") for i, t in ROWS], SCHEMA).repartition(2)
    plan = linededup.line_report(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|InPandas", plan.replace("Scan ExistingRDD", ""))


def test_whole_lines_only(spark):
    df = spark.createDataFrame([(i, f"unique {i} head of a text that goes on\nand ends", 0, "x") for i in range(2)], SCHEMA)
    assert linededup.drop_recurring_lines(df).where(F.length("text") < 30).count() == 0
