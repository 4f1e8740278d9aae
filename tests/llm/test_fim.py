"""Fill-in-middle against slices of a list of lines."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from kmerloom.llm.fim import cut, digests, fill_in_middle, ranked_bits, restored

SCHEMA = "doc_id long, text string, form string, n int"


def brute(doc_id, text, fim=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h4 % 100 < spm else "psm", len(p), len(m), out


def texts():
    g = random.Random(5)
    parts = ["a", "b c", "\n", "\n\n", "é", "漢字", "🙂", "<", "<P", "S>", "|", "\r\n", "\x00", " ", " ", "\x85"]
    rows = [(i, "".join(g.choice(parts) for _ in range(g.randrange(40)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "\n\n\n"), (504, "no end"), (505, "x <P> y\nz\n"), (506, "<S>"), (507, "a\n<M>\nb"), (None, "one\ntwo\nthree"), (-3, "one\ntwo\n")]
    rows += [(508, "z" * 300_000), (509, "word line\n" * 60_000), (510, "é\n" * 50_000)]
    return rows + rows[:20]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_forms_and_cuts(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    assert ordered(fill_in_middle(docs).collect()) == ordered(brute(i, t) for i, t in rows)
    assert ordered(fill_in_middle(docs, fim_percent=40, spm_percent=10).collect()) == ordered(brute(i, t, 40, 10) for i, t in rows)


def test_every_text_is_restored(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    back = fill_in_middle(docs).select("doc_id", restored(F.col("output"), F.col("form"))).collect()
    assert ordered(back) == ordered((i, t or "") for i, t in rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(*brute(i, t)[:5], sha(brute(i, t)[5]), sha(t or "")) for i, t in rows]
    assert ordered(digests(docs).collect()) == ordered(want)


def test_empty_table(spark):
    none = fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_ranked_bits():
    g = random.Random(6)
    for width in [1, 2, 3, 64, 65, 1000]:
        mask = g.getrandbits(width)
        at = [i for i in range(width) if mask >> i & 1]
        ranks = sorted(g.choices(range(len(at)), k=5)) if at else []
        assert ranked_bits(mask, width, ranks) == [at[r] for r in ranks]
    assert cut(b"", 4, 5) == (0, 0, 0)


def test_a_text_of_twenty_megabytes():
    data = b"some line of text\n" * 1_200_000
    n, a, b = cut(data, 1_000_000, 17)
    assert (n, a, b) == (1_200_000, 18 * 17, 18 * 1_000_000)
