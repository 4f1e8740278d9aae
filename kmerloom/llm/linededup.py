"""Line dedup by a log-template tree, in DataFrame functions only.

A line is a log message. The tree has a fixed depth: its token count, then its leading tokens, where tokens with digits
are wildcards. In a leaf, messages of one template differ in variable fields: digit tokens are always such, and in lines
of ``long_tokens`` or more the tokens behind the leading ones fall into four spans of which one may vary. Each line thus
has up to five signatures (its wildcarded tokens whole, and with each span as a wildcard). A signature that occurs in
``min_docs`` documents or more is recurring. Of its recurring signatures a line takes the one of most documents as its
template (of equal ones the whole line, then the earlier span). A template's lines stay in the document of the smallest
doc_id among those whose lines took it, and are dropped from all others: since every line has one template, each dropped
line has a line of its template that stays elsewhere.

Texts are tokenised once and shuffled once; counting shuffles hashes, combined before the exchange. A line found in a
third of all documents is a skewed join key of rows a few bytes long, not a collected group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import column, free_names
from kmerloom.storage import materialize

LEADING, SPANS = 3, 4
#: Documents of a template that one part of a join takes: a frequent template is dealt over several tasks.
SPLIT = 1000
#: Characters of a line that has a template however few its tokens, as in scripts without blanks.
LONG_CHARS = 50


def line_templates(docs: DataFrame, min_tokens: int = 3, long_tokens: int = 12) -> DataFrame:
    """(doc_id, sig, signatures): per row an array with one array of template signatures for each \\n-split line.

    Tokens are never split out: a line is brought to single blanks and wildcards, only if it has anything to bring,
    blanks are counted, and the spans' neighbours are cut at the blank of that number.
    """
    blank = r"[\x20\x09-\x0D]"
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def plain(line: Column) -> Column:
        masked = F.regexp_replace(line, rf"(?<!{blank.replace('[', '[^')})[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", "<*>")
        odd = line.rlike(r"[0-9\x09-\x0D]") | F.contains(line, F.lit("  ")) | line.startswith(" ") | line.endswith(" ")
        return F.when(odd, F.trim(F.regexp_replace(masked, f"{blank}+", " "))).otherwise(line)

    def counted(line: Column) -> Column:
        blanks = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
        return F.struct(line.alias("l"), F.when(line == "", 0).otherwise(blanks + 1).alias("n"))

    def signatures(x: Column) -> Column:
        line, n = x["l"], x["n"]
        cut = [LEADING + F.floor((n - LEADING) * i / SPANS).cast("int") for i in range(SPANS + 1)]
        spans = [F.xxhash64(n, F.lit(i), F.call_function("substring_index", line, F.lit(" "), cut[i]), F.call_function("substring_index", line, F.lit(" "), cut[i + 1] - n)) for i in range(SPANS)]
        whole = F.xxhash64(n, F.lit(-1), line)
        return F.when((n < min_tokens) & (F.length(line) < LONG_CHARS), F.array().cast("array<long>")).when(n < long_tokens, F.array(whole)).otherwise(F.array(whole, *spans))

    found = F.transform(F.transform(F.transform(lines, plain), counted), signatures)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("sig"), found.alias("signatures"))


def dropped_lines(docs: DataFrame, min_docs: int = 3, min_tokens: int = 3, long_tokens: int = 12) -> DataFrame:
    """(doc_id, sig, drop): positions (from 0) of the lines to drop, for rows that lose any; sig is the text's hash.

    The joins are merge joins at every size: recurring templates multiply with the input and a frequent one is split.
    """
    lines = materialize(line_templates(docs, min_tokens, long_tokens), "templates")
    each = lines.select("doc_id", "sig", F.explode(F.array_distinct(F.flatten("signatures"))).alias("template"))
    recurring = materialize(each.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "recurring")
    found = lines.select("doc_id", "sig", F.posexplode("signatures").alias("pos", "own")).select("doc_id", "sig", "pos", F.posexplode("own").alias("order", "template"))
    hit = found.join(recurring.hint("merge"), "template")
    best = hit.groupBy("doc_id", "sig", "pos").agg(F.max(F.struct("n", -F.col("order"), "template")).alias("best"))
    parts = F.ceil(F.col("n") / SPLIT)  # of a template by its documents, known on both sides of the join
    taken = materialize(best.select("doc_id", "sig", "pos", "best.template", "best.n"), "taken").withColumn("part", F.pmod(F.xxhash64("doc_id", "sig"), parts))
    first = taken.groupBy("template", "n").agg(F.min("doc_id").alias("first")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    lost = taken.join(first.drop("n").hint("merge"), ["template", "part"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return lost.groupBy("doc_id", "sig").agg(F.collect_set("pos").alias("drop"))


def _without(lines: Column, lost: Column) -> Column:
    """The lines at other positions than ``lost``, which are subtracted as a set: a text of n lines takes some n steps."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    return F.transform(stay, lambda i: F.get(lines, i))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 3, min_tokens: int = 3, long_tokens: int = 12) -> DataFrame:
    """docs with every column kept, recurring lines cut from text, and n_chars (if there is such a column) counted anew.

    Rows are never dropped: a text that loses all lines becomes empty. Null text stays null. Lines of fewer than
    ``min_tokens`` tokens stay, unless they have LONG_CHARS characters or more. Repeats inside one document count once,
    and stay where the document is the template's first. Repeated rows count as documents of their own for ``min_docs``,
    lose the same lines and are all returned. Null doc_ids are never first, unless a template has no other. An empty
    table gives an empty result. Extra columns may have any names.
    """
    own, other, sig, lost, new_text, new_size = free_names(docs, "own", "other_id", "sig", "lost", "new_text", "new_size")
    drop = dropped_lines(docs, min_docs, min_tokens, long_tokens).toDF(other, sig, lost)
    hashed = docs.withColumn(own, F.xxhash64("text"))
    joined = hashed.join(drop, F.col("doc_id").cast("long").eqNullSafe(F.col(other)) & (F.col(own) == F.col(sig)), "left")
    cut = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(_without(lines, F.col(lost)), "\n"))
    joined = joined.withColumn(new_text, F.when(F.col(lost).isNull(), F.col("text")).otherwise(cut[0]))
    new = {"text": F.col(new_text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new_text).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new[c].alias(c) if c in new else column(c) for c in docs.columns))


def line_report(docs: DataFrame, min_docs: int = 3, min_tokens: int = 3, long_tokens: int = 12) -> DataFrame:
    """One row per input row: doc_id, n_lines (\\n-split; 0 for null), kept_chars and text_md5 of the text that is kept."""
    before = docs.select(F.col("doc_id").cast("long"), "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n"))
    after = drop_recurring_lines(before, min_docs, min_tokens, long_tokens)
    return after.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("text_md5"))
