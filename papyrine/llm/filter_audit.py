"""Filter interaction audit: what each filter of a cascade does in every order of the filters.

A document's failures are a mask with one bit a filter; the last filter fails texts that a smaller id has too.
Duplicates come by sorting: rows are dealt by ranges of (XXH64 of the text, SHA-256 of the text, id, row), so a group of
copies of any size is spread over many tasks, and sorted within a task by fingerprint, full text and id. Each row is compared
with the row before it. A run of equal texts that goes on over a border of two tasks is mended by one row a task: the texts
at its two ends (as SHA-256) and the smallest id of its last run; the driver walks over these rows, as many as tasks, and
what a task inherits goes to the rows of its first run. (Range bounds are drawn on the driver, so the full text is no
range key; within a task texts are compared in full, so only texts with one SHA-256 could go astray, and only at a border.)

Masks are counted by part, mask and the labels good and toxic; all else is arithmetic on at most 2 ** k rows a part, for the outcome of a step depends
on its filter and the set of the filters before it only: k * 2 ** (k - 1) sums a part, which each order then looks up.

Defined cases: a null text is an empty one, and empty texts are copies of each other; a null id is no smaller and no larger than
any, so such rows never fail as copies; rows that repeat the smallest id of a text do not fail either; a null part is the empty string;
labels that repeat an id count if any of them is 1, null labels are not 1; an empty table gives no rows; columns other than id, text and
part are ignored and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from papyrine.llm.common import slices, word_array
from papyrine.session import dropped, reachable, stored

MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 50, 65, 5, "[#$%&*|]"
COPIES = "E"
SORTED = "doc_id long, part string, mask int, first boolean, task int, head_text binary, tail_text binary, tail_id long, whole boolean"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The text filters by letter, in order of their bits: true where a text fails."""
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(MARKS),
    }


def in_order(docs: DataFrame, filters, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, sha, text, mask) in ranges by fingerprint, text and id; the mask is made after the sort, once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"print": F.xxhash64("text"), "sha": F.unhex(F.sha2("text", 256)), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("print", "sha", "doc_id", "row").sortWithinPartitions("print", "sha", "text", "doc_id", "row")
    rows = rows.withColumn("words", word_array(F.col("text")))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters(F.col("text"), F.col("words")).values())), F.lit(0))
    return rows.select("doc_id", "part", "sha", "text", mask.cast("int").alias("mask"))


def compared(bit: int):
    """Of sorted rows, each with `bit` set where the text equals the one before and the id is larger than the first of the run; then one row on the task's borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        head_text = tail_text = last = lowest = None
        runs = 0
        for batch in batches:
            for part in slices(batch, "text"):
                n, text = part.num_rows, part.column("text")
                same = [last is not None and text[0].as_py() == last, *pc.equal(text[1:], text[: n - 1]).to_pylist()]
                ids, masks, first = part.column("doc_id").to_pylist(), part.column("mask").to_pylist(), []
                for i in range(n):
                    if not same[i]:
                        runs, lowest = runs + 1, None
                    if lowest is None:
                        lowest = ids[i]
                    elif ids[i] is not None and ids[i] > lowest:
                        masks[i] |= bit
                    first.append(runs == 1)
                last, tail_text = text[n - 1].as_py(), part.column("sha")[n - 1].as_py()
                head_text = head_text or part.column("sha")[0].as_py()
                nothing = {"head_text": pa.nulls(n, pa.binary()), "tail_text": pa.nulls(n, pa.binary()), "tail_id": pa.nulls(n, pa.int64()), "whole": pa.nulls(n, pa.bool_())}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "part": part.column("part"), "mask": pa.array(masks, pa.int32()), "first": pa.array(first), "task": pa.array([task] * n, pa.int32())} | nothing)
        if runs:
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.nulls(1, pa.int64()), "part": pa.nulls(1, pa.string()), "mask": pa.nulls(1, pa.int32()), "first": pa.nulls(1, pa.bool_()), "task": pa.array([task], pa.int32()),
                "head_text": pa.array([head_text], pa.binary()), "tail_text": pa.array([tail_text], pa.binary()), "tail_id": pa.array([lowest], pa.int64()), "whole": pa.array([runs == 1]),
            })

    return run


def inherited(borders: list) -> list[tuple[int, int]]:
    """(task, smallest id of the run that goes on into its first rows), from one row a task."""
    out, text, low = [], None, None
    for b in sorted(borders, key=lambda b: b.task):
        goes_on = text is not None and b.head_text == text
        if goes_on and low is not None:
            out.append((b.task, low))
        if not (goes_on and b.whole and low is not None):
            low = b.tail_id
        text = b.tail_text
    return out


def masks(docs: DataFrame, filters=failures, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, part, mask) of every row, the stored table under it, and the number of filters."""
    reachable(docs.sparkSession)
    k = len(filters(F.lit(""), F.array(F.lit("")))) + 1
    bit = 1 << (k - 1)
    table = stored(in_order(docs, filters, id_col, text_col, part_col).mapInArrow(compared(bit), SORTED), "sorted")
    carried = inherited(table.where("whole is not null").select("task", "head_text", "tail_text", "tail_id", "whole").collect())  # a row a task
    spark = docs.sparkSession
    low = F.broadcast(spark.createDataFrame(carried, "_task int, _low long"))  # at most a row a task
    rows = table.where("whole is null").join(low, F.col("first") & (F.col("task") == F.col("_task")), "left")
    rows = rows.select("doc_id", "part", F.when(F.col("doc_id") > F.col("_low"), F.col("mask").bitwiseOR(bit)).otherwise(F.col("mask")).alias("mask"))
    return rows, table, k


def counted(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): the additive counters of a part."""
    marks = labels.groupBy(F.col(id_col).cast("long").alias("_id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}") for c in ("quality", "toxic")])
    marks = marks.where("_id is not null and (_quality = 1 or _toxic = 1)")
    known = rows.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "_quality", "_toxic")
    bare = rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("_quality"), F.lit(0).alias("_toxic"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a) for c, a in (("_quality", "good"), ("_toxic", "toxic"))]
    return known.unionByName(bare).groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)


def steps(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the letters and step. A step is its filter (a bit) behind a set of others (a mask)."""
    spark, k = counts.sparkSession, len(letters)
    cells = [(sum(before), 1 << f) for f in range(k) for m in range(k) for before in combinations([1 << g for g in range(k) if g != f], m)]
    orders = []
    for order in permutations(range(k)):
        bits = [1 << f for f in order]
        orders += [("".join(letters[f] for f in order), s + 1, sum(bits[:s]), bits[s]) for s in range(k)]
    of = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("bit")) for b, f in cells])
    wide = counts.select("*", F.explode(of).alias("cell")).select("*", "cell.before", "cell.bit")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    all_orders = len(list(permutations(range(k))))

    def total(when: Column, what: Column | str = "n") -> Column:
        return F.sum(F.when(when, F.col(what) if isinstance(what, str) else what).otherwise(0))

    share = F.col("n") * (F.lit(all_orders) / F.bit_count("mask")).cast("long")  # each failed filter of a document is the first in as many orders
    sums = wide.groupBy("part", "before", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"), total(fails, share).alias("shapley"),
    )
    fixed = spark.createDataFrame(orders, "filter_order string, step int, before int, bit int")  # k! * k rows, whatever the data
    return sums.join(F.broadcast(fixed), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, filters=failures, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order and step what the step's filter keeps and removes; `filters` gives the text filters by letter, copies are the last, E."""
    letters = "".join(filters(F.lit(""), F.array(F.lit("")))) + COPIES
    rows, table, _ = masks(docs, filters, id_col, text_col, part_col)
    counts = stored(counted(rows, labels, id_col), "counts")
    dropped(table)
    return steps(counts, letters)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part,
             len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
             100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, (CASE WHEN a THEN 1 ELSE 0 END) | (CASE WHEN b THEN 2 ELSE 0 END) | (CASE WHEN c THEN 4 ELSE 0 END)
               | (CASE WHEN d THEN 8 ELSE 0 END) | (CASE WHEN e THEN 16 ELSE 0 END) AS mask,
             count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
           FROM letter p, letter q, letter r, letter s, letter t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
cells AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
          FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
sums AS (SELECT part, filter_order, step, bit,
                sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
         FROM m, cells GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM sums
"""
