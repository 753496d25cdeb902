"""Quality rules by cross-document line frequency, in DataFrame operations only.

Base rules look at one text: words, code points in words, symbols, lines that repeat an earlier line, and
words in 5-word windows that occur twice or more in the text. The corpus rule hashes the normalised
lines of every document, counts for each host (the source) in how many different documents a line stands,
and removes lines above the limit: more than `min_docs` documents and more than `share` of the host's
documents. Exact copies count as one document on both sides, and the first document that carries a line keeps it, so
copying a text does not condemn it. A document that keeps less than `keep` of its words is depleted and
rejected, as is one that fails the base rules.

Counts are summed up before they are shuffled (a line that a third of the corpus carries is one row per
task), and the lines above the limits, few by their definition (a host has at most words / (share *
docs) of them), are joined back to the lines by hash, not to the texts.

Defined cases: null, empty and blank texts have no words, fail the base rules and are not kept; a null
source is a host of its own; rows that repeat a doc_id are judged together as the copies they are, but each
has a row; a line counts once per document; an empty table gives no rows; other columns are ignored by
`judged` and kept by `kept_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from papyrine.llm.common import BLANKS, word_array
from papyrine.session import stored

WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20
MIN_DOCS, SHARE, KEEP = 20, 0.01, 0.25


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over an array of one element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words covered by windows of five whose sequence is found twice or more in the array."""
    span = F.sequence(F.lit(0), F.greatest(F.size(words) - F.lit(WINDOW), F.lit(0)))
    hashes = F.transform(span, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # Neighbours in hash order with the same hash are both repeated.
        marks = let(pairs, lambda s: F.flatten(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))))
        starts = F.array_sort(F.array_distinct(marks))
        return let(starts, lambda m: F.aggregate(F.zip_with(m, F.slice(F.concat(m, F.array(F.lit(1 << 30))), 2, F.greatest(F.size(m), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0).cast("long"), lambda acc, x: acc + x))

    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(count)


def text_lines(text: Column) -> Column:
    """The lines that hold a word, as they are."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def normalised(line: Column) -> Column:
    """Lower case, single blanks, digits as 0."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(line, F.lit(BLANKS))), r"[\x20\x09-\x0D]+", " "), "[0-9]", "0")


def base_columns(docs: DataFrame, text: Column) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    whole = F.coalesce(text, F.lit(""))
    lines = text_lines(text)
    return (
        docs.withColumn("_words", word_array(text))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("_words")))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
        .drop("_words")
    )


def line_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, body, pos, line, words): one row per line of a document."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("body"), F.posexplode(text_lines(F.col(text_col))).alias("pos", "raw"))
    return each.select("doc_id", "source", "body", "pos", F.xxhash64(normalised(F.col("raw"))).alias("line"), F.size(word_array(F.col("raw"))).cast("long").alias("words"))


def frequent_lines(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, source_col: str, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, line, first_doc) of the lines above the limit of their host."""
    hosts = docs.select(F.col(source_col).alias("source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body")).distinct().groupBy("source").agg(F.count("*").alias("_docs"))
    # Different documents of a line: first one row per (host, line, text), then the count.
    texts = lines.groupBy("source", "line", "body").agg(F.min("doc_id").alias("first_doc"))
    counts = texts.groupBy("source", "line").agg(F.count("*").alias("docs"), F.min("first_doc").alias("first_doc")).where(F.col("docs") > min_docs)
    return counts.join(hosts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).where(F.col("docs") > share * F.col("_docs")).select(F.col("source").alias("host"), F.col("line").alias("_line"), "first_doc", "docs")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits) -> tuple[DataFrame, DataFrame]:
    """(frequent, per_doc): the lines above the limits, and by document the words and hashes of those it loses."""
    lines = stored(line_rows(docs, id_col, text_col, source_col), "lines")
    frequent = stored(frequent_lines(docs, lines, id_col, text_col, source_col, **limits), "frequent")
    hit = lines.join(frequent, F.col("source").eqNullSafe(F.col("host")) & (F.col("line") == F.col("_line")) & (F.coalesce(F.col("doc_id") != F.col("first_doc"), F.lit(True))))
    # Rows that repeat a doc_id with the same text share one entry.
    per_doc = hit.dropDuplicates(["doc_id", "source", "body", "pos"]).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("body").alias("_b")).agg(F.sum("words").alias("_lost"), F.collect_set("line").alias("_lines"))
    return frequent, stored(per_doc, "per_doc")


def verdicts(docs: DataFrame, keep: float, **limits) -> DataFrame:
    """docs (doc_id, text, source) as doc_id, source, body (hash of the text), the base columns, n_removed_words, kept and lost (hashes of the lines it loses)."""
    _, per_doc = removed(docs, **limits)
    out = base_columns(docs.withColumn("body", F.xxhash64("text")), F.col("text")).drop("text")
    out = out.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("body") == F.col("_b")), "left")
    out = out.withColumn("n_removed_words", F.coalesce("_lost", F.lit(0).cast("long"))).withColumnRenamed("_lines", "lost")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= keep * F.col("n_words"))).drop("_d", "_s", "_b", "_lost")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: float = KEEP, **limits) -> DataFrame:
    """One row per document: the base columns, n_removed_words and kept."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    return verdicts(plain, keep, **limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: float = KEEP, **limits) -> DataFrame:
    """The kept rows of docs with all their columns, without the lines above the limits."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    # Stored, so that the filter is not pushed back into the expressions that made it.
    verdict = stored(verdicts(plain, keep, **limits).select("doc_id", "source", "body", "kept", "lost"), "verdicts").where("kept")
    verdict = verdict.dropDuplicates(["doc_id", "source", "body"]).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("body").alias("_b"), F.col("lost").alias("_lost"))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.xxhash64(text_col).alias("_body"))
    out = inner.join(verdict, F.col("_id").eqNullSafe(F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_body") == F.col("_b")))
    text = F.col(f"_row.`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("_lost"), F.xxhash64(normalised(x)))), "\n")
    return out.select(*[F.when(F.col("_lost").isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, source, text, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 5) AS r(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, text AS body, regexp_replace(regexp_replace(lower(regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g') AS line,
         len(list_filter(string_split_regex(raw, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM (SELECT doc_id, source, text, unnest(ls) AS raw FROM w)
), hosts AS (
  SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source
), freq AS (
  SELECT l.source, l.line, min(l.doc_id) AS first_doc FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.line, h.docs HAVING count(DISTINCT l.body) > 20 AND count(DISTINCT l.body) > 0.01 * h.docs
), lost AS (
  SELECT l.doc_id, sum(l.words) AS n FROM lines l JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line AND l.doc_id <> f.first_doc GROUP BY l.doc_id
), base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 0.25 * n_words AS kept, n_removed_words
FROM base
"""
