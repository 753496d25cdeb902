"""Line dedup by a log-template tree.

Lines are parsed by a tree of fixed depth: first by their number of tokens, then by their leading tokens;
tokens with a digit (numbers, dates, addresses, hashes) count as variable fields at every level. Below a leaf, a
token is constant where its position holds it in at least `min_docs` documents, else it is a variable field
too, written <*>. A line's template is its tokens with the variable fields generalised; one that
recurs in `min_docs` documents or more is dropped from all documents but the first that carries it. Templates count if
at least 80 % of their tokens are constant, or, with any constant token at all, if the line itself recurs in
`min_docs` documents but for its tokens with a digit ("Page <*> of <*>", "Read more").

The tree is order-free: instead of a parser that meets lines one by one, every level is a count. Leaves in
fewer than min_docs documents are cut first, which removes nearly all prose, then lines of a leaf are
summed up by their masked form, so a line that a third of the corpus repeats is one row per task.
No leaf is ever gathered in one place.

Defined cases: null and empty texts have no lines and stay as they are; lines without tokens, with fewer than
`min_tokens`, or with fields only are never dropped; a line repeated within its first document stays there as often as
it stood; rows that repeat a doc_id count as one document (each keeps its own text); an empty table gives no rows; other columns are
ignored by `dropped_lines` and kept by `without_templates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from papyrine.llm.common import BLANK_RUN, BLANKS
from papyrine.session import stored

MIN_DOCS, MIN_TOKENS, DEPTH, CONSTANT = 5, 1, 3, 0.8
FIELD = "<*>"


def masked(line: Column) -> Column:
    """The line with single blanks and its tokens with a digit generalised."""
    core = F.btrim(line, F.lit(BLANKS))
    single = F.when(core.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(core, BLANK_RUN, " ")).otherwise(core)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(single, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(single)


def masked_lines(text: Column) -> Column:
    """The masked lines of a text. A few plain searches tell whether any line has something to mask or to blank out; most texts have not."""
    lines = F.split(text, "\n")
    odd = F.contains(text, F.lit("  ")) | F.contains(text, F.lit(" \n")) | F.contains(text, F.lit("\n ")) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    return F.when(odd | text.rlike(r"[0-9\x09\x0B-\x0D]"), F.transform(lines, masked)).otherwise(lines)


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_tokens: int, depth: int) -> DataFrame:
    """(doc_id, row, pos, leaf, form, line): one row per line with min_tokens tokens or more; line its masked tokens, form their hash."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.posexplode(masked_lines(F.col(text_col))).alias("pos", "line"))
    blanks = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    # A line of min_tokens tokens is longer than its head of one token less.
    lines = each.where((F.substring_index("line", " ", min_tokens - 1) != F.col("line")) if min_tokens > 1 else (F.col("line") != ""))
    return lines.select("doc_id", "row", "pos", F.xxhash64(blanks + 1, F.substring_index("line", " ", depth)).alias("leaf"), F.xxhash64("line").alias("form"), "line")


def templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, constant: float = CONSTANT) -> tuple[DataFrame, DataFrame]:
    """(lines, recurring): candidate lines (doc_id, pos, leaf, form) and (leaf, form, template, docs, first_doc) of the forms whose template recurs."""
    rows = line_rows(docs, id_col, text_col, min_tokens, depth)
    keys = rows.select("doc_id", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= min_docs)
    leaves = stored(keys.select("leaf"), "leaves")
    lines = stored(rows.join(leaves.hint("shuffle_hash"), "leaf"), "lines")
    forms = stored(lines.groupBy("leaf", "form").agg(F.min("line").alias("line")).select("leaf", "form", F.split("line", " ").alias("tokens")), "forms")
    per_form = lines.select("doc_id", "leaf", "form").distinct()
    weight = per_form.groupBy("leaf", "form").agg(F.count("*").alias("_n"))
    # Support of a token at a position of a leaf: lines of a document that share it are counted once each form.
    cells = forms.join(weight, ["leaf", "form"]).select("leaf", "form", "_n", F.posexplode("tokens").alias("at", "token"))
    support = cells.groupBy("leaf", "at", "token").agg(F.sum("_n").alias("_s")).where(F.col("_s") >= min_docs)
    sorted_cells = cells.join(support, ["leaf", "at", "token"]).groupBy("leaf", "form").agg(F.collect_set(F.struct("at", "token")).alias("held"))
    shaped = (
        sorted_cells.join(forms.select("leaf", "form", F.size("tokens").alias("size")).join(weight, ["leaf", "form"]), ["leaf", "form"])
        .withColumn("held", F.filter("held", lambda x: x["token"] != FIELD))
        .where((F.size("held") >= constant * F.col("size")) | ((F.col("_n") >= min_docs) & (F.size("held") > 0)))
        .select("leaf", "form", F.xxhash64("size", F.array_sort("held")).alias("template"))
    )
    shaped = stored(shaped, "shaped")
    recurring = (
        per_form.join(shaped, ["leaf", "form"]).select("leaf", "template", "doc_id").distinct()
        .groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).where(F.col("docs") >= min_docs)
    )
    return lines, stored(shaped.join(recurring, ["leaf", "template"]), "recurring")


def dropped_lines(docs: DataFrame, **how) -> DataFrame:
    """(row, drop): by row (the hash of its id and text) the positions (from 0) of the lines it loses."""
    lines, recurring = templates(docs, **how)
    hit = lines.join(recurring, ["leaf", "form"]).where(F.coalesce(F.col("doc_id") != F.col("first_doc"), F.lit(True)))
    return hit.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def _with_drop(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """docs with _drop (the positions to drop, or null) and _left (the text that stays)."""
    drop = stored(dropped_lines(docs, id_col=id_col, text_col=text_col, **how), "drop").select(F.col("row").alias("_d"), F.col("drop").alias("_drop"))
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("_drop"), i)), "\n")
    return docs.join(drop.hint("shuffle_hash"), F.xxhash64(id_col, text_col) == F.col("_d"), "left").withColumn("_left", F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(left))


def without_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with all its columns and rows, the recurring lines gone from the text."""
    inner = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    out = _with_drop(inner, "doc_id", "text", **how)
    return out.select(*[F.col("_left").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_chars, kept_sha256 (of the text that stays)."""
    out = _with_drop(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", **how)
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split(F.col("text"), "\n")))
    left = F.coalesce("_left", F.lit(""))
    return out.select("doc_id", lines.cast("long").alias("n_lines"), F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")).cast("long").alias("n_dropped"), F.length(left).cast("long").alias("kept_chars"), F.sha2(left, 256).alias("kept_sha256"))


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
), rows AS (
  SELECT doc_id, pos, toks, len(toks) AS n FROM (
    SELECT doc_id, pos, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM raw)
  WHERE len(toks) >= 1
), keyed AS (
  SELECT doc_id, pos, n, toks, array_to_string(toks[1:3], ' ') AS head, array_to_string(toks, ' ') AS form FROM rows
), leaves AS (
  SELECT n, head FROM keyed GROUP BY n, head HAVING count(DISTINCT doc_id) >= 5
), lines AS (
  SELECT k.* FROM keyed k JOIN leaves USING (n, head)
), forms AS (
  SELECT n, head, form, any_value(toks) AS toks, count(DISTINCT doc_id) AS c FROM lines GROUP BY n, head, form
), cells AS (
  SELECT n, head, form, c, unnest(range(0, n)) AS ix, unnest(toks) AS token FROM forms
), support AS (
  SELECT n, head, ix, token FROM cells GROUP BY n, head, ix, token HAVING sum(c) >= 5 AND token <> '<*>'
), shaped AS (
  SELECT n, head, form, string_agg(ix || ':' || token, ' ' ORDER BY ix) AS template FROM cells JOIN support USING (n, head, ix, token)
  GROUP BY n, head, form HAVING count(*) >= 0.8 * n OR max(c) >= 5
), recurring AS (
  SELECT n, head, template, min(doc_id) AS first_doc FROM lines JOIN shaped USING (n, head, form) GROUP BY n, head, template HAVING count(DISTINCT doc_id) >= 5
), hit AS (
  SELECT DISTINCT doc_id, pos FROM lines JOIN shaped USING (n, head, form) JOIN recurring USING (n, head, template) WHERE doc_id <> first_doc
), left_lines AS (
  SELECT r.doc_id, count(h.pos) AS n_dropped, count(*) AS n_lines, coalesce(string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (WHERE h.pos IS NULL), '') AS kept
  FROM raw r LEFT JOIN hit h ON r.doc_id = h.doc_id AND r.pos = h.pos GROUP BY r.doc_id
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
       CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN left_lines USING (doc_id)
"""
