"""Fill-in-middle transformation, in Spark SQL functions only.

A text is cut into units (a word with the blanks before it, or blanks alone), matched from the left by
`regexp_extract_all`; the units joined are the text. The hexadecimal SHA-256 of the seed and the document's id gives four numbers of 32 bits: two
cuts between units, whether the document is rearranged, and how. The rearranged text has a sentinel before each of its
three parts: psm writes prefix, suffix, middle, spm suffix, prefix, middle; a plain document stays as it is. `restored`
takes an output apart at its sentinels and puts the text together again. Everything is a projection: no shuffle, and no
row meets another.

Defined cases: a null text is an empty one; empty texts and texts that hold a sentinel are plain; blanks alone are one
unit; a null id counts as the empty string, so all such rows have the same cuts in units; rows that repeat an id are cut alike;
an empty table gives no rows; columns other than id and text are ignored and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
SEED, RATE, SPM = 42, 50, 80


def numbers(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of `seed:doc_id`, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output): rate percent of the documents are rearranged, spm percent of those as spm. The parts of plain documents are null."""
    h1, h2, h3, h4 = numbers(F.col("doc_id"), seed)
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    units = text.withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), 0)).withColumn("n", F.size("units").cast("long"))
    plain = (F.col("text") == "") | F.col("text").rlike(SENTINELS) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    cuts = units.select("doc_id", "text", "units", "n", form.alias("form"), (h1 % (F.col("n") + 1)).alias("one"), (h2 % (F.col("n") + 1)).alias("two"))
    cuts = cuts.withColumn("lo", F.least("one", "two").cast("int")).withColumn("hi", F.greatest("one", "two").cast("int"))

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))

    parts = cuts.select(
        "doc_id", "n", "form", "text",
        part(F.lit(1), F.col("lo")).alias("prefix"),
        part(F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("middle"),
        part(F.col("hi") + 1, F.size("units") - F.col("hi")).alias("suffix"),
    )
    spm_text = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm_text = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm_text).otherwise(psm_text)
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(rows: DataFrame) -> DataFrame:
    """rows with the column text, rebuilt from the columns output and form alone."""
    parts = rows.withColumn("_parts", F.when(F.col("form") != "plain", F.split("output", SENTINELS, -1)))

    def joined(*order: int) -> Column:
        return F.concat(*[F.element_at("_parts", k) for k in order])

    text = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", joined(2, 4, 3)).otherwise(joined(3, 4, 2))
    return parts.withColumn("text", text).drop("_parts")


def digest(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = restored(transformed(docs, **how))
    return out.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
numbered AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4
  FROM hashed),
formed AS (
  SELECT doc_id, text, units, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered),
parted AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:lo], ''), '') AS p,
         coalesce(array_to_string(units[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(units[hi + 1:], ''), '') AS s
  FROM formed)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parted
"""
