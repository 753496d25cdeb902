"""Records of indented blocks: one record a numbered line, then blocks under headings, then the path to the descriptor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Headings of the blocks with the fields they fill, and the lines that end a block.
BLOCKS = {"Subheadings:": "subheadings", "Entry Terms:": "entry_terms", "See Also:": "see_also", "Previous Indexing:": "previous_indexing"}
TREE, ENDS, HIERARCHY = "Tree Number(s):", ("Year introduced", "Unique ID"), "All MeSH Categories"
QUERY_TERMS = 20


def headings() -> str:
    """A pattern for the whole of a heading line."""
    quoted = lambda s: "\\Q" + s + "\\E"
    return "|".join([*(quoted(b) for b in BLOCKS), *(quoted(e) + "[^\n]*" for e in (TREE, *ENDS)), quoted(HIERARCHY)])


def lines_of(block: Column) -> Column:
    """The lines of a block without the blanks around them; empty ones go."""
    return F.filter(F.transform(F.split(block, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def record_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a row for each record of its texts: the columns n (its place in the text, from 0) and record, a struct of
    descriptor, definition, tree_numbers, entry_terms, subheadings, see_also, previous_indexing, broader and query.

    A record begins with a line "number: descriptor"; texts without one give no rows. It is cut at its heading lines, so each
    piece is a heading with the lines under it and no state goes from line to line: a block's field takes the lines of all its pieces,
    the definition is the first line under no block, the last tree line counts, and from the hierarchy on every line but
    headings belongs to the path, whose last line but one is the broader term if the last is the descriptor itself.
    """
    chunks = F.split(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), r"\n(?=[0-9]+:\s)")
    each = df.select("*", F.posexplode(F.filter(chunks, lambda c: c.rlike(r"^[0-9]+:\s"))).alias("n", "_chunk"))
    pieces = F.transform(F.split("_chunk", r"\n(?=[ \t]*(?:" + headings() + r")\s*(?:\n|\z))"), lines_of)
    cut = each.withColumn("_pieces", F.filter(F.transform(pieces, lambda ls: F.struct(F.get(ls, 0).alias("head"), F.slice(ls, 2, F.size(ls)).alias("rest"))), lambda p: p["head"].isNotNull()))
    start = F.array_position(F.transform("_pieces", lambda p: p["head"]), HIERARCHY).cast("int")
    cut = cut.withColumn("_before", F.when(start > 0, F.slice("_pieces", 1, start - 1)).otherwise(F.col("_pieces"))).withColumn("_path", F.when(start > 0, F.slice("_pieces", start, F.size("_pieces"))))

    def field(heading: str) -> Column:
        return F.flatten(F.transform(F.filter("_before", lambda p: p["head"] == heading), lambda p: p["rest"]))

    loose = F.flatten(F.transform(F.filter("_before", lambda p: ~p["head"].isin(*BLOCKS)), lambda p: p["rest"]))
    trees = F.filter("_pieces", lambda p: p["head"].startswith(TREE))
    numbers = F.transform(F.split(F.substring(F.try_element_at(trees, F.lit(-1))["head"], len(TREE) + 1, 1 << 30), ","), lambda x: F.trim(x))
    path = F.flatten(F.transform("_path", lambda p: F.concat(F.when(p["head"] == HIERARCHY, F.array(p["head"])).otherwise(F.array().cast("array<string>")), p["rest"])))
    descriptor = F.regexp_replace(F.get("_pieces", 0)["head"], r"^[0-9]+:\s*", "")
    none = F.array().cast("array<string>")
    fields = cut.select(
        *[F.col(f"`{c}`") for c in df.columns], "n", descriptor.alias("_d"), F.coalesce(F.get(loose, 0), F.lit("")).alias("_definition"), F.coalesce(F.filter(numbers, lambda x: x != ""), none).alias("_trees"),
        *[field(h).alias(f"_{c}") for h, c in BLOCKS.items()], path.alias("_way"),
    )
    broader = F.when((F.size("_way") >= 2) & (F.try_element_at("_way", F.lit(-1)) == F.col("_d")), F.array(F.try_element_at("_way", F.lit(-2)))).otherwise(none)
    asked = F.transform(F.filter(F.slice(F.concat(F.array("_d"), "_entry_terms"), 1, QUERY_TERMS), lambda x: x != ""), lambda x: F.concat(F.lit('"'), x, F.lit('"[tiab]')))
    query = F.array_join(F.concat(F.when(F.col("_d") != "", F.array(F.concat(F.lit('"'), "_d", F.lit('"[MeSH Terms]')))).otherwise(none), asked), " OR ")
    record = F.struct(F.col("_d").alias("descriptor"), F.col("_definition").alias("definition"), F.col("_trees").alias("tree_numbers"), *[F.col(f"_{c}").alias(c) for c in BLOCKS.values()], broader.alias("broader"), query.alias("query"))
    return fields.select(*[F.col(f"`{c}`") for c in df.columns], "n", record.alias("record"))
