"""Controlled vocabulary: lookup cascade, ranking, hierarchy, query plans, concept extraction."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from papyrine.functions.text import label_score, squashed
from papyrine.session import reachable


def cascade(terms: DataFrame, labels: DataFrame) -> DataFrame:
    """terms: (term); labels: (ui, label). Exact, then squashed matches; of each term only the first rung that answers."""
    exact = terms.join(labels, F.lower("term") == F.lower("label")).withColumn("rung", F.lit(1))
    loose = terms.join(labels, squashed(F.col("term"), None) == squashed(F.col("label"), None)).withColumn("rung", F.lit(2))
    both = exact.unionByName(loose)
    return both.withColumn("least", F.min("rung").over(Window.partitionBy("term"))).where("rung = least").drop("least").distinct()


def ranked(terms: DataFrame, labels: DataFrame) -> DataFrame:
    """terms: (term, t array); labels: (ui, label, l array, path). Labels sharing a token, by score, then nearness to the best hit's path, then brevity."""
    at = lambda df, arr: df.withColumn("token", F.explode(F.array_distinct(arr)))
    met = at(terms, "t").join(at(labels, "l"), "token").drop("token").distinct()
    scored = met.withColumn("score", label_score(F.col("t"), F.col("l")))
    order = [F.col("score").desc(), F.length("label"), F.col("ui")]
    head = Window.partitionBy("term").orderBy(*order)
    near = scored.withColumn("ref", F.first("path").over(head.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    near = near.withColumn("near", F.when(F.col("path") == F.col("ref"), 2).when(F.substring_index("path", ".", 1) == F.substring_index("ref", ".", 1), 1).otherwise(0))
    return near.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.col("score").desc(), F.col("near").desc(), F.length("label"), "ui"))).select("term", "ui", "label", "score", "near", "place")


def ancestors(paths: DataFrame) -> DataFrame:
    """(ui, path) with every leading part of its path, itself included, as up: prefixes as keys, so that subtrees are equi-joins."""
    parts = F.split("path", r"\.")
    return paths.withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))))


def descendants(paths: DataFrame) -> DataFrame:
    """(ui, below): all pairs of a node and one at or below it."""
    own = paths.select("ui", F.col("path").alias("up"))
    return own.join(ancestors(paths).select(F.col("ui").alias("below"), "up"), "up").select("ui", "below").distinct()


def relatives(edges: DataFrame, paths: DataFrame, want_broader: bool = True, least: int = 4) -> DataFrame:
    """edges: (ui, broader); paths: (ui, path). One step down, and one step up where the broader one lies at depth `least` or below: shallow ones name categories. (ui, relative, relation, depth, place): narrower ones first, broader ones deepest first."""
    depth = paths.groupBy(F.col("ui").alias("relative")).agg(F.max(F.size(F.split("path", r"\."))).alias("depth"))
    down = edges.select(F.col("broader").alias("ui"), F.col("ui").alias("relative"), F.lit("narrower").alias("relation"))
    up = edges.select("ui", F.col("broader").alias("relative"), F.lit("broader").alias("relation"))
    rows = (down.unionByName(up) if want_broader else down).distinct().join(depth, "relative", "left").fillna(0, ["depth"])
    rows = rows.where((F.col("relation") == "narrower") | (F.col("depth") >= least))
    place = F.row_number().over(Window.partitionBy("ui").orderBy(F.col("relation").desc(), F.when(F.col("relation") == "broader", -F.col("depth")), "relative"))
    return rows.select("ui", "relative", "relation", "depth", place.alias("place"))


def by_concept(extra: DataFrame, dictionary: DataFrame) -> DataFrame:
    """extra: (spelling, synonym), curated; dictionary: (gram, ui). The synonyms keyed by concept, so that any spelling of it reaches them: (ui, synonyms). Spellings are looked up as terms are, with and then without their blanks and marks."""
    asked = extra.withColumn("term", F.trim(F.regexp_replace(F.lower("spelling"), "[^a-z0-9]+", " "))).where("term <> ''")
    exact = asked.select("term").distinct().join(dictionary.select(F.col("gram").alias("term"), "ui"), "term").groupBy("term").agg(F.min("ui").alias("ui"))
    known = rejoined(exact, asked.select("term").distinct(), dictionary)
    return asked.join(known, "term").groupBy("ui").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))


def crossed(variants: DataFrame, most: int) -> DataFrame:
    """variants: (plan, concept, place, term), concepts numbered from 0. Combinations of one term a concept, least sum of places first, `most` a plan; sides are cut to the width first."""
    k = variants.groupBy("plan").agg(F.count_distinct("concept").alias("k"))
    width = F.greatest(F.lit(2), (F.bround(F.pow(F.lit(float(most)), 1 / F.col("k")), 0) + 1).cast("int"))
    cut = variants.join(k, "plan").where(F.col("place") < width)
    sides = cut.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("concept", "place", "term"))).alias("v"), F.first("k").alias("k"))
    start = F.array(F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("terms")))
    grow = lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(F.filter("v", lambda x: x["concept"] == c), lambda x: F.struct((a["total"] + x["place"]).alias("total"), F.concat(a["terms"], F.array(x["term"])).alias("terms")))))
    made = F.aggregate(F.sequence(F.lit(0), F.col("k").cast("int") - 1), start, lambda acc, c: grow(acc, c))
    rows = sides.select("plan", F.explode(F.slice(F.array_sort(made), 1, most)).alias("q"))
    return rows.select("plan", "q.total", F.array_join("q.terms", " AND ").alias("query"))


#: Up to so many bytes of terms a dictionary is sent whole to every task, as a trie; a larger one is dealt by first words.
TRIE_BYTES, HEAD_BITS = 32 << 20, 1 << 22

#: Semantic types that say nothing about what a paper is about.
UNINFORMATIVE_TYPES = (
    "Human", "Population Group", "Age Group", "Family Group", "Group", "Patient or Disabled Group", "Professional or Occupational Group", "Group Attribute",
    "Animal", "Mammal", "Rodent", "Vertebrate", "Amphibian", "Bird", "Fish", "Reptile",
    "Qualitative Concept", "Quantitative Concept", "Temporal Concept", "Spatial Concept", "Idea or Concept", "Functional Concept", "Conceptual Entity", "Intellectual Product",
    "Language", "Geographic Area", "Regulation or Law", "Classification", "Occupation or Discipline", "Occupational Activity",
    "Organization", "Health Care Related Organization", "Professional Society", "Self-help or Relief Organization",
    "Research Activity", "Governmental or Regulatory Activity", "Educational Activity", "Machine Activity",
    "Laboratory Procedure", "Molecular Biology Research Technique", "Medical Device", "Research Device", "Manufactured Object", "Biomedical Occupation or Discipline",
)


def informative(types: Column, uninformative: tuple[str, ...] = UNINFORMATIVE_TYPES) -> Column:
    """Whether a concept has semantic types and none of them is uninformative."""
    return F.coalesce((F.size(types) > 0) & ~F.arrays_overlap(types, F.array(*map(F.lit, uninformative))), F.lit(False))


def specific(concepts: DataFrame, paths: DataFrame, least: int = 3) -> DataFrame:
    """concepts: (ui, ...); paths: (ui, path). Those whose deepest path has `least` parts; a concept without a path is specific by construction."""
    depth = paths.groupBy(F.col("ui").alias("_ui")).agg(F.max(F.size(F.split("path", r"\."))).alias("_depth"))
    return concepts.join(depth, F.col("ui") == F.col("_ui"), "left").where(F.coalesce("_depth", F.lit(least)) >= least).drop("_ui", "_depth")


def on_one_branch(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """pairs: (a, b). Those of which one stands on a path at or above the other's; both directions are equi-joins on leading parts of paths."""
    own, up = paths.select("ui", F.col("path").alias("own")), ancestors(paths).select("ui", F.col("up"))
    some = pairs.select("a", "b").distinct()

    def above(x: str, y: str) -> DataFrame:
        return some.join(own.withColumnRenamed("ui", x), x).join(up.withColumnRenamed("ui", y), y).where("own = up").select("a", "b")

    return above("a", "b").unionByName(above("b", "a")).distinct()


def trie(grams: list[str]) -> dict:
    """Nested dictionaries by word; under None the places in `grams` that end there."""
    root: dict = {}
    for k, gram in enumerate(grams):
        node = root
        for word in gram.split(" "):
            node = node.setdefault(word, {})
        node.setdefault(None, []).append(k)
    return root


def found_in(words: list[str], root: dict, greedy: bool) -> Iterator[tuple[int, int, int]]:
    """(start, words, term) of all terms in a text; greedy: of the longest one at each start, and none inside it. The last of equal terms counts then."""
    i = 0
    while i < len(words):
        node, j, taken = root.get(words[i]), i + 1, 0
        while node is not None:
            ends = node.get(None)
            if ends:
                if greedy:
                    taken, best = j - i, ends[-1]
                else:
                    for k in ends:
                        yield i, j - i, k
            node, j = node.get(words[j]) if j < len(words) else None, j + 1
        if taken:
            yield i, taken, best
        i += taken or 1


#: So many words of texts become Python objects at once.
PIECE_WORDS = 1 << 16


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_WORDS) -> Iterator[pa.RecordBatch]:
    """The batches cut, so that the lists in w of a piece hold about `most` words, or one row more than that: a worker's memory does not grow with the rows of a batch."""
    for batch in batches:
        words = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("w")), 0).to_numpy(zero_copy_only=False))
        at = [0, *(np.flatnonzero(np.diff(words // most)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(at, at[1:]):
            yield batch.slice(lo, hi - lo)


def by_trie(docs: DataFrame, words: Column, terms: DataFrame, greedy: bool) -> DataFrame:
    """One pass over the texts with the whole dictionary in every task. Only for dictionaries of a checked size."""
    rows = docs.select("id", words.alias("w"))
    table = terms.orderBy("gram", *[c for c in terms.columns if c != "gram"]).toArrow()
    shared = reachable(docs.sparkSession).sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie(shared.value.column("gram").to_pylist())
        for batch in pieces(batches):
            hits = [(r, *h) for r, w in enumerate(batch.column("w").to_pylist()) if w for h in found_in(w, root, greedy)]
            row, at, n, k = (np.array(x, np.int64) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 4
            held = shared.value.take(pa.array(k))
            own = {"id": batch.column("id").take(pa.array(row)), "at": pa.array((at + 1).astype(np.int32)), "n": pa.array(n.astype(np.int32))}
            own |= {c: held.column(c).combine_chunks() for c in held.column_names}
            yield pa.RecordBatch.from_pydict({c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in own.items()})

    kinds = ", ".join(f"`{c}` {k}" for c, k in [("id", dict(rows.dtypes)["id"]), ("at", "int"), ("n", "int"), *terms.dtypes])
    return rows.mapInArrow(run, kinds)


def by_head(docs: DataFrame, words: Column, terms: DataFrame, most: int) -> DataFrame:
    """An equi-join on first words, for dictionaries of any size. A bitmap of fixed size keeps words that begin no term from becoming rows."""
    terms = terms.withColumn("head", F.substring_index("gram", " ", 1)).withColumn("n", F.size(F.split("gram", " ")))
    bit = F.crc32("head") % HEAD_BITS + 1  # a bucket of a bitmap begins at 1
    buckets = terms.select(bit.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))
    whole = np.zeros((HEAD_BITS // 32768, 4096), np.uint8)
    for r in buckets.collect():  # HEAD_BITS bits at most
        whole[r.k - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = reachable(docs.sparkSession).sparkContext.broadcast(whole)
    rows = docs.select("id", words.alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def begins(word: str) -> bool:
            bucket, place = divmod(zlib.crc32(word.encode()) % HEAD_BITS, 32768)
            return bool(bits[bucket, place // 8] >> (place % 8) & 1)

        known: dict[str, bool] = {}
        for batch in pieces(batches):
            hits = []
            for r, w in enumerate(batch.column("w").to_pylist()):
                for i, word in enumerate(w or ()):
                    on = known.get(word)
                    if on is None:
                        if len(known) > 1 << 18:
                            known.clear()
                        on = known[word] = begins(word)
                    if on:
                        hits.append((r, i + 1, w[i : i + most], word))
            r, at, ahead, head = zip(*hits, strict=True) if hits else ((),) * 4
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(r, pa.int64())), "at": pa.array(at, pa.int32()), "ahead": pa.array(ahead, pa.list_(pa.string())), "head": pa.array(head, pa.string())})

    starts = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, at int, ahead array<string>, head string")
    met = starts.join(terms, "head").where((F.size("ahead") >= F.col("n")) & (F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ") == F.col("gram")))
    return met.drop("ahead", "head")


def small(terms: DataFrame, most: int) -> bool:
    """Whether all terms fit into `most` bytes, each with the room a node of the trie takes."""
    return (terms.agg(F.coalesce(F.sum(F.octet_length("gram") + 200), F.lit(0))).first()[0]) <= most


def matches(docs: DataFrame, words: Column, dictionary: DataFrame, most: int, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """dictionary: (gram, ...). All places where a term of up to `most` words stands: (id, at, n, gram, ...), places from 1."""
    terms = dictionary.where((F.size(F.split("gram", " ")) <= most) & (F.col("gram") != ""))
    return by_trie(docs, words, terms, False) if small(terms, trie_bytes) else by_head(docs, words, terms, most)


def concepts(docs: DataFrame, words: Column, dictionary: DataFrame, most: int = 6, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """dictionary: (gram, ui, informative). Leftmost-longest matches: of each start the longest, then starts inside an accepted match are passed over; uninformative matches consume their words but are not returned. Of equal terms the one with the largest ui counts."""
    terms = dictionary.select("gram", "ui", "informative").where((F.size(F.split("gram", " ")) <= most) & (F.col("gram") != ""))
    if small(terms, trie_bytes):
        return by_trie(docs, words, terms, True).where("informative").select("id", "at", "gram", "ui")
    found = by_head(docs, words, terms, most)
    longest = found.groupBy("id", "at").agg(F.max(F.struct("n", "gram", "ui", "informative")).alias("m"))
    runs = longest.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "m.n", "m.gram", "m.ui", "m.informative"))).alias("ms"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for r, ms in enumerate(batch.column("ms").to_pylist()):
                after = 0
                for m in ms:
                    if m["at"] >= after:
                        after = m["at"] + m["n"]
                        if m["informative"]:
                            kept.append((r, m["at"], m["gram"], m["ui"]))
            r, at, gram, ui = zip(*kept, strict=True) if kept else ((),) * 4
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(r, pa.int64())), "at": pa.array(at, pa.int32()), "gram": pa.array(gram, pa.string()), "ui": pa.array(ui, pa.string())})

    return runs.mapInArrow(take, f"id {dict(runs.dtypes)['id']}, at int, gram string, ui string")


def rejoined(found: DataFrame, missed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """found: (term, ui); missed: (term). The terms that no exact entry has, matched without their blanks and marks: of several the first entry counts."""
    keys = dictionary.select(squashed(F.col("gram"), None).alias("_k"), "gram", "ui").where("_k IS NOT NULL")
    first = keys.groupBy("_k").agg(F.min(F.struct("gram", "ui")).alias("m")).select("_k", F.col("m.ui").alias("ui"))
    rest = missed.join(found.select("term"), "term", "left_anti")
    return found.select("term", "ui").unionByName(rest.withColumn("_k", squashed(F.col("term"), None)).join(first, "_k").select("term", "ui"))


def ranked_concepts(found: DataFrame, titles: DataFrame, examples: int = 3) -> DataFrame:
    """found: (id, ui); titles: (id, title). Documents of each concept and its first titles; titles are cut to a few before they are gathered."""
    each = found.select("id", "ui").distinct().join(titles, "id")
    some = each.withColumn("k", F.row_number().over(Window.partitionBy("ui").orderBy("title", "id"))).where(F.col("k") <= examples)
    return each.groupBy("ui").agg(F.count("*").alias("n_docs")).join(some.groupBy("ui").agg(F.array_join(F.array_sort(F.collect_list("title")), " | ").alias("examples")), "ui")


def generic(counts: DataFrame, n: Column, share: float = 0.02) -> DataFrame:
    """counts: (ui, df). Share of the background and whether it is above the limit."""
    return counts.withColumn("share", F.round(F.col("df") / n, 6)).withColumn("is_generic", F.col("df") / n > share)


def either(*tests: Column) -> Column:
    return reduce(Column.__or__, tests)
