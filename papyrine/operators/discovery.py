"""Discovery: indirect links, citation walks, verdicts on directions, collisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from papyrine.operators.relational import top
from papyrine.session import dealt, stored


def bridges(uses: DataFrame, seeds: DataFrame, least: int = 1) -> DataFrame:
    """uses: (doc, item); seeds: (item). Items that never stand with a seed, by how many linking items stand with both (ltc) and how often (freq)."""
    a_docs = uses.join(seeds, "item", "left_semi").select("doc").distinct()
    with_a = uses.join(a_docs, "doc", "left_semi").select("item").distinct()
    b = with_a.join(seeds, "item", "left_anti").withColumnRenamed("item", "b")
    b_docs = uses.join(b, uses.item == b.b).select("doc", "b").distinct()
    pairs = b_docs.join(uses.select("doc", F.col("item").alias("c")).distinct(), "doc").where("b <> c")
    c = pairs.join(with_a, pairs.c == with_a.item, "left_anti").join(seeds, pairs.c == seeds.item, "left_anti")
    return c.groupBy("c", "b").agg(F.count("*").alias("n")).groupBy("c").agg(F.count("*").alias("ltc"), F.sum("n").alias("freq")).where(F.col("ltc") >= least)


def nearest(pool: DataFrame, targets: list[tuple[int, int]], most: int) -> DataFrame:
    """pool: (item, freq, place, silent); targets: a top-k report's (found, freq). For each target the `most` pool rows nearest by frequency, ties by place.

    Each task keeps its nearest ones for each target in one pass, at most targets * most rows, and these are ranked again: no pool row is paired with every target.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {found: None for found, _ in targets}
        for batch in batches:
            rows = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in ("item", "freq", "place", "silent")], np.int64).T
            for found, freq in targets:
                both = rows if held[found] is None else np.concatenate([held[found], rows])
                held[found] = both[np.lexsort((both[:, 2], np.abs(both[:, 1] - freq)))[:most]]
        for found, rows in held.items():
            if rows is not None and len(rows):
                columns = [pa.array(np.full(len(rows), found)), *[pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], pa.array(rows[:, 3].astype(bool))]
                yield pa.RecordBatch.from_arrays(columns, names=["found", "item", "freq", "place", "silent"])

    near = pool.select(F.col("item").cast("long"), F.col("freq").cast("long"), F.col("place").cast("long"), "silent").mapInArrow(run, "found long, item long, freq long, place long, silent boolean")
    want = pool.sparkSession.createDataFrame(targets, "found long, target long")
    near = near.join(F.broadcast(want), "found").withColumn("gap", F.abs(F.col("freq") - F.col("target")))
    return top(near, ["found"], [F.col("gap"), F.col("place")], most).drop("rank")


def matched_controls(found: DataFrame, pool: DataFrame, tries: int = 6) -> DataFrame:
    """found: (item, freq), a top-k report, taken in the order of its column place, without one by falling frequency; pool: (item, freq) and, if they matter, silent (whether the
    item may serve) and place (which settles ties). For each found item the first silent one of its `tries` nearest pool items by frequency that are not spent; those passed over
    are spent, as the one taken is. Sequential by nature, over at most len(found) * tries candidates an item: those before it can spend no more. (item, freq, control)."""
    pool = pool if "silent" in pool.columns else pool.withColumn("silent", F.lit(True))
    pool = pool if "place" in pool.columns else pool.withColumn("place", F.col("item"))
    order = [F.col("place")] if "place" in found.columns else [F.col("freq").desc(), F.col("item")]
    targets = [(r.item, r.freq) for r in found.orderBy(*order).select("item", "freq").collect()]  # the report itself
    schema = "item long, freq long, control long"
    if not targets:
        return found.sparkSession.createDataFrame([], schema)
    near: dict[int, list] = {}
    for r in nearest(pool, targets, len(targets) * tries).orderBy("found", "gap", "place").collect():
        near.setdefault(r.found, []).append((r.item, r.silent))
    spent, rows = set(), []
    for item, freq in targets:
        free = [c for c in near.get(item, ()) if c[0] not in spent][:tries]
        at = next((k for k, c in enumerate(free) if c[1]), None)
        spent |= {c[0] for c in (free if at is None else free[: at + 1])}
        rows.append((item, freq, None if at is None else free[at][0]))
    return found.sparkSession.createDataFrame(rows, schema)


def linked(uses: DataFrame, anchor: int, n_b: int = 30) -> DataFrame:
    """uses: (doc, item), no repeats. Items that never stand with the anchor, by the linking items they stand with: (item, ltc, freq). The linking items are the `n_b` that most often stand with
    the anchor, a parameter of the experiment, so a document has at most n_b rows for each of its items, however many it holds."""
    with_a = uses.join(uses.where(F.col("item") == anchor).select("doc"), "doc", "left_semi")
    a_items = stored(with_a.groupBy("item").agg(F.count("*").alias("n")), "a")
    b = a_items.where(F.col("item") != anchor).orderBy(F.col("n").desc(), "item").limit(n_b).select(F.col("item").alias("b"))
    b_docs = stored(uses.join(F.broadcast(b), uses.item == b.b).select("doc", "b"), "b")
    far = uses.join(a_items.select("item"), "item", "left_anti").where(F.col("item") != anchor)
    per = far.join(b_docs, "doc").groupBy("item", "b").agg(F.count("*").alias("n"))
    return per.groupBy("item").agg(F.count("*").alias("ltc"), F.sum("n").alias("freq"))


def experiment(uses: DataFrame, anchor: int, most: int = 20, n_b: int = 30, scan: int = 8, tries: int = 6, least_docs: int = 3, exclude: DataFrame | None = None, checks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, rows). Do items that are only linked to the anchor before the cutoff meet it afterwards, more often than others of like frequency?

    uses: (doc, item, is_before), no repeats; exclude: (item) judged to be no hypothesis; checks: (item, before, after), how often an item stands with the anchor, where asked elsewhere, else it is counted.
    The ranking is by ltc, then freq. The first `most` silent items among the first scan * most are the top, their controls are matched among those ranked behind the places scanned.
    rows: (kind, item, ltc, freq, before, after, hit); report: one row, the gate's, with pool_size, n_excluded and n_scanned.
    """
    early = uses.where("is_before").select("doc", "item")
    found = stored(linked(early, anchor, n_b), "linked")
    kept = found if exclude is None else found.join(exclude.select("item").distinct(), "item", "left_anti")
    if checks is None:
        with_a = uses.join(uses.where(F.col("item") == anchor).select("doc", "is_before"), ["doc", "is_before"], "left_semi")
        checks = with_a.groupBy("item").agg(F.count_if("is_before").alias("before"), F.count_if(~F.col("is_before")).alias("after"))
    pool = kept.join(checks.select("item", "before", "after"), "item", "left").fillna(0, ["before", "after"]).withColumn("silent", F.col("before") == 0)
    pool = stored(pool, "pool")
    order = [F.col("ltc").desc(), F.col("freq").desc(), F.col("item")]
    head = pool.orderBy(*order).limit(scan * most)  # the places that are looked at
    head = stored(head.withColumn("place", F.row_number().over(Window.orderBy(*order))), "head")
    best = stored(silent_first(head.select("item", "place", "silent"), most, scan), "top").join(head.drop("place", "silent"), "item")
    scanned = (best.agg(F.max("n_scanned")).first()[0]) or 0
    rest = pool.join(head.where(F.col("place") <= scanned).select("item"), "item", "left_anti")
    rest = rest.withColumn("place", F.col("item"))  # ties of frequency go by item
    controls = matched_controls(best.select("item", "freq", "place"), rest, tries).select(F.col("control").alias("item")).where("item IS NOT NULL")
    sides = best.select(F.lit("top").alias("kind"), "item").unionByName(controls.select(F.lit("control").alias("kind"), "item"))
    rows = stored(sides.join(pool, "item").select("kind", "item", "ltc", "freq", "before", "after", (F.col("after") >= least_docs).alias("hit")), "rows")
    size, whole = pool.count(), found.count()
    return gate(rows).withColumns({"pool_size": F.lit(size).cast("long"), "n_excluded": F.lit(whole - size).cast("long"), "n_scanned": F.lit(scanned).cast("long")}), rows


def silent_first(ranked: DataFrame, most: int = 20, scan: int = 8) -> DataFrame:
    """ranked: (item, place from 1, silent). The first `most` silent items among the first scan * most places, with n_scanned, the places looked at until then."""
    seen = ranked.where(F.col("place") <= scan * most)
    taken = seen.where("silent").orderBy("place").limit(most)
    ends = taken.agg(F.count("*").alias("n"), F.max("place").alias("last")).join(seen.agg(F.max("place").alias("all")))
    return taken.join(F.broadcast(ends)).select("item", "place", F.when(F.col("n") == most, F.col("last")).otherwise(F.col("all")).cast("long").alias("n_scanned"))


def gate(rows: DataFrame, ceiling: float = 0.5, least: float = 2.0) -> DataFrame:
    """rows: (kind 'top' or 'control', hit, ltc). One row: hit rates, mean ltc, their ratio and the verdict. A control that hits above the ceiling, or no ratio, voids the experiment."""
    own = lambda kind, value: F.avg(F.when(F.col("kind") == kind, value))
    hit = F.col("hit").cast("int")
    out = rows.agg(
        own("top", hit).alias("top_hit_rate"), own("control", hit).alias("control_hit_rate"), F.count_if(F.col("kind") == "top").alias("n_top"), F.count_if(F.col("kind") == "control").alias("n_control"),
        F.round(own("top", F.col("ltc")), 2).alias("mean_ltc_top"), F.round(own("control", F.col("ltc")), 2).alias("mean_ltc_control"),
    )
    out = out.withColumn("ratio", F.when((F.col("top_hit_rate") > 0) & (F.col("control_hit_rate") > 0), F.col("top_hit_rate") / F.col("control_hit_rate")))
    return out.withColumn("verdict", F.when(F.col("control_hit_rate") > ceiling, "VOID").when(F.col("ratio").isNull(), "VOID").when(F.col("ratio") >= least, "PASS").otherwise("FAIL"))


def walk(edges: DataFrame, seeds: DataFrame, depth: int, per_step: int, weight: DataFrame) -> DataFrame:
    """edges: (src, dst) cites; weight: (node, score). From the seeds, `depth` steps along references and citers, each keeping the per_step best unseen nodes a seed. (seed, node, step).

    A seed has seen 1 + per_step * (depth - 1) nodes at most, so of a node's neighbours only so many and per_step of the best can be kept: the others never meet the seeds."""
    ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    n = ways.count()
    ways = dealt(ways, n, "dst").distinct()
    best = [F.col("score").desc_nulls_last(), F.col("dst")]
    ways = stored(top(dealt(ways.join(weight.withColumnRenamed("node", "dst"), "dst", "left"), n, "src"), ["src"], best, 1 + per_step * depth).select("src", "dst", "score"), "ways")
    out = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("step"))
    edge = out
    for k in range(1, depth + 1):
        near = edge.join(ways, edge.node == ways.src).select("seed", F.col("dst").alias("node"), "score").distinct().join(out.select("seed", "node"), ["seed", "node"], "left_anti")
        best = near.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy(F.col("score").desc_nulls_last(), "node")))
        edge = best.where(F.col("_n") <= per_step).select("seed", "node", F.lit(k).alias("step"))
        out = out.unionByName(edge)
    return out


def verdicts(directions: DataFrame, postings: DataFrame, settled: int = 3, least_papers: int = 25) -> DataFrame:
    """directions: (direction, term), one row a term; postings: (doc, term, is_before). Verdict from how many documents hold all terms before and after the cutoff."""
    directions = stored(directions.select("direction", "term").distinct(), "directions")  # of known size, so that a few are sent to the postings
    size = directions.groupBy("direction").agg(F.count_distinct("term").alias("n_terms"))
    asked = stored(directions.select("term").distinct(), "terms")
    met = stored(postings.join(asked, "term", "left_semi").select("doc", "term", "is_before").distinct(), "postings")  # those that are asked for, read twice, made once
    papers = met.select("doc", "term").distinct().groupBy("term").agg(F.count("doc").alias("papers"))
    per_term = directions.join(papers, "term", "left").groupBy("direction").agg(F.min(F.coalesce("papers", F.lit(0))).alias("rarest"))
    docs = directions.join(met, "term").groupBy("direction", "doc", "is_before").agg(F.count("*").alias("held")).join(size, "direction").where("held = n_terms")
    counts = docs.groupBy("direction").agg(F.count_if("is_before").alias("before"), F.count_if(~F.col("is_before")).alias("after"))
    met = size.join(per_term, "direction").join(counts, "direction", "left").fillna(0, ["before", "after"])
    verdict = F.when(F.col("n_terms") < 2, "SINGLE GROUP").when(F.col("rarest") < least_papers, "TERM TOO RARE").when(F.col("before") >= settled, "ALREADY DONE").when(F.col("after") >= settled, "PURSUED SINCE").otherwise("STILL OPEN")
    return met.withColumn("verdict", verdict)


def checked(directions: DataFrame, slots: DataFrame, postings: DataFrame, failed: DataFrame | None = None, default_cutoff: int = 2015, settled: int = 3, least_papers: int = 25, meet: int = 3) -> DataFrame:
    """The verdict on each direction, each against its own cutoff, with the counts behind it and the zone of those that are not done.

    directions: (direction, cutoff), a cutoff that is null stands for the default; slots: (direction, slot, term), the terms of a slot are alternatives;
    postings: (doc, term, subject, open, year), subject where the abstract holds the term and not only the body; failed: (direction, why), checks that
    broke off. A paper takes a direction if each slot has a term among its subjects. Co-mentions are open papers up to the cutoff that hold every slot anywhere.
    """
    own = directions.select("direction", F.coalesce("cutoff", F.lit(default_cutoff)).alias("cutoff"))
    terms = stored(slots.where(F.trim("term") != "").select("direction", "slot", "term").distinct(), "slots")  # of known size, so that a few are sent to the postings
    met = terms.join(postings, "term").groupBy("direction", "slot", "doc").agg(F.max("subject").alias("subject"), F.max("open").alias("open"), F.max("year").alias("year"))
    met = stored(met, "met")  # read twice, made once
    papers = met.groupBy("direction", "slot").agg(F.count_if("subject").alias("papers"))
    sizes = terms.select("direction", "slot").distinct().join(papers, ["direction", "slot"], "left")
    sizes = sizes.groupBy("direction").agg(F.count("*").alias("n_slots"), F.min(F.coalesce("papers", F.lit(0))).alias("rarest"))
    docs = met.groupBy("direction", "doc").agg(F.count("*").alias("held"), F.count_if("subject").alias("subjects"), F.max("open").alias("open"), F.max("year").alias("year"))
    docs = docs.join(sizes.join(own, "direction"), "direction")
    taken, early = F.col("subjects") == F.col("n_slots"), F.col("year") <= F.col("cutoff")
    counts = docs.where("held = n_slots").groupBy("direction").agg(
        F.count_if(taken & early).alias("before"), F.count_if(taken & (F.col("year") > F.col("cutoff"))).alias("after"), F.count_if(early & F.col("open")).alias("met")
    )
    out = own.join(sizes, "direction", "left").join(counts, "direction", "left").fillna(0, ["n_slots", "before", "after", "met"])
    broke = failed.groupBy("direction").agg(F.min("why").alias("_why")) if failed is not None else out.select("direction").limit(0).withColumn("_why", F.lit(None).cast("string"))
    out = out.join(broke, "direction", "left")
    verdict = (
        F.when(F.col("n_slots") == 0, "NO TERMS").when(F.col("n_slots") < 2, "SINGLE GROUP").when(F.col("_why").isNotNull(), "CHECK FAILED").when(F.col("rarest") < least_papers, "TERM TOO RARE")
        .when(F.col("before") >= settled, "ALREADY DONE").when(F.col("after") >= settled, "PURSUED SINCE").otherwise("STILL OPEN")
    )
    out = out.withColumn("verdict", verdict)
    ruled, open_ = F.col("verdict").isin("ALREADY DONE", "PURSUED SINCE", "STILL OPEN"), F.col("verdict").isin("PURSUED SINCE", "STILL OPEN")
    why = F.when(F.col("verdict") == "SINGLE GROUP", "all terms are in one slot").when(F.col("verdict") == "CHECK FAILED", F.col("_why")).when(F.col("verdict") == "TERM TOO RARE", "the rarest slot caps the conjunction")
    return out.select(
        "direction", "cutoff", "n_slots", F.when(F.col("n_slots") >= 2, F.col("rarest")).alias("rarest"), F.when(ruled, F.col("before")).alias("before"), F.when(ruled, F.col("after")).alias("after"), "verdict",
        F.when(open_, F.col("met")).alias("co_mentions"), F.when(open_, F.when(F.col("met") >= meet, "ADJACENT").otherwise("NEVER MEET")).alias("zone"), why.alias("why"),
    )


def unseen(fresh: DataFrame, baseline: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows of fresh (topic, key, seq) whose key no earlier watch of the topic has, each key once, first seen first."""
    new = fresh.join(baseline.select("topic", "key"), ["topic", "key"], "left_anti")
    return new.groupBy("topic", "key").agg(F.min(seq).alias(seq))


def contradiction(df: DataFrame) -> DataFrame:
    """(verdict, added, revived): the level at which late evidence contradicts a verdict."""
    none = F.col("verdict") == "no_prior_art"
    return df.withColumn("level", F.when(none & (F.col("revived") > 0), "contradicted").when(none & (F.col("added") > 0), "weakened").when(F.col("added") > 0, "note"))


def longest_empty_run(rounds: DataFrame) -> DataFrame:
    """rounds: (topic, seq, n_hits). Longest run of rounds without hits; rounds whose count is unknown neither count nor break it."""
    known = rounds.where("n_hits IS NOT NULL")
    group = F.sum(F.when(F.col("n_hits") > 0, 1).otherwise(0)).over(Window.partitionBy("topic").orderBy("seq"))
    runs = known.withColumn("g", group).groupBy("topic", "g").agg(F.count_if(F.col("n_hits") == 0).alias("run"))
    return runs.groupBy("topic").agg(F.max("run").alias("longest"))


def termination(df: DataFrame, drift_max: float = 0.5, rounds: int = 10) -> DataFrame:
    """(drift, round, open_cited, reason): drift first, then nothing cited open, then the round cap, then the caller's reason."""
    why = F.when(F.col("drift") > drift_max, "drift").when(F.col("open_cited") == 0, "nothing cited is open").when(F.col("round") >= rounds, "round cap").when(F.trim(F.coalesce("reason", F.lit(""))) != "", F.trim("reason"))
    return df.withColumn("why", why).withColumn("terminated", why.isNotNull())
