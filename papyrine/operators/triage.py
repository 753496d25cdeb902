"""Triage of ideas: near-duplicates, clusters and survivors, schedules, ratings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from papyrine.functions.measures import blend, expectation, tfidf
from papyrine.session import dropped, reachable, stored


def token_rows(docs: DataFrame, tokens: Column, by: str | None = None) -> DataFrame:
    """(id, token, tf). Dealt `by` id, the tokens of a document go to one task as one array, so that what is done by id afterwards, this count first, needs no shuffle of its rows."""
    rows = docs.select("id", tokens.alias("_ts"))
    rows = rows if by is None else rows.repartition(F.col(by))
    return rows.select("id", F.explode("_ts").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def weights(rows: DataFrame, n: DataFrame) -> DataFrame:
    """(id, token, df, w): TF-IDF of unit length. n: one row with the number of documents. The document frequencies are stored, so that the planner knows whether they are few enough to be sent to the rows; else the rows go to them."""
    df = stored(rows.groupBy("token").agg(F.count("*").alias("df")), "df")
    raw = rows.join(df, "token").join(F.broadcast(n)).withColumn("v", tfidf(F.col("tf"), F.col("df"), F.col("n")))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return raw.withColumn("w", F.when(norm > 0, F.col("v") / norm).otherwise(0.0)).select("id", "token", "df", "w")


#: How much of the score is cosine and how much Jaccard.
COSINE, JACCARD = 0.7, 0.3
SLACK = 1e-3  # scores are rounded to three places


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, class_id) of docs (id, text): the smallest id of each text, by the text's SHA-256 (null: none), so that no text is shuffled."""
    return docs.groupBy(text_key(text).alias("h")).agg(F.min("id").alias("class_id"))


def text_key(text: str) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit("none"))


def ranked_tokens(rows: DataFrame, n: DataFrame) -> DataFrame:
    """(id, n, token, df, w) as arrays: the tokens of each document in one order for all, rarest first, and their TF-IDF of unit length. n: one row with the number of documents."""
    df = stored(rows.groupBy("token").agg(F.count("*").alias("df")), "df")
    own = rows.join(df, "token").select("id", "token", "tf", "df").repartition("id")
    docs = own.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token", "tf"))).alias("x")).join(F.broadcast(n.select("n")))
    docs = docs.withColumn("v", F.transform("x", lambda x: tfidf(x["tf"], x["df"], F.col("n"))))
    docs = docs.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v)))
    unit = F.transform("v", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(0.0))
    return docs.select("id", "n", F.col("x.token").alias("token"), F.col("x.df").alias("df"), unit.alias("w"))


#: Classes of tokens by the share of documents that hold one, up to these, and how many words of 64 bits stand for the tokens of each in a signature.
SHARES, WIDTHS = (0.0004, 0.002, 0.02, 1.0), (8, 8, 8, 4)
#: A text of more tokens than this has a signature of twice the words, and so on up to LEVELS doublings: full bitmaps would tell nothing.
LEVEL_TOKENS, LEVELS = 512, 4
#: Tokens of all documents that a task should meet.
BUCKET_TOKENS = 1 << 22


def candidates(ranked: DataFrame, least: float, cosine: float, jaccard: float) -> DataFrame:
    """The pairs (a, b), a < b, whose score cosine * cos + jaccard * J may reach `least`, as far as bounds at a shared token tell.

    Tokens behind the first one that two documents share are all that their score can come from: their cosine is at most the
    product of the norms of the rests, their Jaccard at most the smaller rest over the union. So a token is looked at only
    where its own document's rest could reach `least` with any partner, which leaves the frequent tokens out, and a meeting only
    counts if both rests together can, and if the signatures allow it. No pair is lost: its first shared token passes all tests.
    Tokens meet by their hash, since two that are taken for one only make a pair to be scored. They are dealt to buckets, and
    a document goes to each of them once, with all its tokens there and its signature.
    """
    least = max(least - SLACK, 0.0) - 1e-9
    total = ranked.agg(F.sum(F.size("token"))).first()[0] or 0  # one number
    buckets = max(int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // BUCKET_TOKENS))
    kind = dict(ranked.dtypes)["id"]
    hashed = ranked.select("id", "n", F.transform("token", lambda t: F.xxhash64(t)).alias("token"), "df", "w")
    head = hashed.mapInArrow(lambda batches: heads(batches, buckets, least, cosine, jaccard), f"bucket int, id {kind}, size int, sums array<float>, bits binary, token array<long>, rest array<int>, norm array<float>")
    head = head.repartition(buckets, "bucket").sortWithinPartitions("bucket", "id")
    return head.mapInArrow(lambda batches: meetings(batches, least, cosine, jaccard), f"a {kind}, b {kind}").where("a < b").distinct()


def levels(size: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(np.log2(np.maximum(size, 1) / LEVEL_TOKENS)), 0, LEVELS).astype(np.int64)


def heads(batches: Iterator[pa.RecordBatch], buckets: int, least: float, cosine: float, jaccard: float) -> Iterator[pa.RecordBatch]:
    """Of documents (id, n, token, df, w): by bucket, the tokens that a partner could be met at first, each with how many there are from it on and the norm of these.
    bits and sums are the signature: by class of tokens that other documents hold too, a bitmap of their hashes, how many there are, their squared weight and the least one."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            docs = batch.slice(at, 1000)
            lists = docs.column("token")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            token, df, w = (docs.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("token", "df", "w"))
            doc, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
            rest = ends[doc] - np.arange(len(doc))
            behind = np.append(np.cumsum((w * w)[::-1])[::-1], 0.0)
            norm = np.sqrt(np.maximum(behind[:-1] - behind[ends][doc], 0.0))
            share = df / docs.column("n").to_numpy()[doc]
            cls = sum((share > s).astype(np.int64) for s in SHARES[:-1])
            shared = df > 1
            slot, q = (doc * len(WIDTHS) + cls)[shared], (w * w)[shared]
            least_q = np.full(len(size) * len(WIDTHS), np.inf)
            np.minimum.at(least_q, slot, q)
            sums = np.stack([np.bincount(slot, minlength=len(least_q)), np.bincount(slot, q, minlength=len(least_q)), np.where(np.isinf(least_q), 0.0, least_q)], axis=1).astype(np.float32)
            sums = sums.reshape(len(size), -1)
            level, bits = levels(size), [b""] * len(size)
            for k in np.unique(level):
                own = np.flatnonzero(level == k)
                line = np.full(len(size), -1)
                line[own] = np.arange(len(own))
                on = np.zeros((len(own), 64 * sum(WIDTHS) << k), bool)
                mine = shared & (line[doc] >= 0)
                width, start = (64 * np.array(x) << k for x in (WIDTHS, np.cumsum([0, *WIDTHS[:-1]])))
                c = cls[mine]
                on[line[doc[mine]], start[c] + (token[mine].view(np.uint64) % width[c].astype(np.uint64)).astype(np.int64)] = True
                for i, one in zip(own, np.packbits(on, axis=1, bitorder="little"), strict=True):
                    bits[i] = one.tobytes()
            head = np.flatnonzero(shared & (cosine * norm * (1 + 1e-6) + jaccard * rest / size[doc] >= least))
            bucket = ((token[head].view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((bucket, doc[head]))
            head, bucket = head[order], bucket[order]
            if not len(head):
                continue
            first = np.flatnonzero(np.append(True, (doc[head][1:] != doc[head][:-1]) | (bucket[1:] != bucket[:-1])))
            cuts, of = pa.array(np.append(first, len(head)).astype(np.int32)), doc[head[first]]
            many = lambda x, kind: pa.ListArray.from_arrays(cuts, pa.array(x, kind))
            twelve = pa.ListArray.from_arrays(pa.array((np.arange(len(of) + 1) * sums.shape[1]).astype(np.int32)), pa.array(sums[of].ravel()))
            cols = {"bucket": pa.array(bucket[first]), "id": docs.column("id").take(pa.array(of)), "size": pa.array(size[of].astype(np.int32)), "sums": twelve, "bits": pa.array(bits, pa.binary()).take(pa.array(of))}
            cols |= {"token": many(token[head], pa.int64()), "rest": many(rest[head], pa.int32()), "norm": many((norm[head] * (1 + 1e-6)).astype(np.float32), pa.float32())}
            yield pa.RecordBatch.from_pydict(cols)


def meetings(batches: Iterator[pa.RecordBatch], least: float, cosine: float, jaccard: float) -> Iterator[pa.RecordBatch]:
    """Rows of `heads` in the order of bucket and id, as (a, b) of those of one bucket that may reach `least`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column("bucket")[0] != batch.column("bucket")[start]:
                yield from met_rows(pa.Table.from_batches(held), least, cosine, jaccard)
                held = []
            if end > start:
                held.append(batch.slice(start, end - start))
    if held:
        yield from met_rows(pa.Table.from_batches(held), least, cosine, jaccard)


#: Bytes of signatures that are compared at once, and pairs that are held before they are.
COMPARED, MET_PAIRS = 1 << 24, 1 << 20


def met_rows(rows: pa.Table, least: float, cosine: float, jaccard: float) -> Iterator[pa.RecordBatch]:
    """The documents of a bucket that meet at a token and may reach `least` by their rests there, then by their signatures: a bit that only
    one has stands for one token at least that the other lacks, so the shared ones are fewer and weigh less. Of unequal signatures the longer is folded."""
    flat = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in rows[c].chunks])
    lengths = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in rows["token"].chunks])
    doc, token = np.repeat(np.arange(rows.num_rows), lengths), flat("token")
    order = np.lexsort((doc, token))
    doc, token, rest, norm = doc[order], token[order], flat("rest")[order], flat("norm")[order].astype(np.float64)
    size, ids = rows["size"].to_numpy().astype(np.int64), pa.concat_arrays(rows["id"].chunks)
    number, weight, low = (flat("sums").astype(np.float64).reshape(rows.num_rows, len(WIDTHS), 3)[:, :, k] for k in range(3))
    level, raw, place, folded = levels(size), rows["bits"].to_pylist(), [], []
    for k in range(LEVELS, -1, -1):  # each signature at its own level and, folded, at those below
        own = np.flatnonzero(level == k)
        line = np.full(rows.num_rows, -1)
        bits = np.frombuffer(b"".join(raw[i] for i in own), np.uint64).reshape(len(own), sum(WIDTHS) << k)
        if folded:
            above, before = folded[0], np.flatnonzero(place[0] >= 0)
            before = before[np.argsort(place[0][before])]
            halves = [x.reshape(len(x), 2, x.shape[1] // 2) for x in np.split(above, np.cumsum(WIDTHS)[:-1] << (k + 1), axis=1)]
            bits, own = np.concatenate([bits, np.concatenate([x[:, 0] | x[:, 1] for x in halves], axis=1)]), np.append(own, before)
        line[own] = np.arange(len(own))
        place.insert(0, line)
        folded.insert(0, bits)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep, both = np.zeros(len(a), bool), np.minimum(level[a], level[b])
        for k in np.unique(both):
            those, starts = np.flatnonzero(both == k), np.cumsum([0, *WIDTHS[:-1]]) << k
            step = max(COMPARED // (8 * sum(WIDTHS) << k), 1)
            for at in range(0, len(those), step):
                part = those[at : at + step]
                i, j = a[part], b[part]
                x, y = folded[k][place[k][i]], folded[k][place[k][j]]
                alone = [np.add.reduceat(np.bitwise_count(one).astype(np.int32), starts, axis=1) for one in (x & ~y, y & ~x)]
                left = [np.maximum(weight[d] - u * low[d] * (1 - 1e-6), 0.0) for d, u in ((i, alone[0]), (j, alone[1]))]
                cos = np.sqrt(left[0] * left[1]).sum(axis=1) * (1 + 1e-6)
                shared = np.minimum(number[i] - alone[0], number[j] - alone[1]).sum(axis=1)
                keep[part] = cosine * cos + jaccard * shared / (size[i] + size[j] - shared) >= least
        return keep

    def told(keys: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.divmod(np.unique(np.concatenate(keys)), rows.num_rows)
        keep = near(a, b)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(a[keep])), ids.take(pa.array(b[keep]))], ["a", "b"])

    x, step, keys = np.arange(len(token)), 0, []
    while True:  # every row with the next one of its token, then with the one after it
        step += 1
        x = x[: np.searchsorted(x, len(token) - step)]
        x = x[token[x] == token[x + step]]
        if not len(x):
            break
        i, j, both = doc[x], doc[x + step], np.minimum(rest[x], rest[x + step])
        may = cosine * norm[x] * norm[x + step] + jaccard * both / (size[i] + size[j] - both) >= least
        keys.append(i[may] * rows.num_rows + j[may])
        if sum(map(len, keys)) >= MET_PAIRS:
            yield told(keys)
            keys = []
    if keys:
        yield told(keys)


#: Documents of a cell: two cells are scored by one task at once.
CELL = 256


def placed(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the cells x <= y of their documents. A document's cell is the least one among itself and its partners, as near copies share theirs; a large one is dealt to cells of about `CELL`."""
    pairs = stored(pairs, "met")
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("o")), F.struct(F.col("b").alias("id"), F.col("a").alias("o"))))).select("col.*")
    hubs = each.groupBy("id").agg(F.min("o").alias("o")).select("id", F.least("id", "o").alias("hub"))
    many = hubs.groupBy("hub").agg(F.ceil(F.count("*") / CELL).alias("k"))
    cells = stored(hubs.join(many, "hub").select("id", F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.col("k"))).alias("cell")), "cells")
    met = pairs.join(cells.toDF("a", "ca"), "a").join(cells.toDF("b", "cb"), "b")
    return stored(met.select("a", "b", F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")), "placed")


def scored(pairs: pa.Table, docs: pa.Table) -> pa.Table:
    """pairs (a, b) with their dot products, shared tokens and all tokens; docs: (id, size, token, w), every document of the pairs."""
    line = {k: i for i, k in enumerate(docs["id"].to_pylist())}
    pairs = pairs.select(["a", "b"]).sort_by([("a", "ascending"), ("b", "ascending")])
    a, b = (np.array([line[k] for k in pairs[c].to_pylist()], np.int64) for c in "ab")
    code = pa.chunked_array([x.flatten() for x in docs["token"].chunks]).combine_chunks().dictionary_encode()
    code, vocabulary = code.indices.to_numpy(), len(code.dictionary)
    w = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in docs["w"].chunks])
    ends = np.cumsum(np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in docs["token"].chunks]))
    starts, size = np.append(0, ends[:-1]), docs["size"].to_numpy()
    weight, held = np.zeros(vocabulary), np.zeros(vocabulary, np.int64)
    dots, shared = np.zeros(len(a)), np.zeros(len(a), np.int64)
    cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        own = slice(starts[a[low]], ends[a[low]])
        weight[code[own]], held[code[own]] = w[own], 1
        other = b[low:high]
        at = np.concatenate([np.arange(starts[k], ends[k]) for k in other])
        first = np.append(0, np.cumsum(ends[other] - starts[other])[:-1])
        dots[low:high] = np.add.reduceat(weight[code[at]] * w[at], first)
        shared[low:high] = np.add.reduceat(held[code[at]], first)
        weight[code[own]], held[code[own]] = 0.0, 0
    return pa.table({"a": pairs["a"], "b": pairs["b"], "dot": dots, "shared": shared, "all": size[a] + size[b] - shared})


def ranked_texts(docs: DataFrame, tokens: Column) -> DataFrame:
    """`ranked_tokens` of docs (id, ...), stored; the rows they are made of are deleted."""
    rows = stored(token_rows(docs, tokens), "tokens")
    ranked = stored(ranked_tokens(rows, docs.agg(F.count("*").alias("n"))), "ranked")
    dropped(rows)
    return ranked


def similar_pairs(rows: DataFrame, n: DataFrame, least: float = 0.0, cosine: float = COSINE, jaccard: float = JACCARD) -> DataFrame:
    """`ranked_pairs` of rows (id, token, tf); n: one row with the number of documents."""
    return ranked_pairs(stored(ranked_tokens(rows, n), "ranked"), least, cosine, jaccard)


def ranked_pairs(ranked: DataFrame, least: float = 0.0, cosine: float = COSINE, jaccard: float = JACCARD) -> DataFrame:
    """(a, b, cosine, jaccard, score) of the pairs that share a token and may reach `least` by the bounds of `candidates`; scores are exact. ranked: stored `ranked_tokens`.

    A vector goes to a pair of cells once, however many of its pairs are scored there, and only with tokens that other documents hold too.
    """
    pairs = placed(candidates(ranked, least, cosine, jaccard))
    wanted = pairs.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.explode(F.array("a", "b")).alias("id")).distinct()
    common = F.filter(F.arrays_zip("token", "df", "w"), lambda x: x["df"] > 1)
    vectors = ranked.select("id", F.size("token").cast("long").alias("size"), common.alias("v")).select("id", "size", F.col("v.token").alias("token"), F.col("v.w").alias("w"))
    sent = wanted.join(vectors, "id").select("cx", "cy", "id", "size", "token", "w")
    kind = dict(ranked.dtypes)["id"]
    out = pairs.select("x", "y", "a", "b").groupBy("x", "y").cogroup(sent.groupBy("cx", "cy")).applyInArrow(scored, f"a {kind}, b {kind}, dot double, shared long, all long")
    out = out.withColumn("cosine", F.round("dot", 6)).withColumn("jaccard", F.round(F.col("shared") / F.col("all"), 6))
    return out.withColumn("score", blend(F.col("cosine"), F.col("jaccard"))).select("a", "b", "cosine", "jaccard", "score")


def near_duplicates(docs: DataFrame, tokens: Column, threshold: float, top: int) -> DataFrame:
    """docs: (id, ...), one row a text (see classes). Pairs at the threshold or among the top with a positive score, flagged.

    The top are sought among the pairs at the threshold; only if these are too few, the bound falls by halves until there are enough or all pairs that share a token are scored.
    """
    ranked, least = ranked_texts(docs, tokens), threshold
    while True:
        pairs = stored(ranked_pairs(ranked, least).where(F.col("score") >= least if least else F.col("score") > 0), "pairs")
        if not least or pairs.limit(top).count() >= top:
            break
        least = least / 2 if least > 0.05 else 0.0
    best = pairs.where("score > 0").orderBy(F.col("score").desc(), "a", "b").limit(top).select("a", "b", F.lit(True).alias("is_top"))
    met = pairs.join(best, ["a", "b"], "left").where((F.col("score") >= threshold) | F.col("is_top"))
    return met.withColumn("above", F.col("score") >= threshold).drop("is_top")


def clusters(edges: DataFrame, name: str = "clusters") -> DataFrame:
    """(node, root) of undirected edges (a, b): star contraction until nothing changes, each round stored in the shared folder."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        out = both.join(least, both.a == least.u).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = out.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        back = out.join(least, out.a == least.u).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, now = now, stored(back.where("a <> b").distinct(), name)
        dropped(last)  # the round before is not read again
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state


def survivors(members: DataFrame) -> DataFrame:
    """members: (root, id, code, pinned, completeness, created). Of each cluster: a pinned one, else the most complete, earliest (unknown last), by code (none last), by id."""
    order = [F.col("pinned").desc(), F.col("completeness").desc(), F.col("created").asc_nulls_last(), F.coalesce("code", F.lit("~")), F.col("id")]
    rank = F.row_number().over(Window.partitionBy("root").orderBy(*order))
    return members.withColumn("survives", rank == 1).withColumn("merged_into", F.first("id").over(Window.partitionBy("root").orderBy(*order)))


#: Players of a tournament whose pairs are numbered in one task, and pairs a task should have.
FIELD, TASK_PAIRS = 128, 1 << 20


def schedule(players: DataFrame, batch: int, order: Column) -> DataFrame:
    """players: (tournament, id, is_anchor). All pairs of a tournament but of two anchors, once each way; the second way starts on a batch of its own. Pairs are made on purpose: a tournament plays them all, so their number is the square of its field.

    The first players of the pairs are cut into fields of `FIELD`, in order, and each field meets the tournament in a task of its own. A pair's place is its place in its
    field, among the pairs of equal `order`, behind those that come before: a table by field and order, of a few values, counted first. No task sorts a tournament, and no pair is shuffled.
    """
    ranked = stored(players.toDF("tournament", "id", "anchor").withColumn("field", F.floor((F.rank().over(Window.partitionBy("tournament").orderBy("id")) - 1) / FIELD)), "players")
    sizes = ranked.groupBy("tournament").agg(F.count("*").alias("n"))
    most = sizes.agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0  # one number
    tasks = max(int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(most // TASK_PAIRS))
    fields = ranked.groupBy("tournament", "field").agg(F.min("id").alias("least"))
    a = ranked.select("tournament", "field", F.col("id").alias("l"), F.col("anchor").alias("l_anchor")).repartition(tasks, "tournament", "field")
    b = ranked.select("tournament", F.col("id").alias("r"), F.col("anchor").alias("r_anchor")).join(fields, "tournament").where("r >= least").select("tournament", "field", "r", "r_anchor").repartition(tasks, "tournament", "field")
    pairs = a.join(b.hint("shuffle_hash"), ["tournament", "field"]).where((F.col("l") < F.col("r")) & ~(F.col("l_anchor") & F.col("r_anchor"))).select("tournament", "field", "l", "r", order.alias("ord"))
    counts = stored(pairs.groupBy("tournament", "field", "ord").agg(F.count("*").alias("n")), "places")
    own = Window.partitionBy("tournament")
    ahead = stored(counts.withColumn("ahead", F.sum("n").over(own.orderBy("ord", "field")) - F.col("n")).withColumn("shift", F.ceil(F.sum("n").over(own) / batch)).drop("n"), "ahead")  # the planner knows its size
    place = F.row_number().over(Window.partitionBy("tournament", "field", "ord").orderBy("l", "r"))
    met = pairs.withColumn("place", place).join(ahead.withColumnRenamed("ord", "_ord"), (F.col("ord").eqNullSafe(F.col("_ord"))) & (pairs.tournament == ahead.tournament) & (pairs.field == ahead.field))
    rows = met.select(pairs.tournament, "l", "r", F.floor((F.col("ahead") + F.col("place") - 1) / batch).alias("batch"), "shift")
    both = F.array(F.struct("l", "r", "batch"), F.struct(F.col("r").alias("l"), F.col("l").alias("r"), (F.col("batch") + F.col("shift")).alias("batch")))
    return rows.select("tournament", F.inline(both))


def ratings(matches: DataFrame, k: float = 32.0, start: float = 1000.0) -> DataFrame:
    """matches: (tournament, seq, l, r, winner). Rating is a fold in order, so a tournament is one array (bounded by its schedule); tournaments go in parallel. winner: l, r or tie."""
    games = matches.groupBy("tournament").agg(F.array_sort(F.collect_list(F.struct("seq", "l", "r", "winner"))).alias("games"))
    zero = F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<double>"))
    held = lambda m, p: F.coalesce(F.element_at(m, p), F.lit(start))

    def play(m: Column, g: Column) -> Column:
        own, other = held(m, g["l"]), held(m, g["r"])
        won = F.when(g["winner"] == "l", 1.0).when(g["winner"] == "r", 0.0).otherwise(0.5)
        gain = k * (won - expectation(own, other))
        rest = F.map_filter(m, lambda p, _: (p != g["l"]) & (p != g["r"]))
        return F.map_concat(rest, F.map_from_arrays(F.array(g["l"], g["r"]), F.array(own + gain, other - gain)))

    final = games.select("tournament", F.explode(F.aggregate("games", zero, play)).alias("id", "elo"))
    final = final.withColumn("elo", F.round("elo", 1))
    return final.withColumn("rank", F.row_number().over(Window.partitionBy("tournament").orderBy(F.col("elo").desc(), "id")))


def flips(matches: DataFrame) -> DataFrame:
    """(tournament, judged_twice, flipped, rate): pairs judged both ways and verdicts that changed with the order."""
    winner = F.when(F.col("winner") == "tie", F.lit(None)).when(F.col("winner") == "l", F.col("l")).otherwise(F.col("r"))
    pair = Window.partitionBy("tournament", F.least("l", "r"), F.greatest("l", "r")).orderBy("seq", "l", "r", "winner")
    seen = matches.withColumn("w", F.coalesce(winner, F.lit(-1))).withColumn("before", F.lag("w").over(pair))
    again = seen.where(F.col("before").isNotNull())
    return again.groupBy("tournament").agg(F.count("*").alias("judged_twice"), F.count_if(F.col("before") != F.col("w")).alias("flipped")).withColumn("rate", F.round(F.col("flipped") / F.col("judged_twice"), 3))


def bands(rated: DataFrame, grade: Column) -> DataFrame:
    return rated.groupBy(grade.alias("grade")).agg(F.round(F.avg("elo"), 1).alias("mean_elo"), F.count("*").alias("n"))
