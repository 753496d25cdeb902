"""Operator 6: vantage-point links against all pairs."""

import numpy as np
import xxhash

from papyrine.llm import simhash_vp as vp


def truth(prints, radius):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius):
            a, b = find(i), find(int(j) + i + 1)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)
    prints = centres[rng.integers(0, len(centres), n)]
    for _ in range(3):
        prints ^= np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(prints)


def test_shards_meet_every_pair():
    prints = clustered(3000)
    nodes = vp.grow(prints, 6, 2)
    own, leaf = vp.shards(prints, nodes, 2)
    assert len(set(leaf.tolist())) > 8
    held = [set() for _ in prints]
    for i, x in zip(own.tolist(), leaf.tolist()):
        held[i].add(x)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2):
            assert held[i] & held[int(j)]


def test_copies_a_print_stay_few():
    """2 ** 24 fingerprints are dealt by so flat a tree that each goes to fewer than three shards on the average."""
    depth = vp.depth_for(1 << 24)
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 1 << 20, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 1 << 20, dtype=np.uint64)
    nodes = vp.grow(prints[: vp.PER_LEAF << depth], depth, 2)
    own, leaf = vp.shards(prints, nodes, 2)
    assert len(set(leaf.tolist())) > 16 and len(own) < 3 * len(prints)
    assert vp.depth_for(0) == 0 and vp.depth_for(4097) == 1 and vp.depth_for(1 << 30) == 12


def test_dense_shard_looks_up(monkeypatch):
    prints = clustered(2500, 3)
    for dense in (10, 1 << 20):
        monkeypatch.setattr(vp, "DENSE", dense)
        monkeypatch.setattr(vp, "LEAF", 100)
        a, b = vp.shard_links(prints, 2)
        root = dict(zip(a.tolist(), b.tolist()))
        assert [root.get(int(p), int(p)) for p in prints] == [int(prints[k]) for k in truth(prints, 2)]


def test_components(spark):
    from papyrine.llm.common import components

    edges = [(i + 1, i) for i in range(40)] + [(100, 50), (100, 60), (60, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50, 100: 50}


def test_documents(docs, none, rows):
    got = vp.near_duplicates(docs).collect()
    assert len(got) == len(rows) and vp.near_duplicates(none).count() == 0

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(r[1]) for r in rows]
    assert sorted(r.fingerprint for r in got) == sorted(f"{p:016x}" for p in prints)
    roots = truth(np.array(prints, np.uint64), 2)
    least = {}
    for r, k in zip(rows, roots):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted(str((r[0], least.get(k))) for r, k in zip(rows, roots))
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == want


def test_one_per_group(docs, rows):
    kept = vp.one_per_group(docs).collect()
    assert vp.one_per_group(docs).columns == docs.columns
    hot = [r.doc_id for r in kept if r.source == "hot"]
    assert len(hot) == 1 and hot[0] == min(r[0] for r in rows if r[3] == "hot" and r[0] is not None)
    clean = {r[0] for r in rows if r[1] and r[3] != "hot" and len(r[1].split()) > 20 and r[0] is not None}
    assert clean <= {r.doc_id for r in kept}
    assert len(kept) == len({(r.doc_id, r.text) for r in kept})


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def decided(spark, texts, least=0.8):
    """(near, grouped) for each pair of texts 2 i and 2 i + 1: whether their exact similarity is `least` or more, and whether they are in one group."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    root = {r.doc_id: r.root for r in vp.groups(frame).collect()}
    sets = [shingles(t) for t in texts]
    near = [len(a & b) >= least * len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    return near, [root[i] == root[i + 1] for i in range(0, len(texts), 2)]


def test_passage_fills_buckets(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage, texts = word(244), []
    for _ in range(250):
        own = word(80)
        texts += [" ".join(passage + own), " ".join(passage + own[:46] + word(34))]
    texts += [" ".join(passage + word(80)) for _ in range(400)]
    near, grouped = decided(spark, texts)
    assert sum(near) == 250 and sum(g for n, g in zip(near, grouped) if n) == 250


def test_fingerprint_buckets_hold_every_pair(spark):
    prints = clustered(600, 8)
    rows = [(i, 9, int(p)) for i, p in enumerate(prints.view(np.int64))] + [(len(prints), 9, int(prints.view(np.int64)[0]))]
    held = {}
    for r in vp.fingerprint_buckets(spark.createDataFrame(rows, "body long, n long, fp long"), 2).collect():
        held.setdefault(r.body, set()).add(r.key)
    fps = np.array([r[2] for r in rows]).view(np.uint64)
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2)]
    assert len(pairs) > len(fps) and all(held[i] & held[j] for i, j in pairs)


def test_similarity_is_exact(spark):
    rng = np.random.default_rng(9)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    texts = []
    for n in (10, 13) * 20:  # the last word differs: 5 of 7 shingles, 8 of 10
        own = word(n)
        texts += [" ".join(own), " ".join(own[:-1] + word(1))]
    near, grouped = decided(spark, texts)
    assert sum(near) == 20 and grouped == near


def test_groups_on_documents(spark):
    """Against all pairs: no pair at 0.8 is lost, no document joins a group without such a pair."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    root = {r.doc_id: r.root for r in vp.groups(frame).collect()}
    sets, by_shingle, pairs = [shingles(t.lower()) if t.split() else set() for t in texts], {}, set()
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        # The rarest fifth of the shingles, and one more, holds a shared one.
        for x in sorted(s, key=lambda x: (len(by_shingle[x]), x))[: len(s) // 5 + 1]:
            pairs.update((min(i, j), max(i, j)) for j in by_shingle[x] if j != i)
    near = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 50 and sum(root[i] == root[j] for i, j in near) >= 0.99 * len(near)
    partnered = {x for p in near for x in p}
    sizes = {}
    for r in root.values():
        sizes[r] = sizes.get(r, 0) + 1
    assert not [i for i in range(len(texts)) if sizes[root[i]] > 1 and i not in partnered and sets[i]]


def test_clashing_names_and_wordless(spark):
    rows = [(1, None, 5, 6, 7, 8), (2, "", 5, 6, 7, 8), (3, " \n\t", 5, 6, 7, 8), (4, "a b c", 5, 6, 7, 8), (4, "a b c", 5, 6, 7, 8), (None, "a b c", 5, 6, 7, 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _d long, _b long, _row long, body long")
    got = vp.one_per_group(frame)
    assert got.columns == frame.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [frame.where("doc_id = 1").first(), frame.where("doc_id is null").first()]))
