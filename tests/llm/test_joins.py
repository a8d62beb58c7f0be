import random
import re

import numpy as np
import pytest

from quayside.llm import jaccard_join, near_vectors
from quayside.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, n=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(nodes, linked):
    parent = {k: k for k in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in nodes}


def brute_jaccard(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    parts = brute_components(ids, linked)
    return {k: (len(sets[k]), parts[k]) for k in ids}


def run_jaccard(df):
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()]


def test_jaccard_components_equal_brute_force(shipped, near_copies):
    got = {k: (n, c) for k, n, c in run_jaccard(shipped.createDataFrame(near_copies, "doc_id long, text string"))}
    want = brute_jaccard(near_copies)
    assert len({c for _, c in want.values()}) < len(want) - 20  # the fixture does link
    assert got == want


def test_jaccard_with_split_buckets_and_weak_signatures(shipped, near_copies, monkeypatch):
    """Tiny blocks deal every shingle out; one counter makes the order arbitrary."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "shingle_counters", lambda docs, n: np.zeros(jaccard_join.COUNTERS, np.uint32))
    got = {k: (n, c) for k, n, c in run_jaccard(shipped.createDataFrame(near_copies, "doc_id long, text string"))}
    assert got == brute_jaccard(near_copies)


def test_jaccard_on_messy_documents(messy):
    got = sorted(run_jaccard(messy), key=str)
    # each row has its own set, linked by its own words; a null id has no component
    assert (None, 2, None) in got and len(got) == 13
    assert sorted(c for k, _, c in got if k is not None) == sorted(k for k, _, _ in got if k is not None)
    assert {k: n for k, n, _ in got if k in (1, 2, 3)} == {1: 0, 2: 0, 3: 0}
    assert (7, 2, 7) in got and (6, 1, 6) in got
    assert run_jaccard(messy.limit(0)) == []


def test_texts_that_share_an_id_are_linked_each_by_its_own_words(shipped):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, a), (5, b), (9, b.replace("b59", "x")), (2, "c " + a), (5, b), (7, None), (7, "")]
    got = jaccard_join.jaccard_classes(shipped.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(2, 2), (5, 2), (5, 5), (5, 5), (7, 7), (7, 7), (9, 5)]
    kept = sorted((r["doc_id"], r["component_id"]) for r in got.where("kept").collect())
    assert kept == [(2, 2), (5, 5), (5, 5), (7, 7), (7, 7)]


def test_a_group_of_many_members_is_paired_in_tiles():
    """Members of one group meet in bounded portions, also where the group is dealt to two sides."""
    import tracemalloc

    import pyarrow as pa

    m, rng = 3000, np.random.default_rng(1)
    sig = rng.integers(0, 256, (m, 64), dtype=np.uint8)
    for side in (np.zeros(m, np.int32), np.sort(np.arange(m) % 2).astype(np.int32)):
        same = lambda v, t=pa.int64(): pa.array(np.full(m, v), t)
        table = pa.table({"token": same(1), "x": same(0, pa.int32()), "y": same(int(side.max()), pa.int32()), "side": pa.array(side), "pos": same(0),
                          "n": same(100), "gid": same(0), "rep": pa.array(np.arange(m)), "label": pa.array(np.arange(m)),
                          "sig": pa.array([s.tobytes() for s in sig], pa.binary())})
        finder = jaccard_join.PairFinder(85, False)
        tracemalloc.start()
        finder.rows(table)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300 << 20


def test_groups_dealt_to_sides_keep_every_link(shipped, monkeypatch):
    """One prefix, one size, many different sets: a group that is split over many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):  # all share their rarest shingles, each changes one word near the end
        w = list(base)
        w[60 + k] = f"y{k % 7}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(base[:100] + [f"z{k}{i}" for i in range(60)])) for k in range(10)]
    got = {k: (n, c) for k, n, c in run_jaccard(shipped.createDataFrame(rows, "doc_id long, text string"))}
    assert got == brute_jaccard(rows)


def test_pair_filter_keeps_every_link_of_random_sets():
    """The finder's survivors, forest or not, connect what brute force links."""
    import pyarrow as pa

    rng = random.Random(5)
    base = list(range(1000, 1060))
    sets = {}
    for k in range(60):
        drop = set(rng.sample(base, rng.choice([0, 2, 4, 8, 20])))
        sets[k] = sorted([x for x in base if x not in drop] + [10_000 * (k + 1) + i for i in range(rng.choice([0, 1, 3]))])
    rows = []
    for k, s in sets.items():
        n = len(s)
        ordered = sorted(s, key=lambda x: (x < 5000, x))
        bits = np.zeros(512, np.uint8)
        for x in s:
            bits[(x * 2654435761 >> 7) % 512] ^= 1
        for pos, token in enumerate(ordered[:n - (85 * n + 99) // 100 + 1]):
            rows.append({"token": token, "x": 0, "y": 0, "side": 0, "pos": pos, "n": n, "gid": k, "rep": k, "label": k, "sig": np.packbits(bits).tobytes()})
    rows.sort(key=lambda r: (r["token"], r["gid"]))
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=7)
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))]
    every = {tuple(e) for out in jaccard_join.PairFinder(85, False).run(iter(batches)) for e in zip(*out.to_pydict().values())}
    assert set(linked) <= every
    forest = [tuple(e) for out in jaccard_join.PairFinder(85, True).run(iter(batches)) for e in zip(*out.to_pydict().values())]
    assert len(forest) < len(sets) and brute_components(sets, forest) == brute_components(sets, every)


def test_components_of_chains_stars_and_rings(shipped):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(k, 200 + (k - 199) % 10) for k in range(200, 210)] + [(300, 300)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(shipped.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = brute_components({x for e in edges for x in e}, edges)
    del want[300]  # a loop is no edge
    assert got == want
    assert components(shipped.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, cosine=0.95):
    good = [(k, np.array(v, float)) for k, v in rows]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= cosine
    links = near.sum(1) - 1
    parts = brute_components(range(len(good)), [(i, j) for i in range(len(good)) for j in range(i) if near[i, j]])
    low = {}
    for i, p in parts.items():
        low[p] = min(low.get(p, good[i][0]), good[i][0])
    return {good[i][0]: (int(links[i]), low[parts[i]]) for i in range(len(good))}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for centre in rng.normal(size=(40, 24)):
        for _ in range(int(rng.choice([1, 2, 8]))):
            rows.append(centre + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.15, 0.3]))
    return [(int(k), v.astype(np.float32).tolist()) for k, v in enumerate(rows)]


def test_vector_links_recall_and_precision(shipped, vectors, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)  # lists are dealt out as pairs of blocks
    monkeypatch.setattr(near_vectors, "DIRECT", 1)  # pivots even for few vectors
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(shipped.createDataFrame(vectors, "vec_id long, embedding array<float>")).collect()}
    want = brute_vectors(vectors)
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values()) > 0


def test_vectors_that_link_with_nothing(shipped, vectors):
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [nan] + [1.0] * 23), (1004, [inf] + [1.0] * 23), (1005, [None] + [1.0] * 23),
           (1006, [1.0] * 7), (1007, [1.0] * 7), (None, vectors[0][1])]
    copies = [(2000, vectors[0][1]), (2000, vectors[0][1]), (2001, [2 * x for x in vectors[0][1]])]
    df = shipped.createDataFrame(vectors + odd + copies, "vec_id long, embedding array<float>").selectExpr("*", "1 as weight", "2 as pivot", "3 as id", "4 as links")
    rows = near_vectors.near_duplicates(df).collect()
    assert len(rows) == len(vectors) + 12
    for r in rows:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        elif r["vec_id"] in (1006, 1007):  # a length of their own
            assert (r["n_links"], r["component_id"], r["kept"]) == (1, 1006, r["vec_id"] == 1006)
        elif 1000 <= r["vec_id"] < 2000:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
        elif r["vec_id"] >= 2000:
            assert r["n_links"] >= 3 and r["component_id"] == 0 and not r["kept"]
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("direct", [256, 1])
def test_vectors_of_two_lengths_link_each_among_their_own(shipped, vectors, monkeypatch, direct):
    monkeypatch.setattr(near_vectors, "DIRECT", direct)
    rng = np.random.default_rng(9)
    short = [(5000 + k, v.tolist()) for k, v in enumerate(np.repeat(rng.normal(size=(30, 6)), 3, axis=0) + rng.normal(size=(90, 6)) * 0.1)]
    single = [(9000, [1.0, 2.0, 3.0])]
    df = shipped.createDataFrame(vectors + short + single, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_duplicates(df).collect()}
    assert got[9000] == (0, 9000)
    for part in (vectors, short):
        want = brute_vectors(part)
        found, every = sum(got[k][0] for k in want), sum(n for n, _ in want.values())
        assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.9 * every > 0
        if direct > len(part):  # all pairs were compared
            assert {k: got[k] for k in want} == want


def test_recall_of_the_index_on_a_larger_table(shipped):
    """Enough vectors for the pivots that production takes: recall of links against brute force."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(500, 32))
    rows = [(k, (centres[k % 500] + rng.normal(size=32) * 0.15).tolist()) for k in range(2500)]
    got = near_vectors.near_duplicates(shipped.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = int(((unit @ unit.T) >= 0.95).sum()) - len(rows)
    assert want > 1000 and 0.9 * want <= sum(r["n_links"] for r in got) <= want


def test_marked_rows_hold_every_key_and_few_others(shipped):
    from quayside.llm.lookup import marked

    rows = shipped.range(20_000).selectExpr("if(id % 100 = 0, null, id) as a", "cast(id % 7 as string) as b", "id")
    keys = rows.where("id % 50 = 3").select("a", "b")
    got = marked(rows, keys, ["a", "b"], "near")
    assert got.columns == ["a", "b", "id", "near"] and got.count() == 20_000
    near = {r["id"] for r in got.where("near").collect()}
    assert {k for k in range(20_000) if k % 50 == 3} <= near and len(near) < 420
    assert got.where("near is null").isEmpty()
    assert marked(rows, keys.limit(0), ["a", "b"], "near").where("near").isEmpty()


def test_texts_are_not_shuffled_to_find_the_ones_to_verify(shipped, near_copies, monkeypatch):
    """Also where no join is small enough to be broadcast, only wanted texts meet the wanted keys; shared shingles are found once."""
    names, plans = [], []
    real_stored, real_join = jaccard_join.stored, jaccard_join.marked
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: names.append(name) or real_stored(df, name))
    monkeypatch.setattr(jaccard_join, "marked", lambda rows, keys, on, name: plans.append(rows.columns) or real_join(rows, keys, on, name))
    before = shipped.conf.get("spark.sql.autoBroadcastJoinThreshold")
    shipped.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shipped.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        got = {k: (n, c) for k, n, c in run_jaccard(shipped.createDataFrame(near_copies, "doc_id long, text string"))}
    finally:
        shipped.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        shipped.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
    assert got == brute_jaccard(near_copies)
    assert names.count("shared") == 1 and plans and all("text" in columns for columns in plans)
