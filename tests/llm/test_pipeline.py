import random

import pytest

import corpus_pipeline
from quayside.llm import jaccard_join, quality, toxicity

from .conftest import DOCS, LABELS
from .test_joins import brute_components, brute_jaccard, shingle_set
from .test_models import corpus
from .test_tokens import check_packing


@pytest.fixture(scope="module")
def folder(shipped, tmp_path_factory):
    """documents and labels with toxic, loud, copied, repeated and null rows."""
    rows, labels = corpus()
    rng = random.Random(9)
    clean = [r for r in rows if r[0] % 5 and r[0] % 4 != 1]
    copies = []
    for k, r in enumerate(clean[:30]):
        w = r[1].split()
        if k % 2 and len(w) > 100:
            w[rng.randrange(len(w))] = "changed"
        copies.append((1000 + k, " ".join(w), r[2], r[3], r[4]))
    rows += copies + [copies[0], (None, clean[40][1], None, None, None), (5000, None, None, None, None), (5001, "", "en", "s", 0)]
    path = tmp_path_factory.mktemp("corpus")
    shipped.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(path / "documents.parquet"))
    shipped.createDataFrame(labels, LABELS).write.parquet(str(path / "labels.parquet"))
    return str(path), rows, labels


def key(row):
    return tuple(str(x) for x in row)


def test_stages_keep_and_drop_what_their_operators_say(shipped, folder):
    path, rows, labels = folder
    docs = shipped.read.parquet(f"{path}/documents.parquet")
    table = shipped.read.parquet(f"{path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]

    after = corpus_pipeline.toxicity_stage(shipped, docs, path)
    assert after.columns == docs.columns
    bad = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, table)).where("score >= 0.3").collect()} - {None}
    assert {k for k in range(400) if k % 5 == 0} <= bad and len(bad) <= 84
    kept = sorted(key(r) for r in rows if r[0] not in bad)
    assert sorted(key(r) for r in after.collect()) == kept

    second = corpus_pipeline.quality_stage(shipped, after, path)
    bad = {r["doc_id"] for r in quality.score(after, quality.train(after, table)).where("not keep").collect()} - {None}
    assert {k for k in range(400) if k % 5 and k % 4 == 1} <= bad
    assert not {k for k in range(400) if k % 5 and k % 4 != 1} & bad
    assert second.columns == docs.columns
    assert sorted(key(r) for r in second.collect()) == sorted(key(r) for r in after.collect() if r["doc_id"] not in bad)

    third = corpus_pipeline.near_duplicate_stage(shipped, second, path).collect()
    before = second.collect()
    want = brute_jaccard([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])
    heads = sorted(k for k, (_, c) in want.items() if k == c)
    assert sorted(r["doc_id"] for r in third if r["doc_id"] is not None) == heads and len(heads) < len(before) - 15
    assert sum(r["doc_id"] is None for r in third) == 1

    packed = corpus_pipeline.packing_stage(shipped, shipped.createDataFrame(third, DOCS), path).collect()
    assert sorted({r["doc_id"] for r in packed if r["doc_id"] is not None}) == heads
    check_packing(packed, 2048)


def test_near_duplicate_stage_takes_five_words_and_four_fifths(shipped, near_copies):
    base = [f"w{k}" for k in range(100)]
    # two words changed far apart: 86 of 106 five-word shingles are shared (0.811), 89 of 105 four-word ones (0.848)
    near = [w if k not in (30, 70) else f"x{k}" for k, w in enumerate(base)]
    rows = near_copies + [(9001, " ".join(base)), (9002, " ".join(near))]
    rows = [(k, t) for k, t in rows if (t or "").split()]
    sets = {k: shingle_set(t, 5) for k, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    heads = {k for k, c in brute_components(ids, linked).items() if k == c}
    assert heads != {k for k, (_, c) in brute_jaccard(rows).items() if k == c} and 9002 not in heads
    docs = shipped.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(shipped, docs, "").collect()} == heads


def test_rows_that_share_an_id_are_judged_each_by_its_own_text(shipped, folder, messy):
    from pyspark.sql import functions as F

    path, rows, _ = folder
    toxic, clean = rows[0], next(r for r in rows if r[0] is not None and r[0] % 5 and r[0] % 4 != 1)
    other = " ".join(f"plain{k}" for k in range(80))
    some = [clean, (clean[0], toxic[1], "en", "s", 1), (clean[0], other, "en", "s", 2), (clean[0], other, "de", "t", 3), (10**6, other + " more", "en", "s", 4),
            (None, toxic[1], "en", "s", 5), (None, clean[1], "en", "s", 6), (7, None, None, None, None), (7, "", None, None, None)]
    docs = shipped.createDataFrame(some, DOCS).withColumns({c: F.lit(1) for c in ("score", "text_hash", "n", "rep", "id")})
    after = corpus_pipeline.toxicity_stage(shipped, docs.unionByName(shipped.createDataFrame(rows, DOCS), allowMissingColumns=True), path)
    assert after.columns == docs.columns
    kept = sorted((key(r) for r in after.where("rep = 1").collect()))
    assert kept == sorted(key((*r, 1, 1, 1, 1, 1)) for r in some if r[1] != toxic[1])
    last = corpus_pipeline.near_duplicate_stage(shipped, docs, path).collect()
    assert [r["doc_id"] for r in last].count(clean[0]) == 3  # three texts, one of them twice
    assert 10**6 not in {r["doc_id"] for r in last} and [r["doc_id"] for r in last].count(None) == 2 and [r["doc_id"] for r in last].count(7) == 2
    # very long texts, nulls and clashing columns go through every stage that returns documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(shipped, messy, path)
        assert out.columns == messy.columns and out.count() <= messy.count()


def test_run_gives_the_pieces_of_all_stages(shipped, folder):
    path, _, _ = folder
    rows = corpus_pipeline.run(shipped, path).collect()
    assert rows and check_packing(rows, 2048) >= 1
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_tables(shipped, folder, tmp_path):
    path, _, _ = folder
    for name, schema in (("documents", DOCS), ("labels", LABELS)):
        shipped.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(shipped, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert jaccard_join.PERCENT == 85
    assert {"op5_bm25_search", "op8_license_scan"} <= set(__spark_entry__.oracle_sql())


def test_rows_without_copies_do_not_meet_the_join(shipped, monkeypatch):
    """The near-duplicate stage joins, and so shuffles, only rows that may be copies or repetitions."""
    seen, real = [], corpus_pipeline.marked
    monkeypatch.setattr(corpus_pipeline, "marked", lambda *a: seen.append(real(*a)) or seen[-1])
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(300)]
    rows += [(1000 + k, rows[k][1]) for k in range(10)] + [rows[20], rows[20], (None, rows[3][1]), (None, None), (400, "")]
    docs = shipped.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.near_duplicate_stage(shipped, docs, "")
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted([str(k) for k in range(300)] + ["400", "None", "None"])
    assert 13 <= seen[0].where("__near").count() <= 20
