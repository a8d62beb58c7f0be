import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quayside.llm import bm25, license_scan
from quayside.llm import sentencepiece_lattice as lattice
from quayside.llm.language_id import Pieces

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def brute_bm25(docs, queries, top):
    bags = [(k, Counter(words(t))) for k, t in docs]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, text in queries:
        scores = []
        for k, b in bags:
            s = sum(m * math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * b[w] * 2.2 / (b[w] + 1.2 * (.25 + .75 * sum(b.values()) / mean))
                    for w, m in Counter(words(text)).items() if w in b)
            if k is not None and round(s, 6) > 0:
                scores.append((-round(s, 6), k))
        out += [(q, r, k, -s) for r, (s, k) in enumerate(sorted(scores)[:top], 1)]
    return out


def test_search_equals_brute_force(shipped, near_copies, monkeypatch):
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 4)
    docs = near_copies + [(None, near_copies[0][1])]
    queries = [(k, near_copies[k * 5][1]) for k in range(9)] + [(50, ""), (51, None), (52, "nosuchword"), (53, "one")]
    df = shipped.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 as score", "2 as query_id")
    got = bm25.search(df, shipped.createDataFrame(queries, "query_id long, text string"), top=7).collect()
    want = brute_bm25(docs, queries, 7)
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got) == sorted(w[:3] for w in want)
    assert np.allclose(sorted(r["score"] for r in got), sorted(w[3] for w in want))
    assert bm25.search(df.limit(0), shipped.createDataFrame(queries, "query_id long, text string")).count() == 0
    assert bm25.search(df, shipped.createDataFrame([], "query_id long, text string")).count() == 0


def test_search_query_asks_every_twentieth_document(shipped, near_copies, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from quayside.llm import queries

    monkeypatch.setattr(bm25, "QUERY_BLOCK", 3)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    docs = [(20 * k if k % 3 == 0 else 20 * k + 1, t) for k, (_, t) in enumerate(near_copies)]
    df = shipped.createDataFrame(docs, "doc_id long, text string").repartition(2)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    df.limit(1).select(F.lit(20).alias("item_id"), "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    asked = [(k, t) for k, t in docs if k % 20 == 0]
    got = queries.LLM_QUERIES["op5_bm25_search"](shipped, str(tmp_path)).collect()
    want = brute_bm25(docs, asked, 10)
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got) == sorted(w[:3] for w in want)
    assert {r["query_id"] for r in got} == {k for k, t in asked if words(t)} and len(asked) > 2 * bm25.QUERY_BLOCK
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rows = con.execute(bm25.oracle_sql()).fetchall()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got) == sorted(r[:3] for r in rows)


def test_search_reads_the_texts_once_for_all_blocks(shipped, near_copies, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 3)
    shipped.createDataFrame(near_copies, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = shipped.read.parquet(str(tmp_path / "documents.parquet"))
    files = bm25.search(df, df.withColumnRenamed("doc_id", "query_id")).inputFiles()
    assert files and not [f for f in files if "documents.parquet" in f]


@pytest.mark.parametrize("dense", [0, 0.05, 2])
def test_runs_of_a_shard_give_the_best_documents(near_copies, monkeypatch, dense):
    for name, value in (("BLOCK", 5), ("DENSE", dense), ("WIDTH", 2), ("CELLS", 20), ("ENTRIES", 30), ("SHARD_DOCS", 16)):
        monkeypatch.setattr(bm25, name, value)
    docs = [(None if k % 7 == 3 else k, t) for k, t in near_copies]
    asked = near_copies[::3] + [(500, ""), (501, "nosuchword")]
    rows = pa.record_batch({"doc_id": pa.array([k for k, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs])})
    bags = [Counter(words(t)) for _, t in asked]
    known = sorted({w for b in bags for w in b})
    held = Counter(w for _, t in docs for w in set(words(t)))
    n, mean = len(docs), sum(len(words(t)) for _, t in docs) / len(docs)
    q = bm25.Queries(pa.array([w.encode() for w in known], pa.binary()), np.arange(len(asked)), np.cumsum([0, *map(len, bags)]),
                     np.array([known.index(w) for b in bags for w in b]), np.array([b[w] for b in bags for w in b]),
                     np.array([math.log(1 + (n - held[w] + .5) / (held[w] + .5)) for w in known]))
    floor, kept, shards, seen = np.zeros(len(asked)), [np.zeros(0, int), np.zeros(0, int), np.zeros(0)], 0, 0
    for part in bm25._slices(iter([rows])):
        data, offsets = bm25.string_buffer(part.column("text"))
        distinct = bm25.Words(bm25.LOWER[data], offsets, bm25.ALNUM)
        shard, _ = bm25.index(part.column("doc_id").combine_chunks(), distinct)
        assert max(np.diff(shard.runs)) <= 5 and sorted(shard.ids) == [k for k in part.column("doc_id").to_pylist() if k is not None]
        number = np.array([known.index(w.decode()) if w.decode() in known else -1 for w in distinct.distinct.to_pylist()])
        for query, doc, score in bm25.search_shard(shard, number, q, mean, 6, floor):
            kept = [np.append(x, y) for x, y in zip(kept, (query, shard.ids[doc], score))]
        shards, seen = shards + 1, seen + part.num_rows
    query, ids, score, rank = bm25._best(*kept, 6)
    want = brute_bm25(docs, list(enumerate(t for _, t in asked)), 6)
    assert shards > 2 and seen == len(docs)
    assert [(k, r + 1, d) for k, r, d in zip(query, rank, ids)] == [w[:3] for w in want] and np.allclose(score, [w[3] for w in want])


def test_search_holds_one_shard_and_one_block_at_a_time(shipped, near_copies, monkeypatch):
    import os

    import pyarrow.parquet as pq

    written, sent = {}, []
    stored, broadcast = bm25.stored, type(shipped.sparkContext).broadcast
    monkeypatch.setattr(bm25, "stored", lambda df, name, *more: written.setdefault(name, []).append(stored(df, name, *more)) or written[name][-1])
    monkeypatch.setattr(type(shipped.sparkContext), "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    monkeypatch.setattr(bm25, "QUERY_BYTES", 2_000, raising=False)
    docs = near_copies + [(10_000 + k, "two") for k in range(9_000)]
    queries = near_copies[::8]
    df = shipped.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = bm25.search(df, shipped.createDataFrame(queries, "query_id long, text string"), top=3).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in got) == sorted(w[:3] for w in brute_bm25(docs, queries, 3))
    # a reader takes the rows of a row group into memory together
    kept = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written["shards"][0].inputFiles()]
    assert sum(m.num_rows for m in kept) > 1 and [m.row_group(g).num_rows for m in kept for g in range(m.num_row_groups)] == [1] * sum(m.num_rows for m in kept)
    # blocks are bounded by their texts, and no block is left with the executors
    assert written["query_blocks"][0].count() > 2
    assert sent and not [b for b in sent if os.path.exists(b._path)]


def test_a_task_holds_little_beside_the_queries():
    import tracemalloc

    rng, known, asked = np.random.default_rng(3), 4_000, 2_000
    texts = [" ".join(f"w{w}" for w in rng.choice(known, 300, replace=False)) for _ in range(40)]
    data, offsets = bm25.string_buffer(pa.array(texts))
    distinct = bm25.Words(data, offsets, bm25.ALNUM)
    shard, _ = bm25.index(pa.array(range(40), pa.int64()), distinct)
    number = np.array([int(w[1:]) for w in distinct.distinct.to_pylist()])
    cuts = np.arange(asked + 1) * 2_000
    q = bm25.Queries(None, np.arange(asked), cuts, np.concatenate([np.sort(rng.choice(known, 2_000, replace=False)) for _ in range(20)] * 100).astype("<i4"),
                     np.ones(cuts[-1], "<i4"), np.ones(known))
    tracemalloc.start()
    hits = sum(len(query) for query, _, _ in bm25.search_shard(shard, number, q, 300.0, 5, np.zeros(asked)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the queries' own words and counts are 8 bytes an entry
    assert hits >= 5 * asked and peak < 20 * len(q.terms)


def brute_scan(text):
    low = (text or "").translate(ASCII)
    w = words(low)
    base = sorted(i for p, _ in license_scan.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    labels = {label for p, label in license_scan.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()}
    best, more = 0.0, set(labels)
    for line in low.split("\n"):
        v = words(line)
        for k in range(0, max(0, math.ceil((len(v) - 64) / 32)) + 1):
            block = set(v[32 * k:32 * k + 64])
            for label, t in license_scan.TEMPLATES:
                t = set(t.split())
                if 100 * len(t & block) >= 80 * len(t):
                    more.add(label)
                    best = max(best, len(t & block) / len(t))
    return len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if base else best


SCAN = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_scan_equals_brute_force(shipped, messy):
    rng = random.Random(4)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()}) + ["filler", "ß", "42"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 30, 70, 200]))) for _ in range(60)]
    for _, t in license_scan.TEMPLATES:
        w = t.split()
        rng.shuffle(w)
        texts += [t.upper(), "intro\n" + " ".join(w) + ".\nend", " ".join(w[1:]), " ".join(w[3:]), " ".join(["filler"] * 75 + w + ["filler"] * 50)]
    texts += ["cc by cc by", "CC-BY, cc  by!", "cc\nby", "all rights reserved" * 2, "general public license general public license", "cc by", "xcc by", None, ""]
    df = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in SCAN) for r in license_scan.scan(df).collect()}
    for k, t in enumerate(texts):
        want = brute_scan(t)
        assert got[k][:6] == want[:6] and abs(got[k][6] - want[6]) < 1e-12, t
    rows = license_scan.scan(messy).collect()
    want = sorted((str(r["doc_id"]), *map(str, brute_scan(r["text"])[:6])) for r in messy.collect())
    assert sorted((str(r["doc_id"]), *(str(r[c]) for c in SCAN[:6])) for r in rows) == want
    assert license_scan.scan(messy.limit(0)).count() == 0


def brute_matches(text, marks):
    """(labels, best containment) over lines and windows of the whole text; a template's marks must all be there."""
    low = (text or "").translate(ASCII)
    labels, best = set(), 0.0
    for part in [*low.split("\n"), low]:
        v = words(part)
        for k in range(0, max(0, math.ceil((len(v) - 64) / 32)) + 1):
            block = set(v[32 * k:32 * k + 64])
            for label, t in license_scan.TEMPLATES:
                t = set(t.split())
                if 100 * len(t & block) >= 80 * len(t) and set(marks.get(label, ())) & t <= block:
                    labels.add(label)
                    best = max(best, len(t & block) / len(t))
    return labels, best


def wrapped_texts():
    rng = random.Random(12)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()}) + ["filler", "42"]
    texts = ["licensed under the\napache license, version 2.0", "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software"]
    for _, t in license_scan.TEMPLATES:
        w = t.split()
        for k in (2, len(w) // 2, len(w) - 2):
            texts += [" ".join(w[:k]) + "\n" + " ".join(w[k:]), "filler " * 70 + "\n" + " ".join(w[:k]) + "\r\n\n  " + " ".join(w[k:]) + "\n" + "filler " * 50]
    return texts + ["".join(rng.choice(vocabulary) + rng.choice(" \n") for _ in range(rng.choice([12, 40, 150]))) for _ in range(40)]


def own_labels(r):
    """Labels that only templates gave, and the score where no phrase decides it."""
    return {x for x in r["labels"].split(",") if x}, None if r["n_base"] else r["score"]


def check_labels(rows, texts, marks):
    base = dict(license_scan.PHRASES)
    for r in rows:
        labels, best = brute_matches(texts[r["doc_id"]], marks)
        labels |= {x for x in r["base_labels"].split(",") if x}
        got, score = own_labels(r)
        assert got == labels and set(r["base_labels"].split(",")) <= {"", *base.values()}, texts[r["doc_id"]]
        assert score is None or abs(score - best) < 1e-12


def test_wrapped_notices_are_found(shipped):
    texts = wrapped_texts()
    rows = license_scan.scan(shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    by_id = {r["doc_id"]: r["labels"].split(",") for r in rows}
    assert "apache" in by_id[0] and "mit" in by_id[1]
    check_labels(rows, texts, {})


def test_query_tells_notices_apart_that_share_most_words(shipped, tmp_path):
    from quayside.llm import queries

    notices = [("Licensed under the GNU General Public License.", {"gpl"}), ("This work is licensed under the GNU General Public License version 3", {"gpl"}),
               ("licensed under the gnu lesser general public license", {"gpl", "lgpl"}),  # the phrase of gpl stands in it
               ("licensed under CC BY-NC 4.0", {"cc-by", "cc-by-nc"}), ("licensed under CC BY-SA 4.0", {"cc-by", "cc-by-sa"}),
               ("licensed under CC BY 4.0", {"cc-by"}), ("released under the Apache license", set()), ("this work is licensed under the mozilla public license version 3", set())]
    texts = [t for t, _ in notices] + wrapped_texts()
    shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.LLM_QUERIES["op8_license_scan"](shipped, str(tmp_path)).collect()
    by_id = {r["doc_id"]: own_labels(r)[0] for r in rows}
    assert [by_id[k] for k in range(len(notices))] == [labels for _, labels in notices]
    check_labels(rows, texts, license_scan.MARKS)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(queries.LLM_ORACLE["op8_license_scan"]).fetchall()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))


def test_scan_runs_without_python(shipped, messy):
    plan = license_scan.scan(messy)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.read_pieces(MODEL)


def brute_best(unit, score, lowest):
    """(best total, a way to reach it) over all segmentations."""
    best = [(0.0, [])] + [(-math.inf, [])] * len(unit)
    for j in range(1, len(unit) + 1):
        for i in range(max(0, j - 16), j):
            piece = unit[i:j]
            s = score.get(piece, lowest if j - i == 1 else None)
            if s is not None and best[i][0] + s > best[j][0]:
                best[j] = best[i][0] + s, [*best[i][1], piece]
    return best[-1]


TEXTS = ["hello  World\n\tx é漢", " a", "the quick brown fox jumps over", "a▁b", "   ", "x" * 300, "漢字 日本語 мир 🙂🙂 ok", "Licensed under the Apache License, Version 2.0.", "", None]


@pytest.mark.parametrize("frequent", [0, 1, 1000])
def test_paths_are_best_and_text_comes_back(shipped, vocabulary, frequent):
    rows, byte_ids = vocabulary
    score, name = {p: s for p, _, s in rows}, {i: p for p, i, _ in rows}
    of_byte = {i: b for b, i in enumerate(byte_ids)}
    df = shipped.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as ids", "2 as unit", "3 as id")
    encoded = lattice.encode(df, MODEL, frequent=frequent)
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in lattice.decode(encoded, MODEL).collect()}
    lowest = min(score.values()) - 10
    for k, t in enumerate(TEXTS):
        assert back[k] == (t or "").replace("▁", " ")
        if not t:
            assert got[k] == []
            continue
        marked = "▁" + t.replace(" ", "▁")
        want = sum(brute_best(u, score, lowest)[0] for u in re.findall("▁*[^▁]+|▁+$", marked))
        total, run = 0.0, b""
        for i in got[k]:
            if i in of_byte:
                run += bytes([of_byte[i]])
                try:
                    run.decode()
                except UnicodeDecodeError:
                    continue
                total, run = total + lowest, b""
            else:
                total += score[name[i]]
        assert not run and total == want


def test_relational_and_array_paths_agree(shipped, near_copies):
    df = shipped.createDataFrame(near_copies, "doc_id long, text string")
    a, b = ({r["doc_id"]: list(r["ids"]) for r in lattice.encode(df, MODEL, frequent=n).collect()} for n in (0, 100_000))
    assert a == b


def test_lattice_on_messy_documents(messy):
    out = lattice.decode(lattice.encode(messy, MODEL, frequent=100), MODEL).collect()
    want = sorted((str(r["doc_id"]), r["text"] or "") for r in messy.collect())
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == want
    assert lattice.encode(messy.limit(0), MODEL).count() == 0


def test_pieces_are_looked_up_only_where_one_begins(monkeypatch):
    keep = [b"abcdefghij"[:n] for n in range(2, 11, 2)] + [b"bc", b"z"]
    data = np.frombuffer(b"xabcdefghi" * 50 + b"zbcab", np.uint8)
    offsets = np.array([0, 101, 101, len(data)])
    asked, real = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda keys, h, *a, **k: asked.append(np.size(h)) or real(keys, h, *a, **k))
    pieces = Pieces(keep)
    got = sorted((n, p, i) for n, at, found in pieces.lattice(data, offsets) for p, i in zip(at.tolist(), found.tolist()))
    raw, ends = data.tobytes(), [101, len(data)]
    assert got == sorted((len(w), p, i) for i, w in enumerate(keep) for p in range(len(raw))
                         if raw[p:p + len(w)] == w and p + len(w) <= next(e for e in ends if p < e))
    assert sum(asked) < 2.5 * len(data)


def test_frequent_units_change_no_path_and_decoding_builds_no_pieces(vocabulary):
    rows, byte_ids = vocabulary
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["the", "in", "ing", "a", "b", "é", "漢", "🙂", " ", "x" * 9]) for _ in range(rnd.randrange(1, 40))) for _ in range(300)]
    data = [t.encode() for t in texts]
    flat, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data])
    ids, bounds = lattice.Codec(rows, byte_ids, []).encode(flat, offsets)
    of_piece = {p: i for p, i, _ in rows}
    codec = lattice.Codec(rows, byte_ids, [("▁a", [of_piece["▁a"]]), ("▁漢", [of_piece["▁"], -1 - ord("漢")])])
    same = codec.encode(flat, offsets)
    assert (same[0] == ids).all() and (same[1] == bounds).all()
    fresh = lattice.Codec(rows, byte_ids, [])
    out, cuts = fresh.decode(ids, bounds)
    assert [out[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:])] == texts
    assert "pieces" not in vars(fresh)
