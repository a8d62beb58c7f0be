"""Operators 11 to 13 against plain Python and SQL."""

import hashlib
import heapq
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quayside.llm import conversation_repair as cr
from quayside.llm import periodic_runs as pr
from quayside.llm import source_mix as sm

TURNS = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


# --- operator 11 --------------------------------------------------------------------

def cheapest(rows):
    """(cost, audit, repaired) by Dijkstra over (rows read, place in the sound reading); rows are (role, text, faulty, truncated)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, place, out = heapq.heappop(heap)
        if i == len(rows) and place in ("", "a"):
            return cost, audit, "\n".join(out)
        if (i, place) in done:
            continue
        done.add((i, place))
        for (a, b), c in step.items():
            if a == place and b != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, c, out + (names[b] + ":",)))
        if i < len(rows):
            role, text, faulty, truncated = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, place, out))
            for (a, b), c in step.items():
                if a == place and not faulty:
                    if role[:1] == b:
                        heapq.heappush(heap, (cost + truncated, audit + "K", i + 1, c, out + (f"{role}:{text}",)))
                    if b != "s":
                        heapq.heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, c, out + (f"{names[b]}:{text}",)))


def brute_repair(table):
    """The contract, row by row, in plain Python."""
    groups = {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if code == 4:
            role = "user"
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, counts, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in rows:
            fault = None
            if not text.strip(SPACE):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif text.strip(SPACE)[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = cheapest(marked)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations(seed=5, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 20])):
            if rng.random() < 0.1:
                continue
            rows.append((conv, turn + rng.choice([0, 0, 0, 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(["Yes.", "No!", "so it goes", " \n", "", None, "What? ", "漢字.", f"text {rng.random()}."])))
    rows += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (900, None, "user", "x."), (900, None, None, None), (900, 4, "assistant", "y."),
             (901, None, "user", "z."), (902, 7, "user", "same."), (902, 7, "user", "same."), (902, 7, "user", "same."), (903, 1, "user", "w " * 50_000 + ".")]
    return rows + [(950, t, "user" if t % 2 else "assistant", f"row {t}.") for t in range(150)]


def test_repair_is_what_the_contract_says(shipped):
    rows = conversations()
    df = shipped.createDataFrame(rows, TURNS).repartition(5)
    for c in ("cost", "audit", "kind", "digest", "copies_", "part", "n"):
        df = df.withColumn(c, df["turn"])
    got = {r["conv_id"]: tuple(r)[1:9] for r in cr.repair(cr.damaged(df)).collect()}
    want = brute_repair(rows)
    assert got.keys() == want.keys() and any(v[6] == "" for v in want.values())
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}


def test_repair_does_not_depend_on_the_partitions(shipped):
    rows = [r for r in conversations(6, 4)] + [(950, t + 500, "assistant" if t % 3 else "user", f"more {t % 90}!") for t in range(300)]
    want = brute_repair(rows)
    before = shipped.conf.get("spark.sql.shuffle.partitions")
    try:
        shipped.conf.set("spark.sql.shuffle.partitions", "40")
        shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        planned = cr.spans(cr.faults(cr.damaged(shipped.createDataFrame(rows, TURNS))))
        assert planned.where("conv_id = 950").count() > 3
        got = {r["conv_id"]: tuple(r)[1:9] for r in cr.repair(cr.damaged(shipped.createDataFrame(rows, TURNS))).collect()}
    finally:
        shipped.conf.set("spark.sql.shuffle.partitions", before)
        shipped.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.booleans(), st.booleans()), max_size=40))
def test_parse_gives_the_cheapest_and_least_audit(rows):
    span = cr.Span()
    for turn, (initial, faulty, truncated) in enumerate(rows):
        span.add(turn, initial, faulty, False, truncated)
    assert cr.cheapest(span.cell()) == cheapest([(i, "", f, t and not f) for i, f, t in rows])[:2]


def test_every_split_of_a_span_gives_the_same_cell():
    rng = random.Random(3)
    cells = [cr.row_cell(rng.choice("sua"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(12)]
    whole = cr.parse_block(cells)
    for k in range(1, 12):
        assert tuple(cr.join_cells(cr.parse_block(cells[:k]), cr.parse_block(cells[k:]))) == whole


def test_repaired_rows_read_as_a_sound_conversation(shipped):
    turns = cr.damaged(shipped.createDataFrame(conversations(8), TURNS))
    planned = cr.repair_plans(turns)
    readings = {}
    for r in sorted(cr.repaired_rows(turns, planned).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["position"])):
        assert r["position"] == len(readings.setdefault(r["conv_id"], ""))
        readings[r["conv_id"]] += r["role"][0]
    import re

    assert readings and all(re.fullmatch("s?(ua)+", x) for x in readings.values())


def test_repair_of_an_empty_table(shipped):
    assert cr.repair(cr.damaged(shipped.createDataFrame([], TURNS))).count() == 0


# --- operator 12 --------------------------------------------------------------------

def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            a = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            x = w[a:i]
            if len(x) >= max(least, 2 * q) and not any(x[p:] == x[:-p] for p in range(1, q)):
                out.append((a, i - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, n):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        base = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        return [base[i % len(base)] if rng.random() > 0.01 else 9 for i in range(n)]
    if kind == 2:
        w = []
        while len(w) < n:
            w += w[-rng.randrange(1, len(w) + 1):] * rng.randrange(1, 3) if w and rng.random() < 0.6 else [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        return w[:n]
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(0, 220), st.sampled_from([2, 4, 12]))
def test_runs_are_those_of_a_search_over_all_periods(rng, n, least):
    w = repetitive(rng, n)
    want = brute_runs(w, least)
    at_once = pr.Catchers(least)
    at_once.append(np.array(w, np.int64))
    assert at_once.finish() == want
    online, at = pr.Catchers(least), 0
    while at < n:
        k = rng.choice([1, 1, 2, 7, 50])
        online.append(np.array(w[at:at + k], np.int64))
        at += k
    assert online.finish() == want


def test_online_search_reports_a_run_as_soon_as_it_ends():
    search = pr.Catchers()
    for k in range(60):
        search.append(np.array([k % 10]))
        assert search.runs == []
    assert search.open == {10: 0}
    search.append(np.array([77]))
    assert search.runs == [(0, 60, 10)]


def test_long_texts_of_few_words():
    for words, runs in ((np.zeros(100_000, np.int64), 1), (np.arange(100_000) % 2, 1), ((np.arange(60_000) % 1001 == 1000).astype(np.int64), 1 + 60)):
        search = pr.Catchers()
        search.append(words)
        assert len(search.finish()) == runs


def brute_document(doc_id, text):
    words = [w.decode("utf-8", "replace") for w in (text or "").encode().translate(bytes(32 if 9 <= b <= 13 else b for b in range(256))).split(b" ") if w]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_run_digests_are_what_the_contract_says(shipped):
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{x}" for x in repetitive(rng, rng.randrange(0, 150)))) for k in range(150)]
    rows += [(k, " ".join(rng.choice(["a", "b", "é漢", "\u0085x", "z y"]) + "\n" * (rng.random() < 0.1) for _ in range(120))) for k in range(150, 190)]
    rows += [(None, "x y " * 20), (None, None), (3, ""), (3, " \t\x0b\n"), (7, "one"), (200, "a b c d e f g h i j k l m " * 3), (201, "same " * 3000)]
    df = shipped.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for c in ("id", "runs", "best", "start", "collapsed", "n_words"):
        df = df.withColumn(c, df["doc_id"])
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got = sorted((tuple(r)[:8] for r in pr.run_digests(df).collect()), key=key)
    want = sorted((brute_document(*r) for r in rows), key=key)
    assert got == want and sum(r[1] > 0 for r in want) > 30


def test_collapsed_text_and_runs(shipped):
    text = "start " + "a b c d e f g h " * 4 + "end"
    row = pr.find_runs(shipped.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()[0]
    assert [tuple(r) for r in row["runs"]] == [(1, 32, 8)] and row["n_words"] == 34
    assert row["collapsed"] == "start a b c d e f g h end"
    assert pr.run_digests(shipped.createDataFrame([], "doc_id bigint, text string")).count() == 0


# --- operator 13 --------------------------------------------------------------------

DOCS = "doc_id bigint, text string, source string"


def brute_targets(sizes, weights=(3, 1, 2), percent=150, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, out, budget = set(order), {}, sum(sizes.values()) * percent / 100
    while rest:
        share = budget / sum(weight[s] for s in rest)
        over = {s for s in rest if share * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in rest}
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
        rest -= over
    return out


def mixed_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for source, n in (("big", 600), ("b", 40), ("é", 60), ("z", 5), (None, 80), ("A", 100), ("漢", 90)):
        rows += [(len(rows) + k, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 30, 120]))), source) for k in range(n)]
    same = (77_777, "one two three", "big")
    return rows + [same] * 50 + [(None, "a b c d", "big")] * 20 + [(None, None, "z"), (5, "", None), (6, " \t", "empty"), (9, "x " * 5000, "b")]


def check_mix(got, rows):
    sizes, biggest = {}, {}
    for _, text, source in rows:
        n = len((text or "").replace("\t", " ").split(" ")) - (text or "").replace("\t", " ").split(" ").count("")
        sizes[source] = sizes.get(source, 0) + n
        biggest[source] = max(biggest.get(source, 0), n)
    targets, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) <= 1e-9 * (1 + targets[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    budget = sum(sizes.values()) * 150 // 100
    assert budget - max(biggest.values()) <= sum(taken.values()) <= budget
    for s, n in taken.items():
        assert abs(n - targets[s]) <= 2 * max(biggest.values()) and n <= 2 * sizes[s]


def test_mix_comes_near_its_targets_and_agrees_with_sql(shipped):
    rows = mixed_rows()
    df = shipped.createDataFrame(rows, DOCS).repartition(7)
    for c in ("size", "key", "cut", "rank", "target", "at", "part", "ends", "words"):
        df = df.withColumn(c, df["doc_id"])
    got = sm.mix(df).collect()
    check_mix(got, rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(con.execute(sm.oracle_sql()).fetchall(), key=key)
    again = sm.mix(shipped.createDataFrame(rows[::-1], DOCS).repartition(3)).collect()
    assert sorted((tuple(r) for r in again), key=key) == sorted((tuple(r) for r in got), key=key)


def test_mix_takes_whole_passes_and_is_shuffled(shipped):
    rows = [(k, "w " * 10, s) for s in ("a", "b", "c", "d") for k in range(100)]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    got = sm.mix(shipped.createDataFrame(rows, DOCS)).collect()
    check_mix(got, rows)
    taken = {s: [r["taken"] for r in sorted(got, key=lambda r: r["doc_id"]) if r["source"] == s] for s in "abcd"}
    assert min(taken["a"]) >= 10  # a pass ends before the next one begins
    assert taken["b"] != sorted(taken["b"]) and taken["b"] != sorted(taken["b"], reverse=True)
    other = sm.mix(shipped.createDataFrame(rows, DOCS), seed="another").collect()
    assert {r["doc_id"] for r in other if r["taken"]} != {r["doc_id"] for r in got if r["taken"]}


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "a b c", "s")]])
def test_mix_of_small_tables(shipped, rows):
    got = sm.mix(shipped.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    check_mix(got, rows) if any((t or "").strip() for _, t, _ in rows) else [r["taken"] for r in got] == [0] * len(rows)
