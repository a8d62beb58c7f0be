import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quayside.llm import packing, token_files
from quayside.llm.arrays import string_buffer
from quayside.llm.tokens import SegmentEncoder, with_end

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def segments():
    return SegmentEncoder(PATH)


def encode_all(segments, texts):
    import pyarrow as pa

    ids, bounds = segments.encode(*string_buffer(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


SPACES = [" ", "  ", "   ", "\n", " \n", "\n ", "\t", " ", " ", "　", "\u0085", "  ", "   ", "\x1f", "\x0b "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(SPACES), st.sampled_from(["word", "it's", "a,b", ",'s", "x',s", "(b)", "don't.", "42", "é", "漢字", "!?", "🙂", "<|endoftext|>", "à", "ა"])), max_size=12), max_size=5))
def test_segments_give_the_ids_of_the_whole_text(parts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = ["".join(p) for p in parts]
    assert encode_all(SegmentEncoder(PATH), texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_memory_limit_never_changes_ids(whole, segments, monkeypatch):
    monkeypatch.setattr("quayside.llm.tokens.MEMO_SEGMENTS", 3)
    texts = [f"some words {k} and {k * 7} more, {k % 3}" for k in range(50)] + [None, ""]
    for at in range(0, len(texts), 7):
        assert encode_all(segments, texts[at:at + 7]) == [whole(t) for t in texts[at:at + 7]]


def test_memory_is_bounded_and_keeps_what_recurs(whole, monkeypatch):
    monkeypatch.setattr("quayside.llm.tokens.MEMO_SEGMENTS", 100)
    encoder = SegmentEncoder(PATH)
    for run in range(6):
        texts = [f"often {run * 1000 + k} often" for k in range(300)]
        assert encode_all(encoder, texts) == [whole(t) for t in texts]
        assert len(encoder.place) <= 100 and len(encoder.ids) == encoder.length.sum()
        assert b" often" in encoder.place


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\n", "\n\n", "\r\n", " \n", "\n ", " ", "él", "Ñu", "ȿx", "×", "÷", "ɀ", "word", "'s", "'", ",", "(", ".", "42", "\x7f", "漢", "é́"]), max_size=10), max_size=4))
def test_cuts_at_lines_and_after_latin_letters_keep_the_ids(whole, segments, parts):
    texts = ["".join(p) for p in parts]
    assert encode_all(segments, texts) == [whole(t) for t in texts]


def test_latin_words_go_straight_to_the_model(whole, monkeypatch):
    from quayside.llm import tokens

    library, sent = tokens._tokenizer(PATH), []

    class Counting:
        model = library.model

        def encode_batch(self, texts, **more):
            sent.extend(texts)
            return library.encode_batch(texts, **more)

    monkeypatch.setattr(tokens, "_tokenizer", lambda path: Counting())
    texts = [f"Première été{a}, niño{a}.\nStraße{a}\nend" for a in "abcdefgh"]
    assert encode_all(SegmentEncoder(PATH), texts) == [whole(t) for t in texts]
    assert set(sent) == {",", ".", "\n"}


def greedy_words(ids):
    words, sizes = [], []
    for a in range(0, len(ids), 512):
        block, k, before = ids[a:a + 512], 0, len(words)
        while k < len(block):
            fits = [s for s in range(1, 15) if all(i < 1 << token_files.SLOTS[s][1] for i in block[k:k + token_files.SLOTS[s][0]])]
            if not fits:
                words += [0, block[k]]
                k += 1
                continue
            count, bits = token_files.SLOTS[fits[0]]
            words.append(fits[0] << 60 | sum(i << j * bits for j, i in enumerate(block[k:k + count])))
            k += count
        sizes.append(len(words) - before)
    return words, sizes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 1), st.integers(0, 60_000), st.sampled_from([2**60 - 1, 2**60, 2**64 - 1])), max_size=1300))
def test_blocks_hold_the_greedy_words(values):
    words, block_words = token_files.encode_blocks(np.array(values, np.uint64))
    assert (words.tolist(), block_words.tolist()) == greedy_words(values)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**32 - 1), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    words, block_words = token_files.encode_blocks(ids)
    assert block_words.sum() == len(words)
    assert (token_files.decode_blocks(words, block_words.astype(np.int64), len(ids)) == ids).all()


def test_simple8b_packs_small_ids():
    words, _ = token_files.encode_blocks(np.ones(60 * 512, np.uint64))
    assert len(words) == 60 * 9  # 512 ids a block: 8 words of 60 and one of 32


def brute_documents(rows, whole):
    """(doc_id, start, n_tokens, crc) in ascending id, nulls first, ties by text."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*whole(text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_on_messy_documents(shipped, messy, whole, tmp_path):
    token_files.write_token_files(messy, str(tmp_path / "files"), PATH)
    got = token_files.read_token_files(shipped, str(tmp_path / "files"), with_ids=True).collect()
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert sorted([(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got], key=lambda r: r[1]) == brute_documents(rows, whole)
    by_start = {r["start"]: list(r["ids"]) for r in got}
    assert by_start[0] == [*whole("a text without an id"), 0]


def test_token_files_of_an_empty_table(shipped, messy, tmp_path):
    token_files.write_token_files(messy.limit(0), str(tmp_path / "files"), PATH)
    assert token_files.read_token_files(shipped, str(tmp_path / "files")).count() == 0


def check_packing(rows, capacity):
    """Every sequence is gapless from 0 and within capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_messy_documents(messy, whole):
    rows = packing.best_fit_packing(messy, PATH).collect()
    want = []
    for r in messy.collect():
        ids = [*whole(r["text"]), 0]
        first = len(ids) % 2048 or min(2048, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows], key=key) == sorted(want, key=key)
    check_packing(rows, 2048)
    assert packing.best_fit_packing(messy.limit(0), PATH).count() == 0


def place(counts, capacity):
    rows = []
    for length, lo, hi, first, each, offset in packing.pack_plan(counts, capacity):
        rows += [{"length": length, "rank": r, "sequence_id": first + (r - lo) // each, "offset": offset + (r - lo) % each * length} for r in range(lo, hi)]
    return rows


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_places_every_piece_once(counts):
    rows = place(counts, 60)
    assert sorted((r["length"], r["rank"]) for r in rows) == sorted((s, k) for s, n in counts.items() for k in range(n))
    bins = check_packing(rows, 60)
    large = sum(n for s, n in counts.items() if 3 * s > 60)
    per_bin = {}
    for r in rows:
        if 3 * r["length"] > 60:
            per_bin[r["sequence_id"]] = per_bin.get(r["sequence_id"], 0) + 1
    assert all(n <= 2 for n in per_bin.values()) and sum(per_bin.values()) == large
    # best fit decreasing stays within 11/9 of the least number, which the volume bounds from below
    assert bins <= 11 / 9 * -(-sum(s * n for s, n in counts.items()) // 60) + large + 1


def test_plan_is_close_to_the_volume():
    rng = random.Random(3)
    counts = {}
    for _ in range(20_000):
        s = min(2048, max(1, int(rng.lognormvariate(5.8, 1.0))))
        counts[s] = counts.get(s, 0) + 1
    bins = check_packing(place(counts, 2048), 2048)
    assert bins <= -(-sum(s * n for s, n in counts.items()) // 2048) + 2


def test_end_id_follows_every_document():
    ids, bounds = with_end(np.array([5, 6, 7]), np.array([0, 2, 2, 3]))
    assert ids.tolist() == [5, 6, 0, 0, 7, 0] and bounds.tolist() == [0, 3, 4, 6]
