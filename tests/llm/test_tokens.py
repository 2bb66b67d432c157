import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sumiveil.llm.bpe_codec import codec_digests, decode_ids, encode_ids
from sumiveil.llm.packing import pack, plan_packing
from sumiveil.llm.token_counts import count_tokens
from sumiveil.llm.word_bpe import WordBpe, default_path

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(default_path())


def library_ids(bpe, text):
    return bpe.library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_both_merge_loops_match_the_library(bpe, text):
    words = text.split()
    for w in words:
        if w.split() != [w] or any(c in w for c in "\t\n\x0b\f\r "):
            continue
        ids = np.frombuffer(bpe.ids_word(w, {}), np.uint16).tolist()
        assert ids == library_ids(bpe, w)
        assert bpe.count_word(w, {}) == len(ids)


def test_every_latin_character(bpe):
    for cp in [*range(0x21, 0x17F), *range(0x370, 0x400), 0x130, 0x1E9E, 0x212B, 0x3A3]:
        w = f"a{chr(cp)}B"
        if len(w.split()) == 1 and chr(cp) not in "\x1c\x1d\x1e\x1f\x85\xa0":
            assert np.frombuffer(bpe.ids_word(w, {}), np.uint16).tolist() == library_ids(bpe, w), hex(cp)


def texts(small):
    return {r["doc_id"]: r["text"] for r in small.collect()}


def test_counts(small, awkward, nothing, bpe):
    for r in count_tokens(small).collect():
        text = texts(small)[r["doc_id"]] if r["doc_id"] < 3 else None
        if text is not None:
            assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library_ids(bpe, text)))
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    got = sorted((r["doc_id"] or -1, r["n_tokens"]) for r in count_tokens(awkward).collect())
    assert got == sorted((i or -1, len(library_ids(bpe, t))) for i, t in AWKWARD)
    assert count_tokens(nothing).count() == 0


def test_codec(small, awkward, nothing, bpe):
    source = [*((r["doc_id"], r["text"]) for r in small.limit(40).collect()), *AWKWARD]
    expected = sorted((i or -1, len(x := library_ids(bpe, t)), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(bpe.library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, t in source)
    union = small.limit(40).select("doc_id", "text").union(awkward.select("doc_id", "text"))
    assert sorted((r[0] or -1, r[1], r[2], r[3]) for r in codec_digests(union).collect()) == expected
    ids = encode_ids(union)
    assert sorted((r[0] or -1, list(r[1])) for r in ids.collect()) == sorted((i or -1, library_ids(bpe, t)) for i, t in source)
    assert sorted((r[0] or -1, r[1]) for r in decode_ids(ids).collect()) == sorted((i or -1, bpe.library.decode(library_ids(bpe, t), skip_special_tokens=False)) for i, t in source)
    assert codec_digests(nothing).count() == encode_ids(nothing).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plans_are_whole(given_):
    capacity, items = given_
    plan = plan_packing(Counter(items), capacity)
    bins, seen = defaultdict(list), Counter()
    for size, rank, n, sequence, per, offset in plan.runs:
        assert rank == seen[size]
        for k in range(n):
            bins[sequence + k // per].append((offset + k % per * size, size))
        seen[size] += n
    assert seen == Counter(items) and len(bins) == plan.sequences
    for placed in bins.values():
        end = 0
        for offset, size in sorted(placed):
            assert offset == end
            end += size
        assert end <= capacity


def fewest(items, capacity):
    """The least number of bins, by trying every way."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] >= items[k]:
                bins[i] -= items[k]
                go(k + 1, bins)
                bins[i] += items[k]
        bins.append(capacity - items[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best


@settings(max_examples=400, deadline=None)
@given(st.integers(8, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=10))))
def test_reduction_never_costs_a_sequence(case):
    """What dominance fixes leaves an optimum: fixed sequences and the best for the rest are the best for all."""
    from sumiveil.llm.packing import Plan, dominating_sets

    capacity, items = case
    plan = Plan(capacity, {s: n for s, n in Counter(items).items()})
    dominating_sets(plan)
    rest = [s for s, n in plan.left.items() for _ in range(n)]
    assert plan.fixed + fewest(rest, capacity) == fewest(items, capacity)


def test_a_pair_that_only_fills_the_room_is_not_fixed():
    from sumiveil.llm.packing import plan_packing

    assert plan_packing(Counter([2038, 1045, 1041, 1000, 1000, 8, 7, 3, 1]), 2048).sequences == 3


def test_reduced_plans_need_no_more_than_best_fit():
    from sumiveil.llm.packing import Plan, best_fit, dominating_sets, plan_packing

    rng, worse = random.Random(11), 0
    for _ in range(3000):
        capacity = rng.choice([30, 100, 2048])
        counts = Counter(rng.randint(1, capacity if rng.random() < 0.6 else max(1, capacity // 3)) for _ in range(rng.randint(1, 40)))
        alone, reduced = Plan(capacity, dict(counts)), Plan(capacity, dict(counts))
        best_fit(alone)
        dominating_sets(reduced)
        best_fit(reduced)
        worse += reduced.sequences > alone.sequences
        plan = plan_packing(counts, capacity)
        assert -(-sum(s * n for s, n in counts.items()) // capacity) <= plan.sequences <= alone.sequences
        assert plan.rank == dict(counts) and not plan.left
    assert worse <= 30


def test_packing(small, awkward, nothing, bpe):
    for docs, source in ((small, list(texts(small).items())), (awkward, AWKWARD)):
        rows = pack(docs).collect()
        expected = []
        for i, t in source:
            ids = [*library_ids(bpe, t), 0]
            expected += [(i or -1, p, s, len(x := ids[s : s + 2048]), zlib.crc32(np.array(x, "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
        sequences = defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for s in sequences.values():
            end = 0
            for offset, length in sorted(s):
                assert offset == end
                end += length
            assert end <= 2048
        assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert pack(nothing).count() == 0


def test_ranks_cross_buckets(small):
    from sumiveil.llm.common import settle
    from sumiveil.llm.packing import cut_pieces, rank_pieces

    ranks = defaultdict(list)
    pieces = settle(cut_pieces(small))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    for r in rank_pieces(pieces, counts, per_bucket=2).collect():
        ranks[r["length"]].append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())


def test_long_parts(bpe):
    import time

    rng = random.Random(4)
    long = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (511, 512, 513, 4000)] + ["-" * 700, "é" * 900, "日" * 600, "=" * 3000]
    for word in long:
        assert np.frombuffer(bpe.ids_word(word, {}), bpe.kind).tolist() == library_ids(bpe, word)
        assert bpe.count_word(word, {}) == len(library_ids(bpe, word))
    word, began = "".join(rng.choice("etaoinshr") for _ in range(100_000)), time.process_time()
    n = len(bpe.ids_word(word, {}))
    assert time.process_time() - began < 5 and n == bpe.count_word(word, {}) * bpe.kind.itemsize


def test_wide_ids(bpe):
    wide = WordBpe(default_path())
    wide.kind = np.dtype(np.uint32)
    words = ["hello", "wörld", "<|endoftext|>x", "日本"]
    for w in words:
        assert np.frombuffer(wide.ids_word(w, {}), np.uint32).tolist() == np.frombuffer(bpe.ids_word(w, {}), bpe.kind).tolist()
