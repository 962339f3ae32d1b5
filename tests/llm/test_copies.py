"""op5, op7, op10: repeated phrases, near-duplicates, fingerprints."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from brute_llm import cut_words, linked, rows_of, shingles
from hypothesis import given, settings
from hypothesis import strategies as st

from hostloom.llm import components, neardup, phrases, winnowing
from hostloom.llm.text import span_hashes


def assert_cut(docs):
    want = cut_words(rows_of(docs))
    texts = Counter((d, *want[d, t][:2], " ".join(want[d, t][2]) if want[d, t][1] else t) for d, t in rows_of(docs))
    rows = phrases.deduplicated(docs)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows.collect()) == texts
    digests = Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in phrases.digests(rows).collect())
    assert digests == Counter(
        (d, want[d, t][1], hashlib.sha256(" ".join(want[d, t][2]).encode()).hexdigest()) for d, t in rows_of(docs)
    )


@pytest.mark.parametrize("table", ["small", "odd"])
def test_repeated_phrases(request, table):
    assert_cut(request.getfixturevalue(table))


def shuffled_passages(frame, seed, documents=60, words=25):
    """Few different words, so that windows recur at any place."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(5, words))) for _ in range(8)]
    return frame([(rng.randint(1, 50), "\n".join(rng.choices(passages, k=rng.randint(1, 6)))) for _ in range(documents)])


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_phrases_of_few_words(frame, seed):
    assert_cut(shuffled_passages(frame, seed))


def test_repeated_phrases_with_hot_anchors_and_small_automata(frame, monkeypatch):
    monkeypatch.setattr(phrases, "HOT_RUNS", 2)
    monkeypatch.setattr(phrases, "AUTOMATON_PHRASES", 5)
    assert_cut(shuffled_passages(frame, 3))


@pytest.mark.parametrize("text", [None, ""])
def test_repeated_phrases_with_an_empty_text_last_or_alone(frame, text):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    for rows in ([(1, text)], [(1, passage), (2, passage), (3, text)], [(1, text), (2, text)]):
        assert_cut(frame(rows).coalesce(1))


def test_hashes_of_empty_spans_are_equal():
    data = np.frombuffer(b"abcabc", np.uint8)
    got = span_hashes(data, np.array([0, 0, 3, 3, 6]), np.array([0, 3, 3, 6, 6])).tolist()
    assert got[0] == got[2] == got[4] != got[1] == got[3]


def test_repeated_phrases_of_an_empty_table(empty):
    assert phrases.deduplicated(empty).count() == 0


def assert_linked(docs):
    rows, want = rows_of(docs), linked(rows_of(docs))
    expected = Counter()
    for d, t in rows:
        component = want.get(d)
        expected[d, len(shingles(t)), component, d is None or component == d] += 1
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == expected


@pytest.mark.parametrize("table", ["small", "odd"])
def test_near_duplicates(request, table):
    assert_linked(request.getfixturevalue(table))


def test_near_duplicates_in_chains_and_crowds(frame):
    """Chains whose ends are far apart, and a crowd in which not all are linked with the first."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    text = rng.sample(words, 120)
    for k in range(40):
        rows.append((k, " ".join(text)))
        at = rng.randrange(115)
        text[at : at + 5] = rng.sample(words, 5)
    base = rng.sample(words, 100)
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(100)] = rng.choice(words)
        rows.append((100 + k, " ".join(copy)))
    assert_linked(frame(rows))


def test_no_near_duplicates_in_an_empty_table(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_pruning_limits_follow_the_posterior():
    """Numerical integration of the posterior agrees with the closed form on both sides of every limit."""
    grid = np.linspace(0, 1, 200_001)[1:-1]
    for n, least in neardup.least_matches():

        def above(m):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            return mass[grid >= 0.75].sum() / mass.sum()

        assert above(least) >= neardup.MISS_PROBABILITY * 0.99
        assert least == 0 or above(least - 1) <= neardup.MISS_PROBABILITY * 1.01


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    parent = list(range(26))
    for a, b in edges:
        x, y = parent[a], parent[b]
        parent = [min(x, y) if p in (x, y) else p for p in parent]
    want = {n: parent[n] for a, b in edges if a != b for n in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_long_chain(spark):
    edges = spark.range(1, 300).selectExpr("id - 1 AS a", "id AS b")
    assert {r["component"] for r in components.components(edges).collect()} == {0}


# --- winnowing


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=60), st.integers(1, 5), st.integers(1, 6))
def test_selection_is_the_rightmost_minimum_of_every_window(text, gram, window):
    points = winnowing.code_points(text)
    hashes, positions = winnowing.select(points, gram, window)
    if not text:
        assert not len(hashes)
        return
    codes = winnowing.gram_codes(points, min(gram, len(points))).tolist()
    width = min(window, len(codes))
    want = []
    for k in range(len(codes) - width + 1):
        at = max(range(k, k + width), key=lambda i: (-codes[i], i))
        if not want or want[-1] != at:
            want.append(at)
    assert positions.tolist() == want and hashes.tolist() == [codes[i] for i in want]
    assert winnowing.decoded(winnowing.encoded(hashes, positions)) == list(zip(hashes.tolist(), want))


@settings(max_examples=60, deadline=None)
@given(st.text("abcd", min_size=40, max_size=60), st.text(max_size=50), st.text(max_size=50))
def test_shared_passages_share_a_hash(passage, before, after):
    a, _ = winnowing.select(winnowing.code_points(before + passage))
    b, _ = winnowing.select(winnowing.code_points(passage + after))
    assert set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize("table,buckets", [("small", 7), ("small", None), ("odd", 3)])
def test_edited_and_next(request, table, buckets):
    docs = request.getfixturevalue(table)
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = Counter()
    for k, (d, t) in enumerate(rows):
        text, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [{h for h, _ in winnowing.decoded(fingerprint_of(x))} for x in (text, edited, after)]
        near = [likeness(prints[0], prints[1]), likeness(prints[0], prints[2])]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        want[d, len(text), digest, fingerprint_of(text), fingerprint_of(edited), *near] += 1
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    got = winnowing.edited_and_next(docs, buckets=buckets).collect()
    assert Counter(tuple(r[c] for c in columns) for r in got) == want


def fingerprint_of(text):
    return winnowing.encoded(*winnowing.select(winnowing.code_points(text)))


def likeness(a, b):
    return float(a == b) if not a or not b else len(a & b) / len(a | b)


def test_fingerprints_of_an_empty_table(empty):
    assert winnowing.fingerprints(empty).count() == 0
    assert winnowing.edited_and_next(empty).count() == 0


def test_fingerprints_need_no_order(odd):
    prints = {r["fingerprint"] for r in winnowing.fingerprints(odd).collect() if r["doc_id"] in (4, 5)}
    assert len(prints) == 1
