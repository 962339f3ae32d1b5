"""op3, op4, op6, op9 and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from brute_llm import cut_words, linked, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from test_tokens import assert_packed

from hostloom.llm import decontamination, quality, sharding, toxicity
from hostloom.llm.labelled import held_out, training_labels
from hostloom.llm.queries import TOKENIZER
from hostloom.llm.winnowing import code_points

SF = "/root/testdata/sf0.001"


# --- decontamination


def normal(text):
    points = decontamination.normal(code_points(text or ""))
    return points.astype("<u4").tobytes().decode("utf-32-le")


def fitting_distance(item, text):
    """Edits of the best place of ``item`` in ``text``."""
    row = np.zeros(len(text) + 1, np.int64)
    letters = code_points(text)
    ramp = np.arange(len(text) + 1)
    for r, c in enumerate(code_points(item), 1):
        step = np.minimum(row[:-1] + (letters != c), row[1:] + 1)
        row = np.minimum.accumulate(np.append(r, step) - ramp) + ramp
    return int(row.min())


def holds(item, text, region=80, rate=1 / 16):
    """Some region of the item lies in the text within the budget."""
    item, text = normal(item), normal(text)
    size = min(len(item), region)
    budget = min(int(size * rate), max(size // 10 - 1, 0))
    return any(fitting_distance(item[k : k + size], text) <= budget for k in range(len(item) - size + 1))


def edited(text, edits, rng):
    letters = list(text)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        letters[at : at + 1] = rng.choice([[], ["q"], [letters[at], "z"]])
    return "".join(letters)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_leaks_of_the_given_tables(spark, small, benchmark):
    found = decontamination.contaminated(small, benchmark).collect()
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    exact = {(d, i) for d, t in rows_of(small) for i, x in items if normal(x) in normal(t)}
    assert exact and exact <= {(r["doc_id"], r["item_id"]) for r in found}
    texts, sources = dict(rows_of(small)), dict(items)
    for r in found:
        assert holds(sources[r["item_id"]], texts[r["doc_id"]])
        if (r["doc_id"], r["item_id"]) in exact:
            stretch = texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["edits"] == 0 and normal(stretch) == normal(sources[r["item_id"]])


def test_edited_leaks_agree_with_full_alignment(frame, spark, benchmark):
    rng = random.Random(6)
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()][:12]
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()
    rows = []
    for k in range(48):
        i, text = items[k % len(items)]
        part = edited(text[: rng.choice([60, 100, 400])], rng.choice([0, 2, 4, 9, 20]), rng)
        fill = [" ".join(rng.choices(words, k=30)) for _ in range(2)]
        rows.append((k, f"{fill[0]} {part.upper() if k % 5 == 0 else part} {fill[1]}"))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(rows), table).collect()}
    want = {(k, items[k % len(items)][0]) for k, t in rows if holds(items[k % len(items)][1], t)}
    assert found == want and 10 < len(want) < 48


def test_excerpts_at_the_borders_of_a_text(spark, benchmark):
    rng = random.Random(9)
    items = [(r["item_id"], r["text"]) for r in benchmark.collect() if len(r["text"]) >= 250][:6]
    index = decontamination.Index(items)
    fill = " ".join(rng.choices("lorem ipsum dolor sit amet consectetur adipiscing".split(), k=40))
    got, want = [], []
    for k in range(80):
        number = k % len(items)
        item = items[number][1]
        size = rng.choice([30, 30, 60, 76, 82, 100, 120])
        at = rng.randrange(100, len(item) - size - 20)
        part = item[at : at + size] if k % 3 else edited(item[at : at + size], 2, rng)
        gap = fill[: rng.choice([0, 0, 5, 30, 74])]
        text = [part, f"{part} {gap}", f"{gap} {part}", f"{gap} {part} {fill}", f"{fill} {part} {gap}"][k % 5]
        data = decontamination.normal(code_points(text))
        got.append(number in {leak[1] for leak in decontamination.leaks(data, np.array([0, len(data)]), index)})
        want.append(holds(item[at - 100 : at + size + 100], text))  # the rest of the item is far from the text
    assert got == want and 20 < sum(want) < 60


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=20), max_size=6))
def test_decoding_is_that_of_python(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    points, offsets = decontamination.decoded(data, np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    assert points.tolist() == [ord(c) for t in texts for c in t]
    assert offsets.tolist() == [sum(len(t) for t in texts[:k]) for k in range(len(texts) + 1)]


def test_letters_beyond_ascii_count_once(frame, spark):
    rng = random.Random(12)
    scripts = {"cjk": range(0x4E00, 0x9FA0), "cyrillic": range(0x0430, 0x0450), "beyond": range(0x20000, 0x2A6D0)}
    items, rows = [], []
    for k, letters in enumerate(scripts.values()):
        item = "".join(chr(rng.choice(letters)) for _ in range(90))
        items.append((k, item))
        for edits in (0, 3, 5, 12):
            part = list(item)
            for at in rng.sample(range(90), edits):
                part[at] = chr(rng.choice(letters))
            rows.append((10 * k + edits if edits < 10 else 100 + k, f"xyz {''.join(part)} xyz"))
    docs, table = frame(rows), spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, table).collect()}
    want = {(d, i) for d, t in rows for i, x in items if holds(x, t)}
    assert set(found) == want and {(10 * k + e, k) for k in range(3) for e in (0, 3, 5)} <= want
    for k in range(3):
        exact = found[10 * k, k]
        assert (exact["start"], exact["length"], exact["item_start"], exact["item_length"], exact["edits"]) == (4, 90, 0, 90, 0)


def test_items_without_a_gram_are_compared_whole(frame, spark):
    table = spark.createDataFrame([(1, "Été"), (2, "yes"), (3, ""), (4, None), (5, "YES")], "item_id bigint, text string")
    docs = frame([(1, "yes"), (2, "oh yes"), (3, "éTÉ"), (4, ""), (5, None), (6, "yes ")])
    found = {(r["doc_id"], r["item_id"], r["length"], r["edits"]) for r in decontamination.contaminated(docs, table).collect()}
    assert found == {(1, 2, 3, 0), (1, 5, 3, 0), (3, 1, 3, 0)}
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, table).collect()) == [2, 4, 5, 6]


def test_blocks_of_the_benchmark_give_the_same(small, benchmark):
    whole = decontamination.contaminated(small, benchmark)
    parts = decontamination.contaminated(small, benchmark, block_bytes=2000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_clean_drops_leaks_only(frame, odd, empty, benchmark, spark):
    item = benchmark.first()["text"]
    rows = [(1, f"before {item} after"), (2, "before after"), (None, item), (3, None), (4, "")]
    docs = frame(rows)
    left = decontamination.clean(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(left.select("doc_id", "text").collect()) == [(2, "before after"), (3, None), (4, "")]
    assert decontamination.clean(odd, benchmark).count() == odd.count()
    assert decontamination.contaminated(empty, benchmark).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "short")], "item_id bigint, text string")
    assert decontamination.contaminated(docs, nothing).count() == 0
    assert decontamination.clean(docs, nothing).count() == 5


# --- toxicity


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12))
def test_block_max_search_is_exact(seed, k):
    rng = np.random.default_rng(seed)
    terms = 12

    def vector():
        t = np.sort(rng.choice(terms, rng.integers(1, 5), replace=False))
        w = rng.random(len(t)) + 0.1
        return t, w / np.sqrt((w**2).sum())

    rows = [vector() for _ in range(int(rng.integers(0, 60)))]
    index = toxicity.BlockMaxIndex(rows, terms, block=4)
    t, w = vector()
    dense = np.zeros(terms)
    dense[t] = w
    cosines = [float(sum(dense[a] * b for a, b in zip(*row))) for row in rows]
    want = sorted((n for n, c in enumerate(cosines) if c > 0 and n != 0), key=lambda n: (-round(cosines[n], 12), n))[:k]
    numbers, found = index.search(t, w, k, without=0)
    assert numbers.tolist() == want
    assert np.allclose(found, [cosines[n] for n in want])


def test_isotonic_is_increasing_and_calibrated():
    rng = np.random.default_rng(1)
    x = rng.random(4000)
    knots, values = toxicity.isotonic(x, (rng.random(4000) < x).astype(float))
    assert (np.diff(values) >= 0).all()
    assert abs(values[np.searchsorted(knots, 0.5)] - 0.5) < 0.1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.scored(docs, model)
    judged = scored.join(labels, "doc_id").filter("held_out").select("toxic", "predicted").collect()
    counts = Counter((r["toxic"], r["predicted"]) for r in judged)
    # A few junk texts are labelled toxic at random.
    assert counts[1, 1] >= 0.85 * (counts[1, 0] + counts[1, 1])
    assert counts[0, 1] <= 0.02 * (counts[0, 0] + counts[0, 1])
    some = scored.filter("size(neighbours) > 0").first()
    assert len(some["neighbours"]) == len(some["cosines"]) and some["cosines"] == sorted(some["cosines"], reverse=True)
    assert scored.count() == docs.count()


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (8, 0), (9, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.accepted(odd, model).columns == odd.columns
    assert toxicity.scored(empty, model).count() == 0
    unlabelled = toxicity.fit(odd, labels.limit(0))
    assert {(r["score"], r["predicted"]) for r in toxicity.scored(odd, unlabelled).collect()} == {(0.25, 0)}


def test_hold_out_rule(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"] for r in rows.filter(held_out(rows["doc_id"])).collect()}
    assert got == {k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0}
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] * 2, "doc_id bigint, toxic int")
    learned = training_labels(labels, "toxic").collect()
    assert len(learned) == 200 - len(got) and not got & {r["doc_id"] for r in learned}


# --- quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    judged = quality.scored(docs, model).join(labels, "doc_id").filter("held_out").collect()
    good = [r["predicted"] == r["quality"] for r in judged]
    assert sum(good) >= 0.95 * len(good)
    assert 0.6 < model.prior < 0.95  # about 0.85 of the documents are good


def test_prior_and_posterior_of_known_mixtures():
    rng = np.random.default_rng(2)
    positive = rng.normal(2, 1, 4000)
    unlabelled = np.concatenate([rng.normal(2, 1, 2400), rng.normal(-2, 1, 1600)])
    prior = quality.estimated_prior(positive, unlabelled)
    assert abs(prior - 0.6) < 0.06
    knots, values = quality.posteriors(positive, unlabelled, prior)
    assert (np.diff(values) >= -1e-12).all() and values[0] < 0.1 and values[-1] > 0.85


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(k, 1) for k in range(4, 9)] + [(None, 1), (9, None)], "doc_id bigint, quality int")
    model = quality.fit(odd, labels)
    rows = quality.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(empty, model).count() == 0
    assert quality.fit(empty, labels).score(np.zeros((2, quality.FEATURES))).tolist() == [0.5, 0.5]


def test_quality_where_every_row_has_a_label(spark):
    """The corpus serves as unlabelled text with its labels unseen: no constant score."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    assert len(rows) == docs.count() and len({r["score"] for r in rows}) > 5
    # Scores order good before bad far better than chance.
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) > 0.9 * len(good) * len(bad)


def test_quality_prior_and_density_count_every_row(spark):
    """Counts of all rows by Spark equal those of numpy over the whole table, whatever the sample."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = quality.featured(docs.unionByName(docs))
    x = quality._matrix([bytes(r["row"]) for r in table.collect()])
    mean, scale, network = x.mean(axis=0), x.std(axis=0) + 1e-3, quality.Network(quality.FEATURES)
    outputs = network.outputs((x - mean) / scale)
    for edges in (np.quantile(outputs, [0.1, 0.5, 0.9]), np.zeros(0)):
        want = [((outputs >= a) & (outputs < b)).sum() for a, b in zip([-np.inf, *edges], [*edges, np.inf])]
        assert quality._counted(table, mean, scale, network, edges).tolist() == want
    assert len(x) == 2 * docs.count()
    # Copies of a row are drawn once.
    drawn, places, share = quality._drawn(table, 10**9)
    assert share == 1 and len(drawn) == docs.select("doc_id", "text").distinct().count() and (np.diff(places) >= 0).all()


# --- sharding


@pytest.mark.parametrize("table", ["small", "odd"])
def test_virtual_slots(request, table):
    docs = request.getfixturevalue(table)
    rows = sharding.records(docs)
    slot_map = sharding.first_map(sharding.slot_bytes(rows))
    got = sharding.assigned(rows, slot_map).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows_of(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places, loads = defaultdict(list), Counter({s: 0 for s in range(40)})
    shard_of = {}
    for r in got:
        places[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        assert shard_of.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(loads) == 40
    if table == "small":
        assert max(loads.values()) <= max(1.05 * sum(loads.values()) / 40, max(r["size"] for r in got) + 64)


def test_a_grown_map_moves_slots_into_the_new_shard_only(small):
    slots = sharding.slot_bytes(sharding.records(small))
    first = sharding.first_map(slots, 4)
    second = sharding.grown_map(first, slots, 4)
    before = {r["virtual_slot"]: r["shard"] for r in first.collect()}
    after = {r["virtual_slot"]: r["shard"] for r in second.collect()}
    assert before.keys() == after.keys() == set(range(sharding.SLOTS))
    assert {after[s] for s in after if after[s] != before[s]} == {4}
    loads = Counter()
    for r in slots.collect():
        loads[after[r["virtual_slot"]]] += r["bytes"]
    assert max(loads.values()) < 1.3 * sum(loads.values()) / 5 and second.first()["version"] == 2


def test_kept_versions_of_a_map(spark, small, tmp_path):
    path = str(tmp_path / "map")
    with pytest.raises(ValueError):
        sharding.read_map(spark, path)
    rows = sharding.records(small)
    slots = sharding.slot_bytes(rows)
    assert sharding.save_map(sharding.first_map(slots, 4), path) == 1
    first = sharding.read_map(spark, path)
    assert sharding.save_map(sharding.grown_map(first, slots, 4), path) == 2
    with pytest.raises(ValueError):
        sharding.save_map(sharding.grown_map(first, slots, 4), path)
    with pytest.raises(ValueError):
        sharding.save_map(first.filter("false"), path)
    (tmp_path / "map" / "version=3").mkdir()  # a writing that broke off
    assert sharding.map_versions(spark, path) == [1, 2]
    last = sharding.read_map(spark, path)
    assert last.first()["version"] == 2 and sharding.read_map(spark, path, 1).first()["version"] == 1
    with pytest.raises(ValueError):
        sharding.read_map(spark, path, 3)
    # The records that change their shard are those of the moved slots, and all go to the new shard.
    moved = {r["virtual_slot"]: (r["from_shard"], r["to_shard"]) for r in sharding.moved_slots(first, last).collect()}
    assert moved and all(a != 4 and b == 4 for a, b in moved.values())
    before = {(r["doc_id"], r["virtual_slot"]): r["shard"] for r in sharding.assigned(rows, first).collect()}
    for r in sharding.assigned(rows, last).collect():
        old = before[r["doc_id"], r["virtual_slot"]]
        assert r["shard"] == (4 if r["virtual_slot"] in moved else old)


def test_virtual_slots_of_an_empty_table(empty):
    rows = sharding.records(empty)
    assert sharding.assigned(rows, sharding.first_map(sharding.slot_bytes(rows))).count() == 0


def test_sharding_plan_has_no_python(small):
    rows = sharding.records(small)
    plan = sharding.assigned(rows, sharding.first_map(sharding.slot_bytes(rows)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- pipeline


def test_pipeline_against_plain_versions(spark, benchmark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in benchmark.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.scored(docs, model).filter("predicted = 1").collect()}
    rows = [(d, t) for d, t in rows_of(docs) if d not in toxic]
    component = linked(rows)
    rows = [(d, t) for d, t in rows if component[d] == d]
    cut = cut_words(rows)
    rows = [(d, " ".join(cut[d, t][2]) if cut[d, t][1] else t) for d, t in rows if not 0 < cut[d, t][0] == cut[d, t][1]]
    short = {d for d, t in rows if any(normal(x) in normal(t) for x in items)}
    rows = [(d, t) for d, t in rows if d not in short]
    got = corpus_pipeline.run(spark, SF).collect()
    # Edited leaks may go too; they are few and hold up to the full alignment.
    gone = {d for d, _ in rows} - {r["doc_id"] for r in got}
    assert len(gone) <= 2 and all(any(holds(x, t) for x in items) for d, t in rows if d in gone)
    rows = [(d, t) for d, t in rows if d not in gone]
    ids = [e.ids for e in tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert_packed(got, [(d, [*i, 2]) for (d, _), i in zip(rows, ids)])


def test_stages_keep_the_columns_and_take_odd_rows(spark, odd, empty):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (odd, empty):
        docs = table.selectExpr("doc_id", "text", "lang", "rest AS source", "CAST(length(text) AS BIGINT) AS n_chars", "score")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.filter("piece = 0").count() == docs.count()
