"""Mergeable host states: any roll-up equals the features of the sessions behind it."""

import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from test_features import frame, session

from hostloom.operators import features as X
from hostloom.operators import slices as T
from hostloom.operators import states as H

FIRST = T.Period("a", ends_by=40_000_000, keep_partial=True)
SECOND = T.Period("b", starts_from=50_000_000)


def log_rows(seed=3, count=600):
    rng = random.Random(seed)
    hosts = ["10.0.0.1"] * 6 + [f"10.0.1.{k}" for k in range(12)] + ["8.8.8.8", "fd00::1", None]
    rows = []
    for _ in range(count):
        start = rng.choice([0, 50_000_000]) + rng.randrange(9 * T.HOUR_MS)
        rows.append(
            session(
                rng.choice(hosts),
                rng.choice(hosts),
                source_port=rng.choice([None, 22, 443, 1024, 5000, 50_000, rng.randrange(65536)]),
                destination_port=rng.choice([None, 80, 443, 8080, 60_000]),
                source_bytes=rng.choice([None, 0, 10**8, rng.randrange(10**6)]),
                network_bytes=rng.choice([None, 10**7 + rng.randrange(9), rng.randrange(10**6)]),
                ip_protocol=rng.choice([None, 1, 6, 17]),
                first_packet=start,
                last_packet=start + rng.randrange(5000),
            )
        )
    return rows


def same(got, want, by):
    got, want = ({tuple(r[k] for k in by): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and len(want) > 5
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == (pytest.approx(value, rel=1e-9) if isinstance(value, float) else value), (key, name)


@pytest.fixture(scope="module")
def log(spark):
    return frame(spark, log_rows()).cache()


@pytest.mark.parametrize("band", ["as_written", "intended"])
def test_roll_ups_equal_features_of_the_sessions(spark, log, tmp_path, band):
    layout, path = T.slice_layout(log, (FIRST, SECOND)), str(tmp_path / "states")
    early = F.col("first_packet") < 50_000_000
    for part, name in ((early, "a"), (~early, "b")):
        H.add_part(log.filter(part), layout, path, name, band)
    states = H.read_states(spark, path, user_band=band)
    sliced = T.assign_slices(log, layout)
    assert 0 < sliced.count() < log.count()
    same(H.state_features(states), X.host_features(log, user_band=band), ["ip"])
    same(H.state_features(states, ["slice"]), X.host_features(sliced, ["slice"], band), ["slice", "ip"])
    some = F.col("slice").isin("a_2", "a_5", "b_1")
    same(H.state_features(states.filter(some)), X.host_features(sliced.filter(some), user_band=band), ["ip"])
    only = H.read_states(spark, path, "b", user_band=band)
    same(H.state_features(only), X.host_features(log.filter(~early), user_band=band), ["ip"])
    # Merging in steps changes nothing.
    same(H.state_features(H.merged(states, ["slice"])), H.state_features(states), ["ip"])


def test_moments_of_large_close_values(spark):
    """Far from zero a difference of sums of squares would lose every digit."""
    values = [10**12 + k * k % 7 for k in range(40)]
    rows = [session(network_bytes=v, first_packet=k, last_packet=k + 1) for k, v in enumerate(values)]
    log = frame(spark, rows).withColumn("slice", (F.col("first_packet") % 9).cast("string"))
    moments = H.merged(H.host_states(log, ["slice"])).moments.filter("ip = '10.0.0.2'").first()["network_bytes"]
    assert moments["n"] == 40
    assert moments["m2"] == pytest.approx(float(statistics.pvariance([Fraction(v) for v in values]) * 40), rel=1e-3)


def test_a_part_is_stored_once_and_must_exist(spark, log, tmp_path):
    layout, path = T.slice_layout(log, (FIRST, SECOND)), str(tmp_path / "states")
    with pytest.raises(ValueError):
        H.read_states(spark, path)
    H.add_part(log, layout, path, "a")
    with pytest.raises(ValueError):
        H.add_part(log, layout, path, "a")
    with pytest.raises(ValueError):
        H.read_states(spark, path, "b")
    with pytest.raises(ValueError):
        H.read_states(spark, path, user_band="intended")
    assert H.stored_parts(spark, path) == ["a"]


def test_a_broken_load_is_not_read_and_can_be_repeated(spark, log, tmp_path):
    layout, path = T.slice_layout(log, (FIRST, SECOND)), tmp_path / "states"
    H.add_part(log, layout, str(path), "a")
    broken = path / "as_written" / "moments" / "part=b"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"torn")
    assert H.stored_parts(spark, str(path)) == ["a"]
    same(H.state_features(H.read_states(spark, str(path))), X.host_features(log), ["ip"])
    H.add_part(log, layout, str(path), "b")
    assert H.stored_parts(spark, str(path)) == ["a", "b"]


def test_a_new_day_reads_only_itself(spark, log, tmp_path):
    path, layout = str(tmp_path / "states"), T.slice_layout(log, (FIRST, SECOND))
    for day, part in enumerate(("first_packet < 50000000", "first_packet >= 50000000")):
        log.filter(part).write.parquet(str(tmp_path / f"day{day}"))
        H.add_part(spark.read.parquet(str(tmp_path / f"day{day}")), layout, path, str(day))
    same(H.state_features(H.read_states(spark, path)), X.host_features(log), ["ip"])


def test_states_of_no_sessions(spark, log, tmp_path):
    layout, path = T.slice_layout(log, (FIRST, SECOND)), str(tmp_path / "states")
    H.add_part(log.filter("false"), layout, path, "none")
    assert H.state_features(H.read_states(spark, path)).collect() == []


def test_names_of_slices_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Stored states carry the names, their aggregates only the numbers."""
    from hostloom.plans import standin

    seen, whole = [], H.host_states
    monkeypatch.setattr(H, "host_states", lambda *args, **named: seen.append(whole(*args, **named)) or seen[-1])
    log = standin.sessions(spark, "/root/testdata/sf0.001")
    layout = T.slice_layout(log)
    H.add_part(log, layout, f"{tmp_path}/states", "all")
    assert "slice" not in seen[0].counts.columns and "slice" not in seen[0].moments.columns
    stored = H.read_states(spark, f"{tmp_path}/states")
    for table in (stored.counts, stored.moments):
        pairs = {(r["slice_no"], r["slice"]) for r in table.select("slice_no", "slice").distinct().collect()}
        assert pairs - {(None, None)} <= set(enumerate(layout.names, 1)) and len(pairs) > 10


def test_slices_of_one_part_are_not_summed_again(spark, log, tmp_path):
    layout, path = T.slice_layout(log, (FIRST, SECOND)), str(tmp_path / "states")
    early = F.col("first_packet") < 50_000_000
    for part, name in ((early, "a"), (~early, "b")):
        H.add_part(log.filter(part), layout, path, name)

    def summed(states, keys):
        plan = H.merged(states, keys).counts._jdf.queryExecution().optimizedPlan().toString()
        return "Aggregate" in plan

    states = H.read_states(spark, path)
    inside = states.filter("slice IS NOT NULL")
    assert not summed(inside, ["slice"]) and not summed(inside, ["slice_no"])
    # Sessions outside all slices are in both parts.
    assert summed(states, ["slice"]) and summed(states, ["part"]) and summed(states, [])
    # A further part with sessions of the same slices.
    H.add_part(log.filter(early), layout, path, "c")
    assert summed(H.read_states(spark, path).filter("slice IS NOT NULL"), ["slice"])
