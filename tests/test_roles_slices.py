from test_features import frame, session

from hostloom.functions.labels import is_blue
from hostloom.operators import roles as R
from hostloom.operators import slices as T
from hostloom.schema import LABEL_SCHEMA

HOUR = T.HOUR_MS


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), LABEL_SCHEMA)


def test_every_role(spark):
    log = frame(
        spark,
        [
            session("10.0.0.1", "10.0.0.2", source_bytes=0, destination_bytes=0),  # neither ever sent or received
            session("10.0.0.3", "10.0.0.4", source_bytes=5, destination_bytes=0),  # 3 never gets anything, 4 never sends
            session("10.0.0.5", "10.0.0.6", source_bytes=5, destination_bytes=5),
            session("10.0.0.7", "10.0.0.6", source_bytes=5, destination_bytes=5),
        ],
    )
    inventory = labels(
        spark,
        *[(f"10.0.0.{i}", f"h{i}", "Corporate", "BT1" if i == 6 else "None", i == 5) for i in range(1, 9)],
        ("8.8.8.8", "public", "Corporate", "None", True),
        ("fd00::1", "v6", "Corporate", "None", True),
    )
    roles = {r.ip: r.red_vs_blue for r in R.host_roles(log, inventory).collect()}
    # 1, 2 are in both silent groups: 0 wins. 8 has no traffic: 1. Public and IPv6 hosts have no role.
    want = {1: 0, 2: 0, 3: 1, 4: 0, 5: 2, 6: 3, 7: 4, 8: 1}
    assert roles == {f"10.0.0.{i}": code for i, code in want.items()}
    totals = R.host_totals(log)
    assert {r.ip for r in R.real_hosts(totals).collect()} == {"10.0.0.5", "10.0.0.6", "10.0.0.7"}


def test_facility_class(spark):
    rows = [(0, "Corporate", 0), (1, "Other", 1), (2, "Corporate", 2), (3, "Confidential Data Storage", 3)]
    rows += [(4, "Cyprus Creek Campus", 4), (4, "Power Plant", 5), (4, None, 5)]
    df = spark.createDataFrame(rows, "red_vs_blue bigint, facility string, want bigint")
    assert all(r.want == r.facility_class for r in R.facility_classes(df).collect())


PERIODS = (T.Period("a", ends_by=50 * HOUR, keep_partial=True), T.Period("b", starts_from=40 * HOUR))


def log_at(spark, *times, **values):
    return frame(spark, [session(first_packet=t, last_packet=t + 1, **values) for t in times])


def test_edges_are_closed_on_the_right(spark):
    start_b = 60 * HOUR
    times = [0, 1, HOUR, HOUR + 1, 2 * HOUR + 5, start_b, start_b + HOUR, start_b + HOUR + 1, start_b + 2 * HOUR + 9]
    log = log_at(spark, *times)
    layout = T.slice_layout(log, PERIODS)
    # Period a keeps its partial third hour, period b drops it.
    assert layout.names == ["a_1", "a_2", "a_3", "b_1", "b_2"]
    placed = {r.first_packet: (r.slice, r.slice_no) for r in T.assign_slices(log, layout).collect()}
    assert placed == {
        1: ("a_1", 1),
        HOUR: ("a_1", 1),
        HOUR + 1: ("a_2", 2),
        2 * HOUR + 5: ("a_3", 3),
        start_b + HOUR: ("b_1", 4),
        start_b + HOUR + 1: ("b_2", 5),
    }
    catalogue = {r.slice: (r.slice_no, r.start_ms, r.end_ms) for r in T.slice_catalogue(log, layout).collect()}
    assert catalogue["a_3"] == (3, 2 * HOUR, 3 * HOUR)
    assert catalogue["b_1"] == (4, start_b, start_b + HOUR)
    assert sum(r.n for r in T.activity_hist(log, layout).collect()) == 2 * len(placed)
    wide = T.activity_hist_wide(log, layout)
    assert wide.columns == ["ip", *layout.names] and wide.count() == 2


def test_starts_round_half_to_even_hundreds(spark):
    for first, rounded in ((150, 200), (250, 200), (251, 300), (249, 200)):
        assert T.period_bounds(log_at(spark, first), PERIODS).first()["a_start"] == rounded


def test_missing_period_has_no_slices(spark):
    layout = T.slice_layout(log_at(spark, 0, HOUR + 1), PERIODS)
    assert layout.names == ["a_1", "a_2"]


def test_slice_labels_every_branch(spark):
    t = HOUR // 2
    rows = [
        session("10.0.0.1", "10.0.0.2", first_packet=0, last_packet=1),  # marks the period start, in no slice
        # Slice 1: 2 only receives and never replies there, though it replied before: 0.
        session("10.0.0.1", "10.0.0.2", destination_bytes=0, first_packet=t, last_packet=t + 1),
        # Slice 1: 3 sends without answer, though it was answered in slice 2: 1.
        session("10.0.0.3", "10.0.0.4", destination_bytes=0, first_packet=t, last_packet=t + 1),
        session("10.0.0.3", "10.0.0.2", first_packet=HOUR + t, last_packet=HOUR + t + 1),
        # 5 never gets anything in the whole log: its activity counts, so it keeps its role.
        session("10.0.0.5", "10.0.0.4", destination_bytes=0, first_packet=t, last_packet=t + 1),
    ]
    log = frame(spark, rows)
    layout = T.slice_layout(log, PERIODS)
    roles = spark.createDataFrame([(f"10.0.0.{i}", 4) for i in range(1, 7)], "ip string, red_vs_blue bigint")
    got = {(r.ip[-1], r.slice): r.label for r in T.slice_labels(log, roles, layout).collect()}
    assert got == {
        ("1", "a_1"): 1,
        ("1", "a_2"): -1,
        ("2", "a_1"): 0,
        ("2", "a_2"): 4,
        ("3", "a_1"): 1,
        ("3", "a_2"): 4,
        ("4", "a_1"): 4,  # never replied anywhere: no such record
        ("4", "a_2"): -1,
        ("5", "a_1"): 4,
        ("5", "a_2"): -1,
        ("6", "a_1"): -1,
        ("6", "a_2"): -1,
    }
    simple = {(r.ip[-1], r.slice): r.label for r in T.slice_labels(log, roles, layout, simple=True).collect()}
    assert simple == {k: (-1 if v == -1 else 4) for k, v in got.items()}
    missing = {r.ip[-1]: (r.missing_ur, r.missing_ig) for r in T.hosts_missing_activity(log, layout).collect()}
    assert missing == {"4": (True, False), "5": (False, True)}


def test_timelines(spark):
    log = log_at(spark, 0, 10, 99, 100)
    assert {r.bin: r.n for r in T.timeline(log, 10).collect()} == {0: 1, 1: 1, 9: 2}
    assert {r.bin: r.n for r in T.timeline(log_at(spark, 5, 5), 10).collect()} == {0: 2}
    # Edges 0, 50, 100: the last bin holds its right edge.
    assert {r.bin: r.n for r in T.timeline_edges(log, 0, 101, 50).collect()} == {0: 2, 1: 2}


def test_a_missing_team_is_a_team(spark):
    df = spark.createDataFrame([("None",), ("BT1",), (None,)], "blue_team string")
    assert [r[0] for r in df.select(is_blue(df.blue_team)).collect()] == [False, True, True]
