import os

import pytest

from test_features import frame, random_sessions, session

from hostloom.schema import SESSION_CSV_NAMES, SESSION_SCHEMA
from hostloom.session import stored
from hostloom.sources import readers, writers


def test_sessions_csv_round_trip(spark, tmp_path):
    log = frame(spark, random_sessions(8, 200))
    writers.write_sessions_csv(log, f"{tmp_path}/day1")
    writers.write_sessions_csv(log.limit(5), f"{tmp_path}/day2")
    back = readers.read_sessions_csv(spark, f"{tmp_path}/day1", f"{tmp_path}/day2")
    assert back.schema.simpleString() == SESSION_SCHEMA.simpleString()
    assert back.count() == 205
    assert sorted(map(repr, back.collect()))[::41] == sorted(map(repr, log.union(log.limit(5)).collect()))[::41]


def test_columns_are_found_by_name_and_odd_numbers_are_null(spark, tmp_path):
    row = session(source_port="NaN", destination_port="443.0", source_bytes="9007199254740993", destination_bytes="")
    names = list(reversed(SESSION_CSV_NAMES))
    header = ",".join(["totDataBytes"] + [SESSION_CSV_NAMES[n] for n in names])
    (tmp_path / "a.csv").write_text(header + "\n" + ",".join(["1"] + [str(row[n]) for n in names]) + "\n")
    r = readers.read_sessions_csv(spark, f"{tmp_path}/a.csv").first()
    assert (r.source_port, r.destination_port) == (None, 443)
    assert (r.source_bytes, r.destination_bytes) == (9007199254740993, None)
    assert (r.source_ip, r.first_packet) == (row["source_ip"], row["first_packet"])


def test_lists_and_labels(spark, tmp_path):
    (tmp_path / "public.csv").write_text("source.ip\n8.8.8.8\n")
    assert readers.read_public_ips(spark, f"{tmp_path}/public.csv").first().ip == "8.8.8.8"
    (tmp_path / "labels.csv").write_text(
        "ip,red_team,blue_team,hostname,facility,red_vs_blue\n10.0.0.1,True,None,h,Corporate,2\n"
    )
    r = readers.read_host_labels(spark, f"{tmp_path}/labels.csv").first()
    assert (r.red_team, r.blue_team, r.red_vs_blue) == (True, "None", 2)


def test_slice_store_reads_one_slice(spark, tmp_path):
    df = spark.createDataFrame([(f"d1_{i % 4}", f"10.0.0.{i}", float(i)) for i in range(200)], "slice string, ip string, x double")
    writers.write_slices(df, f"{tmp_path}/store")
    assert {d for d in os.listdir(f"{tmp_path}/store") if d.startswith("slice=")} == {f"slice=d1_{i}" for i in range(4)}
    one = readers.read_table(spark, f"{tmp_path}/store").filter("slice = 'd1_2'")
    assert one.count() == 50
    assert all("slice=d1_2" in f for f in one._jdf.queryExecution().optimizedPlan().toString().split() if "slice=d1" in f)


def test_fold_predictions_and_stored_tables(spark, tmp_path):
    df = spark.createDataFrame([(0, "test", "10.0.0.1", 2, 3)], "fold int, part string, ip string, y_true int, y_pred int")
    writers.write_fold_predictions(df, f"{tmp_path}/folds")
    files = os.listdir(f"{tmp_path}/folds/fold=0/part=test")
    text = next(open(f"{tmp_path}/folds/fold=0/part=test/{f}").read() for f in files if f.endswith(".csv"))
    assert text.strip() == "10.0.0.1,2,3"
    kept = stored(df, "t")
    assert kept.collect() == df.collect()
    assert "ExistingRDD" not in kept._jdf.queryExecution().toString()


def test_files_of_a_folder_with_different_headers_are_an_error(spark, tmp_path):
    names = [*SESSION_CSV_NAMES.values()]
    row = {n: "7" for n in names} | {"source.ip": "10.0.0.1", "destination.ip": "10.0.0.2"}
    for k, order in enumerate((names, names[::-1])):
        lines = [",".join(order), ",".join(row[n] for n in order)]
        (tmp_path / f"{k}.csv").write_text("\n".join(lines) + "\n")
    with pytest.raises(Exception, match="header"):
        readers.read_sessions_csv(spark, str(tmp_path)).collect()
    apart = readers.read_sessions_csv(spark, *(str(tmp_path / f"{k}.csv") for k in (0, 1))).collect()
    assert len(apart) == 2 and apart[0] == apart[1] and apart[0].source_port == 7
