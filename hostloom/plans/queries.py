"""The registered queries: name -> (spark, sf_dir) -> DataFrame.

Float results keep single precision on both sides of the comparison with the oracle (``rounded``); all
computing and storing before it is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostloom.functions.labels import is_blue
from hostloom.functions.ranges import standard_ranges
from hostloom.operators import dataset as D
from hostloom.operators import evaluation as E
from hostloom.operators import features as X
from hostloom.operators import models as M
from hostloom.operators import neighbours as N
from hostloom.operators import ports as P
from hostloom.operators import roles as R
from hostloom.operators import sessions as S
from hostloom.operators import slices as T
from hostloom.operators import states as H
from hostloom.plans import standin
from hostloom.schema import FACILITY_NAMES, FEATURE_GROUPS, FEATURES, GRAY, RED, ROLE_NAMES
from hostloom.session import new_table_path, stored
from hostloom.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]

# Arguments of the single-host operators.
HOST = "10.1.0.161"
SUBNET = "10.1.1."
SLICES = tuple(f"d{d}_{k}" for d in (1, 2) for k in range(1, 11))
# Edges of the one-host timeline.
TIMELINE_EDGES = (1461418200000, 1461454200031, 600000)
UNEVEN_EDGES = tuple(1461333600000 + 60_000 * k * k for k in range(40))
OVERLAP = 900_000
FURTHER_RANGES = (("10.1.0.0/16", True), ("10.1.0.128/25", False), ("10.1.0.160/30", True), ("8.8.1.0/24", False), ("fd00::/120", True))
FOLDS = (0, 1, 2, 3, 4)
OFF_TIES = 1.00000000321

_registry: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_registry)


def rounded(df: DataFrame) -> DataFrame:
    """Keep the 24 significant bits of single precision, for the comparison with the oracle only.

    The last digits of a variance depend on the order in which partial results are merged. A value is moved by three
    billionths first, so that one that lies exactly between two roundings falls on the same side everywhere.
    """
    floats = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: (F.col(c) * F.lit(OFF_TIES)).cast("float").cast("double") for c in floats})


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    return R.host_roles(standin.sessions(spark, sf), standin.host_labels(spark, sf))


def _layout(spark: SparkSession, sf: str) -> T.SliceLayout:
    return T.slice_layout(standin.sessions(spark, sf))


def _sliced(spark: SparkSession, sf: str, layout: T.SliceLayout | None = None) -> DataFrame:
    return T.assign_slices(standin.sessions(spark, sf), layout or _layout(spark, sf))


def _slice_features(spark: SparkSession, sf: str, layout: T.SliceLayout, only: DataFrame | None = None) -> DataFrame:
    """The 94 features per slice and host. Slices are grouped by number; the name, which follows from it, is not shuffled."""
    features = X.host_features(_sliced(spark, sf, layout), ["slice_no"], only=only)
    return T.name_slices(features, layout).select("slice", "ip", *FEATURES)


def _slice_labels(spark: SparkSession, sf: str, layout: T.SliceLayout | None = None) -> DataFrame:
    return T.slice_labels(standin.sessions(spark, sf), _roles(spark, sf), layout or _layout(spark, sf))


def _active_labels(spark: SparkSession, sf: str, layout: T.SliceLayout) -> DataFrame:
    """Labels of hosts in the slices they are active in; hosts with features in a slice are among them."""
    return T.active_slice_labels(standin.sessions(spark, sf), _roles(spark, sf), layout)


def _present_labels(spark: SparkSession, sf: str) -> DataFrame:
    layout = _layout(spark, sf)
    sliced = S.internal_sessions(_sliced(spark, sf, layout))
    present = S.mirror_sessions(sliced, "slice").select("slice", "ip").distinct()
    return X.labelled(present, _active_labels(spark, sf, layout), "label", ["slice"])


def _feature_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled hosts that have a feature row, with their role; written once, as class sizes and ranks both read it."""
    hosts = R.hosts(S.internal_sessions(standin.sessions(spark, sf)))
    return stored(hosts.join(_roles(spark, sf).select("ip", "red_vs_blue"), "ip"), "feature-hosts")


# --- sources and sinks


@_query
def session_scan(spark, sf):
    """Write the log as two daily CSVs in the reader's layout and scan them back."""
    raw = standin.sessions_raw(spark, sf)
    first_day = F.col("first_packet") < T.TWO_DAYS[1].starts_from
    days = []
    for name, part in (("day1", first_day), ("day2", ~first_day)):
        days.append(new_table_path(spark, f"sessions-csv-{name}"))
        writers.write_sessions_csv(raw.filter(part), days[-1])
    return readers.read_sessions_csv(spark, *days)


@_query
def slice_store_roundtrip(spark, sf):
    """Store slice features with one folder per slice and read the store back."""
    path = new_table_path(spark, "slice-store")
    writers.write_slices(X.pro_node_features(_sliced(spark, sf), ["slice"]), path)
    return rounded(readers.read_table(spark, path))


@_query
def public_list_from_disk(spark, sf):
    """Write the list of public addresses, read it from disk and leave its hosts out."""
    log, path = standin.sessions(spark, sf), new_table_path(spark, "public-ips")
    writers.write_csv(R.public_ips(log).withColumnRenamed("ip", "source.ip"), path)
    return S.internal_sessions(log, readers.read_public_ips(spark, path))


@_query
def fold_predictions_csv(spark, sf):
    """Write labels and predictions per fold and part without header and read them back."""
    rows = standin.predictions(spark, sf).select("y_true", "pred_a", "fold", F.lit("test").alias("part"))
    path = new_table_path(spark, "fold-predictions")
    writers.write_fold_predictions(rows, path)
    return spark.read.schema("y_true bigint, pred_a bigint, fold bigint, part string").csv(path)


@_query
def score_table_csv(spark, sf):
    """Write the accuracy table as CSV and read it back."""
    path = new_table_path(spark, "scores")
    writers.write_csv(E.accuracy_by_slice(standin.predictions(spark, sf), "y_true", "pred_a"), path)
    stored_scores = spark.read.option("header", True).csv(path)
    return rounded(
        stored_scores.select("slice", F.col("slice_no").cast("bigint"), F.col("accuracy").cast("double"))
    )


@_query
def label_table_csv(spark, sf):
    """Write the label table as CSV with header and read it back."""
    path = new_table_path(spark, "label-csv")
    writers.write_csv(_roles(spark, sf), path)
    return readers.read_host_labels(spark, path).select("ip", "hostname", "facility", "blue_team", "red_vs_blue")


# --- filters, projections, reshaping


@_query
def clean_sessions(spark, sf):
    return S.clean_sessions(standin.sessions_raw(spark, sf))


@_query
def internal_sessions(spark, sf):
    return S.internal_sessions(standin.sessions(spark, sf))


@_query
def internal_sessions_by_list(spark, sf):
    """The same filter with an explicit list of public addresses."""
    log = standin.sessions(spark, sf)
    return S.internal_sessions(log, R.public_ips(log))


@_query
def session_duration(spark, sf):
    log = S.session_duration(standin.sessions(spark, sf))
    return log.select("source_ip", "destination_ip", "first_packet", "last_packet", "duration")


@_query
def mirrored_sessions(spark, sf):
    mirrored = S.mirror_sessions(S.internal_sessions(standin.sessions(spark, sf)))
    return mirrored.drop("received")


@_query
def ip_octets(spark, sf):
    return rounded(X.ip_octet_means(standin.sessions(spark, sf)))


@_query
def slice_sessions(spark, sf):
    return _sliced(spark, sf).select("slice", "slice_no", "source_ip", "destination_ip", "first_packet")


@_query
def host_sessions(spark, sf):
    log = S.host_sessions(standin.sessions(spark, sf), HOST)
    return log.select("role", "source_ip", "destination_ip", "first_packet", "last_packet", "network_bytes")


@_query
def subnet_activity(spark, sf):
    return S.in_subnet(T.activity_hist(standin.sessions(spark, sf), _layout(spark, sf)), SUBNET)


@_query
def answered_sessions(spark, sf):
    log = S.answered_sessions(standin.sessions(spark, sf))
    return log.select("source_ip", "destination_ip", "first_packet", "destination_bytes")


@_query
def activity_hist_wide(spark, sf):
    return T.activity_hist_wide(standin.sessions(spark, sf), _layout(spark, sf))


@_query
def host_features(spark, sf):
    return rounded(X.host_features(standin.sessions(spark, sf)))


@_query
def feature_group_select(spark, sf):
    return rounded(X.select_group(X.host_features(standin.sessions(spark, sf)), "coarse"))


def _register_group(group: str) -> None:
    def select(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(X.select_group(X.host_features(standin.sessions(spark, sf)), group))

    _registry[f"feature_group_{group}"] = select


for _group in FEATURE_GROUPS:
    _register_group(_group)


@_query
def class_subset(spark, sf):
    names = {code: ROLE_NAMES[code] for code in (2, 3, 4)}
    return X.class_subset(_roles(spark, sf), "red_vs_blue", names).select("ip", "red_vs_blue", "class_name")


@_query
def facility_hostnames(spark, sf):
    return R.facility_hostnames(standin.host_labels(spark, sf), FACILITY_NAMES[3])


@_query
def misclassified(spark, sf):
    return E.misclassified(standin.predictions(spark, sf), "y_true", "pred_a", GRAY)


@_query
def accuracy_melt(spark, sf):
    matrix = E.accuracy_fold_matrix(standin.predictions(spark, sf), "y_true", "pred_a", FOLDS)
    return rounded(E.accuracy_melt(matrix))


@_query
def labelled_features(spark, sf):
    features = X.host_features(standin.sessions(spark, sf))
    return rounded(X.labelled(features, _roles(spark, sf), "red_vs_blue"))


@_query
def host_rows(spark, sf):
    features = X.pro_node_features(_sliced(spark, sf), ["slice"])
    return rounded(S.select_hosts(features, HOST, "10.2.0.2"))


# --- aggregations


@_query
def host_totals(spark, sf):
    return R.host_totals(standin.sessions(spark, sf))


@_query
def li_features(spark, sf):
    return rounded(X.li_features(standin.sessions(spark, sf)))


@_query
def li_features_intended(spark, sf):
    return rounded(X.li_features(standin.sessions(spark, sf), user_band="intended"))


@_query
def li_features_scaled(spark, sf):
    return rounded(X.li_features(standin.sessions(spark, sf), scale="sessions"))


@_query
def li_features_minmax(spark, sf):
    return rounded(X.li_features(standin.sessions(spark, sf), scale="minmax"))


@_query
def lyu_features(spark, sf):
    return rounded(X.lyu_features(standin.sessions(spark, sf)))


@_query
def pro_node_features(spark, sf):
    return rounded(X.pro_node_features(standin.sessions(spark, sf)))


@_query
def pro_edge_features(spark, sf):
    return rounded(X.pro_edge_features(standin.sessions(spark, sf)))


@_query
def port_value_counts(spark, sf):
    """The count lists of every host and series, one row per list entry with its position."""
    lists = P.port_value_counts(S.internal_sessions(standin.sessions(spark, sf)))
    entries = lists.select("ip", "series", F.posexplode("port_counts").alias("position", "entry"))
    return entries.select("ip", "series", "position", "entry.port", "entry.cnt")


@_query
def activity_hist(spark, sf):
    return T.activity_hist(standin.sessions(spark, sf), _layout(spark, sf))


@_query
def period_bounds(spark, sf):
    return T.period_bounds(standin.sessions(spark, sf))


@_query
def label_counts(spark, sf):
    return R.value_frequencies(_roles(spark, sf), "red_vs_blue")


@_query
def facility_list(spark, sf):
    return R.facility_list(standin.host_labels(spark, sf))


@_query
def host_timeline(spark, sf):
    log = standin.sessions(spark, sf)
    return T.timeline(log.filter(F.col("source_ip") == HOST), 200)


@_query
def host_timeline_edges(spark, sf):
    log = standin.sessions(spark, sf)
    return T.timeline_edges(log.filter(F.col("destination_ip") == HOST), *TIMELINE_EDGES)


@_query
def uneven_edge_hist(spark, sf):
    """Session starts by protocol over edges that lie ever further apart."""
    return T.edge_hist(standin.sessions(spark, sf), "first_packet", UNEVEN_EDGES, "protocol")


@_query
def interval_activity(spark, sf):
    """Sessions per host in intervals that overlap: each slice with a quarter of an hour on both sides."""
    log = standin.sessions(spark, sf)
    catalogue = T.slice_catalogue(log, T.slice_layout(log))
    intervals = catalogue.select(
        F.col("slice").alias("interval"),
        (F.col("start_ms") - OVERLAP).alias("start_ms"),
        (F.col("end_ms") + OVERLAP).alias("end_ms"),
    )
    inside = T.assign_intervals(log, intervals)
    return inside.groupBy("interval", F.col("source_ip").alias("ip")).agg(F.count("*").alias("n"))


@_query
def direction_hist(spark, sf):
    return T.direction_hist(standin.sessions(spark, sf), _layout(spark, sf))


def _compared_slices(spark: SparkSession, sf: str) -> DataFrame:
    layout = _layout(spark, sf)
    labels = stored(_active_labels(spark, sf, layout).filter(F.col("label").isin(RED, GRAY)), "compared")
    features = _slice_features(spark, sf, layout, only=labels)
    return D.class_comparison(features, labels, RED, GRAY)


@_query
def feature_density(spark, sf):
    return rounded(D.feature_density(_compared_slices(spark, sf), list(FEATURES)))


@_query
def feature_density_auto(spark, sf):
    compared = stored(_compared_slices(spark, sf), "compared-features")
    return rounded(D.automatic_density(compared, list(FEATURES)))


# --- port distributions


def _series(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.value_counts(S.internal_sessions(standin.sessions(spark, sf)), protocols=False)
    return P.port_series(P.gathered(counts))


@_query
def port_quartile_shares(spark, sf):
    return rounded(P.quartile_shares(_series(spark, sf)))


@_query
def port_count_spread(spark, sf):
    return rounded(P.count_spread(_series(spark, sf)))


@_query
def top5_ports(spark, sf):
    return P.top_ports(_series(spark, sf))


@_query
def port_distribution_features(spark, sf):
    return rounded(P.port_distribution(_series(spark, sf)))


# --- slices


@_query
def slice_features(spark, sf):
    return rounded(_slice_features(spark, sf, _layout(spark, sf)))


_state_stores: dict[tuple[str, str], str] = {}


def _states(spark: SparkSession, sf: str) -> H.HostStates:
    """States of the two days, each loaded from its own sessions; kept for the application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _state_stores:
        log, path = standin.sessions(spark, sf), new_table_path(spark, "host-states")
        first_day = F.col("first_packet") < T.TWO_DAYS[1].starts_from
        for period, part in zip(T.TWO_DAYS, (first_day, ~first_day)):
            day = log.filter(part)
            H.add_part(day, T.slice_layout(day, (period,)), path, period.name)
        _state_stores[key] = path
    return H.read_states(spark, _state_stores[key])


@_query
def host_features_from_states(spark, sf):
    """Features of the whole period, rolled up from the stored days."""
    return rounded(H.state_features(_states(spark, sf)))


@_query
def slice_features_from_states(spark, sf):
    return rounded(H.state_features(_states(spark, sf), ["slice"]))


@_query
def early_features_from_states(spark, sf):
    """Features over a set of slices: the first four of both days."""
    early = [f"{p.name}_{k}" for p in T.TWO_DAYS for k in range(1, 5)]
    return rounded(H.state_features(_states(spark, sf).filter(F.col("slice").isin(early))))


@_query
def day_features_from_states(spark, sf):
    """Features per day, sessions outside the slices included."""
    return rounded(H.state_features(_states(spark, sf), ["part"]))


@_query
def sessions_per_hour(spark, sf):
    log = standin.sessions(spark, sf)
    counts = X.lyu_features(log).select("ip", "sessions", "sessions_inc")
    return rounded(X.sessions_per_hour(counts, T.slice_layout(log).hours()))


@_query
def slice_catalogue(spark, sf):
    log = standin.sessions(spark, sf)
    return T.slice_catalogue(log, T.slice_layout(log))


@_query
def slice_labels(spark, sf):
    return _slice_labels(spark, sf)


@_query
def slice_labels_simple(spark, sf):
    return T.slice_labels(standin.sessions(spark, sf), _roles(spark, sf), _layout(spark, sf), simple=True)


@_query
def slice_labels_present(spark, sf):
    """Labels of the hosts that have a feature row in the slice."""
    return _present_labels(spark, sf)


@_query
def hosts_missing_activity(spark, sf):
    return T.hosts_missing_activity(standin.sessions(spark, sf), _layout(spark, sf))


@_query
def class_comparison(spark, sf):
    layout = _layout(spark, sf)
    features = X.pro_node_features(_sliced(spark, sf, layout), ["slice"])
    return rounded(D.class_comparison(features, _active_labels(spark, sf, layout), RED, GRAY))


# --- addresses and roles


@_query
def public_ips(spark, sf):
    return R.public_ips(standin.sessions(spark, sf))


def _ranges(spark: SparkSession) -> str:
    """Two versions of the range table on disk: the standard one, and one with further ranges inside those."""
    path = new_table_path(spark, "ranges")
    for version, rows in enumerate((standard_ranges(), standard_ranges() + list(FURTHER_RANGES)), 1):
        writers.write_ranges(spark.createDataFrame(rows, "cidr string, is_global boolean"), path, version)
    return path


@_query
def public_ips_by_ranges(spark, sf):
    return R.public_ips(standin.sessions(spark, sf), readers.read_ranges(spark, _ranges(spark), 1))


@_query
def public_ips_by_changed_ranges(spark, sf):
    return R.public_ips(standin.sessions(spark, sf), readers.read_ranges(spark, _ranges(spark)))


@_query
def internal_sessions_by_ranges(spark, sf):
    return S.internal_sessions(standin.sessions(spark, sf), ranges=readers.read_ranges(spark, _ranges(spark)))


@_query
def ipv4_hosts(spark, sf):
    return R.ipv4_hosts(standin.sessions(spark, sf))


@_query
def labelled_hosts(spark, sf):
    return R.labelled_hosts(standin.sessions(spark, sf))


@_query
def blue_team_flag(spark, sf):
    labels = standin.host_labels(spark, sf)
    return labels.select("ip", "blue_team", is_blue(F.col("blue_team")).alias("blue_team_bool"))


@_query
def ghost_hosts(spark, sf):
    return R.ghost_hosts(R.host_totals(standin.sessions(spark, sf)))


@_query
def ignored_hosts(spark, sf):
    return R.ignored_hosts(R.host_totals(standin.sessions(spark, sf)))


@_query
def real_hosts(spark, sf):
    return R.real_hosts(R.host_totals(standin.sessions(spark, sf)))


@_query
def host_roles(spark, sf):
    return _roles(spark, sf).select("ip", "blue_team_bool", "red_team", "red_vs_blue")


@_query
def facility_class(spark, sf):
    return R.facility_classes(_roles(spark, sf)).select("ip", "facility", "red_vs_blue", "facility_class")


# --- training sets


@_query
def class_weights(spark, sf):
    return rounded(D.class_weights(_feature_hosts(spark, sf), "red_vs_blue"))


@_query
def sample_weights(spark, sf):
    hosts = _feature_hosts(spark, sf).select("ip", "red_vs_blue")
    return rounded(D.with_weights(hosts, "red_vs_blue"))


@_query
def stratified_split(spark, sf):
    split = D.stratified_split(_feature_hosts(spark, sf), "red_vs_blue")
    return split.select("ip", "red_vs_blue", "part")


@_query
def stratified_folds(spark, sf):
    folds = D.stratified_folds(_feature_hosts(spark, sf), "red_vs_blue")
    return folds.select("ip", "red_vs_blue", "fold")


@_query
def slice_train_test(spark, sf):
    split = D.stratified_split(_feature_hosts(spark, sf), "red_vs_blue")
    return D.slice_train_test(_present_labels(spark, sf), split)


# --- evaluation


@_query
def classification_report(spark, sf):
    return rounded(E.classification_report(standin.predictions(spark, sf), "y_true", "pred_a"))


@_query
def macro_f1(spark, sf):
    return rounded(E.macro_f1(standin.predictions(spark, sf), "y_true", "pred_a"))


@_query
def confusion_matrix(spark, sf):
    return E.confusion_matrix(standin.predictions(spark, sf), "y_true", "pred_a")


@_query
def confusion_matrix_norm(spark, sf):
    return rounded(E.confusion_matrix(standin.predictions(spark, sf), "y_true", "pred_a", normalize=True))


@_query
def facility_confusion(spark, sf):
    """Role against facility class: six classes, of which some are never true."""
    hosts = R.facility_classes(_roles(spark, sf))
    return E.confusion_matrix(hosts, "red_vs_blue", "facility_class", classes=range(6))


@_query
def mismatches_by_host(spark, sf):
    return E.mismatches_by_host(standin.predictions(spark, sf), "y_true", "pred_a")


@_query
def model_vs_model(spark, sf):
    return E.confusion_matrix(standin.predictions(spark, sf), "pred_a", "pred_b")


@_query
def agreement_confusion(spark, sf):
    return E.agreement_confusion(standin.predictions(spark, sf), "y_true", "pred_a", "pred_b")


@_query
def accuracy_by_slice(spark, sf):
    return rounded(E.accuracy_by_slice(standin.predictions(spark, sf), "y_true", "pred_a"))


@_query
def accuracy_fold_matrix(spark, sf):
    return rounded(E.accuracy_fold_matrix(standin.predictions(spark, sf), "y_true", "pred_a", FOLDS))


@_query
def accuracy_over_time(spark, sf):
    return rounded(E.accuracy_over_time(standin.predictions(spark, sf), "y_true", "pred_a"))


@_query
def accuracy_band(spark, sf):
    return rounded(E.accuracy_band(standin.predictions(spark, sf), "y_true", "pred_a"))


@_query
def confused_hosts(spark, sf):
    return E.confused_hosts(standin.predictions(spark, sf), "y_true", "pred_a", GRAY, RED)


@_query
def repeat_hosts(spark, sf):
    return E.repeat_hosts(standin.predictions(spark, sf))


@_query
def merged_predictions(spark, sf):
    return E.merged_predictions(standin.predictions(spark, sf), "pred_a")


@_query
def merged_confusion(spark, sf):
    return rounded(E.merged_confusion(standin.predictions(spark, sf), "pred_a", _roles(spark, sf)))


# --- models
#
# Scores of fitted models are not determined by SQL. The queries return what is: who is scored, in which fold
# and part, that scores lie in their range and beat the majority class. The operators return the scores themselves.

_BOOSTED = M.Trees("boosted_trees")


def _training_table(spark: SparkSession, sf: str, label: str = "red_vs_blue") -> DataFrame:
    """Feature rows with label and fold; the rows are written once, as ranking and models re-read them."""
    labels = R.facility_classes(_roles(spark, sf)).select("ip", label)
    table = X.labelled(X.host_features(standin.sessions(spark, sf)), labels, label)
    return D.stratified_folds(stored(table, "features"), label)


def _slice_training_table(spark: SparkSession, sf: str, split: DataFrame, column: str) -> DataFrame:
    layout = _layout(spark, sf)
    features = _slice_features(spark, sf, layout)
    labels = _active_labels(spark, sf, layout)
    return stored(D.slice_train_test(features.join(labels, ["slice", "ip"]), split, column), "slice-training")


def _scored(predictions: DataFrame, *by: str) -> DataFrame:
    """Per fold and part: rows scored, macro-F1 within [0, 1], and above that of the largest class alone."""
    keys = [*by, "fold", "part"]
    counts = stored(E.pair_counts(predictions, "y_true", "y_pred", keys), "pair-counts")
    scores = E.macro_f1_of_counts(counts, keys)
    classes = counts.groupBy(*keys, "true").agg(F.sum("n").alias("n")).filter("n > 0")
    share = F.max("n") / F.sum("n")
    alone = classes.groupBy(*keys).agg(
        F.sum("n").alias("support"), (2 * share / (1 + share) / F.count("*")).alias("majority")
    )
    return scores.join(alone, keys).select(
        *by,
        F.col("fold").cast("bigint").alias("fold"),
        "part",
        "support",
        F.col("macro_f1").between(0, 1).alias("in_range"),
        (F.col("macro_f1") > F.col("majority")).alias("beats_majority"),
    )


def _training_rows(spark: SparkSession, sf: str, label: str = "red_vs_blue") -> DataFrame:
    """Assembled and weighted rows with their fold, as the model loops take them."""
    return stored(M.weighted(M.assembled(_training_table(spark, sf, label), label)), "training")


def _cross_validated(spark, sf, settings: M.Trees, label: str = "red_vs_blue") -> DataFrame:
    rows = _training_rows(spark, sf, label)
    return _scored(M.cross_validate(rows, settings))


@_query
def ml_decision_tree(spark, sf):
    return _cross_validated(spark, sf, M.Trees("decision_tree", depth=6))


@_query
def ml_random_forest(spark, sf):
    return _cross_validated(spark, sf, M.Trees("random_forest", depth=6))


@_query
def ml_boosted_trees(spark, sf):
    return _cross_validated(spark, sf, _BOOSTED)


@_query
def ml_facility(spark, sf):
    return _cross_validated(spark, sf, _BOOSTED, "facility_class")


def _depth_grid(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    grid = M.depth_grid(_training_rows(spark, sf), [M.Trees(kind) for kind in kinds])
    test, train = F.col("mean_test_score"), F.col("mean_train_score")
    return grid.select(
        "kind",
        F.col("max_depth").cast("bigint").alias("max_depth"),
        (test.between(0, 1) & train.between(0, 1)).alias("in_range"),
        (F.abs(F.col("test_vs_train") - (test - train)) < 1e-9).alias("consistent"),
    )


@_query
def ml_depth_grid(spark, sf):
    """All depths the library can fit, all folds, the two kinds whose fits do not depend on rounds."""
    return _depth_grid(spark, sf, "decision_tree", "random_forest")


@_query
def ml_depth_grid_boosted(spark, sf):
    """The third kind of the grid, at every depth of the grid; max_depth is null where it is unlimited."""
    return _depth_grid(spark, sf, "boosted_trees")


@_query
def ml_ablation(spark, sf):
    table = stored(_training_table(spark, sf), "training")
    return _scored(M.ablation(table, "red_vs_blue", _BOOSTED), "feature_group")


@_query
def ml_feature_importance(spark, sf):
    """Ten features of every fold's model, by rank: known names, importances that fall and sum to at most 1."""
    rows = _training_rows(spark, sf)
    top = M.fold_importances(rows, _BOOSTED)
    fold = Window.partitionBy("fold")
    ranked = top.withColumns(
        {
            "rank": F.row_number().over(fold.orderBy(F.desc("importance"), "feature")).cast("bigint"),
            "total": F.sum("importance").over(fold),
        }
    )
    return ranked.select(
        F.col("fold").cast("bigint").alias("fold"),
        "rank",
        F.col("feature").isin(*FEATURES).alias("known"),
        (F.col("importance").between(0, 1) & (F.col("total") <= 1.000001)).alias("in_range"),
    )


def _both_models(spark: SparkSession, sf: str, refit: bool) -> DataFrame:
    """Per slice of every fold: rows of classes beyond 1 scored by both models, accuracies within [0, 1]."""
    static = stored(_training_table(spark, sf), "training")
    sliced = _slice_training_table(spark, sf, static, "fold")
    rows = M.assembled(static, "red_vs_blue")
    scored = M.static_vs_slice_folds(rows, M.assembled(sliced, "label"), _BOOSTED, static_model=None if refit else True)
    hit = {c: F.avg((F.col("y_true") == F.col(c)).cast("int")).between(0, 1) for c in ("pred_static", "pred_slice")}
    return (
        scored.filter("y_true > 1")
        .groupBy("slice", F.col("slice_no").cast("bigint").alias("slice_no"), F.col("fold").cast("bigint").alias("fold"))
        .agg(
            F.count("*").alias("support"),
            hit["pred_static"].alias("static_in_range"),
            hit["pred_slice"].alias("slice_in_range"),
        )
    )


@_query
def ml_static_vs_slice(spark, sf):
    """The whole-period model is fitted anew per fold."""
    return _both_models(spark, sf, refit=True)


@_query
def ml_static_vs_slice_as_written(spark, sf):
    """One whole-period model for all folds; hosts held out of a fold were among its training hosts."""
    return _both_models(spark, sf, refit=False)


@_query
def ml_fold_reports(spark, sf):
    """Support per class, fold and part of the reports on real predictions, and scores within [0, 1]."""
    predictions = M.cross_validate(_training_rows(spark, sf), _BOOSTED)
    report = E.classification_report(predictions, "y_true", "y_pred", ["fold", "part"])
    ranges = [F.col(c).between(0, 1) for c in ("precision", "recall", "f1")]
    rows = report.filter((F.col("support") > 0) & F.col("label").rlike("^[0-9]+$"))
    return rows.select(
        F.col("fold").cast("bigint").alias("fold"),
        "part",
        F.col("label").cast("bigint").alias("class"),
        "support",
        (ranges[0] & ranges[1] & ranges[2]).alias("in_range"),
    )


def _compared_hosts(spark: SparkSession, sf: str) -> DataFrame:
    names = {code: ROLE_NAMES[code] for code in (2, 3, 4)}
    table = X.class_subset(_training_table(spark, sf), "red_vs_blue", names)
    return M.assembled(table, "red_vs_blue")


def _neighbours(rows: DataFrame) -> DataFrame:
    return N.neighbour_graph(rows.select("ip", vector_to_array("features").alias("vector")), "ip", "vector")


@_query
def ml_neighbour_graph(spark, sf):
    """The 15 nearest hosts of every compared host under the cosine distance of their features."""
    return _neighbours(_compared_hosts(spark, sf))


@_query
def ml_neighbour_projection(spark, sf):
    """Two axes that keep near hosts near: laid out from the neighbour graph, beginning with the principal axes."""
    rows = stored(_compared_hosts(spark, sf), "compared-hosts")
    weights = N.neighbour_weights(stored(_neighbours(rows), "neighbours"), "ip")
    places = N.neighbour_layout(M.projection(rows, "ip"), weights, "ip")
    return rows.select("ip", "class_name").join(places, "ip")


@_query
def ml_projection(spark, sf):
    rows = _compared_hosts(spark, sf)
    axes = [F.abs(F.col(c)) <= 1.000001 for c in ("x", "y")]  # of vectors of unit length
    return M.projection(rows, "ip", "class_name").select("ip", "class_name", (axes[0] & axes[1]).alias("in_range"))
