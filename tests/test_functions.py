import pytest
from pyspark.sql import functions as F

from fingerspark.functions import containers, scoring, syscalls, timing
from fingerspark.functions.fixed import (
    CATEGORY_SYSCALLS,
    FEATURE_COUNT,
    FEATURE_NAMES,
    NETWORK_EVENT_SYSCALLS,
    PRIVILEGED_SYSCALLS,
    SYSCALL_NUMBERS,
)


def column(spark, values, ddl, expression):
    """Values of an expression over a one-column table, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_fixed_sets():
    assert FEATURE_COUNT == len(set(FEATURE_NAMES)) == 18
    assert len(SYSCALL_NUMBERS) == 68
    assert {c: len(v) for c, v in CATEGORY_SYSCALLS.items()} == {
        "FILE_IO": 20, "NETWORK": 15, "PROCESS": 16, "MEMORY": 8, "IPC": 9, "SECURITY": 9}
    assert len(NETWORK_EVENT_SYSCALLS) == 10 and len(PRIVILEGED_SYSCALLS) == 8
    every = [s for v in CATEGORY_SYSCALLS.values() for s in v]
    assert len(every) == len(set(every))


@pytest.mark.parametrize("name, category", [
    ("read", "FILE_IO"), ("openat", "FILE_IO"), ("connect", "NETWORK"), ("shutdown", "NETWORK"),
    ("execve", "PROCESS"), ("fork", "PROCESS"), ("mmap", "MEMORY"), ("epoll_wait", "IPC"),
    ("capget", "SECURITY"), ("ptrace", "SECURITY"), ("nonsense", "OTHER"), (None, "OTHER"),
    ("READ", "FILE_IO"), ("Connect", "NETWORK"), ("EXECVE", "PROCESS"),
])
def test_category(spark, name, category):
    assert column(spark, [name], "string", syscalls.syscall_category("v")) == [category]


def test_flags_are_narrower_than_categories(spark):
    names = ["accept4", "shutdown", "capget", "capset", None]
    assert column(spark, names, "string", syscalls.is_network_syscall("v")) == [True, False, False, False, False]
    assert column(spark, names, "string", syscalls.is_privileged_syscall("v")) == [False, False, False, True, False]


def test_syscall_name(spark):
    assert column(spark, [0, 435, 13], "int", syscalls.syscall_name("v")) == ["read", "clone3", "unknown_13"]


def test_address_and_protocol(spark):
    packed = 10 + (99 << 8) + (99 << 16) + (255 << 24)
    assert column(spark, [packed], "bigint", syscalls.dotted_address(F.col("v"))) == ["10.99.99.255"]
    assert column(spark, [6, 17, 1], "int", syscalls.protocol_name(F.col("v"))) == ["TCP", "UDP", "1"]


HEX = "0123456789abcdef" * 4


@pytest.mark.parametrize("line, expected", [
    (f"12:memory:/docker/{HEX}", HEX[:12]),
    (f"0::/system.slice/docker-{HEX}.scope\n", HEX[:12]),
    (f"0::/k/cri-containerd-{HEX}.scope", HEX[:12]),
    (f"0::/k/crio-{HEX}.scope", HEX[:12]),
    (f"0::/m/libpod-{HEX}.scope/container", HEX[:12]),
    (f"0::/m/libpod_{HEX}", HEX[:12]),
    (f"1:name=systemd:/sandbox/x{HEX}y/leaf", HEX[:12]),
    (f"0::/{'f' * 64}/{HEX}", HEX[:12]),
    (f"/plain/{HEX}", HEX[:12]),
    (f"0::/{HEX.upper()}", None),
    ("0::/user.slice/user-1000.slice", None),
    ("", None),
    (f"0::/{HEX[:63]}", None),
])
def test_cgroup_container_id(spark, line, expected):
    assert column(spark, [line], "string", containers.cgroup_container_id(F.col("v"))) == [expected]


@pytest.mark.parametrize("blob, image, namespace", [
    ("A=1\0IMAGE_NAME=x=y\0NAMESPACE=n", "x=y", "n"),
    ("IMAGE_NAME=\0CONTAINER_IMAGE=ci\0POD_NAMESPACE=p", "ci", "p"),
    ("MY_IMAGE_NAME=no\0IMAGE_NAME=a\0IMAGE_NAME=b\0K8S_NAMESPACE=k", "b", "k"),
    ("IMAGE_NAME", None, None),
    ("X=multi\nline\0NAMESPACE=n\nm", None, "n\nm"),
])
def test_environment(spark, blob, image, namespace):
    found = column(spark, [blob], "string", F.struct(
        containers.image_from_environment(F.col("v")), containers.namespace_from_environment(F.col("v"))))
    assert tuple(found[0]) == (image, namespace)


def test_scores_and_tiers(spark):
    raw = [-0.7, -1e-6, 0.0, 0.099999, 0.1, 0.25, 0.4, 0.9]
    score = scoring.unit_score(F.col("v"))
    assert [round(x, 6) for x in column(spark, raw, "double", score)] == [
        0.0, 0.499999, 0.5, 0.599999, 0.6, 0.75, 0.9, 1.0]
    assert column(spark, [0.499999, 0.5, 0.6, 0.75, 0.9, 1.0], "double", scoring.severity(F.col("v"))) == [
        "NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL"]
    assert column(spark, [0.5, 0.500001], "double", scoring.is_anomalous(F.col("v"))) == [False, True]


@pytest.mark.parametrize("rate, top, level", [
    (0.0, 0.9, "CRITICAL"), (0.3, 0.0, "CRITICAL"), (0.29, 0.75, "HIGH"), (0.15, 0.1, "HIGH"),
    (0.05, 0.1, "MEDIUM"), (0.0, 0.6, "MEDIUM"), (0.049, 0.59, "LOW")])
def test_risk(spark, rate, top, level):
    row = spark.createDataFrame([(rate, top)], "r double, t double")
    assert row.select(scoring.risk_level(F.col("r"), F.col("t"))).first()[0] == level


def test_clean_vector_and_length(spark):
    vector = [float("nan"), float("inf"), float("-inf"), -2.5]
    assert column(spark, [vector], "array<double>", scoring.clean_vector(F.col("v"))) == [[0.0, 0.0, 0.0, -2.5]]
    sizes = [[0.0] * 17, [0.0] * 18, None]
    assert column(spark, sizes, "array<double>", scoring.has_vector_length(F.col("v"))) == [False, True, False]


def test_csv_round_trip(spark):
    assert column(spark, [["a", "b"], []], "array<string>", scoring.csv_of(F.col("v"))) == ["a,b", None]
    assert column(spark, ["a,b"], "string", scoring.array_of_csv(F.col("v"))) == [["a", "b"]]


@pytest.mark.parametrize("minutes, expected", [(15, "12:45"), (7, "12:56"), (90, "12:00"), (1, "12:59")])
def test_minute_bucket(spark, minutes, expected):
    bucket = timing.minute_bucket(F.col("v").cast("timestamp_ntz"), minutes)
    assert column(spark, ["2024-01-01 12:59:30"], "string", F.date_format(bucket, "HH:mm")) == [expected]


def test_description(spark):
    df = spark.createDataFrame(
        [(0.8125, True, ["a", "b", "c", "d"], 7), (0.7, True, [], None), (0.2, False, ["a"], 1)],
        "s double, f boolean, c array<string>, n bigint")
    text = [r[0] for r in df.select(scoring.anomaly_description(*[F.col(c) for c in "sfcn"])).collect()]
    assert text[1:] == [
        "Anomalous behavior detected (score: 0.700). Window contained 0 events", "Normal behavior observed"]
    assert text[0].endswith("Top contributing features: a, b, c. Window contained 7 events")
