"""Chunked ordered work must equal plain windows, also when one group holds most rows."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from siftline.operators import ordered, ranking, summary


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if i % 3 else rnd.choice(["a", "b", "c", None])
        data.append((key, rnd.randrange(300), i, float(rnd.randrange(50))))
    return spark.createDataFrame(data, "k string, o int, id int, v double").cache(), data


def grouped(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in out.items()}


@pytest.mark.parametrize("bound", [0, 10**6])
def test_running(skewed, bound):
    df, data = skewed
    got = {r["id"]: (r["row_no"], r["s"]) for r in ordered.running(df, ["k"], ["o", "id"], {"s": F.col("v")}, bound=bound).collect()}
    for members in grouped(data).values():
        total = 0.0
        for n, r in enumerate(members, start=1):
            total += r[3]
            assert got[r[2]] == (n, total)


@pytest.mark.parametrize("bound", [0, 10**6])
def test_global_number_and_descending(skewed, bound):
    df, data = skewed
    got = [r["id"] for r in ordered.number_rows(df, [], [F.col("v").desc(), "id"], bound=bound).orderBy("row_no").collect()]
    assert got == [r[2] for r in sorted(data, key=lambda r: (-r[3], r[2]))]


@pytest.mark.parametrize("bound", [0, 10**6])
def test_lagged(skewed, bound):
    df, data = skewed
    got = {r["id"]: (r["prev_id"], r["prev_v"]) for r in ordered.lagged(df, ["k"], ["o", "id"], ["id", "v"], bound=bound).collect()}
    for members in grouped(data).values():
        prev = (None, None)
        for r in members:
            assert got[r[2]] == prev
            prev = (r[2], r[3])


def test_medians(skewed):
    df, data = skewed
    got = {r["k"]: (r["median_v"], r["median_o"]) for r in ordered.medians(df, ["k"], ["v", "o"]).collect()}
    for k, members in grouped(data).items():
        assert got[k] == (statistics.median(r[3] for r in members), statistics.median(r[1] for r in members))


@pytest.mark.parametrize("bound", [0, 150, 10**6])
def test_medians_of_small_and_large_groups(skewed, bound):
    df, data = skewed
    wide = df.withColumns({"none": F.lit(None).cast("double"), "some": F.when(F.col("id") % 2 == 0, F.col("v"))})
    plan = ordered.medians(wide, ["k"], ["v", "some", "none"], bound)
    got = {r["k"]: tuple(r)[1:] for r in plan.collect()}
    assert len(got) == len(grouped(data))
    for k, members in grouped(data).items():
        assert got[k] == (statistics.median(r[3] for r in members), statistics.median(r[3] for r in members if r[2] % 2 == 0), None)
    if bound == 10**6:  # rows are moved once; the other shuffle is of the sizes of groups
        final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("Exchange hashpartitioning") <= 2


@pytest.mark.parametrize("size", [1, 5, 150, 10**5])
def test_digest(skewed, size):
    df, data = skewed
    got = {r["k"]: (r["n_rows"], r["digest"]) for r in ordered.chunk_digest(df, ["k"], ["o", "id"], F.col("id").cast("string"), size).collect()}

    for k, members in grouped(data).items():
        lines = [str(r[2]) for r in members]
        for n in (size, len(lines)):  # runs of lines, then all run digests
            lines = [hashlib.sha256(("\n".join(lines[i:i + n]) + "\n").encode()).hexdigest() for i in range(0, len(lines), n)]
        assert got[k] == (len(members), lines[0])


def test_set_digest_ignores_order(spark):
    a = spark.createDataFrame([("x",), ("b",), ("a",)], "id string")
    want = hashlib.sha256((hashlib.sha256(b"a\nb\nx\n").hexdigest() + "\n").encode()).hexdigest()
    assert summary.set_digest(a, "id").first()["digest"] == want
    assert summary.set_digest(a.orderBy(F.desc("id")), "id").first()["digest"] == want


def test_empty(spark):
    df = spark.createDataFrame([], "k string, o int")
    for bound in (0, 10):
        assert ordered.number_rows(df, ["k"], ["o"], bound=bound).count() == 0
        assert ordered.lagged(df, ["k"], ["o"], ["o"], bound=bound).count() == 0
    assert ranking.compress_ranges(df, ["k"], "o").count() == 0


def test_islands(spark, rows):
    df = spark.createDataFrame([("a", v) for v in (3, 1, 2, 2, 7)] + [("b", 5)], "k string, i int")
    assert rows(ranking.compress_ranges(df, ["k"], "i")) == [("a", "1..3,7"), ("b", "5")]


def test_null_and_even_medians(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", None)], "k string, v double")
    got = {r["k"]: r["median_v"] for r in ordered.medians(df, ["k"], ["v"]).collect()}
    assert got.get("a") == 1.5 and got.get("b") is None


def test_medians_of_all_doubles(spark):
    rng, inf = random.Random(7), float("inf")
    tiny = [5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.0, -0.0, inf, -inf]
    draw = {
        "near": lambda: 100 + rng.random() * 1e-9, "wide": lambda: rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1074, 1023), "edges": lambda: rng.choice(tiny) * rng.choice([-1, 1]),
        "powers": lambda: 2.0 ** rng.randint(-1070, 1020) * (1 + rng.choice([0, 2**-52, -(2**-53)])), None: lambda: float(rng.randint(-3, 3)), "one": lambda: 7.5,
    }
    data = [(k, f()) for k, f in draw.items() for _ in range(rng.choice([200, 301]))]
    df = spark.createDataFrame(data, "k string, v double")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    plan = ordered.medians(df, ["k"], ["v"])
    assert not jobs.getJobIdsForGroup("plan")  # nothing runs before the action
    got = {r["k"]: r["median_v"] for r in plan.collect()}
    spark.sparkContext.setJobGroup("tests", "tests")
    for k in draw:
        own = sorted(v for g, v in data if g == k)
        assert got[k] == 0.5 * own[(len(own) - 1) // 2] + 0.5 * own[len(own) // 2], k
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert ordered.medians(nan, [], ["v"]).first()["median_v"] == 2.0
