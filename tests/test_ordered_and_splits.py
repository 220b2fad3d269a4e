import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.operators import canonical as K
from flowlake.operators import splits as SP
from flowlake.plans import ordered as O
from flowlake.plans.bounded import in_lists, localized
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def flows(spark):
    """Seven files; one holds a third of the rows, one class most of them."""
    rng = random.Random(7)
    rows = []
    for f in range(7):
        for i in range(200 if f == 0 else 60 + f):
            rows.append((f"f{f}", "2017" if f < 4 else "2018", i * 3 + f,
                         rng.choices(["a", "b", "c"], [8, 3, 1])[0]))
    rows.append(("f6", "2018", 10_000, "single"))
    rng.shuffle(rows)
    return spark.createDataFrame(
        rows, f"Source_File string, Dataset string, {S.ROW_ORD} long, `Attack Type` string").cache()


def rows_of(df):
    return [tuple(r) for r in df.select("Source_File", S.ROW_ORD, "split").collect()]


@pytest.mark.parametrize("shift,largest", [(O.ROW_SHIFT, 1 << 20), (4, 1 << 20), (30, 2), (52, 1)])
def test_rank_cuts(spark, shift, largest):
    """Any chunk size, and refinement of large chunks, find the same order values."""
    rng = random.Random(1)
    data = {g: rng.sample(range(-10**15, 10**15), n) for g, n in (("x", 400), ("y", 7), ("z", 1))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v long")
    ranks = {("x", 0): 137, ("x", 1): 400, ("y", 0): 1, ("y", 1): 0, ("z", 0): 1}
    targets = spark.createDataFrame([(g, i, k) for (g, i), k in ranks.items()],
                                    "g string, cut_id int, rank long")
    cuts = O.rank_cuts(df, ["g"], ["v"], targets, shift, max_chunk_rows=largest)
    got = {(r["g"], r["cut_id"]): r["cut"]["o0"] for r in cuts.collect()}
    want = {k: sorted(data[k[0]])[n - 1] if n else -(1 << 63) for k, n in ranks.items()}
    assert got == want


def test_running_before(spark):
    rng = random.Random(2)
    data = [(g, i, rng.randrange(50), rng.randrange(9)) for i in range(300) for g in ("p", "q")]
    df = spark.createDataFrame(data, "g string, i int, v int, n long")
    got = O.running_before(df, ["g"], F.floor(F.col("v") / 7), ["v", "i"], ["n"]).collect()
    for g in ("p", "q"):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["v"], r["i"])):
            assert r["before_n"] == total
            total += r["n"]


def test_large_sides_are_stored(spark):
    df = spark.range(10)
    assert "LocalTableScan" in plan_of(localized(df, 10))
    assert "LocalTableScan" not in plan_of(localized(df, 9))
    assert localized(df, 9).count() == 10


@pytest.mark.parametrize("strategy", SP.STRATEGIES)
def test_every_split_is_a_partition(flows, strategy):
    got = rows_of(SP.assign_split(flows, strategy))
    assert Counter(r[:2] for r in got) == Counter(
        (r["Source_File"], r[S.ROW_ORD]) for r in flows.collect())
    assert {r[2] for r in got} == {"train", "test"}
    if strategy in ("file_holdout", "file", "mixed_holdout"):
        sides = defaultdict(set)
        for f, _, s in got:
            sides[f].add(s)
        assert all(len(s) == 1 for s in sides.values())


def test_positions(flows):
    got = defaultdict(list)
    for f, i, s in sorted(rows_of(SP.assign_split(flows, "per_file"))):
        got[f].append(s)
    for sides in got.values():
        n = int(0.7 * len(sides))
        assert sides == ["train"] * n + ["test"] * (len(sides) - n)
    ordered = [s for _, _, s in sorted(rows_of(SP.assign_split(flows, "temporal")))]
    n = int(0.8 * len(ordered))
    assert ordered == ["train"] * n + ["test"] * (len(ordered) - n)


def test_seeded_files(flows):
    names = [f"f{i}" for i in range(7)]
    want = {names[i] for i in np.random.RandomState(42).choice(7, size=2, replace=False)}
    assert set(SP.holdout_files(flows)) == want
    rng = np.random.RandomState(42)
    mixed = {names[:4][i] for i in rng.choice(4, size=1, replace=False)}
    mixed |= {names[4:][i] for i in rng.choice(3, size=1, replace=False)}
    assert set(SP.mixed_holdout_files(flows)) == mixed
    assert SP.last_files(flows) == ["f6"]


def test_stratified_shares(flows):
    n = Counter(r["Attack Type"] for r in flows.collect())
    out = SP.assign_split(flows, "random").groupBy("Attack Type", "split").count().collect()
    test = {r["Attack Type"]: r["count"] for r in out if r["split"] == "test"}
    assert test == {k: int(0.2 * v + 0.5) for k, v in n.items() if v >= 2}
    fused = SP.assign_split(flows, "fused_2018holdout")
    single = fused.where(F.col("Attack Type") == "single").first()
    assert single["split"] == "train"
    assert fused.where("split = 'test' and Dataset = '2017'").count() == 0


def test_folds(flows):
    s = SP.stratified_folds(flows, "Attack Type").groupBy("Attack Type", "fold").count().collect()
    sizes = defaultdict(list)
    for r in s:
        sizes[r["Attack Type"]].append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in sizes.values())
    g = SP.group_folds(flows)
    assert g.count() == flows.count()
    assert g.select("Source_File", "fold").distinct().count() == 7
    assert SP.balanced_groups([("a", 5), ("b", 3), ("c", 3)], 2) == [("a", 0), ("c", 1), ("b", 1)]


def test_missing_columns(flows):
    bare = flows.drop("Source_File", "Dataset")
    for strategy in ("file_holdout", "mixed_holdout", "cross_dataset_2017to2018"):
        with pytest.raises(ValueError):
            SP.assign_split(bare, strategy)
    with pytest.raises(ValueError):
        SP.assign_split(flows, "other")
    with pytest.raises(ValueError):
        SP.assign_split(flows.where("Dataset = '2017'"), "fused_2018holdout")
    lone = flows.where("Source_File = 'f0'").drop("Source_File")
    n = lone.count()
    out = SP.assign_split(lone, "file_holdout", fallback=True)
    assert out.where("split = 'train'").count() == int(0.8 * n)


def test_rows_without_a_file_are_kept(flows):
    gaps = flows.withColumn("Source_File", F.when(F.col("Source_File") != "f3", F.col("Source_File")))
    n = flows.count()
    out = SP.assign_split(gaps, "temporal")
    assert out.columns == [*flows.columns, "split"] and out.count() == n
    assert out.where("split = 'train'").count() == int(0.8 * n)
    assert out.where("Source_File is null and split = 'test'").count() == 0
    assert SP.group_folds(gaps).count() == n
    assert SP.assign_split(gaps, "file").where("Source_File is null").count() == 63


def test_cap(flows):
    got = defaultdict(list)
    for r in K.cap_per_file(flows, 61).collect():
        got[r["Source_File"]].append(r[S.ROW_ORD])
    assert {f: len(v) for f, v in got.items()} == {f"f{i}": 61 for i in range(7)}
    assert sorted(got["f0"]) == [i * 3 for i in range(61)]


def test_no_split_gathers_rows(flows):
    """The tagged rows come from the scan through broadcast joins: nothing is shuffled."""
    for strategy in ("file_holdout", "per_file", "temporal", "random", "mixed_holdout", "file"):
        plan = plan_of(SP.assign_split(flows, strategy))
        assert "Window" not in plan and "SinglePartition" not in plan
        assert "hashpartitioning" not in plan, strategy
        assert "file" not in strategy.split("_") or strategy == "per_file" or "Exchange" not in plan
    assert "Exchange" not in plan_of(SP.group_folds(flows))


def test_long_lists_are_joined_in_parts(spark, flows):
    """A list too long for literals gives the same rows, and one value's rows are dealt over many tasks."""
    lists = {0: ["f0", "f3", None], 1: ["f1"], 2: ["no such file"]}
    rows = flows.unionByName(flows.limit(5).withColumn("Source_File", F.lit(None).cast("string")))
    short, long = (in_lists(rows, "Source_File", lists, "k", "int", n) for n in (10, 0))
    assert sorted(map(str, short.collect())) == sorted(map(str, long.collect()))
    assert "BroadcastNestedLoopJoin" not in plan_of(long)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "_salt" in plan_of(long.select("*")).split("hashpartitioning(")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_temporal_split_goes_by_data_set_first(spark):
    """All of 2017 comes before 2018, whatever the files are called."""
    rows = [("Monday.csv", "2017", i) for i in range(80)] + [("02-14-2018.csv", "2018", i) for i in range(20)]
    out = SP.split_temporal(spark.createDataFrame(rows, f"Source_File string, Dataset string, {S.ROW_ORD} long"))
    assert {(r["Dataset"], r["split"]) for r in out.collect()} == {("2017", "train"), ("2018", "test")}


def test_a_small_side_is_computed_once(spark):
    """What lies behind a checked side is run once, in its own tasks, and no task takes all of it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    side = spark.range(1000, numPartitions=10).mapInArrow(count, "id long")
    for most in (10, 5000):
        before = seen.value
        assert localized(side, most).count() == 1000 and seen.value - before == 1000
