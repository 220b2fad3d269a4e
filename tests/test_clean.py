import pytest
from pyspark.sql import functions as F

from flowlake import schema as S
from flowlake.functions import scalars as X
from flowlake.functions.scalars import name
from flowlake.operators import canonical as K
from flowlake.operators import clean as C


def test_numbers_from_text(spark):
    texts = ["1", " 2.5 ", "", "x", "inf", "-Infinity", "NaN", "1e400", "0x1", "1d", "2f", "+3", None]
    df = spark.createDataFrame([(t,) for t in texts], "`Idle Min` string").withColumn("Label", F.lit("a"))
    got = [r[0] for r in C.nullify_infinite(C.coerce_numeric(df)).collect()]
    assert got == [1, 2.5, None, None, None, None, None, None, None, None, None, 3, None]
    assert C.quality_report(C.coerce_numeric(df)).first()["inf_cells"] == 3


def test_counters_stay_exact(spark):
    df = spark.createDataFrame([("16777217",), ("3.0",), ("3.5",), ("inf",)], "`Flow Duration` string")
    got = [r[0] for r in C.coerce_numeric(df).collect()]
    assert got == [16777217, 3, 3.5, float("inf")]


def test_label_groups(spark):
    raw = ["Web Attack � XSS", "Web Attack \x96 XSS", "Web Attack - XSS",
           "Web Attack \xef\xbf\xbd XSS", "Infilteration", " BENIGN ", "Benign", "Nope", "\tBot\n"]
    df = spark.createDataFrame([(v,) for v in raw], "Label string")
    got = [r[0] for r in C.group_labels(df, S.label_map(spark)).select("Attack Type").collect()]
    assert sorted(got) == sorted(["Web Attacks"] * 4 + ["Infiltration", "Normal Traffic",
                                                        "Normal Traffic", "Unknown", "Bot"])
    assert [r[0] for r in C.unmapped_labels(df, S.label_map(spark)).collect()] == ["Nope"]


def test_embedded_headers(spark):
    df = spark.createDataFrame([(" Label ",), ("Label",), ("Bot",), (None,)], "Label string")
    assert K.drop_embedded_headers(df).count() == 2


def test_rare_classes_at_the_edge(spark):
    df = spark.range(299).select(F.when(F.col("id") < 99, "few").when(
        F.col("id") < 199, "enough").otherwise("Heartbleed").alias("Attack Type"))
    left = C.drop_rare_classes(df).groupBy("Attack Type").count().collect()
    assert [tuple(r) for r in left] == [("enough", 100)]


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame(
        [(0.0, "f", 5), (-0.0, "f", 3), (1.0, "f", 1), (1.0, "g", 2), (None, "f", 7), (None, "f", 9)],
        f"x double, Source_File string, {S.ROW_ORD} long")
    once = C.dedup_rows(df)
    assert sorted((r[S.ROW_ORD] for r in once.collect())) == [1, 2, 3, 7]
    assert C.dedup_rows(once).count() == 4
    r = C.dedup_report(df).first()
    assert (r["n_read"], r["n_kept"], r["n_removed"]) == (6, 4, 2)


def test_duplicate_columns(spark):
    df = spark.createDataFrame(
        [(i, float(i % 3), float(i % 3), i % 3, float((i + 1) % 3), None if i == 4 else float(i % 3))
         for i in range(9)], f"{S.ROW_ORD} long, a double, b double, c long, d double, e double")
    df = df.withColumn("f", F.col("d")).withColumn("Label", F.lit("x"))
    # c has another type, d the same values in another order, e a gap.
    assert C.duplicate_columns(df) == ["b", "f"]


def test_incomplete_rows_and_files(spark):
    df = spark.createDataFrame([(1.0, "f", "a"), (float("nan"), "f", "a"), (1.0, None, "a"),
                                (None, "g", "b")], "x double, Source_File string, Label string")
    left = C.drop_incomplete(df)
    assert left.count() == 1
    assert [r[0] for r in C.files_without_rows(df, left).collect() if r[0]] == ["g"]
    r = C.quality_report(df).first()
    assert (r["n_rows"], r["incomplete_rows"], r["incomplete_pct"]) == (4, 3, 75.0)


def test_validation(spark):
    good = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, Label string")
    C.validate_labelled(good, "Label", ["x"])
    for bad, features in [(good.limit(0), []), (good.where("Label = 'a'"), []),
                          (good.unionByName(spark.createDataFrame([(1.0, None)], good.schema)), []),
                          (good.withColumn("x", F.lit(float("nan"))), ["x"])]:
        with pytest.raises(ValueError):
            C.validate_labelled(bad, "Label", features)
    with pytest.raises(ValueError):
        C.validate_labelled(good, "Other")


def test_identifiers_and_counts(spark):
    df = spark.createDataFrame([("x", 1, "f1"), ("y", 2, "f1"), ("x", 3, "f2")],
                               "`Flow ID` string, n long, Source_File string")
    assert C.drop_identifiers(df).columns == ["n", "Source_File"]
    assert [tuple(r) for r in C.rows_per_file(df).orderBy("Source_File").collect()] == [
        ("f1", 2, 2), ("f2", 1, 3)]
    assert [r["n"] for r in C.label_distribution(df, "Source_File").collect()] == [2, 1]


def test_scalars(spark):
    r = spark.range(1).select(
        X.proto_name(F.lit(6)).alias("a"), X.proto_name(F.lit(99)).alias("b"),
        X.iso_utc(F.lit(1.9)).alias("c"), X.has_flag(F.lit(18), X.ACK).alias("d"),
        X.payload_bytes(F.lit(6), F.lit(30), F.lit(5), F.lit(5), F.lit(None).cast("int")).alias("e"),
        X.tcp_header_bytes(F.lit(6), F.lit(None).cast("int")).alias("f"),
        X.finite(F.lit(float("inf")), -1).alias("g"), X.ms_to_us(F.lit(4.0)).alias("h"),
        X.top_entries(F.create_map(F.lit("x"), F.lit(0.2), F.lit("y"), F.lit(0.5), F.lit("a"),
                                   F.lit(0.2)), 2).alias("i")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == ("TCP", "99", "1970-01-01T00:00:01Z", True)
    assert (r["e"], r["f"], r["g"], r["h"]) == (0, 20, -1.0, 4000.0)
    assert [tuple(e) for e in r["i"]] == [("y", 0.5), ("a", 0.2)]


def test_dimensions(spark):
    assert S.label_map(spark).count() == 38
    assert S.column_dialect(spark).where("action = 'rename'").count() == 50
    cat = S.feature_catalog(spark)
    assert cat.count() == 40 and cat.where("env").count() == 5
    assert cat.where(name("status") == "S").count() == 11
