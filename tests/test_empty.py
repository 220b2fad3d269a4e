"""Empty inputs give empty results, not errors."""

from flowlake import schema as S
from flowlake.operators import canonical as K
from flowlake.operators import clean as C
from flowlake.operators import flow_features as FF
from flowlake.operators import flows as FL
from flowlake.operators import metrics as M
from flowlake.operators import splits as SP
from tests.packets import frame


def test_no_packets(spark):
    flows = FF.flow_features(FL.assign_flows(FL.prepare_packets(frame(spark, []))))
    assert flows.count() == 0
    assert FF.check_contract(flows).where("non_finite > 0").count() == 0


def test_no_rows(spark):
    rows = spark.createDataFrame(
        [], f"`Idle Min` string, Label string, Source_File string, Dataset string, {S.ROW_ORD} long")
    clean = C.dedup_rows(C.drop_incomplete(C.nullify_infinite(C.coerce_numeric(rows))))
    grouped = C.drop_rare_classes(C.group_labels(clean, S.label_map(spark)))
    assert grouped.count() == 0 and K.cap_per_file(rows, 3).count() == 0
    assert C.quality_report(C.coerce_numeric(rows)).first()["n_rows"] == 0
    assert C.duplicate_columns(grouped) == []
    for strategy in ("per_file", "temporal", "random"):
        assert SP.assign_split(grouped, strategy).count() == 0
    cm = M.confusion(grouped, "Label", "Attack Type")
    assert M.summary_metrics(cm).first()["accuracy"] == 0
