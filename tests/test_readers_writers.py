import json

import pytest
from pyspark.sql import functions as F

from txrisk.operators import audits
from txrisk.sources import readers, writers
from txrisk.session import scratch_path, written

RAW_HEADER = (
    "id,date,client_id,card_id,amount,use_chip,merchant_id,merchant_city,merchant_state,zip,mcc,errors"
)


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_bad_cell_in_raw_csv_becomes_null_and_row_stays(spark, tmp_path):
    path = write(
        tmp_path / "raw.csv",
        RAW_HEADER,
        '1,2019-01-01 00:00:00,5,6,"$1,234.50",Chip,7,Zürich,CA,58523.0,5411,',
        "x,2019-01-01 00:00:00,5,6,$1.00,Chip,7,Town,CA,58523.0,abc,Bad PIN",
        "3,2019-01-01 00:00:00,5",
    )
    rows = {row["client_id"]: row for row in readers.read_raw_transactions(spark, path).where("id is not null").collect()}
    assert len(rows) == 1
    table = readers.read_raw_transactions(spark, path)
    assert table.count() == 3
    bad = table.where("id is null").first()
    assert bad["mcc"] is None and bad["errors"] == "Bad PIN"
    assert table.where("id = 1").first()["merchant_city"] == "Zürich"
    assert table.where("id = 3").first()["amount"] is None


def test_labels_fail_fast(spark, tmp_path):
    good = write(tmp_path / "good.csv", "transaction_id,label", "1,Yes", "2,No")
    assert readers.read_labels(spark, good).count() == 2
    bad = write(tmp_path / "bad.csv", "transaction_id,label", "1,Yes", "two,No")
    with pytest.raises(Exception, match="FAILFAST"):
        readers.read_labels(spark, bad).collect()


def test_label_map_on_one_line_is_split_and_complete(spark, tmp_path):
    pairs = {str(i): ("Yes" if i % 7 == 0 else "No") for i in range(1, 50_001)}
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"target": pairs}), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        labels = readers.read_label_map(spark, str(path))
        assert labels.rdd.getNumPartitions() > 4
        found = {str(r["transaction_id"]): r["label"] for r in labels.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == pairs
    counts = readers.require_label_pairs(labels)
    assert counts == {"total": 50_000, "yes": 7142, "no": 42_858}


@pytest.mark.parametrize("text", ['{"target": {}}', '{"target": {"1": "No"}}', '{"target": {"a": "Yes"}}'])
def test_label_map_without_pairs_or_yes_is_refused(spark, tmp_path, text):
    path = tmp_path / "labels.json"
    path.write_text(text, encoding="utf-8")
    with pytest.raises(ValueError):
        readers.require_label_pairs(readers.read_label_map(spark, str(path)))


def test_missing_or_broken_selection_is_empty(spark, tmp_path):
    assert readers.read_selection(spark, str(tmp_path)) == {}
    broken = tmp_path / "metadata" / "evaluation.json"
    broken.parent.mkdir()
    broken.write_text("{", encoding="utf-8")
    assert readers.read_selection(spark, str(tmp_path)) == {}


def test_report_round_trip(spark, tmp_path):
    report = {"selection": {"recommended_model": "rf_none", "thresholds_by_model": {"rf_none": 0.2}}}
    writers.write_report(spark, report, str(tmp_path / "metadata" / "evaluation.json"))
    assert readers.read_selection(spark, str(tmp_path)) == report["selection"]


def test_partition_column_is_read_back_as_int(spark, tmp_path):
    df = spark.createDataFrame([(1, 2019), (2, 2020)], "transaction_id BIGINT, transaction_year INT")
    path = writers.write_table(df, str(tmp_path / "t"), "transaction_year")
    table = readers.read_table(spark, path)
    assert dict(table.dtypes)["transaction_year"] == "int"
    assert writers.reconcile(spark, path, 2, "t").count() == 2
    with pytest.raises(RuntimeError):
        writers.reconcile(spark, path, 3, "t")


def test_result_table_keeps_asked_columns_only(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2)], "slug STRING, tp INT, extra INT")
    path = writers.write_result_table(df, str(tmp_path / "r.csv"), ["slug", "tp"])
    assert spark.read.csv(path, header=True).columns == ["slug", "tp"]


def test_scratch_follows_the_session_setting(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = written(spark.range(5).withColumn("k", F.col("id") % 2), "numbers", "k")
    assert kept.columns == ["id", "k"] and kept.count() == 5


def bare_session(at):
    class Bare:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            applicationId, master = "app", at

    return Bare


def test_scratch_without_a_setting():
    first, second = scratch_path(bare_session("local[2]"), "x"), scratch_path(bare_session("local[2]"), "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_path(bare_session(master), "x")


def test_a_large_table_is_no_result_table(spark, tmp_path):
    with pytest.raises(ValueError, match="one file"):
        writers.write_result_table(spark.range(11), str(tmp_path / "x.csv"), most_rows=10)


def test_required_columns():
    class Frame:
        columns = ["a", "b"]

    from txrisk.operators.keys import missing_columns, require_columns

    assert missing_columns(Frame, ["a", "c"]) == ["c"]
    with pytest.raises(ValueError, match="c"):
        require_columns(Frame, ["a", "c"])


def test_new_transactions_are_refused_as_a_whole(spark, tmp_path):
    from txrisk.operators.cleaning import parse_new_transactions

    header = "transaction_id,transaction_time,amount,use_chip,merchant_state,mcc,errors"
    good = "1,2019-12-31 23:30:00,1500.00,Online Transaction,,5732,"

    def load(*lines):
        path = write(tmp_path / f"new{len(lines)}{abs(hash(lines))}.csv", header, *lines)
        return parse_new_transactions(readers.read_new_transactions(spark, path))

    assert audits.require_valid_new_transactions(load(good)) == 1
    for bad in (
        "2,2019-12-31 23:30:00,1.00,Chip,,,",
        "2,2019-12-31 23:30:00,-1.00,Chip,,5732,",
        "2,31/12/2019,1.00,Chip,,5732,",
        good,
    ):
        with pytest.raises(ValueError):
            audits.require_valid_new_transactions(load(good, bad))
    with pytest.raises(Exception, match="FAILFAST"):
        load("2,2019-12-31 23:30:00,$1.00,Chip,,5732,").collect()
