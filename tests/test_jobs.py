import json

from txrisk.catalog.tables import as_csv
from txrisk.jobs.__main__ import main


def printed(capsys):
    return json.loads(capsys.readouterr().out)


def test_labels_and_prepare(spark, views, tmp_path, capsys):
    source = tmp_path / "labels.json"
    pairs = {str(r["transaction_id"]): "Yes" if r["class"] else "No" for r in views.labels.collect()}
    source.write_text(json.dumps({"target": pairs}))
    main(["labels", "--source", str(source), "--output", str(tmp_path / "labels")])
    assert printed(capsys)["total"] == len(pairs)
    main([
        "prepare", "--transactions", as_csv(views.raw, "raw"), "--labels", str(tmp_path / "labels"),
        "--output", str(tmp_path / "clean"), "--labeled-output", str(tmp_path / "labeled"),
    ])
    assert printed(capsys)["tables"]["labeled"]["rows"] == views.labeled.count()


def test_stream_of_files(spark, tmp_path, capsys):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.txt").write_text('{"transactionId": "a", "amount": 600}\n{"amount": 400}\nnope\n')
    main([
        "stream", "--inbox", str(inbox), "--output", str(tmp_path / "out"),
        "--checkpoint", str(tmp_path / "progress"), "--threshold", "500", "--once",
    ])
    assert printed(capsys) == {"stopped": "amount"}
    main(["feed", "--alert-path", str(tmp_path / "out" / "alerts")])
    shown = printed(capsys)
    assert shown["status"]["total_alerts"] == 1 and shown["status"]["threshold"] == 500.0
    assert [a["transactionId"] for a in shown["alerts"]] == ["a"]
    alerts = spark.read.parquet(str(tmp_path / "out" / "alerts")).collect()
    assert [(a["transactionId"], a["threshold"]) for a in alerts] == [("a", 500.0)]
    assert spark.read.parquet(str(tmp_path / "out" / "dead_letters")).count() == 1
