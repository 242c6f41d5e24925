"""Sources, sinks and row counts."""

from pyspark.sql import functions as F

from txrisk.catalog.registry import query
from txrisk.operators import metrics, reports
from txrisk.operators.classifiers import model_spec, score_all
from txrisk.operators.cleaning import parse_new_transactions
from txrisk.operators.isolation_forest import fit_forest
from txrisk.operators.features import numeric_features
from txrisk.plans import train
from txrisk.plans.evaluate import choose_thresholds
from txrisk.session import scratch_path, written
from txrisk.settings import EVALUATION_REPORT
from txrisk.sources import layouts, model_store, readers, writers

# A CSV cell without characters reads as null.
RAW_CELLS = """id, date, client_id, card_id, amount, use_chip, merchant_id,
    nullif(merchant_city, '') AS merchant_city, merchant_state, zip, mcc, errors"""


def as_csv(df, name):
    """The rows as a headered CSV folder, cells untouched."""
    path = scratch_path(df.sparkSession, name)
    df.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("src_01_raw_transactions_csv", f"SELECT {RAW_CELLS} FROM raw_tx")
def _(v):
    return readers.read_raw_transactions(v.spark, as_csv(v.raw, "raw-csv"))


@query("src_02_labels_csv", "SELECT transaction_id, label FROM raw_labels")
def _(v):
    return readers.read_labels(v.spark, as_csv(v.raw_labels, "labels-csv"))


@query(
    "src_03_label_map",
    "SELECT transaction_id, CASE class WHEN 1 THEN 'Yes' ELSE 'No' END AS label FROM clean_labels",
)
def _(v):
    path = scratch_path(v.spark, "label-map")
    word = F.when(F.col("class") == 1, "Yes").otherwise("No")
    pairs = F.concat(F.lit('"'), "transaction_id", F.lit('": "'), word, F.lit('"'))
    v.labels.select(pairs).write.option("lineSep", ",").text(path)
    return readers.read_label_map(v.spark, path)


@query(
    "src_04_new_transactions_csv",
    """SELECT transaction_id, transaction_time, amount, use_chip, merchant_state, mcc, errors
       FROM clean_tx""",
)
def _(v):
    new = v.clean.select(
        "transaction_id",
        F.date_format("transaction_time", "yyyy-MM-dd HH:mm:ss").alias("transaction_time"),
        "amount", "use_chip", "merchant_state", "mcc", "errors",
    )
    return parse_new_transactions(readers.read_new_transactions(v.spark, as_csv(new, "new-csv")))


@query(
    "src_05_parquet_partitions",
    """SELECT transaction_year, count(*) AS rows, sum(class)::BIGINT AS fraud, round(max(amount), 2) AS max_amount
       FROM labeled GROUP BY transaction_year""",
)
def _(v):
    path = scratch_path(v.spark, "labeled")
    writers.write_table(v.labeled, path, "transaction_year")
    return readers.read_table(v.spark, path).groupBy("transaction_year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("class").alias("fraud"),
        F.round(F.max("amount"), 2).alias("max_amount"),
    )


@query("src_06_selection_metadata", "SELECT slug, threshold FROM chosen")
def _(v):
    base = scratch_path(v.spark, "selection")
    chosen = choose_thresholds(v.stored_scores(v.splits["validation"])).collect()
    selection = {"thresholds_by_model": {row["slug"]: row["threshold"] for row in chosen}}
    writers.write_report(v.spark, {"selection": selection}, f"{base}/{EVALUATION_REPORT}")
    found = readers.read_selection(v.spark, base)["thresholds_by_model"]
    return v.spark.createDataFrame(list(found.items()), "slug STRING, threshold DOUBLE")


@query("src_08_range_rows", "SELECT count(*) AS rows FROM orders")
def _(v):
    numbers = v.spark.range(v.table("orders").count()).repartition(4)
    return numbers.agg(F.count(F.lit(1)).alias("rows"))


@query(
    "snk_01_year_partitions",
    """SELECT transaction_year, count(*) AS rows, count(merchant_state) AS with_state
       FROM clean_tx GROUP BY transaction_year""",
)
def _(v):
    path = scratch_path(v.spark, "clean")
    writers.write_table(v.clean, path, "transaction_year", rebalance=True)
    return readers.read_table(v.spark, path).groupBy("transaction_year").agg(
        F.count(F.lit(1)).alias("rows"), F.count("merchant_state").alias("with_state")
    )


@query(
    "snk_02_split_partitions",
    "SELECT class, count(*) AS rows, round(sum(amount), 2) AS amount FROM labeled GROUP BY class",
)
def _(v):
    path = scratch_path(v.spark, "splits")
    train.write_splits(v.labeled, path)
    parts = [train.read_split(v.spark, path, name) for name in train.SPLITS]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("class").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("amount"), 2).alias("amount")
    )


@query(
    "snk_03_prediction_partitions",
    "SELECT model, prediction, status, count(*) AS rows FROM predictions GROUP BY ALL",
)
def _(v):
    path = scratch_path(v.spark, "predictions")
    writers.write_table(v.predictions, path, "prediction")
    return readers.read_table(v.spark, path).groupBy("model", "prediction", "status").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "snk_04_plain_parquet",
    """SELECT transaction_id, fraud_probability, model FROM predictions
       WHERE prediction = 1 AND model = 'rf_undersampling'
       ORDER BY fraud_probability DESC, transaction_id LIMIT 20""",
)
def _(v):
    path = scratch_path(v.spark, "suspicious")
    own = v.predictions.where(F.col("model") == "rf_undersampling")
    writers.write_table(reports.top_suspicious(own), path)
    return readers.read_table(v.spark, path).select("transaction_id", "fraud_probability", "model")


@query("snk_05_csv_result_table", "SELECT slug, tp, tn, fp, fn FROM confusion")
def _(v):
    path = scratch_path(v.spark, "confusion.csv")
    table = metrics.binary_metrics(v.decided())
    writers.write_result_table(table, path, ["slug", "tp", "tn", "fp", "fn"])
    schema = "slug STRING, tp BIGINT, tn BIGINT, fp BIGINT, fn BIGINT"
    return v.spark.read.csv(path, schema=schema, header=True)


@query(
    "snk_06_json_report",
    "SELECT class::VARCHAR AS class, count(*) AS rows FROM labeled GROUP BY class",
)
def _(v):
    path = scratch_path(v.spark, "report.json")
    counts = {str(r["class"]): r["count"] for r in v.labeled.groupBy("class").count().collect()}
    writers.write_report(v.spark, {"classes": counts}, path)
    found = readers.read_report(v.spark, path)["classes"]
    return v.spark.createDataFrame(list(found.items()), "class STRING, rows BIGINT")


@query("snk_07_saved_model", "SELECT transaction_id, true AS sound FROM test_rows")
def _(v):
    """A model in place scores as the one in memory, also after a save over it that failed halfway."""
    from txrisk.catalog.models import Fitted

    fitted, base, slug = Fitted(v), scratch_path(v.spark, "models"), "lr_none"
    model, check = fitted.fit(slug), fitted.test.limit(10)
    model_store.save_classifier(slug, model, base, check)

    def unreadable(name):
        raise OSError(f"{name} is unreadable on purpose")

    folder = f"{base}/{model_spec(slug).folder}"
    try:
        model_store.save_checked(model, folder, unreadable, check)
    except OSError as error:
        if "on purpose" not in str(error):
            raise
    again = model_store.load_classifier(slug, base)
    scored = score_all({"own": model, "again": again}, fitted.test)
    p = F.col("fraud_probability")
    return scored.groupBy("transaction_id").agg((F.min(p) == F.max(p)).alias("sound"))


@query(
    "flt_15_required_columns",
    """SELECT 'late' AS folder, 'mcc' AS "column", 'missing' AS problem, count(*) AS rows
       FROM clean_tx WHERE transaction_year >= 1998
       UNION ALL SELECT 'late', 'amount', 'is string', count(*) FROM clean_tx WHERE transaction_year >= 1998""",
)
def _(v):
    """A folder whose newer files lack a column and hold another as text; footers tell."""
    base = scratch_path(v.spark, "layouts")
    clean = written(v.clean, "clean")
    early = F.col("transaction_year") < 1998
    clean.where(early).write.parquet(f"{base}/early")
    late = clean.where(~early).drop("mcc").withColumn("amount", F.col("amount").cast("string"))
    writers.write_table(late, f"{base}/late", "transaction_year")
    wanted = dict(clean.dtypes)
    problems = layouts.layout_problems(layouts.file_columns(v.spark, base), wanted)
    folder = F.regexp_extract("path", "/(early|late)/", 1).alias("folder")
    return problems.groupBy(folder, "column", "problem").agg(F.sum("rows").alias("rows"))


@query(
    "snk_09_forest_table",
    """SELECT tree::INTEGER AS tree, least(256, (SELECT count(*) FROM train_rows))::INTEGER AS sample_size,
              true AS sound FROM range(200) AS t(tree)""",
)
def _(v):
    base = scratch_path(v.spark, "forest")
    train_rows = numeric_features(v.splits["train"], "transaction_id")
    model_store.save_forest(fit_forest(train_rows), base)
    leaf = F.col("feature") == -1
    binary = F.count(F.lit(1)) == 2 * F.count_if(leaf) - 1
    bounded = F.count(F.lit(1)) <= 2 * F.max("sample_size") - 1
    return readers.read_table(v.spark, f"{base}/isolation_forest").groupBy("tree").agg(
        F.max("sample_size").alias("sample_size"), (binary & bounded).alias("sound")
    )


@query(
    "snk_10_row_reconciliation",
    "SELECT count(*) AS expected_rows, count(*) AS stored_rows FROM clean_tx",
)
def _(v):
    from txrisk.operators.profiling import id_profile, row_total

    path = scratch_path(v.spark, "reconciled")
    expected = id_profile(v.raw).first()["valid_ids"]
    writers.write_table(v.clean, path, "transaction_year")
    stored = writers.reconcile(v.spark, path, expected, "clean transactions")
    return row_total("stored", stored).select(
        F.lit(expected).cast("bigint").alias("expected_rows"), F.col("rows").alias("stored_rows")
    )
