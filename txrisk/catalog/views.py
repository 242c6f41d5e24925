"""The given tables seen as transactions, labels, scores and stream records.

Orders stand for transactions and line items decide the labels. The raw views write the values
back as the untidy text the cleaning has to cope with: padded cells, blanks, dollar signs, bad
dates and amounts, missing ids, and a second copy of every pending order.
"""

from functools import cached_property

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from txrisk.functions.hashing import md5_place
from txrisk.operators import cleaning, features, reports, sampling
from txrisk.session import written

# Intercept, weight per 100,000 of amount, weight per hour of the day.
FIXED_MODELS = {
    "lr_none": (-4.0, 0.5, 0.05),
    "lr_class_weight": (-2.0, 0.4, 0.1),
    "rf_none": (-5.0, 0.9, 0.02),
    "rf_class_weight": (-1.0, 0.3, 0.03),
    "rf_undersampling": (-3.0, 0.6, 0.08),
}
STREAM_THRESHOLD = 100.0


class FixedModel:
    """A logistic formula with known weights, in the shape of an MLlib model."""

    def __init__(self, slug):
        self.weights = FIXED_MODELS[slug]

    def transform(self, rows):
        p = fixed_score(*self.weights)
        return rows.withColumn("probability", array_to_vector(F.array(1.0 - p, p)))


def fixed_score(intercept, per_amount, per_hour):
    margin = (
        F.lit(intercept)
        + F.lit(per_amount) * F.col("amount") / F.lit(100000.0)
        + F.lit(per_hour) * F.hour("transaction_time").cast("double")
    )
    return F.round(1.0 / (1.0 + F.exp(-margin)), 6)


class Views:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def table(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw(self):
        rows = (
            self.table("orders")
            .join(self.table("customer"), F.expr("o_custkey = c_custkey"))
            .join(self.table("nation"), F.expr("c_nationkey = n_nationkey"))
            .withColumn(
                "time",
                F.expr("timestampadd(SECOND, CAST(o_orderkey * 7919 % 86400 AS INT), o_orderdate)"),
            )
            .withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
            .withColumn("price", F.expr("format_number(o_totalprice, 2)"))
        )
        # Text is made once per copy, inside the generator, so later filters do not make it again.
        first = """struct(
            CASE WHEN day(o_orderdate) = 31 THEN concat(substring(time, 1, 8), '99', substring(time, 11))
                 WHEN o_orderstatus = 'O' THEN concat('  ', time, ' ') ELSE time END AS date,
            CASE WHEN o_totalprice < 4000 THEN 'abc'
                 WHEN o_totalprice < 7000 THEN 'NaN'
                 WHEN o_totalprice < 10000 THEN concat('$-', price)
                 WHEN o_totalprice < 12000 THEN NULL
                 ELSE concat(' $', price) END AS amount)"""
        second = """struct(
            CASE WHEN day(o_orderdate) = 31 THEN concat(substring(time, 1, 8), '99', substring(time, 11))
                 ELSE time END AS date,
            replace(format_number(o_totalprice - 1, 2), ',', '') AS amount)"""
        copies = F.expr(f"inline(IF(o_orderstatus = 'P', array({first}, {second}), array({first})))")
        return rows.select("*", copies).selectExpr(
            "IF(o_totalprice > 499000, NULL, o_orderkey) AS id",
            "date",
            "o_custkey AS client_id",
            "o_custkey * 100 + c_nationkey AS card_id",
            "amount",
            """CASE WHEN o_orderpriority = '3-MEDIUM' THEN '   '
                    WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN NULL
                    ELSE concat(' ', o_orderpriority) END AS use_chip""",
            "CAST(c_nationkey * 1000 + n_regionkey AS BIGINT) AS merchant_id",
            "IF(c_mktsegment = 'HOUSEHOLD', '', concat(' ', c_mktsegment, ' ')) AS merchant_city",
            "IF(o_orderstatus = 'F', NULL, n_name) AS merchant_state",
            "IF(c_mktsegment = 'MACHINERY', '  ', concat(10000 + o_custkey, '.0')) AS zip",
            """CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN NULL
                    ELSE 4000 + c_nationkey * 10 + n_regionkey END AS mcc""",
            "CASE o_orderstatus WHEN 'P' THEN 'Bad PIN' WHEN 'O' THEN ' ' END AS errors",
        )

    @cached_property
    def line_labels(self):
        """A label per line item; orders with lines of both kinds conflict."""
        rare = F.expr("l_returnflag = 'R' AND l_quantity >= 45 AND l_discount >= 0.08")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("transaction_id"),
            F.when(rare, "Yes").otherwise("No").alias("label"),
            "l_linenumber",
        )

    @cached_property
    def raw_labels(self):
        """Untidy labels per order: any rare line makes it Yes; some come twice."""
        per_order = self.line_labels.groupBy("transaction_id").agg(
            F.bool_or(F.col("label") == "Yes").alias("rare"),
            F.count(F.lit(1)).alias("lines"),
            F.max("l_linenumber").alias("last"),
        )
        return per_order.selectExpr(
            "IF(lines >= 10, NULL, transaction_id) AS transaction_id",
            """CASE WHEN rare THEN IF(lines % 2 = 0, ' yes ', 'Yes')
                    WHEN last = 1 THEN 'maybe'
                    ELSE IF(lines % 2 = 0, 'NO', 'No') END AS label""",
            "explode(IF(lines >= 6, array(0, 1), array(0))) AS copy",
        ).drop("copy")

    @cached_property
    def parsed(self):
        return cleaning.parse_transactions(self.raw)

    @cached_property
    def clean(self):
        return cleaning.clean_transactions(self.raw)

    @cached_property
    def labels(self):
        return cleaning.clean_labels(self.raw_labels)

    @cached_property
    def labeled(self):
        return cleaning.label_transactions(self.clean, self.labels)

    @cached_property
    def stored(self):
        """The labeled table written out, for queries that go over it more than once."""
        return written(self.labeled, "labeled")

    @cached_property
    def features(self):
        return features.training_features(self.labeled)

    @cached_property
    def splits(self):
        return sampling.three_way_split(self.stored, md5_place)

    def scored(self, rows=None):
        """Long table of fixed scores: five models, one pass over the rows."""
        rows = self.labeled if rows is None else rows
        scores = F.array(
            *(
                F.struct(F.lit(s).alias("slug"), fixed_score(*w).alias("p"))
                for s, w in FIXED_MODELS.items()
            )
        )
        return rows.select(
            "transaction_id", "transaction_time", "amount", "class",
            F.inline(scores).alias("slug", "fraud_probability"),
        )

    def stored_scores(self, rows=None):
        """The same, written out once for reports that read it more than once."""
        return written(self.scored(rows), "scores", "slug")

    @staticmethod
    def at_half(scored):
        return scored.withColumn("prediction", (F.col("fraud_probability") >= 0.5).cast("int"))

    def decided(self):
        """Fixed scores with the decision at 0.5."""
        return self.at_half(self.scored())

    @cached_property
    def predictions(self):
        """All models in the stored layout, the slug being the model."""
        return reports.prediction_table(self.decided(), F.col("slug"))

    @cached_property
    def metrics_by_model(self):
        from txrisk.plans.evaluate import evaluate_scored

        return evaluate_scored(self.at_half(self.stored_scores()))

    @staticmethod
    def records(events):
        """Events as JSON text: some broken, some without amount, some with it quoted."""
        amount = F.expr(
            "CASE WHEN event_type = 'purchase' THEN concat('\"', CAST(value AS STRING), '\"') "
            "ELSE CAST(value AS STRING) END"
        )
        online = F.expr("IF(event_type = 'view', 'null', concat('\"S', user_id, '\"'))")
        failed = F.expr("IF(event_type = 'click', '\"Bad PIN\"', 'null')")
        time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        body = F.concat(
            F.lit('{"transactionId":"'), "event_id", F.lit('","accountId":"A'), "user_id",
            F.lit('","amount":'), amount, F.lit(',"merchant_state":'), online,
            F.lit(',"errors":'), failed, F.lit(',"transaction_time":"'), time, F.lit('"}'),
        )
        value = (
            F.when((F.col("event_type") == "error") & (F.col("value") < 10), F.lit("not json"))
            .when(F.col("event_type") == "error", F.concat(F.lit('{"note":"'), "event_id", F.lit('"}')))
            .otherwise(body)
        )
        return events.select(value.alias("value"))

    @cached_property
    def event_records(self):
        return self.records(self.table("events"))
