"""One command per workflow. All paths are arguments; sizes default to the library's."""

import argparse
import json

from txrisk import settings
from txrisk.operators.classifiers import MODELS
from txrisk.operators import profiling
from txrisk.plans import charts, evaluate, predict, prepare, review, train, verify
from txrisk.session import build_session, clear_scratch
from txrisk.sources import model_store, readers, writers
from txrisk.streaming import endpoints, feed, jobs


def _labels(spark, source, output):
    """Label map JSON to a headered CSV folder."""
    labels = readers.read_label_map(spark, source)
    counts = readers.require_label_pairs(labels)
    writers.write_export(labels, output)
    return counts


def _overview(spark, transactions, labeled):
    """Headline numbers of the raw file and the labeled table."""
    raw = readers.read_raw_transactions(spark, transactions)
    return profiling.overview(raw, readers.read_table(spark, labeled)).first().asDict()


def _verify(spark, splits, models, predictions, new_predictions, new_report):
    report = readers.read_report(spark, f"{models}/{settings.EVALUATION_REPORT}")
    found = {
        "models": verify.verify_models(spark, splits, models),
        "evaluation": verify.verify_evaluation(spark, report),
    }
    if new_predictions:
        found["final"] = verify.verify_final(
            spark, new_predictions, f"{predictions}/suspicious_transactions",
            readers.read_report(spark, new_report),
        )
    return found


def _stream(spark, rule, servers, topic, group, alert_topic, letter_topic, checkpoint, inbox, output,
            models, threshold, minimum, once):
    """Kafka or a folder of JSON lines, to two topics or to alert and dead-letter tables."""
    source = (
        endpoints.text_source(spark, inbox)
        if inbox
        else endpoints.kafka_source(spark, servers, topic, group)
    )
    scorer = model_store.load_forest(spark, models) if rule == "anomaly" else None
    if output:
        paths = (f"{output}/alerts", f"{output}/dead_letters", checkpoint)
        query = (
            jobs.run_anomaly_rule(source, scorer, *paths, minimum=minimum, once=once)
            if scorer
            else jobs.run_high_amount_rule(source, *paths, threshold=threshold, once=once)
        )
    else:
        chosen = jobs.anomaly_rule(scorer, minimum) if scorer else jobs.amount_rule(threshold)
        query = jobs.run_to_topics(source, chosen, servers, alert_topic, letter_topic, checkpoint, once)
    query.awaitTermination()
    return {"stopped": rule}


def _parser():
    parser = argparse.ArgumentParser(prog="txrisk.jobs", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name, run, **arguments):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for key, value in arguments.items():
            flag = f"--{key.replace('_', '-')}"
            if value is str:
                sub.add_argument(flag, required=True)
            elif value is False:
                sub.add_argument(flag, action="store_true")
            else:
                kind = type(value) if value is not None else str
                sub.add_argument(flag, type=kind, default=value)
        return sub

    command("labels", _labels, source=str, output=str)
    command("prepare", prepare.prepare, transactions=str, labels=str, output=str,
            labeled_output=str, report=None, label_format="csv")
    command("train", train.train, labeled_path=str, split_base=str, model_base=str, report=None,
            max_training_rows=settings.MAX_TRAINING_ROWS, max_categories=settings.MAX_CATEGORIES,
            trees=settings.FOREST_SIZE, depth=settings.FOREST_DEPTH, undersample_ratio=settings.UNDERSAMPLE_RATIO)
    command("evaluate", evaluate.evaluate, split_base=str, model_base=str, prediction_base=str,
            result_dir=str, report=None).add_argument(
        "--thresholds", type=float, nargs="+", default=list(settings.THRESHOLDS))
    command("charts", charts.charts, labeled_path=str, prediction_base=str, result_dir=str,
            model=settings.DEFAULT_MODEL, report=None, importance_path=None)
    command("review", review.review, prediction_base=str, model=settings.DEFAULT_MODEL, text="", minimum=0.0,
            rows=settings.ALERT_FEED_ROWS)
    command("preview", review.preview, path=str, rows=10, order="transaction_id")
    command("overview", _overview, transactions=str, labeled=str)
    command("predict", predict.predict, input_path=str, output=str, model_base=str, report=None,
            export=None).add_argument("--model", choices=sorted(MODELS))
    commands.choices["predict"].add_argument("--threshold", type=float)
    command("verify", _verify, splits=str, models=str, predictions=None, new_predictions=None,
            new_report=None)
    command("feed", feed.feed, alert_path=str, rows=settings.ALERT_FEED_ROWS)
    stream = command("stream", _stream, servers=None, topic=None, group=None, alert_topic=None,
                     letter_topic=None, checkpoint=str,
                     inbox=None, output=None, models=None,
                     threshold=settings.HIGH_AMOUNT_THRESHOLD,
                     minimum=settings.MIN_ANOMALY_SCORE, once=False)
    stream.add_argument("--rule", choices=("amount", "anomaly"), default="amount")
    return parser


def main(argv=None):
    arguments = vars(_parser().parse_args(argv))
    run, name = arguments.pop("run"), arguments.pop("command")
    spark = build_session(f"txrisk-{name}")
    print(json.dumps(run(spark, **arguments), indent=2, default=str))


if __name__ == "__main__":
    try:
        main()
    finally:
        clear_scratch(build_session())
