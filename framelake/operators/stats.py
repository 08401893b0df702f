"""Statistics over files, requests and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles

STATUSES = ("pending", "processing", "done", "error")


def share(df: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """(key, n, pct): each value's count and its share of all rows. The total is a second pass over the few counts."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.col("n") * 100.0 / F.col("__total"), digits).alias("pct"))


def status_fold(df: DataFrame) -> DataFrame:
    """One row: a count for each known status and type, 0 where there is none; others count in the total alone."""
    count = lambda c, v, n: F.count_if(F.col(c) == v).alias(n)
    return df.agg(*[count("status", s, f"status_{s}") for s in STATUSES], *[count("file_type", t, f"type_{t}") for t in ("image", "video")], F.count("*").alias("total"))


def type_status_cube(df: DataFrame) -> DataFrame:
    """Totals, done and percent for each type and for all, in one pass by grouping sets. 0 percent of nothing."""
    done = F.count_if(F.col("status") == "done")
    pct = F.when(F.count("*") > 0, F.round(done * 100.0 / F.count("*"), 1)).otherwise(0.0)
    return df.groupingSets([[F.col("file_type")], []], "file_type").agg(F.coalesce("file_type", F.lit("all")).alias("kind"), F.count("*").alias("total"), done.alias("indexed"), pct.alias("pct")).drop("file_type")


def top_errors(df: DataFrame, cut: int = 120, n: int = 10) -> DataFrame:
    """The commonest messages by their first characters; ties by message."""
    rows = df.where("status = 'error' AND error_message IS NOT NULL").groupBy(F.substring("error_message", 1, cut).alias("message")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "message").limit(n)


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(3.6e9)


def stuck(df: DataFrame, as_of: Column, hours: float = 2) -> DataFrame:
    """Rows that have been processing for longer, with their age."""
    age = hours_between(F.col("created_at"), as_of)
    return df.where(F.col("status") == "processing").withColumn("age_hours", age).where(F.col("age_hours") > hours)


def timing(df: DataFrame, since: Column | None = None, by: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Count, average, median, p95, least and largest seconds of embedding_ms of finished rows. An average and the like
    of exactly 0 is null, as a number that says nothing."""
    rows = df.where("status = 'done' AND embedding_ms IS NOT NULL")
    if since is not None:
        rows = rows.where(F.col("processed_at") >= since)
    own = by or []
    sec = F.col("embedding_ms") / 1000.0
    value = lambda c: F.nullif(F.round(c, digits), F.lit(0.0))
    made = rows.groupBy(*own).agg(F.count("*").alias("total"), value(F.avg(sec)).alias("avg_sec"), value(F.min(sec)).alias("min_sec"), value(F.max(sec)).alias("max_sec"))
    exact = quantiles(rows, own, sec, median_sec=0.5, p95_sec=0.95)
    return _with(made, exact, own).select(*own, "total", "avg_sec", value(F.col("median_sec")).alias("median_sec"), value(F.col("p95_sec")).alias("p95_sec"), "min_sec", "max_sec")


def _with(made: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """made with the columns of more for the same group, null where that has none."""
    names = {c: f"__more_{i}" for i, c in enumerate(by)}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()] or [F.lit(True)]  # without groups: one row each
    return made.join(more.withColumnsRenamed(names), same, "left").drop(*names.values())


def worker_load(df: DataFrame, since: Column) -> DataFrame:
    """Each worker's finished files, all and since a time, and the average seconds of the latter."""
    late = F.col("processed_at") >= since
    return df.where("status = 'done'").groupBy("worker_id").agg(F.count("*").alias("all_time"), F.count_if(late).alias("recent"), F.round(F.avg(F.when(late, F.col("embedding_ms") / 1000.0)), 3).alias("recent_avg_sec"))


def backlog_eta(df: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Pending files, those finished in the last hours, and the hours that the backlog takes at that rate."""
    recent = F.count_if((F.col("status") == "done") & (F.col("processed_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    made = df.agg(F.count_if(F.col("status") == "pending").alias("pending"), recent.alias("recent"))
    return made.withColumn("eta_hours", F.round(F.try_divide(F.col("pending") * F.lit(float(hours)), F.col("recent")), 1))


def hourly(df: DataFrame, ts: str, since: Column | None = None) -> DataFrame:
    rows = df.where(F.col(ts).isNotNull())
    if since is not None:
        rows = rows.where(F.col(ts) >= since)
    return rows.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("files"), F.count_if(F.col("file_type") == "video").alias("videos"), F.count_if(F.col("file_type") == "image").alias("images"))


def resample(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """(bucket, n) for every bucket between the first and the last, empty ones too."""
    counts = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    calendar = ends.select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL 1 {unit}"))).alias("bucket"))
    return calendar.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def trailing_mean(buckets: DataFrame, width: int = 10, block: str = "month") -> DataFrame:
    """The mean of each bucket and up to width - 1 before it. Windows run inside blocks of time; each row also goes to
    the next block as history, so none needs the whole series."""
    unit = {"month": 86400 * 28, "day": 86400}[block]
    at = F.floor(F.unix_seconds("bucket") / unit).cast("long")
    step = F.array(F.struct(at.alias("block"), F.lit(True).alias("own")), F.struct((at + 1).alias("block"), F.lit(False).alias("own")))
    spread = buckets.select("*", F.explode(step).alias("s")).select("bucket", "n", "s.block", "s.own")
    over = Window.partitionBy("block").orderBy("bucket").rowsBetween(1 - width, 0)
    return spread.withColumn("mean", F.round(F.avg("n").over(over), 6)).where("own").select("bucket", "n", "mean")


def by_extension(df: DataFrame, ext: Column) -> DataFrame:
    """Finished files' seconds by extension, sorted by the mean."""
    sec = F.col("embedding_ms") / 1000.0
    rows = df.where("status = 'done' AND embedding_ms IS NOT NULL").groupBy(ext.alias("file_ext"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(sec), 6).alias("mean_sec"), F.round(F.stddev_samp(sec), 6).alias("std_sec"), F.round(F.max(sec), 6).alias("max_sec"))


def slowest_fastest(per_ext: DataFrame) -> DataFrame:
    made = per_ext.agg(F.max_by("file_ext", "mean_sec").alias("slowest"), F.min_by("file_ext", "mean_sec").alias("fastest"), F.max("mean_sec").alias("a"), F.min("mean_sec").alias("b"))
    return made.select("slowest", "fastest", F.round(F.try_divide("a", "b"), 6).alias("ratio"))


def storage(df: DataFrame, size: Column) -> DataFrame:
    return df.select(size.cast("double").alias("s")).agg(F.count("s").alias("n"), F.round(F.sum("s") / 1e9, 6).alias("total_gb"), F.round(F.avg("s") / 1e6, 6).alias("avg_mb"), F.round(F.max("s") / 1e9, 6).alias("max_gb"))


def coverage(df: DataFrame, **conditions: Column) -> DataFrame:
    """For each name its rows and their percent of all (0 of nothing)."""
    made = df.agg(F.count("*").alias("points"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
    return made.select("points", *conditions, *[F.when(F.col("points") > 0, F.round(F.col(n) * 100.0 / F.col("points"), 1)).otherwise(0.0).alias(f"{n}_pct") for n in conditions])


#: Upper bounds of latency buckets in seconds, and of result counts.
LATENCY_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
RESULT_BUCKETS = (0, 1, 2, 5, 10, 20, 50)


def histogram(df: DataFrame, by: list[str], value: Column, bounds: tuple[float, ...]) -> DataFrame:
    """(by, le, n): rows at or below each bound, and all of them at infinity."""
    counts = [F.struct(F.lit(float(b)).alias("le"), F.count_if(value <= b).alias("n")) for b in bounds] + [F.struct(F.lit(float("inf")).alias("le"), F.count(value).alias("n"))]
    return df.groupBy(*by).agg(F.array(*counts).alias("h")).select(*by, F.explode("h").alias("x")).select(*by, "x.le", "x.n")


def histogram_quantile(hist: DataFrame, by: list[str], q: float) -> DataFrame:
    """The quantile by linear interpolation inside the bucket that holds it; the last finite bound beyond it."""
    over = Window.partitionBy(*by).orderBy("le")
    rows = hist.withColumn("below", F.coalesce(F.lag("n").over(over), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(over), F.lit(0.0))).withColumn("all", F.max("n").over(Window.partitionBy(*by)))
    hit = rows.where((F.col("n") >= F.col("all") * q) & (F.col("below") < F.col("all") * q))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("all") * q - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(*by, F.round(F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside), 6).alias("value"))


def request_metrics(log: DataFrame, minutes: int, by: str = "endpoint") -> DataFrame:
    """Requests a second, share of errors (400 and up), median and p95 by endpoint and tumbling window."""
    rows = log.select(F.window("ts", f"{minutes} minutes")["start"].alias("window_start"), by, "response_status", "response_ms")
    key = ["window_start", by]
    made = rows.groupBy(*key).agg(
        F.count("*").alias("requests"), F.round(F.count("*") / F.lit(60.0 * minutes), 6).alias("rate"), F.round(F.avg((F.col("response_status") >= 400).cast("double")), 6).alias("error_rate")
    )
    exact = quantiles(rows, key, F.col("response_ms"), p50_ms=0.5, p95_ms=0.95)
    return _with(made, exact, key).select(*key, "requests", "rate", "error_rate", F.round("p50_ms", 3).alias("p50_ms"), F.round("p95_ms", 3).alias("p95_ms"))


def retrieval_metrics(queries: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """For each query: hits, mean, population deviation, least and largest score, signal to noise, separation and bands;
    zeros where there are none. A score below both the threshold and 0.3 is in no band."""
    s = F.col("score")
    made = hits.groupBy("query_id").agg(
        F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("low"), F.max(s).alias("high"), F.count_if((s >= 0.5) & (s < 1.01)).alias("exact"),
        F.count_if((s >= 0.4) & (s < 0.5)).alias("strong"), F.count_if((s >= 0.3) & (s < 0.4)).alias("fair"), F.count_if((s >= threshold) & (s < 0.3)).alias("weak"),
    )
    made = made.withColumn("snr", F.col("mean") / F.greatest("std", F.lit(1e-6))).withColumn("separation", F.col("mean") - threshold)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    real = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c)
    return queries.select("query_id").join(made, "query_id", "left").select("query_id", zero("n"), *[real(c) for c in ("mean", "std", "low", "high", "snr", "separation")], *[zero(c) for c in ("exact", "strong", "fair", "weak")])


def retrieval_gates(metrics: DataFrame, consistency: DataFrame | None = None) -> DataFrame:
    """Averages over queries and whether the gates hold: signal to noise 2, separation 0.05, half of the queries with hits.
    With consistency (query_id, mean, std) of paraphrases also its averages, over the queries that have any; no gate."""
    if consistency is not None:
        more = consistency.select("query_id", F.col("mean").alias("__c"), F.col("std").alias("__s"))
        metrics = metrics.join(more, "query_id", "left")
    extra = [F.round(F.avg("__c"), 6).alias("consistency"), F.round(F.avg("__s"), 6).alias("consistency_std")] if consistency is not None else []
    made = metrics.agg(*extra, F.count("*").alias("queries"), F.round(F.avg("snr"), 6).alias("snr"), F.round(F.avg("separation"), 6).alias("separation"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("hit_rate"))
    return made.withColumn("passed", (F.col("snr") >= 2.0) & (F.col("separation") >= 0.05) & (F.col("hit_rate") >= 0.5))


def answer_proxies(rows: DataFrame) -> DataFrame:
    """Shares of answers longer than 20 characters and of rows with contexts, with their gates."""
    made = rows.agg(F.round(F.avg((F.length("answer") > 20).cast("double")), 6).alias("relevancy"), F.round(F.avg((F.size("contexts") > 0).cast("double")), 6).alias("faithfulness"))
    return made.withColumn("passed", (F.col("faithfulness") >= 0.70) & (F.col("relevancy") >= 0.75))


def classifier_report(pred: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from (label, prediction), with rows accuracy, macro and weighted."""
    pairs = pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    true = pairs.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = pairs.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a) * 1.0, F.col(b)), F.lit(0.0))
    each = true.join(said, "label", "left").select("label", ratio("hit", "said").alias("precision"), ratio("hit", "support").alias("recall"), "support", "hit")
    each = each.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    scores = ("precision", "recall", "f1")
    macro = each.agg(*[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support")).withColumn("label", F.lit("macro"))
    weighted = each.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in scores], F.sum("support").alias("support")).withColumn("label", F.lit("weighted"))
    accuracy = each.agg((F.sum("hit") / F.sum("support")).alias("precision"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("label"), "precision", F.col("precision").alias("recall"), F.col("precision").alias("f1"), "support")
    out = each.select("label", *scores, "support")
    for x in (macro, weighted, accuracy):
        out = out.unionByName(x.select("label", *scores, "support"))
    return out.select("label", *[F.round(c, 6).alias(c) for c in scores], "support")


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """(label, prediction, n, share): a row for each pair that occurs, and its share of the label's rows."""
    pairs = pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    total = pairs.groupBy("label").agg(F.sum("n").alias("__total"))
    return pairs.join(total, "label").select("label", "prediction", "n", F.round(F.col("n") / F.col("__total"), 6).alias("share"))


def review_counts(pred: DataFrame, least: float = 0.85) -> DataFrame:
    """(prediction, automatic, review): rows sure enough to be labelled, and those that someone has to look at."""
    sure = F.col("confidence") >= least
    return pred.groupBy("prediction").agg(F.count_if(sure).alias("automatic"), F.count_if(~sure).alias("review"))


def report_change(report: DataFrame, baseline: DataFrame, score: str = "f1", most: float = 0.10) -> DataFrame:
    """(label, change, warn): a score less the baseline's, and whether it fell by more than the most allowed."""
    both = report.select("label", F.col(score).alias("__a")).join(baseline.select("label", F.col(score).alias("__b")), "label")
    change = F.col("__a") - F.col("__b")
    return both.select("label", F.round(change, 6).alias("change"), (change < -most).alias("warn"))
