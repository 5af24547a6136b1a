"""Run catalogue helpers: latest checkpoint per folder (T6), metric log lines
(F29 writer, S9 reader) and evaluation report text (S10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.functions.timefmt import log_metric_text

# Default checkpoint name pattern (full match) and the metric
# log line layout "Step: N, Training Logs: k: v, ...".
CHECKPOINT_PATTERN = r"training-state-(\d+).pt"
LOG_LINE_RE = r"Step: (\d+), Training Logs: (.*)$"
LOG_PAIR_RE = r"([^\s:,][^:,]*): (-?[0-9.]+(?:[eE][-+]?\d+)?|nan|inf|-inf)"
ANSI_RE = r"\x1b\[[0-9;]*m"


def latest_checkpoint(files: DataFrame, folder: str, name: str, pattern: str = CHECKPOINT_PATTERN) -> DataFrame:
    """Per folder, the file whose base name fully matches ``pattern`` with the
    largest group 1 read as a number; NULL when no file matches."""
    full = f"^(?:{pattern})$"
    base = F.substring_index(F.col(name), "/", -1)
    hit = base.rlike(full)
    step = F.regexp_extract(base, full, 1).cast("double")
    return files.groupBy(folder).agg(F.max_by(F.when(hit, base), F.when(hit, step)).alias("latest_name"))


def format_metric_log(df: DataFrame, step: str = "step", metric: str = "metric", value: str = "value") -> DataFrame:
    """one log line per step, metrics in name order."""
    per_step = df.groupBy(step).agg(F.array_sort(F.collect_list(F.struct(
        F.col(metric).alias("key"), F.col(value).cast("double").alias("value")))).alias("_m"))
    return per_step.select(step, F.concat(F.lit("Step: "), F.col(step).cast("string"), F.lit(", Training Logs: "),
                                          log_metric_text("_m")).alias("line"))


def parse_metric_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """(step, metric, value) rows from log lines; colour codes stripped,
    lines without the pattern ignored."""
    clean = F.regexp_replace(F.col(text), ANSI_RE, "")
    t = lines.select(clean.alias("_l")).filter(F.col("_l").rlike(LOG_LINE_RE))
    t = t.select(F.regexp_extract("_l", LOG_LINE_RE, 1).cast("long").alias("step"),
                 F.regexp_extract_all(F.regexp_extract("_l", LOG_LINE_RE, 2), F.lit(LOG_PAIR_RE), 0).alias("_pairs"))
    e = t.select("step", F.explode("_pairs").alias("_p"))
    return e.select("step", F.regexp_extract("_p", LOG_PAIR_RE, 1).alias("metric"),
                    F.regexp_extract("_p", LOG_PAIR_RE, 2).cast("double").alias("value"))


REPORT_LABELS = ("Inception Score", "FID", "sFID", "Precision", "Recall")


def format_eval_report(metrics: DataFrame) -> DataFrame:
    """K5 text form: five labelled lines per run (run_id, line_no, line)."""
    lines = F.array(*[F.struct(F.lit(i).alias("line_no"), F.concat(F.lit(f"{k}: "), F.col(c).cast("string")).alias("line"))
                      for i, (k, c) in enumerate(zip(REPORT_LABELS, ("inception_score", "fid", "sfid", "precision",
                                                                      "recall")))])
    return metrics.select("run_id", F.inline(lines))


def parse_eval_reports(lines: DataFrame, text: str = "value", path: str = "path") -> DataFrame:
    """One row per report file; the five labelled values pivoted to
    columns; only the ``cfg_cond`` flag is taken from the file name."""
    kv = lines.select(F.col(path).alias("path"),
                      F.regexp_extract(F.col(text), r"^([A-Za-z ]+): ", 1).alias("k"),
                      F.regexp_extract(F.col(text), r": (\S+)$", 1).cast("double").alias("v"))
    kv = kv.filter(F.col("k").isin(list(REPORT_LABELS)))
    wide = kv.groupBy("path").pivot("k", list(REPORT_LABELS)).agg(F.first("v"))
    for k, c in zip(REPORT_LABELS, ("inception_score", "fid", "sfid", "precision", "recall")):
        wide = wide.withColumnRenamed(k, c)
    flag = F.regexp_extract(F.col("path"), r"cfg_cond_(true|false)\.txt(/|$)", 1)
    return wide.withColumn("cfg_cond", F.when(flag != "", flag == "true"))
