"""Risk scores of targets from weighted signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Weight of each signal.
WEIGHTS = {
    "subdomain_discovery": 2.0, "dns_wildcard": -1.0, "certificate_transparency": 3.0, "certificate_expired": 1.5, "certificate_self_signed": 2.0,
    "http_alive": 5.0, "http_redirect": 1.0, "http_error_4xx": 0.5, "http_error_5xx": 2.0, "http_uncommon_port": 3.0, "http_dev_headers": 4.0,
    "tech_admin_panel": 8.0, "tech_database": 6.0, "tech_framework": 3.0, "tech_cms": 4.0, "tech_dev_tools": 7.0, "tech_monitoring": 3.0,
    "waf_detected": -2.0, "cdn_detected": 1.0, "cloudflare_detected": 0.5,
    "dir_admin_found": 9.0, "dir_backup_found": 8.0, "dir_config_found": 7.0, "dir_logs_found": 6.0, "dir_test_found": 5.0, "dir_dev_found": 6.0, "dir_api_found": 7.0, "dir_upload_found": 5.0,
    "file_config": 8.0, "file_backup": 7.0, "file_source_code": 6.0, "file_database": 9.0, "file_log": 4.0, "file_documentation": 3.0,
    "js_api_endpoint": 6.0, "js_secret_key": 9.0, "js_hardcoded_token": 8.0, "js_internal_domain": 5.0, "js_debug_info": 4.0, "js_source_map": 3.0,
    "api_openapi_spec": 7.0, "api_swagger_ui": 6.0, "api_graphql_endpoint": 7.0, "api_graphql_introspection": 8.0, "api_rest_endpoint": 5.0, "api_authentication_bypass": 9.0,
    "api_idor_potential": 9.0, "api_rate_limit_bypass": 7.0, "api_verb_tampering": 6.0, "api_parameter_pollution": 5.0, "api_mass_assignment": 8.0,
    "mobile_hardcoded_url": 6.0, "mobile_api_key": 8.0, "mobile_debug_mode": 5.0, "mobile_backup_enabled": 4.0,
    "change_title": 2.0, "change_certificate": 4.0, "change_technology": 3.0, "change_new_subdomain": 5.0, "change_new_endpoint": 6.0,
    "content_sensitive_info": 7.0, "content_error_disclosure": 5.0, "content_debug_info": 4.0, "content_internal_ip": 6.0,
}
# Multipliers by context, severity thresholds, boost and amplification.
PORTS = {"80": 1.0, "443": 1.0, "8080": 1.2, "8443": 1.2, "3000": 1.3, "8000": 1.3, "9000": 1.3, "admin": 1.5}
SUBDOMAINS = {"www": 1.0, "api": 1.3, "test": 1.3, "dev": 1.4, "staging": 1.4, "admin": 1.5, "internal": 1.6}
PATHS = {"root": 1.0, "api": 1.3, "dev": 1.4, "backup": 1.4, "config": 1.4, "admin": 1.5}
SEVERITIES = ((80, "critical"), (60, "high"), (40, "medium"), (20, "low"), (0, "info"))
BOOST_CONFIDENCE, BOOST, AMPLIFY_ABOVE, AMPLIFY, MOST = 0.7, 1.2, 70.0, 1.3, 100.0
# Points of combinations that raise a score, and of signs of a false alarm that lower it.
PATTERNS = {
    "admin_panel_with_weak_auth": 15.0, "api_with_no_auth": 12.0, "backup_with_sensitive_data": 10.0, "dev_env_in_production": 8.0,
    "honeypot_detected": -20.0, "waf_blocking_everything": -10.0, "rate_limited_heavily": -5.0,
}
DECAY, DECAY_HOURS, OUTLIER = 0.95, 24.0, 3.0


def weights(spark: SparkSession, table: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((table or WEIGHTS).items()), "signal string, weight double")


def factor(c: Column, table: dict[str, float]) -> Column:
    """The multiplier of a context word; 1 for unknown ones."""
    return F.coalesce(reduce(lambda chain, x: chain.when(c == x[0], F.lit(x[1])), table.items(), F.when(F.lit(False), 1.0)), F.lit(1.0))


def severity(score: Column) -> Column:
    return reduce(lambda chain, x: chain.when(score >= x[0], x[1]), SEVERITIES, F.when(score.isNull(), F.lit(None).cast("string"))).otherwise("info")


def scores(signals: DataFrame, weight_table: DataFrame, target: str = "target", signal: str = "signal", confidence: str = "confidence", multiplier: Column | None = None, age_hours: Column | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """``target, n_signals, confidence, score, severity``. Unknown signals weigh nothing.

    ``patterns`` (target, pattern) adds the points of each of a target's patterns once, before the score is cut to its range.

    The weight table is a fixed list of settings, so it is broadcast; signals are summed before the shuffle.
    """
    w = F.broadcast(weight_table.select(F.col("signal").alias("_s"), "weight"))
    part = F.coalesce("weight", F.lit(0.0)) * F.col(confidence) * (multiplier if multiplier is not None else F.lit(1.0))
    if age_hours is not None:
        part = part * F.pow(F.lit(DECAY), age_hours / DECAY_HOURS)
    summed = signals.join(w, F.col(signal) == F.col("_s"), "left").groupBy(target).agg(F.count("*").alias("n_signals"), F.avg(confidence).alias("confidence"), F.sum(part).alias("raw"))
    boosted = F.when(F.col("confidence") >= BOOST_CONFIDENCE, F.col("raw") * BOOST).otherwise(F.col("raw"))
    amplified = F.when(boosted > AMPLIFY_ABOVE, boosted * AMPLIFY).otherwise(boosted)
    if patterns is not None:
        points = reduce(lambda chain, x: chain.when(F.col("pattern") == x[0], F.lit(x[1])), PATTERNS.items(), F.when(F.lit(False), 0.0))
        extra = patterns.select(target, "pattern").distinct().groupBy(target).agg(F.sum(points).alias("points"))
        summed = summed.join(extra, target, "left")
        amplified = amplified + F.coalesce("points", F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(MOST), amplified)), 2)
    return summed.select(target, "n_signals", F.round("confidence", 4).alias("confidence"), score.alias("score"), severity(score).alias("severity"))


def normalised(df: DataFrame, column: str, how: str = "min_max") -> DataFrame:
    """``df`` with ``normalised``: to 0..1 by the range, or in standard deviations cut at three."""
    stats = F.broadcast(df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.avg(column).alias("_m"), F.stddev_pop(column).alias("_sd")))  # one row
    value = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    if how == "z":
        value = F.when(F.col("_sd") > 0, F.least(F.lit(OUTLIER), F.greatest(F.lit(-OUTLIER), (F.col(column) - F.col("_m")) / F.col("_sd")))).otherwise(0.0)
    return df.crossJoin(stats).withColumn("normalised", value).drop("_lo", "_hi", "_m", "_sd")


def ranked(scored: DataFrame, target: str = "target", group: str | None = None) -> DataFrame:
    """Rank by falling score within a group (severity by default), ties by target."""
    # A group's rows are sorted in one task: give a narrower group where a severity is large.
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group or "severity").orderBy(F.desc("score"), target)))
