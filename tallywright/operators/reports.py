"""Grouped reports. Each takes column names and is one or two hash aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(flag: str | Column) -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.avg(F.coalesce(c, F.lit(False)).cast("int").cast("double"))


def field_means(df: DataFrame, keys: list[str], fields: list[str], counted: str) -> DataFrame:
    """Mean of each field per group, n = non-null values of ``counted``."""
    return df.groupBy(*keys).agg(*(F.avg(f).alias(f"mean_{f}") for f in fields), F.count(counted).alias("n"))


def macro_mean(df: DataFrame, keys: list[str], sample: list[str], value: str) -> DataFrame:
    """Mean over samples of the mean within a sample."""
    within = df.groupBy(*keys, *sample).agg(F.avg(value).alias("_v"))
    return within.groupBy(*keys).agg(F.avg("_v").alias("macro_mean"), F.count("_v").alias("n_samples"))


def run_rates(df: DataFrame, keys: list[str], flags: list[str], seconds: str, timed_out: str | Column | None = None) -> DataFrame:
    """Counts and rates of flags, and seconds in both readings: null as 0, and null left out."""
    out = [F.count(F.lit(1)).alias("n")]
    for f in flags:
        out += [F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f"n_{f}"), _rate(f).alias(f"rate_{f}")]
    out += [F.avg(F.coalesce(F.col(seconds), F.lit(0.0))).alias("mean_seconds_null_as_0"), F.avg(seconds).alias("mean_seconds"), F.median(seconds).alias("median_seconds"), F.max(seconds).alias("max_seconds")]
    if timed_out is not None:
        out.append(F.count_if(F.coalesce(F.col(timed_out) if isinstance(timed_out, str) else timed_out, F.lit(False))).alias("n_timed_out"))
    return df.groupBy(*keys).agg(*out)


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))


def spread(df: DataFrame, keys: list[str], sample: list[str], value: str) -> DataFrame:
    """Range of a sample's values (two at least), summed up per group."""
    each = df.groupBy(*keys, *sample).agg((F.max(value) - F.min(value)).alias("_s"), F.count(value).alias("_n")).where("_n >= 2")
    return each.groupBy(*keys).agg(F.avg("_s").alias("mean_spread"), F.median("_s").cast("double").alias("median_spread"), F.max("_s").alias("max_spread"), F.count(F.lit(1)).alias("n_samples"))


def coverage(df: DataFrame, keys: list[str], sample: list[str], skipped: str = "skipped", error: str | None = "errored") -> DataFrame:
    """Distinct scored samples and skipped rows; rows in error are left out unless ``error`` is None."""
    s = F.coalesce(F.col(skipped), F.lit(False))
    ok = ~s if error is None else ~s & ~F.coalesce(F.col(error), F.lit(False))
    return df.groupBy(*keys).agg(F.count_distinct(F.when(ok, F.struct(*sample))).alias("n_scored"), F.count_if(s).alias("n_skipped_rows"), F.count_distinct(F.when(s, F.struct(*sample))).alias("n_skipped"))


def rates_of_all(attempts: DataFrame, runs: DataFrame, keys: list[str], flags: list[str], means: dict[str, Column] | None = None) -> DataFrame:
    """Rates with all attempts as denominator: a missing run counts as failed. ``means``
    are averages over those runs that have the value, null where none has."""
    total = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_attempts"))
    good = runs.groupBy(*keys).agg(*(F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f"n_{f}") for f in flags), *(F.avg(c).alias(f"mean_{n}") for n, c in (means or {}).items()))
    joined = total.join(good, keys, "left")
    return joined.select(*keys, "n_attempts", *(F.coalesce(f"n_{f}", F.lit(0)).alias(f"n_{f}") for f in flags), *((F.coalesce(f"n_{f}", F.lit(0)) / F.col("n_attempts")).alias(f"rate_{f}") for f in flags), *(f"mean_{n}" for n in means or {}))


def rescued(original: DataFrame, recovered: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Both flags before and after recovery, in one aggregate over both tables: how many
    rows have the first, the second, both and neither, and ``rescued``, by how many
    more have the first one afterwards. A key of one table only counts as 0 in the other."""
    f, s = (F.coalesce(F.col(c), F.lit(False)) for c in (first, second))
    tagged = original.select(*keys, f.alias("_f"), s.alias("_s"), F.lit(False).alias("_after")).unionByName(recovered.select(*keys, f.alias("_f"), s.alias("_s"), F.lit(True).alias("_after")))
    first_ok, second_ok = F.col("_f"), F.col("_s")
    kinds = {"total": F.lit(True), "first": first_ok, "second": second_ok, "both": first_ok & second_ok, "neither": ~first_ok & ~second_ok}
    counts = [F.count_if(rule & when).alias(f"{name}_{kind}") for name, when in (("before", ~F.col("_after")), ("after", F.col("_after"))) for kind, rule in kinds.items()]
    return tagged.groupBy(*keys).agg(*counts).withColumn("rescued", F.col("after_first") - F.col("before_first"))


def best_in_group(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Label with the largest value; of ties the greatest label. Nulls and NaN can't win."""
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    best = usable.groupBy(*keys).agg(F.max(F.struct(value, label)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{label}").alias("best"), F.col(f"_b.{value}").alias("best_value"))


def flag_counts(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """How many rows have the first flag, the second, both, neither."""
    a, b = (F.coalesce(F.col(c), F.lit(False)) for c in (first, second))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(a).alias("n_first"), F.count_if(b).alias("n_second"), F.count_if(a & b).alias("n_both"), F.count_if(~a & ~b).alias("n_neither"))


def matrix(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of (row, column), largest first."""
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), row, column)


def cost(df: DataFrame, prices: DataFrame, judge: str, tokens_in: str, tokens_out: str, seconds: str) -> DataFrame:
    """Tokens, price and time per judge (unknown judges left out) and a total row, by rollup."""
    j = df.join(F.broadcast(prices), judge)  # a price per judge
    ti, to = (F.coalesce(F.col(c), F.lit(0)) for c in (tokens_in, tokens_out))
    usd = (ti * F.col("usd_in_per_m") + to * F.col("usd_out_per_m")) / 1e6
    out = j.rollup(judge).agg(F.count(F.lit(1)).alias("n"), F.sum(ti).alias("sum_in"), F.sum(to).alias("sum_out"), F.sum(usd).alias("usd"), F.sum(seconds).alias("sum_seconds"), F.grouping(judge).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(judge)).alias("judge"), "n", "sum_in", "sum_out", "usd", "sum_seconds", (F.col("sum_seconds") / F.col("n")).alias("mean_seconds"))


def ending(text: str) -> Column:
    """First 60 of the last 80 characters, line feeds shown."""
    return F.substring(F.replace(F.right(F.col(text), F.lit(80)), F.lit("\n"), F.lit("\\n")), 1, 60)


def failure_analysis(failed: DataFrame, parts: tuple[str, ...] = ("engine", "experiment"), most: dict[str, int] | None = None, error: str = "parse_error", raw: str = "raw_output", code_ok: str = "parse_ok_code", only: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Everything about failed rows (of ``failed`` those whose ``keys`` are in ``only``, if
    given; outputs are cut down before that join) from one scan, by grouping sets: a row per section
    and value with counts and lengths. Sections are ``all``, each of ``parts``, ``ending``
    (of outputs that were cut or don't parse, so not of API errors) and ``message``.

    ``api_errors`` are messages that begin with "no output"; ``cut`` are rows with any
    other message, whose output lengths are summed up. A null or empty message is
    "(none)". ``most`` bounds a section to its most frequent values (of equal counts
    the smaller value); rank counts from 1.
    """
    most = {"experiment": 10, "ending": 5, "message": 5} if most is None else most
    message = F.coalesce(F.col(error), F.lit(""))
    api, was_cut = message.startswith("no output"), (message != "") & ~message.startswith("no output")
    rows = failed.select(
        *keys, *parts, F.when(was_cut, ending(raw)).alias("ending"), F.when(message == "", "(none)").otherwise(message).alias("message"), api.alias("_api"), was_cut.alias("_cut"),
        F.when(was_cut, F.length(F.coalesce(F.col(raw), F.lit("")))).alias("_length"), F.coalesce(F.col(code_ok), F.lit(False)).alias("_code"),
    )
    if only is not None:
        rows = rows.join(only.select(*keys).distinct(), list(keys), "left_semi")
    sections = [*parts, "ending", "message"]
    grouped = rows.groupingSets([[], *([F.col(s)] for s in sections)], *map(F.col, sections)).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), F.count_if("_api").alias("api_errors"), F.count_if("_cut").alias("cut"), F.count_if("_code").alias("code_ok"),
        F.min("_length").alias("low"), F.median("_length").alias("median"), F.avg("_length").alias("mean"), F.max("_length").alias("high"),
    )
    whole = (1 << len(sections)) - 1
    section, value = F.when(F.col("_set") == whole, "all"), F.lit(None).cast("string")
    for i, s in enumerate(sections):
        here = F.col("_set") == whole - (1 << (len(sections) - 1 - i))
        section, value = section.when(here, s), F.when(here, F.col(s).cast("string")).otherwise(value)
    named = grouped.select(section.alias("section"), value.alias("value"), "n", "api_errors", "cut", "code_ok", "low", "median", "mean", "high").where("NOT (section = 'ending' AND value IS NULL)")
    bound = F.lit(2**31 - 1)
    for s, k in most.items():
        bound = F.when(F.col("section") == s, k).otherwise(bound)
    # The most frequent of each of many lots first, so a section of many values isn't one task.
    place = lambda *by: F.row_number().over(Window.partitionBy("section", *by).orderBy(F.desc("n"), F.asc("value")))
    lots = named.withColumn("_lot", F.pmod(F.xxhash64("value"), F.lit(64)))
    first = lots.withColumn("rank", place("_lot")).where(F.col("rank") <= bound).drop("_lot")
    return first.withColumn("rank", place()).where(F.col("rank") <= bound)


def recovery_summary(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    b, a = (F.coalesce(F.col(c), F.lit(False)) for c in (before, after))
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        n.alias("rows"), F.count_if(b).alias("originally_ok"), F.count_if(a).alias("now_ok"), F.count_if(a & ~b).alias("rescued"), F.count_if(~a & ~b).alias("still_lost"),
        (F.count_if(a) - F.count_if(b)).alias("ok_gain"), F.round(100.0 * F.count_if(b) / n, 1).alias("pct_before"), F.round(100.0 * F.count_if(a) / n, 1).alias("pct_after"),
    )


def shares(df: DataFrame, value: str) -> DataFrame:
    """Count of each value and its share of all rows."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(value, "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def gap(df: DataFrame, keys: list[str], by: str, upper: str, lower: str, value: str) -> DataFrame:
    """Mean of ``value`` where ``by`` is ``upper`` minus where it is ``lower``."""
    out = df.groupBy(*keys).agg(F.avg(F.when(F.col(by) == upper, F.col(value))).alias("mean_upper"), F.avg(F.when(F.col(by) == lower, F.col(value))).alias("mean_lower"))
    return out.withColumn("gap", F.col("mean_upper") - F.col("mean_lower"))


def scaled(df: DataFrame, value: str) -> DataFrame:
    """(v - min) / (max - min) over all rows, 0 where all are equal."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    heat = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.join(F.broadcast(ends)).withColumn("heat", F.coalesce(heat, F.lit(0.0))).drop("_lo", "_hi")


def true_entries(flags: Column) -> Column:
    """How many values of a map of booleans are true."""
    return F.size(F.filter(F.map_values(flags), lambda x: x))


def likert(score: Column) -> Column:
    """Stored 0-4 as shown 1-5."""
    return score + 1


def difference_in_differences(df: DataFrame, value: str, treated: Column, after: Column) -> DataFrame:
    cell = lambda t, a: F.avg(F.when(t & a, F.col(value)))
    return df.agg(((cell(treated, after) - cell(treated, ~after)) - (cell(~treated, after) - cell(~treated, ~after))).alias("did"))
