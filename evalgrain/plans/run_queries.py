"""Run summaries, comparisons and ledgers over the trials made of `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrain.operators import compare, ledger, metrics
from evalgrain.plans.fixtures import rounded, trials, with_trials
from evalgrain.plans.registry import query


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = trials(spark, sf_dir)
    return t.where("run_id = 'run_a'"), t.where("run_id = 'run_b'")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.pair_runs(*_runs(spark, sf_dir))


_ACCURACY = """count(*) AS n_records, count(correct) AS n_graded, count(*) - count(correct) AS n_ungraded,
 count(DISTINCT item_id) AS n_items, count(*) FILTER (correct) AS n_correct"""


@query("agg_01_run_summary", with_trials(f"SELECT run_id, {_ACCURACY}, round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy FROM trials GROUP BY run_id"))
def run_summary(spark, sf_dir):
    return rounded(metrics.summarize(trials(spark, sf_dir), metrics.accuracy_columns()), "accuracy")


@query("agg_02_errors", with_trials("SELECT run_id, count(*) FILTER (status NOT IN ('completed', 'empty_answer')) AS n_errors, count(*) FILTER (parse_error) AS grader_parse_errors FROM trials GROUP BY run_id"))
def errors(spark, sf_dir):
    return metrics.summarize(trials(spark, sf_dir), metrics.error_columns())


@query("agg_02_status_histogram", with_trials("SELECT run_id, status, count(*) AS n FROM trials GROUP BY run_id, status"))
def status_histogram(spark, sf_dir):
    return metrics.status_histogram(trials(spark, sf_dir))


@query("agg_03_rates", with_trials("""SELECT run_id, round(avg(CASE WHEN extracted_answer IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS answer_rate,
 round(avg(CASE WHEN n_citations > 0 THEN 1.0 ELSE 0.0 END), 6) AS citation_rate, round(avg(CASE WHEN search_calls = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_search_rate,
 count(*) FILTER (correct AND search_calls = 0) AS correct_zero_search_count FROM trials GROUP BY run_id"""))  # fmt: skip
def rates(spark, sf_dir):
    return rounded(metrics.summarize(trials(spark, sf_dir), metrics.rate_columns()), "answer_rate", "citation_rate", "zero_search_rate")


@query("agg_04_tokens_costs", with_trials("""SELECT run_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
 CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, round(sum(total_cost), 6) AS cost_usd, round(sum(model_cost), 6) AS model_cost_usd,
 round(sum(grader_cost), 6) AS grader_cost_usd, round(sum(total_cost) / nullif(count(*) FILTER (correct), 0), 6) AS cost_per_correct_usd FROM trials GROUP BY run_id"""))  # fmt: skip
def costs(spark, sf_dir):
    return rounded(metrics.summarize(trials(spark, sf_dir), metrics.cost_columns()), "cost_usd", "model_cost_usd", "grader_cost_usd", "cost_per_correct_usd")


@query("agg_05_durations", with_trials("""SELECT run_id, round(sum(duration_seconds), 4) AS duration_total, round(avg(duration_seconds), 6) AS duration_mean,
 round(median(duration_seconds), 6) AS duration_median, round(quantile_cont(duration_seconds, 0.9), 6) AS duration_p90,
 round(quantile_cont(duration_seconds, 0.95), 6) AS duration_p95 FROM trials GROUP BY run_id"""))  # fmt: skip
def durations(spark, sf_dir):
    t = trials(spark, sf_dir)
    out = metrics.with_duration_quantiles(metrics.summarize(t, metrics.duration_columns()), t)
    return rounded(rounded(out, "duration_total", digits=4), "duration_mean", "duration_median", "duration_p90", "duration_p95")


_CALLS = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}_total, round(avg({c}), 6) AS {c}_mean" for c in metrics.CALLS)


@query("agg_06_calls", with_trials(f"SELECT run_id, {_CALLS} FROM trials GROUP BY run_id"))
def calls(spark, sf_dir):
    return rounded(metrics.summarize(trials(spark, sf_dir), metrics.call_columns()), *[f"{c}_mean" for c in metrics.CALLS])


_Z = "1.959963984540054"


@query("agg_07_wilson", with_trials(f""", s AS (SELECT run_id, count(*)::DOUBLE AS n, count(*) FILTER (correct) / count(*)::DOUBLE AS p FROM trials GROUP BY run_id),
 w AS (SELECT run_id, (p + {_Z}*{_Z}/(2*n)) / (1 + {_Z}*{_Z}/n) AS mid, {_Z} * sqrt((p*(1-p) + {_Z}*{_Z}/(4*n)) / n) / (1 + {_Z}*{_Z}/n) AS half FROM s)
 SELECT run_id, round(greatest(0.0, mid - half), 6) AS wilson_low, round(least(1.0, mid + half), 6) AS wilson_high FROM w"""))  # fmt: skip
def wilson(spark, sf_dir):
    out = metrics.with_wilson(metrics.summarize(trials(spark, sf_dir), metrics.accuracy_columns()))
    return rounded(out.select("run_id", "wilson_low", "wilson_high"), "wilson_low", "wilson_high")


def _binomial_sql(name: str, laws: str, points: str) -> str:
    """CTEs: `name`(law, id, draw), the inverse of the binomial laws (law, n, p) at points (law, id, u), by counting table rows below u."""
    return f"""{name}_l AS (SELECT law, n, p, CASE WHEN p >= 1 THEN n ELSE greatest(0, floor(n * p - 9 * sqrt(n * p * (1 - p)) - 9)) END::BIGINT AS low,
  CASE WHEN p <= 0 THEN 0 ELSE least(n, ceil(n * p + 9 * sqrt(n * p * (1 - p)) + 9)) END::BIGINT AS high FROM ({laws})),
 {name}_j AS (SELECT law, n, p, low, unnest(range(least(low, high), high + 1)) AS j FROM {name}_l),
 {name}_w AS (SELECT law, low, j, sum(CASE WHEN j > low THEN ln((n - j + 1) / j) + ln(p / (1 - p)) ELSE 0.0::DOUBLE END) OVER (PARTITION BY law ORDER BY j) AS w FROM {name}_j),
 {name}_e AS (SELECT law, low, j, exp(w - max(w) OVER (PARTITION BY law)) AS e FROM {name}_w),
 {name}_c AS (SELECT law, low, j, sum(e) OVER (PARTITION BY law ORDER BY j) / sum(e) OVER (PARTITION BY law) AS cdf FROM {name}_e),
 {name} AS (SELECT q.law, q.id, min(c.j) + count(*) FILTER (c.cdf < q.u) AS draw FROM ({points}) q JOIN {name}_c c ON c.law = q.law GROUP BY q.law, q.id)"""


def _uniform_sql(said: str) -> str:
    return f"('0x' || substr(md5('0:' || {said}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE"


_ACCURACY = _binomial_sql("d", "SELECT run_id AS law, n, k / n::DOUBLE AS p FROM g", f"SELECT run_id AS law, id, {_uniform_sql('id')} AS u FROM g, range(10000) r(id)")


@query("agg_08_bootstrap", with_trials(f""", g AS (SELECT run_id, count(*) AS n, count(*) FILTER (correct) AS k FROM trials GROUP BY run_id), {_ACCURACY},
 o AS (SELECT law AS run_id, draw / n::DOUBLE AS e, row_number() OVER (PARTITION BY law ORDER BY draw, id) - 1 AS place FROM d JOIN g ON g.run_id = d.law)
 SELECT run_id, max(e) FILTER (place = 250) AS bootstrap_low, max(e) FILTER (place = 9749 - 1) AS bootstrap_high FROM o GROUP BY run_id"""))
def bootstrap(spark, sf_dir):
    return metrics.bootstrap_accuracy(trials(spark, sf_dir))


@query("agg_09_calibration", with_trials(""", p AS (SELECT run_id, confidence / 100 AS p, CASE WHEN correct THEN 1.0 ELSE 0.0 END AS hit FROM trials WHERE confidence IS NOT NULL AND correct IS NOT NULL),
 b AS (SELECT run_id, CASE WHEN p >= 0 AND p < 1 THEN (SELECT max(i) FROM range(10) r(i) WHERE p >= i / 10.0::DOUBLE) WHEN p = 1 THEN 9 END AS bin, p, hit FROM p),
 g AS (SELECT run_id, bin, count(*) AS n, abs(avg(p) - avg(hit)) AS gap FROM b WHERE bin IS NOT NULL GROUP BY run_id, bin)
 SELECT p.run_id, count(*) AS n, round(avg((p - hit) * (p - hit)), 6) AS brier,
  round((SELECT sum(g.n * g.gap) FROM g WHERE g.run_id = p.run_id) / count(*), 6) AS ece FROM p GROUP BY p.run_id"""))  # fmt: skip
def calibration(spark, sf_dir):
    return rounded(metrics.calibration(trials(spark, sf_dir)), "brier", "ece")


@query("agg_10_pass_at_k", with_trials(""", f AS (SELECT run_id, item_id, min(attempt) FILTER (correct) AS first FROM trials GROUP BY run_id, item_id),
 k AS (SELECT run_id, unnest(range(1, max(attempt) + 1)) AS k FROM trials GROUP BY run_id)
 SELECT k.run_id, k.k, round(avg(CASE WHEN f.first <= k.k THEN 1.0 ELSE 0.0 END), 6) AS pass_at_k FROM k JOIN f USING (run_id) GROUP BY k.run_id, k.k"""))  # fmt: skip
def pass_at_k(spark, sf_dir):
    return rounded(metrics.pass_at_k(trials(spark, sf_dir)), "pass_at_k")


_LEDGER = """, o AS (SELECT *, status = 'completed' AND correct IS NOT NULL AS graded, coalesce(correct, false) AS ok,
  row_number() OVER (PARTITION BY subset_rank ORDER BY finished_at, run_id, attempt) AS up FROM trials),
 m AS (SELECT subset_rank, min(up) AS a, max(up) AS b, coalesce(max(up) FILTER (ok), max(up)) AS c, min(up) FILTER (graded) AS d, max(up) FILTER (graded) AS e FROM o GROUP BY subset_rank),
 l AS (SELECT subset_rank, unnest(['strict_first_terminal', 'latest_terminal', 'best_observed_after_repair', 'graded_first_completion', 'graded_latest_completion']) AS policy, unnest([a, b, c, d, e]) AS up FROM m),
 ledger AS (SELECT l.subset_rank, l.policy, o.run_id, o.attempt, o.status, o.correct, o.finished_at FROM l JOIN o ON o.subset_rank = l.subset_rank AND o.up = l.up)"""


@query("agg_11_ledgers", with_trials(_LEDGER + " SELECT * FROM ledger"))
def ledgers(spark, sf_dir):
    return ledger.ledgers(trials(spark, sf_dir))


@query("agg_12_ledger_summary", with_trials(_LEDGER + """ SELECT policy, count(*) AS attempted, count(*) FILTER (correct) AS correct, count(*) - count(*) FILTER (correct) AS incorrect,
 round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy_among_attempted, greatest(250 - count(*), 0) AS questions_without_terminal_record,
 round(count(*) FILTER (correct) / 250.0::DOUBLE, 6) AS full_set_correct_coverage, string_agg(CAST(subset_rank AS VARCHAR), ',' ORDER BY subset_rank) AS subset_ranks FROM ledger GROUP BY policy"""))  # fmt: skip
def ledger_summary(spark, sf_dir):
    out = ledger.ledger_summary(ledger.ledgers(trials(spark, sf_dir)), 250)
    return rounded(out, "accuracy_among_attempted", "full_set_correct_coverage")


@query("agg_12_rank_ranges", with_trials(_LEDGER + """, i AS (SELECT policy, subset_rank, subset_rank - row_number() OVER (PARTITION BY policy ORDER BY subset_rank) AS island FROM ledger)
 SELECT policy, min(subset_rank) AS low, max(subset_rank) AS high FROM i GROUP BY policy, island"""))  # fmt: skip
def rank_ranges(spark, sf_dir):
    return ledger.rank_ranges(ledger.ledgers(trials(spark, sf_dir)), 64)


@query("agg_12_version_counts", with_trials("""SELECT count(*) FILTER (event_id % 13 > 0 AND event_id % 17 > 0) AS terminal_record_versions, count(*) FILTER (status = 'completed' AND correct IS NOT NULL AND event_id % 13 > 0 AND event_id % 17 > 0) AS graded_record_versions,
 count(*) FILTER (NOT (status = 'completed' AND correct IS NOT NULL)) AS unscored_record_versions, count(*) FILTER (event_id % 13 = 0 OR event_id % 17 = 0) AS quarantined_record_versions FROM trials"""))  # fmt: skip
def version_counts(spark, sf_dir):
    t = trials(spark, sf_dir)
    t = t.withColumn("finished_at", F.when(F.col("event_id") % 13 > 0, F.col("finished_at"))).withColumn("subset_rank", F.when(F.col("event_id") % 17 > 0, F.col("subset_rank")))
    return ledger.version_counts(t)


_PAIRS = """, a AS (SELECT * FROM trials WHERE run_id = 'run_a'), b AS (SELECT * FROM trials WHERE run_id = 'run_b'),
 p AS (SELECT a.run_id AS la, b.run_id AS rb, coalesce(a.correct, false) AS x, coalesce(b.correct, false) AS y, a.duration_seconds - b.duration_seconds AS ds, a.total_cost - b.total_cost AS dc
  FROM a FULL JOIN b ON a.source_index = b.source_index AND a.attempt = b.attempt), c AS (SELECT * FROM p WHERE la IS NOT NULL AND rb IS NOT NULL)"""


@query("join_01_paired_keys", with_trials(_PAIRS + " SELECT count(*) FILTER (la IS NOT NULL AND rb IS NOT NULL) AS n_common, count(*) FILTER (rb IS NULL) AS n_left_only, count(*) FILTER (la IS NULL) AS n_right_only FROM p"))
def paired_keys(spark, sf_dir):
    return compare.key_overlap(_pairs(spark, sf_dir))


@query("agg_13_14_contingency", with_trials(_PAIRS + """, t AS (SELECT count(*) FILTER (x AND y) AS both_correct, count(*) FILTER (x AND NOT y) AS left_only_correct,
 count(*) FILTER (NOT x AND y) AS right_only_correct, count(*) FILTER (NOT x AND NOT y) AS both_wrong, count(*) AS n FROM c)
 SELECT *, round((both_correct + left_only_correct) / n::DOUBLE, 6) AS left_accuracy, round((both_correct + right_only_correct) / n::DOUBLE, 6) AS right_accuracy,
 round((left_only_correct - right_only_correct) / n::DOUBLE, 6) AS accuracy_difference,
 round(least(1.0, (SELECT 2 * sum(exp(lgamma(left_only_correct + right_only_correct + 1) - lgamma(i + 1) - lgamma(left_only_correct + right_only_correct - i + 1) - (left_only_correct + right_only_correct) * ln(2.0)))
  FROM range(0, least(left_only_correct, right_only_correct) + 1) r(i))), 6) AS pvalue FROM t"""))  # fmt: skip
def contingency(spark, sf_dir):
    return rounded(compare.contingency(_pairs(spark, sf_dir)), "left_accuracy", "right_accuracy", "accuracy_difference", "pvalue")


_LEFT = _binomial_sql("l", "SELECT 0 AS law, n, a / n::DOUBLE AS p FROM t", f"SELECT 0 AS law, id, {_uniform_sql("id || ':left'")} AS u FROM range(10000) r(id)")
_RIGHT = _binomial_sql("r", "SELECT DISTINCT draw AS law, n - draw AS n, coalesce(b / nullif(n - a, 0)::DOUBLE, 0) AS p FROM l, t", f"SELECT draw AS law, id, {_uniform_sql("id || ':right'")} AS u FROM l")


@query("agg_15_paired_bootstrap", with_trials(f"""{_PAIRS}, t AS (SELECT count(*) AS n, count(*) FILTER (x AND NOT y) AS a, count(*) FILTER (NOT x AND y) AS b FROM c), {_LEFT}, {_RIGHT},
 f AS (SELECT (law - draw) / n::DOUBLE AS difference FROM r, t)
 SELECT round(quantile_cont(difference, 0.025), 9) AS difference_low, round(quantile_cont(difference, 0.975), 9) AS difference_high FROM f"""))
def paired_bootstrap(spark, sf_dir):
    return rounded(compare.paired_bootstrap(_pairs(spark, sf_dir)), "difference_low", "difference_high", digits=9)


@query("agg_16_mean_differences", with_trials(_PAIRS + " SELECT round(avg(ds), 6) AS mean_seconds_difference, round(avg(dc), 6) AS mean_cost_difference FROM c"))
def mean_differences(spark, sf_dir):
    return rounded(compare.mean_differences(_pairs(spark, sf_dir)), "mean_seconds_difference", "mean_cost_difference")


@query("agg_17_run_table", with_trials("""SELECT run_id, count(*) AS n_records, round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy, round(sum(total_cost), 6) AS cost_usd,
 round(median(duration_seconds), 6) AS duration_median FROM trials GROUP BY run_id"""))  # fmt: skip
def run_table(spark, sf_dir):
    t = trials(spark, sf_dir)
    out = metrics.with_duration_quantiles(metrics.summarize(t, [*metrics.accuracy_columns(), *metrics.cost_columns(), *metrics.duration_columns()]), t)
    return rounded(out.select("run_id", "n_records", "accuracy", "cost_usd", "duration_median"), "accuracy", "cost_usd", "duration_median")


@query("set_01_key_sets", with_trials("""SELECT 'both' AS part, source_index, attempt FROM (SELECT source_index, attempt FROM trials WHERE run_id = 'run_a' INTERSECT SELECT source_index, attempt FROM trials WHERE run_id = 'run_b')
 UNION ALL SELECT 'left', source_index, attempt FROM (SELECT source_index, attempt FROM trials WHERE run_id = 'run_a' EXCEPT SELECT source_index, attempt FROM trials WHERE run_id = 'run_b')
 UNION ALL SELECT 'right', source_index, attempt FROM (SELECT source_index, attempt FROM trials WHERE run_id = 'run_b' EXCEPT SELECT source_index, attempt FROM trials WHERE run_id = 'run_a')"""))  # fmt: skip
def key_sets(spark, sf_dir):
    a, b = (r.select(*compare.KEY) for r in _runs(spark, sf_dir))
    parts = (("both", a.intersect(b)), ("left", a.subtract(b)), ("right", b.subtract(a)))
    out = [df.select(F.lit(name).alias("part"), *compare.KEY) for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("join_02_work_list", with_trials("""SELECT i.item_id, a.attempt FROM (SELECT DISTINCT item_id FROM trials) i CROSS JOIN (SELECT unnest(range(1, 41)) AS attempt) a
 LEFT JOIN (SELECT DISTINCT item_id, attempt FROM trials WHERE run_id = 'run_a') t ON t.item_id = i.item_id AND t.attempt = a.attempt WHERE t.item_id IS NULL"""))  # fmt: skip
def work_list(spark, sf_dir):
    t = trials(spark, sf_dir)
    return ledger.work_list(t.select("item_id").distinct(), t.where("run_id = 'run_a'"), 40)


@query("top_01_seeded_order", with_trials("""SELECT item_id, attempt, row_number() OVER (ORDER BY sha256('7|' || item_id || '|' || attempt), item_id, attempt) AS place
 FROM (SELECT DISTINCT item_id, attempt FROM trials)"""))  # fmt: skip
def seeded_order(spark, sf_dir):
    return ledger.seeded_order(trials(spark, sf_dir).select("item_id", "attempt").distinct(), 7)


@query("win_08_retry_states", with_trials("""SELECT run_id, item_id, max(attempt) + 1 AS next_attempt,
 CASE WHEN bool_or(coalesce(correct, false)) THEN 'completed' WHEN max(attempt) < 40 THEN 'retry_pending' ELSE 'failed' END AS state,
 coalesce((SELECT string_agg(extracted_answer, '|' ORDER BY first) FROM (SELECT extracted_answer, min(attempt) AS first FROM trials u WHERE u.run_id = t.run_id AND u.item_id = t.item_id AND extracted_answer IS NOT NULL GROUP BY extracted_answer)), '') AS tried
 FROM trials t GROUP BY run_id, item_id"""))  # fmt: skip
def retry_states(spark, sf_dir):
    return ledger.retry_states(trials(spark, sf_dir), 40)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, interval and pass@k by run."""
    t = trials(spark, sf_dir)
    return metrics.with_wilson(metrics.summarize(t, metrics.accuracy_columns())).join(metrics.pass_at_k(t), "run_id")
