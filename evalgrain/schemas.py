"""Explicit schemas of the tables that the operators read."""

from __future__ import annotations

METRICS = (
    "steps long, search_calls long, page_opens long, find_calls long, retrieved_chars long, external_model_calls long,"
    " duration_seconds double, input_tokens long, output_tokens long, cached_tokens long, model_cost_usd double,"
    " grader_input_tokens long, grader_output_tokens long, grader_cost_usd double, total_cost_usd double"
)
GRADING = "correct boolean, extracted_answer string, reasoning string, grader_response string, grader_mode string, parse_error string"

TRIALS = (
    "schema_version string, run_id string, item_id string, subset_rank long, source_index long, attempt long, model string,"
    " status string, started_at string, finished_at string, answer_response string, extracted_answer string,"
    " explanation string, confidence double, citations array<string>, correct boolean,"
    f" grading struct<{GRADING.replace(' string', ':string').replace(' boolean', ':boolean')}>,"
    f" metrics struct<{METRICS.replace(' long', ':long').replace(' double', ':double')}>, error string"
)

PUBLIC_TRIALS = "source_index long, attempt long, correct string, duration_seconds string, total_cost_usd string"

EVENTS = (
    "schema_version string, timestamp timestamp, run_id string, item_id string, subset_rank long, attempt long,"
    " event string, step long, phase string, action string, ok boolean, body string"
)
