"""Schemas of the evaluation data, as Spark DDL. Sample ids are strings: leading zeros count."""

KEY = ("engine", "experiment", "sample_id")

ATTEMPT = (
    "model STRING, engine STRING, experiment STRING, sample_id STRING, raw_output STRING, parsed_cot STRING, "
    "parsed_code STRING, parse_ok_cot BOOLEAN, parse_ok_code BOOLEAN, parse_error STRING"
)
RECOVERED = ATTEMPT + ", parse_ok_cot_orig BOOLEAN, parsed_cot_partial BOOLEAN, cot_recovery_method STRING, cot_recovery_error STRING"
SCORES = (
    "STRUCT<name: INT, statement: INT, formula: INT, overall: INT, codebleu: DOUBLE, ngram_match_score: DOUBLE, "
    "weighted_ngram_match_score: DOUBLE, syntax_match_score: DOUBLE, dataflow_match_score: DOUBLE, syntax_ok: BOOLEAN, "
    "runs_without_error: BOOLEAN, produces_video_mp4: BOOLEAN, exit_code: INT, wall_time_s: DOUBLE, timed_out: BOOLEAN, "
    "video_bytes: BIGINT, video_path: STRING>"
)
EVALUATION = (
    "engine STRING, experiment STRING, sample_id STRING, model STRING, scorer STRING, judge_model STRING, "
    f"scores {SCORES}, justification STRING, raw_response STRING, latency_s DOUBLE, tokens_in BIGINT, tokens_out BIGINT, "
    "judge_error STRING, skipped BOOLEAN, skip_reason STRING"
)
SIMILARITY = (
    "scorer STRING, model STRING, engine STRING, experiment STRING, sample_id STRING, rendered_path STRING, "
    "reference_path STRING, dino_cosine DOUBLE, xclip_cosine DOUBLE, status STRING, error STRING"
)
LIKERT = "name INT, statement INT, formula INT, overall INT, justification STRING"
