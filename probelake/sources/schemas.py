"""Record schemas, as DDL. Production scans never infer a schema."""

from __future__ import annotations

DEPENDENCIES = "array<struct<file:string, hops:int>>"
QUALITY = "struct<complexity_score:int, left_complexity:int, right_complexity:int, is_quality:boolean, reason:string>"
_USAGE = (
    "struct<completion_tokens:int, prompt_tokens:int, total_tokens:int, "
    "completion_tokens_details:struct<audio_tokens:int, reasoning_tokens:int, accepted_prediction_tokens:int, rejected_prediction_tokens:int>, "
    "prompt_tokens_details:struct<audio_tokens:int, cached_tokens:int>, prompt_cache_hit_tokens:int, prompt_cache_miss_tokens:int>"
)
_ERROR = "struct<type:string, message:string, status_code:int>"
_MESSAGES = "array<struct<role:string, content:string>>"
_TASK = "task_id string, reponame string, testpath string, testname string, classname string, funcname string, imports array<string>, code string, masked_code string"

MASKED_TASK = f"{_TASK}, ground_truth string, quality_analysis {QUALITY}"
AUGMENTED_TASK = f"{_TASK}, ground_truth array<string>, quality_analysis {QUALITY}"
FUNCTION_REPORT = f"test_file string, test_function string, dependencies {DEPENDENCIES}"
FILE_REPORT = f"test_file string, dependencies {DEPENDENCIES}"
RANKING = "task_id string, reponame string, testpath string, testname string, funcname string, related_files_rank array<string>"
OUTPUT_PREDICTION = f"task_id string, experiment_type string, sample_id int, response string, finish_reason string, usage {_USAGE}"
OUTPUT_INTERACTION = f"task_id string, experiment_type string, sample_id int, timestamp_utc timestamp, messages_sent_to_model {_MESSAGES}, model_used string, related_files_provided_to_prompt array<string>, api_error_details {_ERROR}"
CHAIN_PREDICTION = f"task_id string, test_file string, sample_id int, ratio double, response string, finish_reason string, usage {_USAGE}"
CHAIN_INTERACTION = f"task_id string, test_file string, sample_id int, ratio double, messages {_MESSAGES}, files_in_prompt array<string>, ground_truth_chain array<string>, error {_ERROR}"
CHAIN_EVALUATION = (
    "reponame string, ratio string, task_id string, test_file string, sample_id int, num_truth_files int, num_pred_files int, "
    "precision double, recall double, f1 double, exact_match int, truth_files array<string>, predicted_files array<string>"
)
OUTPUT_EVALUATION = "task_id string, reponame string, condition string, mode string, difficulty string, ground_truth array<string>, predictions array<string>, num_correct int, num_samples int, pass_at_k map<string, double>"
EXECUTION_EVALUATION = "task_id string, reponame string, condition string, mode string, ground_truth string, predictions array<string>, num_correct int, num_samples int, pass_at_k map<string, double>, execution_results array<boolean>"
RUNTIME_TRUTH = "task_id string, reponame string, condition string, original_ground_truth string, runtime_ground_truth struct<status:string, value:string, type:string, error:string, traceback:string, details:string>"
COMMAND_LOG = "command string, success boolean, stdout string, stderr string, execution_time double"
CONVERSATION_LOG = f"repo_name string, model string, messages {_MESSAGES}, response string, timestamp string"
TRACE_EVENT = "test_nodeid string, seq bigint, kind string, filename string"
