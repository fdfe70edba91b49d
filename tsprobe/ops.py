"""Public names of the library, grouped as in the documentation."""

# sources and sinks
from tsprobe.sources.datasets import (  # noqa: F401
    artifact_texts, check_channels, load_artifacts, load_windows, parse_class_shots, parse_label_maps, read_qa, write_qa, write_split,
)
from tsprobe.sources.logs import (  # noqa: F401
    append_results, export_tsv, line_counts, parse_auto, parse_jsonl, parse_ragged, ragged_counts, read_jsonl, read_lines,
    read_ragged_tsv, read_tsv, scan_layers, scan_predictions, scan_variants, upsert_snapshot, valid_rows, write_jsonl,
)
from tsprobe.sources.recordings import (  # noqa: F401
    format_ts, label_recordings, pair_variants, parse_label_csv, parse_sensor_log, parse_ts, rank_variants, read_series_csv,
    read_ts, read_variants, trial_samples, ts_header, unlabelled, write_ts,
)

# ordering
from tsprobe.operators.ordering import exact_quantiles, hash_rank, hash_select, neighbours, positions, running_sums  # noqa: F401

# windows and scaling
from tsprobe.operators.windows import (  # noqa: F401
    chunk_arrays, chunk_left_pad, count_windows, label_center, label_majority, lookback_horizon, pad_trim_center, token_windows,
)
from tsprobe.operators.scaling import (  # noqa: F401
    apply_scaler, apply_vector_scaler, fit_channel_scaler, fit_value_scaler, fit_vector_scaler, invert_scaler, znorm_long, znorm_windows,
)
from tsprobe.functions.series import hann_power as stft_power  # noqa: F401
from tsprobe.functions.series import canonical, drop_channels, keep_channels, mono, reshape, transpose, znorm  # noqa: F401

# labels, splits, samples, folds, baselines
from tsprobe.functions.labels import attach_labels, dense_index, numeric_order, option_block, remap, with_letters, zero_base  # noqa: F401
from tsprobe.operators.splits import (  # noqa: F401
    baseline_predict, chronological_split, class_histogram, few_shots, first_n, group_split, interleave_shots, kfold_contiguous,
    kfold_stratified, prior, reindex, shuffle_reindex, stratified_sample, stratified_split, take_with_shots, time_folds,
    uniform_sample, unseen_labels,
)
from tsprobe.operators.checks import class_coverage, cross_dataset, dataset_statistics, layer_alignment, row_alignment, valid_kinds  # noqa: F401

# evaluation
from tsprobe.operators.metrics import (  # noqa: F401
    classification_metrics, confusion, correct_flag, fill_forecast, forecast_error_pooled, forecast_error_rows, forecast_pairs,
    metrics_from_cells, next_lookback, pass_at_k, running_accuracy, running_mae, vote, vote_list, with_empty_runs,
)
from tsprobe.operators.bootstrap import bootstrap_ci, bootstrap_hash_scores, bootstrap_scores, interval  # noqa: F401
from tsprobe.operators.progress import (  # noqa: F401
    attempt_progress, completeness, first_incomplete_batch, grid, pending_attempts, progress_totals, run_completeness, variant_progress,
)

# results tables
from tsprobe.functions.paths import run_keys, run_keys_from_right, run_modality  # noqa: F401
from tsprobe.operators.results import (  # noqa: F401
    apply_filters, base_vs_control, box_outliers, box_stats, clean_results, common_values, cost_summary, flat_lines, keep_latest,
    last_layer, last_layer_table, max_layer_rows, prefer_zero_shot, probe_curve, prompt_baselines, signed_ranks, stability,
    standardise, stitch, top_common, upsert, variant_summary, wilcoxon_greater,
)

# trends, texts, questions
from tsprobe.operators.trends import overall_trend, step_trends, trend_segments, trend_text, trend_totals, window_segments  # noqa: F401
from tsprobe.functions.text import (  # noqa: F401
    digit_text, extract_letter, last_number, parse_forecast, scaled_digit_text, serialize_series, strip_header,
)
from tsprobe.operators.qa import (  # noqa: F401
    assemble_conversations, build_prompts, classification_qa, collect_answers, export_records, few_shot_messages, forecast_prompt,
    join_answers, merge_answers, stage2_class_qa, stage2_text_qa, trend_record, window_records,
)

# vectors and probes
from tsprobe.functions.vectors import cosine_distance, euclidean_distance, l2_normalise, manhattan_distance  # noqa: F401
from tsprobe.operators.vectors import masked_mean_pool, select_layer, tail_patch_pool, vector_mean  # noqa: F401
from tsprobe.operators.knn import knn_cv, knn_grid, knn_predict, nearest, nearest_approximate, recall, visited_pairs  # noqa: F401
from tsprobe.operators.probes import logistic_probe, logistic_probe_layers, ridge_layers, ridge_probe, ridge_time_probe  # noqa: F401

# streams
from tsprobe.streaming.live import (  # noqa: F401
    batch_writer, exactly_once, latest_rows, live_accuracy, read_log_stream, run_to_end, stream_windows, upsert_writer,
)
