"""The fixed schemas of the engine's tables."""

from __future__ import annotations

MATRICES = "matrix_id long, i int, j int, v double"
VECTORS = "source string, sample_id long, x array<double>"
BINDINGS = "sample_id long, matrix_id long, rhs_id long, solution_id long, param_ids array<long>"
SAMPLES = "dataset_id string, sample_id long, matrix_id long, strategy string, row_kind tinyint, iter int, rhs array<double>, solution array<double>, params array<array<double>>"
TRACES = "system_id long, iter int, i int, r double, x double, p double, ap double"
RUNS = "run_id long, experiment string, assignment_id long, status string, start_time timestamp"
RUN_METRICS = "run_id long, key string, step long, value double"

#: Row kinds, as stored.
STANDARD, CG_INTERNAL = 0, 1
