"""Fixed values that results depend on."""

from __future__ import annotations

# Times in milliseconds.
CAPTURE_INTERVAL_MS = 250
HOUSED_TIMEOUT_MS, QUEUED_TIMEOUT_MS = 1000, 2000
RECORD_INTERVAL_MS, RECORD_GAP_MS, RESOURCE_JUMP, COUNT_JUMP, BLINK_WINDOW_MS = 5000, 1000, 150, 3, 2000
FLOATING_MIN_MS, SAVE_UP_MS = 30_000, 60_000
# Phase thresholds (food, wood, gold, stone), exceeded strictly.
PHASES = ("Dark", "Feudal", "Castle", "Imperial")
PHASE_TECHS = {101: 1, 102: 2, 103: 3}
THRESHOLDS = ((200, 200, 100, 200), (500, 500, 300, 300), (800, 800, 500, 500), (1000, 1000, 1000, 1000))
RESOURCES = ("food", "wood", "gold", "stone")
# Smoothing, grades and the speed of telemetry without a replay.
MIN_SPIKE, MAX_SPIKE_MS = 2, 2000
GOLD_PERCENT, SILVER_PERCENT, GOLD_STARS, SILVER_STARS = 2.0, 4.0, 6, 4
TELEMETRY_SPEED = 1.7
# Clock alignment.
MIN_SPEED, MAX_SPEED, MATCH_SLACK_MS, MIN_MATCHED, MIN_SHARE = 0.5, 4.0, 275.0, 10, 0.5
DROP_FRACTION, DROP_GAP_MS, VOTE_SIMILARITY = 0.4, 1500, 0.5
WINDOW_MS, WINDOW_STEP_MS, SPEED_STEP, OFFSET_BIN_MS, WINDOW_SLACK_MS, WINDOW_INLIERS = 120_000.0, 60_000.0, 1.005, 250.0, 625.0, 3
SEGMENT_SLACK_MS, SEED_PAIRS, MIN_SEGMENT_PAIRS, FROZEN_SHARE, MIN_PAUSE_MS = 125.0, 4, 5, 0.5, 2000.0
SPEED_MARGIN, EXTRAPOLATION_SPAN_MS, EXTENSION_SEARCH = 1.1, 60_000.0, 4.0
# Sanity checks.
BEFORE_MS, AFTER_MS, DELAY_MS, TAKE_FRACTION, OVERCLAIM = 1500, 2500, 250, 0.4, 0.7
LARGE_INCREASE, RESEED_LOW, RESEED_HIGH, LEAST_DROP, POP_SPIKE, EXAMPLES = 80, 40, 60, 20, 2, 10
