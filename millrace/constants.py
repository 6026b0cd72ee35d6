"""Names, thresholds and limits that results depend on."""

from __future__ import annotations

OPERATIONS = ["review", "map", "revalidate"]
SPLITS = ["train", "validation", "test"]
ALL_SPLITS = [*SPLITS, "hard_boundary", "all"]

CATEGORIES = ["bug", "security", "performance", "concurrency", "api-contract", "data-loss", "test-gap", "docs-gap", "build-release", "maintainability"]
SEVERITIES = ["critical", "high", "medium", "low"]
CONFIDENCES = ["high", "medium", "low"]
FEATURE_KINDS = ["cli-command", "route", "ui-flow", "service", "job", "agent-tool", "library", "config", "release", "test-suite", "infra", "unknown"]
TRUST_BOUNDARIES = ["user-input", "network", "filesystem", "secrets", "process-exec", "database", "auth", "permissions", "concurrency", "external-api", "serialization"]
OUTCOMES = ["fixed", "open", "false-positive", "uncertain"]
OUTCOME_CLASSES = {"needs-attention": ["open", "uncertain"], "not-open": ["fixed", "false-positive"]}
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with"]

REPO_SPLITS = {"click": "train", "hono": "train", "ripgrep": "validation"}
HARD_CLEAN, HARD_NONEMPTY = 8, 18
WINDOW_BYTES, WINDOW_RADIUS, CLEAN_LINES = 4000, 10, 28
TARGETS = {"review": 500, "revalidate": 100, "map": 25}
PER_REPO = {"review": 43, "revalidate": 16, "map": 1}
LEAST_REPOS = 5
THRESHOLDS = {"f1": 0.8, "cleanAccuracy": 0.95, "schemaValidRate": 1.0, "evidenceValidRate": 1.0}
MATCH_FINDING, MATCH_FEATURE = 0.55, 0.2
CONTENT_KEYS = ["messages", "prompt", "schema", "rawOutput", "acceptedOutput", "rejectedOutput", "error"]
LATENCY_KEYS = ["latencyMs", "latency_ms", "durationMs", "duration_ms", "elapsedMs", "elapsed_ms"]
COST_KEYS = ["costUsd", "cost_usd", "cost"]
METRIC_CONTAINERS = ["usage", "metrics", "timing", "metadata"]
WRAPPER_KEYS = ["prediction", "output", "response", "completion", "generated_text", "content", "text", "assistant"]

PATH_PREFIXES = ["README", "LICENSE", "COPYING", "UNLICENSE", "Makefile"]
#: Notes that windowing puts where it cuts.
NOTE_TRUNCATED = "\n[Window note: prelude truncated to fit training budget.]\n"
NOTE_MIDDLE = "\n[Window note: middle prompt context omitted to fit training budget.]\n"
NOTE_TRAILING = "\n[Window note: trailing file context omitted to fit training budget.]\n"
#: Markers in prompts.
FILES_MARK, SHAPE_MARK = "\nFiles:\n", "\nJSON shape:"
PATHS_MARK, CONTEXT_MARK, INVENTORY_MARK, FINDING_MARK = "Valid evidence paths are exactly:\n", "\nPrompt context:\n", "Repository inventory:\n", "Finding:\n"

FINDING_KEYS = ["title", "category", "severity", "confidence", "evidence", "reasoning", "reproduction", "recommendation", "whyTestsDoNotAlreadyCoverThis", "suggestedRegressionTest", "minimumFixScope"]
FEATURE_KEYS = [
    "schemaVersion", "featureId", "title", "summary", "kind", "source", "confidence", "entrypoints", "ownedFiles", "contextFiles", "tests",
    "status", "findingIds", "patchAttemptIds", "analysisHistory", "lock", "tags", "trustBoundaries", "reason", "createdAt", "updatedAt",
]
REQUIRED_FIELDS = {
    "map": {"features": "array", "created": "number", "changed": "number", "stale": "number"},
    "revalidate": {"outcome": "string", "reasoning": "string", "commands": "array"},
    "review": {"findings": "array", "inspected": "object"},
}
