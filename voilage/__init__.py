"""Anonymization of personal-record tables, and the risk that remains, as Spark jobs."""

from voilage.config import Roles, Rule, Settings, preset
from voilage.operators.classes import (
    class_key, class_sizes, class_stats, class_verdicts, distribution, keep_rows, qi_column,
    suppress_classes, tvd, with_class_size,
)
from voilage.operators.policy import (
    allowed_actions, choose_rules, classify, data_dictionary, default_rules, fill_rules, guess_mapping,
    guess_roles, policy_target, recommend, recommended_rules, risk_bucket, risk_reduction, table_scores,
)
from voilage.operators.profiling import profile, row_audit
from voilage.operators.risk import compliance, evaluate, metrics_before_after, risk_metrics
from voilage.operators.rules import apply_rules, fixed_rules, search_columns, treat_rows, with_helpers
from voilage.plans.jobs import (
    Anonymized, anonymize, auto_anonymize, chosen_rules, fixed_file_job, profile_and_anonymize, risk_report,
)
from voilage.sources.delimited import preview, read_delimited, sniff_delimiters
from voilage.sources.synthetic import synth_clients

__all__ = [
    "Anonymized", "Roles", "Rule", "Settings", "allowed_actions", "anonymize", "apply_rules", "auto_anonymize",
    "choose_rules", "chosen_rules", "class_key", "class_sizes", "class_stats", "class_verdicts", "classify",
    "compliance", "data_dictionary", "default_rules", "distribution", "evaluate", "fill_rules", "fixed_file_job",
    "fixed_rules", "guess_mapping", "guess_roles", "keep_rows", "metrics_before_after", "policy_target", "preset",
    "preview", "profile", "profile_and_anonymize", "qi_column", "read_delimited", "recommend", "recommended_rules",
    "risk_bucket", "risk_metrics", "risk_reduction", "risk_report", "row_audit", "search_columns",
    "sniff_delimiters", "suppress_classes", "synth_clients", "table_scores", "treat_rows", "tvd",
    "with_class_size", "with_helpers",
]
