"""Multi-step plans: feature sets, evaluation, model experiments, report tables."""
