"""Dataflow operators: knowledge base, detection, disambiguation, evaluation, skew-safe selection."""
