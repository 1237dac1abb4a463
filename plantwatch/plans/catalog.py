"""All registered queries; importing the modules fills the registry."""

from importlib import import_module

MODULES = ["timeline_queries", "audit_queries", "profile_queries", "metric_queries", "model_queries", "stream_queries", "inference_queries"]

for _m in MODULES:
    import_module(f"plantwatch.plans.{_m}")

from plantwatch.plans.registry import CHECKS, QUERIES  # noqa: E402

__all__ = ["CHECKS", "QUERIES"]
