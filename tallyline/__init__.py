"""Batch record pipelines as lazy Spark DataFrame plans.

Every operator takes DataFrames and returns DataFrames; only sinks, gates,
``plans.flow.Flow.run`` and the search for header and trailer lines start Spark jobs.
"""

from tallyline.plans.flow import Flow, load_config
from tallyline.plans.steps import apply_step
from tallyline.session import build_session, clear_scratch, scratch_dir, scratch_scope, sized_shuffles, tune
from tallyline.sources.layout import FieldSpec, Layout

__all__ = [
    "FieldSpec",
    "Flow",
    "Layout",
    "apply_step",
    "build_session",
    "clear_scratch",
    "load_config",
    "scratch_dir",
    "scratch_scope",
    "sized_shuffles",
    "tune",
]
