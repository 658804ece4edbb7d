"""Canonical adapters and the registered queries."""

from sceneloom.plans import camera_queries, comparison_queries, detail_queries, eval_queries, judging_queries, more_queries, motion_queries, retrieval_queries, scene_eval_queries, scene_queries, series_queries, source_queries, workflows  # noqa: F401
