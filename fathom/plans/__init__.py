"""Registered queries."""

from . import assembly_queries, feature_queries, file_queries, model_queries, pose_queries, record_queries, region_queries, report_queries, source_queries, spatial_queries  # noqa: F401
