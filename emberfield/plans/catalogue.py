"""Every registered query; importing the section modules registers them."""

from emberfield.plans import audit_queries, contract_queries, evaluation_queries, feature_queries, fusion_queries, geo_queries, model_queries, raster_queries, sampling_queries, streaming_queries, temporal_queries  # noqa: F401
from emberfield.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
