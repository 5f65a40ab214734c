"""tidemark: timestamped feature data on Spark.

Append feature history, rebuild what was known at any past moment, keep the latest
state per entity, and check that the two agree.
"""

from tidemark.plans.store import FeatureStore
from tidemark.specs import DataType, Entity, Feature, FeatureView, Registry

__all__ = ["DataType", "Entity", "Feature", "FeatureStore", "FeatureView", "Registry"]
