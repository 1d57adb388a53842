"""Imports every query module so the registry is complete."""

from ranklane.plans import q_domains, q_features, q_io, q_judge, q_meta, q_slice, q_topics  # noqa: F401
from ranklane.plans.q_slice import entry_query  # noqa: F401
