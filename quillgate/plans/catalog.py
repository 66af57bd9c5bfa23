"""All registered queries."""

from quillgate.plans import event_queries, gate_queries, lead_queries  # noqa: F401
from quillgate.plans.registry import QUERIES, SQL  # noqa: F401
