"""All queries of the engine and their SQL, by name."""

from millrace.plans import (  # noqa: F401
    datacard_queries,
    dataset_queries,
    dedup_queries,
    flow_queries,
    index_queries,
    ingest_queries,
    product_queries,
    relational_queries,
    retrieval_queries,
    rule_queries,
    scout_queries,
    source_queries,
    state_queries,
    text_queries,
)
from millrace.plans.core import ORACLES, QUERIES  # noqa: F401
