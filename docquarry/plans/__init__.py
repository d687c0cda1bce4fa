"""The registered queries and their SQL."""

from docquarry.plans import q_documents, q_guard, q_operations, q_pipelines, q_reports, q_retrieval, q_serving, q_text  # noqa: F401
from docquarry.plans.registry import ORACLES, QUERIES  # noqa: F401
