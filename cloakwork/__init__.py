"""Finding and tokenizing personal data in tables and streams, on Spark."""

from .functions import register_mode, register_sql_functions
from .functions.tokens import TokenMode
from .operators.catalog import Catalog
from .operators.detect import Rules, detect
from .operators.rewrite import candidates, idempotency_report, remaining_plaintext, run_metrics, tokenize
from .plans.cycle import RunConfig, run_cycle
from .session import local_session, workspace
from .sources.audit import AuditLog
from .sources.published import FileTables, PublishedTables, remove_retired
from .sources.tables import CatalogTables, DataSourceTables, ParquetTables, PartitionedTables
from .streaming.requests import RequestLoop
from .streaming.rows import tokenize_stream

__all__ = [
    "AuditLog",
    "Catalog",
    "CatalogTables",
    "DataSourceTables",
    "FileTables",
    "ParquetTables",
    "PartitionedTables",
    "PublishedTables",
    "RequestLoop",
    "Rules",
    "RunConfig",
    "TokenMode",
    "candidates",
    "detect",
    "idempotency_report",
    "local_session",
    "register_mode",
    "register_sql_functions",
    "remaining_plaintext",
    "remove_retired",
    "run_cycle",
    "run_metrics",
    "tokenize",
    "tokenize_stream",
    "workspace",
]
