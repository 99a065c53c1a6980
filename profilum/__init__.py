"""Spark-native profile sequence search, with text operators for large corpora beside it."""

from profilum.config import get_config
from profilum.databases import DatabaseInfo, get_registry, install_database, list_databases, register_custom_database, uninstall_database
from profilum.operators.result import DomainHit, ResultCollector, SearchResult, SequenceHit
from profilum.options import BitscoreCutoff, MoleculeType, ThresholdOptions
from profilum.plans.search import jackhmmer, nhmmer, phmmer, scan, search

__version__ = "0.1.0"
__all__ = [
    "BitscoreCutoff", "DatabaseInfo", "DomainHit", "MoleculeType", "ResultCollector", "SearchResult", "SequenceHit", "ThresholdOptions",
    "get_config", "get_registry", "install_database", "jackhmmer", "list_databases", "nhmmer", "phmmer",
    "register_custom_database", "scan", "search", "uninstall_database",
]
