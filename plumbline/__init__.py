"""Data-quality assessment of whole sets of tables on Spark."""

from .functions.semantics import register_semantic_type
from .model import Asset, CheckSpec, ForeignKey
from .operators.checks import CheckType, new_spec, register_check
from .operators.evaluate import failing_rows
from .plans.scan import Scan, ScanOptions, run_scan
from .plans.store import change_checks, change_findings, record_scan, scan_and_record

__all__ = [
    "Asset", "CheckSpec", "CheckType", "ForeignKey", "Scan", "ScanOptions", "change_checks", "change_findings",
    "failing_rows", "new_spec", "record_scan", "register_check", "register_semantic_type", "run_scan", "scan_and_record",
]
