"""All registered plans of the library."""

from strandlake.plans import calls, coverage, display, hic, kernels, kmer, pairs, peptides, reads, stream, validation, variant, windows  # noqa: F401
from strandlake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
