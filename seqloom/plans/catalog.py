"""All registered queries: name -> callable(spark, sf_dir), and name -> SQL."""

from . import comparisons, domain, files, formats, genomes, hierarchy, relational, reports, sequence
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "conserved_canonical_kmers"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "comparisons", "domain", "files", "formats", "genomes", "hierarchy", "relational", "reports", "sequence"]
