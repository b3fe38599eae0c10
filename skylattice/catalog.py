"""The registered queries: name -> callable(spark, sf_dir), and SQL that gives the same rows."""

from __future__ import annotations

from .plans import kernels, live, proxy

QUERIES: dict = proxy.QUERIES | kernels.QUERIES | live.QUERIES
ORACLE: dict[str, str] = proxy.ORACLE | kernels.ORACLE | live.ORACLE
FLAGSHIP = "cluster_membership"
