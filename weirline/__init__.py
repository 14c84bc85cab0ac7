"""weirline: infrastructure-registry analytics as Spark DataFrame jobs.

Sub-packages
------------
functions   Column -> Column helpers (cleaning rules, geometry, ratios)
sources     readers of the registry inputs and the writers (sinks)
operators   DataFrame -> DataFrame jobs (enrichment, analyses, purge, audits)
plans       composite jobs and the catalog of named queries
streaming   (intentionally empty: the workload has no streaming part)
"""

__version__ = "0.1.0"
