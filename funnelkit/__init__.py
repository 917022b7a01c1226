"""funnelkit: sales-funnel reports on Spark DataFrames.

Entry points:

* ``funnelkit.sources.crm.load(spark, folder)`` / ``from_tables({...})`` -> CRM views
* ``funnelkit.plans.reports.REPORTS`` -> the eleven reports, ``(views, ReportParams) -> DataFrame``
* ``funnelkit.catalog`` -> every registered query with its DuckDB oracle SQL
* ``python -m funnelkit`` -> run one report from the command line
"""

__version__ = "0.1.0"
