"""Panel data preparation and forecasting on Spark DataFrames.

``operators`` holds DataFrame -> DataFrame building blocks, ``functions`` holds
Column expressions, ``sources`` reads and writes tables, and ``plans`` chains
operators into whole jobs.
"""

from quarterdeck.panel import PanelSpec

__all__ = ["PanelSpec"]
