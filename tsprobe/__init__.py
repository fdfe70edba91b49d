"""tsprobe: labelled time-series windows, probes and evaluation tables as Spark jobs.

Every operator takes DataFrames and returns DataFrames; see ``tsprobe.ops`` for
the public names.
"""

__version__ = "0.1.0"
