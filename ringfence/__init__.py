"""ringfence: payment-fraud analytics on Spark DataFrames and Structured Streaming.

Subpackages: ``sources`` (tables in and out), ``functions`` (column
expressions), ``operators`` (detectors, graph patterns, scoring, triage,
KYC, ML), ``streaming`` (stateful stream operators), ``plans`` (the
registered queries and their SQL oracles).
"""

__version__ = "0.1.0"
