"""zonetide: supply-imbalance analytics for city zones, expressed as Spark jobs.

The package is organised the way a Spark user would look for things:

* ``functions``  - column expressions (no DataFrame is touched)
* ``operators``  - DataFrame -> DataFrame steps
* ``sources``    - readers, payload parsers and sinks
* ``streaming``  - Structured Streaming queries
* ``learning``   - Spark ML steps
* ``plans``      - end-to-end jobs and the query catalogue
"""

from zonetide.settings import DecisionSettings, RiskSettings

__all__ = ["DecisionSettings", "RiskSettings"]
