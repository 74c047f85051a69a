"""hazecast: a Spark-native air-quality feature, forecast and reporting engine.

Every public function takes and returns DataFrames or Columns; the heavy work
runs on executors through the DataFrame API, Spark SQL, Spark ML and
Structured Streaming.
"""

__version__ = "0.1.0"
