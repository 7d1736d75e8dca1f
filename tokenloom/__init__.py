"""tokenloom: corpus and code-project analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver.  Tables carry a ``project`` key so one job covers
many repositories at once.
"""

__version__ = "0.1.0"
