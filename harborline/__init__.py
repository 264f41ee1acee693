"""Order-to-shipment timeliness analytics on Spark DataFrames."""

from harborline import config, schema, session

__all__ = ["config", "schema", "session"]
