"""martlet: retail order analytics on Spark DataFrames.

A snowflake mart of seven tables (categories, subcategories, sellers,
customers, products, orders, order_details), the ingest that builds it from
a flat sales sheet, constraint checks over it, and the business reports
asked of it.  Every report is a lazy DataFrame plan; nothing is collected
except results bounded by a top-k or a small group count.
"""

from martlet.session import get_spark
from martlet.sources.mart import Mart

__all__ = ["Mart", "get_spark"]
