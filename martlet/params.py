"""Parameters the registered queries run with (shared by the Spark side and the
SQL oracle so both ask the same question)."""

# Reports that depend on "today" use a fixed as-of date (orders end 2001-08-01).
AS_OF = "2001-12-31"

# The invoice is for one order: the order id is the report's input.
INVOICE_ORDER_ID = 3

# Order search text (matched against order id and customer name).
SEARCH_TERM = "12"

# Attribute and range filters.
FILTER_CATEGORY = "PROMO"
FILTER_REGION = "EUROPE"
FILTER_START = "1997-01-01"
FILTER_END = "1997-12-31"

# The enum domains present in the driver tables, used where the
# ingest normalises text onto a domain.
TPCH_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TPCH_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
TPCH_SHIP_MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
