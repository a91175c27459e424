"""Table schemas of the mart and the value domains of its enum columns."""

from __future__ import annotations

from pyspark.sql import types as T

# The enum domains of the retail schema, in declaration order.
SEGMENTS = ["Consumer", "Corporate", "Home Office"]
REGIONS = ["East", "West", "Central", "South"]
SHIP_MODES = ["First Class", "Second Class", "Standard Class", "Same Day"]

TABLES = ["categories", "subcategories", "sellers", "customers", "products", "orders",
          "order_details"]

# Primary key of each table.
PRIMARY_KEYS = {
    "categories": "category_id",
    "subcategories": "subcategory_id",
    "sellers": "seller_id",
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "order_details": "id",
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("subcategories", "category_id", "categories", "category_id"),
    ("products", "category_id", "categories", "category_id"),
    ("products", "subcategory_id", "subcategories", "subcategory_id"),
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_details", "order_id", "orders", "order_id"),
    ("order_details", "product_id", "products", "product_id"),
    ("order_details", "seller_id", "sellers", "seller_id"),
]

UNIQUE_COLUMNS = [("categories", "category_name"), ("sellers", "seller_email")]

NOT_NULL = {
    "categories": ["category_id", "category_name"],
    "subcategories": ["subcategory_id", "category_id", "subcategory_name"],
    "sellers": ["seller_id", "seller_name", "seller_email"],
    "customers": ["customer_id", "customer_name"],
    "products": ["product_id", "category_id", "subcategory_id", "product_name"],
    "orders": ["order_id", "order_date", "customer_id"],
    "order_details": ["id", "order_id", "product_id", "sales", "quantity"],
}

# Declared text widths (checked, never enforced on write).
MAX_LENGTHS = {
    "categories": {"category_name": 100},
    "subcategories": {"subcategory_name": 100},
    "sellers": {"seller_id": 50, "seller_name": 255, "seller_email": 255, "seller_phone": 20},
    "customers": {"customer_id": 50, "customer_name": 255, "country": 100, "city": 100,
                  "state": 100, "postal_code": 20},
    "products": {"product_id": 50, "product_name": 255},
    "orders": {"order_id": 50, "customer_id": 50},
    "order_details": {"order_id": 50, "product_id": 50, "seller_id": 50},
}

MONEY = T.DecimalType(12, 2)
DISCOUNT = T.DecimalType(5, 2)
RATING = T.DecimalType(3, 2)
LINE_ID = T.DecimalType(38, 0)

# The 20 columns of the flat sales sheet, plus our input-order column.
FLAT_COLUMNS = [
    "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID",
    "Customer Name", "Segment", "Country", "City", "State", "Postal Code", "Region",
    "Product ID", "Category", "Sub-Category", "Product Name", "Sales", "Quantity",
    "Discount", "Profit",
]

FLAT_SCHEMA = T.StructType(
    [T.StructField("row_id", LINE_ID, False)]
    + [T.StructField(c, T.StringType(), True) for c in FLAT_COLUMNS[:16]]
    + [T.StructField("Sales", T.DoubleType(), True),
       T.StructField("Quantity", T.DoubleType(), True),
       T.StructField("Discount", T.DoubleType(), True),
       T.StructField("Profit", T.DoubleType(), True)]
)
