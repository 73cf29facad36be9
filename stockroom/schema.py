"""Schemas of the application tables and request tables (DDL strings)."""

from __future__ import annotations

# ---- fixed values: table schemas --------------------------------------------
SCHEMAS = {
    "products": "ProductID long, Name string, Category string, Price decimal(12,2), Description string",
    "suppliers": "SupplierID long, Name string, ContactInfo string, Email string, Phone string",
    "supplier_products": "SupplierID long, ProductID long",
    "stock": "StockID long, ProductID long, SupplierID long, QuantityAdded long, DateAdded timestamp_ntz",
    "sales": ("SaleID long, ProductID long, QuantitySold long, SaleDate timestamp_ntz, "
              "TotalAmount decimal(14,2), UserID long"),
    "users": "UserID long, Username string, RoleID long",
    "roles": "RoleID long, RoleName string",
    "cart_events": "event_id long, ts timestamp_ntz, user_id long, product_id long, action string, quantity long",
    "sale_requests": ("request_id long, ts timestamp_ntz, ProductID long, Quantity string, Discount string, "
                      "UserID long"),
    "product_requests": "request_id long, product_name string, category string, price string, description string",
    "receipt_requests": ("request_id long, product_id long, supplier_id long, quantity string, "
                         "date_added timestamp_ntz"),
    "product_edits": ("ProductID long, request_id long, product_name string, category string, price string, "
                      "description string"),
    "supplier_requests": ("request_id long, name string, contact_info string, email string, phone string, "
                          "link_product long"),
}


def from_rows(spark, tables: dict[str, list], params=None):
    """RetailTables over in-memory rows (small hand-made fixtures); missing tables are empty."""
    from .params import DEFAULT
    from .sources.retail import RetailTables

    frames = {name: (lambda name=name: spark.createDataFrame(tables.get(name, []), SCHEMAS[name]))
              for name in SCHEMAS}
    return RetailTables(spark, frames, params or DEFAULT)
