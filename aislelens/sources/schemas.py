"""Explicit schemas of the six retail tables as they arrive in files.

Money is DECIMAL so that sums do not depend on the order in which partitions arrive.
"""

from __future__ import annotations

ORDERS = """order_id bigint, customer_id bigint, order_date timestamp_ntz,
promised_delivery_time timestamp_ntz, actual_delivery_time timestamp_ntz, order_total decimal(18,2),
payment_method string, delivery_partner_id int, store_id int"""

CUSTOMERS = """customer_id bigint, customer_name string, email string, phone bigint, address string,
area string, pincode int, registration_date timestamp_ntz, customer_segment string, total_orders int,
avg_order_value decimal(18,2)"""

FEEDBACK = """feedback_id bigint, order_id bigint, customer_id bigint, rating int, feedback_text string,
feedback_category string, sentiment string, feedback_date timestamp_ntz"""

PRODUCTS = """product_id bigint, product_name string, category string, brand string, price decimal(18,2),
mrp decimal(18,2), margin_percentage double, shelf_life_days int, min_stock_level int, max_stock_level int"""

ORDER_ITEMS = "order_id bigint, product_id bigint, quantity int, unit_price decimal(18,2)"

DELIVERY = """order_id bigint, delivery_partner_id bigint, promised_time timestamp_ntz,
actual_time timestamp_ntz, delivery_time_minutes double, distance_km double, delivery_status string,
reasons_if_delayed string"""
