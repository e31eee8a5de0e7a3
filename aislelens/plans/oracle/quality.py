from aislelens.plans.oracle.base import hu, pct, query

_TABLES = {
    "orders": "r_orders", "customers": "r_customers", "feedback": "r_feedback",
    "products": "r_products", "order_items": "r_items", "delivery": "r_delivery",
}
_FOREIGN_KEYS = [
    ("orders_customer", "r_orders", "customer_id", "r_customers"),
    ("feedback_customer", "r_feedback", "customer_id", "r_customers"),
    ("feedback_order", "r_feedback", "order_id", "r_orders"),
    ("items_product", "r_items", "product_id", "r_products"),
    ("items_order", "r_items", "order_id", "r_orders"),
    ("delivery_order", "r_delivery", "order_id", "r_orders"),
]
_RAW_DELIVERY = {
    "order_id": "order_id", "delivery_partner_id": "delivery_partner_id", "promised_time": "promised_time",
    "actual_time": "actual_time", "delivery_time_minutes": "delivery_time_minutes",
    "distance_km": "distance_km", "delivery_status": "delivery_status", "reasons_if_delayed": "reason_as_given",
}
_MEASURES = ["order_total", "delivery_gap_in_minutes", "gap_between_promised_actual_time"]
_STORED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _numbered(table: str, key: str, order: str) -> str:
    return query(
        f"select {key}, duplicate_rank from n where duplicate_rank > 1",
        n=f"select {key}, row_number() over (partition by {key} order by {order}) as duplicate_rank from {table}",
    )


_REQUIRED = {
    "orders": ["order_id", "customer_id", "order_date"], "customers": ["customer_id"],
    "feedback": ["feedback_id", "order_id", "customer_id", "feedback_date"], "products": ["product_id"],
    "order_items": ["order_id", "product_id"], "delivery": ["order_id"],
}
_KEYS = {
    "orders": "order_id", "customers": "customer_id", "feedback": "feedback_id", "products": "product_id",
    "order_items": "order_id, product_id", "delivery": "order_id",
}


def _describe(column: str, table: str = "r_orders") -> str:
    v = f"cast({column} as double)"
    quartiles = ", ".join(
        f"{hu(f'quantile_cont({v}, {p})', 6)} as {name}" for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
    )
    return (
        f"select '{column}' as column_name, count({column}) as count, {hu(f'avg({v})', 6)} as mean, "
        f"{hu(f'stddev_samp({v})', 6)} as std, min({v}) as min, {quartiles}, max({v}) as max from {table}"
    )


SQL = {
    "row_counts": query(" union all ".join(
        f"select '{name}' as table_name, count(*) as row_count from {table}" for name, table in _TABLES.items()
    )),
    "orphan_orders": query(
        "select order_id, customer_id, order_date, lower(payment_method) as payment_method from r_orders o "
        "where not exists (select 1 from r_customers c where c.customer_id = o.customer_id) "
        "and not exists (select 1 from r_feedback f where f.order_id = o.order_id)"
    ),
    "fk_violations": query(" union all ".join(
        f"select '{name}' as constraint_name, '{key}' as key, count(*) as violations from {child} "
        f"where {key} not in (select {key} from {parent})"
        for name, child, key, parent in _FOREIGN_KEYS
    )),
    "dup_orders": _numbered("r_orders", "order_id", "order_date, customer_id"),
    "dup_customers": _numbered("r_customers", "customer_id", "registration_date, customer_name"),
    "dup_feedback_customer": _numbered("r_feedback", "customer_id", "feedback_date, feedback_id"),
    "pk_violations": query(
        "select l_orderkey as order_id, l_linenumber as line_number, count(*) as n from lineitem "
        "group by all having count(*) > 1 or l_orderkey is null or l_linenumber is null"
    ),
    "dup_feedback_dates": query(
        "select * from (select customer_id, feedback_id, feedback_date, feedback_text, dense_rank() over "
        "(partition by customer_id, feedback_id order by feedback_date) as dupl_cnt from r_feedback) "
        "where dupl_cnt > 1"
    ),
    "dup_customer_orders": query(
        "select * from (select customer_id, order_id, dense_rank() over "
        "(partition by customer_id, order_id order by order_date) as ord_dupl_check "
        "from r_orders join r_customers using (customer_id)) where ord_dupl_check > 1"
    ),
    "dup_order_items": query(
        "select l_orderkey as order_id, l_partkey as product_id, count(*) as n from lineitem "
        "group by all having count(*) > 1"
    ),
    "orphan_orders_of_known_parts": query(
        "select order_id, customer_id, order_date, lower(payment_method) as payment_method from r_orders o where not exists "
        "(select 1 from r_customers c where c.customer_id = o.customer_id and c.customer_id % 3 <> 0) and not exists "
        "(select 1 from r_feedback f where f.order_id = o.order_id and f.order_id % 2 = 0)"
    ),
    "dup_products_of_two_lists": query(
        "select product_id, product_name, category, cast(2 as bigint) as n from r_products where product_id % 4 = 0"
    ),
    "range_check_rating_narrow": query("select feedback_id, rating from r_feedback where rating < 2 or rating > 4"),
    "dup_products": query(
        "select product_id, product_name, category, count(*) as n from r_products group by all having count(*) > 1"
    ),
    "feedback_cardinality": query(
        "select count(*) as rows_count, count(distinct customer_id) as original_cust_count from r_feedback"
    ),
    "range_check_distance": query(
        "select order_id, distance_km from r_delivery where distance_km not between 0 and 5"
    ),
    "range_check_delivery_minutes": query(
        "select order_id, delivery_time_minutes from r_delivery where delivery_time_minutes < -5"
    ),
    "range_check_rating": query("select feedback_id, rating from r_feedback where rating not between 0 and 5"),
    "null_profile": query(" union all ".join(
        f"select '{name}' as column_name, count(*) - count({column}) as null_count, "
        f"{pct(f'(count(*) - count({column}))', 'count(*)')} as null_pct from r_delivery"
        for name, column in _RAW_DELIVERY.items()
    )),
    "row_duplicates": query(
        f"select (select count(*) from lineitem) - count(*) as duplicate_count "
        f"from (select distinct {', '.join(_STORED)} from lineitem)"
    ),
    "row_duplicates_subset": query(
        "select (select count(*) from lineitem) - count(*) as duplicate_count "
        "from (select distinct l_orderkey, l_linenumber from lineitem)"
    ),
    "describe_numeric": query(" union all ".join(_describe(c) for c in _MEASURES)),
    "describe_delivery": query(" union all ".join(_describe(c, "r_delivery") for c in ("distance_km", "delivery_time_minutes"))),
    "null_violations": query(" union all ".join(
        f"select '{name}' as table_name, '{column}' as column_name, count(*) - count({column}) as violations from {_TABLES[name]}"
        for name, columns in _REQUIRED.items() for column in columns
    )),
    "key_violations": query(" union all ".join(
        f"select '{name}' as table_name, (select count(*) from (select {key} from {_TABLES[name]} group by {key} having count(*) > 1)) as violations"
        for name, key in _KEYS.items()
    )),
    "dup_line_ship_dates": query(
        "select l_orderkey, duplicate_rank from n where duplicate_rank > 1",
        n="select l_orderkey, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey) "
          "as duplicate_rank from lineitem",
    ),
    "later_event_times": query(
        "select * from (select event_id, user_id, event_type, dense_rank() over (partition by user_id, event_type order by ts) "
        "as time_rank from events) where time_rank > 1"
    ),
    "orphan_lines": query(
        "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select event_id from events)"
    ),
    "distinct_values": query("select distinct lower(payment_method) as value from r_orders"),
}
