from aislelens.functions import labels as L
from aislelens.plans.oracle.base import hu, label, query

_STAMPS = "order_id, order_date, promised_delivery_time, actual_delivery_time"


def _parts(ts: str, prefix: str, **names: str) -> str:
    monday = f"cast(date_trunc('week', {ts}) as date)"
    sql = {
        "year": f"cast(year({ts}) as int)",
        "month": f"cast(month({ts}) as int)",
        "week": f"cast(week({ts}) as int)",
        "day_name": f"strftime({ts}, '%a')",
        "weekly_period": f"strftime({monday}, '%Y-%m-%d') || '/' || strftime({monday} + 6, '%Y-%m-%d')",
        "day": f"cast(day({ts}) as int)",
        "hour": f"cast(hour({ts}) as int)",
    }
    return ", ".join(f"{sql[part]} as {prefix}_{name}" for part, name in names.items())


SQL = {
    "load_csv": query(
        f"select {_STAMPS}, customer_id, cast(order_total as double) as order_total, payment_method, "
        "delivery_partner_id from r_orders"
    ),
    "parse_dates": query(f"select {_STAMPS} from r_orders"),
    "order_enrich": query(
        "select order_id, delivery_gap_in_minutes, gap_between_promised_actual_time from r_orders"
    ),
    "delivery_gap_flag": query(
        f"select order_id, {label('delivery_gap_in_minutes', L.DELIVERY_GAP_BANDS, L.DELIVERY_GAP_OTHER)}"
        " as delivery_gap_flag from r_orders"
    ),
    "calendar_parts": query(
        "select order_id, order_date, " + _parts(
            "order_date", "order", year="year", month="month", week="week", day_name="day_name",
            weekly_period="weekly_period", day="day", hour="hour",
        ) + " from r_orders"
    ),
    "calendar_parts_feedback": query(
        "select feedback_id, " + _parts(
            "feedback_date", "feedback", year="year", month="month", day_name="day_name", week="week",
            weekly_period="period", day="day",
        ) + " from r_feedback"
    ),
    "calendar_parts_customers": query(
        "select customer_id, " + _parts("registration_date", "registration", year="year", month="month")
        + " from r_customers"
    ),
    "calendar_parts_delivery": query(
        "select order_id, " + _parts(
            "promised_time", "delivery", year="year", month="month", day="day", week="week",
            weekly_period="week_period",
        ) + " from r_delivery"
    ),
    "normalise_text": query("select product_id, product_name, category from r_products"),
    "normalise_delay_reason": query(
        "select order_id, delivery_status, nullif(reasons_if_delayed, 'not given') as reasons_if_delayed from r_delivery"
    ),
    "fill_missing_reason": query(
        "select order_id, coalesce(reason_as_given, 'not given') as reasons_if_delayed from r_delivery"
    ),
    "distance_flag_closed_bands": query(
        f"select order_id, distance_km, {label('distance_km', L.DISTANCE_FLAG_BANDS, L.DISTANCE_FLAG_OTHER)}"
        " as delivery_distance_flag from r_delivery"
    ),
    "distance_category_cumulative": query(
        f"select order_id, distance_km, {label('distance_km', L.DISTANCE_CATEGORY_BANDS, L.DISTANCE_CATEGORY_OTHER)}"
        " as delivery_distance_category from r_delivery"
    ),
    "product_profit": query(f"select product_id, {hu('(mrp - price)')} as profit from r_products"),
    "schema_evolution": query(
        "select order_id, cast(delivery_partner_id as bigint) as delivery_partner_id, "
        "cast(week(promised_time) as varchar) as delivery_week, "
        f"{label('distance_km', L.DISTANCE_CATEGORY_BANDS, L.DISTANCE_CATEGORY_OTHER)}"
        " as delivery_distance_category from r_delivery"
    ),
    "load_append": query(
        "select feedback_id, order_id, customer_id, rating, feedback_category, sentiment, feedback_date from r_feedback"
    ),
    "load_repeated": query(
        "select feedback_id, order_id, customer_id, rating, feedback_category, sentiment, feedback_date, "
        "case when sentiment = 'negative' then 'first' else 'second' end as load_id from r_feedback"
    ),
    "new_load_repeats": query(
        "select order_id, cast(1 as bigint) as in_load, cast(1 as bigint) as in_table from r_orders where order_id % 7 = 0 and order_id % 5 <> 0"
    ),
    "new_load_unknown": query(
        "select order_id, count(*) as \"rows\" from r_items where order_id % 3 = 0 and order_id not in "
        "(select order_id from r_orders where order_id % 5 <> 0) group by order_id"
    ),
    "load_rejects": query(
        "select order_id, concat_ws('; ', case when order_id % 101 = 0 then 'customer_id is missing' end, "
        "case when order_id % 97 = 0 then 'order_total is no double: n/a' end) as reason, 'first' as load_id "
        "from r_orders where order_id % 101 = 0 or order_id % 97 = 0"
    ),
    "write_csv": query(
        "select order_id, delivery_partner_id, promised_time, actual_time, delivery_time_minutes, distance_km, "
        "delivery_status, reasons_if_delayed, "
        + _parts("promised_time", "delivery", year="year", month="month", day="day", week="week")
        + f", {label('distance_km', L.DISTANCE_FLAG_BANDS, L.DISTANCE_FLAG_OTHER)} as delivery_distance_flag"
        + f", {label('distance_km', L.DISTANCE_CATEGORY_BANDS, L.DISTANCE_CATEGORY_OTHER)} as delivery_distance_category"
        + " from r_delivery"
    ),
}
