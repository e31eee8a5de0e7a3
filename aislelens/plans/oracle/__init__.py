"""Independent SQL answers for the registered analyses, by name."""

from __future__ import annotations


def statements() -> dict[str, str]:
    from aislelens.plans.oracle import cleaning, customer, delivery, feedback, growth, product, quality, sequence

    out: dict[str, str] = {}
    for module in (cleaning, quality, customer, sequence, delivery, feedback, growth, product):
        out.update(module.SQL)
    for name in ("cohort_retention", "rfm_fixed_bins", "repeat_customer_pct"):
        out[f"{name}_by_loads"] = out[name]  # the same over all rows
    return out
