"""Canonical vocabulary: enumerations, rules with their default thresholds, datasets and their fields."""

from __future__ import annotations

# Enumerations of the retail model.
SEVERITIES = ("low", "medium", "high")
PRIORITIES = ("low", "medium", "high", "critical")
INVESTIGATION_STATUSES = ("open", "in_progress", "resolved", "closed")
ACTION_STATUSES = ("unassigned", "assigned", "acknowledged", "in_progress", "blocked", "completed", "cancelled")
ACTIVE_ACTIONS = ("unassigned", "assigned", "acknowledged", "in_progress", "blocked")
SUPPRESSION_SCOPES = ("rule", "rule_store", "rule_sku", "rule_store_sku")
EVIDENCE_STRENGTHS = ("weak", "moderate", "strong")

# The detection rules, their default thresholds and family.
RULES: dict[str, tuple[str, dict[str, float]]] = {
    "sales_spike": ("demand", {"pct": 50, "days": 7, "min_revenue": 500}),
    "sales_drop": ("demand", {"pct": 30, "days": 7, "min_revenue": 500}),
    "demand_seasonality_breach": ("demand", {"pct": 40}),
    "cannibalization_signal": ("demand", {"pct": 30, "days": 30}),
    "return_rate_spike": ("demand", {"pct": 15, "days": 30}),
    "channel_mix_shift": ("demand", {"pct": 25}),
    "stockout_risk": ("inventory", {}),
    "safety_stock_breach": ("inventory", {}),
    "dead_stock": ("inventory", {"days": 30}),
    "phantom_inventory": ("inventory", {}),
    "multi_location_imbalance": ("inventory", {}),
    "reorder_point_staleness": ("inventory", {"days": 90}),
    "inventory_shrinkage": ("inventory", {"pct": 20}),
    "po_overdue": ("purchasing", {}),
    "receiving_discrepancy": ("purchasing", {"pct": 20}),
    "supplier_lead_time_drift": ("purchasing", {"pct": 30}),
    "cost_spike": ("purchasing", {"pct": 25}),
    "price_anomaly": ("financial", {"pct": 25}),
    "margin_erosion": ("financial", {}),
    "discount_signal": ("financial", {}),
    "revenue_concentration_risk": ("financial", {"pct": 80, "days": 90}),
    "slow_moving_capital": ("financial", {"value": 1000, "days": 60}),
    "store_outlier": ("store", {"pct": 50, "days": 7}),
    "import_frequency_gap": ("data", {"days": 7}),
    "duplicate_transaction_ids": ("data", {}),
    "sku_master_drift": ("data", {}),
    "location_proliferation": ("data", {"days": 7}),
}

# Sensitivity of adaptive baselines.
SENSITIVITY, SENSITIVITY_STEP, SENSITIVITY_MAX = 2.0, 0.2, 5.0
BASELINE_DAYS, BASELINE_SAMPLES, BASELINE_STDDEV = 90, 7, 0.001

# Canonical fields of each dataset; required ones come first, up to the bar.
DATASETS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "sales": (("date", "sku", "quantity"), ("product_name", "location", "unit_price", "total_amount", "transaction_id", "discount", "payment_method")),
    "returns": (("date", "sku", "quantity"), ("return_id", "value", "location", "reason")),
    "inventory": (("sku",), ("product_name", "location", "on_hand_qty", "reorder_point", "as_of_date", "on_order_qty", "inventory_value")),
    "purchase_orders": (("po_number", "supplier", "sku", "qty_ordered", "order_date"), ("product_name", "qty_received", "unit_cost", "expected_date", "received_date", "location", "open_qty", "late_days", "fill_rate")),
    "products": (("sku", "name"), ("category", "subcategory", "unit_cost", "selling_price", "supplier", "barcode", "brand", "pack_size")),
    "stores": (("name",), ("code", "format", "address", "city", "region", "country")),
    "suppliers": (("name",), ("code", "lead_time_days", "contact_email", "contact_phone", "type", "specialization")),
    "users": (("name", "email"), ("role",)),
}
# What the rules are called.
RULE_LABELS: dict[str, str] = {
    "sales_spike": "Sales Spike",
    "sales_drop": "Sales Drop",
    "demand_seasonality_breach": "Demand Seasonality Breach",
    "cannibalization_signal": "Cannibalization Signal",
    "return_rate_spike": "Return Rate Spike",
    "channel_mix_shift": "Channel Mix Shift",
    "stockout_risk": "Stockout Risk",
    "safety_stock_breach": "Safety Stock Breach",
    "dead_stock": "Dead Stock",
    "phantom_inventory": "Phantom Inventory",
    "multi_location_imbalance": "Multi-Location Imbalance",
    "reorder_point_staleness": "Reorder Point Staleness",
    "inventory_shrinkage": "Inventory Shrinkage",
    "po_overdue": "PO Overdue",
    "receiving_discrepancy": "Receiving Discrepancy",
    "supplier_lead_time_drift": "Supplier Lead Time Drift",
    "cost_spike": "Cost Spike",
    "price_anomaly": "Price Anomaly",
    "margin_erosion": "Margin Erosion",
    "discount_signal": "Discount Signal",
    "revenue_concentration_risk": "Revenue Concentration Risk",
    "slow_moving_capital": "Slow-Moving Capital",
    "store_outlier": "Store Outlier",
    "import_frequency_gap": "Import Frequency Gap",
    "duplicate_transaction_ids": "Duplicate Transaction IDs",
    "sku_master_drift": "SKU Master Drift",
    "location_proliferation": "Location Proliferation",
}

# The fields of each dataset in the order in which headers are held against them.
FIELD_ORDER: dict[str, tuple[str, ...]] = {
    "sales": ("date", "sku", "product_name", "location", "quantity", "unit_price", "total_amount", "transaction_id", "discount", "payment_method"),
    "inventory": ("sku", "product_name", "location", "on_hand_qty", "reorder_point", "as_of_date", "on_order_qty", "inventory_value"),
    "products": ("sku", "name", "category", "subcategory", "unit_cost", "selling_price", "supplier", "barcode", "brand", "pack_size"),
    "stores": ("name", "code", "format", "address", "city", "region", "country"),
    "suppliers": ("name", "code", "lead_time_days", "contact_email", "contact_phone", "type", "specialization"),
    "users": ("name", "email", "role"),
    "returns": ("return_id", "date", "sku", "quantity", "value", "location", "reason"),
    "purchase_orders": ("po_number", "supplier", "sku", "product_name", "qty_ordered", "qty_received", "unit_cost", "order_date", "expected_date", "received_date", "location", "open_qty", "late_days", "fill_rate"),
}
DATES = frozenset({"date", "as_of_date", "order_date", "expected_date", "received_date"})
NUMBERS = frozenset({"quantity", "unit_price", "total_amount", "discount", "value", "on_hand_qty", "reorder_point", "on_order_qty", "inventory_value", "qty_ordered", "qty_received", "unit_cost", "selling_price", "lead_time_days", "open_qty", "late_days", "fill_rate"})
REQUIRED_NUMBERS = frozenset({"quantity", "qty_ordered"})
ADMIN_ROLES = ("admin", "tenant_admin", "tenant admin", "administrator", "manager")
