"""From file columns to typed rows: header mapping, validation, dimensions, ledgers."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_blank, number, parsed_date
from ..schema import ADMIN_ROLES, DATASETS, DATES, FIELD_ORDER, NUMBERS, REQUIRED_NUMBERS

# The names under which files give a field.
ALIASES: dict[str, tuple[str, ...]] = {
    "date": ("date", "transaction_date", "sale_date", "order_date", "txn_date", "trans_date"),
    "sku": ("sku", "item_code", "product_code", "product_id", "item_id", "article_number", "item_no"),
    "product_name": ("product_name", "product", "item_name", "description", "item_description", "name"),
    "location": ("location", "store", "store_id", "outlet", "channel", "region", "site", "branch"),
    "quantity": ("quantity", "qty", "units", "qty_sold", "units_sold", "sales_qty", "amount_sold"),
    "unit_price": ("unit_price", "price", "selling_price", "retail_price", "unit_retail", "price_each"),
    "total_amount": ("total_amount", "total", "revenue", "sales", "net_sales", "gross_sales", "total_sales", "amount"),
    "transaction_id": ("transaction_id", "txn_id", "trans_id", "receipt_no", "receipt_number", "order_id"),
    "on_hand_qty": ("on_hand_qty", "on_hand", "qty_on_hand", "stock", "stock_qty", "inventory", "qty_available", "available"),
    "reorder_point": ("reorder_point", "reorder_level", "min_stock", "min_qty", "safety_stock"),
    "as_of_date": ("as_of_date", "as_of", "snapshot_date", "report_date", "effective_date", "date"),
    "category": ("category", "dept", "department", "class", "product_class", "product_type"),
    "subcategory": ("subcategory", "sub_category", "subclass", "sub_class", "sub_dept", "subdivision"),
    "unit_cost": ("unit_cost", "cost", "cost_price", "purchase_price", "landed_cost", "cogs"),
    "selling_price": ("selling_price", "retail", "sale_price", "list_price", "msrp", "rrp"),
    "supplier": ("supplier", "vendor", "vendor_name", "supplier_name", "manufacturer", "brand"),
    "barcode": ("barcode", "upc", "ean", "gtin", "barcode_number", "upc_code"),
    "po_number": ("po_number", "po_no", "po_num", "purchase_order", "order_number", "po_ref"),
    "qty_ordered": ("qty_ordered", "ordered_qty", "order_qty", "quantity_ordered", "qty_order"),
    "qty_received": ("qty_received", "received_qty", "quantity_received", "qty_recv", "received"),
    "order_date": ("order_date", "po_date", "created_date", "placed_date", "purchase_date"),
    "expected_date": ("expected_date", "due_date", "promised_date", "eta", "delivery_date", "est_arrival"),
    "received_date": ("received_date", "receipt_date", "arrival_date", "delivery_received", "actual_receipt"),
    "name": ("name", "product_name", "item_name", "description", "product_description", "title", "store_name", "supplier_name", "vendor_name", "full_name"),
    "code": ("code", "store_code", "store_no", "store_number", "supplier_code", "vendor_code", "location_code", "site_code"),
    "address": ("address", "street", "street_address", "address_line", "addr"),
    "city": ("city", "town", "municipality"),
    "region": ("region", "state", "province", "area", "territory", "zone", "district"),
    "country": ("country", "country_code", "nation"),
    "lead_time_days": ("lead_time_days", "lead_time", "leadtime", "lead_days", "delivery_days", "contracted_lead_time"),
    "contact_email": ("contact_email", "email", "supplier_email", "vendor_email", "contact_mail", "e_mail"),
    "contact_phone": ("contact_phone", "phone", "telephone", "tel", "supplier_phone", "vendor_phone", "mobile", "contact_number"),
    "email": ("email", "e_mail", "login", "user_email", "username", "mail"),
    "role": ("role", "user_role", "access_level", "permission", "access", "type"),
}


def similarity(a: str, b: str) -> float:
    """Percentage of characters in common: the longest common run (the first of equals), then the same left and right of it."""
    common, work = 0, [(a, b)]
    while work:
        x, y = work.pop()
        best, at, to = 0, 0, 0
        previous = [0] * (len(y) + 1)
        for i, c in enumerate(x):
            row = [0] * (len(y) + 1)
            for j, d in enumerate(y):
                if c == d:
                    row[j + 1] = previous[j] + 1
                    if row[j + 1] > best:
                        best, at, to = row[j + 1], i - row[j + 1] + 1, j - row[j + 1] + 1
            previous = row
        if best:
            common += best
            work += [(x[:at], y[:to]), (x[at + best :], y[to + best :])]
    return 200 * common / (len(a) + len(b)) if a or b else 0.0


def map_header(header: str, dataset: str) -> tuple[str | None, float]:
    """The field of ``dataset`` that a file's header means, and the confidence; none under one half."""
    plain = re.sub(r"[^a-z0-9]", "_", header.strip().lower())
    fields = FIELD_ORDER[dataset]
    if plain in fields:
        return plain, 1.0
    best, score = None, 0.0
    for field in fields:
        for alias in ALIASES.get(field, (field,)):
            s = similarity(plain, alias) / 100
            if s > score:
                best, score = field, s
    return (best, round(score, 2)) if score >= 0.5 else (None, round(score, 2))


def map_headers(headers: list[str], dataset: str) -> dict[str, tuple[str | None, float]]:
    return {h: map_header(h, dataset) for h in headers}


def map_header_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (header, dataset and more) with the field that each header means and the confidence; each distinct header is looked at once."""
    kinds = "header string, dataset string, field string, confidence double"

    def run(batches):
        for pdf in batches:
            found = [map_header(h, d) if h is not None and d in FIELD_ORDER else (None, 0.0) for h, d in zip(pdf["header"], pdf["dataset"], strict=True)]
            yield pdf.assign(field=[f for f, _ in found], confidence=[c for _, c in found])

    each = rows.select("header", "dataset").distinct().mapInPandas(run, kinds)
    return rows.join(each, [rows.header.eqNullSafe(each.header), rows.dataset.eqNullSafe(each.dataset)], "left").select(*(rows[c] for c in rows.columns), each.field, each.confidence)


def apply_map(rows: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Mapped columns under their field names, empty ones null; ``_order`` passes."""
    columns = [F.nullif(F.col(f"`{h}`"), F.lit("")).alias(f) for h, f in mapping.items() if f]
    return rows.select(*columns, *(c for c in ("_order",) if c in rows.columns))


def validate(rows: DataFrame, dataset: str, strict_zero: bool = False, today: Column | None = None) -> DataFrame:
    """Typed columns of ``dataset`` and ``error``, the first thing wrong with a row, null for a good one.

    Required fields must be there (the text "0" counts as missing unless
    ``strict_zero``), dates (words such as "yesterday" only where ``today`` is
    given) and required numbers must be readable. An optional
    number that is missing or unreadable is null; so is "0" unless
    ``strict_zero``. A missing on_hand_qty is zero.
    """
    required, optional = DATASETS[dataset]
    there = [f for f in (*required, *optional) if f in rows.columns]
    rows = rows.withColumns({f"_at_{f}": parsed_date(F.col(f), today) for f in there if f in DATES})  # read once, used twice
    errors: list[Column] = []
    for f in required:
        missing = is_blank(F.col(f), strict_zero) if f in there else F.lit(True)
        errors.append(F.when(missing, F.lit(f"Missing required field: {f}")))
    out: list[Column] = []
    for f in there:
        c = F.col(f)
        if f in DATES:
            out.append(F.col(f"_at_{f}").alias(f))
            errors.append(F.when(c.isNotNull() & (c != "") & F.col(f"_at_{f}").isNull(), F.lit(f"Invalid date: {f}")))
        elif f == "on_hand_qty":
            out.append(F.coalesce(number(c), F.lit(0.0)).alias(f))
        elif f in REQUIRED_NUMBERS:
            out.append(number(c).alias(f))
            errors.append(F.when(number(c).isNull(), F.lit(f"Invalid number: {f}")))
        elif f in NUMBERS:
            out.append(F.when(~is_blank(c, strict_zero), number(c)).alias(f))
        elif f == "email":
            out.append(F.lower(F.trim(c)).alias(f))
            errors.append(F.when(~F.trim(c).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit("Invalid e-mail")))
        else:
            out.append(F.trim(c).alias(f))
    extra = [F.lower(F.trim("role")).isin(*ADMIN_ROLES).alias("is_admin")] if dataset == "users" and "role" in there else []
    keep = ["_order"] if "_order" in rows.columns else []
    return rows.select(*out, *extra, *keep, F.coalesce(*errors).alias("error"))


def foreign_users(checked: DataFrame, users: DataFrame, tenant_id: int) -> DataFrame:
    """Checked rows of users; good ones whose address belongs to a user of another tenant become rejects."""
    other = users.where(F.col("tenant_id") != tenant_id).select(F.lower("email").alias("_email")).distinct()
    rows = checked.join(other, F.col("email") == F.col("_email"), "left")
    said = F.concat(F.lit("user '"), F.col("email"), F.lit("' already exists under a different tenant."))
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("_email").isNotNull(), said))).drop("_email")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects with their error."""
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def reject_groups(rejects: DataFrame) -> DataFrame:
    """Rejects by error, without the row's number, most frequent first."""
    message = F.regexp_replace("error", r"^Row \d+:\s*", "")
    return rejects.groupBy(message.alias("error")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "error")


def numbered(names: DataFrame, name: str, first: DataFrame, id_: str) -> DataFrame:
    """``names`` (distinct) with ids that follow the one in ``first`` (one row), in the order of their md5.

    The first two digits deal the names over 256 groups; each is numbered on
    its own, and what comes before a group is a sum over 256 counts.
    """
    rows = names.withColumn("_md5", F.md5(F.col(name).cast("binary"))).withColumn("_group", F.substring("_md5", 1, 2))
    before = rows.groupBy("_group").agg(F.count("*").alias("_n"))
    before = before.select("_group", (F.sum("_n").over(Window.orderBy("_group")) - F.col("_n")).alias("_before"))  # 256 rows
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_group").orderBy("_md5"))).join(F.broadcast(before), "_group")
    return rows.crossJoin(F.broadcast(first.toDF("_first"))).select((F.col("_first") + F.col("_before") + F.col("_k")).cast("long").alias(id_), name)


def resolve_dimension(rows: DataFrame, members: DataFrame, key: str, name: str = "name", id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``key``_id by trimmed exact name, and the members with the missing ones added."""
    wanted = rows.select(F.trim(F.col(key)).alias(name)).where(F.length(name) > 0).distinct()
    missing = wanted.join(members.select(name), name, "left_anti")
    added = numbered(missing, name, members.agg(F.coalesce(F.max(id_), F.lit(0))), id_)
    everyone = members.select(id_, name).unionByName(added)
    ids = everyone.select(F.col(name).alias("_name"), F.col(id_).alias(f"{key}_id"))
    return rows.join(ids, F.trim(F.col(key)) == F.col("_name"), "left").drop("_name"), everyone


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str = "_order") -> DataFrame:
    """Existing rows, those with a key of ``incoming`` replaced by its last row of the key.

    Incoming rows without a key (a part of it null, empty or the text "0") are
    new ones, each of them; existing ones without a key stay.
    """
    text = {f.name for f in incoming.schema.fields if isinstance(f.dataType, T.StringType)}
    there = reduce(lambda a, b: a & b, (~is_blank(F.col(k)) if k in text else F.col(k).isNotNull() for k in keys))
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = incoming.where(there).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", order)
    kept = existing.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True).unionByName(incoming.where(~there).drop(order), allowMissingColumns=True)


# Datasets that imports insert into, the only ones that can be rolled back, and the states of a committed import.
INSERTED = ("sales", "inventory", "returns", "purchase_orders")
COMMITTED = ("completed", "completed_with_errors")


def rollback(facts: DataFrame, import_id: int) -> DataFrame:
    """Facts without those of an import."""
    return facts.where(F.col("import_id").isNull() | (F.col("import_id") != import_id))


def rolled_back(facts: DataFrame, imports: DataFrame, ids: DataFrame, cancel: bool = False) -> tuple[DataFrame, DataFrame]:
    """Facts without the rows of the imports ``ids``, and the ledger after it.

    Only committed imports of inserted datasets are undone; ``cancel`` takes
    any import, and of master data leaves what was written.
    """
    chosen = imports.join(ids.select("id"), "id", "left_semi")
    chosen = chosen if cancel else chosen.where(can_roll_back())
    gone = chosen.where(F.col("data_type").isin(*INSERTED)).select(F.col("id").alias("import_id"))
    removed = facts.join(gone, "import_id", "left_semi").groupBy("import_id").agg(F.count("*").alias("removed"))
    note = chosen.select("id").withColumn("hit", F.lit(True)).join(removed.withColumnRenamed("import_id", "id"), "id", "left")
    said = F.when(F.col("data_type").isin(*INSERTED), F.concat(F.lit("Rolled back — "), F.coalesce("removed", F.lit(0)).cast("string"), F.lit(" row(s) removed."))).otherwise("Import cancelled.")
    ledger = imports.join(note, "id", "left")
    ledger = ledger.withColumns({"status": F.when(F.col("hit"), "rolled_back").otherwise(F.col("status")), "error_message": F.when(F.col("hit"), said).otherwise(F.col("error_message"))})
    return facts.join(gone, "import_id", "left_anti"), ledger.drop("hit", "removed")


def can_roll_back() -> Column:
    """Whether an import (data_type, status) can be rolled back."""
    return F.col("data_type").isin(*INSERTED) & F.col("status").isin(*COMMITTED)


def retried(rejects: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """Rejected rows (import_id and the mapped fields) that are good now, and those that still fail, with their new error."""
    keep = rejects.withColumn("_order", F.struct("import_id", "_order"))
    good, bad = split_valid(validate(keep, dataset))
    out = lambda df: df.withColumn("import_id", F.col("_order.import_id")).withColumn("_order", F.col("_order._order"))
    return out(good), out(bad)


def after_retry(imports: DataFrame, good: DataFrame, bad: DataFrame, untried: DataFrame | None = None) -> DataFrame:
    """The ledger after a retry: imported and failed rows, and the state that what remains gives.

    ``untried`` holds the rejects (import_id) that were not retried; with those
    that failed again they are what remains of an import that had a retry.
    """
    each = [good.select("import_id", F.lit(1).alias("g"), F.lit(0).alias("b"), F.lit(1).alias("tried")), bad.select("import_id", F.lit(0).alias("g"), F.lit(1).alias("b"), F.lit(1).alias("tried"))]
    each += [] if untried is None else [untried.select("import_id", F.lit(0).alias("g"), F.lit(1).alias("b"), F.lit(0).alias("tried"))]
    n = reduce(DataFrame.unionByName, each).groupBy(F.col("import_id").alias("id")).agg(F.sum("g").alias("n_good"), F.sum("b").alias("n_bad"), F.max("tried").alias("tried")).where("tried = 1").drop("tried")
    rows, bad_ = imports.join(n, "id", "left"), F.coalesce("n_bad", F.lit(0))
    hit = F.col("n_good").isNotNull() | F.col("n_bad").isNotNull()
    return rows.withColumns(
        {
            "imported_rows": F.col("imported_rows") + F.coalesce("n_good", F.lit(0)), "failed_rows": F.when(hit, bad_).otherwise(F.col("failed_rows")),
            "status": F.when(hit, F.when(bad_ == 0, "completed").otherwise("completed_with_errors")).otherwise(F.col("status")),
        }
    ).drop("n_good", "n_bad")


def run_figures(runs: DataFrame) -> DataFrame:
    """Success rate in percent and duration in seconds of each run."""
    rate = F.round(F.try_divide(F.col("rows_imported").cast("double") * 100, F.nullif(F.col("rows_processed"), F.lit(0)).cast("double")) + F.lit(1e-9), 1)
    took = F.abs(F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(1e6)
    return runs.withColumns({"success_rate": rate, "seconds": F.floor(took), "successful": (F.col("status") == "completed") & (F.col("rows_failed") == 0)})


def run_ledger(checked: DataFrame, data_type: str) -> DataFrame:
    """One row for the run: status, counts, score, and up to 20 rejected samples, the first by order, with their row."""
    bad = F.col("error").isNotNull()
    row = checked.agg(F.count("*").alias("rows_processed"), F.count_if(~bad).alias("rows_imported"), F.count_if(bad).alias("rows_rejected"))
    samples = checked.where(bad).orderBy("_order").limit(20).select(F.struct(F.col("_order").alias("row"), "error").alias("s")).agg(F.sort_array(F.collect_list("s")).alias("samples"))
    status = F.when(F.col("rows_rejected") == 0, "completed").when(F.col("rows_imported") == 0, "failed").otherwise("partial")
    score = F.when(F.col("rows_processed") > 0, F.round(F.col("rows_imported") / F.col("rows_processed") * 100, 2)).otherwise(100.0)
    return row.crossJoin(samples).select(F.lit(data_type).alias("data_type"), status.alias("status"), "rows_processed", "rows_imported", "rows_rejected", score.alias("validation_score"), "samples")


def progress(cursor: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.round(cursor / total * 100))).otherwise(F.when(cursor > 0, 100).otherwise(0)).cast("int")


def recover_stuck(imports: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Imports that were running and have not moved for ``minutes`` become failed."""
    stuck = (F.col("status") == "importing") & (F.col("updated_at") < now - F.make_interval(mins=F.lit(minutes)))
    return imports.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))
