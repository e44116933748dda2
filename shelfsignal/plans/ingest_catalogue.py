"""Queries of the import path over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, imports, mail
from ..streaming.ingest import hourly_counts
from .bindings import MAIL_KEY, NOW, SIGNED, load
from .registry import Catalogue, r, tidy

CAT = Catalogue()
#: File rows as text: some without a quantity, some with words in it, some with a bad date.
_RAW = """SELECT l_orderkey * 10 + l_linenumber AS _order, CASE WHEN l_orderkey % 31 = 0 THEN 'soon' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS date, CASE WHEN l_orderkey % 37 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END AS sku,
    CASE l_orderkey % 29 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'n/a' WHEN 3 THEN concat('$', CAST(CAST(l_quantity AS INTEGER) AS STRING), ' pcs') ELSE CAST(CAST(l_quantity AS INTEGER) AS STRING) END AS quantity,
    CASE l_linenumber % 3 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE CAST(CAST(floor(l_extendedprice) AS INTEGER) AS STRING) END AS unit_price FROM lineitem"""
_NUM = "TRY_CAST(regexp_replace({}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"
_CHECK = f"""SELECT _order, TRY_CAST(date AS DATE) AS date, sku, {_NUM.format('quantity')} AS quantity, CASE WHEN unit_price NOT IN ('', '0') THEN {_NUM.format('unit_price')} END AS unit_price,
    CASE WHEN sku IN ('', '0') THEN 'Missing required field: sku' WHEN quantity IN ('', '0') THEN 'Missing required field: quantity' WHEN TRY_CAST(date AS DATE) IS NULL THEN 'Invalid date: date' WHEN {_NUM.format('quantity')} IS NULL THEN 'Invalid number: quantity' END AS error FROM ({_RAW})"""


def _rows(spark, sf_dir):
    raw = spark.sql(_RAW.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    named = raw.withColumnsRenamed({"date": "Sale Date", "sku": "Item Code", "quantity": "Qty", "unit_price": "Price"})
    mapping = {h: m[0] for h, m in imports.map_headers(["Sale Date", "Item Code", "Qty", "Price"], "sales").items()}
    return imports.validate(imports.apply_map(named, mapping), "sales")


def _add(name, f, sql):
    CAT.queries[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
    if sql:
        CAT.sql[name] = sql


_add("validate_sales_rows", _rows, f"SELECT _order, date, nullif(sku, '') AS sku, {r('quantity')} AS quantity, {r('unit_price')} AS unit_price, error FROM ({_CHECK})")
_add("reject_groups", lambda s, d: imports.reject_groups(imports.split_valid(_rows(s, d))[1]), f"SELECT error, count(*) AS rows FROM ({_CHECK}) WHERE error IS NOT NULL GROUP BY 1")
_add(
    "ingestion_run_summary",
    lambda s, d: imports.run_ledger(_rows(s, d), "sales").drop("samples"),
    f"SELECT 'sales' AS data_type, CASE WHEN count(error) = 0 THEN 'completed' WHEN count(error) = count(*) THEN 'failed' ELSE 'partial' END AS status, count(*) AS rows_processed, count(*) - count(error) AS rows_imported, count(error) AS rows_rejected, {r('round((count(*) - count(error)) / CAST(count(*) AS DOUBLE) * 100, 2)')} AS validation_score FROM ({_CHECK})",
)


def _upserted(spark, sf_dir):
    parts = load(spark, sf_dir, "part_products").select("sku", "name", "selling_price")
    incoming = _rows(spark, sf_dir).where("error IS NULL").select("sku", F.concat(F.lit("renamed "), "sku").alias("name"), F.col("quantity").alias("selling_price"), "_order", "date")
    incoming = incoming.select("sku", "name", "selling_price", F.struct("_order", "date", "selling_price").alias("_order"))
    return imports.upsert(parts, incoming, ["sku"])


_add(
    "master_upsert",
    _upserted,
    f"""SELECT sku, name, {r('selling_price')} AS selling_price FROM part_products WHERE sku NOT IN (SELECT sku FROM ({_CHECK}) WHERE error IS NULL)
    UNION ALL SELECT sku, 'renamed ' || sku, {r('quantity')} FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY _order DESC, date DESC, quantity DESC) AS k FROM ({_CHECK}) WHERE error IS NULL) WHERE k = 1""",
)


def _resolved(spark, sf_dir):
    rows = load(spark, sf_dir, "sales").select("location", "quantity")
    known = load(spark, sf_dir, "stores").select("id", "name").where("id % 3 <> 0")
    found, _ = imports.resolve_dimension(rows, known, "location")
    return found.groupBy("location", "location_id").agg(F.count("*").alias("rows"))


_add(
    "dimension_resolution",
    _resolved,
    """WITH k AS (SELECT id, name FROM stores WHERE id % 3 <> 0), m AS (SELECT location AS name, row_number() OVER (ORDER BY md5(location)) + (SELECT max(id) FROM k) AS id FROM (SELECT DISTINCT location FROM sales WHERE location NOT IN (SELECT name FROM k)))
    SELECT s.location, coalesce(k.id, m.id) AS location_id, count(*) AS rows FROM sales s LEFT JOIN k ON s.location = k.name LEFT JOIN m ON s.location = m.name GROUP BY 1, 2""",
)


#: Headers that are an alias to the letter, the field and dataset they stand for, and one that is like no alias.
_HEADERS = [("Item No", "sales", "sku"), ("trans date", "sales", "date"), ("Channel", "sales", "location"), ("units-sold", "sales", "quantity"), ("MSRP", "products", "selling_price"), ("UPC", "products", "barcode"), ("qty recv", "purchase_orders", "qty_received"), ("est. arrival", "purchase_orders", None), ("Lead Days", "suppliers", "lead_time_days"), ("territory", "stores", "region"), ("Permission", "users", "role"), ("safety_stock", "inventory", "reorder_point"), ("quantity", "returns", "quantity")]


_NAMED = [h for h in _HEADERS if h[2]]


def _header_map(spark, sf_dir):
    """Each part's number picks one of some headers; they are mapped as a column, dataset by dataset."""
    parts = load(spark, sf_dir, "part_products").select((F.col("sku").cast("long") % len(_NAMED)).alias("k"))
    pick = F.element_at(F.array(*(F.struct(F.lit(h).alias("header"), F.lit(d).alias("dataset")) for h, d, _ in _NAMED)), (F.col("k") + 1).cast("int"))
    return imports.map_header_rows(parts.select(pick.alias("x")).select("x.*")).groupBy("header", "dataset", "field", "confidence").agg(F.count("*").alias("rows"))


_add(
    "fuzzy_header_map",
    _header_map,
    "SELECT header, dataset, field, 1.0::DOUBLE AS confidence, count(*) AS rows FROM part_products JOIN (VALUES " + ", ".join(f"({i}, '{h}', '{d}', '{f}')" for i, (h, d, f) in enumerate(_NAMED)) + f") AS h(k, header, dataset, field) ON h.k = CAST(sku AS BIGINT) % {len(_NAMED)} GROUP BY ALL",
)


def _header_scores(spark, sf_dir):
    """Headers that no list has: names of fields with a letter taken out or put in, and a part's brand behind some."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = F.array(*map(F.lit, ("Sale Date", "Item Code", "Quantity", "Unit Price", "Location Name", "Transaction Ref", "Discount Pct", "Payment", "Zebra")))
    name, at = F.element_at(names, (F.col("p_partkey") % 9 + 1).cast("int")), (F.col("p_size") % 7 + 2).cast("int")
    changed = F.when(F.col("p_size") % 3 == 0, F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.lit(99)))).when(F.col("p_size") % 3 == 1, F.concat(F.substring(name, F.lit(1), at), F.lit("x"), F.substring(name, at + 1, F.lit(99)))).otherwise(F.concat(name, F.lit(" "), "p_brand"))
    return imports.map_header_rows(p.select(changed.alias("header"), F.lit("sales").alias("dataset"))).groupBy("header", "dataset", "field", "confidence").agg(F.count("*").alias("rows"))


#: SQL has no such similarity of texts; tested against a plain one.
_add("fuzzy_header_scores", _header_scores, None)
_add(
    "feed_file_match",
    lambda s, d: files.matching(load(s, d, "suppliers").select(F.concat(F.lit("Sales_"), "id", F.when(F.col("id") % 2 == 0, ".CSV").otherwise(".xlsx")).alias("name")), "sales_*.csv"),
    "SELECT 'Sales_' || id || '.CSV' AS name FROM suppliers WHERE id % 2 = 0",
)
_add("hourly_event_counts", lambda s, d: hourly_counts(s.read.parquet(f"{d}/events.parquet")).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH")), f"SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS events, {r('sum(CAST(value AS DECIMAL(18,2)))')} AS value FROM events GROUP BY 1, 2")


# Rows of every dataset. A raw table of text is made of the driver's rows; the oracle reads it with plain casts.
_B = "CASE WHEN {0} % 13 = 0 THEN '' ELSE {1} END"
_TABLES = {
    "inventory": "SELECT p_partkey AS _order, " + _B.format("p_partkey", "CAST(p_partkey AS STRING)") + " AS sku, concat('L', p_partkey % 25) AS location, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE CAST(p_size AS STRING) END AS on_hand_qty, CASE p_partkey % 3 WHEN 0 THEN '0' ELSE concat(CAST(p_size AS STRING), ' pcs') END AS reorder_point, CASE WHEN p_partkey % 17 = 0 THEN 'soon' ELSE '2001-07-31' END AS as_of_date FROM part",
    "purchase_orders": "SELECT l_orderkey * 10 + l_linenumber AS _order, " + _B.format("l_orderkey", "concat('PO-', CAST(l_orderkey AS STRING))") + " AS po_number, " + _B.format("l_suppkey", "concat(' S', CAST(l_suppkey AS STRING), ' ')") + " AS supplier, CAST(l_partkey AS STRING) AS sku, CASE WHEN l_orderkey % 19 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS STRING) END AS qty_ordered, CASE WHEN l_orderkey % 23 = 0 THEN '31.31.2001' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS order_date, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS STRING) END AS qty_received, '' AS received_date FROM lineitem",
    "returns": "SELECT l_orderkey * 10 + l_linenumber AS _order, CAST(CAST(l_shipdate AS DATE) AS STRING) AS date, CAST(l_partkey AS STRING) AS sku, CASE WHEN l_orderkey % 19 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS STRING) END AS quantity, CASE l_linenumber % 3 WHEN 0 THEN '' ELSE CAST(CAST(floor(l_extendedprice) AS INTEGER) AS STRING) END AS value, ' late ' AS reason FROM lineitem WHERE l_returnflag = 'R'",
    "products": "SELECT p_partkey AS _order, CAST(p_partkey AS STRING) AS sku, " + _B.format("p_partkey", "concat(' ', p_name)") + " AS name, p_type AS category, CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE CAST(p_size AS STRING) END AS unit_cost, concat('$', CAST(p_size * 2 AS STRING)) AS selling_price FROM part",
    "stores": "SELECT n_nationkey AS _order, " + _B.format("n_nationkey", "n_name") + " AS name, concat(' C', CAST(n_nationkey AS STRING)) AS code, '' AS city FROM nation",
    "suppliers": "SELECT s_suppkey AS _order, " + _B.format("s_suppkey", "s_name") + " AS name, CASE WHEN s_suppkey % 2 = 0 THEN '14 days' ELSE '' END AS lead_time_days, concat('x', CAST(s_suppkey AS STRING), '@y.org') AS contact_email FROM supplier",
    "users": "SELECT c_custkey AS _order, c_name AS name, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'no address' ELSE concat(' USER', CAST(c_custkey AS STRING), '@Example.com ') END AS email, CASE c_custkey % 3 WHEN 0 THEN 'Admin' WHEN 1 THEN 'clerk' ELSE 'tenant_admin' END AS role FROM customer",
}


def _typed(name):
    table = _TABLES[name].rsplit("FROM ", 1)[1].split()[0]

    def run(spark, sf_dir):
        sql = _TABLES[name].replace(f"FROM {table}", f"FROM {{{table}}}")
        raw = spark.sql(sql, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})
        fields = [c for c in raw.columns if c != "_order"]
        return imports.validate(imports.apply_map(raw, {c: c for c in fields}), name)

    return run


def _num(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ('', '0') THEN {_NUM.format(c)} END"


def _any(c: str) -> str:
    return f"nullif(trim({c}), '')"


def _first(*checks: str) -> str:
    return f"coalesce({', '.join(checks)}) AS error"


def _required(*fields: str) -> list[str]:
    return [f"CASE WHEN coalesce({f}, '') IN ('', '0') THEN 'Missing required field: {f}' END" for f in fields]


def _bad_date(c: str) -> str:
    return f"CASE WHEN {c} <> '' AND TRY_CAST({c} AS DATE) IS NULL THEN 'Invalid date: {c}' END"


def _bad_number(c: str) -> str:
    return f"CASE WHEN {_NUM.format(c)} IS NULL THEN 'Invalid number: {c}' END"


_WANT = {
    "inventory": f"_order, {_any('sku')} AS sku, location, {r('coalesce(' + _NUM.format('on_hand_qty') + ', 0)')} AS on_hand_qty, {r(_num('reorder_point'))} AS reorder_point, TRY_CAST(as_of_date AS DATE) AS as_of_date, {_first(*_required('sku'), _bad_date('as_of_date'))}",
    "purchase_orders": f"_order, {_any('po_number')} AS po_number, {_any('supplier')} AS supplier, sku, {r(_NUM.format('qty_ordered'))} AS qty_ordered, TRY_CAST(order_date AS DATE) AS order_date, {r(_num('qty_received'))} AS qty_received, CAST(NULL AS DATE) AS received_date, {_first(*_required('po_number', 'supplier', 'sku'), _bad_number('qty_ordered'), _bad_date('order_date'))}",
    "returns": f"_order, TRY_CAST(date AS DATE) AS date, sku, {r(_NUM.format('quantity'))} AS quantity, {r(_num('value'))} AS value, 'late' AS reason, {_first(*_required('sku', 'quantity'))}",
    "products": f"_order, sku, {_any('name')} AS name, category, {r(_num('unit_cost'))} AS unit_cost, {r(_num('selling_price'))} AS selling_price, {_first(*_required('sku', 'name'))}",
    "stores": f"_order, {_any('name')} AS name, trim(code) AS code, CAST(NULL AS VARCHAR) AS city, {_first(*_required('name'))}",
    "suppliers": f"_order, {_any('name')} AS name, {r(_num('lead_time_days'))} AS lead_time_days, contact_email, {_first(*_required('name'))}",
    "users": f"_order, name, lower({_any('email')}) AS email, role, lower(trim(role)) IN ('admin', 'tenant_admin') AS is_admin, {_first(*_required('email'), chr(67) + 'ASE WHEN trim(email) NOT LIKE ' + chr(39) + '%@%.%' + chr(39) + ' THEN ' + chr(39) + 'Invalid e-mail' + chr(39) + ' END')}",
}
for _name in _TABLES:
    _add(f"validate_{_name}_rows", _typed(_name), f"SELECT {_WANT[_name]} FROM ({_TABLES[_name]})")


# Ledgers of imports
_imports = lambda s, d: load(s, d, "imports")
_add("import_progress", lambda s, d: _imports(s, d).select("id", imports.progress(F.col("process_cursor"), F.col("total_rows")).alias("pct")), "SELECT id, CAST(CASE WHEN total_rows > 0 THEN least(100, round(process_cursor / CAST(total_rows AS DOUBLE) * 100)) WHEN process_cursor > 0 THEN 100 ELSE 0 END AS BIGINT) AS pct FROM imports")
_add("stuck_imports", lambda s, d: imports.recover_stuck(_imports(s, d), F.lit(NOW).cast("timestamp_ntz")).groupBy("status").agg(F.count("*").alias("n")), "SELECT CASE WHEN status = 'importing' AND updated_at < TIMESTAMP '2024-01-30 23:50:00' THEN 'failed' ELSE status END AS status, count(*) AS n FROM imports GROUP BY 1")
_CAN = "data_type IN ('sales', 'inventory', 'returns', 'purchase_orders') AND status IN ('completed', 'completed_with_errors')"
_add("rollback_eligible", lambda s, d: _imports(s, d).select("id", imports.can_roll_back().alias("eligible")), f"SELECT id, {_CAN} AS eligible FROM imports")


def _undone(spark, sf_dir, cancel):
    facts, ledger = imports.rolled_back(load(spark, sf_dir, "imported_sales"), _imports(spark, sf_dir), _imports(spark, sf_dir).where("id % 4 = 1").select("id"), cancel)
    left = facts.groupBy("import_id").agg(F.count("*").alias("rows"))
    return ledger.select("id", "status", "error_message").join(left, F.col("id") == F.col("import_id"), "left").select("id", "status", "error_message", F.coalesce("rows", F.lit(0)).alias("rows"))


def _undone_sql(hit: str) -> str:
    return f"""SELECT i.id, CASE WHEN {hit} THEN 'rolled_back' ELSE i.status END AS status, CASE WHEN {hit} THEN CASE WHEN data_type IN ('sales', 'inventory', 'returns', 'purchase_orders') THEN 'Rolled back — ' || coalesce(n, 0) || ' row(s) removed.' ELSE 'Import cancelled.' END END AS error_message,
      CASE WHEN {hit} AND data_type IN ('sales', 'inventory', 'returns', 'purchase_orders') THEN 0 ELSE coalesce(n, 0) END AS rows FROM imports i LEFT JOIN (SELECT import_id, count(*) AS n FROM imported_sales GROUP BY 1) f ON f.import_id = i.id"""


_add("import_rollback", lambda s, d: _undone(s, d, False), _undone_sql(f"(id % 4 = 1 AND {_CAN})"))
_add("import_cancel", lambda s, d: _undone(s, d, True), _undone_sql("(id % 4 = 1)"))


def _again(spark, sf_dir):
    """Rejected rows, a third of them mended, as an import's; the ledger after a retry of two fifths of them."""
    raw = spark.sql(_RAW.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    bad = imports.validate(raw, "sales").where("error IS NOT NULL").select("_order")
    mended = raw.join(bad, "_order", "left_semi").withColumn("import_id", F.col("_order") % 50).withColumn("quantity", F.when(F.col("_order") % 3 == 0, "5").otherwise(F.col("quantity")))
    chosen = F.col("_order") % 5 < 2
    good, still = imports.retried(mended.where(chosen), "sales")
    return imports.after_retry(_imports(spark, sf_dir), good, still, mended.where(~chosen)).select("id", "status", "imported_rows", "failed_rows")


_MENDED = f"SELECT _order, date, sku, CASE WHEN _order % 3 = 0 THEN '5' ELSE quantity END AS quantity, unit_price FROM ({_RAW}) WHERE _order IN (SELECT _order FROM ({_CHECK}) WHERE error IS NOT NULL)"
_AGAIN = f"SELECT _order % 50 AS import_id, count(*) FILTER (WHERE error IS NULL AND _order % 5 < 2) AS g, count(*) FILTER (WHERE error IS NOT NULL OR _order % 5 >= 2) AS b FROM ({_CHECK.replace(_RAW, _MENDED)}) GROUP BY 1 HAVING count(*) FILTER (WHERE _order % 5 < 2) > 0"
_add("import_retry", _again, f"SELECT i.id, CASE WHEN a.import_id IS NULL THEN i.status WHEN a.b = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status, i.imported_rows + coalesce(a.g, 0) AS imported_rows, CASE WHEN a.import_id IS NULL THEN i.failed_rows ELSE a.b END AS failed_rows FROM imports i LEFT JOIN ({_AGAIN}) a ON a.import_id = i.id")
_add("run_figures", lambda s, d: imports.run_figures(load(s, d, "runs")).select("id", "success_rate", "seconds", "successful"), f"SELECT id, {r('CASE WHEN rows_processed <> 0 THEN round(CAST(rows_imported AS DOUBLE) * 100 / rows_processed + 1e-9, 1) END')} AS success_rate, 420 AS seconds, status = 'completed' AND rows_failed = 0 AS successful FROM runs")
def _sales_upserted(spark, sf_dir):
    """Sold rows with their number, and an import's, of which a fifth has none, an empty one or a zero."""
    old = load(spark, sf_dir, "sales").select("transaction_id", "quantity").groupBy("transaction_id").agg(F.max("quantity").alias("quantity"))
    old = old.unionByName(old.where("quantity = 7").select(F.lit(None).cast("string").alias("transaction_id"), "quantity"))
    key = F.when(F.col("_order") % 15 == 0, F.lit(None)).when(F.col("_order") % 15 == 5, "").when(F.col("_order") % 15 == 10, "0").otherwise(F.concat("sku", F.lit("-1")))
    new = _rows(spark, sf_dir).where("error IS NULL").select(key.alias("transaction_id"), F.col("quantity").cast("decimal(12,2)").alias("quantity"), F.struct("_order", "date", "quantity").alias("_order"))
    return imports.upsert(old, new, ["transaction_id"])


_add(
    "sales_upsert",
    _sales_upserted,
    f"""WITH n AS (SELECT CASE WHEN _order % 15 = 0 THEN NULL WHEN _order % 15 = 5 THEN '' WHEN _order % 15 = 10 THEN '0' ELSE sku || '-1' END AS transaction_id, CAST(quantity AS DECIMAL(12,2)) AS quantity, _order, date FROM ({_CHECK}) WHERE error IS NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY _order DESC, date DESC, quantity DESC) AS k FROM n WHERE transaction_id NOT IN ('', '0')),
    o AS (SELECT transaction_id, max(quantity) AS quantity FROM sales GROUP BY 1)
    SELECT transaction_id, {r('quantity')} AS quantity FROM o WHERE transaction_id NOT IN (SELECT transaction_id FROM k) UNION ALL SELECT NULL, {r('quantity')} FROM o WHERE quantity = 7
    UNION ALL SELECT transaction_id, {r('quantity')} FROM k WHERE k = 1 UNION ALL SELECT transaction_id, {r('quantity')} FROM n WHERE transaction_id IS NULL OR transaction_id IN ('', '0')""",
)


# Mail
def _mail(spark, sf_dir):
    get = lambda name: load(spark, sf_dir, name)
    return mail.comments(get("inbound_mail"), get("mail_cases"), get("users"), get("mail_posted"), MAIL_KEY)


_MAIL = r"""SELECT message_id, lower(nullif(regexp_extract(sender, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', 0), '')) AS sender, coalesce(nullif(regexp_extract(recipient, '\+([A-Za-z0-9\-]+)@', 1), ''), nullif(regexp_extract(subject, '\[INV-([A-Za-z0-9\-]+)\]', 1), '')) AS token,
    trim(regexp_replace(split_part(replace(body, chr(13), ''), chr(10), 1), '^\s+', '')) AS line, body FROM inbound_mail"""
_SIGNATURES = ", ".join(f"({n}, '{n}-{signature}')" for n, signature in SIGNED.items())
_READ = f"""SELECT m.*, i.id AS investigation_id, u.id AS author_id, CASE WHEN m.token IS NULL THEN 'no reply token found' WHEN t.token IS NULL THEN 'invalid token' WHEN i.id IS NULL THEN 'investigation not found' WHEN m.sender IS NULL THEN 'no sender address' WHEN u.id IS NULL THEN 'sender is not a user of this tenant'
      WHEN m.line = '' THEN 'empty message body' WHEN p.message_id IS NOT NULL THEN 'already posted' END AS reason
    FROM ({_MAIL}) m LEFT JOIN (VALUES {_SIGNATURES}) t(number, token) ON t.token = m.token LEFT JOIN mail_cases i ON i.id = t.number LEFT JOIN users u ON lower(u.email) = m.sender LEFT JOIN mail_posted p ON p.message_id = m.message_id AND p.investigation_id = i.id"""
_add("mail_comments", lambda s, d: _mail(s, d)[0].groupBy("investigation_id", "message_id", "source").agg(F.count("*").alias("n"), F.count_if(F.col("body").rlike(r"^text \d+$")).alias("whole")), f"SELECT investigation_id, message_id, 'email' AS source, 1 AS n, 1 AS whole FROM ({_READ}) WHERE reason IS NULL GROUP BY 1, 2")
_add("mail_ignored", lambda s, d: _mail(s, d)[1].groupBy("reason").agg(F.count("*").alias("n")), f"SELECT reason, count(*) AS n FROM ({_READ}) WHERE reason IS NOT NULL GROUP BY 1")


# Feeds
_due = lambda s, d: files.due_files(load(s, d, "remote_files").distinct(), load(s, d, "connections"), load(s, d, "feeds"), load(s, d, "taken_files"))
_DUE = """SELECT f.connection_id, c.tenant_id, min(e.id) AS feed_id, f.path, f.filename FROM (SELECT DISTINCT connection_id, path, string_split(path, '/')[-1] AS filename, CASE WHEN path LIKE '%/%' THEN string_split(path, '/')[1] ELSE '.' END AS folder FROM remote_files) f JOIN connections c ON c.id = f.connection_id AND c.active
    JOIN feeds e ON e.connection_id = f.connection_id AND e.enabled AND f.folder = CASE trim(e.remote_path) WHEN 'in/' THEN 'in' WHEN '' THEN '.' ELSE trim(e.remote_path) END AND lower(f.filename) GLOB CASE e.pattern WHEN '' THEN '*' ELSE lower(e.pattern) END
    WHERE NOT EXISTS (SELECT 1 FROM taken_files t WHERE t.connection_id = f.connection_id AND t.path = f.path) GROUP BY 1, 2, 4, 5"""
_add("feed_due_files", lambda s, d: _due(s, d).drop("data_type"), _DUE)


def _polled(spark, sf_dir):
    taken = _due(spark, sf_dir).select("connection_id", "feed_id", "path", "filename", F.when(F.length("filename") % 5 == 0, 0).otherwise(9).alias("size"), F.lit(4).alias("import_id"), F.when(F.col("filename").like("other%"), "bad header").alias("error"))
    ledger = load(spark, sf_dir, "taken_files").distinct().withColumn("status", F.lit("imported"))
    return files.poll_ledger(ledger, taken, F.lit(NOW).cast("timestamp_ntz")).groupBy("status", "error").agg(F.count("*").alias("n"))


_add("feed_ledger", _polled, f"SELECT CASE WHEN error IS NULL THEN 'imported' ELSE 'failed' END AS status, error, count(*) AS n FROM (SELECT CASE WHEN length(filename) % 5 = 0 THEN 'Empty or unreadable remote file.' WHEN filename LIKE 'other%' THEN 'bad header' END AS error FROM ({_DUE}) UNION ALL SELECT NULL FROM (SELECT DISTINCT * FROM taken_files)) GROUP BY 1, 2")
