"""What an operator runs on: tables of one tenant, an as-of date and a clock."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.shared import shared_dir
from .schema import RULES

Table = DataFrame | Callable[[], DataFrame]


@dataclass
class Context:
    """Tables by canonical name; a table may be given as a function that builds it when it is asked for."""

    tables: Mapping[str, Table]
    as_of: dt.date
    now: dt.datetime
    tenant_id: int | None = None
    thresholds: dict[str, dict[str, float]] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """The rows of this context's tenant; without a tenant, or a tenant_id column, all rows."""
        found = self.tables[name]
        df = found() if callable(found) and not isinstance(found, DataFrame) else found
        return df if self.tenant_id is None or "tenant_id" not in df.columns else df.where(F.col("tenant_id") == self.tenant_id)

    def staged(self, *names: str) -> Context:
        """This context with some tables of the tenant written to the shared folder and read from there: built once, however often they are scanned.

        The files outlive executors and the session; clear the folder ``tables``
        there when what was made of them has been written.
        """
        kept = {}
        for name in names:
            df = self.table(name)
            path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            kept[name] = df.sparkSession.read.schema(df.schema).parquet(path)
        return Context({**self.tables, **kept}, self.as_of, self.now, self.tenant_id, self.thresholds)

    def threshold(self, rule: str, key: str) -> float:
        """The tenant's threshold over the default one."""
        return self.thresholds.get(rule, {}).get(key, RULES[rule][1][key])

    def day(self, back: int = 0) -> Column:
        return F.lit(self.as_of - dt.timedelta(days=back))

    def clock(self, hours: float = 0) -> Column:
        return F.lit(self.now - dt.timedelta(hours=hours)).cast("timestamp_ntz")
