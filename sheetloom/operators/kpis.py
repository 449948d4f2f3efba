"""Indicators over the fact table. Hours belong to a sheet, not to a row: each sheet's count once in every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACEHOLDERS = ("", "/", "-")


def filled(c: str) -> Column:
    """A value that is neither null nor blank."""
    return F.when(F.trim(c) != "", F.col(c))


def by_sheet(fact: DataFrame, *keys: str) -> DataFrame:
    """Of each group and sheet: pieces, rows and the sheet's hours. What counts a sheet once is made of these rows, so that the
    facts are read and joined once."""
    return fact.groupBy(*keys, "sheet_id").agg(F.sum("qtd").alias("qty"), F.count("*").alias("n_rows"), F.max("hours").alias("hours"))


def day_summary(fact: DataFrame, day: str) -> DataFrame:
    """One row: pieces, rows, sheets, orders, operators and clients of a day, and its hours. The distinct sheets and
    their hours come from one row a sheet, so that only small sets are shuffled."""
    f = fact.where(F.col("iso_date") == F.lit(day).cast("date"))
    by_sheet = f.groupBy("sheet_id").agg(F.sum("qtd").alias("qty"), F.count("*").alias("n"), F.max("hours").alias("h"), F.max(F.when(F.col("status") == "validated", 1).otherwise(0)).alias("valid"))
    totals = by_sheet.agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_sheets"), F.coalesce(F.sum("valid"), F.lit(0)).cast("bigint").alias("n_validated"), F.coalesce(F.sum("h"), F.lit(0.0)).alias("hours"))
    sets = f.agg(F.count_distinct("of").alias("n_of"), F.count_distinct("operador").alias("n_operador"), F.count_distinct(filled("cliente")).alias("n_cliente"))
    return totals.crossJoin(sets)  # one row by one row


def totals_by(fact: DataFrame, *keys: str) -> DataFrame:
    """qty, sheets, rows and hours of each group, each sheet's hours once."""
    return by_sheet(fact, *keys).groupBy(*keys).agg(F.sum("qty").alias("qty"), F.count("sheet_id").alias("n_sheets"), F.sum("n_rows").alias("n_rows"), F.sum("hours").alias("hours"))


def top(grouped: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    return grouped.orderBy(F.desc(by), *ties).limit(n)


def last_days(fact: DataFrame, end: str, days: int) -> DataFrame:
    """Both ends count: days + 1 calendar days."""
    return fact.where(F.col("iso_date").between(F.date_sub(F.lit(end).cast("date"), days), F.lit(end).cast("date")))


def week_key(day: Column) -> Column:
    """Year and week of the year, weeks starting on Monday, days before the first Monday in week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(F.date_format(day, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def months_before(day: str, months: int) -> Column:
    """The same day of an earlier month; a day that month lacks rolls over into the next."""
    d = F.lit(day).cast("date")
    return F.date_add(F.trunc(F.add_months(d, -months), "month"), F.dayofmonth(d) - 1)


def worker_summary(fact: DataFrame, end: str, days: int = 7) -> DataFrame:
    """Of each operator: sheets, pieces, least, most and mean pieces of a row, and the pieces of the last days, 0 where there are none."""
    ago = F.datediff(F.lit(end).cast("date"), F.col("iso_date"))
    recent = [F.sum(F.when(ago == days - 1 - i, F.col("qtd"))).alias(f"d{i}") for i in range(days)]
    one = fact.groupBy("operador", "sheet_id").agg(F.sum("qtd").alias("qty"), F.count("qtd").alias("n"), F.min("qtd").alias("least"), F.max("qtd").alias("most"), *recent)
    out = one.groupBy("operador").agg(F.count("sheet_id").alias("n_sheets"), F.sum("qty").alias("qty"), F.min("least").alias("least"), F.max("most").alias("most"), F.round(F.sum("qty") / F.sum("n"), 6).alias("mean"), *[F.coalesce(F.sum(f"d{i}"), F.lit(0)).cast("string").alias(f"d{i}") for i in range(days)])
    return out.select("operador", "n_sheets", "qty", "least", "most", "mean", F.concat_ws(",", *[f"d{i}" for i in range(days)]).alias("recent"))


def worker_detail(fact: DataFrame, operador: str) -> dict[str, DataFrame]:
    f = fact.where(F.col("operador") == operador)
    return {
        "days": totals_by(f, "iso_date"),
        "sheets": f.select("sheet_id", "iso_date", "status", "hours").dropDuplicates(["sheet_id"]),
        "models": f.groupBy("modelo").agg(F.sum("qtd").alias("qty"), F.count("*").alias("n_rows")),
        "clients": f.groupBy("cliente").agg(F.sum("qtd").alias("qty"), F.count("*").alias("n_rows")),
    }


def job_summary(fact: DataFrame) -> DataFrame:
    """Of each order: pieces, sheets, operators, its client (the greatest by name) and its models, sorted. Operators and
    models of an order are few; its sheets, which may be many, are counted as rows."""
    one = fact.groupBy("of", "sheet_id").agg(F.sum("qtd").alias("qty"), F.collect_set("operador").alias("o"), F.max("cliente").alias("cliente"), F.collect_set("segmento").alias("s"), F.max("iso_date").alias("day"))
    every = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    return one.groupBy("of").agg(
        F.sum("qty").alias("qty"),
        F.count("sheet_id").alias("n_sheets"),
        F.size(every("o")).cast("long").alias("n_operador"),
        F.max("cliente").alias("cliente"),
        F.concat_ws(",", F.array_sort(every("s"))).alias("segmentos"),
        F.max("day").cast("string").alias("last_day"),
    )


def client_matrix(fact: DataFrame, left: str = "operador", right: str = "segmento") -> DataFrame:
    """Pieces, sheets and pieces an hour of each pair; pairs with a placeholder go after the sums are made."""
    rate = F.when(F.col("hours") > 0, F.round(F.col("qty") / F.col("hours"), 6)).otherwise(F.lit(0.0))
    return totals_by(fact, left, right).drop("n_rows").withColumn("rate", rate).where(~F.trim(right).isin(*PLACEHOLDERS))


def model_matrix(fact: DataFrame, n: int = 5) -> DataFrame:
    """Pieces by operator and model, of the n models with most pieces."""
    best = top(fact.groupBy("modelo").agg(F.sum("qtd").alias("all_qty")), "all_qty", n, "modelo")
    return fact.join(F.broadcast(best.select("modelo")), "modelo", "left_semi").groupBy("operador", "modelo").agg(F.sum("qtd").alias("qty"))


def lead_time(fact: DataFrame) -> DataFrame:
    """Days from an order's first to its last sheet, where they differ."""
    days = F.datediff(F.max("iso_date"), F.min("iso_date")).cast("bigint").alias("days")
    return fact.groupBy("of").agg(days, F.count_distinct("sheet_id").alias("n_sheets")).where("days > 0")


def alerts(sheet: DataFrame, edit: DataFrame, latest: int = 100, many: int = 5, floor: float = 0.0) -> dict[str, DataFrame]:
    """low: of the latest sheets, those under a total (the limit comes before the filter); edited: sheets with many
    edits; fields: the fields edited most."""
    newest = sheet.orderBy(F.desc("sheet_id")).limit(latest)
    edited = sheet.join(edit, "sheet_id").groupBy("sheet_id").agg(F.count("id").alias("n_edits")).where(F.col("n_edits") >= many)
    leaf = F.expr("substr(field_path, instr(field_path, '.') + 1)")
    fields = edit.where("source = 'human'").groupBy(leaf.alias("field")).agg(F.count("*").alias("n"))
    return {"low": newest.where(F.col("total") < floor), "edited": edited, "fields": top(fields, "n", 10, "field")}


def stuck(sheet: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    """Pending sheets older than so many days."""
    age = F.datediff(F.lit(as_of).cast("date"), "iso_date")
    return sheet.where((F.col("status") == "pending") & (age > days)).select("sheet_id", age.cast("bigint").alias("age"))


def sector_overview(fact: DataFrame, dimension: DataFrame) -> DataFrame:
    """Sector and machine totals with subtotals: rows whose label has no sector are left out of all of them.

    dimension: label, sector, machine. Sheet hours are distinct by sheet in every grouping set.
    """
    routed = fact.join(dimension, fact["setor"] == dimension["label"]).drop("label")
    one = by_sheet(routed, "sector", "machine")
    none = F.lit(None).cast("string")
    sets = F.array(F.struct("sector", "machine", F.lit(0).alias("level")), F.struct("sector", none.alias("machine"), F.lit(1).alias("level")), F.struct(none.alias("sector"), none.alias("machine"), F.lit(3).alias("level")))
    # a sheet of several machines counts once in each subtotal
    spread = one.select("sheet_id", "qty", "hours", F.inline(sets)).groupBy("sector", "machine", "level", "sheet_id").agg(F.sum("qty").alias("qty"), F.max("hours").alias("hours"))
    return spread.groupBy("sector", "machine", "level").agg(F.sum("qty").alias("qty"), F.count("sheet_id").alias("n_sheets"), F.sum("hours").alias("hours")).select("sector", "machine", "qty", "n_sheets", "hours", "level")


def period(day: str, kind: str) -> tuple[Column, Column]:
    """First and last day of the day, week, month or year around a day."""
    d = F.lit(day).cast("date")
    if kind == "day":
        return d, d
    if kind == "week":
        first = F.to_date(F.date_trunc("week", d))
        return first, F.date_add(first, 6)
    if kind == "month":
        return F.trunc(d, "month"), F.last_day(d)
    if kind == "year":
        return F.trunc(d, "year"), F.make_date(F.year(d), F.lit(12), F.lit(31))
    raise ValueError(kind)


def keep_most_used(labels: DataFrame, label: str, key: Column) -> DataFrame:
    """Of labels that are equal by a key, the one used most (the first by name in a tie)."""
    n = labels.groupBy(label).count().withColumn("key", key)
    order = Window.partitionBy("key").orderBy(F.desc("count"), label)
    return n.withColumn("place", F.row_number().over(order)).where("place = 1").select(label, "key", "count")
