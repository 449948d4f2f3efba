"""Tables as other programs take them: summaries by day and operator, the flat table of a migration, and what it derives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text


def in_sector(rows: DataFrame, templates: DataFrame, label: str, sector: str | None) -> DataFrame:
    """The rows whose label's template is of a sector; labels (label, phase) that are unknown count as the first phase."""
    if not sector:
        return rows
    known = templates.select(text.label(F.col("label")).alias("_l"), F.col("phase").alias("_phase")).dropDuplicates(["_l"])
    first = templates.orderBy("ord").select("phase").limit(1).select(F.col("phase").alias("_first"))
    out = rows.join(known, text.label(F.coalesce(label, F.lit(""))) == F.col("_l"), "left").crossJoin(F.broadcast(first))  # one row
    return out.where(F.coalesce("_phase", "_first") == sector).drop("_l", "_phase", "_first")


def machine_of(rows: DataFrame, label: str, catalogue: DataFrame, table: DataFrame) -> DataFrame:
    """rows with machine: the code of a label by the catalogue (label, code), by an exact entry of a table (label, code, ord),
    or by its first entry that the label holds; else empty."""
    known = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    labels = rows.select(known.alias("_k")).distinct().where("_k != ''")
    by_catalogue = catalogue.groupBy(F.upper(F.trim("label")).alias("_k")).agg(F.min(F.upper(F.trim("code"))).alias("_c0"))
    by_table = table.groupBy(F.upper("label").alias("_k")).agg(F.min_by("code", "ord").alias("_c1"))
    # the table is a fixed list: a few dozen entries
    held = labels.crossJoin(F.broadcast(table)).where(F.contains("_k", F.upper("label"))).groupBy("_k").agg(F.min_by("code", "ord").alias("_c2"))
    found = labels.join(by_catalogue, "_k", "left").join(by_table, "_k", "left").join(held, "_k", "left").select(F.col("_k").alias("_key"), F.coalesce("_c0", "_c1", "_c2").alias("_code"))
    return rows.join(found, known == F.col("_key"), "left").withColumn("machine", F.coalesce("_code", F.lit(""))).drop("_key", "_code")


def filled_from_plan(rows: DataFrame, match: DataFrame, entries: DataFrame, fields: tuple[str, ...] = ("ov", "cliente")) -> DataFrame:
    """rows (row_id) whose blank fields are those of the plan entry they match: match (row_id, entry_ord), entries."""
    j = rows.join(match.select("row_id", "entry_ord"), "row_id", "left").join(entries.select("entry_ord", *[F.col(f).alias(f"_{f}") for f in fields]), "entry_ord", "left")
    filled = {f: F.coalesce(F.nullif(F.trim(f), F.lit("")), F.trim(f"_{f}"), F.lit("")) for f in fields}
    return j.withColumns(filled).drop("entry_ord", *[f"_{f}" for f in fields])


def summary(facts: DataFrame) -> DataFrame:
    """One row over everything exported."""
    return totals(facts)


def totals(facts: DataFrame, *keys: str) -> DataFrame:
    """Pieces, sheets, orders, operators and days, by keys."""
    return facts.groupBy(*keys).agg(F.coalesce(F.sum("qtd"), F.lit(0)).alias("qty"), F.count_distinct("sheet_id").alias("n_sheets"), F.count_distinct("of").alias("n_of"), F.count_distinct("operador").alias("n_operators"), F.count_distinct("iso_date").alias("n_days"))


def day_sheets(facts: DataFrame, columns: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The tables of each day, an operator after the other, as lines: (iso_date, place, kind, line). A heading before each
    operator's rows, and a total before the day's first. Lines are numbered within a day, by its rows alone."""
    line = F.concat_ws(";", *[F.coalesce(text.neutral(F.col(c).cast("string"), True), F.lit("")) for c in columns])
    rows = facts.select("iso_date", F.col("operador").alias("_o"), F.lit(2).alias("_k"), F.struct(*order).alias("_w"), F.lit("row").alias("kind"), line.alias("line"))
    blank = F.lit(None).cast(rows.schema["_w"].dataType)
    heads = facts.select("iso_date", "operador").distinct().select("iso_date", F.col("operador").alias("_o"), F.lit(1).alias("_k"), blank.alias("_w"), F.lit("operator").alias("kind"), text.neutral(F.col("operador"), True).alias("line"))
    tops = facts.groupBy("iso_date").agg(F.sum("qtd").alias("q"), F.count_distinct("sheet_id").alias("s"), F.count_distinct("of").alias("f"))
    tops = tops.select("iso_date", F.lit("").alias("_o"), F.lit(0).alias("_k"), blank.alias("_w"), F.lit("total").alias("kind"), F.concat_ws(";", *[F.col(c).cast("string") for c in "qsf"]).alias("line"))
    every = rows.unionByName(heads).unionByName(tops)
    place = F.row_number().over(Window.partitionBy("iso_date").orderBy("_o", "_k", "_w", "line"))
    return every.withColumn("place", place).select("iso_date", "place", "kind", "line")


def tonnes(kilograms: Column) -> Column:
    return F.round(kilograms / 1000.0, 3)


#: The columns of the migration's table, in order.
COLUMNS = (
    "data", "cod_funcionario", "nome_funcionario", "setor_maquina_desc", "cod_maquina", "of", "ov", "cliente", "modelo", "qtd", "qtd_metros", "m2", "nesting", "cesta_n", "duracao", "comp_mm",
    "larg_mm", "esp_mm", "coni", "n_chapas", "peso_consumido_t", "peso_produzido_t", "desperdicio_t", "desperdicio_pct", "sucata", "lote", "fecho",
)


def migration(rows: DataFrame) -> DataFrame:
    """The table of COLUMNS. rows: facts with weights (n_slices, *_kg, wasted_pct and the measures used), machine, header's
    pernr and code, and what the sheet says; texts that are null come as empty ones."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: text.number(F.col(c).cast("string"))
    pernr = F.coalesce(F.nullif(F.trim("pernr"), F.lit("")), text.personnel_number(F.col("code")))
    made = {
        "data": F.col("iso_date"),
        "cod_funcionario": pernr.try_cast("int"),
        "nome_funcionario": F.trim(F.coalesce("validated_operador", "operador", F.lit(""))),
        "setor_maquina_desc": blank("setor"),
        "cod_maquina": F.coalesce(F.nullif(F.trim("header_machine"), F.lit("")), "machine"),
        **{c: blank(c) for c in ("of", "ov", "cliente", "modelo", "nesting", "cesta_n", "coni", "lote")},
        "qtd": F.col("qtd").cast("int"),
        "qtd_metros": number("qtd_metros"),
        "m2": number("m2"),
        "duracao": F.coalesce(dates.length_between(dates.clock_loose(F.col("inicio")), dates.clock_loose(F.col("fim"))), F.lit("")),
        "comp_mm": number("comp").cast("int"),
        "larg_mm": number("larg").cast("int"),
        "esp_mm": number("esp"),
        "n_chapas": F.col("n_slices"),
        "peso_consumido_t": tonnes(F.col("consumed_kg")),
        "peso_produzido_t": tonnes(F.col("produced_kg")),
        "desperdicio_t": tonnes(F.col("wasted_kg")),
        "desperdicio_pct": F.round("wasted_pct", 2),
        "sucata": F.col("sucata").try_cast("int"),
        "fecho": F.when(F.upper(F.trim("fecho")) == "X", "X").otherwise(""),
    }
    return rows.select(*[made[c].alias(c) for c in COLUMNS])


def inbox(cells: DataFrame, engine: str) -> tuple[DataFrame, DataFrame]:
    """From one table of checked cells, of which those of other engines are stale: the sums of statuses by sheet, and the
    cells to look at (sheet_id, field_path, ref_value, ref_source, reason), with the paths and names that older ones lack."""
    now = cells.where(F.col("engine_version") == engine)
    sums = now.groupBy("sheet_id").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("MATCH", "n_match"), ("NO_MATCH", "n_miss"), ("NA", "n_na"))])
    section = F.coalesce("section", F.lit("rows"))
    path = F.coalesce(F.nullif("field_path", F.lit("")), F.when(section == "rows", F.concat(F.lit("rows["), F.col("row_index").cast("string"), F.lit("]."), "field")).otherwise(F.concat_ws(".", section, F.col("field"))))
    ref = F.coalesce(F.nullif("ref", F.lit("")), "plan_value")
    return sums, now.where("status = 'NO_MATCH'").select("sheet_id", path.alias("field_path"), ref.alias("ref_value"), F.coalesce(F.nullif("ref_source", F.lit("")), "source").alias("ref_source"), "reason")
