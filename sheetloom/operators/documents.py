"""Nested documents and their flat forms: explode, paths, change-log replay, key-wise replacement, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

ROW = "array<struct<of: string, ov: string, cliente: string, modelo: string, qtd: string, comp_mm: string, larg_mm: string, lote: string, esp: string, lbase: string, ltopo: string, motivo: string, inicio: string, fim: string>>"
DOCUMENT = f"header struct<operador: string, n_operador: string, setor_maquina: string, data: string, turno: string>, rows {ROW}, footer struct<colunas_produzidas: string, horas_trabalhadas: string>"
FIELDS = ("of", "ov", "cliente", "modelo", "qtd", "comp_mm", "larg_mm", "lote", "esp", "lbase", "ltopo")


def parsed(docs: DataFrame, column: str = "doc") -> DataFrame:
    """docs with the JSON text read to DOCUMENT's fields; what isn't there is null."""
    return docs.withColumn("_d", F.from_json(column, DOCUMENT)).select(*[c for c in docs.columns if c != column], "_d.*")


def row_facts(docs: DataFrame, needed: tuple[str, ...] = ("of", "modelo", "cliente", "qtd")) -> DataFrame:
    """A fact for each row with something in the fields that make one; numbers and dates read, the sheet's total beside."""
    r = docs.select("sheet_id", "header", "footer", F.posexplode("rows").alias("row_index", "r"))
    r = r.where(F.exists(F.array(*[F.col(f"r.{c}") for c in needed]), lambda x: F.coalesce(F.trim(x) != "", F.lit(False))))
    text = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    return r.select(
        "sheet_id",
        "row_index",
        text("header.operador").alias("operador"),
        dates.date_parts(F.col("header.data")).alias("sheet_iso_date"),
        dates.hours(F.col("footer.horas_trabalhadas")).alias("sheet_hours"),
        *[text(f"r.{c}").alias(c) for c in ("of", "ov", "cliente", "modelo", "lote")],
        *[dates.whole(F.col(f"r.{c}")).alias(c) for c in ("qtd", "comp_mm", "larg_mm", "lbase", "ltopo")],
        dates.decimal(F.col("r.esp")).alias("esp"),
    )


def cells(docs: DataFrame) -> DataFrame:
    """(sheet_id, section, row_index, field, value): every cell of a document."""
    r = docs.select("sheet_id", F.posexplode("rows").alias("row_index", "r"))
    body = r.select("sheet_id", F.lit("rows").alias("section"), "row_index", F.explode(F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*[F.col(f"r.{c}") for c in FIELDS]))).alias("field", "value"))
    names = ("operador", "n_operador", "setor_maquina", "data", "turno")
    head = docs.select("sheet_id", F.lit("header").alias("section"), F.lit(None).cast("int").alias("row_index"), F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"header.{c}") for c in names]))).alias("field", "value"))
    return body.unionByName(head)


def path_of(section: Column, row_index: Column, field: Column) -> Column:
    return F.when(section == "rows", F.concat(F.lit("rows["), row_index.cast("string"), F.lit("]."), field)).otherwise(F.concat_ws(".", section, field))


def replayed(base: DataFrame, edit: DataFrame, sources: tuple[str, ...] = ("human", "wizard")) -> DataFrame:
    """Cells (sheet_id, path, value) after the newest edit of each path by the sources that count; a path whose newest
    edit of all is another's isn't protected."""
    newest = edit.where(F.col("source").isin(*sources)).groupBy("sheet_id", "path").agg(F.max_by("new_value", "id").alias("_new"))
    out = base.join(newest, ["sheet_id", "path"], "left")
    return out.withColumn("value", F.coalesce("_new", "value")).drop("_new")


def protected(edit: DataFrame, sources: tuple[str, ...] = ("human", "wizard")) -> DataFrame:
    """Paths whose newest edit is by one of the sources."""
    return edit.groupBy("sheet_id", "field_path").agg(F.max_by("source", "id").alias("source")).where(F.col("source").isin(*sources))


def written_back(accepted: DataFrame, edit: DataFrame) -> DataFrame:
    """Accepted cells that no protected path keeps from being written."""
    return accepted.join(protected(edit).select("sheet_id", "field_path"), ["sheet_id", "field_path"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str, decided: tuple[str, ...] = ("accepted", "rejected")) -> DataFrame:
    """Proposals by key: new ones are added, old ones take the new evidence, but a human's decision stays."""
    o, n = old.select(key, F.col("status").alias("_os"), F.col("evidence").alias("_oe")), new.select(key, F.col("status").alias("_ns"), F.col("evidence").alias("_ne"))
    j = o.join(n, key, "full")
    kept = F.col("_os").isin(*decided)
    return j.select(key, F.when(kept, F.col("_os")).otherwise(F.coalesce("_ns", "_os")).alias("status"), F.coalesce("_ne", "_oe").alias("evidence"))


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of other keys: a cascade's deletion."""
    return df.join(keys.select(key), key, "left_anti")


def folded(events: DataFrame) -> DataFrame:
    """State of an event log in one pass: the last version, how often each known kind came, the active version after
    promotions and rollbacks. Unknown kinds only move the version on."""
    kind = F.col("type")
    return events.agg(
        F.max("version").alias("version"),
        F.count_if(kind == "accepted").alias("n_accepted"),
        F.count_if(kind == "rejected").alias("n_rejected"),
        F.max_by(F.when(kind.isin("promoted", "rolled_back"), F.col("payload")), F.when(kind.isin("promoted", "rolled_back"), F.col("version"))).alias("active"),
    )
