"""Work orders: consumption, remaining quantities, roll-ups by sales order and client; weights; stops and areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .ordered import waterfall

#: Fixed value: steel, in kilograms for a square millimetre a millimetre thick, per millimetre of length.
DENSITY = 7.85e-6


def consumption(fact: DataFrame, cutoff: str, keys: list[str]) -> DataFrame:
    """Pieces of validated rows from the cutoff on. The row's own date counts, so late rows fall out by it."""
    used = fact.where((F.col("status") == "validated") & (F.col("iso_date") >= F.lit(cutoff).cast("date")))
    return used.groupBy(*keys).agg(F.sum("qtd").alias("used"), F.max("iso_date").alias("last_used"))


def remaining(plan: DataFrame, used: DataFrame, keys: list[str], order: str = "plan_ord") -> DataFrame:
    """The plan with what remains of each line after what was used is handed down its siblings."""
    pool = used.select(*keys, F.col("used").cast("double").alias("pool"))
    return waterfall(plan.join(pool, keys, "left").withColumn("pool", F.coalesce("pool", F.lit(0.0))), keys, order)


def order_status(lines: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Of each sales order: planned, produced, what remains (lines that can't be tracked don't count), open and closed
    lines, the share done, and its first few models."""
    done = F.when(F.col("planned") > 0, F.round(100 * F.least(F.col("produced"), F.col("planned")) / F.col("planned"), 6))
    out = lines.groupBy(key).agg(
        F.coalesce(F.sum("quanttrp"), F.lit(0.0)).alias("planned"),
        F.coalesce(F.sum("produced"), F.lit(0.0)).alias("produced"),
        F.sum(F.greatest(F.col("remaining"), F.lit(0.0))).alias("remaining"),
        F.count_if(F.col("closed")).alias("n_closed"),
        F.count_if(~F.col("closed")).alias("n_open"),
        F.concat_ws(",", F.slice(F.array_sort(F.collect_set("modelo")), 1, most)).alias("models"),
    )
    return out.withColumn("pct", done)


def order_detail(status: DataFrame, key: str, value: object) -> DataFrame:
    """One order's status; nothing if there is no such order."""
    return status.where(F.col(key) == value)


def client_status(orders: DataFrame, key: str) -> DataFrame:
    return orders.groupBy(key).agg(F.count("*").alias("n_orders"), F.sum("planned").alias("planned"), F.sum("produced").alias("produced"), F.sum("remaining").alias("remaining"), F.sum("n_open").alias("n_open"))


def by_remaining(status: DataFrame, name: str) -> DataFrame:
    """What can't be tracked comes last, then by name."""
    return status.orderBy(F.col("remaining").desc_nulls_last(), name)


def recent_orders(fact: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Orders with rows in the days before a day, that day excluded."""
    d = F.lit(as_of).cast("date")
    return fact.where((F.col("iso_date") >= F.date_sub(d, days)) & (F.col("iso_date") < d)).select("of").distinct()


def phase_incomplete(phases: str, planned: str) -> Column:
    """Whether some phase's quantity isn't the planned one."""
    return F.exists(phases, lambda p: p["qty"] != F.col(planned))


def produced_in(phases: str, phase: str | None = None) -> Column:
    """A phase's quantity, or the last one's that has any, not below 0."""
    of = F.filter(phases, (lambda p: p["phase"] == phase) if phase else (lambda p: p["qty"].isNotNull()))
    return F.greatest(F.get(of, F.size(of) - 1)["qty"], F.lit(0.0))


def closed(written: Column) -> Column:
    t = F.lower(F.trim(written))
    return F.when(t.isin("s", "sim", "x", "1", "true", "fechado"), True).when(t.isin("n", "nao", "não", "0", "false", "aberto"), False)


# -- weights -----------------------------------------------------------------------------------------------------


def slices_of(width: Column, base: Column, top: Column, length: Column | None = None, wanted: Column | None = None) -> Column:
    """How many pieces a slice of a coil gives: as many bases and tops as lie side by side in its width; 0 if not one base
    does. A slice over 100 longer than wanted gives two of a piece that fits once."""
    times = lambda b, t: width > base * b + top * t
    longer = F.coalesce(length - wanted > 100, F.lit(False)) if length is not None and wanted is not None else F.lit(False)
    known = (F.coalesce(width, F.lit(0.0)) > 0) & (F.coalesce(base, F.lit(0.0)) != 0) & (F.coalesce(top, F.lit(0.0)) != 0)
    ladder = F.when(~known, 0)
    for n, b, t in ((6, 3, 3), (5, 3, 2), (4, 2, 2), (3, 2, 1), (2, 1, 1)):
        ladder = ladder.when(times(b, t), n)
    return ladder.when((width > base) & longer, 2).when(width > base, 1).otherwise(0).cast("int")


def trapezoid(base: Column, top: Column, height: Column) -> Column:
    return (base + top) / 2 * height


def piece_weight(count: Column, base: Column, top: Column, length: Column, thickness: Column) -> Column:
    """Kilograms of so many pieces of a trapezoid's shape; 0 where a measure is missing, not positive or implausible."""
    fine = (count > 0) & (base > 0) & (top > 0) & (length > 0) & (thickness >= 0.5) & (thickness <= 30) & (length <= 20_000) & (base <= 2000) & (top <= 2000)
    return F.when(F.coalesce(fine, F.lit(False)), count * (trapezoid(base, top, length) * thickness * DENSITY)).otherwise(0.0)


def first_positive(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c > 0, c) for c in columns])


def direct_consumption(template: Column, sector: Column, phase: Column, label: str = "bobine_formato", phases: tuple[str, ...] = ("Bobine Formato",)) -> Column:
    """Whether what a row used up and wasted can be told: by its template, or by a sector of such a phase whose own name says
    so, which a label that only fell back to it doesn't."""
    named = text.compact(sector)
    return F.coalesce((F.trim(template) == label) | ((F.trim(sector) != "") & phase.isin(*phases) & (F.contains(named, F.lit("BOB")) | F.contains(named, F.lit("FORMATO")))), F.lit(False))


def row_weights(rows: DataFrame) -> DataFrame:
    """rows with n_slices, consumed_kg, produced_kg, wasted_kg, wasted_pct, produced_source and consumption_source.

    rows: qtd, comp, lbase, ltopo, esp, larg as written; plan_comp, plan_lbase, plan_ltopo, plan_esp, plan_unit_kg,
    plan_pieces, in_plan of the plan's entry; lot_esp, lot_larg, in_lot of the coil's; direct; human, the fields written by
    hand (array), which go before plan and lot; without it these go before the sheet.
    """
    refs = {"comp": ["plan_comp"], "lbase": ["plan_lbase"], "ltopo": ["plan_ltopo"], "esp": ["lot_esp", "plan_esp"], "larg": ["lot_larg"]}
    named = {"comp": "comp_mm", "larg": "larg_mm"}
    chosen = {f: F.when(F.array_contains("human", named.get(f, f)), first_positive(F.col(f), *map(F.col, r))).otherwise(first_positive(*map(F.col, r), F.col(f))) for f, r in refs.items()}
    out = rows.withColumns({f"_{f}": c for f, c in chosen.items()})
    comp, lbase, ltopo, esp, larg = (F.col(f"_{f}") for f in ("comp", "lbase", "ltopo", "esp", "larg"))
    made = F.coalesce(F.col("qtd") > 0, F.lit(False))
    geometry = piece_weight(F.col("qtd"), lbase, ltopo, comp, esp)
    by_plan = F.col("qtd") * F.col("plan_unit_kg")
    source = F.when(made & F.col("direct") & (geometry > 0), "geometry").when(made & (F.col("plan_unit_kg") > 0), "plan").when(made & (geometry > 0), "geometry")
    pieces = F.coalesce(F.when(F.col("plan_pieces") >= 1, F.floor("plan_pieces").cast("int")), F.nullif(slices_of(larg, lbase, ltopo, comp, comp), F.lit(0)))
    can = F.coalesce(made & F.col("direct") & (comp > 0) & (comp <= 20_000) & larg.between(200, 3000) & esp.between(0.5, 30) & (pieces > 0), F.lit(False))
    out = out.withColumns({"produced_source": source, "n_slices": F.when(can, F.ceil(F.col("qtd") / pieces).cast("int"))})
    out = out.withColumns({"produced_kg": F.when(F.col("produced_source") == "geometry", geometry).when(F.col("produced_source") == "plan", by_plan), "consumed_kg": F.col("n_slices") * larg * comp * esp * DENSITY})
    out = out.withColumn("wasted_kg", F.greatest(F.lit(0.0), F.when(F.col("consumed_kg").isNotNull() & F.col("produced_kg").isNotNull(), F.col("consumed_kg") - F.col("produced_kg")))).withColumn("wasted_kg", F.when(F.col("produced_kg").isNotNull() & F.col("consumed_kg").isNotNull(), F.col("wasted_kg")))
    found = F.coalesce(F.col("in_plan"), F.lit(False)) | F.coalesce(F.col("in_lot"), F.lit(False))
    return out.withColumns({"wasted_pct": F.col("wasted_kg") / F.col("consumed_kg") * 100, "consumption_source": F.when(can, F.when(found, "plan_lot").otherwise("sheet"))}).drop(*[f"_{f}" for f in refs])


# -- stops and areas ---------------------------------------------------------------------------------------------


def downtime(stops: DataFrame) -> dict[str, DataFrame]:
    """stops (operador, motivo, resolvido, iso_date, minutes): minutes by operator, state and day; by reason, how many."""
    total = lambda key: stops.groupBy(key).agg(F.coalesce(F.sum("minutes"), F.lit(0)).alias("minutes"), F.count("*").alias("n"))
    return {"operador": total("operador"), "resolvido": total("resolvido"), "iso_date": total("iso_date"), "motivo": stops.groupBy("motivo").agg(F.count("*").alias("n"))}


def area(sheet: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Square metres and rows by a key of the sheets; sheets without rows count among the sheets."""
    by_sheet = rows.groupBy("sheet_id").agg(F.sum("m2").alias("m2"), F.count("*").alias("n_rows"))
    return sheet.join(by_sheet, "sheet_id", "left").groupBy(key).agg(F.count("*").alias("n_sheets"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.round(F.coalesce(F.sum("m2"), F.lit(0.0)), 6).alias("m2"))


def within_tolerance(rows: DataFrame, checks: dict[str, tuple[str, float]]) -> DataFrame:
    """rows with notes on each column that is off its reference by more than a tolerance, and a status."""
    notes = F.array_compact(F.array(*[F.when(F.abs(F.col(c) - F.col(ref)) > tolerance, F.lit(c)) for c, (ref, tolerance) in checks.items()]))
    unknown = F.forall(F.array(*[F.col(ref).isNull() for ref, _ in checks.values()]), lambda x: x)
    return rows.withColumn("notes", F.concat_ws(",", notes)).withColumn("status", F.when(unknown, "no_reference").when(F.size(notes) > 0, "differs").otherwise("fits"))


def consolidated(statuses: list[Column], order: tuple[str, ...]) -> Column:
    """The first status of an order that any of the columns has."""
    held = F.array(*statuses)
    return F.coalesce(*[F.when(F.array_contains(held, s), F.lit(s)) for s in order])


def margin(ranked: DataFrame, key: str, group: str, score: str) -> DataFrame:
    """Of each key the winner, its score, and how far the best of another group is behind."""
    w = Window.partitionBy(key).orderBy(F.desc(score), group)
    r = ranked.withColumns({"_place": F.row_number().over(w), "_winner": F.first(group).over(w)})
    return r.groupBy(key).agg(F.max(F.when(F.col("_place") == 1, F.col(group))).alias("winner"), F.max(score).alias("score"), F.max(F.when(F.col(group) != F.col("_winner"), F.col(score))).alias("rival")).withColumn("margin", F.col("score") - F.col("rival"))
