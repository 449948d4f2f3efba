"""Changes to sheets in bulk: edits with audit and revisions, rows added and taken away, validation, corrected dates.

A sheet is (sheet_id, status, revision); what is asked comes as a table, at most one batch for each sheet. Every answer
says what became of each request, so that the caller can write the sheets, their cells and the audit as tables, all from
one result; a validated sheet only takes a corrected date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUTHORITATIVE = ("human", "wizard")
#: Rows a sheet may have, the dates it may bear, and how long a reason may be.
MOST_ROWS = 100
FIRST_DATE, LAST_DATE = "2024-01-01", "2030-12-31"
LONGEST_REASON = 500


def inserted(known: DataFrame, new: DataFrame, order: str, key: str = "sheet_id") -> DataFrame:
    """known and the new documents, pending, at revision 0, with the ids after the greatest known one. order numbers the new
    ones from 1 without gaps."""
    last = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    added = new.crossJoin(F.broadcast(last))  # one row
    added = added.withColumns({key: F.col("_last") + F.col(order), "status": F.lit("pending"), "revision": F.lit(0)})
    return known.unionByName(added.select(*known.columns))


def refusal(asked: DataFrame, sheets: DataFrame) -> DataFrame:
    """asked with refused: missing, validated, or stale where an expected revision isn't the sheet's; else null."""
    s = sheets.select("sheet_id", F.col("status").alias("_status"), F.col("revision").alias("_revision"))
    stale = F.col("expected_revision").isNotNull() & (F.col("expected_revision") != F.col("_revision"))
    why = F.when(F.col("_status").isNull(), "missing").when(F.col("_status") == "validated", "validated").when(stale, "stale")
    return asked.join(s, "sheet_id", "left").withColumn("refused", why).drop("_status", "_revision")


def applied_edits(sheets: DataFrame, cells: DataFrame, asked: DataFrame) -> DataFrame:
    """The audit of batches of edits (sheet_id, expected_revision, seq, path, new_value): with what stood there before,
    the batch's own earlier edits included, and refused."""
    w = Window.partitionBy("sheet_id", "path").orderBy("seq")
    before = F.coalesce(F.lag("new_value").over(w), "_value", F.lit(""))
    checked = refusal(asked, sheets).join(cells.select("sheet_id", "path", F.col("value").alias("_value")), ["sheet_id", "path"], "left")
    return checked.withColumn("old_value", F.when(F.col("refused").isNull(), before)).drop("_value")


def cells_after(cells: DataFrame, audit: DataFrame) -> DataFrame:
    """The cells with each path's last edit."""
    last = audit.where("refused is null").groupBy("sheet_id", "path").agg(F.max_by("new_value", "seq").alias("_new"))
    return cells.join(last, ["sheet_id", "path"], "full").select("sheet_id", "path", F.coalesce("_new", "value").alias("value"))


def revised(sheets: DataFrame, audit: DataFrame) -> DataFrame:
    """The sheets; those with an applied batch are at the next revision."""
    touched = audit.where("refused is null").select("sheet_id").distinct().withColumn("_touched", F.lit(1))
    return sheets.join(touched, "sheet_id", "left").withColumn("revision", F.col("revision") + F.coalesce("_touched", F.lit(0))).drop("_touched")


def protected_after(edits: DataFrame, marks: DataFrame, sources: tuple[str, ...] = AUTHORITATIVE) -> DataFrame:
    """(sheet_id, field_path): paths with an edit of an operator after the sheet's mark (sheet_id, seq)."""
    later = edits.where(F.col("source").isin(*sources)).join(marks, "sheet_id").where(F.col("id") > F.col("seq"))
    return later.select("sheet_id", "field_path").distinct()


def marks(edits: DataFrame, sheets: DataFrame) -> DataFrame:
    """(sheet_id, seq): the id of each sheet's last edit, 0 if it has none."""
    last = edits.groupBy("sheet_id").agg(F.max("id").alias("seq"))
    return sheets.select("sheet_id").join(last, "sheet_id", "left").na.fill(0, ["seq"])


def row_added(sheets: DataFrame) -> DataFrame:
    """sheets (sheet_id, status, rows) with an empty row at the end: outcome, row_index, path and the rows after it."""
    outcome = F.when(F.col("status") == "validated", "validated").when(F.size("rows") > MOST_ROWS, "full").otherwise("added")
    s = sheets.withColumn("outcome", outcome)
    at = F.when(F.col("outcome") == "added", F.size("rows"))
    blank = F.array(F.lit(None).cast(sheets.schema["rows"].dataType.elementType))
    return s.withColumns({"row_index": at, "path": F.concat(F.lit("rows["), at.cast("string"), F.lit("]")), "rows": F.when(F.col("outcome") == "added", F.concat("rows", blank)).otherwise(F.col("rows"))})


def row_removed(sheets: DataFrame, index: str) -> DataFrame:
    """sheets (sheet_id, status, rows) without the row at an index: outcome, what was removed, the rows that stay."""
    i = F.col(index)
    outcome = F.when(F.col("status") == "validated", "validated").when((i < 0) | (i >= F.size("rows")), "out_of_range").otherwise("removed")
    s = sheets.withColumn("outcome", outcome)
    gone = F.col("outcome") == "removed"
    return s.withColumns({"removed": F.when(gone, F.get("rows", i)), "rows": F.when(gone, F.filter("rows", lambda x, at: at != i)).otherwise(F.col("rows"))})


def validated(sheets: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (sheet_id, operador) with outcome and the sheet's status and revision after it; the operator given counts
    from then on."""
    s = sheets.select("sheet_id", F.col("status").alias("_status"), F.col("revision").alias("_revision"))
    out = asked.join(s, "sheet_id", "left")
    outcome = F.when(F.col("_status").isNull(), "missing").when(F.col("_status") == "validated", "already").otherwise("validated")
    out = out.withColumn("outcome", outcome)
    done = F.col("outcome") == "validated"
    return out.select("sheet_id", "operador", "outcome", F.when(done, "validated").otherwise(F.col("_status")).alias("status"), (F.col("_revision") + done.cast("int")).alias("revision"))


def restamped(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """The rows of facts, those of sheets validated now with that status and the operator chosen."""
    done = answers.where("outcome = 'validated'").select("sheet_id", F.col("operador").alias("_operador"))
    out = facts.join(done, "sheet_id", "left")
    return out.withColumns({"status": F.when(F.col("_operador").isNotNull(), "validated").otherwise(F.col("status")), "operador": F.coalesce("_operador", "operador")}).drop("_operador")


def corrected_date(sheets: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (sheet_id, new_date, expected_revision, reason) with outcome, and where a validated sheet's date (old_date,
    day first) is corrected, the new one, the revision and the reason kept."""
    s = sheets.select("sheet_id", F.col("status").alias("_status"), F.col("revision").alias("_revision"), "old_date")
    new = F.trim(F.coalesce("new_date", F.lit("")))
    day = F.when(new.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), new.try_cast("date"))
    shown = F.date_format(day, "dd-MM-yyyy")
    reason = F.trim(F.coalesce("reason", F.lit("")))
    outcome = (
        F.when(day.isNull(), "not_a_date")
        .when((day < F.lit(FIRST_DATE).cast("date")) | (day > F.lit(LAST_DATE).cast("date")), "out_of_range")
        .when(F.length(reason) > LONGEST_REASON, "long_reason")
        .when(F.col("_status").isNull(), "missing")
        .when(F.col("_status") != "validated", "not_validated")
        .when(F.col("expected_revision") != F.col("_revision"), "stale")
        .when(F.coalesce("old_date", F.lit("")) == shown, "no_change")
        .otherwise("corrected")
    )
    out = asked.join(s, "sheet_id", "left").withColumn("outcome", outcome)
    done = F.col("outcome") == "corrected"
    return out.select("sheet_id", "outcome", F.when(done, F.col("old_date")).alias("old_date"), F.when(done, shown).alias("date"), F.when(done, F.col("_revision") + 1).alias("revision"), F.when(done & (reason != ""), reason).alias("reason"))


def aliased_values(rows: DataFrame, field: str, proposals: DataFrame) -> DataFrame:
    """rows with a field's values replaced by those of accepted aliases (from, to), equal but for case and blanks around; and
    whether they changed. Two aliases of a value: the least counts."""
    p = proposals.where("trim(`from`) != '' and trim(`to`) != ''").groupBy(F.upper(F.trim("from")).alias("_from")).agg(F.min(F.trim("to")).alias("_to"))
    out = rows.join(p, F.upper(F.trim(field)) == F.col("_from"), "left")
    return out.withColumn("changed", F.col("_to").isNotNull()).withColumn(field, F.coalesce("_to", field)).drop("_from", "_to")


def risk(kind: Column, conflict: Column, target_known: Column) -> Column:
    """Whether a proposal may be taken without a test: aliases onto a known value, examples and observed values may."""
    # fixed values: kinds of proposals
    alias = F.when(F.coalesce(target_known, F.lit(False)), "low").otherwise("behavior")
    return F.when(kind.isin("confusion_pair", "snap_rule"), "behavior").when(kind.isin("fewshot_example", "observed_value"), "low").when(kind == "case_rule", F.when(F.coalesce(conflict, F.lit(False)), "behavior").otherwise("low")).when(kind.endswith("_alias"), alias).otherwise("behavior")


def classified(proposals: DataFrame, known: DataFrame) -> DataFrame:
    """proposals (kind, to, conflict) with risk; known (kind, value): canonical values by kind of alias."""
    k = known.select(F.col("kind").alias("_kind"), F.upper(F.trim("value")).alias("_value")).distinct().withColumn("_known", F.lit(True))
    met = (F.col("kind") == F.col("_kind")) & (F.upper(F.trim("to")) == F.col("_value"))
    return proposals.join(k, met, "left").withColumn("risk", risk(F.col("kind"), F.col("conflict"), F.col("_known"))).drop("_kind", "_value", "_known")
