"""Looking things up and listing them: documents, labels, queues, overlays, examples, uploads, what the references hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document(docs: DataFrame, key: str, value: object, column: str, schema: str) -> DataFrame:
    """The document with a key, its JSON read; nothing if there is none."""
    return docs.where(F.col(key) == value).withColumn(column, F.from_json(column, schema))


def listed_documents(docs: DataFrame, paths: dict[str, list[str]], column: str, *order: Column, status: str | None = None, limit: int = 100) -> DataFrame:
    """The newest documents of a status (None: any), with parts of their JSON: of each name the first path that is there."""
    if status is not None:
        docs = docs.where(F.col("status") == status)
    first = {name: F.coalesce(*[F.get_json_object(column, p) for p in of]) for name, of in paths.items()}
    return docs.orderBy(*order).limit(limit).withColumns(first).drop(column)


def labels(docs: DataFrame, label: str, status: str = "status", among: tuple[str, ...] = ("extracted", "validated")) -> DataFrame:
    """The distinct labels of documents that have been read, trimmed, in order."""
    return docs.where(F.col(status).isin(*among) & (F.trim(label) != "")).select(F.trim(label).alias(label)).distinct().orderBy(label)


def untriaged(docs: DataFrame, scored: str, triaged: str, key: str = "sheet_id", limit: int = 500) -> DataFrame:
    """Documents with a second opinion that nobody has looked at, the newest first."""
    return docs.where(F.col(scored).isNotNull() & F.col(triaged).isNull()).orderBy(F.desc(key)).limit(limit)


def overlays(table: DataFrame, template: str | None = None) -> DataFrame:
    """The active overlays, of a template or all, as they were promoted."""
    active = table.where("active")
    return (active.where(F.col("template") == template) if template else active).orderBy("promoted_at", "id")


def in_use(docs: DataFrame, template: str, by: str = "template") -> DataFrame:
    """How many documents a template has; with any it can't be deleted, only switched off."""
    return docs.where(F.col(by) == template).agg(F.count("*").alias("n")).withColumn("deletable", F.col("n") == 0)


def examples(lists: DataFrame, docs: DataFrame, most: int = 3) -> DataFrame:
    """(template, place, ...): the documents behind the first few ids listed for each template; ids without a document give none."""
    asked = lists.select("template", F.posexplode(F.slice("ids", 1, most)).alias("place", "sheet_id"))
    return asked.join(docs, "sheet_id")


def uploads(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def recent_edits(edits: DataFrame, now: str, days: int = 7, source: str = "human", limit: int = 100) -> DataFrame:
    """The newest edits of the last days (1 to 90) by a source, or by all."""
    since = F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(max(1, min(days, 90))))
    found = edits.where(F.col("edited_at") >= since)
    return (found if source == "all" else found.where(F.col("source") == source)).orderBy(F.desc("edited_at"), F.desc("id")).limit(limit)


def references(plan: DataFrame, stock: DataFrame) -> DataFrame:
    """How much the references hold, in one row."""
    p = plan.agg(F.count("*").alias("n_plan_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in ("of", "ov", "cliente", "modelo")])
    return p.crossJoin(F.broadcast(stock.agg(F.count_distinct("lote").alias("n_lote"))))  # one row each


def proposed(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Proposals (kind, payload, reason) with accepted: of a known kind, with a payload that is a JSON object and a reason;
    those that are go to quarantine, and why the others don't."""
    shape = F.trim(F.coalesce("payload", F.lit("")))
    whole = shape.startswith("{") & F.get_json_object(shape, "$").isNotNull()
    why = F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "unknown kind").when(~F.coalesce(whole, F.lit(False)), "no payload").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason")
    return rows.withColumn("refused", why).withColumn("status", F.when(F.col("refused").isNull(), "quarantine"))


def normalised(lexicon: DataFrame, key: str, value: str) -> DataFrame:
    """A lexicon's entries in upper case, trimmed; keys that begin with _ are notes, and of keys that fall together the least
    value counts."""
    k, v = F.upper(F.trim(key)), F.upper(F.trim(value))
    return lexicon.where(~F.col(key).startswith("_") & (k != "") & (v != "")).groupBy(k.alias(key)).agg(F.min(v).alias(value))


def current_results(results: DataFrame, index: DataFrame, engine: str, stale: bool = False) -> DataFrame:
    """The results that the index names, of the engine in use, or with stale all of them, marked."""
    out = results.join(index.select("sheet_id", "file"), ["sheet_id", "file"], "left_semi").withColumn("stale", F.col("engine_version") != engine)
    return out if stale else out.where("not stale")
