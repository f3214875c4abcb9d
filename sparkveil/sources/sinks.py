"""Audit exports: entities, provenance and reviews as tables and CSV, and the whole audit as JSON."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PROCESSING, VeilError
from ..functions.spans import unnest

#: What the payload of an event of each kind names.
PAYLOAD_KINDS = ("pattern", "model", "deduplication", "conflict", "contested")
SILENT_KINDS = ("calibration", "refinement", "redaction")


def _confidence(x: Column) -> Column:
    return F.format_string("%.3f", x.cast("double"))


def entities(audit: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per entity: part_id, modality, entity_id, label, confidence with three decimals, coref."""
    e = unnest(audit, [id_col], "entities", "e")
    return e.select(id_col, "e.part_id", "e.modality", "e.entity_id", "e.label", _confidence(F.col("e.confidence")).alias("confidence"), "e.coref")


def provenance(audit: DataFrame, id_col: str = "doc_id", at: datetime.datetime | None = None) -> DataFrame:
    """One row per event: entity_id, event_index, kind, source, confidence, timestamp, payload_id, and a hash chained to the event before."""
    stamp = F.lit(at.isoformat() if at else None).cast("string")
    known = F.when(F.col("x.kind").isin(*PAYLOAD_KINDS, *SILENT_KINDS), F.col("x.kind")).otherwise("unknown")
    e = unnest(audit, [id_col], "entities", "e")
    chained = F.aggregate(
        F.col("e.events"),
        F.array().cast("array<string>"),
        lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat_ws("|", F.coalesce(F.try_element_at(acc, F.lit(-1)), F.col("e.entity_id")), x["kind"], F.coalesce(x["source"], F.lit("")), F.coalesce(x["payload_id"], F.lit("")), F.coalesce(x["operator"], F.lit(""))), 256))),
    )
    rows = e.select(id_col, F.col("e.entity_id").alias("entity_id"), chained.alias("chain"), F.posexplode_outer("e.events").alias("event_index", "x")).where("x is not null")
    return rows.select(
        id_col,
        "entity_id",
        "event_index",
        known.alias("kind"),
        F.col("x.source").alias("source"),
        F.when(F.col("x.confidence").isNotNull(), _confidence(F.col("x.confidence"))).alias("confidence"),
        stamp.alias("timestamp"),
        F.when(F.col("x.kind").isin(*PAYLOAD_KINDS), F.col("x.payload_id")).alias("payload_id"),
        F.element_at("chain", F.col("event_index") + 1).alias("hash"),
    )


def operator_kind(action: Column, modality: Column) -> Column:
    """The operator's kind in an action's JSON, for a modality; null if it has none."""
    out = F.lit(None).cast("string")
    for m in ("text", "tabular", "image", "audio"):
        out = F.when(modality == m, F.get_json_object(action, f"$.{m}.kind")).otherwise(out)
    return out


def reviews(audit: DataFrame, overrides: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """entity_id, modality and operator of each entity whose review has an operator for its own modality."""
    e = unnest(audit, [], "entities", "e").select("e.entity_id", "e.modality")
    rows = e.join(overrides.select("entity_id", "action"), "entity_id")
    return rows.select("entity_id", "modality", operator_kind(F.col("action"), F.col("modality")).alias("operator")).where("operator is not null")


def to_json(audit: DataFrame, id_col: str = "doc_id", pretty: bool = False) -> DataFrame:
    """(id, audit): each row's entities, context and usage in one JSON text, which needs a context."""
    if "context" not in audit.columns:
        raise VeilError(PROCESSING, "the audit has no context")
    body = F.to_json(F.struct(F.col(id_col).cast("string").alias("id"), "entities", "context", "usage"), {"pretty": str(pretty).lower()})
    return audit.select(id_col, body.alias("audit"))


def from_json(rows: DataFrame, schema: DataFrame, json_col: str = "audit") -> DataFrame:
    """Audits read back with the types of ``schema`` (an audit frame); a text without context is an error that names it."""
    kinds = {f.name: f.dataType.simpleString() for f in schema.schema.fields}
    parsed = F.from_json(json_col, f"id string, entities {kinds['entities']}, context {kinds['context']}, usage {kinds['usage']}")
    checked = F.when(parsed["context"].isNull(), F.raise_error(F.lit("Processing: audit JSON lacks context"))).otherwise(parsed)
    return rows.select(checked.alias("a")).select("a.*")


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows as CSV with a header in every part, in order; an empty table still has its header."""
    try:
        ordered = rows.orderBy(*[F.col(c).asc_nulls_first() for c in order])
        ordered.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    except Exception as e:  # noqa: BLE001
        raise VeilError(PROCESSING, f"CSV export: {e}") from e


def write_entities_csv(audit: DataFrame, path: str) -> None:
    write_csv(entities(audit).select("part_id", "modality", "entity_id", "label", "confidence", "coref"), path, ["part_id", "entity_id"])


def write_provenance_csv(audit: DataFrame, path: str, at: datetime.datetime | None = None) -> None:
    rows = provenance(audit, at=at).select("entity_id", "event_index", "kind", "source", "confidence", "timestamp", "payload_id")
    write_csv(rows, path, ["entity_id", "event_index"])


def write_reviews_csv(audit: DataFrame, overrides: DataFrame, path: str) -> None:
    write_csv(reviews(audit, overrides), path, ["entity_id"])


def write_json(audit: DataFrame, path: str) -> None:
    to_json(audit).select("audit").write.mode("overwrite").text(path)


def usage(audit: DataFrame, text_col: str = "text") -> DataFrame:
    """(recognizer, documents, characters): on how many documents each model-backed recognizer ran, and on how much text."""
    used = audit.select(F.explode("usage").alias("recognizer"), F.length(text_col).alias("n"))
    return used.groupBy("recognizer").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("characters"))


def released(df: DataFrame, text_col: str = "text", redacted_col: str = "redacted") -> DataFrame:
    """What may leave: the documents' columns with the redacted text in place of the source text, without entities (they hold source values) and what else the audit added."""
    kept = [c for c in df.columns if c not in ("entities", "context", "usage", redacted_col)]
    return df.select(*[F.col(redacted_col).alias(c) if c == text_col else F.col(c) for c in kept])


def write_redacted(df: DataFrame, path: str, text_col: str = "text", redacted_col: str = "redacted") -> None:
    """Redacted documents as Parquet; no column holds the source text."""
    released(df, text_col, redacted_col).write.mode("overwrite").parquet(path)
