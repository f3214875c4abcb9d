"""Detection: a documents frame gets one array of entities per row, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..plans.catalog import Catalog
from ..plans.policy import AnalyzerParams
from . import language
from .recognizers import ALTERNATION_TERMS, BASELINE, PATTERNS, Dictionary, Pattern, Recognizer, dictionary_spans, pattern_spans, relevant, with_automaton, with_model_spans

EVENT = "struct<kind:string,source:string,confidence:float,payload_id:string,operator:string,attribution:struct<kind:string,authority:string,citation:string,rationale:string,name:string,description:string,source_id:string>>"
ENTITY = f"struct<entity_id:string,part_id:string,modality:string,label:string,start:int,end:int,value:string,confidence:float,coref:string,language:string,pattern:string,events:array<{EVENT}>>"
ENTITIES = f"array<{ENTITY}>"
NO_ATTRIBUTION = "struct<kind:string,authority:string,citation:string,rationale:string,name:string,description:string,source_id:string>"


@dataclass(frozen=True)
class Detection:
    """What one request looks for, and how overlapping finds are settled.

    ``union`` (the default) makes one entity of what overlaps in a chain: the
    strongest's, over all that any of them covers, so nothing found stays
    readable. ``cluster`` keeps every entity; what overlaps in a chain is
    replaced as one, by the strongest's decision, which every member's event
    records. ``winner`` keeps the strongest with its own bounds only.
    """

    patterns: tuple[Pattern, ...] = PATTERNS
    dictionaries: tuple[Dictionary, ...] = ()
    recognizers: tuple[Recognizer, ...] = ()
    baseline: float = BASELINE
    span_policy: str = "union"

    def pruned(self, catalog: Catalog | None, countries: Sequence[str]) -> Detection:
        keep = None if catalog is None or not len(catalog) else catalog
        return Detection(tuple(relevant(self.patterns, catalog, countries)), tuple(d for d in self.dictionaries if keep is None or d.label in keep), self.recognizers, self.baseline, self.span_policy)


def event(kind: Column, source: Column, confidence: Column, payload: Column, operator: Column | None = None, attribution: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        kind.alias("kind"),
        source.alias("source"),
        confidence.cast("float").alias("confidence"),
        payload.alias("payload_id"),
        (null if operator is None else operator).alias("operator"),
        (F.lit(None).cast(NO_ATTRIBUTION) if attribution is None else attribution).alias("attribution"),
    )


def entity_id(*parts: Column) -> Column:
    """A UUID-shaped name from the content of an entity: equal runs give equal ids."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def as_entities(found: Column, doc: Column, part: Column, modality: str, lang: Column) -> Column:
    """Spans with identity, coreference (same label and value: same entity) and their events so far."""

    def more(happened: Column, kind: str, how: str, x: Column) -> Column:
        return F.when(happened, F.array(event(F.lit(kind), F.lit("reconcile"), x["confidence"], F.lit(how)))).otherwise(F.array().cast(f"array<{EVENT}>"))

    def one(x: Column, known: Column) -> Column:
        kind = F.when(x["source"] == "model", "model").otherwise("pattern")
        return F.struct(
            entity_id(doc, part, F.lit(modality), x["label"], x["start"], x["end"]).alias("entity_id"),
            part.alias("part_id"),
            F.lit(modality).alias("modality"),
            x["label"].alias("label"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["value"].alias("value"),
            x["confidence"].alias("confidence"),
            F.concat(F.lit("c"), F.substring(F.md5(F.concat_ws("|", x["label"], F.lower(x["value"])).cast("binary")), 1, 12)).alias("coref"),
            known.alias("language"),
            x["pattern"].alias("pattern"),
            F.concat(F.array(event(kind, x["source"], x["confidence"], x["pattern"])), more(x["merged"] > 1, "deduplication", "overlap", x), more(x["beaten"] > 0, "conflict", "confidence", x)).alias("events"),
        )

    # a text without spans is never asked for its language
    named = S.let(lang, lambda known: F.transform(found, lambda x: one(x, known)))
    return F.when(F.size(found) > 0, named).otherwise(F.array().cast(ENTITIES))


def reconcile(text: Column, found: Column, baseline: float = BASELINE, policy: str = "winner", excluded: Column | None = None) -> Column:
    """Candidates in canonical order: exclusions, one label's overlaps merged, other overlaps resolved, the weak dropped, source order."""
    if excluded is not None:
        found = S.without_excluded(found, excluded)
    found = S.merge_same_label(text, found)
    found = S.let(found, lambda x: F.array_sort(x, S.by_position)) if policy == "cluster" else S.resolve_overlaps(text, found, policy)
    return F.filter(found, lambda x: x["confidence"] >= F.lit(baseline).cast("float"))


def included(spans: Column, text: Column) -> Column:
    """Annotated regions as candidates, as sure as can be."""
    return F.coalesce(
        F.transform(spans, lambda x: S.span(x["start"], x["end"], F.substring(text, x["start"] + 1, x["end"] - x["start"]), x["label"], F.lit(1.0), F.lit("annotation"), F.lit("inclusion"))), S.empty_spans()
    )


def with_candidates(df: DataFrame, text_col: str, detection: Detection, params: AnalyzerParams, lang: Column | None, out: str = "_found", modality: str = "text") -> DataFrame:
    """``df`` with all candidate spans of ``text_col``; regular expressions come first, each in its own array, and are concatenated once."""
    text = F.col(text_col)
    if any(p.digits for p in detection.patterns):
        df = df.withColumn("_digit", text.rlike("[0-9]"))
    digit = F.col("_digit") if "_digit" in df.columns else None
    arrays = [pattern_spans(text, p, lang if p.languages else None, digit) for p in detection.patterns]
    large = [d for d in detection.dictionaries if len(d.terms) > ALTERNATION_TERMS]
    arrays += [F.coalesce(dictionary_spans(text, d), S.empty_spans()) for d in detection.dictionaries if d not in large]  # either way finds the same
    if params.inclusions:
        arrays.append(included(F.col(params.inclusions), text))
    extra = []
    if large:
        df = with_automaton(df, text_col, f"{out}_terms", large)
        extra.append(f"{out}_terms")
    for k, r in enumerate(x for x in detection.recognizers if modality in x.modalities):
        df = with_model_spans(df, text_col, f"{out}_model{k}", r.spans)
        extra.append(f"{out}_model{k}")
    arrays += [F.coalesce(F.col(c), S.empty_spans()) for c in extra]
    return df.withColumn(out, F.concat(*arrays) if arrays else S.empty_spans()).drop(*extra, "_digit")


def with_entities(df: DataFrame, detection: Detection, params: AnalyzerParams, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, out: str = "entities") -> DataFrame:
    """``df`` with an array of entities of its text, in source order and without overlaps."""
    asserted = params.scope.languages[0] if params.scope.languages else None
    lang = language.asserted_or_detected(asserted, F.col(lang_col) if lang_col else None, F.col(text_col))
    df = with_candidates(df, text_col, detection, params, lang)
    text = F.col(text_col)
    kept = reconcile(text, F.col("_found"), detection.baseline, detection.span_policy, F.col(params.exclusions) if params.exclusions else None)
    df = df.withColumn("_found", kept)
    entities = as_entities(F.col("_found"), F.col(id_col), F.lit(None).cast("string"), "text", lang)
    return df.withColumn(out, F.coalesce(entities, F.array().cast(ENTITIES))).drop("_found")
