"""Tables: entities in cells, and operators on cells, rows and columns.

Cells are worked on column by column in one projection, so a table isn't
turned into rows of cells and back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions import spans as S
from ..functions.text import Match
from ..plans import decide, validate
from ..plans.catalog import compile_catalog
from ..plans.policy import AnalyzerParams, Policy
from .detect import ENTITIES, Detection, as_entities, reconcile, with_candidates
from .redact import decided, key_columns, replacement, text_operator, with_keys


def with_cell_entities(df: DataFrame, columns: Sequence[str], detection: Detection, row_id: Column) -> DataFrame:
    """``df`` with an array of entities for each of ``columns``, named _cell_<column>; a cell's part is row:column."""
    params = AnalyzerParams()
    for c in columns:
        df = with_candidates(df, c, detection, params, None, "_found", "tabular")
        found = reconcile(F.col(c), F.col("_found"), detection.baseline, detection.span_policy)
        part = F.concat_ws(":", row_id.cast("string"), F.lit(c))
        df = df.withColumn(f"_cell_{c}", F.coalesce(as_entities(found, row_id.cast("string"), part, "tabular", F.lit(None).cast("string")), F.array().cast(ENTITIES))).drop("_found")
    return df


def redact_table(df: DataFrame, policies: Sequence[Policy], row_id: str, columns: Sequence[str] | None = None, detection: Detection = Detection(), provider: crypto.KeyProvider | None = None, run_secret: bytes = b"", drop_columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` under the policies' tabular operators.

    A cell operator rewrites the match in its cell, drop_row removes rows with a
    match, and drop_column removes columns with a match anywhere: one aggregate
    finds them, unless ``drop_columns`` says which they are (as on a stream).
    """
    validate.scope_references(policies)
    validate.key_provider(policies, provider is not None)
    catalog = compile_catalog(policies)
    names = list(columns) if columns is not None else [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name != row_id]
    slots = decide.slots(policies, "tabular")
    original = df.columns
    keys = key_columns([op for s in slots if (op := text_operator(s.operator)) is not None], provider, run_secret)
    df = with_keys(with_cell_entities(df, names, detection.pruned(catalog, ()), F.col(row_id)), keys)
    of = lambda kind: [k for k, s in enumerate(slots) if s.operator.kind == kind]
    for c in names:
        df = df.withColumn(f"_cell_{c}", decided(F.col(f"_cell_{c}"), slots, policies, catalog, None))
    has = lambda c, ks: F.exists(f"_cell_{c}", lambda x: F.coalesce(x["slot"].isin(*ks), F.lit(False))) if ks else F.lit(False)
    gone: list[str] = list(drop_columns or ())
    if drop_columns is None and of("drop_column") and names:
        found = df.agg(*[F.bool_or(has(c, of("drop_column"))).alias(c) for c in names]).first()
        gone = [c for c in names if found[c]]
    if of("drop_row") and names:
        df = df.where(~reduce(lambda a, b: a | b, [has(c, of("drop_row")) for c in names]))
    out = {}
    for c in names:

        def with_text(x: Column) -> Column:
            e = x["entity"]
            m = Match(e["value"], e["label"], e["coref"], e["language"], F.col(row_id).cast("string"), F.col(crypto.KEYS) if keys else None)
            return F.struct(e["start"].alias("start"), e["end"].alias("end"), replacement(slots, x["slot"], m, False).alias("text"))

        active = F.transform(F.filter(f"_cell_{c}", lambda x: F.coalesce(x["slot"].isin(*of("cell")), F.lit(False)) if of("cell") else F.lit(False)), with_text)
        out[c] = F.when(F.col(c).isNotNull(), S.splice(F.col(c), active, lambda x: x["text"]))
    return df.select(*[(out[c].alias(c) if c in out else F.col(c)) for c in original if c not in gone])


def cell_entities(df: DataFrame, row_id: str, columns: Sequence[str], detection: Detection = Detection()) -> DataFrame:
    """One row per entity in a cell: row id, column, label, start, end, value, confidence."""
    found = with_cell_entities(df, columns, detection, F.col(row_id))

    def named(c: str) -> Column:
        return F.transform(f"_cell_{c}", lambda e: F.struct(F.lit(c).alias("column"), e.alias("e")))

    parts = F.concat(*[named(c) for c in columns])
    return S.unnest(found, [row_id], parts, "x").select(row_id, "x.column", "x.e.label", "x.e.start", "x.e.end", "x.e.value", "x.e.confidence")
