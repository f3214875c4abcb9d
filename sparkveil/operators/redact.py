"""Redaction: decisions applied to the entities of a row, without a shuffle."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import configuration
from ..functions import crypto
from ..functions import spans as S
from ..functions.text import Match, build, needed_keys
from ..plans import decide, validate
from ..plans.catalog import Catalog
from ..plans.decide import Override, Slot
from ..plans.policy import ModalityRedactions, Policy, Redaction
from .detect import NO_ATTRIBUTION, event

#: Overrides given as a list are a literal map; more come as a table with doc_id, with no more than so many different decisions.
LITERAL_OVERRIDES = 1000


def text_operator(r: Redaction) -> Redaction | None:
    """The text operator that a slot applies to a value: a cell's own, or none for operators on rows and columns."""
    return r["redaction"] if r.kind == "cell" else r if r.modality == "text" else None


def key_columns(operators: Sequence[Redaction], provider: crypto.KeyProvider | None, run_secret: bytes) -> dict[str, bytes]:
    kinds = {(r.kind, dict(r.params).get("algorithm")) for r in operators}
    out: dict[str, bytes] = {}
    for name in sorted(needed_keys(kinds)):
        if name == "encrypt":
            out[name] = provider.key("encrypt")[:32]
        elif name.startswith("pseudonym"):
            inner, outer = crypto.pads(run_secret, "sha256")
            out |= {"pseudonym_inner": inner, "pseudonym_outer": outer}
        else:
            algorithm, side = name.split("_")
            out[name] = crypto.pads(provider.key("hmac"), algorithm)[side == "outer"]
    return out


def with_keys(df: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """``df`` beside the one row of key bytes, whose size is fixed."""
    return df.crossJoin(F.broadcast(crypto.key_table(df.sparkSession, keys))) if keys else df


def replacement(slots: Sequence[Slot], slot: Column, m: Match, strict: bool) -> Column:
    """The text that a decided entity becomes; equal operators share a branch."""
    branches: dict[tuple, list[int]] = {}
    for k, s in enumerate(slots):
        if (op := text_operator(s.operator)) is not None:
            branches.setdefault((op, s.policy_id if op.kind == "pseudonymize" else None), []).append(k)
    out = m.value
    for (op, policy), ks in branches.items():
        out = F.when(slot.isin(*ks), build(op, m, policy or "", strict)).otherwise(out)
    return out


def decided(entities: Column, slots: Sequence[Slot], policies: Sequence[Policy], catalog: Catalog, override: Column | None) -> Column:
    """array<struct<entity,slot>>. If only labels matter, one map looks the slot up."""
    by_id = {p.id: p for p in policies}
    first: dict[str, int] | None = {}
    for k, s in enumerate(slots):
        labels = s.labels if s.predicate is None else decide.labels_of(s.predicate, by_id.get(s.policy_id), catalog)
        if labels is None:
            first = None
            break
        for x in labels:
            if x in s.labels:
                first.setdefault(x, k)

    def one(e: Column) -> Column:
        given = None if override is None else override[e["entity_id"]]
        if first is not None:
            table = F.create_map(*[F.lit(x) for kv in first.items() for x in kv]) if first else F.lit(None).cast("map<string,int>")
            slot = table[e["label"]]
            slot = slot if given is None else F.coalesce(given, slot)
        else:
            slot = decide.slot_number(slots, e, policies, catalog, given)
        return F.struct(e.alias("entity"), slot.cast("int").alias("slot"))

    return F.transform(entities, one)


def clusters(text: Column, entities: Column) -> Column:
    """array<struct<start,end,slot,entity,members>> of decided entities that overlap in a chain: what they cover, the slot and entity of the strongest that has a slot, and all of them with that slot. In source order."""

    def one(island: Column) -> Column:
        ruled = F.filter(island, lambda x: x["slot"].isNotNull())
        best = F.aggregate(ruled, F.try_element_at(ruled, F.lit(1)), lambda a, x: F.when(S.by_strength(x["entity"], a["entity"]) < 0, x).otherwise(a))
        start, end = F.element_at(island, 1)["start"], F.array_max(F.transform(island, lambda x: x["end"]))
        return S.let(best, lambda b: F.struct(start.alias("start"), end.alias("end"), b["slot"].alias("slot"), b["entity"].withField("value", F.substring(text, start + 1, end - start)).alias("entity"), F.transform(island, lambda x: F.struct(x["entity"].alias("entity"), b["slot"].alias("slot"))).alias("members")))

    placed = F.transform(entities, lambda x: F.struct(x["entity"]["start"].alias("start"), x["entity"]["end"].alias("end"), x["entity"]["label"].alias("label"), x["entity"].alias("entity"), x["slot"].alias("slot")))
    in_order = F.array_sort(placed, lambda a, b: S.by_position(a["entity"], b["entity"]))
    return F.when(F.size(entities) > 0, S.let(in_order, lambda s: F.transform(S.islands(s, False), one)))


def override_slots(overrides, policies: Sequence[Policy], modality: str, at: int, id_col: str) -> tuple[list[Slot], Column | None, DataFrame | None]:
    """Slots for the reviewers' distinct decisions, numbered from ``at``, and where a row finds its own: a literal map, or a table to join by document."""
    if overrides is None:
        return [], None, None
    if isinstance(overrides, DataFrame):
        if overrides.sparkSession.conf.get("spark.checkpoint.dir", None) and not overrides.isStreaming:
            overrides = overrides.checkpoint()  # they are read twice, and often come from the audit itself
        kinds = overrides.select("policy_id", "action").distinct().limit(LITERAL_OVERRIDES + 1).collect()  # distinct decisions, not entities
        if len(kinds) > LITERAL_OVERRIDES:
            raise configuration(f"more than {LITERAL_OVERRIDES} different override decisions")
        given = sorted((r.policy_id, r.action) for r in kinds)
    else:
        if len(overrides) > LITERAL_OVERRIDES:
            raise configuration(f"more than {LITERAL_OVERRIDES} overrides come as a table with {id_col}")
        given = list(dict.fromkeys((o.policy_id, json.dumps(o.action.to_json(), sort_keys=True)) for o in overrides))
    validate.override_authorities([p for p, _ in given], policies)
    slots, number = [], {}
    for policy, action in given:
        op = getattr(ModalityRedactions.from_json(json.loads(action)), modality)
        if op is not None:
            number[policy, action] = at + len(slots)
            slots.append(Slot(policy, (), None, op, decide.override_attribution(policy)))
    if not number:
        return [], None, None
    if isinstance(overrides, DataFrame):
        known = overrides.sparkSession.createDataFrame([(p, a, k) for (p, a), k in number.items()], "policy_id string, action string, k int")
        table = overrides.join(F.broadcast(known), ["policy_id", "action"]).select(id_col, "entity_id", "k")
        table = table.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("entity_id", "k"))).alias("_overrides"))
        return slots, F.col("_overrides"), table
    pairs = {o.entity_id: number[o.policy_id, json.dumps(o.action.to_json(), sort_keys=True)] for o in reversed(overrides) if (o.policy_id, json.dumps(o.action.to_json(), sort_keys=True)) in number}
    return slots, F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), None


def redact_text(
    df: DataFrame,
    policies: Sequence[Policy],
    catalog: Catalog,
    overrides: Sequence[Override] | DataFrame | None = None,
    provider: crypto.KeyProvider | None = None,
    run_secret: bytes = b"",
    id_col: str = "doc_id",
    text_col: str = "text",
    out: str = "redacted",
    strict: bool = False,
    vault_scope: str = "document",
    clustered: bool = False,
) -> DataFrame:
    """``df`` (with entities) with the redacted text, and entities that carry a redaction event for each operator that ran.

    ``clustered`` says that entities may overlap: what overlaps in a chain is
    replaced as one by the strongest member's decision, and every member's event
    has that decision's attribution, whatever policy would have decided on it.
    """
    ruled = decide.slots(policies, "text")
    own, override, table = override_slots(overrides, policies, "text", len(ruled), id_col)
    slots = ruled + own
    columns = df.columns
    if table is not None:
        df = df.join(table, id_col, "left")
    keys = key_columns([op for s in slots if (op := text_operator(s.operator)) is not None], provider, run_secret)
    df = with_keys(df, keys)
    if not slots:
        return df.withColumn(out, F.col(text_col))
    df = df.withColumn("_decided", decided(F.col("entities"), ruled, policies, catalog, override))
    context = F.col(id_col).cast("string") if vault_scope == "document" else F.lit("")

    def with_text(x: Column) -> Column:
        e = x["entity"]
        m = Match(e["value"], e["label"], e["coref"], e["language"], F.coalesce(context, F.lit("")), F.col(crypto.KEYS) if keys else None)
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), F.coalesce(replacement(slots, x["slot"], m, strict), F.lit("")).alias("text"))

    if clustered:
        df = df.withColumn("_clusters", clusters(F.col(text_col), F.col("_decided")))
        df = df.withColumn("_decided", F.coalesce(F.flatten(F.transform("_clusters", lambda c: F.transform(c["members"], lambda m: F.struct(m["entity"].alias("entity"), m["slot"].alias("slot"), c["entity"]["entity_id"].alias("by"))))), F.array()))
        active = F.filter(F.coalesce("_clusters", F.array()), lambda x: x["slot"].isNotNull())
        active = F.transform(active, lambda c: F.struct(c["entity"].withField("start", c["start"]).withField("end", c["end"]).alias("entity"), c["slot"].alias("slot")))
    else:
        active = F.filter("_decided", lambda x: x["slot"].isNotNull())
    df = df.withColumn("_replaced", F.transform(active, with_text))
    whys = F.array(*[decide.attribution_column(s.attribution) for s in slots])
    names = F.array(*[F.lit(s.operator.kind) for s in slots])

    def stamped(x: Column) -> Column:
        e, k = x["entity"], x["slot"] + 1
        why = F.element_at(whys, k)
        why = F.when(x["slot"] >= len(ruled), why.withField("source_id", x["by"] if clustered else e["entity_id"])).otherwise(why)
        done = event(F.lit("redaction"), F.lit("anonymizer"), F.lit(None), F.lit(None).cast("string"), F.element_at(names, k), why.cast(NO_ATTRIBUTION))
        return F.when(x["slot"].isNotNull(), e.withField("events", F.concat(e["events"], F.array(done)))).otherwise(e)

    df = df.withColumns({out: S.splice(F.col(text_col), F.col("_replaced"), lambda x: x["text"]), "entities": F.transform("_decided", stamped)})
    return df.select(*[c for c in columns if c != out], out)
