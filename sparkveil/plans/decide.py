"""Policies compiled to one slot expression: which operator, if any, an entity gets.

Order: reviewers' overrides, then every policy's rules, then every policy's
fallback; the first that matches and has an operator for the modality wins. Tags
and scopes are resolved to label sets here, on the driver, so that at run time a
decision is a CASE over labels, confidence and coreference.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import configuration
from .catalog import Catalog
from .policy import Attribution, ModalityRedactions, Policy, Predicate, Redaction

NOTE = "policy fallback: no rule matched this entity"


@dataclass(frozen=True)
class Slot:
    """One reachable decision."""

    policy_id: str
    labels: tuple[str, ...]  # gate: the policy's scope
    predicate: Predicate | None
    operator: Redaction
    attribution: Attribution


def rule_attribution(policy: Policy, rule) -> Attribution:
    base = rule.attribution or Attribution.freeform(policy.name, policy.description)
    return replace(base, source_id=rule.id)


def fallback_attribution(policy: Policy) -> Attribution:
    cited = {s.attribution for s in policy.scopes}
    if len(cited) == 1 and None not in cited:
        return next(iter(cited))
    return Attribution.freeform(policy.name, NOTE)


def slots(policies: Sequence[Policy], modality: str) -> list[Slot]:
    """Decisions in order; an action without an operator for the modality has none."""
    out = []
    for p in policies:
        for rule in p.rules:
            for predicate, action in rule.steps():
                if (op := getattr(action, modality)) is not None:
                    out.append(Slot(p.id, p.label_scope(), predicate, op, rule_attribution(p, rule)))
    for p in policies:
        if p.fallback is not None and (op := getattr(p.fallback, modality)) is not None:
            out.append(Slot(p.id, p.label_scope(), None, op, fallback_attribution(p)))
    return out


def _one_of(x: Column, values: Sequence[str]) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False)) if values else F.lit(False)


def labels_of(predicate: Predicate, policy: Policy | None, catalog: Catalog) -> tuple[str, ...] | None:
    """The label set that a label-only predicate stands for; None for other kinds."""
    if predicate.kind == "labelOneOf":
        return predicate.value
    if predicate.kind == "tagOneOf":
        return catalog.tagged(*predicate.value)
    if predicate.kind == "labelInScope":
        found = policy.scope_named(predicate.value) if policy else None
        if found is None:
            raise configuration(f"no scope {predicate.value!r}")
        return found
    return None


def condition(predicate: Predicate | None, entity: Column, policy: Policy | None, catalog: Catalog) -> Column:
    """A predicate over one entity, always true or false."""
    if predicate is None:
        return F.lit(True)
    labels = labels_of(predicate, policy, catalog)
    if labels is not None:
        return _one_of(entity["label"], labels)
    if predicate.kind == "confidence":
        return F.coalesce(entity["confidence"] >= F.lit(predicate.value).cast("float"), F.lit(False))
    if predicate.kind == "coRef":
        return F.coalesce(entity["coref"] == F.lit(predicate.value), F.lit(False))
    parts = [condition(p, entity, policy, catalog) for p in predicate.parts()]
    if predicate.kind == "not":
        return ~parts[0]
    out = F.lit(predicate.kind == "all")
    for p in parts:
        out = out & p if predicate.kind == "all" else out | p
    return out


def slot_number(decisions: Sequence[Slot], entity: Column, policies: Sequence[Policy], catalog: Catalog, override: Column | None = None, first: int = 0) -> Column:
    """The number of an entity's slot, null if none matches. ``override``, a slot number or null, comes first."""
    by_id = {p.id: p for p in policies}
    chain = None
    for k, s in enumerate(decisions, first):
        test = _one_of(entity["label"], s.labels) & condition(s.predicate, entity, by_id.get(s.policy_id), catalog)
        chain = F.when(test, F.lit(k)) if chain is None else chain.when(test, F.lit(k))
    found = F.lit(None).cast("int") if chain is None else chain
    return found if override is None else F.coalesce(override, found)


def attribution_column(a: Attribution) -> Column:
    return F.struct(*[F.lit(getattr(a, k)).cast("string").alias(k) for k in ("kind", "authority", "citation", "rationale", "name", "description", "source_id")])


def override_attribution(policy_id: str) -> Attribution:
    return Attribution.freeform(policy_id, "reviewer override")


@dataclass(frozen=True)
class Override:
    """A reviewer's decision about one entity, under a submitted policy."""

    entity_id: str
    policy_id: str
    action: ModalityRedactions
