"""Request checks that need no data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from ..errors import CAPABILITY_UNAVAILABLE, VeilError, configuration
from .policy import MODALITIES, ModalityRedactions, Policy, Predicate, RasterMode, Redaction


def scope_references(policies: Sequence[Policy]) -> None:
    """Scope names are unique in a policy, and predicates name scopes of their own policy."""
    for p in policies:
        names = [s.name for s in p.scopes]
        for n in names:
            if names.count(n) > 1:
                raise configuration(f"policy {p.name!r} declares scope {n!r} more than once")

        def walk(q: Predicate, p: Policy = p) -> None:
            if q.kind == "labelInScope" and p.scope_named(q.value) is None:
                raise configuration(f"policy {p.name!r} has no scope {q.value!r}")
            for part in q.parts():
                walk(part)

        for rule in p.rules:
            if rule.predicate is not None:
                walk(rule.predicate)


def override_authorities(policy_ids: Iterable[str], policies: Sequence[Policy]) -> None:
    known = {p.id for p in policies}
    for i in policy_ids:
        if i not in known:
            raise configuration(f"an override names policy {i!r}, which wasn't submitted")


def _operators(policies: Sequence[Policy]) -> Iterable[tuple[Policy, Redaction]]:
    for p in policies:
        actions: list[ModalityRedactions] = [a for r in p.rules for _, a in r.steps()] + ([p.fallback] if p.fallback else [])
        for a in actions:
            for m in MODALITIES:
                if (r := getattr(a, m)) is not None:
                    yield p, r["redaction"] if r.kind == "cell" else r


def key_provider(policies: Sequence[Policy], has_keys: bool) -> None:
    for p, r in _operators(policies):
        if r.modality == "text" and r.kind in ("hmac_hash", "encrypt") and not has_keys:
            raise configuration(f"policy {p.name!r}: operator {r.kind} needs a KeyProvider, and none is wired")


def strict_actions(policies: Sequence[Policy]) -> None:
    """Optional: an action without any operator is refused instead of passing through."""
    for p in policies:
        for rule in p.rules:
            if any(a.is_empty for _, a in rule.steps()):
                raise configuration(f"policy {p.name!r}: rule {rule.name!r} has an empty action")


def at_most_one(kind: str, configured: Sequence) -> object | None:
    if len(configured) > 1:
        raise configuration(f"{len(configured)} {kind} enrichers are configured; at most one can run")
    return configured[0] if configured else None


def raster_mode(mode: RasterMode, can_render: bool) -> None:
    if mode.kind != "auto" and not can_render:
        raise VeilError(CAPABILITY_UNAVAILABLE, f"raster mode {mode.kind!r} needs a page renderer, and none is wired")
