"""The governance vocabulary as plain driver-side data, with its JSON forms.

Nothing here touches Spark. Policies are compiled into column expressions by
``sparkveil.plans.decide``; JSON keys are camel case, operators are tagged by
``kind`` in snake case, and defaults are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import PROCESSING, VeilError, configuration

MODALITIES = ("text", "tabular", "image", "audio")
TERMINAL = ("erase", "keep", "replace", "mask")


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


# -- attributions -------------------------------------------------------------


@dataclass(frozen=True)
class Attribution:
    """Why an operator ran: a cited provision, or free text."""

    kind: str  # cited or freeform
    authority: str | None = None
    citation: str | None = None
    rationale: str | None = None
    name: str | None = None
    description: str | None = None
    source_id: str | None = None

    @staticmethod
    def cited(authority: str, citation: str, rationale: str) -> Attribution:
        return Attribution("cited", authority=authority, citation=citation, rationale=rationale)

    @staticmethod
    def freeform(name: str, description: str | None = None) -> Attribution:
        return Attribution("freeform", name=name, description=description)

    def to_json(self) -> dict:
        return {_camel(k): v for k, v in self.__dict__.items() if v is not None}

    @staticmethod
    def from_json(d: dict | None) -> Attribution | None:
        return None if d is None else Attribution(**{k: d.get(_camel(k)) for k in Attribution.__dataclass_fields__})


# -- operators ----------------------------------------------------------------

#: Operator kinds by modality, with their parameters and defaults (None: absent).
OPERATORS: dict[str, dict[str, dict[str, Any]]] = {
    "text": {
        "erase": {},
        "keep": {},
        "mask": {"mask_char": "*", "keep_prefix": 0, "keep_suffix": 0},
        "replace": {"template": "[{label}]"},
        "hash": {"algorithm": "sha256", "salt": None},
        "fake": {"default_language": None, "seed": None, "fallback_template": "[{label}]"},
        "pseudonymize": {},
        "encrypt": {},
        "hmac_hash": {"algorithm": "sha256"},
        "truncate": {"keep_prefix": 0, "keep_suffix": 0},
        "clamp": {"ceiling": None, "ceiling_bucket": None, "floor": None, "floor_bucket": None, "fallback": None},
        "generalize_date": {"granularity": "year", "style": "iso", "fallback": None},
    },
    "tabular": {"cell": {"redaction": None}, "drop_row": {}, "drop_column": {}},
    "image": {"erase": {}, "keep": {}, "blur": {"sigma": 16.0}, "pixelate": {"block_size": 16}, "blackbox": {"color": "#000000"}},
    "audio": {"erase": {}, "keep": {}, "silence": {}, "beep": {"hz": 1000.0, "amplitude": 0.5, "waveform": "sine"}},
}


@dataclass(frozen=True)
class Redaction:
    """One operator of one modality: a kind and its parameters."""

    modality: str
    kind: str
    params: tuple[tuple[str, Any], ...] = ()

    @staticmethod
    def of(modality: str, kind: str, **params: Any) -> Redaction:
        known = OPERATORS.get(modality, {})
        if kind not in known:
            raise configuration(f"{modality} has no operator {kind!r}")
        if odd := set(params) - set(known[kind]):
            raise configuration(f"{modality} operator {kind!r} has no parameter {sorted(odd)[0]!r}")
        merged = known[kind] | params
        r = Redaction(modality, kind, tuple(sorted(merged.items(), key=lambda kv: kv[0])))
        r.check()
        return r

    def __getitem__(self, name: str) -> Any:
        return dict(self.params)[name]

    def check(self) -> None:
        if self.modality != "text":
            if self.kind == "cell" and not (isinstance(self["redaction"], Redaction) and self["redaction"].modality == "text"):
                raise configuration("cell needs a text operator")
            return
        if self.kind == "mask" and len(self["mask_char"]) != 1:
            raise configuration("mask_char is one character")
        if self.kind in ("hash", "hmac_hash") and self["algorithm"] not in ("sha256", "sha512"):
            raise configuration(f"unknown algorithm {self['algorithm']!r}")
        if self.kind == "clamp":
            for side in ("ceiling", "floor"):
                if (self[side] is None) != (self[f"{side}_bucket"] is None):
                    raise configuration(f"clamp: {side} and {side}_bucket come together")
        fallback = dict(self.params).get("fallback")
        if fallback is not None and fallback.kind not in TERMINAL:
            raise configuration(f"fallback {fallback.kind!r} could itself decline")

    def to_json(self) -> dict:
        default = OPERATORS[self.modality][self.kind]
        out: dict[str, Any] = {"kind": self.kind}
        for k, v in self.params:
            if v != default[k]:
                out[_camel(k)] = v.to_json() if isinstance(v, Redaction) else v
        return out

    @staticmethod
    def from_json(modality: str, d: dict) -> Redaction:
        kind = d.get("kind")
        known = OPERATORS.get(modality, {}).get(kind)
        if known is None:
            raise configuration(f"{modality} has no operator {kind!r}")
        params = {k: d.get(_camel(k), d.get(k)) for k in known if _camel(k) in d or k in d}
        for k in ("fallback", "redaction"):
            if isinstance(params.get(k), dict):
                params[k] = Redaction.from_json("text", params[k])
        return Redaction.of(modality, kind, **params)


def text_op(kind: str, **params: Any) -> Redaction:
    return Redaction.of("text", kind, **params)


@dataclass(frozen=True)
class ModalityRedactions:
    """At most one operator per modality; a modality without one passes through."""

    text: Redaction | None = None
    tabular: Redaction | None = None
    image: Redaction | None = None
    audio: Redaction | None = None

    @classmethod
    def for_text(cls, kind: str, **params: Any) -> ModalityRedactions:
        return cls(text=Redaction.of("text", kind, **params))

    @classmethod
    def for_tabular(cls, kind: str, **params: Any) -> ModalityRedactions:
        return cls(tabular=Redaction.of("tabular", kind, **params))

    @classmethod
    def for_image(cls, kind: str, **params: Any) -> ModalityRedactions:
        return cls(image=Redaction.of("image", kind, **params))

    @classmethod
    def for_audio(cls, kind: str, **params: Any) -> ModalityRedactions:
        return cls(audio=Redaction.of("audio", kind, **params))

    @property
    def is_empty(self) -> bool:
        return all(getattr(self, m) is None for m in MODALITIES)

    def to_json(self) -> dict:
        return {m: r.to_json() for m in MODALITIES if (r := getattr(self, m)) is not None}

    @staticmethod
    def from_json(d: dict) -> ModalityRedactions:
        return ModalityRedactions(**{m: Redaction.from_json(m, d[m]) for m in MODALITIES if d.get(m) is not None})


# -- predicates ---------------------------------------------------------------


@dataclass(frozen=True)
class Predicate:
    """A condition on one entity. Kinds: confidence, labelOneOf, tagOneOf, labelInScope, coRef, all, any, not."""

    kind: str
    value: Any

    _KEYS = {"confidence": "min", "labelOneOf": "labels", "tagOneOf": "tags", "labelInScope": "scope", "coRef": "coref", "all": "all", "any": "any", "not": "not"}

    @staticmethod
    def confidence(least: float) -> Predicate:
        return Predicate("confidence", float(least))

    @staticmethod
    def label_one_of(*labels: str) -> Predicate:
        return Predicate("labelOneOf", tuple(labels))

    @staticmethod
    def tag_one_of(*tags: str) -> Predicate:
        return Predicate("tagOneOf", tuple(tags))

    @staticmethod
    def label_in_scope(scope: str) -> Predicate:
        return Predicate("labelInScope", scope)

    @staticmethod
    def coref(coref: str) -> Predicate:
        return Predicate("coRef", coref)

    @staticmethod
    def all_of(*parts: Predicate) -> Predicate:
        return Predicate("all", tuple(parts))

    @staticmethod
    def any_of(*parts: Predicate) -> Predicate:
        return Predicate("any", tuple(parts))

    @staticmethod
    def negate(part: Predicate) -> Predicate:
        return Predicate("not", part)

    def parts(self) -> tuple[Predicate, ...]:
        return self.value if self.kind in ("all", "any") else (self.value,) if self.kind == "not" else ()

    def to_json(self) -> dict:
        v = self.value
        if self.kind in ("all", "any"):
            v = [p.to_json() for p in v]
        elif self.kind == "not":
            v = v.to_json()
        elif isinstance(v, tuple):
            v = list(v)
        return {"kind": self.kind, self._KEYS[self.kind]: v}

    @staticmethod
    def from_json(d: dict) -> Predicate:
        kind = d.get("kind")
        if kind not in Predicate._KEYS or Predicate._KEYS[kind] not in d:
            raise configuration(f"unknown predicate {d!r}")
        v = d[Predicate._KEYS[kind]]
        if kind in ("all", "any"):
            v = tuple(Predicate.from_json(p) for p in v)
        elif kind == "not":
            v = Predicate.from_json(v)
        elif isinstance(v, list):
            v = tuple(v)
        elif kind == "confidence":
            v = float(v)
        return Predicate(kind, v)


# -- rules, scopes, policies --------------------------------------------------


@dataclass(frozen=True)
class LabelEntry:
    label: str
    action: ModalityRedactions


@dataclass(frozen=True)
class Rule:
    """A predicate with an action, or a table of labels with an action each, under one identity."""

    id: str
    name: str
    predicate: Predicate | None = None
    action: ModalityRedactions | None = None
    table: tuple[LabelEntry, ...] | None = None
    description: str | None = None
    attribution: Attribution | None = None

    def steps(self) -> list[tuple[Predicate, ModalityRedactions]]:
        """The rule as predicate and action pairs in order; of a label's table entries the first wins."""
        if self.table is not None:
            return [(Predicate.label_one_of(e.label), e.action) for e in self.table]
        return [(self.predicate, self.action)]

    def to_json(self) -> dict:
        out: dict[str, Any] = {"id": self.id, "name": self.name, "description": self.description, "attribution": self.attribution and self.attribution.to_json()}
        if self.table is not None:
            out |= {"kind": "table", "operators": [{"label": e.label, "action": e.action.to_json()} for e in self.table]}
        else:
            out |= {"kind": "predicated", "predicate": self.predicate.to_json(), "action": self.action.to_json()}
        return {k: v for k, v in out.items() if v is not None}

    @staticmethod
    def from_json(d: dict) -> Rule:
        common = {"id": d["id"], "name": d["name"], "description": d.get("description"), "attribution": Attribution.from_json(d.get("attribution"))}
        if d.get("kind") == "table":
            return Rule(**common, table=tuple(LabelEntry(e["label"], ModalityRedactions.from_json(e["action"])) for e in d["operators"]))
        if d.get("kind") == "predicated":
            return Rule(**common, predicate=Predicate.from_json(d["predicate"]), action=ModalityRedactions.from_json(d["action"]))
        raise configuration(f"rule kind {d.get('kind')!r}")


@dataclass(frozen=True)
class Scope:
    name: str
    labels: tuple[str, ...]
    description: str | None = None
    attribution: Attribution | None = None

    def to_json(self) -> dict:
        out = {"name": self.name, "description": self.description, "attribution": self.attribution and self.attribution.to_json(), "labels": list(self.labels)}
        return {k: v for k, v in out.items() if v is not None}

    @staticmethod
    def from_json(d: dict) -> Scope:
        return Scope(d["name"], tuple(d.get("labels", ())), d.get("description"), Attribution.from_json(d.get("attribution")))


@dataclass(frozen=True)
class Label:
    """A label with its category, tags and names by language."""

    id: str
    tags: tuple[str, ...] = ()
    category: str | None = None
    names: tuple[tuple[str, str], ...] = ()

    def to_json(self) -> dict:
        return {"id": self.id, "tags": list(self.tags), "category": self.category, "names": dict(self.names)}

    @staticmethod
    def from_json(d: dict) -> Label:
        return Label(d["id"], tuple(d.get("tags", ())), d.get("category"), tuple(sorted(d.get("names", {}).items())))


@dataclass(frozen=True)
class TemplateOrigin:
    id: str
    version: str

    def release(self) -> tuple[int, ...]:
        return tuple(int(x) for x in self.version.split(".")[:3])


@dataclass(frozen=True)
class Policy:
    """Scopes, custom labels, ordered rules and a fallback under one identity."""

    id: str
    name: str
    scopes: tuple[Scope, ...] = ()
    rules: tuple[Rule, ...] = ()
    fallback: ModalityRedactions | None = None
    custom: tuple[Label, ...] = ()
    description: str | None = None
    template: TemplateOrigin | None = None

    def label_scope(self) -> tuple[str, ...]:
        """Every label the policy may act on, each once: its scopes' in order, then its own."""
        return tuple(dict.fromkeys([x for s in self.scopes for x in s.labels] + [c.id for c in self.custom]))

    def scope_named(self, name: str) -> tuple[str, ...] | None:
        return next((s.labels for s in self.scopes if s.name == name), None)

    def to_json(self) -> dict:
        out: dict[str, Any] = {
            "id": self.id,
            "name": self.name,
            "description": self.description,
            "template": self.template and {"id": self.template.id, "version": self.template.version},
            "scopes": [s.to_json() for s in self.scopes],
            "custom": [c.to_json() for c in self.custom],
            "rules": [r.to_json() for r in self.rules],
            "fallback": self.fallback and self.fallback.to_json(),
        }
        return {k: v for k, v in out.items() if v is not None}

    @staticmethod
    def from_json(d: dict) -> Policy:
        t = d.get("template")
        return Policy(
            d["id"],
            d["name"],
            tuple(map(Scope.from_json, d.get("scopes", ()))),
            tuple(map(Rule.from_json, d.get("rules", ()))),
            None if d.get("fallback") is None else ModalityRedactions.from_json(d["fallback"]),
            tuple(map(Label.from_json, d.get("custom", ()))),
            d.get("description"),
            t and TemplateOrigin(t["id"], t["version"]),
        )

    def with_fallback(self, action: ModalityRedactions | None) -> Policy:
        return replace(self, fallback=action)


def dumps(policies: Policy | Iterable[Policy]) -> str:
    return json.dumps(policies.to_json() if isinstance(policies, Policy) else [p.to_json() for p in policies], sort_keys=True)


def loads(text: str) -> Policy | list[Policy]:
    try:
        d = json.loads(text)
    except ValueError as e:
        raise VeilError(PROCESSING, f"policy JSON: {e}") from e
    return [Policy.from_json(x) for x in d] if isinstance(d, list) else Policy.from_json(d)


# -- requests -----------------------------------------------------------------


@dataclass(frozen=True)
class ScopeParams:
    """What the caller asserts about the documents of a request."""

    languages: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    purpose: str | None = None
    audience: tuple[str, ...] = ()


@dataclass(frozen=True)
class RasterMode:
    kind: str = "auto"  # auto, force, never
    dpi: int | None = None


@dataclass(frozen=True)
class AnalyzerParams:
    """Request parameters; annotations name an array<struct<start,end,label>> column each."""

    scope: ScopeParams = field(default_factory=ScopeParams)
    inclusions: str | None = None
    exclusions: str | None = None
    raster_mode: RasterMode = field(default_factory=RasterMode)
