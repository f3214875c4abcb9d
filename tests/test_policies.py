"""Policies, predicates, catalogue, validators and templates."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkveil.errors import CAPABILITY_UNAVAILABLE, CONFIGURATION, VeilError
from sparkveil.plans import decide, templates, validate
from sparkveil.plans.catalog import BUILTIN, builtin, compile_catalog
from sparkveil.plans.policy import AnalyzerParams, Attribution, Label, LabelEntry, ModalityRedactions, Policy, Predicate, RasterMode, Redaction, Rule, Scope, TemplateOrigin, dumps, loads, text_op

CITED = Attribution.cited("LAW", "§1", "because")
ERASE = ModalityRedactions.for_text("erase")


def policy(name="p", labels=("email_address",), rules=(), fallback=None, **more):
    return Policy(f"id-{name}", name, (Scope(f"s-{name}", tuple(labels)),), tuple(rules), fallback, **more)


def rule(predicate, action=ERASE, name="r", **more):
    return Rule(f"id-{name}", name, predicate, action, **more)


# -- wire forms ---------------------------------------------------------------


@pytest.mark.parametrize("t", templates.all_templates(), ids=lambda t: t.id)
def test_templates_round_trip(t):
    assert loads(dumps(t.policy)) == t.policy


def test_predicate_wire_forms():
    forms = [
        {"kind": "confidence", "min": 0.7},
        {"kind": "labelOneOf", "labels": ["a", "b"]},
        {"kind": "tagOneOf", "tags": ["pii"]},
        {"kind": "labelInScope", "scope": "s"},
        {"kind": "coRef", "coref": "c1"},
        {"kind": "all", "all": [{"kind": "not", "not": {"kind": "any", "any": []}}]},
    ]
    for f in forms:
        assert Predicate.from_json(f).to_json() == f
    with pytest.raises(VeilError):
        Predicate.from_json({"kind": "other"})


def test_operators_leave_out_defaults():
    assert text_op("mask").to_json() == {"kind": "mask"}
    assert text_op("truncate", keep_prefix=6, keep_suffix=4).to_json() == {"kind": "truncate", "keepPrefix": 6, "keepSuffix": 4}
    clamp = text_op("clamp", ceiling=90.0, ceiling_bucket={"format": "{n} or older"}, fallback=text_op("keep"))
    assert Redaction.from_json("text", json.loads(json.dumps(clamp.to_json()))) == clamp
    cell = Redaction.of("tabular", "cell", redaction=text_op("erase"))
    assert Redaction.from_json("tabular", cell.to_json()) == cell
    for m, kinds in {"image": ["erase", "keep", "blur", "pixelate", "blackbox"], "audio": ["erase", "keep", "silence", "beep"]}.items():
        for k in kinds:
            assert Redaction.from_json(m, Redaction.of(m, k).to_json()) == Redaction.of(m, k)


def test_shortcuts_and_empty_actions():
    assert ModalityRedactions().is_empty and not ERASE.is_empty
    assert ModalityRedactions.for_image("blur").image["sigma"] == 16.0
    assert ModalityRedactions.for_audio("beep").audio["hz"] == 1000.0
    with pytest.raises(VeilError):
        validate.strict_actions([policy(rules=[rule(Predicate.all_of(), ModalityRedactions())])])


def test_broken_json_is_an_error():
    with pytest.raises(VeilError, match="policy JSON"):
        loads("{")


# -- scopes and catalogue -----------------------------------------------------


def test_label_scope_is_an_ordered_union():
    p = Policy("i", "n", (Scope("a", ("x", "y")), Scope("b", ("y", "z"))), custom=(Label("w"), Label("x")))
    assert p.label_scope() == ("x", "y", "z", "w")
    assert p.scope_named("b") == ("y", "z") and p.scope_named("c") is None


def test_catalog_union_puts_custom_labels_first():
    a, b = policy("a"), policy("b", ["phone_number", "badge"], custom=(Label("badge", ("pii",), "identity"),))
    c = compile_catalog([a, b])
    assert list(c.labels) == ["badge", "email_address", "phone_number"] and c.custom == {"badge"}
    assert set(c.tagged("pii")) == {"badge", "email_address", "phone_number"}
    assert len(compile_catalog([])) == 0


@pytest.mark.parametrize(
    "policies, text",
    [
        ([policy(labels=["nothing_known"])], "unknown label"),
        ([policy(custom=(Label("email_address"),))], "shadows"),
        ([policy("a", custom=(Label("x"),)), policy("b", custom=(Label("x", ("pii",)),))], "conflicts"),
        ([policy("a", custom=(Label("x"),)), policy("b", labels=["x"])], "unknown label"),
    ],
)
def test_catalog_errors(policies, text):
    with pytest.raises(VeilError, match=text) as e:
        compile_catalog(policies)
    assert e.value.kind == CONFIGURATION


def test_same_custom_label_twice_is_fine():
    same = Label("x", ("pii",))
    assert list(compile_catalog([policy("a", custom=(same,)), policy("b", custom=(same,))]).labels)[0] == "x"


def test_scopes_add_no_tags():
    c = compile_catalog([policy(labels=["email_address"])])
    assert c.labels["email_address"] == BUILTIN["email_address"]
    assert c.labels["email_address"].tags == ("pii",) and c.labels["email_address"].category == "contact"


def test_origin_equality_has_the_version():
    assert TemplateOrigin("a", "1.0.0") == TemplateOrigin("a", "1.0.0") != TemplateOrigin("a", "1.1.0")
    assert TemplateOrigin("a", "1.10.0").release() > TemplateOrigin("a", "1.9.0").release()


def test_catalog_frame(spark):
    rows = {r.label: r for r in builtin().frame(spark).collect()}
    assert len(rows) == len(BUILTIN) and "pci" in rows["payment_card"].tags
    assert set(builtin().filter_tag("phi").labels) == {k for k, v in BUILTIN.items() if "phi" in v.tags}


# -- validators ---------------------------------------------------------------


def test_scope_references():
    twice = Policy("i", "n", (Scope("contact", ("email_address",)), Scope("contact", ("phone_number",))))
    with pytest.raises(VeilError, match="more than once"):
        validate.scope_references([twice])
    nested = Predicate.negate(Predicate.all_of(Predicate.any_of(Predicate.label_in_scope("contact_info"))))
    with pytest.raises(VeilError, match="contact_info"):
        validate.scope_references([policy("a", rules=[rule(nested)]), Policy("b", "b", (Scope("contact_info", ("email_address",)),))])
    validate.scope_references([policy("a", rules=[rule(Predicate.label_in_scope("s-a"))])])


def test_other_validators():
    with pytest.raises(VeilError, match="wasn't submitted"):
        validate.override_authorities(["other"], [policy()])
    with pytest.raises(VeilError, match="KeyProvider") as e:
        validate.key_provider([policy(fallback=ModalityRedactions.for_text("hmac_hash"))], False)
    assert e.value.kind == CONFIGURATION
    with pytest.raises(VeilError, match="KeyProvider"):
        validate.key_provider([policy(rules=[rule(Predicate.all_of(), ModalityRedactions.for_tabular("cell", redaction=text_op("encrypt")))])], False)
    with pytest.raises(VeilError, match="at most one"):
        validate.at_most_one("OCR", [1, 2])
    assert validate.at_most_one("OCR", []) is None
    with pytest.raises(VeilError) as e:
        validate.raster_mode(RasterMode("force", 300), False)
    assert e.value.kind == CAPABILITY_UNAVAILABLE
    with pytest.raises(VeilError, match="come together"):
        text_op("clamp", ceiling=90.0)
    with pytest.raises(VeilError, match="decline"):
        text_op("clamp", fallback=text_op("generalize_date"))
    assert AnalyzerParams().raster_mode.kind == "auto"


# -- decisions ----------------------------------------------------------------


def naive(entity, policies, modality, catalog):
    def holds(p, q):
        k, v = q.kind, q.value
        if k == "confidence":
            return entity["confidence"] >= v
        if k == "labelOneOf":
            return entity["label"] in v
        if k == "tagOneOf":
            return entity["label"] in catalog and bool(set(v) & set(catalog.labels[entity["label"]].tags))
        if k == "labelInScope":
            return entity["label"] in p.scope_named(v)
        if k == "coRef":
            return entity["coref"] == v
        if k == "not":
            return not holds(p, v)
        return (all if k == "all" else any)(holds(p, x) for x in v)

    k = 0
    for p in policies:
        for r in p.rules:
            for predicate, action in r.steps():
                if getattr(action, modality) is None:
                    continue
                if entity["label"] in p.label_scope() and holds(p, predicate):
                    return k
                k += 1
    for p in policies:
        if p.fallback is not None and getattr(p.fallback, modality) is not None:
            if entity["label"] in p.label_scope():
                return k
            k += 1
    return None


def random_predicate(rng, depth=0):
    kind = rng.choice(["confidence", "labelOneOf", "tagOneOf", "labelInScope", "coRef"] + ["all", "any", "not"] * (depth < 2))
    if kind in ("all", "any"):
        return Predicate(kind, tuple(random_predicate(rng, depth + 1) for _ in range(rng.randint(0, 2))))
    if kind == "not":
        return Predicate.negate(random_predicate(rng, depth + 1))
    labels = ["email_address", "phone_number", "payment_card", "diagnosis"]
    value = {"confidence": rng.choice([0.5, 0.75]), "labelOneOf": tuple(rng.sample(labels, rng.randint(0, 3))), "tagOneOf": tuple(rng.sample(["pii", "phi", "pci", "none"], rng.randint(0, 2))), "labelInScope": "s", "coRef": "c1"}[kind]
    return Predicate(kind, value)


def test_decisions_equal_a_plain_interpreter(spark):
    rng = random.Random(1)
    labels = ["email_address", "phone_number", "payment_card", "diagnosis", "city"]
    entities = [{"label": x, "confidence": c, "coref": r} for x in labels for c in (0.25, 0.5, 0.75, 1.0) for r in (None, "c1", "c2")]
    rows = spark.createDataFrame([(i, (e["label"], e["confidence"], e["coref"])) for i, e in enumerate(entities)], "i int, e struct<label:string,confidence:float,coref:string>")
    columns, expected = [], []
    for n in range(25):
        policies = []
        for k in range(rng.randint(1, 3)):
            rules = []
            for r in range(rng.randint(0, 3)):
                action = rng.choice([ERASE, ModalityRedactions.for_image("blur")])
                if rng.random() < 0.3:
                    rules.append(Rule(f"{k}{r}", "t", table=tuple(LabelEntry(rng.choice(labels), action) for _ in range(2))))
                else:
                    rules.append(rule(random_predicate(rng), action, f"{k}{r}"))
            policies.append(Policy(str(k), str(k), (Scope("s", tuple(rng.sample(labels, rng.randint(1, 4)))),), tuple(rules), rng.choice([None, ERASE])))
        catalog = compile_catalog(policies)
        slots = decide.slots(policies, "text")
        columns.append(decide.slot_number(slots, F.col("e"), policies, catalog).cast("int").alias(f"n{n}"))
        expected.append([naive(e, policies, "text", catalog) for e in entities])
    got = rows.select("i", *columns).orderBy("i").collect()
    for n in range(25):
        assert [r[f"n{n}"] for r in got] == expected[n]


def test_predicate_edges(spark):
    rows = spark.createDataFrame([(("email_address", 0.7, None),)], "e struct<label:string,confidence:float,coref:string>")
    p, c = policy(), compile_catalog([policy()])
    edge = {"all": Predicate.all_of(), "none": Predicate.any_of(), "labels": Predicate.label_one_of(), "ref": Predicate.coref("x"), "noref": Predicate.negate(Predicate.coref("x")), "equal": Predicate.confidence(0.7)}
    got = rows.select(*[decide.condition(q, F.col("e"), p, c).alias(k) for k, q in edge.items()]).first().asDict()
    assert got == {"all": True, "none": False, "labels": False, "ref": False, "noref": True, "equal": True}


def test_attributions():
    cited = Policy("i", "n", (Scope("a", ("email_address",), attribution=CITED),), (rule(Predicate.all_of(), attribution=CITED), rule(Predicate.all_of(), name="q")), ERASE, description="d")
    first, second, last = decide.slots([cited], "text")
    assert first.attribution.kind == "cited" and first.attribution.source_id == "id-r"
    assert second.attribution == Attribution("freeform", name="n", description="d", source_id="id-q")
    assert last.attribution == CITED
    mixed = Policy("i", "n", (Scope("a", ("email_address",), attribution=CITED), Scope("b", ("phone_number",))), fallback=ERASE)
    assert decide.slots([mixed], "text")[0].attribution == Attribution.freeform("n", decide.NOTE)
    assert decide.override_attribution("p").description == "reviewer override"


# -- templates ----------------------------------------------------------------


def test_eighteen_templates_with_distinct_stable_ids():
    found = templates.all_templates()
    assert len(found) == 18
    assert len({t.id for t in found}) == len({t.policy.id for t in found}) == 18
    assert [t.policy for t in found] == [t.policy for t in templates.all_templates()]
    for t in found:
        compile_catalog([t.policy])
        validate.scope_references([t.policy])


def test_hipaa():
    safe = templates.hipaa()
    assert len(safe.policy.label_scope()) == 34 and len(templates.hipaa(accounts="extended").policy.label_scope()) == 35
    assert "crypto_address" in templates.hipaa(accounts="extended").policy.label_scope()
    assert str(safe.effective_date) == "2003-04-14"
    ages = {e.label: e.action.text for e in safe.policy.rules[0].table}
    assert ages["age"]["ceiling"] == 90.0 and ages["age"]["ceiling_bucket"] == "90 or older" and ages["date_of_birth"].kind == "generalize_date"
    assert set(templates.SAFE_HARBOR_TABLE).isdisjoint(templates.SAFE_HARBOR)
    lds = templates.hipaa("limited_data_set").policy.label_scope()
    assert len(lds) == 29 and not {"age", "date_of_birth", "city", "postal_code"} & set(lds)
    expert = templates.hipaa("expert_determination")
    assert expert.policy.fallback.text.kind == "pseudonymize" and set(expert.policy.label_scope()) == set(safe.policy.label_scope())
    assert expert.policy.rules[0].id != safe.policy.rules[0].id
    wide = templates.hipaa(accounts="extended")
    assert wide.id == "hipaa_deid_safe_harbor_extended_accounts" and wide.policy.template.id == "hipaa_deid_safe_harbor"


def test_gdpr_widens_strictly():
    for treatment in templates.GDPR_TREATMENTS:
        a, b, c = (set(templates.gdpr(treatment, s).policy.label_scope()) for s in templates.GDPR_SCOPES)
        assert (len(a), len(b), len(c)) == (17, 25, 28) and a < b < c
        assert "nationality" not in a and "nationality" in b and "criminal_record" in c - b
        assert templates.gdpr(treatment).policy.fallback.text.kind == treatment


def test_pci_and_ccpa():
    kinds = {r: templates.pci_pan(r).policy for r in templates.PAN_RENDERS}
    assert kinds["truncate"].fallback.text["keep_prefix"] == 6 and kinds["truncate_last_four"].fallback.text["keep_prefix"] == 0
    assert kinds["hmac_sha512"].fallback.text["algorithm"] == "sha512"
    assert all(p.label_scope() == ("payment_card",) and not p.rules for p in kinds.values())
    assert kinds["truncate"].scopes[0].attribution.citation == "§3.5.1" and kinds["hmac_sha256"].scopes[0].attribution.citation == "§3.5.1.1"
    assert str(templates.pci_pan("hmac_sha256").effective_date) == "2025-03-31" and str(templates.pci_sav().effective_date) == "2022-03-31"
    assert set(templates.pci_sav().policy.label_scope()) == {"card_security_code", "card_track_data", "pin_block"}
    ccpa = templates.ccpa().policy
    assert len(ccpa.label_scope()) == 49 and not {"amount", "company_id", "department_name"} & set(ccpa.label_scope()) and not ccpa.rules


@pytest.mark.parametrize(
    "spec, id_",
    [
        ({"kind": "hipaa_deidentification", "method": "safe_harbor"}, "hipaa_deid_safe_harbor"),
        ({"kind": "gdpr_article_9", "treatment": "erase", "scope": "article_9_and_10"}, "gdpr_article_9_erase_with_article_10"),
        ({"kind": "pci_dss", "part": {"kind": "pan_render", "render": "truncate"}}, "pci_dss_pan_truncate"),
        ({"kind": "pci_dss", "part": "sav_erase"}, "pci_dss_sav_erase"),
        ({"kind": "ccpa"}, "ccpa"),
    ],
)
def test_build_from_wire_form(spec, id_):
    assert templates.build(spec).id == id_


def test_build_refuses_unknown_kinds():
    for spec in ({"kind": "x"}, {"kind": "pci_dss", "part": "y"}, {"kind": "gdpr_article_9", "treatment": "z"}):
        with pytest.raises(VeilError):
            templates.build(spec)


def test_every_scope_is_cited():
    assert all(s.attribution.kind == "cited" for t in templates.all_templates() for s in t.policy.scopes)
    assert len(list(itertools.chain(*(t.policy.scopes for t in templates.all_templates())))) == 18
