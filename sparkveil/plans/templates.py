"""Ready policies for HIPAA, GDPR, PCI DSS and CCPA. Building one is pure and gives stable ids."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import configuration
from .policy import Attribution, LabelEntry, ModalityRedactions, Policy, Rule, Scope, TemplateOrigin

VERSION = "1.0.0"
#: Fixed value: the namespace of derived ids.
NAMESPACE = uuid.UUID("018f5a2c-0000-7000-8000-000000000000")

# Label sets, ids, names, dates and citations.
SAFE_HARBOR = """person_name address street_address city postal_code phone_number fax_number email_address government_id
national_insurance_number medical_id insurance_id certificate_number drivers_license vehicle_id license_plate device_id url
ip_address fingerprint voiceprint retina_scan facial_geometry genetic_data face internal_id case_number unresolved""".split()
SAFE_HARBOR_TABLE = ["age", "date_of_birth", "individual_date"]
LIMITED_DATA_SET = """person_name street_address address phone_number fax_number email_address government_id
national_insurance_number medical_id insurance_id certificate_number drivers_license vehicle_id license_plate device_id url
ip_address fingerprint voiceprint retina_scan facial_geometry genetic_data face internal_id case_number unresolved""".split()
ACCOUNTS = {"standard": ["bank_account", "iban", "payment_card"], "extended": ["bank_account", "iban", "payment_card", "crypto_address"]}
ARTICLE_9 = """ethnicity political_opinion religion trade_union_membership genetic_data fingerprint voiceprint retina_scan
facial_geometry medical_id insurance_id prescription_id diagnosis medication health_narrative sex_life sexual_orientation""".split()
RECITAL_26 = "date_of_birth postal_code gender age city nationality citizenship occupation".split()
ARTICLE_10 = "criminal_record criminal_charge judicial_narrative".split()
CCPA = """person_name address street_address city postal_code email_address phone_number ip_address mac_address device_id
username government_id national_insurance_number drivers_license passport_number individual_date signature handwriting
medical_id insurance_id health_narrative bank_account payment_card password security_question_answer ethnicity nationality
religion gender sexual_orientation sex_life age date_of_birth product fingerprint voiceprint retina_scan facial_geometry
genetic_data url communications_content coordinates geolocation_metadata precise_geolocation face occupation
certificate_number education_record inference""".split()
SAV = ["card_security_code", "card_track_data", "pin_block"]
POLICY_IDS = {
    "ccpa": "016806b5-bc00-7000-8000-000000000001",
    "pci_dss_pan_truncate": "01958ccd-0000-7000-8000-000000000001",
    "pci_dss_pan_hmac_sha256": "01958ccd-0000-7000-8000-000000000003",
    "pci_dss_pan_truncate_last_four": "01958ccd-0000-7000-8000-000000000005",
    "pci_dss_pan_hmac_sha512": "01958ccd-0000-7000-8000-000000000007",
    "pci_dss_sav_erase": "01958ccd-0000-7000-8000-000000000009",
}
EFFECTIVE = {"hipaa": "2003-04-14", "gdpr": "2018-05-25", "pci": "2022-03-31", "pci_keyed": "2025-03-31", "ccpa": "2020-01-01"}

HIPAA_METHODS = ("safe_harbor", "limited_data_set", "expert_determination")
GDPR_TREATMENTS = ("erase", "pseudonymize")
GDPR_SCOPES = ("article_9", "article_9_with_reid_hardening", "article_9_and_10")
PAN_RENDERS = ("truncate", "truncate_last_four", "hmac_sha256", "hmac_sha512")


@dataclass(frozen=True)
class Template:
    id: str
    name: str
    effective_date: datetime.date
    description: str
    policy: Policy
    version: str = VERSION


def derived_id(name: str) -> str:
    return str(uuid.uuid5(NAMESPACE, name))


def _template(id_: str, origin: str, name: str, effective: str, description: str, policy_id: str, policy_name: str, scope: Scope, fallback: ModalityRedactions, rules: tuple[Rule, ...] = ()) -> Template:
    policy = Policy(policy_id, policy_name, (scope,), rules, fallback, (), description, TemplateOrigin(origin, VERSION))
    return Template(id_, name, datetime.date.fromisoformat(EFFECTIVE[effective]), description, policy)


def _ages_and_dates(id_: str, name: str, cited: Attribution) -> Rule:
    year = ModalityRedactions.for_text("generalize_date")
    table = (LabelEntry("age", ModalityRedactions.for_text("clamp", ceiling=90.0, ceiling_bucket="90 or older")), LabelEntry("date_of_birth", year), LabelEntry("individual_date", year))
    return Rule(derived_id(f"{id_}:rule:age-and-dates"), name, table=table, attribution=cited, description="Ages from 90 on share one bucket and dates keep their year.")


def hipaa(method: str = "safe_harbor", accounts: str = "standard") -> Template:
    if method not in HIPAA_METHODS or accounts not in ACCOUNTS:
        raise configuration(f"no HIPAA template {method!r} with accounts {accounts!r}")
    origin = f"hipaa_deid_{method}"
    id_ = origin + ("_extended_accounts" if accounts == "extended" else "")
    policy_id, more = derived_id(f"{id_}:policy"), tuple(ACCOUNTS[accounts])
    if method == "limited_data_set":
        scope = Scope("hipaa_limited_data_set", (*LIMITED_DATA_SET, *more), "Direct identifiers that a limited data set leaves out.", Attribution.cited("HIPAA", "§164.514(e)(2)", "a limited data set leaves out these direct identifiers"))
        return _template(id_, origin, "HIPAA §164.514(e)(2) Limited Data Set", "hipaa", "Erases direct identifiers and keeps dates, ages, towns and ZIP codes; needs a data use agreement.", policy_id, "hipaa-limited-data-set", scope, ModalityRedactions.for_text("erase"))
    labels = (*SAFE_HARBOR, *more, *SAFE_HARBOR_TABLE)
    if method == "safe_harbor":
        scope = Scope("hipaa_safe_harbor", labels, "Identifiers of the safe harbor list.", Attribution.cited("HIPAA", "§164.514(b)(2)", "the safe harbor list of identifiers to remove"))
        rule = _ages_and_dates(id_, "hipaa-age-and-dates", Attribution.cited("HIPAA", "§164.514(b)(2)(i)(C)", "only the year of a date stays, and ages over 89 are one category"))
        return _template(id_, origin, "HIPAA §164.514(b)(2) Safe Harbor", "hipaa", "Removes the identifiers of the safe harbor list.", policy_id, "hipaa-safe-harbor", scope, ModalityRedactions.for_text("erase"), (rule,))
    scope = Scope("hipaa_expert_determination", labels, "The safe harbor identifiers as a start for an expert's analysis.", Attribution.cited("HIPAA", "§164.514(b)(1)", "a starting scope; the expert decides about the final one"))
    rule = _ages_and_dates(id_, "hipaa-ed-age-and-dates", Attribution.cited("HIPAA", "§164.514(b)(1)", "defaults for ages and dates until the expert's analysis"))
    return _template(id_, origin, "HIPAA §164.514(b)(1) Expert Determination (scaffold)", "hipaa", "A scaffold that pseudonymizes; it certifies nothing without an expert's documented analysis.", policy_id, "hipaa-expert-determination", scope, ModalityRedactions.for_text("pseudonymize"), (rule,))


def gdpr(treatment: str = "erase", scope: str = "article_9") -> Template:
    if treatment not in GDPR_TREATMENTS or scope not in GDPR_SCOPES:
        raise configuration(f"no GDPR template {treatment!r} over {scope!r}")
    origin = f"gdpr_article_9_{treatment}"
    id_ = origin + {"article_9": "", "article_9_with_reid_hardening": "_reid_hardened", "article_9_and_10": "_with_article_10"}[scope]
    labels = (*ARTICLE_9, *(RECITAL_26 if scope != "article_9" else ()), *(ARTICLE_10 if scope == "article_9_and_10" else ()))
    group = Scope(origin, labels, "Special categories of personal data, and what the chosen width adds.", Attribution.cited("GDPR", "Article 9(1)", "special categories whose processing needs an exception"))
    return _template(id_, origin, f"GDPR Article 9 special categories: {treatment}", "gdpr", f"Applies {treatment} to the special categories of personal data.", derived_id(f"{id_}:policy"), f"gdpr-article-9-{treatment}", group, ModalityRedactions.for_text(treatment))


def pci_pan(render: str = "truncate") -> Template:
    actions = {
        "truncate": (ModalityRedactions.for_text("truncate", keep_prefix=6, keep_suffix=4), "PCI DSS §3.5.1 PAN: truncate"),
        "truncate_last_four": (ModalityRedactions.for_text("truncate", keep_suffix=4), "PCI DSS §3.5.1 PAN: truncate to last four"),
        "hmac_sha256": (ModalityRedactions.for_text("hmac_hash", algorithm="sha256"), "PCI DSS §3.5.1 PAN: HMAC-SHA-256"),
        "hmac_sha512": (ModalityRedactions.for_text("hmac_hash", algorithm="sha512"), "PCI DSS §3.5.1 PAN: HMAC-SHA-512"),
    }
    if render not in actions:
        raise configuration(f"no PAN template {render!r}")
    keyed, id_ = render.startswith("hmac"), f"pci_dss_pan_{render}"
    cited = Attribution.cited("PCI DSS", "§3.5.1.1", "a hash of a stored PAN is keyed and covers all of it") if keyed else Attribution.cited("PCI DSS", "§3.5.1", "truncation makes a stored PAN unreadable")
    action, name = actions[render]
    return _template(id_, id_, name, "pci_keyed" if keyed else "pci", "Makes stored primary account numbers unreadable.", POLICY_IDS[id_], id_.replace("_", "-"), Scope(f"pci_pan_{render}", ("payment_card",), "Stored Primary Account Numbers.", cited), action)


def pci_sav() -> Template:
    scope = Scope("pci_sav", tuple(SAV), "Security codes, track data and PIN blocks.", Attribution.cited("PCI DSS", "§3.3.1", "authentication data isn't kept after authorization"))
    return _template("pci_dss_sav_erase", "pci_dss_sav_erase", "PCI DSS §3.3.1 SAV: erase", "pci", "Erases sensitive authentication data.", POLICY_IDS["pci_dss_sav_erase"], "pci-dss-sav-erase", scope, ModalityRedactions.for_text("erase"))


def ccpa() -> Template:
    scope = Scope("ccpa_personal_information", tuple(CCPA), "The enumerated categories of personal information.", Attribution.cited("CCPA", "Cal. Civ. Code §1798.140(v)(1)", "information that can be linked with a consumer or household"))
    return _template("ccpa", "ccpa", "CCPA / CPRA personal information", "ccpa", "Erases every enumerated category of personal information.", POLICY_IDS["ccpa"], "ccpa-personal-information", scope, ModalityRedactions.for_text("erase"))


def build(spec: dict) -> Template:
    """A template from its wire form: ``kind`` hipaa_deidentification, gdpr_article_9, pci_dss or ccpa, with its options."""
    kind = spec.get("kind")
    if kind == "hipaa_deidentification":
        return hipaa(spec["method"], spec.get("accounts", "standard"))
    if kind == "gdpr_article_9":
        return gdpr(spec["treatment"], spec.get("scope", "article_9"))
    if kind == "pci_dss":
        part = spec["part"]
        name = part if isinstance(part, str) else part.get("kind")
        if name == "sav_erase":
            return pci_sav()
        if name == "pan_render":
            return pci_pan(spec["render"] if isinstance(part, str) else part["render"])
        raise configuration(f"no PCI DSS part {name!r}")
    if kind == "ccpa":
        return ccpa()
    raise configuration(f"no template {kind!r}")


def all_templates() -> list[Template]:
    """All eighteen configurations."""
    return (
        [hipaa(m, a) for m in HIPAA_METHODS for a in ACCOUNTS]
        + [gdpr(t, s) for t in GDPR_TREATMENTS for s in GDPR_SCOPES]
        + [pci_pan(r) for r in PAN_RENDERS]
        + [pci_sav(), ccpa()]
    )


def frame(spark: SparkSession) -> DataFrame:
    """(template_id, name, version, effective_date, n_rules, n_labels, fallback) of every template."""
    rows = [(t.id, t.name, t.version, t.effective_date, len(t.policy.rules), len(t.policy.label_scope()), t.policy.fallback.text.kind) for t in all_templates()]
    return spark.createDataFrame(rows, "template_id string, name string, version string, effective_date date, n_rules int, n_labels int, fallback string")
