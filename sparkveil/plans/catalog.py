"""The label catalogue: builtin labels, and the union a set of policies works with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..errors import configuration
from .policy import Label, Policy

#: The builtin label ids, by category.
BUILTIN_BY_CATEGORY: dict[str, str] = {
    "contact": "email_address phone_number fax_number url username address street_address city postal_code",
    "identity": "person_name government_id national_insurance_number drivers_license passport_number internal_id case_number certificate_number unresolved signature handwriting",
    "demographic": "age date_of_birth individual_date gender ethnicity nationality citizenship religion political_opinion trade_union_membership sexual_orientation sex_life occupation education_record inference",
    "financial": "bank_account iban payment_card card_security_code card_track_data pin_block crypto_address product amount company_id department_name",
    "health": "medical_id insurance_id prescription_id diagnosis medication health_narrative",
    "biometric": "face facial_geometry fingerprint retina_scan voiceprint genetic_data",
    "digital": "ip_address mac_address device_id password security_question_answer communications_content coordinates geolocation_metadata precise_geolocation",
    "vehicle": "vehicle_id license_plate",
    "legal": "criminal_record criminal_charge judicial_narrative",
    "general": "date_time state country",
}
#: Our choice: which tags a category's labels have.
TAGS_BY_CATEGORY: dict[str, tuple[str, ...]] = {
    "contact": ("pii",),
    "identity": ("pii",),
    "demographic": ("pii",),
    "financial": ("pii", "financial"),
    "health": ("pii", "phi"),
    "biometric": ("pii", "phi"),
    "digital": ("pii",),
    "vehicle": ("pii",),
    "legal": ("pii",),
    "general": (),
}
PCI = ("payment_card", "card_security_code", "card_track_data", "pin_block")

BUILTIN: dict[str, Label] = {
    x: Label(x, TAGS_BY_CATEGORY[c] + (("pci",) if x in PCI else ()), c) for c, ids in BUILTIN_BY_CATEGORY.items() for x in ids.split()
}


class Catalog:
    """Labels by id, in the order they were declared."""

    def __init__(self, labels: dict[str, Label], custom: frozenset[str] = frozenset()):
        self.labels, self.custom = labels, custom

    def __contains__(self, label: str) -> bool:
        return label in self.labels

    def __len__(self) -> int:
        return len(self.labels)

    def tagged(self, *tags: str) -> tuple[str, ...]:
        """Ids of the labels that have any of ``tags``."""
        return tuple(k for k, v in self.labels.items() if set(tags) & set(v.tags))

    def filter_tag(self, tag: str) -> Catalog:
        keep = self.tagged(tag)
        return Catalog({k: self.labels[k] for k in keep}, self.custom & set(keep))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(label, category, tags, is_custom), one row per label."""
        rows = [(k, v.category, list(v.tags), k in self.custom) for k, v in self.labels.items()]
        return spark.createDataFrame(rows, "label string, category string, tags array<string>, is_custom boolean")


def builtin() -> Catalog:
    return Catalog(dict(BUILTIN))


def compile_catalog(policies: Sequence[Policy]) -> Catalog:
    """The union of what the policies' scopes name; a scope may use builtin labels and its policy's own custom ones only. A rule's table may have an entry for any other label: it never matches.

    Custom labels come first. One may be declared by several policies if the
    declarations agree, and none may take a builtin's id.
    """
    custom: dict[str, Label] = {}
    for p in policies:
        for label in p.custom:
            if label.id in BUILTIN:
                raise configuration(f"policy {p.name!r}: custom label {label.id!r} shadows a builtin label")
            if custom.setdefault(label.id, label) != label:
                raise configuration(f"policy {p.name!r}: custom label {label.id!r} conflicts with another declaration")
    labels = dict(custom)
    for p in policies:
        own = {c.id for c in p.custom}
        for scope in p.scopes:
            for x in scope.labels:
                if x not in own and x not in BUILTIN:
                    raise configuration(f"policy {p.name!r}: scope {scope.name!r} names unknown label {x!r}")
                labels.setdefault(x, custom.get(x) or BUILTIN[x])
    return Catalog(labels, frozenset(custom))
