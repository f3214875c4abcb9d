"""Text redaction operators as column expressions.

``build`` turns an operator into a function from a match (value, label, coref,
language, identity) to its replacement. Operators that can decline give null,
which their fallback (erase unless set) replaces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import configuration
from ..plans.policy import Redaction
from . import crypto

#: Strictly a number: Spark's cast also takes '91d', 'NaN' and 'Infinity'.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Our choice of surrogates, by language and label; more languages fall back to English.
SURROGATES: dict[str, dict[str, list[str]]] = {
    "en": {
        "person_name": ["Alex Morgan", "Sam Carter", "Robin Hayes", "Jamie Ellis", "Taylor Brooks", "Casey Lane", "Jordan Reed", "Morgan Blake"],
        "email_address": ["alex@mail.invalid", "sam@mail.invalid", "robin@mail.invalid", "jamie@mail.invalid"],
        "phone_number": ["+1 (555) 555-0101", "+1 (555) 555-0102", "+1 (555) 555-0103", "+1 (555) 555-0104"],
        "city": ["Springfield", "Riverton", "Lakeside", "Fairview"],
        "company_id": ["ACME-001", "ACME-002", "ACME-003"],
        "ip_address": ["192.0.2.1", "192.0.2.2", "198.51.100.1", "203.0.113.1"],
    },
    "de": {"person_name": ["Kim Weber", "Toni Schmidt", "Sascha Braun", "Luca Vogel"], "city": ["Neustadt", "Altdorf", "Seeheim"]},
    "fr": {"person_name": ["Camille Petit", "Dominique Roux", "Claude Moreau"], "city": ["Villeneuve", "Montclair", "Beaulieu"]},
    "es": {"person_name": ["Alex Vega", "Cruz Molina", "Ariel Campos"], "city": ["Villanueva", "Montealto", "Riosol"]},
}


@dataclass(frozen=True)
class Match:
    """The columns an operator may use; ``keys`` is the struct of key bytes, ``identity`` what makes two mentions one entity."""

    value: Column
    label: Column
    coref: Column
    language: Column
    context: Column
    keys: Column | None = None

    @property
    def identity(self) -> Column:
        return F.coalesce(self.coref, self.value)


def mask(v: Column, char: str, prefix: int, suffix: int) -> Column:
    """Same length; a value that the kept ends would cover is masked whole."""
    n = F.length(v)
    short = F.repeat(F.lit(char), n)
    kept = F.concat(F.substring(v, 1, prefix), F.repeat(F.lit(char), n - prefix - suffix), F.expr("''") if not suffix else F.right(v, F.lit(suffix)))
    return F.when(n > prefix + suffix, kept).otherwise(short)


def truncate(v: Column, prefix: int, suffix: int, strict: bool) -> Column:
    """Keeps both ends. A value that they cover is an error if strict, else it is erased: it never passes unchanged."""
    kept = F.concat(F.substring(v, 1, prefix), F.right(v, F.lit(suffix)) if suffix else F.lit(""))
    refused = F.raise_error(F.lit("Redaction: truncate would keep the whole value")).cast("string") if strict else F.lit("")
    return F.when(F.length(v) > prefix + suffix, kept).otherwise(refused)


def fill(template: str, m: Match) -> Column:
    """``{label}``, ``{value}`` and ``{coref}`` filled in one pass, so that a value with braces isn't read again; a missing coref is empty."""
    known = {"{label}": m.label, "{value}": m.value, "{coref}": F.coalesce(m.coref, F.lit(""))}
    parts = [known.get(p, F.lit(p)) for p in re.split(r"(\{(?:label|value|coref)\})", template) if p]
    return F.concat(*parts) if parts else F.lit("")


def _number_text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def bucket(b, threshold: float, language: Column) -> Column:
    """A bucket's text: plain, ``{"format": "{n} or older"}``, or a map by language with English for the rest."""
    if isinstance(b, str):
        return F.lit(b)
    if isinstance(b, dict) and set(b) == {"format"}:
        return F.lit(b["format"].replace("{n}", _number_text(threshold)))
    if isinstance(b, dict) and "en" in b:
        out = F.lit(b["en"])
        for lang, text in sorted(b.items()):
            out = F.when(F.lower(F.split(language, "[-_]")[0]) == lang.lower(), F.lit(text)).otherwise(out)
        return out
    raise configuration("a localized bucket needs an English text")


def clamp(m: Match, r: Redaction) -> Column:
    """Values from the ceiling up, or the floor down, become a bucket; others stay. What is no finite number is declined (null)."""
    trimmed = F.trim(m.value)
    number = F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))
    number = F.when(F.abs(number) < float("inf"), number)
    out = F.when(number.isNotNull(), m.value)
    if r["floor"] is not None:
        out = F.when(number <= F.lit(float(r["floor"])), bucket(r["floor_bucket"], r["floor"], m.language)).otherwise(out)
    if r["ceiling"] is not None:
        out = F.when(number >= F.lit(float(r["ceiling"])), bucket(r["ceiling_bucket"], r["ceiling"], m.language)).otherwise(out)
    return out


def generalize_date(v: Column, granularity: str, style: str) -> Column:
    """An ISO date at a coarser grain; anything else is declined (null)."""
    shapes = {("year", "iso"): "yyyy", ("month", "iso"): "yyyy-MM"}
    if (granularity, style) not in shapes:
        raise configuration(f"no date style {style!r} at {granularity!r}")
    trimmed = F.trim(v)
    date = F.when(trimmed.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd")))
    return F.date_format(date, shapes[granularity, style])


def fake(m: Match, r: Redaction) -> Column:
    """A surrogate picked by 60 bits of the MD5 of seed, label and identity: mentions of one entity agree. A label without surrogates is filled from the fallback template."""
    seed = F.lit(str(r["seed"] if r["seed"] is not None else 0))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", seed, m.label, m.identity).cast("binary")), 1, 15), 16, 10).cast("bigint")
    language = F.lower(F.split(F.coalesce(m.language, F.lit(r["default_language"] or "en")), "[-_]")[0])
    out = fill(r["fallback_template"], m)

    def one(names: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), (F.pmod(pick, F.lit(len(names))) + 1).cast("int"))

    for label in sorted({x for by in SURROGATES.values() for x in by}):
        value = one(SURROGATES["en"][label]) if label in SURROGATES["en"] else out
        for lang, by in SURROGATES.items():
            if lang != "en" and label in by:
                value = F.when(language == lang, one(by[label])).otherwise(value)
        out = F.when(m.label == label, value).otherwise(out)
    return out


def build(r: Redaction, m: Match, policy_id: str, strict: bool = False) -> Column:
    """The replacement of one match under operator ``r``; never null."""
    if r.kind == "erase":
        return F.lit("")
    if r.kind == "keep":
        return m.value
    if r.kind == "mask":
        return mask(m.value, r["mask_char"], r["keep_prefix"], r["keep_suffix"])
    if r.kind == "replace":
        return fill(r["template"], m)
    if r.kind == "hash":
        return F.sha2(F.encode(F.concat(F.lit(r["salt"] or ""), m.value), "utf-8"), int(r["algorithm"][3:]))
    if r.kind == "hmac_hash":
        return crypto.hmac(m.value, m.keys[f"{r['algorithm']}_inner"], m.keys[f"{r['algorithm']}_outer"], r["algorithm"])
    if r.kind == "encrypt":
        return crypto.encrypt(m.value, m.keys["encrypt"], m.context)
    if r.kind == "truncate":
        return truncate(m.value, r["keep_prefix"], r["keep_suffix"], strict)
    if r.kind == "fake":
        return fake(m, r)
    if r.kind == "pseudonymize":
        token = crypto.hmac(F.concat_ws("\0", F.lit(policy_id), m.context, m.label, m.identity), m.keys["pseudonym_inner"], m.keys["pseudonym_outer"])
        return F.concat(m.label, F.lit("_"), F.substring(token, 1, 12))
    if r.kind in ("clamp", "generalize_date"):
        first = clamp(m, r) if r.kind == "clamp" else generalize_date(m.value, r["granularity"], r["style"])
        rest = F.lit("") if r["fallback"] is None else build(r["fallback"], m, policy_id, strict)
        return F.coalesce(first, rest)
    raise configuration(f"no text operator {r.kind!r}")


def needed_keys(kinds: set[tuple[str, str | None]]) -> set[str]:
    """Key columns that operators (kind, algorithm) use."""
    out: set[str] = set()
    for kind, algorithm in kinds:
        if kind == "hmac_hash":
            out |= {f"{algorithm}_inner", f"{algorithm}_outer"}
        elif kind == "encrypt":
            out.add("encrypt")
        elif kind == "pseudonymize":
            out |= {"pseudonym_inner", "pseudonym_outer"}
    return out
