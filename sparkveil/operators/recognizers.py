"""Recognizers: each turns a text column into an array of spans.

Patterns keep to what Java and RE2 regular expressions share: no lookaround, no
back references, no capturing groups.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import configuration
from ..functions import spans as S
from ..plans.catalog import Catalog

#: Our choice: the least confidence of an entity, and how far around a match context words are looked for, in characters.
BASELINE = 0.35
CONTEXT_REACH = 40
CONTEXT_BOOST = 0.25
#: Limits of all dictionaries together.
TERM_LIMIT, BYTE_LIMIT = 100_000, 8 * 1024 * 1024
#: Dictionaries up to this many terms are an alternation; larger ones run as one automaton in Arrow batches and find the same.
ALTERNATION_TERMS = 200
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Pattern:
    """A pattern for one label. ``needs`` is a substring that any match has and ``digits`` says that any match has a digit: cheap tests before the pattern. ``inner`` narrows a match to its part; ``check`` names a checksum."""

    name: str
    label: str
    regex: str
    confidence: float = 0.8
    needs: str | None = None
    inner: str | None = None
    check: str | None = None
    countries: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    digits: bool = False


#: Our patterns; confidences are our choice too.
PATTERNS: tuple[Pattern, ...] = (
    Pattern("email", "email_address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95, "@"),
    Pattern("ipv4", "ip_address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\b", 0.85, ".", digits=True),
    Pattern("phone-international", "phone_number", r"\+[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}\b", 0.85, "+", digits=True),
    Pattern("card-16", "payment_card", r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b", 0.6, None, check="luhn", context=("card", "visa", "mastercard", "pan"), digits=True),
    Pattern("us-ssn", "government_id", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.75, "-", countries=("US",), context=("ssn", "social security"), digits=True),
    Pattern("iban", "iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 0.7, None, check="mod97", context=("iban", "account"), digits=True),
    Pattern("url", "url", r"\bhttps?://[^\s<>\"]+", 0.9, "://"),
    Pattern("mac", "mac_address", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", 0.85, ":"),
    Pattern("secret-assignment", "password", r"\b(?:password|passwd|token|secret|api_key) ?[=:] ?\"?[A-Za-z0-9_./+-]{8,}\"?", 0.8, None, inner=r"[A-Za-z0-9_./+-]{8,}\"?$"),
    Pattern("iso-date", "individual_date", r"\b(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\b", 0.5, "-", digits=True),
    Pattern("birth-date", "date_of_birth", r"\b(?:born|birth|DOB)(?: on|:)? (?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}\b", 0.85, None, inner=r"[0-9]{4}-[0-9]{2}-[0-9]{2}$", digits=True),
    Pattern("age-years", "age", r"\b(?:aged?|Aged?)[ :]{1,2}[0-9]{1,3}\b", 0.7, None, inner=r"[0-9]+$", digits=True),
    Pattern("cvv", "card_security_code", r"\b(?:CVV2?|CVC2?)[ :]{1,2}[0-9]{3,4}\b", 0.8, "CV", inner=r"[0-9]+$", digits=True),
    Pattern("coordinates", "coordinates", r"-?[0-9]{1,2}\.[0-9]{4,}, ?-?[0-9]{1,3}\.[0-9]{4,}", 0.6, ",", digits=True),
    Pattern("bitcoin", "crypto_address", r"\b(?:bc1[a-z0-9]{25,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", 0.55, None, context=("bitcoin", "btc", "wallet")),
    Pattern("us-zip", "postal_code", r"\b[A-Z]{2} [0-9]{5}(?:-[0-9]{4})?\b", 0.5, None, inner=r"[0-9-]+$", countries=("US",), digits=True),
)


def relevant(patterns: Iterable[Pattern], catalog: Catalog | None, countries: Sequence[str] = ()) -> list[Pattern]:
    """The patterns worth running: of a label in the catalogue (an empty one restricts nothing), and of no country or one that is asserted."""
    wanted = None if catalog is None or len(catalog) == 0 else catalog
    return [p for p in patterns if (wanted is None or p.label in wanted) and (not countries or not p.countries or set(p.countries) & set(countries))]


def pattern_spans(text: Column, p: Pattern, language: Column | None = None, has_digit: Column | None = None) -> Column:
    """The pattern's spans, with checksum and context words applied. ``has_digit`` says whether the text has a digit, where that is known."""
    reach = CONTEXT_REACH

    def narrowed(m: Column) -> Column:
        value = F.regexp_extract(m["value"], p.inner, 0) if p.inner else m["value"]
        start = m["start"] + (F.length(m["value"]) - F.length(value)) if p.inner else m["start"]
        end = start + F.length(value)
        conf = F.lit(float(p.confidence))
        if p.context:
            left = F.greatest(start - reach, F.lit(0))
            near = F.lower(F.substring(text, left + 1, end + reach - left))
            conf = F.when(near.rlike(r"\b(?:" + "|".join(map(re.escape, p.context)) + r")\b"), F.least(F.lit(1.0), conf + CONTEXT_BOOST)).otherwise(conf)
        return S.span(start, end, value, F.lit(p.label), conf, F.lit("pattern"), F.lit(p.name))

    found = F.transform(S.matches(text, p.regex), narrowed)
    if p.check:
        found = F.filter(found, lambda x: S.luhn(x["value"]) if p.check == "luhn" else S.mod97(x["value"]))
    may = F.lit(True)
    if p.digits and has_digit is not None:
        may = may & has_digit
    if p.needs:
        may = may & F.contains(text, F.lit(p.needs))
    if p.languages and language is not None:
        may = may & F.coalesce(F.lower(F.split(language, "[-_]")[0]).isin([x.lower() for x in p.languages]), F.lit(True))
    return F.when(may & text.isNotNull(), found).otherwise(S.empty_spans())


@dataclass(frozen=True)
class Dictionary:
    """Terms of one label, in any case of ASCII letters.

    A term that starts or ends with an ASCII letter, digit or underscore is found
    only where no such character precedes or follows. Of terms that overlap, the
    leftmost goes first, then the longest. However many terms there are, this is
    what is found.
    """

    name: str
    label: str
    terms: tuple[str, ...]
    confidence: float = 0.75


def check_dictionaries(dictionaries: Sequence[Dictionary]) -> None:
    terms = sum(len(d.terms) for d in dictionaries)
    size = sum(len(t.encode()) for d in dictionaries for t in d.terms)
    if terms > TERM_LIMIT or size > BYTE_LIMIT:
        raise configuration(f"dictionaries hold {terms} terms and {size} bytes; the limits are {TERM_LIMIT} and {BYTE_LIMIT}")
    if any(not t.strip() for d in dictionaries for t in d.terms):
        raise configuration("a dictionary term is blank")


def dictionary_spans(text: Column, d: Dictionary) -> Column:
    """Spans of a small dictionary: one alternation, longest terms first."""
    terms = sorted(set(d.terms), key=lambda t: (-len(t), t))
    edged = [("(?<![A-Za-z0-9_])" if t[0] in _WORD else "") + re.escape(t) + ("(?![A-Za-z0-9_])" if t[-1] in _WORD else "") for t in terms]
    regex = "(?i)(?:" + "|".join(edged) + ")"
    return F.transform(S.matches(text, regex), lambda m: S.span(m["start"], m["start"] + F.length(m["value"]), m["value"], F.lit(d.label), F.lit(float(d.confidence)), F.lit("dictionary"), F.lit(d.name)))


def with_automaton(df: DataFrame, text_col: str, out_col: str, dictionaries: Sequence[Dictionary]) -> DataFrame:
    """``df`` with an array of spans of all ``dictionaries``, found by one automaton in Arrow batches. The terms, within their limits, are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast([(t.translate(_LOWER), k, len(t)) for k, d in enumerate(dictionaries) for t in d.terms])
    named = [(d.label, d.name, d.confidence) for d in dictionaries]
    built: dict[int, object] = {}

    def find(texts: Iterable[str | None]) -> Iterator[list[dict]]:
        if 0 not in built:
            import ahocorasick

            a = ahocorasick.Automaton()
            by: dict[str, list[tuple]] = {}
            for t, *rest in dict.fromkeys(shared.value):
                by.setdefault(t, []).append(tuple(rest))
            for t, rest in by.items():
                a.add_word(t, rest)
            if by:
                a.make_automaton()
            built[0] = a
        a = built[0]
        for text in texts:
            rows = []
            if text and len(a):
                word = lambda i: 0 <= i < len(text) and text[i] in _WORD
                hits = [(k, end - size + 1, end + 1) for end, rest in a.iter(text.translate(_LOWER)) for k, size in rest]
                last = (-1, 0)
                for k, start, end in sorted(hits, key=lambda x: (x[0], x[1], -x[2])):
                    if not (word(start - 1) and word(start)) and not (word(end - 1) and word(end)) and (k != last[0] or start >= last[1]):
                        last, d = (k, end), named[k]
                        rows.append({"start": start, "end": end, "value": text[start:end], "label": d[0], "confidence": d[2], "source": "dictionary", "pattern": d[1], "merged": 1, "beaten": 0})
            yield rows

    return with_model_spans(df, text_col, out_col, lambda texts: list(find(texts)))


def with_model_spans(df: DataFrame, text_col: str, out_col: str, find: Callable[[list[str | None]], list[list[dict]]]) -> DataFrame:
    """``df`` with an array of spans from a function over batches of texts; the way in for models and services."""
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("label", pa.string()), ("confidence", pa.float32()), ("source", pa.string()), ("pattern", pa.string()), ("merged", pa.int32()), ("beaten", pa.int32())])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find(b.column(at).to_pylist())
            yield pa.record_batch([*b.columns, pa.array(found, pa.list_(kind))], [*b.schema.names, out_col])

    schema = df.withColumn(out_col, S.empty_spans()).schema
    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Recognizer:
    """A configured model-backed recognizer. ``find`` takes a list of texts, and with a ``prompt`` (a template, or where it is from) that of their prompts, and gives a list of (start, end, label, confidence) per text; a mock finds nothing."""

    name: str
    provider: str = "mock"
    find: Callable[..., list[list[tuple[int, int, str, float]]]] | None = field(default=None, repr=False)
    modalities: tuple[str, ...] = ("text",)
    description: str | None = None
    prompt: str | dict | None = None

    def prepared(self) -> Recognizer:
        """With its prompt read and checked, which happens on the driver when a request is planned."""
        if self.prompt is None:
            return self
        text = self.prompt if isinstance(self.prompt, str) else load_prompt(self.prompt, DEFAULT_PROMPT)
        fill_prompt(text, "")
        return replace(self, prompt=text)

    def spans(self, texts: list[str | None]) -> list[list[dict]]:
        if self.find is None:
            return [[] for _ in texts]
        given = [t or "" for t in texts]
        found = self.find(given) if self.prompt is None else self.find(given, [fill_prompt(self.prompt, t) for t in given])
        return [[{"start": s, "end": e, "value": (t or "")[s:e], "label": label, "confidence": c, "source": "model", "pattern": self.name, "merged": 1, "beaten": 0} for s, e, label, c in f] for t, f in zip(texts, found)]


def check_recognizers(kind: str, recognizers: Sequence[Recognizer]) -> None:
    for r in recognizers:
        if kind == "llm" and not r.modalities:
            raise configuration(f"LLM recognizer {r.name!r} lists no modality")


DEFAULT_PROMPT = "List every span of personal or confidential data in the text below, each with its label and confidence.\n\n{{ text }}"


def fill_prompt(template: str, text: str) -> str:
    """``template`` with ``{{ text }}`` filled in; other names and statements are refused."""
    if re.search(r"\{%|\{#", template):
        raise configuration("a prompt may name values only, not statements")

    def value(m: re.Match) -> str:
        if m[1] != "text":
            raise configuration(f"a prompt has no value {m[1]!r}")
        return text

    return re.sub(r"\{\{\s*(.*?)\s*\}\}", value, template)


def load_prompt(source: dict | None, default: str) -> str:
    """A prompt from its configuration: ``default``, inline text, or a file that the driver reads when the request is planned."""
    kind = (source or {}).get("kind", "default")
    if kind == "default":
        return default
    if kind == "inline":
        return source["template"]
    if kind == "file":
        with open(source["path"], encoding="utf-8") as f:
            return f.read()
    raise configuration(f"prompt source {kind!r}")
