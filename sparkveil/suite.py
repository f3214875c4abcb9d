"""Registered queries over the engine's operators, and their SQL."""

from __future__ import annotations

import functools
import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .engine import Engine
from .errors import VeilError, configuration
from .functions import crypto
from .functions import spans as S
from .functions.text import SURROGATES, Match, build
from .operators import audio, detect, image, language, reconcile, tabular
from .operators.media import Reader
from .operators.recognizers import PATTERNS, Dictionary, Pattern, Recognizer, dictionary_spans, pattern_spans, relevant, with_automaton
from .plans import templates
from .plans.catalog import Catalog, builtin, compile_catalog
from .plans.decide import Override
from .plans.policy import AnalyzerParams, Label, LabelEntry, ModalityRedactions, Policy, Predicate, RasterMode, Redaction, Rule, Scope, ScopeParams, text_op
from .sources import files, rewrite, sinks
from .streaming import redact as streaming

BY_NAME = {p.name: p for p in PATTERNS}
KEY = b"bench key, not a secret"
SECRET = b"run secret of the suite"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if f.dataType.simpleString() == "int" else F.col(f.name) for f in df.schema.fields])


def _found(docs: DataFrame, spans) -> DataFrame:
    x = S.unnest(docs, ["doc_id"], spans, "x")
    return _longs(x.select("doc_id", "x.start", "x.end", "x.value"))


def _span_sql(p: Pattern) -> str:
    return f'SELECT doc_id, start::BIGINT AS start, "end"::BIGINT AS "end", value FROM {O.matches(p)}'


# -- recognizers --------------------------------------------------------------


@query(_span_sql(BY_NAME["email"]))
def detect_email(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), pattern_spans(F.col("text"), BY_NAME["email"]))


@query(_span_sql(BY_NAME["ipv4"]))
def detect_ipv4(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), pattern_spans(F.col("text"), BY_NAME["ipv4"]))


@query(_span_sql(BY_NAME["phone-international"]))
def detect_phone(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), pattern_spans(F.col("text"), BY_NAME["phone-international"]))


CARD_SHAPE = Pattern("card-shape", "payment_card", BY_NAME["card-16"].regex, 0.4)


@query(_span_sql(CARD_SHAPE))
def detect_payment_card(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), pattern_spans(F.col("text"), CARD_SHAPE))


@query(_span_sql(BY_NAME["card-16"]))
def detect_card_luhn(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), pattern_spans(F.col("text"), BY_NAME["card-16"]))


@query(_span_sql(BY_NAME["secret-assignment"]))
def detect_secret_token(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), pattern_spans(F.col("text"), BY_NAME["secret-assignment"]))


LICENSES = Dictionary("licenses", "certificate_number", ("MIT License", "Apache License", "GNU General Public License", "CC BY-NC 4.0"))


@query(_span_sql(Pattern("licenses", "certificate_number", r"(?i)\b(?:GNU General Public License|Apache License|CC BY\-NC 4\.0|MIT License)\b")))
def detect_dictionary_license(spark, sf_dir):
    return _found(table(spark, sf_dir, "documents"), dictionary_spans(F.col("text"), LICENSES))


NEAR_THE = Pattern("ipv4-context", "ip_address", BY_NAME["ipv4"].regex, 0.5, context=("the", "of"))


@query(f"SELECT doc_id, start::BIGINT AS start, value, printf('%.3f', conf::DOUBLE) AS confidence FROM {O.matches(NEAR_THE)}")
def detect_context_boost(spark, sf_dir):
    x = S.unnest(table(spark, sf_dir, "documents"), ["doc_id"], pattern_spans(F.col("text"), NEAR_THE), "x")
    return x.select("doc_id", F.col("x.start").cast("bigint").alias("start"), "x.value", F.format_string("%.3f", F.col("x.confidence").cast("double")).alias("confidence"))


_MADE = """(SELECT c_custkey, c_custkey % 100 AS pair, lpad((c_custkey * 7919 % 1000)::VARCHAR, 3, '0') AS area, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS serial,
  lpad((c_custkey * 104729)::VARCHAR, 18, '1') AS account FROM customer)"""
_MADE_SQL = f"""WITH m AS (SELECT *, area || '-' || lpad(pair::VARCHAR, 2, '0') || '-' || serial AS ssn, 'DE' || lpad(pair::VARCHAR, 2, '0') || account AS iban,
  '19' || lpad(pair::VARCHAR, 2, '0') || '-03-0' || (c_custkey % 9 + 1) AS born, (c_custkey % 90) || '.' || serial || '1, -' || (c_custkey % 180) || '.' || serial || '2' AS place, '9' || serial AS zip FROM {_MADE}),
p AS (SELECT *, 'No. ' || c_custkey || ' social security ' AS a, ' at ' AS b, ' from account ' AS c, ' near CA ' AS d, ' born ' AS e FROM m),
q AS (SELECT *, len(a) AS s1, len(a || ssn || b) AS s2, len(a || ssn || b || place || c) AS s3, len(a || ssn || b || place || c || iban || d) AS s4, len(a || ssn || b || place || c || iban || d || zip || e) AS s5 FROM p)
SELECT c_custkey, 'government_id' AS label, ssn AS value, s1::BIGINT AS start, '1.000' AS confidence FROM q
UNION ALL SELECT c_custkey, 'coordinates', place, s2, '0.600' FROM q
UNION ALL SELECT c_custkey, 'iban', iban, s3, '0.950' FROM q WHERE (account || '1314' || lpad(pair::VARCHAR, 2, '0'))::HUGEINT % 97 = 1
UNION ALL SELECT c_custkey, 'postal_code', zip, s4, '0.500' FROM q
UNION ALL SELECT c_custkey, 'date_of_birth', born, s5, '0.850' FROM q"""
MADE_PATTERNS = tuple(BY_NAME[k] for k in ("us-ssn", "coordinates", "iban", "us-zip", "birth-date"))
#: Rows of a task that makes a text of each and searches it.
MADE_ROWS = 4096


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt evenly to tasks of at most about ``rows`` rows. Reads are cut by bytes and row groups, so a million keys are one task, however much is made of each."""
    return df.repartition(max(1, -(-df.count() // rows)))


@query(_MADE_SQL)
def detect_made_identifiers(spark, sf_dir):
    """Identifiers written into a text at places that arithmetic gives, some with wrong check digits."""
    c, k = _dealt(table(spark, sf_dir, "customer").select("c_custkey"), MADE_ROWS), F.col("c_custkey")
    digits = lambda x, n: F.lpad(x.cast("string"), n, "0")
    pair, serial = digits(k % 100, 2), digits(k % 10000, 4)
    ssn = F.concat(digits(k * 7919 % 1000, 3), F.lit("-"), pair, F.lit("-"), serial)
    place = F.concat((k % 90).cast("string"), F.lit("."), serial, F.lit("1, -"), (k % 180).cast("string"), F.lit("."), serial, F.lit("2"))
    iban = F.concat(F.lit("DE"), pair, F.lpad((k * 104729).cast("string"), 18, "1"))
    born = F.concat(F.lit("19"), pair, F.lit("-03-0"), (k % 9 + 1).cast("string"))
    text = F.concat(F.lit("No. "), k.cast("string"), F.lit(" social security "), ssn, F.lit(" at "), place, F.lit(" from account "), iban, F.lit(" near CA "), F.concat(F.lit("9"), serial), F.lit(" born "), born)
    found = Engine(detection=detect.Detection(patterns=MADE_PATTERNS)).analyze(c.select("c_custkey", text.alias("text")), id_col="c_custkey")
    e = S.unnest(found, ["c_custkey"], "entities", "e")
    return e.select("c_custkey", "e.label", "e.value", F.col("e.start").cast("bigint").alias("start"), F.format_string("%.3f", F.col("e.confidence").cast("double")).alias("confidence"))


def _language_sql() -> str:
    counts = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(map(O.quote, v))}))) AS n_{k}" for k, v in language.FUNCTION_WORDS.items())
    best = "greatest(" + ", ".join(f"n_{k}" for k in language.FUNCTION_WORDS) + ")"
    case = " ".join(f"WHEN n_{k} = {best} THEN '{k}'" for k in sorted(language.FUNCTION_WORDS))
    return rf"SELECT doc_id, CASE WHEN {best} = 0 THEN NULL {case} END AS detected FROM (SELECT doc_id, {counts} FROM (SELECT doc_id, string_split_regex(lower(text), '[^\p{{L}}]+') AS w FROM documents))"


@query(_language_sql())
def detect_language_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", language.detect(F.col("text")).alias("detected"))


HTML_NOISE = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"


@query(
    f"SELECT page_id, len(t)::BIGINT AS visible_chars, len(regexp_extract_all(html, {O.quote(BY_NAME['url'].regex)}))::BIGINT AS n_urls, len(regexp_extract_all(t, {O.quote(BY_NAME['email'].regex)}))::BIGINT AS n_emails "
    f"FROM (SELECT page_id, html, regexp_replace(regexp_replace(html, {O.quote(HTML_NOISE)}, ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages)"
)
def detect_html_pages(spark, sf_dir):
    t = F.regexp_replace(F.regexp_replace("html", HTML_NOISE, " "), "<[^>]*>", " ")
    count = lambda c, p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0))).cast("bigint")
    d = table(spark, sf_dir, "pages").select("page_id", "html", t.alias("t"))
    return d.select("page_id", F.length("t").cast("bigint").alias("visible_chars"), count(F.col("html"), BY_NAME["url"].regex).alias("n_urls"), count(F.col("t"), BY_NAME["email"].regex).alias("n_emails"))


def _counts(df: DataFrame) -> DataFrame:
    return S.unnest(df, [], "entities", "e").groupBy(F.col("e.label").alias("label")).agg(F.count("*").alias("n"))


def _policy(name: str, labels, rules=(), fallback=None, **more) -> Policy:
    return Policy(templates.derived_id(f"suite:{name}"), name, (Scope(name, tuple(labels)),), tuple(rules), fallback, **more)


CONTACT = _policy("contact", ["email_address", "phone_number"])


def _label_counts_sql(patterns) -> str:
    return f"WITH {O.winners(patterns)} SELECT label, count(*) AS n FROM w GROUP BY label"


@query(_label_counts_sql(relevant(PATTERNS, compile_catalog([CONTACT]))))
def detect_vocabulary_pruned(spark, sf_dir):
    return _counts(Engine().analyze(table(spark, sf_dir, "documents"), [CONTACT]))


@query(_label_counts_sql(relevant(PATTERNS, None, ("DE",))))
def detect_country_pruned(spark, sf_dir):
    return _counts(Engine().analyze(table(spark, sf_dir, "documents"), [], AnalyzerParams(ScopeParams(countries=("DE",)))))


# -- spans --------------------------------------------------------------------

DIGITS = Pattern("digits", "payment_card", r"[0-9]{6,}", 0.5)
GROUPED = Pattern("grouped", "payment_card", r"\b[0-9]{4,}[ -][0-9]{3}-[0-9]{4}\b|[0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.45)
OTHER_DIGITS = Pattern("other-digits", "internal_id", r"[0-9]{4,}", 0.5)


def _spans_of(df: DataFrame, patterns, merge: bool = True) -> DataFrame:
    text = F.col("text")
    found = F.concat(*[pattern_spans(text, p) for p in patterns])
    return df.withColumn("found", S.merge_same_label(text, found) if merge else found)


@query(f'WITH {O.winners([DIGITS, CARD_SHAPE])} SELECT doc_id, start::BIGINT AS start, "end"::BIGINT AS "end", label, printf(\'%.3f\', conf::DOUBLE) AS confidence FROM m2')
def spans_merge_same_label(spark, sf_dir):
    x = S.unnest(_spans_of(table(spark, sf_dir, "documents"), [DIGITS, CARD_SHAPE]), ["doc_id"], "found", "x")
    return _longs(x.select("doc_id", "x.start", "x.end", "x.label", F.format_string("%.3f", F.col("x.confidence").cast("double")).alias("confidence")))


@query(f'WITH {O.winners([CARD_SHAPE, OTHER_DIGITS, BY_NAME["phone-international"]], whole=False)} SELECT doc_id, start::BIGINT AS start, "end"::BIGINT AS "end", value, label FROM w')
def spans_resolve_cross_label(spark, sf_dir):
    docs = _spans_of(table(spark, sf_dir, "documents"), [CARD_SHAPE, OTHER_DIGITS, BY_NAME["phone-international"]], merge=False)
    x = S.unnest(docs, ["doc_id"], detect.reconcile(F.col("text"), F.col("found")), "x")
    return _longs(x.select("doc_id", "x.start", "x.end", "x.value", "x.label"))


@query(f'SELECT doc_id, start::BIGINT AS start, "end"::BIGINT AS "end", value FROM {O.matches(BY_NAME["email"])} s WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS d, 0 AS a, 400 AS b FROM documents) x WHERE x.d = s.doc_id AND s.start < x.b AND x.a < s."end")')
def spans_exclusion_antijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("keep_out", F.array(F.struct(F.lit(0).alias("start"), F.lit(400).alias("end"))))
    return _found(docs, S.without_excluded(pattern_spans(F.col("text"), BY_NAME["email"]), F.col("keep_out")))


@query(f'SELECT doc_id, start::BIGINT AS start, label, dense_rank() OVER (PARTITION BY doc_id ORDER BY label, lower(value)) AS coref FROM (SELECT * FROM {O.matches(OTHER_DIGITS)} UNION ALL SELECT * FROM {O.matches(BY_NAME["email"])})')
def coref_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = F.concat(pattern_spans(F.col("text"), OTHER_DIGITS), pattern_spans(F.col("text"), BY_NAME["email"]))
    x = S.unnest(docs, ["doc_id"], found, "x").select("doc_id", F.col("x.start").cast("bigint").alias("start"), "x.label", "x.value")
    return reconcile.coreference(x, ["doc_id"], F.col("value")).select("doc_id", "start", "label", F.col("coref").cast("bigint").alias("coref"))


MANY_TERMS = Dictionary("licenses", "certificate_number", (*LICENSES.terms, *(f"term number {i}" for i in range(400))))


@query(SQL["detect_dictionary_license"])
def detect_dictionary_automaton(spark, sf_dir):
    found = with_automaton(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "found", [MANY_TERMS])
    return _longs(S.unnest(found, ["doc_id"], "found", "x").select("doc_id", "x.start", "x.end", "x.value"))


@query("SELECT doc_id, 'person_name' AS label, substr(text, 3, 6) AS value, '1.000' AS confidence FROM documents WHERE len(text) >= 8")
def detect_inclusions(spark, sf_dir):
    given = F.array(F.struct(F.lit(2).alias("start"), F.lit(8).alias("end"), F.lit("person_name").alias("label")))
    docs = table(spark, sf_dir, "documents").withColumn("given", F.when(F.length("text") >= 8, given))
    engine = Engine(detection=detect.Detection(patterns=()))
    audit = engine.analyze(docs, params=AnalyzerParams(inclusions="given"))
    return sinks.entities(audit).select("doc_id", "label", "confidence").join(S.unnest(audit, ["doc_id"], "entities", "e").select("doc_id", "e.value"), "doc_id")


@query(f"WITH {O.winners([CARD_SHAPE, OTHER_DIGITS, BY_NAME['phone-international']])} SELECT doc_id, min(start)::BIGINT AS start, max(\"end\")::BIGINT AS \"end\", arg_min(label, r) AS label FROM c2 GROUP BY doc_id, island")
def spans_union_policy(spark, sf_dir):
    docs = _spans_of(table(spark, sf_dir, "documents"), [CARD_SHAPE, OTHER_DIGITS, BY_NAME["phone-international"]], merge=False)
    x = S.unnest(docs, ["doc_id"], detect.reconcile(F.col("text"), F.col("found"), policy="union"), "x")
    return _longs(x.select("doc_id", "x.start", "x.end", "x.label"))


@query(f"WITH {O.winners([CARD_SHAPE, OTHER_DIGITS])} SELECT doc_id, label, start::BIGINT AS start, first_value(label) OVER (PARTITION BY doc_id, island ORDER BY r) AS winner, r = 1 AS wins FROM c2")
def spans_cluster_winners(spark, sf_dir):
    docs = _spans_of(table(spark, sf_dir, "documents"), [CARD_SHAPE, OTHER_DIGITS])
    x = S.unnest(docs, ["doc_id"], "found", "x").select("doc_id", "x.start", "x.end", "x.label", "x.confidence")
    return reconcile.cluster_winners(x, ["doc_id"]).select("doc_id", "label", F.col("start").cast("bigint").alias("start"), "winner", "wins")


# -- text operators over documents --------------------------------------------

COMMON = ["email_address", "phone_number", "ip_address", "payment_card", "password"]
COMMON_PATTERNS = relevant(PATTERNS, Catalog({k: builtin().labels[k] for k in COMMON}))


def _run(spark, sf_dir, policies, engine: Engine = Engine(), **options) -> DataFrame:
    out = engine.run(table(spark, sf_dir, "documents"), policies, run_secret=SECRET, **options)
    return out.select("doc_id", "redacted", F.size("entities").cast("bigint").alias("n_entities"))


def _one_op(name: str, action: ModalityRedactions, labels=COMMON) -> Policy:
    return _policy(name, labels, fallback=action)


ALL_OF = {
    "redact_erase": (text_op("erase"), "''"),
    "redact_mask_card": (text_op("mask", keep_prefix=6, keep_suffix=4), "CASE WHEN len(value) > 10 THEN substr(value, 1, 6) || repeat('*', len(value) - 10) || right(value, 4) ELSE repeat('*', len(value)) END"),
    "redact_replace_template": (text_op("replace", template="<{label}:{value}>"), "'<' || label || ':' || value || '>'"),
    "redact_keep": (text_op("keep"), "value"),
    "redact_truncate_pan_6_4": (text_op("truncate", keep_prefix=6, keep_suffix=4), "CASE WHEN len(value) > 10 THEN substr(value, 1, 6) || right(value, 4) ELSE '' END"),
    "redact_truncate_last4": (text_op("truncate", keep_suffix=4), "CASE WHEN len(value) > 4 THEN right(value, 4) ELSE '' END"),
    "redact_sha256_salted": (text_op("hash", salt="pepper"), "sha256('pepper' || value)"),
}


def _register_text_operators() -> None:
    for name, (op, sql) in ALL_OF.items():

        def run(spark, sf_dir, op=op, name=name):
            return _run(spark, sf_dir, [_one_op(name, ModalityRedactions(text=op))])

        run.__name__ = name
        query(O.redacted(COMMON_PATTERNS, sql))(run)


_register_text_operators()
_INNER, _OUTER = (x.hex() for x in crypto.pads(KEY, "sha256"))
_P_INNER, _P_OUTER = (x.hex() for x in crypto.pads(SECRET, "sha256"))


def _hmac_sql(value: str, inner: str = _INNER, outer: str = _OUTER) -> str:
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


KEYED = Engine(key_provider=crypto.KeyProvider.static(KEY))


@query(O.redacted(COMMON_PATTERNS, _hmac_sql("value")))
def redact_hmac_sha256(spark, sf_dir):
    return _run(spark, sf_dir, [_one_op("hmac", ModalityRedactions.for_text("hmac_hash"))], KEYED)


#: A published test case of HMAC-SHA-512 (RFC 4231, case 2).
RFC_KEY, RFC_TEXT = b"Jefe", "what do ya want for nothing?"
RFC_DIGEST = "164b7a7bfcf819e2e395fbe73b56e0a387bd64222e831fd610270cd7ea2505549758bf75c05a994a6d034f65f8f0e6fdcaeab1a34d4a6b4b636e070a38bce737"


@query(f"SELECT c_custkey, '{RFC_DIGEST}' AS digest FROM customer")
def redact_hmac_sha512(spark, sf_dir):
    inner, outer = crypto.pads(RFC_KEY, "sha512")
    keyed = table(spark, sf_dir, "customer").crossJoin(F.broadcast(crypto.key_table(spark, {"sha512_inner": inner, "sha512_outer": outer})))
    keys = F.col(crypto.KEYS)
    text = F.concat(F.lit(RFC_TEXT), F.substring("c_name", 1, 0))  # a column's value, so that nothing is folded
    return keyed.select("c_custkey", crypto.hmac(text, keys["sha512_inner"], keys["sha512_outer"], "sha512").alias("digest"))


@query("SELECT c_custkey, c_name AS opened, true AS sealed FROM customer")
def redact_encrypt_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").crossJoin(F.broadcast(crypto.key_table(spark, {"encrypt": KEYED.key_provider.key("encrypt")})))
    key = F.col(crypto.KEYS)["encrypt"]
    c = c.withColumn("box", crypto.encrypt(F.col("c_name"), key, F.col("c_custkey").cast("string")))
    return c.select("c_custkey", crypto.decrypt(F.col("box"), key).alias("opened"), (F.col("box") != F.col("c_name")).alias("sealed"))


# -- text operators over values -----------------------------------------------


def _match(value, label: str = "age", coref=None) -> Match:
    null = F.lit(None).cast("string")
    return Match(value, F.lit(label), null if coref is None else coref, null, F.lit(""))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_quantity >= 45 THEN '45 or more' WHEN l_quantity <= 5 THEN 'up to 5' ELSE (l_quantity::INT)::VARCHAR END AS clamped FROM lineitem")
def clamp_quantity(spark, sf_dir):
    op = text_op("clamp", ceiling=45.0, ceiling_bucket={"format": "{n} or more"}, floor=5.0, floor_bucket="up to 5")
    value = F.col("l_quantity").cast("int").cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), build(op, _match(value), "").alias("clamped"))


@query("SELECT p_partkey, '[age]' AS clamped, CASE WHEN p_size >= 40 THEN 'large' ELSE p_size::VARCHAR END AS sized FROM part")
def clamp_decline_fallback(spark, sf_dir):
    op = text_op("clamp", ceiling=40.0, ceiling_bucket={"en": "large", "fr": "grand"}, fallback=text_op("replace"))
    return table(spark, sf_dir, "part").select("p_partkey", build(op, _match(F.col("p_type")), "").alias("clamped"), build(op, _match(F.col("p_size").cast("string")), "").alias("sized"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, strftime(l_shipdate, '%Y') AS shipped FROM lineitem")
def generalize_shipdate_year(spark, sf_dir):
    op = text_op("generalize_date")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), build(op, _match(day), "").alias("shipped"))


@query("SELECT o_orderkey, repeat('#', len(o_orderpriority)) AS declined, '' AS impossible FROM orders")
def generalize_decline(spark, sf_dir):
    masked = text_op("generalize_date", fallback=text_op("mask", mask_char="#"))
    impossible = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30"))
    return table(spark, sf_dir, "orders").select("o_orderkey", build(masked, _match(F.col("o_orderpriority")), "").alias("declined"), build(text_op("generalize_date"), _match(impossible), "").alias("impossible"))


_NAMES = "[" + ", ".join(map(O.quote, SURROGATES["en"]["person_name"])) + "]"


@query(f"SELECT c_custkey, {_NAMES}[('0x' || substr(md5('7|person_name|' || c_name), 1, 15))::BIGINT % {len(SURROGATES['en']['person_name'])} + 1] AS surrogate FROM customer")
def fake_names(spark, sf_dir):
    op = text_op("fake", seed=7)
    return table(spark, sf_dir, "customer").select("c_custkey", build(op, _match(F.col("c_name"), "person_name"), "").alias("surrogate"))


def _pseudonym_sql(policy_id: str, context: str, label: str, identity: str) -> str:
    return f"{label} || '_' || substr({_hmac_sql(f'{O.quote(policy_id)} || chr(0) || {context} || chr(0) || {label} || chr(0) || {identity}', _P_INNER, _P_OUTER)}, 1, 12)"


@query(f"SELECT c_custkey, {_pseudonym_sql('p1', chr(39) * 2, chr(39) + 'person_name' + chr(39), 'c_name')} AS token, {_pseudonym_sql('p2', chr(39) * 2, chr(39) + 'person_name' + chr(39), 'c_name')} AS other FROM customer")
def pseudonymize_customer(spark, sf_dir):
    inner, outer = crypto.pads(SECRET, "sha256")
    c = table(spark, sf_dir, "customer").crossJoin(F.broadcast(crypto.key_table(spark, {"pseudonym_inner": inner, "pseudonym_outer": outer})))
    null = F.lit(None).cast("string")
    m = Match(F.col("c_name"), F.lit("person_name"), null, null, F.lit(""), F.col(crypto.KEYS))
    return c.select("c_custkey", build(text_op("pseudonymize"), m, "p1").alias("token"), build(text_op("pseudonymize"), m, "p2").alias("other"))


# -- policies -----------------------------------------------------------------


def _rule(name: str, predicate: Predicate, kind: str, **params) -> Rule:
    return Rule(templates.derived_id(f"suite:rule:{name}"), name, predicate, ModalityRedactions.for_text(kind, **params))


P_FIRST = _policy("first", COMMON, [_rule("a", Predicate.label_one_of("email_address"), "replace", template="[A]"), _rule("b", Predicate.label_one_of("email_address", "ip_address"), "replace", template="[B]")])


@query(O.redacted(COMMON_PATTERNS, "CASE WHEN label = 'email_address' THEN '[A]' ELSE '[B]' END", "label IN ('email_address', 'ip_address')"))
def policy_first_match(spark, sf_dir):
    return _run(spark, sf_dir, [P_FIRST])


P_COARSE = _policy("coarse", ["email_address", "phone_number"], fallback=ModalityRedactions.for_text("erase"))
P_SPECIFIC = _policy("specific", ["email_address"], [_rule("s", Predicate.label_one_of("email_address"), "replace", template="[mail]")])
PAIR = relevant(PATTERNS, compile_catalog([P_COARSE, P_SPECIFIC]))


@query(O.redacted(PAIR, "CASE WHEN label = 'email_address' THEN '[mail]' ELSE '' END"))
def policy_two_pass_fallback(spark, sf_dir):
    return _run(spark, sf_dir, [P_COARSE, P_SPECIFIC])


P_A = _policy("only-mail", ["email_address"], [_rule("pii", Predicate.tag_one_of("pii"), "replace", template="[pii]")])
P_B = _policy("only-phone", ["phone_number"])


@query(O.redacted(PAIR, "'[pii]'", "label = 'email_address'"))
def policy_scope_isolation(spark, sf_dir):
    return _run(spark, sf_dir, [P_A, P_B])


P_TABLE = Policy(
    templates.derived_id("suite:table"),
    "table",
    (Scope("table", ("email_address", "phone_number", "ip_address")),),
    (Rule(templates.derived_id("suite:rule:t"), "t", table=(LabelEntry("email_address", ModalityRedactions.for_text("erase")), LabelEntry("phone_number", ModalityRedactions.for_text("replace", template="[phone]")), LabelEntry("email_address", ModalityRedactions.for_text("keep")))),),
)


@query(O.redacted(relevant(PATTERNS, compile_catalog([P_TABLE])), "CASE WHEN label = 'email_address' THEN '' ELSE '[phone]' END", "label IN ('email_address', 'phone_number')"))
def policy_table_rule(spark, sf_dir):
    return _run(spark, sf_dir, [P_TABLE])


TREE = Predicate.all_of(Predicate.any_of(Predicate.confidence(0.9), Predicate.label_in_scope("tree")), Predicate.negate(Predicate.label_one_of("ip_address")), Predicate.negate(Predicate.coref("nobody")))
P_TREE = _policy("tree", COMMON, [_rule("tree", TREE, "mask"), _rule("rest", Predicate.all_of(), "replace", template="-")])


@query(O.redacted(COMMON_PATTERNS, "CASE WHEN label <> 'ip_address' THEN repeat('*', len(value)) ELSE '-' END"))
def policy_boolean_tree(spark, sf_dir):
    return _run(spark, sf_dir, [P_TREE])


@query(O.redacted(PAIR, "CASE WHEN label = 'email_address' AND start % 2 = 0 THEN value ELSE '' END"))
def policy_override_first(spark, sf_dir):
    """Reviewers keep the addresses that start at an even place; the policy erases the rest."""
    engine, policies = Engine(), [P_COARSE]
    audit = engine.analyze(table(spark, sf_dir, "documents"), policies)
    e = S.unnest(audit, ["doc_id"], "entities", "e").where("e.label = 'email_address' and e.start % 2 = 0")
    overrides = e.select("doc_id", "e.entity_id", F.lit(P_COARSE.id).alias("policy_id"), F.lit(json.dumps(ModalityRedactions.for_text("keep").to_json())).alias("action"))
    out = engine.anonymize(audit, policies, overrides)
    return out.select("doc_id", "redacted", F.size("entities").cast("bigint").alias("n_entities"))


#: Overlapping finds on purpose: digits inside cards and telephone numbers.
CLUSTERED = (CARD_SHAPE, OTHER_DIGITS, BY_NAME["phone-international"])
P_CARDS = _policy("cards", ["payment_card", "phone_number"], [_rule("card", Predicate.label_one_of("payment_card"), "replace", template="[card]"), _rule("phone", Predicate.label_one_of("phone_number"), "replace", template="[phone]")])
P_DIGITS = _policy("digits", ["internal_id"], [_rule("id", Predicate.label_one_of("internal_id"), "replace", template="[id]")])
CLUSTER_ENGINE = Engine(detection=detect.Detection(patterns=CLUSTERED, span_policy="cluster"))
_RULE_OF = f"CASE label WHEN 'payment_card' THEN {O.quote(P_CARDS.rules[0].id)} WHEN 'phone_number' THEN {O.quote(P_CARDS.rules[1].id)} ELSE {O.quote(P_DIGITS.rules[0].id)} END"


@query(f"WITH {O.winners(CLUSTERED)} SELECT doc_id, label, start::BIGINT AS start, first_value({_RULE_OF}) OVER (PARTITION BY doc_id, island ORDER BY r) AS source_id, CASE WHEN first_value(label) OVER (PARTITION BY doc_id, island ORDER BY r) = 'internal_id' THEN 'digits' ELSE 'cards' END AS policy FROM c2")
def policy_cluster_stamping(spark, sf_dir):
    """Every member of a cluster records the winner's rule, whichever policy would have decided on it."""
    out = CLUSTER_ENGINE.run(table(spark, sf_dir, "documents"), [P_CARDS, P_DIGITS])
    e = S.unnest(out, ["doc_id"], "entities", "e").select("doc_id", "e.label", F.col("e.start").cast("bigint").alias("start"), F.element_at("e.events", -1).alias("x"))
    return e.where("x.kind = 'redaction'").select("doc_id", "label", "start", F.col("x.attribution.source_id").alias("source_id"), F.col("x.attribution.name").alias("policy"))


@query(O.redacted(CLUSTERED, "CASE label WHEN 'payment_card' THEN '[card]' WHEN 'phone_number' THEN '[phone]' ELSE '[id]' END").replace("n AS (SELECT doc_id, count(*) AS n FROM w", "n AS (SELECT doc_id, count(*) AS n FROM c2"))
def policy_cluster_text(spark, sf_dir):
    """A cluster is replaced as one, over all that its members cover."""
    return _run(spark, sf_dir, [P_CARDS, P_DIGITS], CLUSTER_ENGINE)


@query(f"WITH {O.winners(relevant(PATTERNS, compile_catalog([P_TABLE, P_COARSE])))} SELECT CASE WHEN label IN ('email_address', 'phone_number') THEN 'table' END AS name, CASE WHEN label IN ('email_address', 'phone_number') THEN {O.quote(P_TABLE.rules[0].id)} END AS source_id, CASE label WHEN 'email_address' THEN 'erase' WHEN 'phone_number' THEN 'replace' END AS operator, count(*) AS n FROM w WHERE label IN ('email_address', 'phone_number') GROUP BY ALL")
def policy_attribution_counts(spark, sf_dir):
    out = Engine().run(table(spark, sf_dir, "documents"), [P_TABLE, P_COARSE])
    x = S.unnest(S.unnest(out, [], "entities", "e"), [], "e.events", "x").where("x.kind = 'redaction'")
    return x.groupBy(F.col("x.attribution.name").alias("name"), F.col("x.attribution.source_id").alias("source_id"), F.col("x.operator").alias("operator")).agg(F.count("*").alias("n"))


# -- templates ----------------------------------------------------------------


def _template_patterns(t: templates.Template) -> list[Pattern]:
    return relevant(PATTERNS, compile_catalog([t.policy]))


def _template(name: str, t: templates.Template, replacement: str, keep: str = "true", engine: Engine = Engine(), show=None) -> None:
    def run(spark, sf_dir):
        out = _run(spark, sf_dir, [t.policy], engine)
        return out.withColumn("redacted", show(F.col("redacted"))) if show else out

    run.__name__ = name
    patterns = _template_patterns(t)
    plain = "SELECT doc_id, text AS redacted, 0::BIGINT AS n_entities FROM documents"
    query(O.redacted(patterns, replacement, keep) if patterns else plain)(run)


_AGES = "CASE WHEN label = 'age' THEN CASE WHEN value::INT >= 90 THEN '90 or older' ELSE value END WHEN label IN ('date_of_birth', 'individual_date') THEN CASE WHEN try_strptime(value, '%Y-%m-%d') IS NULL THEN '' ELSE substr(value, 1, 4) END ELSE {rest} END"
_template("template_ccpa", templates.ccpa(), "''")
_template("template_hipaa_safe_harbor", templates.hipaa(), _AGES.format(rest="''"))
_template("template_hipaa_lds", templates.hipaa("limited_data_set"), "''")
_ED = templates.hipaa("expert_determination")
_COREF = "('c' || substr(md5(label || '|' || lower(value)), 1, 12))"
_template("template_hipaa_expert", _ED, _AGES.format(rest=_pseudonym_sql(_ED.policy.id, "doc_id::VARCHAR", "label", _COREF)))
_template("template_gdpr_erase", templates.gdpr(), "''")
_template("template_pci_truncate", templates.pci_pan("truncate"), "CASE WHEN len(value) > 10 THEN substr(value, 1, 6) || right(value, 4) ELSE '' END")
_template("template_pci_hmac256", templates.pci_pan("hmac_sha256"), _hmac_sql("value"), engine=KEYED)
_template("template_pci_sav", templates.pci_sav(), "''")


#: Fixed values, written out from the regulations' templates: id, day it took effect, rules, labels, fallback.
_TEMPLATES = """SELECT template_id, '1.0.0' AS version, effective_date, n_rules::BIGINT AS n_rules, n_labels::BIGINT AS n_labels, fallback FROM (VALUES
('hipaa_deid_safe_harbor', '2003-04-14', 1, 34, 'erase'),
('hipaa_deid_safe_harbor_extended_accounts', '2003-04-14', 1, 35, 'erase'),
('hipaa_deid_limited_data_set', '2003-04-14', 0, 29, 'erase'),
('hipaa_deid_limited_data_set_extended_accounts', '2003-04-14', 0, 30, 'erase'),
('hipaa_deid_expert_determination', '2003-04-14', 1, 34, 'pseudonymize'),
('hipaa_deid_expert_determination_extended_accounts', '2003-04-14', 1, 35, 'pseudonymize'),
('gdpr_article_9_erase', '2018-05-25', 0, 17, 'erase'),
('gdpr_article_9_erase_reid_hardened', '2018-05-25', 0, 25, 'erase'),
('gdpr_article_9_erase_with_article_10', '2018-05-25', 0, 28, 'erase'),
('gdpr_article_9_pseudonymize', '2018-05-25', 0, 17, 'pseudonymize'),
('gdpr_article_9_pseudonymize_reid_hardened', '2018-05-25', 0, 25, 'pseudonymize'),
('gdpr_article_9_pseudonymize_with_article_10', '2018-05-25', 0, 28, 'pseudonymize'),
('pci_dss_pan_truncate', '2022-03-31', 0, 1, 'truncate'),
('pci_dss_pan_truncate_last_four', '2022-03-31', 0, 1, 'truncate'),
('pci_dss_pan_hmac_sha256', '2025-03-31', 0, 1, 'hmac_hash'),
('pci_dss_pan_hmac_sha512', '2025-03-31', 0, 1, 'hmac_hash'),
('pci_dss_sav_erase', '2022-03-31', 0, 3, 'erase'),
('ccpa', '2020-01-01', 0, 49, 'erase')) v(template_id, effective_date, n_rules, n_labels, fallback)"""


@query(_TEMPLATES)
def template_label_catalog(spark, sf_dir):
    return _longs(templates.frame(spark).drop("name")).withColumn("effective_date", F.col("effective_date").cast("string"))


def _rest_of_the_templates() -> None:
    """The configurations without a query of their own."""
    pseudonym = lambda t: _pseudonym_sql(t.policy.id, "doc_id::VARCHAR", "label", _COREF)
    for scope in templates.GDPR_SCOPES[1:]:
        _template(f"template_gdpr_erase_{scope}", templates.gdpr("erase", scope), "''")
    for scope in templates.GDPR_SCOPES:
        t = templates.gdpr("pseudonymize", scope)
        _template(f"template_gdpr_pseudonymize_{scope}", t, pseudonym(t))
    _template("template_pci_last_four", templates.pci_pan("truncate_last_four"), "CASE WHEN len(value) > 4 THEN right(value, 4) ELSE '' END")
    _template("template_hipaa_safe_harbor_extended", templates.hipaa("safe_harbor", "extended"), _AGES.format(rest="''"))
    _template("template_hipaa_lds_extended", templates.hipaa("limited_data_set", "extended"), "''")
    t = templates.hipaa("expert_determination", "extended")
    _template("template_hipaa_expert_extended", t, _AGES.format(rest=pseudonym(t)))
    # DuckDB has no SHA-512: redact_hmac_sha512 holds digests against a published one, this query where they stand
    _template("template_pci_hmac512", templates.pci_pan("hmac_sha512"), "'<128 hex digits>'", engine=KEYED, show=lambda x: F.regexp_replace(x, "[0-9a-f]{128}", "<128 hex digits>"))


_rest_of_the_templates()


def _catalog_sql() -> str:
    rows = ", ".join(f"({O.quote(k)}, {O.quote(v.category)}, {len(v.tags)}::BIGINT, {str('pii' in v.tags).lower()})" for k, v in builtin().labels.items())
    return f"SELECT * FROM (VALUES {rows}) v(label, category, n_tags, is_pii)"


@query(_catalog_sql())
def catalog_labels(spark, sf_dir):
    c = builtin().frame(spark)
    return c.select("label", "category", F.size("tags").cast("bigint").alias("n_tags"), F.array_contains("tags", "pii").alias("is_pii"))


# -- tables -------------------------------------------------------------------

NAMED = Pattern("customer-name", "person_name", r"Customer#[0-9]+", 0.9)
SEGMENT = Pattern("segment", "occupation", r"BUILDING", 0.9)
CELLS = detect.Detection(patterns=(NAMED, SEGMENT))


def _cells(*entries: tuple[str, ModalityRedactions]) -> Policy:
    return Policy(templates.derived_id("suite:cells"), "cells", (Scope("cells", tuple(e[0] for e in entries)),), (Rule(templates.derived_id("suite:rule:cells"), "cells", table=tuple(LabelEntry(*e) for e in entries)),))


def _customer(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_name, 'Customer#[0-9]+') THEN repeat('*', len(c_name) - 3) || right(c_name, 3) ELSE c_name END AS c_name, c_mktsegment FROM customer")
def tabular_cell_mask(spark, sf_dir):
    cell = ModalityRedactions.for_tabular("cell", redaction=text_op("mask", keep_suffix=3))
    return tabular.redact_table(_customer(spark, sf_dir), [_cells(("person_name", cell))], "c_custkey", detection=CELLS)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment NOT LIKE '%BUILDING%'")
def tabular_drop_row(spark, sf_dir):
    return tabular.redact_table(_customer(spark, sf_dir), [_cells(("occupation", ModalityRedactions.for_tabular("drop_row")))], "c_custkey", detection=CELLS)


@query("SELECT c_custkey, c_name FROM customer")
def tabular_drop_column(spark, sf_dir):
    return tabular.redact_table(_customer(spark, sf_dir), [_cells(("occupation", ModalityRedactions.for_tabular("drop_column")))], "c_custkey", detection=CELLS)


@query("SELECT c_custkey, 'c_mktsegment' AS \"column\", 'occupation' AS label, c_mktsegment AS value FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'c_name', 'person_name', c_name FROM customer WHERE regexp_matches(c_name, 'Customer#[0-9]+')")
def tabular_cell_entities(spark, sf_dir):
    return tabular.cell_entities(_customer(spark, sf_dir), "c_custkey", ["c_name", "c_mktsegment"], CELLS).select("c_custkey", "column", "label", "value")


# -- audit --------------------------------------------------------------------


def _audit(spark, sf_dir) -> DataFrame:
    return Engine().run(table(spark, sf_dir, "documents"), [P_COARSE, P_TABLE])


AUDITED = relevant(PATTERNS, compile_catalog([P_COARSE, P_TABLE]))
_ID = "md5(doc_id::VARCHAR || '||text|' || label || '|' || start::VARCHAR || '|' || \"end\"::VARCHAR)"
_UUID = f"substr({_ID}, 1, 8) || '-' || substr({_ID}, 9, 4) || '-' || substr({_ID}, 13, 4) || '-' || substr({_ID}, 17, 4) || '-' || substr({_ID}, 21, 12)"


@query(f"WITH {O.winners(AUDITED)} SELECT doc_id, NULL::VARCHAR AS part_id, 'text' AS modality, {_UUID} AS entity_id, label, printf('%.3f', conf::DOUBLE) AS confidence, {_COREF} AS coref FROM w")
def audit_entities_export(spark, sf_dir):
    return sinks.entities(_audit(spark, sf_dir))


AUDITED_MORE = (*AUDITED, OTHER_DIGITS, Pattern("phone-tail", "phone_number", r"[0-9]{3}-[0-9]{4}", 0.4))
_EVENTS = f"""WITH {O.winners(AUDITED_MORE)}, u AS (SELECT *, {_UUID} AS id, printf('%.3f', conf::DOUBLE) AS c FROM w)
SELECT id AS entity_id, 0::BIGINT AS event_index, 'pattern' AS kind, 'pattern' AS source, c AS confidence, pattern AS payload_id FROM u
UNION ALL SELECT id, 1, 'deduplication', 'reconcile', c, 'overlap' FROM u WHERE merged > 1
UNION ALL SELECT id, 1 + (merged > 1)::INT, 'conflict', 'reconcile', c, 'confidence' FROM u WHERE beaten > 0
UNION ALL SELECT id, 1 + (merged > 1)::INT + (beaten > 0)::INT, 'redaction', 'anonymizer', NULL, NULL FROM u WHERE label IN ('email_address', 'phone_number')"""


@query(_EVENTS)
def audit_provenance_export(spark, sf_dir):
    wide = _policy("wide", ["email_address", "phone_number", "ip_address", "internal_id"])
    engine = Engine(detection=detect.Detection(patterns=AUDITED_MORE))
    audit = engine.run(table(spark, sf_dir, "documents"), [P_COARSE, P_TABLE, wide])
    return _longs(sinks.provenance(audit).select("entity_id", "event_index", "kind", "source", "confidence", "payload_id"))


@query(f"WITH {O.winners(AUDITED)} SELECT {_UUID} AS entity_id, 'text' AS modality, 'mask' AS operator FROM w WHERE label = 'phone_number'")
def audit_reviews_export(spark, sf_dir):
    audit = _audit(spark, sf_dir)
    e = S.unnest(audit, [], "entities", "e")
    action = F.when(F.col("e.label") == "phone_number", json.dumps(ModalityRedactions.for_text("mask").to_json())).otherwise(json.dumps(ModalityRedactions.for_image("blur").to_json()))
    return sinks.reviews(audit, e.select("e.entity_id", action.alias("action")))


@query(f"WITH {O.winners(AUDITED)} SELECT label, source, count(*) AS n FROM w JOIN documents USING (doc_id) GROUP BY ROLLUP (label, source)")
def audit_rollup_label_source(spark, sf_dir):
    audit = Engine().analyze(table(spark, sf_dir, "documents"), [P_COARSE, P_TABLE])
    e = S.unnest(audit, ["source"], "entities", "e").select("source", F.col("e.label").alias("label"))
    return e.rollup("label", "source").agg(F.count("*").alias("n"))


@query("SELECT recognizer, count(*) AS documents, sum(len(text))::BIGINT AS characters FROM documents CROSS JOIN (VALUES ('names'), ('places')) v(recognizer) GROUP BY recognizer")
def audit_usage(spark, sf_dir):
    engine = Engine(ner=(Recognizer("names"), Recognizer("places")))
    return sinks.usage(engine.analyze(table(spark, sf_dir, "documents")))


@query(f"WITH {O.winners(AUDITED)} SELECT l.toxic::BIGINT AS toxic, l.quality::BIGINT AS quality, w.label, count(*) AS n FROM w JOIN labels l USING (doc_id) GROUP BY ALL")
def audit_join_labels(spark, sf_dir):
    e = sinks.entities(_audit(spark, sf_dir)).select("doc_id", "label")
    labels = table(spark, sf_dir, "labels")
    return e.join(labels, "doc_id").groupBy(F.col("toxic").cast("bigint").alias("toxic"), F.col("quality").cast("bigint").alias("quality"), "label").agg(F.count("*").alias("n"))


@query(f"WITH {O.winners(AUDITED)} SELECT doc_id::VARCHAR AS id, count(w.label) AS n_entities, 'auto' AS raster_mode FROM documents LEFT JOIN w USING (doc_id) GROUP BY doc_id")
def audit_json_roundtrip(spark, sf_dir):
    audit = Engine().analyze(table(spark, sf_dir, "documents"), [P_COARSE, P_TABLE])
    back = sinks.from_json(sinks.to_json(audit), audit)
    return back.select("id", F.size("entities").cast("bigint").alias("n_entities"), F.col("context.raster_mode").alias("raster_mode"))


@query(
    """SELECT * FROM (VALUES ('scope twice', 'Configuration'), ('unknown scope', 'Configuration'), ('scope of another policy', 'Configuration'), ('override of no policy', 'Configuration'),
('unknown label', 'Configuration'), ('custom label shadows', 'Configuration'), ('custom labels conflict', 'Configuration'), ('ceiling without bucket', 'Configuration'), ('no key provider', 'Configuration'),
('two OCR readers', 'Configuration'), ('two speech readers', 'Configuration'), ('model without modality', 'Configuration'), ('audit without body', 'Configuration'), ('format without codec', 'CapabilityUnavailable'),
('pages without renderer', 'CapabilityUnavailable'), ('undecodable bytes', 'MalformedInput'), ('unwritable format', 'Redaction'), ('audit without context', 'Processing'), ('sound request', NULL)) v(request, refused)"""
)
def request_checks(spark, sf_dir):
    """What a request is refused with, before any document is read."""
    docs, mail = table(spark, sf_dir, "documents"), ["email_address"]
    inside = Predicate.all_of(Predicate.negate(Predicate.label_in_scope("elsewhere")))
    tag = lambda *tags: (Label("badge", tags),)
    reader = Reader("r")
    requests = {
        "scope twice": lambda: Engine().analyze(docs, [Policy("i", "p", (Scope("s", ("email_address",)), Scope("s", ("url",))))]),
        "unknown scope": lambda: Engine().analyze(docs, [_policy("p", mail, [_rule("r", inside, "erase")])]),
        "scope of another policy": lambda: Engine().analyze(docs, [_policy("p", mail, [_rule("r", Predicate.label_in_scope("elsewhere"), "erase")]), _policy("elsewhere", mail)]),
        "override of no policy": lambda: Engine().anonymize(Engine().analyze(docs, [CONTACT]), [CONTACT], [Override("e", "none", ModalityRedactions.for_text("keep"))]),
        "unknown label": lambda: Engine().analyze(docs, [_policy("p", ["never_heard_of"])]),
        "custom label shadows": lambda: Engine().analyze(docs, [_policy("p", mail, custom=(Label("email_address"),))]),
        "custom labels conflict": lambda: Engine().analyze(docs, [_policy("p", mail, custom=tag()), _policy("q", mail, custom=tag("pii"))]),
        "ceiling without bucket": lambda: text_op("clamp", ceiling=90.0),
        "no key provider": lambda: _run(spark, sf_dir, [_one_op("p", ModalityRedactions.for_text("hmac_hash"))]),
        "two OCR readers": lambda: Engine().with_ocr(reader, reader).analyze(docs),
        "two speech readers": lambda: Engine().with_stt(reader, reader).analyze(docs),
        "model without modality": lambda: Engine().with_llm(Recognizer("m", modalities=())).analyze(docs),
        "audit without body": lambda: Engine().anonymize(docs.select("doc_id"), [CONTACT]),
        "format without codec": lambda: files.modality("jpeg"),
        "pages without renderer": lambda: Engine().analyze(docs, params=AnalyzerParams(raster_mode=RasterMode("force", 150))),
        "undecodable bytes": lambda: files.decode(b"\xff\xfe", "txt"),
        "unwritable format": lambda: rewrite.rewrite(b"%PDF", "pdf", {None: "x"}),
        "audit without context": lambda: sinks.to_json(docs),
        "sound request": lambda: Engine().analyze(docs, [CONTACT]),
    }
    rows = []
    for name, ask in requests.items():
        try:
            ask()
            rows.append((name, None))
        except VeilError as e:
            rows.append((name, e.kind))
    return spark.createDataFrame(rows, "request string, refused string")


# -- pictures, sounds and containers ------------------------------------------


def _made(spark, sf_dir, make: Callable[[int, str], bytes]) -> DataFrame:
    """The nations, each with a file made from its key and name."""

    @F.pandas_udf("binary")
    def content(k, name):
        return k.combine(name, lambda a, b: make(int(a), b))

    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", content("n_nationkey", "n_name").alias("content"))


def _pixel_sum(df: DataFrame) -> DataFrame:
    @F.pandas_udf("bigint")
    def total(c):
        return c.map(lambda data: int(files.png_pixels(bytes(data)).sum()))

    return df.select("n_nationkey", total("content").alias("total"))


#: Each pixel of an 8 x 8 picture, and what an operator makes of the region of 4 x 4 pixels at (2, 1): a block's rounded mean, or a weighted sum of neighbours that stops at the region's edges.
_PIXELS = "SELECT n_nationkey, x, y, c, (n_nationkey * 3 + x * x + y * 11 + c * 5)::DOUBLE AS v FROM nation, range(8) a(x), range(8) b(y), range(3) d(c)"
_GAUSS = "(SELECT d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) OVER () AS k FROM (SELECT unnest(range(-3, 4)) AS d))"
_PICTURES = f"""WITH p AS ({_PIXELS}), r AS (SELECT * FROM p WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 4),
m AS (SELECT n_nationkey, (x - 2) // 2 AS i, (y - 1) // 2 AS j, c, round_even(avg(v), 0) * count(*) AS v FROM r GROUP BY ALL),
h AS (SELECT r.n_nationkey, r.y, r.x, r.c, sum(g.k * q.v) AS v FROM r CROSS JOIN {_GAUSS} g JOIN r q ON q.n_nationkey = r.n_nationkey AND q.c = r.c AND q.x = r.x AND q.y = greatest(1, least(4, r.y + g.d)) GROUP BY ALL),
b AS (SELECT h.n_nationkey, h.y, h.x, h.c, round(sum(g.k * q.v)) AS v FROM h CROSS JOIN {_GAUSS} g JOIN h q ON q.n_nationkey = h.n_nationkey AND q.c = h.c AND q.y = h.y AND q.x = greatest(2, least(5, h.x + g.d)) GROUP BY ALL),
t AS (SELECT n_nationkey, sum(v) AS whole, sum(v) FILTER (NOT (x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 4)) AS rest FROM p GROUP BY n_nationkey)
SELECT t.n_nationkey, o.name AS operator, (CASE o.name WHEN 'erase' THEN rest + 16 * 3 * 255 WHEN 'blackbox' THEN rest WHEN 'keep' THEN whole
  WHEN 'pixelate' THEN rest + (SELECT sum(v) FROM m WHERE m.n_nationkey = t.n_nationkey) ELSE rest + (SELECT sum(v) FROM b WHERE b.n_nationkey = t.n_nationkey) END)::BIGINT AS total
FROM t CROSS JOIN (VALUES ('erase'), ('keep'), ('blur'), ('pixelate'), ('blackbox')) o(name)"""


@query(_PICTURES)
def image_operators(spark, sf_dir):
    import numpy as np

    x, y, c = np.arange(8)[None, :, None], np.arange(8)[:, None, None], np.arange(3)[None, None, :]
    pictures = _made(spark, sf_dir, lambda k, _: files.png_bytes((3 * k + x * x + 11 * y + 5 * c).astype(np.uint8)))
    pictures = pictures.withColumn("regions", F.array(F.struct(*[F.lit(v).alias(n) for n, v in (("x", 2), ("y", 1), ("w", 4), ("h", 4))])))
    settings = {"erase": {}, "keep": {}, "blur": {"sigma": 1.0}, "pixelate": {"block_size": 2}, "blackbox": {}}
    parts = [_pixel_sum(image.redact_images(pictures, Redaction.of("image", kind, **more))).withColumn("operator", F.lit(kind)) for kind, more in settings.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("SELECT n_nationkey, o.name AS operator, CASE o.name WHEN 'erase' THEN 600 ELSE 800 END::BIGINT AS frames, CASE o.name WHEN 'erase' THEN 600 * n_nationkey WHEN 'silence' THEN 600 * n_nationkey WHEN 'keep' THEN 800 * n_nationkey ELSE 600 * n_nationkey + (SELECT sum(round(32767 * 0.5 * sin(2 * pi() * 130 * t / 800))) FROM range(200) x(t)) END::BIGINT AS total FROM nation CROSS JOIN (VALUES ('erase'), ('keep'), ('silence'), ('beep')) o(name)")
def audio_operators(spark, sf_dir):
    import io
    import wave

    import numpy as np

    def clip(k: int, _: str) -> bytes:
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(800)
            w.writeframes(np.full(800, k, np.int16).tobytes())
        return out.getvalue()

    @F.pandas_udf("frames bigint, total bigint")
    def measured(c):
        import pandas as pd

        def one(data):
            with wave.open(io.BytesIO(bytes(data))) as w:
                x = np.frombuffer(w.readframes(w.getnframes()), np.int16)
            return len(x), int(x.sum(dtype=np.int64))

        return pd.DataFrame([one(d) for d in c], columns=["frames", "total"])

    clips = _made(spark, sf_dir, clip).withColumn("intervals", F.array(F.struct(F.lit(0.25).alias("t_start"), F.lit(0.5).alias("t_end"))))
    parts = []
    for kind in ("erase", "keep", "silence", "beep"):
        more = {"hz": 130.0, "amplitude": 0.5, "waveform": "sine"} if kind == "beep" else {}
        m = audio.redact_audio(clips, Redaction.of("audio", kind, **more)).select("n_nationkey", measured("content").alias("m"))
        parts.append(m.select("n_nationkey", F.lit(kind).alias("operator"), "m.frames", "m.total"))
    return functools.reduce(DataFrame.unionByName, parts)


@query("SELECT n_nationkey, NULL::VARCHAR AS part_id, 'text' AS modality, 'About ' || n_name || chr(10) || 'second' AS text FROM nation UNION ALL SELECT n_nationkey, 'word/media/image1.png', 'image', NULL FROM nation")
def source_docx_parts(spark, sf_dir):
    import io
    import zipfile

    def docx(_: int, name: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>About {name}</w:t></w:p><w:p><w:t>second</w:t></w:p></w:document>')
            z.writestr("word/media/image1.png", b"picture")
        return out.getvalue()

    @F.pandas_udf("array<struct<part_id:string,modality:string,text:string>>")
    def parts(c):
        return c.map(lambda data: [{"part_id": p, "modality": m, "text": t} for p, m, t, _ in files.decode(bytes(data), "docx")])

    return S.unnest(_made(spark, sf_dir, docx), ["n_nationkey"], parts("content"), "p").select("n_nationkey", "p.*")


def _zip(members: dict[str, str | bytes]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def _files_of(k: int, name: str) -> dict[str, bytes]:
    """A letter, a workbook, a table and a note about one nation, each with an address."""
    mail, sheet = f"{name.lower().replace(' ', '.')}@mail.example", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    return {
        "docx": _zip({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Write to {mail}</w:t></w:r><w:r><w:t> today</w:t></w:r></w:p><w:p><w:t>second</w:t></w:p></w:document>'}),
        "xlsx": _zip({"xl/sharedStrings.xml": f'<sst xmlns="{sheet}"><si><t>{mail}</t></si></sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{sheet}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>{k}</v></c></row></sheetData></worksheet>'}),
        "csv": f'name,"mail, if any"\n{name},{mail}\n'.encode(),
        "rtf": f"{{\\rtf1 {{\\fonttbl x;}}To \\b {mail}\\b0\\par second}}".encode(),
        "txt": f"To {mail}".encode(),
    }


@query(
    """WITH m AS (SELECT n_nationkey, n_name, '[mail]' AS mail FROM nation)
SELECT n_nationkey, 'docx' AS extension, NULL::VARCHAR AS part_id, 'Write to ' || mail || ' today' || chr(10) || 'second' AS text FROM m
UNION ALL SELECT n_nationkey, 'xlsx', 'A1', mail FROM m UNION ALL SELECT n_nationkey, 'xlsx', 'C1', n_nationkey::VARCHAR FROM m
UNION ALL SELECT n_nationkey, 'csv', 'A1', 'name' FROM m UNION ALL SELECT n_nationkey, 'csv', 'B1', 'mail, if any' FROM m UNION ALL SELECT n_nationkey, 'csv', 'A2', n_name FROM m UNION ALL SELECT n_nationkey, 'csv', 'B2', mail FROM m
UNION ALL SELECT n_nationkey, 'rtf', NULL, 'To ' || mail || chr(10) || 'second' FROM m UNION ALL SELECT n_nationkey, 'txt', NULL, 'To ' || mail FROM m"""
)
def source_files_redacted(spark, sf_dir):
    """Files of five formats read, redacted, written in their own format and read again; a file in which the address is left raises."""
    kinds = ("docx", "xlsx", "csv", "rtf", "txt")
    made = [_made(spark, sf_dir, lambda k, name, e=e: _files_of(k, name)[e]).withColumn("extension", F.lit(e)) for e in kinds]
    sources = functools.reduce(DataFrame.unionByName, made).withColumn("file", F.concat("n_nationkey", F.lit("."), "extension"))

    made = sources.select("file", "extension", F.lit(None).cast("timestamp").alias("modified"), F.octet_length("content").cast("bigint").alias("length"), "content")
    policy = _one_op("files", ModalityRedactions.for_text("replace", template="[mail]"), ["email_address"])
    written = Engine().redact_files(made, [policy])
    whole = F.when(F.contains("content", F.lit("@mail").cast("binary")), F.raise_error(F.lit("an address is left"))).otherwise(F.col("content"))
    again = files.parts_of(made.drop("content").join(written.select("file", whole.alias("content")), "file"))
    return again.select(F.split("file", "[.]")[0].cast("int").alias("n_nationkey"), "extension", "part_id", "text")


# -- streams ------------------------------------------------------------------

EVENT_KEY = Pattern("event-key", "internal_id", r"\"k\": ?[0-9]+", 0.9, inner=r"[0-9]+$")
EVENT_POLICY = _policy("events", ["internal_id"], fallback=ModalityRedactions.for_text("replace", template="#"))
EVENT_ENGINE = Engine(detection=detect.Detection(patterns=(EVENT_KEY,)))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return streaming.read_folder(spark, sf_dir, schema, pattern="events.parquet")


@query(r"""SELECT event_id, regexp_replace(props, '("k": ?)[0-9]+', '\1#', 'g') AS redacted FROM events""")
def stream_redact_events(spark, sf_dir):
    stream = streaming.redact_stream(_event_stream(spark, sf_dir), [EVENT_POLICY], EVENT_ENGINE, "event_id", "props", run_secret=SECRET)
    return _drained(spark, stream.select("event_id", "redacted"))


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All of a stream's output, through a file sink with a checkpoint in the shared folder."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise configuration("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
    base = f"{base.rstrip('/')}/streams-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="sparkveil-stream-")
    streaming.run_once(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("SELECT h AS window_start, 'internal_id' AS label, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS h, max(time_bucket(INTERVAL '1 hour', ts)) OVER () AS last, max(ts) OVER () AS m, props FROM events) WHERE regexp_matches(props, '\"k\": ?[0-9]+') AND h + INTERVAL '1 hour' <= m - INTERVAL '10 minutes' GROUP BY h")
def stream_window_entity_counts(spark, sf_dir):
    stream = _event_stream(spark, sf_dir)
    found = EVENT_ENGINE.analyze(stream.withColumn("ts", F.col("ts").cast("timestamp")), [EVENT_POLICY], id_col="event_id", text_col="props")
    counts = streaming.window_counts(found)
    return _drained(spark, counts).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(O.redacted(COMMON_PATTERNS, "'[' || label || ']'", table="(SELECT conv_id * 1000000 + turn AS doc_id, conv_id, turn, text FROM conversations)", extra=", d.conv_id, d.turn").replace("SELECT d.doc_id, ", "SELECT "))
def conversation_redact(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 1000000 + F.col("turn"))
    out = Engine().run(c, [_one_op("conversations", ModalityRedactions.for_text("replace"))])
    return out.select("conv_id", "turn", "redacted", F.size("entities").cast("bigint").alias("n_entities"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CCPA over documents: ids, redacted texts, number of entities."""
    return QUERIES["template_ccpa"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
