"""Detection and redaction end to end on a small text, operator values, spans, audits, tables, streams."""

import csv
import datetime
import glob
import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkveil import AnalyzerParams, Dictionary, Engine, KeyProvider, LabelEntry, ModalityRedactions, Override, Policy, Predicate, Reader, Recognizer, Rule, Scope, ScopeParams, VeilError
from sparkveil.functions import spans as S
from sparkveil.functions import crypto
from sparkveil.functions.text import Match, build
from sparkveil.operators import reconcile, tabular
from sparkveil.operators.detect import Detection
from sparkveil.operators.recognizers import PATTERNS, Pattern, check_dictionaries, dictionary_spans, load_prompt, pattern_spans, relevant, with_automaton
from sparkveil.plans import templates
from sparkveil.plans.policy import text_op
from sparkveil.sources import sinks
from sparkveil.streaming import redact as streaming

SAMPLE = "Contact Jane Doe at jane.doe@example.com or +1-415-555-0142.\nHer SSN is 123-45-6789 and she lives at 123 Main St, San Francisco.\nReach the office at office@example.com or +1-415-555-0199."
FOUND = ["jane.doe@example.com", "+1-415-555-0142", "123-45-6789", "office@example.com", "+1-415-555-0199"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, SAMPLE), (2, None), (3, "")], "doc_id bigint, text string")


def redacted(df, doc=1):
    return df.where(F.col("doc_id") == doc).first().redacted


def policy(name, labels, rules=(), fallback=None):
    return Policy(f"id-{name}", name, (Scope(f"s-{name}", tuple(labels)),), tuple(rules), fallback)


def rule(predicate, kind, name="r", **params):
    return Rule(f"id-{name}", name, predicate, ModalityRedactions.for_text(kind, **params))


# -- detection ----------------------------------------------------------------


def test_analyze_finds_patterns(docs):
    rows = {r.doc_id: r for r in Engine().analyze(docs).collect()}
    assert [e.value for e in rows[1].entities] == FOUND
    assert [SAMPLE[e.start : e.end] for e in rows[1].entities] == FOUND
    assert rows[2].entities == rows[3].entities == []
    assert len({e.entity_id for e in rows[1].entities}) == 5 and rows[1].usage == []


def test_vocabulary_restricts_detection(docs):
    p = policy("mail", ["email_address"])
    assert {e.label for e in Engine().analyze(docs, [p]).where("doc_id = 1").first().entities} == {"email_address"}
    assert {x.label for x in relevant(PATTERNS, None)} == {x.label for x in PATTERNS}
    assert not [x for x in relevant(PATTERNS, None, ("FR",)) if "US" in x.countries]


def test_context_is_mirrored(docs):
    params = AnalyzerParams(ScopeParams(("de",), ("DE", "AT"), ("t",), "audit", ("a",)))
    c = Engine().analyze(docs, params=params).first().context
    assert (c.languages, c.countries, c.tags, c.purpose, c.audience, c.raster_mode) == (["de"], ["DE", "AT"], ["t"], "audit", ["a"], "auto")
    assert Engine().analyze(docs, params=params).where("doc_id = 1").first().entities[0].language == "de"


def test_checksums_context_and_inner(spark):
    rows = spark.createDataFrame([(0, "4111 1111 1111 1111"), (1, "4111 1111 1111 1112"), (2, "my visa card 4111111111111111"), (3, "IBAN DE89 3704 0044 0532 0130 00"), (4, "IBAN DE89 3704 0044 0532 0130 01"), (5, 'token = "abcdef0123456789"'), (6, "born on 1984-07-09, aged 97")], "doc_id bigint, text string")
    got = {r.doc_id: [(e.label, e.value, round(e.confidence, 2)) for e in r.entities] for r in Engine().analyze(rows).collect()}
    assert got[0] == [("payment_card", "4111 1111 1111 1111", 0.6)] and got[1] == []
    assert got[2] == [("payment_card", "4111111111111111", 0.85)]
    assert got[3] == [("iban", "DE89 3704 0044 0532 0130 00", 0.95)] and not [x for x in got[4] if x[0] == "iban"]
    assert got[5] == [("password", 'abcdef0123456789"', 0.8)]
    assert got[6] == [("date_of_birth", "1984-07-09", 0.85), ("age", "97", 0.7)]


def test_annotations(spark):
    kind = "array<struct<start:int,end:int,label:string>>"
    rows = spark.createDataFrame([(1, SAMPLE, [(0, 30, "x")], [(8, 16, "person_name")]), (2, SAMPLE, None, None)], f"doc_id bigint, text string, keep_out {kind}, given {kind}")
    found = Engine().analyze(rows, params=AnalyzerParams(inclusions="given")).orderBy("doc_id").collect()
    assert ("person_name", "Jane Doe") in [(e.label, e.value) for e in found[0].entities] and len(found[1].entities) == 5
    found = Engine().analyze(rows, params=AnalyzerParams(exclusions="keep_out")).orderBy("doc_id").collect()
    assert [e.value for e in found[0].entities] == FOUND[1:] and len(found[1].entities) == 5


def test_models_and_dictionaries(docs):
    def names(texts):
        return [[(t.index("Jane"), t.index("Jane") + 8, "person_name", 0.9)] if "Jane" in t else [] for t in texts]

    engine = Engine().with_ner(Recognizer("names", "local", names), Recognizer("nothing")).with_dictionaries(Dictionary("towns", "city", ("San Francisco", "Main")))
    r = engine.analyze(docs).where("doc_id = 1").first()
    assert {("person_name", "Jane Doe"), ("city", "San Francisco"), ("city", "Main")} <= {(e.label, e.value) for e in r.entities}
    assert r.usage == ["names", "nothing"]
    large = Dictionary("many", "city", ("San Francisco", "Jane", "ohn", *(f"zz{i}" for i in range(400))))
    r = Engine().with_dictionaries(large).analyze(docs).where("doc_id = 1").first()
    assert {e.value for e in r.entities if e.label == "city"} == {"San Francisco", "Jane"}
    with pytest.raises(VeilError, match="limits"):
        check_dictionaries([Dictionary("d", "city", tuple(map(str, range(100_001))))])


def test_registered_and_formats(spark):
    engine = Engine().with_ner(Recognizer("a", "p", description="d")).with_ocr(Reader("o"))
    assert {tuple(r) for r in engine.registered(spark).collect()} == {("ner", "a", "d", "p"), ("ocr", "o", None, "mock")}
    assert "docx" in engine.formats
    with pytest.raises(VeilError, match="modality"):
        Engine().with_llm(Recognizer("l", modalities=())).analyze(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))
    with pytest.raises(VeilError, match="at most one"):
        Engine().with_ocr(Reader("a"), Reader("b")).analyze(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))


def test_prompts(tmp_path):
    (tmp_path / "p.txt").write_text("from file")
    assert load_prompt(None, "d") == "d" and load_prompt({"kind": "inline", "template": "t"}, "d") == "t"
    assert load_prompt({"kind": "file", "path": str(tmp_path / "p.txt")}, "d") == "from file"


# -- policies on the sample ---------------------------------------------------


@pytest.mark.parametrize("t", [templates.ccpa(), templates.hipaa(), templates.hipaa("limited_data_set")], ids=lambda t: t.id)
def test_erasing_templates(docs, t):
    out = redacted(Engine().run(docs, [t.policy]))
    assert not [x for x in FOUND if x in out] and "123 Main St" in out


def test_other_templates(docs):
    expert = redacted(Engine().run(docs, [templates.hipaa("expert_determination").policy]))
    assert not [x for x in FOUND if x in expert] and "email_address_" in expert
    for t in (templates.gdpr(), templates.pci_pan(), templates.pci_sav()):
        assert redacted(Engine().run(docs, [t.policy])) == SAMPLE
    keyed = templates.pci_pan("hmac_sha256").policy
    audit = Engine().analyze(docs, [keyed])
    with pytest.raises(VeilError, match="KeyProvider"):
        Engine().anonymize(audit, [keyed])
    assert redacted(Engine().with_key_provider(KeyProvider.static(b"k")).anonymize(audit, [keyed])) == SAMPLE


def test_table_rule_and_events(docs):
    table = Rule("rid", "t", table=(LabelEntry("email_address", ModalityRedactions.for_text("erase")), LabelEntry("phone_number", ModalityRedactions.for_text("replace", template="[phone]"))))
    out = Engine().run(docs, [policy("p", ["email_address", "phone_number"], [table])]).where("doc_id = 1").first()
    assert "[phone]" in out.redacted and "example.com" not in out.redacted
    last = [e.events[-1] for e in out.entities]
    assert {x.kind for x in last} == {"redaction"} and {x.attribution.source_id for x in last} == {"rid"} and {x.operator for x in last} == {"erase", "replace"}


def test_scopes_tags_and_two_passes(docs):
    scoped = Policy("i", "n", (Scope("contact", ("email_address", "phone_number")),), (rule(Predicate.label_in_scope("contact"), "erase"),))
    assert "555" not in redacted(Engine().run(docs, [scoped])) and "123-45-6789" in redacted(Engine().run(docs, [scoped]))
    a = policy("a", ["email_address"], [rule(Predicate.tag_one_of("pii"), "erase")])
    out = redacted(Engine().run(docs, [a, policy("b", ["phone_number"])]))
    assert "example.com" not in out and "555-0142" in out
    coarse = policy("a", ["email_address", "phone_number"], fallback=ModalityRedactions.for_text("erase"))
    fine = policy("b", ["email_address"], [rule(Predicate.label_one_of("email_address"), "replace", template="[replaced-email]")])
    out = redacted(Engine().run(docs, [coarse, fine]))
    assert out.count("[replaced-email]") == 2 and "555" not in out


def test_overrides_come_first(spark, docs):
    p = policy("a", ["email_address", "phone_number"], fallback=ModalityRedactions.for_text("erase"))
    audit = Engine().analyze(docs, [p])
    first = audit.where("doc_id = 1").first().entities[0]
    keep = Override(first.entity_id, p.id, ModalityRedactions.for_text("keep"))
    out = Engine().anonymize(audit, [p], [keep]).where("doc_id = 1").first()
    assert FOUND[0] in out.redacted and FOUND[1] not in out.redacted
    why = out.entities[0].events[-1].attribution
    assert (why.name, why.description, why.source_id) == (p.id, "reviewer override", first.entity_id)
    rows = spark.createDataFrame([(1, first.entity_id, p.id, json.dumps(keep.action.to_json()))], "doc_id bigint, entity_id string, policy_id string, action string")
    assert redacted(Engine().anonymize(audit, [p], rows)) == out.redacted
    pictures = Override(first.entity_id, p.id, ModalityRedactions.for_image("blur"))
    assert FOUND[0] not in redacted(Engine().anonymize(audit, [p], [pictures]))
    with pytest.raises(VeilError, match="wasn't submitted"):
        Engine().anonymize(audit, [p], [Override("x", "other", ModalityRedactions.for_text("keep"))])
    with pytest.raises(VeilError, match="no body"):
        Engine().anonymize(docs, [p])


def test_no_key_shows_in_a_plan(docs):
    p = policy("h", ["email_address"], fallback=ModalityRedactions.for_text("hmac_hash"))
    df = Engine().with_key_provider(KeyProvider.static(b"topsecretkey")).run(docs, [p])
    plan = df._jdf.queryExecution().toString().lower()
    assert b"topsecretkey".hex() not in plan and "topsecretkey" not in plan and crypto.pads(b"topsecretkey", "sha256")[0].hex() not in plan


# -- operator values ----------------------------------------------------------


def apply(spark, op, value, label="x", coref=None, language=None, strict=False, policy_id="p", keys=None):
    df = spark.createDataFrame([(value, label, coref, language)], "v string, l string, c string, g string")
    if keys:
        df = df.crossJoin(crypto.key_table(spark, keys))
    m = Match(F.col("v"), F.col("l"), F.col("c"), F.col("g"), F.lit(""), F.col(crypto.KEYS) if keys else None)
    return df.select(build(op, m, policy_id, strict).alias("o")).first().o


PAN = "4111111111111234"


@pytest.mark.parametrize(
    "op, value, expected",
    [
        (text_op("erase"), "x", ""),
        (text_op("keep"), "x", "x"),
        (text_op("truncate", keep_prefix=6, keep_suffix=4), PAN, "4111111234"),
        (text_op("truncate", keep_suffix=4), PAN, "1234"),
        (text_op("truncate", keep_prefix=10, keep_suffix=10), PAN, ""),
        (text_op("mask", keep_prefix=6, keep_suffix=4), PAN, "411111******1234"),
        (text_op("mask", mask_char="#"), "é😀", "##"),
        (text_op("mask", keep_prefix=2, keep_suffix=2), "abc", "***"),
        (text_op("replace"), "v", "[x]"),
        (text_op("replace", template="{label}:{value}"), "{label}", "x:{label}"),
        (text_op("hash", salt="s"), "v", hashlib.sha256(b"sv").hexdigest()),
        (text_op("hash", algorithm="sha512"), "v", hashlib.sha512(b"v").hexdigest()),
        (text_op("generalize_date"), "1984-07-09", "1984"),
        (text_op("generalize_date"), "2024-02-30", ""),
        (text_op("generalize_date"), "last May", ""),
        (text_op("generalize_date", fallback=text_op("keep")), "last May", "last May"),
        (text_op("generalize_date", granularity="month"), "1984-07-09", "1984-07"),
    ],
)
def test_operator_values(spark, op, value, expected):
    assert apply(spark, op, value) == expected


CLAMP = text_op("clamp", ceiling=90.0, ceiling_bucket="90 or older")


@pytest.mark.parametrize("value, expected", [("90", "90 or older"), ("97", "90 or older"), ("73", "73"), ("ninety", ""), ("91d", ""), ("NaN", ""), ("Infinity", ""), ("-5", "-5"), ("9e1", "90 or older"), ("1e400", "")])
def test_clamp(spark, value, expected):
    assert apply(spark, CLAMP, value) == expected


def test_clamp_buckets(spark):
    formatted = text_op("clamp", ceiling=90.0, ceiling_bucket={"format": "{n} or older"})
    assert apply(spark, formatted, "95") == "90 or older"
    local = text_op("clamp", ceiling=90.0, ceiling_bucket={"en": "old", "fr": "vieux"}, floor=5.0, floor_bucket="young")
    assert apply(spark, local, "95", language="fr-FR") == "vieux" and apply(spark, local, "95", language="de") == "old" and apply(spark, local, "3") == "young"
    assert apply(spark, text_op("clamp", ceiling=1.0, ceiling_bucket="b", fallback=text_op("replace")), "x") == "[x]"


def test_strict_truncate_raises(spark):
    with pytest.raises(Exception, match="truncate"):
        apply(spark, text_op("truncate", keep_prefix=10, keep_suffix=10), PAN, strict=True)


@pytest.mark.parametrize("algorithm, key", [("sha256", b"k"), ("sha512", b"k"), ("sha256", b"x" * 200), ("sha512", b"y" * 200)])
def test_hmac_is_standard(spark, algorithm, key):
    inner, outer = crypto.pads(key, algorithm)
    keys = {f"{algorithm}_inner": inner, f"{algorithm}_outer": outer}
    assert apply(spark, text_op("hmac_hash", algorithm=algorithm), "välue", keys=keys) == hmac.new(key, "välue".encode(), algorithm).hexdigest()


def test_encrypt_round_trip(spark):
    key = bytes(range(32))
    box = apply(spark, text_op("encrypt"), "secret é", keys={"encrypt": key})
    df = spark.createDataFrame([(box,)], "b string").crossJoin(crypto.key_table(spark, {"good": key, "bad": bytes(32)}))
    r = df.select(crypto.decrypt(F.col("b"), F.col(crypto.KEYS)["good"]).alias("g"), crypto.decrypt(F.col("b"), F.col(crypto.KEYS)["bad"]).alias("x")).first()
    assert r.g == "secret é" and r.x is None


def test_pseudonyms_and_fakes(spark):
    inner, outer = crypto.pads(b"s", "sha256")
    keys = {"pseudonym_inner": inner, "pseudonym_outer": outer}
    op = text_op("pseudonymize")
    one = apply(spark, op, "Jane", "person_name", "c1", keys=keys)
    assert one == apply(spark, op, "J. Doe", "person_name", "c1", keys=keys) and one.startswith("person_name_")
    assert one != apply(spark, op, "Jane", "person_name", "c1", keys=keys, policy_id="q")
    fake = text_op("fake", seed=3)
    assert apply(spark, fake, "Jane", "person_name", "c1") == apply(spark, fake, "Doe", "person_name", "c1")
    assert apply(spark, fake, "v", "no_such_label") == "[no_such_label]"
    assert len({apply(spark, text_op("fake", seed=s), "Jane", "person_name") for s in range(8)}) > 1


# -- spans --------------------------------------------------------------------


def spans_frame(spark, sets):
    return spark.createDataFrame([(i, "x" * 60, s) for i, s in enumerate(sets)], f"i int, t string, s {S.SPANS}")


def random_spans(rng, n):
    return [(a, a + rng.randint(1, 12), "", rng.choice("ab"), rng.choice([0.25, 0.5, 0.75]), "p", "q", 1, 0) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, n)))]


def naive_merge(spans):
    out = []
    for label in sorted({s[3] for s in spans}):
        own = []
        for s in sorted((s for s in spans if s[3] == label), key=lambda s: (s[0], -s[1])):
            if own and s[0] < own[-1][1]:
                own[-1] = (own[-1][0], max(own[-1][1], s[1]), label, max(own[-1][3], s[4]))
            else:
                own.append((s[0], s[1], label, s[4]))
        out += own
    return out


def naive_winners(spans):
    out = []
    for s in sorted(spans, key=lambda s: (-s[3], -(s[1] - s[0]), s[0], s[2])):
        if not [k for k in out if s[0] < k[1] and k[0] < s[1]]:
            out.append(s)
    return sorted(out)


def test_merging_and_winners_equal_plain_versions(spark):
    rng = random.Random(2)
    sets = [random_spans(rng, 8) for _ in range(200)]
    df = spans_frame(spark, sets)
    merged = S.merge_same_label(F.col("t"), F.col("s"))
    got = df.select("i", merged.alias("m"), S.resolve_overlaps(F.col("t"), merged).alias("w"), S.resolve_overlaps(F.col("t"), merged, "union").alias("u")).collect()
    for r in got:
        key = lambda x: (x.start, x.end, x.label, x.confidence)
        expected = naive_merge(sets[r.i])
        assert sorted(map(key, r.m)) == sorted(expected)
        assert [key(x) for x in r.w] == naive_winners(expected)
        covered = {p for a, z, *_ in expected for p in range(a, z)}
        assert {p for x in r.u for p in range(x.start, x.end)} == covered
        assert all(a.end <= b.start for a, b in zip(r.u, r.u[1:]))
    assert all(sum(x.merged for x in r.m) == len(sets[r.i]) and sum(x.beaten > 0 for x in r.w) <= len(r.m) for r in got)
    again = df.select("i", S.merge_same_label(F.col("t"), merged).alias("m"), merged.alias("o")).collect()
    assert all(r.m == r.o for r in again)
    rows = df.select("i", F.explode("s").alias("x")).select("i", "x.label", "x.start", "x.end", "x.confidence")
    table = reconcile.merge_same_label(rows, ["i"]).collect()
    for i, s in enumerate(sets):
        assert sorted((r.start, r.end, r.label, r.confidence) for r in table if r.i == i) == sorted(naive_merge(s))


def test_cluster_winners_and_exclusion(spark):
    rows = spark.createDataFrame([(1, 0, 10, "a", 0.5), (1, 5, 12, "b", 0.9), (1, 12, 15, "a", 0.1)], "d int, start int, end int, label string, confidence double")
    got = {(r.start, r.label): (r.winner, r.wins) for r in reconcile.cluster_winners(rows, ["d"]).collect()}
    assert got == {(0, "a"): ("b", False), (5, "b"): ("b", True), (12, "a"): ("a", True)}
    out = spark.createDataFrame([(1, 10, 12)], "d int, start int, end int")
    assert [r.start for r in reconcile.outside(rows, out, "d").orderBy("start").collect()] == [0, 12]


def test_matches_have_exact_offsets(spark):
    texts = ["", "a1b22c333", "1", "11 22", "é😀7x8", "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    p = Pattern("n", "x", "[0-9]+", 0.5)
    for r in df.select("i", pattern_spans(F.col("t"), p).alias("s")).collect():
        t = texts[r.i]
        assert all(t[x.start : x.end] == x.value for x in r.s)
        assert [x.value for x in r.s] == __import__("re").findall("[0-9]+", t)


def test_splice_keeps_every_gap(spark):
    rng = random.Random(3)
    sets = [[s for s in naive_winners([(a[0], a[1], a[3], a[4]) for a in random_spans(rng, 6)])] for _ in range(60)]
    text = "".join(chr(97 + i % 26) for i in range(60))
    df = spark.createDataFrame([(i, text, [(a, z) for a, z, *_ in s]) for i, s in enumerate(sets)], "i int, t string, s array<struct<start:int,end:int>>")
    for r in df.select("i", S.splice(F.col("t"), F.col("s"), lambda x: F.lit("_")).alias("o")).collect():
        expected, at = "", 0
        for a, z, *_ in sets[r.i]:
            expected, at = expected + text[at:a] + "_", z
        assert r.o == expected + text[at:]


# -- audit exports ------------------------------------------------------------


def read_csv(path):
    rows = [list(csv.reader(open(f))) for f in sorted(glob.glob(f"{path}/*.csv"))]
    return rows[0][0], [r for part in rows for r in part[1:]]


def test_exports(spark, docs, tmp_path):
    p = policy("p", ["email_address", "phone_number"], fallback=ModalityRedactions.for_text("erase"))
    audit = Engine().run(docs, [p])
    at = datetime.datetime(2024, 1, 2, tzinfo=datetime.timezone.utc)
    sinks.write_entities_csv(audit, str(tmp_path / "e"))
    head, rows = read_csv(tmp_path / "e")
    assert head == ["part_id", "modality", "entity_id", "label", "confidence", "coref"] and len(rows) == 4
    assert {r[4] for r in rows} == {"0.950", "0.850"} and [r[2] for r in rows] == sorted(r[2] for r in rows)
    sinks.write_provenance_csv(audit, str(tmp_path / "p"), at)
    head, rows = read_csv(tmp_path / "p")
    assert head == ["entity_id", "event_index", "kind", "source", "confidence", "timestamp", "payload_id"] and len(rows) == 8
    assert {(r[2], r[6]) for r in rows} == {("pattern", "email"), ("pattern", "phone-international"), ("redaction", "")}
    e = audit.select(F.explode("entities").alias("e")).select("e.entity_id", F.lit('{"text": {"kind": "mask"}}').alias("action"))
    sinks.write_reviews_csv(audit, e, str(tmp_path / "r"))
    head, rows = read_csv(tmp_path / "r")
    assert head == ["entity_id", "modality", "operator"] and len(rows) == 4 and {r[2] for r in rows} == {"mask"}
    sinks.write_reviews_csv(audit, e.limit(0), str(tmp_path / "n"))
    assert read_csv(tmp_path / "n") == (head, [])
    kinds = {r.operator for r in sinks.reviews(audit, e.withColumn("action", F.lit('{"image": {"kind": "blur"}}'))).collect()}
    assert kinds == set()


def test_json_round_trip_needs_context(spark, docs, tmp_path):
    audit = Engine().analyze(docs)
    texts = sinks.to_json(audit)
    back = sinks.from_json(texts, audit).collect()
    assert sorted(len(r.entities) for r in back) == [0, 0, 5]
    assert {r.context.raster_mode for r in back} == {"auto"}
    broken = texts.withColumn("audit", F.lit('{"id": "1", "entities": []}'))
    with pytest.raises(Exception, match="context"):
        sinks.from_json(broken, audit).collect()
    with pytest.raises(VeilError, match="context"):
        sinks.to_json(docs)
    sinks.write_json(audit, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 3


def test_provenance_hashes_chain(docs):
    audit = Engine().run(docs, [policy("p", ["email_address"], fallback=ModalityRedactions.for_text("erase"))])
    rows = sinks.provenance(audit).collect()
    assert len({r.hash for r in rows}) == len(rows) == 4
    assert rows == sinks.provenance(audit).collect()


# -- tables and streams -------------------------------------------------------


def test_tables(spark):
    rows = spark.createDataFrame([(1, "a@b.com", "call +1-415-555-0142 now"), (2, "none", None), (3, "c@d.org x", "y")], "id int, mail string, note string")
    cell = Rule("r", "r", table=(LabelEntry("email_address", ModalityRedactions.for_tabular("cell", redaction=text_op("replace"))),))
    got = tabular.redact_table(rows, [policy("p", ["email_address", "phone_number"], [cell])], "id").orderBy("id").collect()
    assert [r.mail for r in got] == ["[email_address]", "none", "[email_address] x"] and got[0].note == "call +1-415-555-0142 now" and got[1].note is None
    drop = Rule("r", "r", table=(LabelEntry("phone_number", ModalityRedactions.for_tabular("drop_row")), LabelEntry("email_address", ModalityRedactions.for_tabular("drop_column"))))
    got = tabular.redact_table(rows, [policy("p", ["email_address", "phone_number"], [drop])], "id")
    assert got.columns == ["id", "note"] and sorted(r.id for r in got.collect()) == [2, 3]
    text_only = policy("p", ["email_address"], fallback=ModalityRedactions.for_text("erase"))
    assert tabular.redact_table(rows, [text_only], "id").orderBy("id").first().mail == "a@b.com"
    found = tabular.cell_entities(rows, "id", ["mail", "note"], Detection()).collect()
    assert {(r.id, r.column, r.value) for r in found} == {(1, "mail", "a@b.com"), (3, "mail", "c@d.org"), (1, "note", "+1-415-555-0142")}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    p = templates.ccpa().policy
    batch = Engine().run(spark.read.parquet(f"{sf_dir}/documents.parquet"), [p])
    stream = streaming.read_folder(spark, sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet").schema, pattern="documents.parquet")
    out = streaming.redact_stream(stream, [p], run_secret=b"tests").select("doc_id", "redacted")
    streaming.run_once(out, str(tmp_path / "o"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.exceptAll(batch.select("doc_id", "redacted")).count() == 0 and got.count() == batch.count()


def test_detection_stays_in_one_stage(spark, sf_dir):
    plan = Engine().run(spark.read.parquet(f"{sf_dir}/documents.parquet"), [templates.ccpa().policy]).select("doc_id", "redacted")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "lang" not in plan.split("ReadSchema")[1].split("\n")[0]


# -- overlaps, dictionaries, what may leave ----------------------------------------


def long_spans(n):
    """``n`` spans of two labels, neighbours overlapping in pairs."""
    return [(4 * k + d, 4 * k + d + 3, "x" * 3, "ab"[d], 0.5 + d / 4, "pattern", "p", 1, 0) for k in range(n // 2) for d in (0, 1)]


@pytest.mark.parametrize("n", [2 * S.CHUNK, 1001])
def test_folds_over_many_spans_equal_plain_versions(spark, n):
    spans = long_spans(n)
    df = spans_frame(spark, [spans])
    merged = S.merge_same_label(F.col("t"), F.col("s"))
    r = df.select(merged.alias("m"), S.resolve_overlaps(F.col("t"), merged).alias("w"), S.resolve_overlaps(F.col("t"), merged, "union").alias("u")).first()
    assert len(r.m) == len(spans) and [(x.start, x.end, x.label) for x in r.w] == [s[:3] for s in naive_winners([(x[0], x[1], x[3], x[4]) for x in spans])]
    assert [(x.start, x.end, x.beaten) for x in r.u] == [(4 * k, 4 * k + 4, 1) for k in range(n // 2)]


def test_running_values_over_chunks(spark):
    values = [(k * 37) % 11 for k in range(3 * S.CHUNK + 5)]
    df = spark.createDataFrame([(values,), ([],), ([4],)], "v array<int>")
    got = [r.x for r in df.select(S.running(F.col("v"), "int", F.lit(0), lambda a, x: a + x).alias("x")).collect()]
    assert got == [[sum(values[:k]) for k in range(len(values))], [], [0]]


def test_a_text_with_many_matches(spark):
    n = 5000
    text = " ".join(f"u{i}@x.org" for i in range(n)) + " end"
    p = policy("mail", ["email_address"], fallback=ModalityRedactions.for_text("replace", template="<{value}>"))
    out = Engine().run(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), [p]).first()
    assert len(out.entities) == n and out.redacted == " ".join(f"<u{i}@x.org>" for i in range(n)) + " end"


OVERLAPPING = (Pattern("long", "payment_card", "[0-9]{4} [0-9]{4}", 0.6), Pattern("tail", "phone_number", "[0-9]{4}-[0-9]{3}", 0.5), Pattern("word", "city", "[A-Z][a-z]+", 0.7))


def test_what_overlaps_is_covered_whole(spark):
    d = spark.createDataFrame([(1, "a 1111 2222-333 Rome"), (2, None), (3, "none")], "doc_id bigint, text string")
    p = policy("p", ["payment_card", "phone_number", "city"], fallback=ModalityRedactions.for_text("replace", template="[{label}]"))
    out = {k: Engine(detection=Detection(patterns=OVERLAPPING, span_policy=k)).run(d, [p]) for k in ("union", "winner", "cluster")}
    assert redacted(out["union"]) == redacted(out["cluster"]) == "a [payment_card] [city]"
    assert redacted(out["winner"]) == "a [payment_card]-333 [city]"
    assert redacted(Engine(detection=Detection(patterns=OVERLAPPING)).run(d, [p])) == redacted(out["union"])


def test_a_cluster_records_the_winner_on_every_member(spark):
    d = spark.createDataFrame([(1, "a 1111 2222-333 Rome"), (2, None)], "doc_id bigint, text string")
    first = policy("first", ["phone_number", "city"], [rule(Predicate.label_one_of("phone_number"), "mask", "phones")])
    second = policy("second", ["payment_card"], [rule(Predicate.label_one_of("payment_card"), "erase", "cards")])
    engine = Engine(detection=Detection(patterns=OVERLAPPING, span_policy="cluster"))
    audit = engine.analyze(d, [first, second])
    out = engine.anonymize(audit, [first, second]).where("doc_id = 1").first()
    assert out.redacted == "a  Rome"
    events = {e.label: [x for x in e.events if x.kind == "redaction"] for e in out.entities}
    assert {k: [(x.operator, x.attribution.source_id, x.attribution.name) for x in v] for k, v in events.items()} == {"payment_card": [("erase", "id-cards", "second")], "phone_number": [("erase", "id-cards", "second")], "city": []}
    # a member with a decision stands in for a stronger one without
    only = engine.anonymize(audit, [policy("first", ["phone_number", "payment_card"], [rule(Predicate.label_one_of("phone_number"), "mask", "phones")])]).where("doc_id = 1").first()
    assert only.redacted == "a " + "*" * 13 + " Rome"
    one = next(e for e in audit.where("doc_id = 1").first().entities if e.label == "payment_card")
    given = engine.anonymize(audit, [first, second], [Override(one.entity_id, second.id, ModalityRedactions.for_text("keep"))]).where("doc_id = 1").first()
    assert given.redacted == "a 1111 2222-333 Rome"
    assert {x.attribution.source_id for e in given.entities for x in e.events if x.kind == "redaction"} == {one.entity_id}


def test_dictionaries_find_the_same_at_any_size(spark):
    terms = ("New York", "York", "new", "Österreich", "c++", "(x)", "a_b", "naïve", "K")
    texts = ["new york newer New YORK, York", "ÖSTERREICH Österreich österreich", "c++ c+++ c++x xc++ (x)(X)a", "a_b a_bc _a_b a_B", "NAÏVE naïve naïvely", "k K K1 K", "yorkYork Yorké éYork", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    small = Dictionary("d", "city", terms)
    large = Dictionary("d", "city", terms + tuple(f"filler{k}" for k in range(400)))
    a = df.select("i", dictionary_spans(F.col("text"), small).alias("s")).orderBy("i").collect()
    b = with_automaton(df, "text", "s", [large]).orderBy("i").collect()
    key = lambda r: [(x.start, x.end, x.value) for x in r.s or []]
    assert [key(r) for r in a] == [key(r) for r in b]
    assert [[v for *_, v in key(r)] for r in a] == [["new york", "New YORK", "York"], ["ÖSTERREICH", "Österreich"], ["c++", "c++", "c++", "(x)", "(X)"], ["a_b", "a_B"], ["naïve"], ["k", "K"], ["York", "York"], [], []]


def test_what_may_leave_holds_no_source_text(spark, tmp_path):
    d = spark.createDataFrame([(1, "mail jane@x.org now", "en")], "doc_id bigint, text string, lang string")
    out = Engine().run(d, [policy("mail", ["email_address"], fallback=ModalityRedactions.for_text("erase"))])
    sinks.write_redacted(out, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.columns == ["doc_id", "text", "lang"] and back.first().text == "mail  now"
    assert not any(b"jane" in p.read_bytes() for p in (tmp_path / "r").rglob("*") if p.is_file())


def test_streams_need_a_secret(docs):
    with pytest.raises(TypeError):
        streaming.redact_stream(docs, [])
    with pytest.raises(VeilError, match="secret"):
        streaming.redact_stream(docs, [], run_secret=b"")


def test_override_decisions_are_bounded(docs, monkeypatch):
    from sparkveil.operators import redact

    p = policy("mail", ["email_address"], fallback=ModalityRedactions.for_text("erase"))
    audit = Engine().analyze(docs, [p])
    action = F.concat(F.lit('{"text": {"kind": "replace", "template": "'), F.col("e.start").cast("string"), F.lit('"}}'))
    given = S.unnest(audit, ["doc_id"], "entities", "e").select("doc_id", "e.entity_id", F.lit(p.id).alias("policy_id"), action.alias("action"))
    out = redacted(Engine().anonymize(audit, [p], given))
    assert f"at {SAMPLE.index('jane')} or" in out and "example.com" not in out
    monkeypatch.setattr(redact, "LITERAL_OVERRIDES", 1)
    with pytest.raises(VeilError, match="different override"):
        Engine().anonymize(audit, [p], given)


def test_a_table_may_name_labels_that_never_match(docs):
    p = Policy("id-t", "t", (Scope("t", ("email_address",)),), (Rule("id-r", "r", table=(LabelEntry("never_heard_of", ModalityRedactions.for_text("keep")), LabelEntry("email_address", ModalityRedactions.for_text("erase")))),))
    assert "example.com" not in redacted(Engine().run(docs, [p]))


def test_prompts_reach_the_model(docs):

    def find(texts, prompts):
        assert [p.split("|")[1] for p in prompts] == texts and all(p.startswith("Find names in |") for p in prompts)
        return [[(t.index("Jane"), t.index("Jane") + 4, "person_name", 0.9)] if "Jane" in t else [] for t in texts]

    engine = Engine().with_llm(Recognizer("asked", "remote", find, prompt={"kind": "inline", "template": "Find names in |{{ text }}|"}))
    assert "Jane" in [e.value for e in engine.analyze(docs).where("doc_id = 1").first().entities]
    assert Recognizer("x", prompt={"kind": "default"}).prepared().prompt.endswith("{{ text }}")
    for bad in ("{{ secret }}", "{% for x in y %}"):
        with pytest.raises(VeilError):
            Engine().with_llm(Recognizer("x", prompt=bad)).analyze(docs)
