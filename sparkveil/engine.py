"""The engine: analyze finds entities, anonymize acts on them under policies."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import configuration
from .functions.crypto import KeyProvider
from .operators import detect, media, redact
from .operators.media import Reader
from .operators.recognizers import Dictionary, Recognizer, check_dictionaries, check_recognizers
from .plans import validate
from .plans.catalog import compile_catalog
from .plans.decide import Override
from .plans.policy import AnalyzerParams, Policy
from .sources.files import FORMATS, RENDERABLE, parts_of
from .sources.rewrite import redacted_files


@dataclass(frozen=True)
class Engine:
    """An immutable set of recognizers and keys; requests share nothing through it."""

    ner: tuple[Recognizer, ...] = ()
    llm: tuple[Recognizer, ...] = ()
    ocr: tuple[Reader, ...] = ()
    stt: tuple[Reader, ...] = ()
    dictionaries: tuple[Dictionary, ...] = ()
    key_provider: KeyProvider | None = None
    detection: detect.Detection = field(default_factory=detect.Detection)

    def with_ner(self, *r: Recognizer) -> Engine:
        return replace(self, ner=r)

    def with_llm(self, *r: Recognizer) -> Engine:
        return replace(self, llm=r)

    def with_ocr(self, *r: Reader) -> Engine:
        return replace(self, ocr=r)

    def with_stt(self, *r: Reader) -> Engine:
        return replace(self, stt=r)

    def with_dictionaries(self, *d: Dictionary) -> Engine:
        return replace(self, dictionaries=d)

    def with_key_provider(self, keys: KeyProvider) -> Engine:
        return replace(self, key_provider=keys)

    @property
    def formats(self) -> tuple[str, ...]:
        return tuple(sorted(FORMATS))

    def registered(self, spark: SparkSession) -> DataFrame:
        """(kind, name, description, provider) of every configured recognizer and enricher; no connection details."""
        rows = [(k, r.name, r.description, r.provider) for k in ("ner", "llm", "ocr", "stt") for r in getattr(self, k)]
        return spark.createDataFrame(rows, "kind string, name string, description string, provider string")

    def _detection(self, policies: Sequence[Policy], params: AnalyzerParams) -> detect.Detection:
        validate.scope_references(policies)
        catalog = compile_catalog(policies)
        validate.at_most_one("OCR", self.ocr)
        validate.at_most_one("STT", self.stt)
        check_recognizers("ner", self.ner)
        check_recognizers("llm", self.llm)
        check_dictionaries(self.dictionaries)
        validate.raster_mode(params.raster_mode, RENDERABLE)
        whole = replace(self.detection, dictionaries=self.detection.dictionaries + self.dictionaries, recognizers=tuple(r.prepared() for r in self.ner + self.llm))
        return whole.pruned(catalog, params.scope.countries)

    def analyze(self, documents: DataFrame, policies: Sequence[Policy] = (), params: AnalyzerParams = AnalyzerParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
        """``documents`` with entities, context and usage. Null text has no entities."""
        d = self._detection(policies, params)
        out = detect.with_entities(documents, d, params, id_col, text_col, lang_col)
        s = params.scope
        strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        context = F.struct(
            strings(s.languages).alias("languages"),
            strings(s.countries).alias("countries"),
            strings(s.tags).alias("tags"),
            F.lit(s.purpose).cast("string").alias("purpose"),
            strings(s.audience).alias("audience"),
            F.lit(params.raster_mode.kind).alias("raster_mode"),
            F.lit(params.raster_mode.dpi).cast("int").alias("dpi"),
        )
        used = [r.name for r in d.recognizers]
        return out.withColumns({"context": context, "usage": strings(used)})

    def anonymize(
        self,
        audit: DataFrame,
        policies: Sequence[Policy],
        overrides: Sequence[Override] | DataFrame | None = None,
        id_col: str = "doc_id",
        text_col: str = "text",
        out: str = "redacted",
        strict: bool = False,
        run_secret: bytes | None = None,
        vault_scope: str = "document",
    ) -> DataFrame:
        """``audit`` (what analyze gave) with the redacted text and redaction events. ``run_secret`` makes pseudonyms repeatable across runs."""
        if "entities" not in audit.columns or text_col not in audit.columns:
            raise configuration("the audit has no body: analyze the documents first")
        validate.scope_references(policies)
        validate.key_provider(policies, self.key_provider is not None)
        if not isinstance(overrides, DataFrame) and overrides:
            validate.override_authorities([o.policy_id for o in overrides], policies)
        catalog = compile_catalog(policies)
        secret = run_secret or (self.key_provider.key("pseudonym") if self.key_provider else hashlib.sha256(uuid.uuid4().bytes).digest())
        return redact.redact_text(audit, policies, catalog, overrides, self.key_provider, secret, id_col, text_col, out, strict, vault_scope, self.detection.span_policy == "cluster")

    def redact_pictures(self, pictures: DataFrame, policies: Sequence[Policy], params: AnalyzerParams = AnalyzerParams(), **options) -> DataFrame:
        """PNG contents under the policies' image operators, read by the configured OCR."""
        d, reader = self._detection(policies, params), validate.at_most_one("OCR", self.ocr)
        return media.redact_pictures(pictures, policies, reader or Reader("none"), detection=d, params=params, **options)

    def redact_sounds(self, clips: DataFrame, policies: Sequence[Policy], params: AnalyzerParams = AnalyzerParams(), **options) -> DataFrame:
        """WAV contents under the policies' audio operators, read by the configured speech recognizer."""
        d, reader = self._detection(policies, params), validate.at_most_one("STT", self.stt)
        return media.redact_sounds(clips, policies, reader or Reader("none"), detection=d, params=params, **options)

    def redact_files(self, sources: DataFrame, policies: Sequence[Policy], params: AnalyzerParams = AnalyzerParams(), run_secret: bytes | None = None) -> DataFrame:
        """(file, extension, content, error) of whole files (what ``list_files`` gives), each in its own format with all its parts redacted.

        Texts and cells go through the policies' text operators, pictures and
        sounds, those inside a document too, through theirs. A file that can't
        be decoded or written has no content and says why. Files are decoded once
        for each kind of part.
        """
        parts = parts_of(sources).withColumn("doc_id", F.concat_ws("/", "file", "part_id"))
        none, shape = F.lit(None), ("file", "part_id", "redacted", "content")
        texts = self.run(parts.where("modality in ('text', 'tabular')").drop("content"), policies, params, run_secret=run_secret).withColumn("content", none.cast("binary"))
        media_ = [f(parts.where(F.col("modality") == kind).select("file", "part_id", "doc_id", "content"), policies, params).withColumn("redacted", none.cast("string")) for kind, f in (("image", self.redact_pictures), ("audio", self.redact_sounds))]
        failed = parts.where("decode_error is not null").select("file", "part_id", none.cast("string").alias("redacted"), none.cast("binary").alias("content"))
        whole = failed
        for df in (texts, *media_):
            whole = whole.unionByName(df.select(*shape))
        return redacted_files(sources, whole)

    def run(self, documents: DataFrame, policies: Sequence[Policy], params: AnalyzerParams = AnalyzerParams(), **options) -> DataFrame:
        """Both steps in one plan."""
        names = {k: options[k] for k in ("id_col", "text_col") if k in options}
        return self.anonymize(self.analyze(documents, policies, params, lang_col=options.pop("lang_col", None), **names), policies, **options)


def documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", extension: str = "txt") -> DataFrame:
    """``df`` in the shape of a document table: an id, the text, an extension and a correlation id made from the id."""
    name = F.md5(F.concat(F.lit("correlation|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    correlation = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return df.withColumns({"doc_id": F.col(id_col), "text": F.col(text_col), "extension": F.lit(extension), "correlation_id": correlation})
