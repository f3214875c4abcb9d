"""Pictures and sounds as text: a plug-in reads them, text detection runs, and what it finds maps back to regions and intervals.

An OCR plug-in gives the words of a picture with their boxes, a speech plug-in
the segments of a clip with their times. At most one of each runs, before any
text detection; a mock reads nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import decide
from ..plans.catalog import compile_catalog
from ..plans.policy import AnalyzerParams, Policy
from . import audio, image
from .detect import Detection, with_entities
from .redact import decided

WORDS = "array<struct<start:int,end:int,x:int,y:int,w:int,h:int>>"
SEGMENTS = "array<struct<start:int,end:int,t_start:double,t_end:double>>"


@dataclass(frozen=True)
class Reader:
    """``read`` takes a list of file contents and gives for each a list of pieces: (text, x, y, w, h) for pictures, (text, t_start, t_end) for sounds."""

    name: str
    read: Callable[[list[bytes]], list[list[tuple]]] | None = field(default=None, repr=False)
    provider: str = "mock"
    description: str | None = None


def _with_text(df: DataFrame, reader: Reader, content_col: str, names: Sequence[str], kind: pa.DataType, schema: str) -> DataFrame:
    at = df.columns.index(content_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = b.column(at).to_pylist()
            read = reader.read([c or b"" for c in contents]) if reader.read else [[] for _ in contents]
            texts, layouts = [], []
            for pieces in read:
                text, layout = "", []
                for word, *place in pieces:
                    start = len(text) + bool(text)
                    text = f"{text} {word}" if text else word
                    layout.append(dict(zip(names, place), start=start, end=start + len(word)))
                texts.append(text)
                layouts.append(layout)
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string()), pa.array(layouts, pa.list_(kind))], [*b.schema.names, "text", "layout"])

    out = df.withColumns({"text": F.lit("").cast("string"), "layout": F.array().cast(schema)}).schema
    return df.mapInArrow(run, out)


def read_pictures(df: DataFrame, reader: Reader, content_col: str = "content") -> DataFrame:
    """``df`` with the text of its pictures and the box of each word."""
    kind = pa.struct([(n, pa.int32()) for n in ("start", "end", "x", "y", "w", "h")])
    return _with_text(df, reader, content_col, ("x", "y", "w", "h"), kind, WORDS)


def read_sounds(df: DataFrame, reader: Reader, content_col: str = "content") -> DataFrame:
    """``df`` with the transcript of its clips and the times of each segment."""
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("t_start", pa.float64()), ("t_end", pa.float64())])
    return _with_text(df, reader, content_col, ("t_start", "t_end"), kind, SEGMENTS)


def places(entity: Column, layout: Column) -> Column:
    """The pieces of a layout that an entity overlaps."""
    return F.filter(layout, lambda p: (p["start"] < entity["end"]) & (entity["start"] < p["end"]))


def _decided_places(df: DataFrame, policies: Sequence[Policy], modality: str, detection: Detection, params: AnalyzerParams, id_col: str):
    catalog = compile_catalog(policies)
    slots = decide.slots(policies, modality)
    found = with_entities(df, detection.pruned(catalog, params.scope.countries), params, id_col, "text")
    found = found.withColumn("entities", F.transform("entities", lambda e: e.withField("modality", F.lit(modality))))
    return found.withColumn("_decided", decided(F.col("entities"), slots, policies, catalog, None)), slots


def redact_pictures(df: DataFrame, policies: Sequence[Policy], reader: Reader, id_col: str = "doc_id", content_col: str = "content", detection: Detection = Detection(), params: AnalyzerParams = AnalyzerParams()) -> DataFrame:
    """``df`` (PNG contents) with entities, and contents whose decided regions went through their image operators; untouched pictures keep their bytes."""
    columns = df.columns
    out, slots = _decided_places(read_pictures(df, reader, content_col), policies, "image", detection, params, id_col)
    for k, s in enumerate(slots):
        own = F.filter("_decided", lambda x: F.coalesce(x["slot"] == k, F.lit(False)))
        out = out.withColumn("_regions", F.flatten(F.transform(own, lambda x: F.transform(places(x["entity"], F.col("layout")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["w"].alias("w"), p["h"].alias("h"))))))
        out = image.redact_images(out, s.operator, content_col, "_regions").drop("_regions")
    return out.select(*columns, "entities")


def redact_sounds(df: DataFrame, policies: Sequence[Policy], reader: Reader, id_col: str = "doc_id", content_col: str = "content", detection: Detection = Detection(), params: AnalyzerParams = AnalyzerParams()) -> DataFrame:
    """``df`` (WAV contents) with entities, and contents whose decided intervals went through their audio operators.

    Operators that keep the length run first, so that a cut doesn't move the intervals of the others.
    """
    columns = df.columns
    out, slots = _decided_places(read_sounds(df, reader, content_col), policies, "audio", detection, params, id_col)

    def intervals(numbers: list[int]) -> Column:
        own = F.filter("_decided", lambda x: F.coalesce(x["slot"].isin(*numbers), F.lit(False)))
        return F.flatten(F.transform(own, lambda x: F.transform(places(x["entity"], F.col("layout")), lambda p: F.struct(p["t_start"].alias("t_start"), p["t_end"].alias("t_end")))))

    same: dict = {}
    for k, s in enumerate(slots):
        same.setdefault(s.operator, []).append(k)  # all cuts of a clip are one, whichever rules ask for them
    for op, numbers in sorted(same.items(), key=lambda x: x[0].kind == "erase"):
        out = audio.redact_audio(out.withColumn("_intervals", intervals(numbers)), op, content_col, "_intervals").drop("_intervals")
    return out.select(*columns, "entities")
