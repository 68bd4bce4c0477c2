"""GPX files: one file is one row in, points and waypoints out, and back."""

from __future__ import annotations

import itertools
import math
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import format_time, parse_time
from ..schema import GPX_CONTENTS


class GpxError(ValueError):
    """A text that is not a GPX document."""


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files (path, content), each whole in a row as bytes, so that it is read in the encoding it declares."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.to(spark.createDataFrame([], GPX_CONTENTS).schema)


def _name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else ""


def _children(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node if _name(x) == name]


def _text(node: ET.Element | None, name: str) -> str | None:
    found = _children(node, name) if node is not None else []
    return ("".join(found[0].itertext()).strip() or None) if found else None


_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?")


def _number(text: str | None) -> float | None:
    text = (text or "").strip()
    if _NUMBER.fullmatch(text):
        return float(text.rstrip("dDfF"))
    return {"NaN": math.nan, "Infinity": math.inf, "+Infinity": math.inf, "-Infinity": -math.inf}.get(text)


def _point(node: ET.Element) -> tuple | None:
    """(lat, lon, ele, time as text), or nothing if the position cannot be used."""
    lat, lon = _number(node.get("lat")), _number(node.get("lon"))
    if lat is None or lon is None or not (abs(lat) <= 90 and abs(lon) <= 180):
        return None
    return lat, lon, _number(_text(node, "ele")), _text(node, "time")


def _points(node: ET.Element, name: str) -> list[tuple]:
    return [p for p in map(_point, _children(node, name)) if p]


class _Builder(ET.TreeBuilder):
    """Builds trees of documents without a document type."""

    def doctype(self, name, pubid, system):
        raise GpxError("document types are refused")


def parse(xml: str | bytes) -> dict:
    """name, description, segments (lists of points) and waypoints (name, point) of a document.

    Element names are matched without regard to case and namespace.  Segments: of each track its segments, then its
    loose points; all routes after all tracks; empty ones vanish.  Bytes are read in the encoding that they declare
    or begin with; what a text declares is passed over.  Raises GpxError for anything but well-formed GPX without a
    document type.
    """
    if isinstance(xml, str):
        xml = re.sub(r"^\s*<\?xml[^>]*\?>", "", xml.lstrip("\ufeff")).encode("utf-8")
    try:
        root = ET.XML(bytes(xml).lstrip(b" \t\r\n"), ET.XMLParser(target=_Builder()))
    except (ET.ParseError, LookupError, ValueError) as e:
        if isinstance(e, GpxError):
            raise
        raise GpxError(f"not well-formed: {e}") from e
    if _name(root) != "gpx":
        raise GpxError(f"the root is {_name(root)}, not gpx")
    segments = []
    for track in _children(root, "trk"):
        segments += [_points(s, "trkpt") for s in _children(track, "trkseg")] + [_points(track, "trkpt")]
    segments += [_points(route, "rtept") for route in _children(root, "rte")]
    metadata = next(iter(_children(root, "metadata")), None)
    track_names = [n for t in _children(root, "trk") if (n := _text(t, "name"))]
    return {
        "name": _text(metadata, "name") or (track_names or [None])[0] or _text(root, "name"),
        "description": _text(metadata, "desc") or _text(root, "desc"),
        "segments": [s for s in segments if s],
        "waypoints": [(_text(w, "name"), p) for w in _children(root, "wpt") if (p := _point(w))],
    }


#: Rows that a worker hands over at a time, however many files it was given.
ROWS_AT_ONCE = 10_000
_ROW = (
    "track_id string, kind string, part int, idx int, name string, lat double, lon double, ele double, time string, "
    "description string, error string"
)


def _parsed(files: DataFrame) -> DataFrame:
    """Rows of kind document, point, waypoint and error of files: (path, content) or (path, xml)."""
    column = "content" if "content" in files.columns else "xml"
    names = [x.split()[0] for x in _ROW.split(", ")]

    def rows(frames):
        for frame in frames:
            for path, xml in zip(frame["path"], frame[column], strict=True):
                try:
                    found = parse("" if xml is None else xml)
                except GpxError as e:
                    yield path, "error", 0, 0, None, None, None, None, None, None, str(e)
                    continue
                yield path, "document", 0, 0, found["name"], None, None, None, None, found["description"], None
                for part, segment in enumerate(found["segments"]):
                    yield from ((path, "point", part, i, None, *p, None, None) for i, p in enumerate(segment))
                yield from ((path, "waypoint", 0, i, name, *p, None, None) for i, (name, p) in enumerate(found["waypoints"]))

    def run(frames):
        left = rows(frames)
        while some := list(itertools.islice(left, ROWS_AT_ONCE)):
            yield pd.DataFrame(some, columns=names)

    return files.select("path", column).mapInPandas(run, _ROW)


def read_gpx(files: DataFrame) -> dict[str, DataFrame]:
    """points, waypoints, documents (track_id, name, description) and errors (track_id, error) of files: (path, content)
    as of read_files, or (path, xml)."""
    rows = _parsed(files)
    time = parse_time(F.col("time")).alias("time_ms")
    finite = F.when(~F.isnan("ele"), F.col("ele")).alias("ele")
    return {
        "points": rows.filter("kind = 'point'").select(
            "track_id", F.col("part").alias("segment_idx"), F.col("idx").alias("point_idx"), "lat", "lon", finite, time, F.lit(None).cast("double").alias("hacc_m")
        ),
        "waypoints": rows.filter("kind = 'waypoint'").select("track_id", F.col("idx").alias("wpt_idx"), "name", "lat", "lon", finite, time),
        "documents": rows.filter("kind = 'document'").select("track_id", "name", "description"),
        "errors": rows.filter("kind = 'error'").select("track_id", "error"),
    }


def escape(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def _element(name: str, value: Column, indent: int) -> Column:
    """A line, or nothing for a missing value."""
    line = F.concat(F.lit("  " * indent + f"<{name}>"), escape(value), F.lit(f"</{name}>\n"))
    return F.coalesce(line, F.lit(""))


def _place(tag: str, indent: int) -> Column:
    return F.format_string("  " * indent + f'<{tag} lat="%.7f" lon="%.7f">\n', F.col("lat"), F.col("lon"))


def write_gpx(points: DataFrame, documents: DataFrame | None = None, waypoints: DataFrame | None = None, default_name: str = "Track") -> DataFrame:
    """track_id, xml: a GPX 1.1 document a track; documents (track_id, name, description) and waypoints may be given.

    Positions have seven places and heights two; waypoints come first and have no time.
    """
    height = _element("ele", F.format_string("%.2f", F.col("ele")), 4)
    height = F.when(F.col("ele").isNotNull(), height).otherwise("")
    body = F.concat(_place("trkpt", 3), height, _element("time", format_time(F.col("time_ms")), 4), F.lit("      </trkpt>\n"))

    def joined(rows: DataFrame, keys: list[str], order: str, text: Column, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("v"))))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), "").alias(name))

    parts = joined(points, ["track_id", "segment_idx"], "point_idx", body, "text")
    part = F.concat(F.lit("    <trkseg>\n"), F.col("text"), F.lit("    </trkseg>\n"))
    out = joined(parts, ["track_id"], "segment_idx", part, "track")
    if waypoints is not None:
        mark = F.concat(_place("wpt", 1), _element("name", F.col("name"), 2), F.when(F.col("ele").isNotNull(), _element("ele", F.format_string("%.2f", F.col("ele")), 2)).otherwise(""), F.lit("  </wpt>\n"))
        out = out.join(joined(waypoints, ["track_id"], "wpt_idx", mark, "marks"), "track_id", "full")
    else:
        out = out.withColumn("marks", F.lit(None).cast("string"))
    if documents is not None:
        out = out.join(documents.select("track_id", "name", "description"), "track_id", "left")
    else:
        out = out.withColumns({"name": F.lit(None).cast("string"), "description": F.lit(None).cast("string")})
    head = F.lit(
        '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trekframe" xmlns="http://www.topografix.com/GPX/1/1" '
        'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '
        'xsi:schemaLocation="http://www.topografix.com/GPX/1/1 http://www.topografix.com/GPX/1/1/gpx.xsd">\n'
    )
    metadata = F.when(
        F.col("name").isNotNull() | F.col("description").isNotNull(),
        F.concat(F.lit("  <metadata>\n"), _element("name", F.col("name"), 2), _element("desc", F.col("description"), 2), F.lit("  </metadata>\n")),
    ).otherwise("")
    track = F.concat(F.lit("  <trk>\n"), _element("name", F.coalesce("name", F.lit(default_name)), 2), F.col("track"), F.lit("  </trk>\n"))
    xml = F.concat(head, metadata, F.coalesce("marks", F.lit("")), F.coalesce(track, F.lit("")), F.lit("</gpx>\n"))
    return out.select("track_id", xml.alias("xml"))
