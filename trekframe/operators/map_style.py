"""Map styles (JSON texts) with a track's sources and layers put in; each function may be applied again without effect.

A style is one small text, so these are plain functions for the driver or for a column of texts, not set operators.
Our layers are taken out of the style first and stacked anew, so the order of calls does not matter: relief shading lies
before the first symbol layer, routes and waypoint circles before the labels that end the style, captions above all.
"""

from __future__ import annotations

import json

# Terrain tiles and their deepest zoom, exaggeration and colours.
TERRAIN_TILES = "https://s3.amazonaws.com/elevation-tiles-prod/terrarium/{z}/{x}/{y}.png"
TERRAIN_CREDIT, TERRAIN_ZOOM, EXAGGERATION = "Elevation: AWS Terrain Tiles / Mapzen", 15, 1.35
TRACK_COLOR, CASING_COLOR, WAYPOINT_COLOR = "#FF5A00", "#12140F", "#0B6E4F"
FONT = "Noto Sans Regular"

TERRAIN, TRACK, GRADIENT, WAYPOINTS = "trek-terrain", "trek-track", "trek-gradient", "trek-waypoints"
_SHADE, _CAPTIONS = "trek-shade", "trek-captions"
#: Layers between the map and its labels, from below.
_ROUTES = ("trek-track-casing", "trek-track-line", "trek-gradient-casing", "trek-gradient-line", "trek-waypoint-circles")


def _symbol(layer: dict) -> bool:
    return layer.get("type") == "symbol"


def _stacked(style: dict, layers: list[dict]) -> str:
    """The style with these layers of ours besides those it has."""
    ours, rest = {}, []
    for layer in style.get("layers", []):
        if layer.get("id") in {_SHADE, _CAPTIONS, *_ROUTES}:
            ours[layer["id"]] = layer
        else:
            rest.append(layer)
    ours |= {layer["id"]: layer for layer in layers}
    shade_at = next((i for i, layer in enumerate(rest) if _symbol(layer)), len(rest))
    labels_at = len(rest)
    while labels_at and _symbol(rest[labels_at - 1]):
        labels_at -= 1
    pick = lambda *names: [ours[x] for x in names if x in ours]
    below, between, above = rest[:shade_at], rest[shade_at:labels_at], rest[labels_at:]
    style["layers"] = [*below, *pick(_SHADE), *between, *pick(*_ROUTES), *above, *pick(_CAPTIONS)]
    return json.dumps(style)


def _with_source(style: str, name: str, source: dict) -> dict:
    out = json.loads(style)
    out.setdefault("sources", {})[name] = source
    return out


def _line(name: str, source: str, color, width: float) -> dict:
    layout, paint = {"line-cap": "round", "line-join": "round"}, {"line-color": color, "line-width": width}
    return {"id": name, "type": "line", "source": source, "layout": layout, "paint": paint}


def _geojson(text: str) -> dict:
    return {"type": "geojson", "data": json.loads(text)}


def with_terrain(style: str, exaggeration: float = EXAGGERATION) -> str:
    """A style with heights, relief shading and a sky."""
    source = {"type": "raster-dem", "tiles": [TERRAIN_TILES], "encoding": "terrarium", "tileSize": 256, "maxzoom": TERRAIN_ZOOM, "attribution": TERRAIN_CREDIT}
    out = _with_source(style, TERRAIN, source)
    out["terrain"] = {"source": TERRAIN, "exaggeration": exaggeration}
    out["sky"] = {"sky-color": "#88C6FC", "horizon-color": "#F0E9D8", "fog-color": "#F0E9D8", "sky-horizon-blend": 0.6}
    return _stacked(out, [{"id": _SHADE, "type": "hillshade", "source": TERRAIN, "paint": {"hillshade-exaggeration": 0.4}}])


def with_track(style: str, geojson: str, color: str = TRACK_COLOR) -> str:
    """A style with a track's feature as a line on a darker, wider one."""
    out = _with_source(style, TRACK, _geojson(geojson))
    return _stacked(out, [_line(_ROUTES[0], TRACK, CASING_COLOR, 7.0), _line(_ROUTES[1], TRACK, color, 4.0)])


def with_gradients(style: str, geojson: str) -> str:
    """A style with a collection of gradient features, each in the colour among its properties."""
    out = _with_source(style, GRADIENT, _geojson(geojson))
    return _stacked(out, [_line(_ROUTES[2], GRADIENT, CASING_COLOR, 7.0), _line(_ROUTES[3], GRADIENT, ["get", "color"], 4.0)])


def with_waypoints(style: str, geojson: str) -> str:
    """A style with a collection of waypoints as circles with captions."""
    out = _with_source(style, WAYPOINTS, _geojson(geojson))
    circle = {"circle-radius": 7.0, "circle-color": WAYPOINT_COLOR, "circle-stroke-width": 2.0, "circle-stroke-color": "#FFFFFF"}
    text = {"text-field": ["get", "label"], "text-font": [FONT], "text-size": 12.0, "text-offset": [0, 1.3], "text-anchor": "top"}
    captions = {"id": _CAPTIONS, "type": "symbol", "source": WAYPOINTS, "layout": text, "paint": {"text-halo-color": "#FFFFFF", "text-halo-width": 1.5}}
    return _stacked(out, [{"id": _ROUTES[4], "type": "circle", "source": WAYPOINTS, "paint": circle}, captions])


def with_terrain_and_track(style: str, geojson: str | None = None, exaggeration: float = EXAGGERATION, color: str = TRACK_COLOR) -> str:
    """Both; without a track the terrain alone."""
    relief = with_terrain(style, exaggeration)
    return relief if geojson is None else with_track(relief, geojson, color)
