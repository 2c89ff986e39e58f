"""Profiles and city files: JSON texts to rubrics and tables of areas, with errors that name the place by its dotted path."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .model import Landmark, Range, Rubric, Scaled

#: Weights that answers of a first questionnaire stand for.
ANSWERS = {"important": 12.0, "nice": 6.0, "indifferent": 0.0, "avoid": -8.0, "rather_not": -3.0}
NUMBERS = ["rent_max", "rent_min", "area_min", "lease_months_min", "total_monthly_max", "unverified_penalty"]
TEXTS = ["currency", "area_unit", "available_by", "unknown_policy"]


def _document(text: str, kind: str) -> Mapping[str, Any]:
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{kind} at <root>: no JSON (line {e.lineno}, column {e.colno})") from e
    if not isinstance(found, Mapping):
        raise ValueError(f"{kind} at <root>: no mapping")
    return found


def _number(value: Any, at: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise ValueError(f"profile at {at}: no number")
    return float(value)


def rubric(text: str) -> Rubric:
    """A profile's rubric. Unknown keys are errors, so that a misspelt one isn't silently no criterion."""
    p = dict(_document(text, "profile"))
    out: dict[str, Any] = {k: _number(p.pop(k), k) for k in NUMBERS if p.get(k) is not None}
    for k in TEXTS:
        if p.get(k) is not None:
            if not isinstance(p[k], str):
                raise ValueError(f"profile at {k}: no text")
            out[k] = p.pop(k)
    if "lease_months_min" in out:
        out["lease_months_min"] = int(out["lease_months_min"])
    for k in ("beds", "baths", "floor"):
        if (r := p.pop(k, None)) is not None:
            if not isinstance(r, Mapping) or set(r) - {"eq", "min", "max"}:
                raise ValueError(f"profile at {k}: eq, or min and max")
            out[k] = Range(**{x: _number(v, f"{k}.{x}") for x, v in r.items()})
    for k in ("areas", "exclude"):
        if (x := p.pop(k, None)) is not None:
            out[k] = tuple(map(str, x))
    for k in ("require_laundry", "require_parking"):
        if (x := p.pop(k, None)) is not None:
            if not isinstance(x, bool):
                raise ValueError(f"profile at {k}: true or false")
            out[k] = x
    if (w := p.pop("weights", None)) is not None:
        out["weights"] = {k: Scaled(_number(v.get("rate"), f"weights.{k}.rate"), _number(v.get("cap"), f"weights.{k}.cap")) if isinstance(v, Mapping) else _number(v, f"weights.{k}") for k, v in w.items()}
    if (w := p.pop("area_key_weights", None)) is not None:
        out["area_key_weights"] = {k: _number(v, f"area_key_weights.{k}") for k, v in w.items()}
    if (m := p.pop("landmark", None)) is not None:
        out["landmark"] = Landmark(str(m.get("name", "")), *(_number(m.get(x), f"landmark.{x}") for x in ("lat", "lng", "within_km", "weight")))
    left = sorted(k for k in p if k not in ("city", "name", "schedule") and p[k] is not None)
    if left:
        raise ValueError(f"profile at {left[0]}: unknown")
    return Rubric(**out)


def weights_of_answers(answers: Mapping[str, str], rules: Mapping[str, str]) -> dict[str, float]:
    """First weights, of answers by topic; rules names each topic's rule. An answer that isn't known is an error, an indifferent one no weight."""
    out = {}
    for topic, answer in answers.items():
        if answer not in ANSWERS:
            raise ValueError(f"answers at {topic}: {answer}")
        if ANSWERS[answer] and topic in rules:
            out[rules[topic]] = ANSWERS[answer]
    return out


def areas(spark: SparkSession, text: str) -> tuple[str, DataFrame, DataFrame]:
    """Of a city file its name; key, label, west, south, east, north of its areas; keyword, key of their keywords."""
    c = _document(text, "city")
    if not isinstance(c.get("name"), str) or not c["name"].strip():
        raise ValueError("city at name: no text")
    rows, words = [], []
    for i, a in enumerate(c.get("areas") or []):
        box = a.get("bbox") if isinstance(a, Mapping) else None
        if not isinstance(box, list) or len(box) != 4 or not all(isinstance(x, int | float) for x in box) or box[0] > box[2] or box[1] > box[3]:
            raise ValueError(f"city at areas.{i}.bbox: south, west, north, east")
        if not isinstance(a.get("key"), str) or not a["key"]:
            raise ValueError(f"city at areas.{i}.key: no text")
        rows.append((a["key"], a.get("label") or a["key"], float(box[1]), float(box[0]), float(box[3]), float(box[2])))
        words += [(str(w).strip(), a["key"]) for w in a.get("keywords") or [] if str(w).strip()]
    return c["name"].strip(), spark.createDataFrame(rows, "key string, label string, west double, south double, east double, north double"), spark.createDataFrame(words, "keyword string, key string")


def consistent(profile: str, city: str, known_areas: set[str]) -> list[str]:
    """A profile is of its city, else it is an error; weights of areas that the city doesn't have are warnings."""
    p = _document(profile, "profile")
    if str(p.get("city", "")).strip().lower() != city.strip().lower():
        raise ValueError(f"profile at city: {p.get('city')!r} isn't {city!r}")
    return [f"no area {k}" for k in (p.get("area_key_weights") or {}) if k not in known_areas]
