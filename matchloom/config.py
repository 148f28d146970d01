"""Settings of a run: field profiles, weights, thresholds and rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# The fields of a canonical record; id identifies a query, ein a reference entry.
FIELDS = ["id", "ein", "name", "dba", "division", "street", "unit", "city", "county", "state", "zip5", "zip_plus4", "active"]
# Which fields each profile compares; blocked and scored by name besides.
GEO_PROFILES = {
    "state": ["state"], "city_state": ["city", "state"], "county_state": ["county", "state"], "zip_city_state": ["zip5", "city", "state"],
    "street_full": ["street", "city", "state", "zip5"], "street_unit_full": ["street", "unit", "city", "state", "zip5"],
}
# Weights of geographic agreements, and of fields by profile.
GEO_WEIGHTS = {"zip9": 1.00, "street": 0.95, "zip5": 0.90, "pobox": 0.90, "zip3": 0.55, "city": 0.50, "state": 0.20}
FIELD_WEIGHTS = {
    "state": {"name": 1.0}, "city_state": {"name": 0.70, "city": 0.30}, "county_state": {"name": 0.70, "county": 0.30},
    "zip_city_state": {"name": 0.55, "zip5": 0.25, "city": 0.20}, "street_full": {"name": 0.45, "street": 0.25, "zip5": 0.15, "city": 0.15},
    "street_unit_full": {"name": 0.45, "street": 0.22, "unit": 0.06, "zip5": 0.14, "city": 0.13},
}
#: Field -> the normalized column whose similarity stands for it.
COMPARED = {"name": "name_key", "street": "street_key", "unit": "street_unit", "city": "city", "county": "county", "zip5": "zip5"}


@dataclass(frozen=True)
class Config:
    # The defaults of thresholds and weights.
    yes: float = 0.78
    maybe: float = 0.65
    min_margin: float = 0.05
    tie_band: float = 0.05
    tie_high: float = 0.95
    tiebreak: str = "name"
    distinct_name_maxfreq: int = 3
    distinct_name_floor: float = 0.90
    distinct_name_floor_xstate: float = 0.72
    overlap_maybe_floor: float = 0.80
    similarity_floor: float = 0.85
    overlap_idf_min: float = 9.0
    name_weight: float = 0.6
    geo_weight: float = 0.4
    geo_weights: dict = field(default_factory=lambda: dict(GEO_WEIGHTS))
    weights: dict = field(default_factory=lambda: {k: dict(v) for k, v in FIELD_WEIGHTS.items()})
    rules: tuple | None = None
