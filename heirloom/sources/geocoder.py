"""A geocoder over HTTP as a place provider.  It is never called unless a caller passes it in."""

from __future__ import annotations

import json
import math
import urllib.parse
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass

from heirloom.functions.places import KINDS

def unresolved(query: str, source: str) -> dict:
    return {"normalized": query, "lat": None, "lon": None, "precisionTier": "unknown", "admin1": None, "admin2": None, "country": None, "confidence": 0.0, "source": source}


def build_request(endpoint: str, agent: str, query: str) -> tuple[str, dict[str, str]]:
    """Address and headers of a search for one place."""
    asked = urllib.parse.urlencode({"q": query, "format": "jsonv2", "addressdetails": "1", "limit": "1"})
    return f"{endpoint}{'&' if '?' in endpoint else '?'}{asked}", {"Accept": "application/json", "User-Agent": agent}


def answer(query: str, payload: object, source: str = "nominatim") -> dict:
    """The first hit of a search as a resolution."""
    if not isinstance(payload, list) or not payload:
        return unresolved(query, source)
    hit: Mapping = payload[0]
    address = hit.get("address") or {}

    def coordinate(x):
        try:
            value = float(x)
        except (TypeError, ValueError):
            return None
        return value if math.isfinite(value) else None

    kind = str(hit.get("addresstype") or hit.get("type") or "").lower()
    weight = hit.get("importance")
    return {
        "normalized": hit.get("display_name") or query, "lat": coordinate(hit.get("lat")), "lon": coordinate(hit.get("lon")),
        "precisionTier": next((tier for tier, kinds in KINDS.items() if kind in kinds), "unknown"),
        "admin1": address.get("state") or address.get("province"), "admin2": address.get("county") or address.get("state_district"), "country": address.get("country"),
        "confidence": min(1.0, max(0.0, float(weight))) if isinstance(weight, (int, float)) and math.isfinite(weight) else 0.0, "source": source,
    }


@dataclass(frozen=True)
class HttpGeocoder:
    """Provider that asks a search service for each query."""

    endpoint: str
    agent: str = "heirloom/0.1"
    timeout: float = 30.0

    def __call__(self, query: str) -> dict:
        url, headers = build_request(self.endpoint, self.agent, query)
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=self.timeout) as reply:  # noqa: S310
            return answer(query, json.load(reply))
