"""Geocoding providers: what asks a service for one address, and stand-ins that need no network."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass
from typing import Protocol

from plotwright.functions.values import LATITUDES, LONGITUDES

Fetch = Callable[[str, float], bytes]


@dataclass(frozen=True)
class Result:
    success: bool
    latitude: float | None = None
    longitude: float | None = None
    corrected_address: str | None = None
    confidence: float | None = None
    source: str | None = None
    status: str = "FAILED"
    message: str | None = None
    raw_response: str | None = None

    def row(self) -> dict:
        return asdict(self)


class Provider(Protocol):
    name: str

    def geocode(self, address: str) -> Result: ...


def inside(latitude: float, longitude: float) -> bool:
    return LATITUDES[0] <= latitude <= LATITUDES[1] and LONGITUDES[0] <= longitude <= LONGITUDES[1]


def fetch(url: str, timeout: float) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": "plotwright"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def settled(name: str, latitude: float, longitude: float, address: str | None, confidence: float, raw: object) -> Result:
    """A result, refused outside the box."""
    if not inside(latitude, longitude):
        return Result(False, source=name, message="outside bounds", raw_response=json.dumps(raw))
    return Result(True, latitude, longitude, address, confidence, name, "GEOCODED", None, json.dumps(raw))


@dataclass
class OpenStreetMap:
    """The first result of a search in one country, at most one request each ``interval`` seconds."""

    base: str = "https://nominatim.openstreetmap.org/search"
    interval: float = 1.1
    timeout: float = 30.0
    get: Fetch = fetch
    name: str = "OSM"
    last: float = float("-inf")

    def geocode(self, address: str) -> Result:
        wait = self.last + self.interval - time.monotonic()
        if wait > 0:
            time.sleep(wait)
        self.last = time.monotonic()
        query = urllib.parse.urlencode({"q": address, "format": "json", "limit": 1, "countrycodes": "us", "addressdetails": 1})
        try:
            found = json.loads(self.get(f"{self.base}?{query}", self.timeout))
            if not found:
                return Result(False, source=self.name, message="no result")
            first = found[0]
            return settled(self.name, float(first["lat"]), float(first["lon"]), first.get("display_name"), min(1.0, max(0.0, float(first.get("importance", 0.5)))), first)
        except (OSError, ValueError, KeyError, TypeError) as e:
            return Result(False, source=self.name, message=str(e))


@dataclass
class Here:
    """The paid fallback; without a key it fails and says so."""

    key: str | None = None
    base: str = "https://geocode.search.hereapi.com/v1/geocode"
    pause: float = 1.0
    timeout: float = 30.0
    get: Fetch = fetch
    name: str = "HERE"

    def geocode(self, address: str) -> Result:
        if not self.key:
            return Result(False, source=self.name, message="no key")
        time.sleep(self.pause)
        query = urllib.parse.urlencode({"q": address, "apiKey": self.key, "in": "countryCode:USA", "limit": 1})
        try:
            items = json.loads(self.get(f"{self.base}?{query}", self.timeout)).get("items") or []
            if not items:
                return Result(False, source=self.name, message="no result")
            first = items[0]
            at = first["position"]
            return settled(self.name, float(at["lat"]), float(at["lng"]), (first.get("address") or {}).get("label"), float((first.get("scoring") or {}).get("queryScore", 0.5)), first)
        except (OSError, ValueError, KeyError, TypeError) as e:
            return Result(False, source=self.name, message=str(e))


@dataclass
class Offline:
    """Answers from a table of known places."""

    places: Mapping[str, tuple[float, float]]
    name: str = "OSM"
    confidence: float = 0.9

    def geocode(self, address: str) -> Result:
        if address not in self.places:
            return Result(False, source=self.name, message="no result")
        return settled(self.name, *self.places[address], address, self.confidence, {"address": address})


@dataclass
class ByRule:
    """Answers by a rule: the place of an address, or None. Unlike a table of places, it does not grow with the addresses."""

    place: Callable[[str], tuple[float, float] | None]
    name: str = "OSM"
    confidence: float = 0.9

    def geocode(self, address: str) -> Result:
        at = self.place(address)
        return Result(False, source=self.name, message="no result") if at is None else settled(self.name, *at, address, self.confidence, {"address": address})
