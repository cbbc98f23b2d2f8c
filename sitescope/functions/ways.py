"""Classes of map features by their tags, a map of text to text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitescope.functions.text import SLOW_SURFACES

# Kinds of ways that may be walked, ridden, or ridden where that is allowed.
WALKED = ("footway", "path", "pedestrian", "residential", "living_street", "service", "tertiary", "secondary", "primary", "unclassified", "track", "cycleway")
RIDDEN = ("cycleway", "path", "residential", "living_street", "service", "tertiary", "secondary", "primary", "unclassified", "track")
SHARED, SHARED_ALLOWED = ("footway", "pedestrian"), ("yes", "designated")
# Features of the base map: (class, tag, values), the first that holds.
LINES = (
    ("road-major", "highway", ("motorway", "trunk", "primary", "secondary", "tertiary")), ("rail", "railway", ("rail", "light_rail", "subway")),
    ("waterway", "waterway", ("river", "canal")), ("coastline", "natural", ("coastline",)),
)
# Amenities by class.
AMENITIES = (("daycare", ("kindergarten", "childcare")), ("school", ("school",)), ("healthcare", ("clinic", "doctors", "hospital")), ("library", ("library",)))
CARE = ("clinic", "doctor", "hospital")
PROVIDERS = (("mehiläinen", "mehilainen"), ("terveystalo", "terveystalo"), ("pihlajalinna", "pihlajalinna"))


def _is(tags: Column, key: str, values: Iterable[str]) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)).isin(*values), F.lit(False))


def walkable(tags: Column) -> Column:
    return _is(tags, "highway", WALKED) & ~_is(tags, "foot", ("no",))


def shared(tags: Column) -> Column:
    """Ways on foot that cycling is explicitly allowed on."""
    return _is(tags, "highway", SHARED) & _is(tags, "bicycle", SHARED_ALLOWED)


def cyclable(tags: Column) -> Column:
    return (_is(tags, "highway", RIDDEN) & ~_is(tags, "bicycle", ("no",))) | shared(tags)


def slow(tags: Column) -> Column:
    """Rough, or among people on foot: paths are unless told otherwise."""
    mixed_path = _is(tags, "highway", ("path",)) & F.try_element_at(tags, F.lit("segregated")).isNull() & ~_is(tags, "foot", ("no",))
    return shared(tags) | _is(tags, "surface", SLOW_SURFACES) | _is(tags, "segregated", ("no",)) | mixed_path


def signal(tags: Column) -> Column:
    lit = _is(tags, "crossing", ("traffic_signals",)) | _is(tags, "crossing:signals", ("yes",))
    return _is(tags, "highway", ("traffic_signals",)) | (_is(tags, "highway", ("crossing",)) & lit)


def line_class(tags: Column) -> Column:
    return F.coalesce(*[F.when(_is(tags, key, values), name) for name, key, values in LINES])


def area_class(tags: Column) -> Column:
    water = _is(tags, "natural", ("water",)) | F.coalesce(F.try_element_at(tags, F.lit("water")) != "", F.lit(False))
    green = _is(tags, "leisure", ("park",)) | _is(tags, "natural", ("wood",)) | _is(tags, "landuse", ("forest",))
    return F.when(water, "water").when(green, "green")


def amenity_class(tags: Column) -> Column:
    """The amenity's class; other features that give care are healthcare too,
    unless their amenity is of an earlier class."""
    care = _is(tags, "healthcare", CARE)
    out = [F.when(_is(tags, "amenity", values) | (care if name == "healthcare" else F.lit(False)), name) for name, values in AMENITIES]
    return F.coalesce(*out)


def provider(tags: Column) -> Column:
    """The private provider that a place of care names."""
    label = F.lower(F.concat_ws(" ", *[F.try_element_at(tags, F.lit(k)) for k in ("brand", "name", "operator")]))
    named = F.coalesce(*[F.when(label.contains(word), group) for word, group in PROVIDERS])
    return F.when(amenity_class(tags) == "healthcare", named)
