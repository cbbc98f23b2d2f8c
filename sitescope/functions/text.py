"""Classifiers and patterns over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shop brands by the beginning of their name, in order.
BRANDS = ("prisma", "k-citymarket", "lidl", "k-supermarket", "s-market", "sale", "k-market", "alepa")
# Education services: (group, must match, must not match).
EDUCATION = (
    ("daycare", "päivähoito", "asiakaspalvelu|ohjausalue|leikkitoiminta|esiopetus|perhepäivähoito"),
    ("primary", "perusopetus luokille 1-6", None),
    ("lower_secondary", "perusopetus luokille 7-9", None),
    ("upper_secondary", "lukiokoulutus$", "aikuisten|asiakaspalvelu|ohjaus"),
    ("vocational", "ammatillinen peruskoulutus|ammatillinen koulutus$", "lisäkoulutus|asiakaspalvelu|ohjaus|opiskelija|myymälä"),
)
# Surfaces on which cycling is slow.
SLOW_SURFACES = ("gravel", "fine_gravel", "ground", "dirt", "earth", "grass", "sand", "mud", "wood", "pebblestone", "unpaved", "cobblestone", "sett", "compacted")


def clean(c: Column) -> Column:
    return F.lower(F.trim(c))


def grocery_brand(name: Column, shop: Column) -> Column:
    out = F.when(shop == "supermarket", "other_supermarket").otherwise("other_grocery")
    for b in reversed(BRANDS):
        out = F.when(F.startswith(clean(name), F.lit(b)), b.replace("-", "_")).otherwise(out)
    return out


def education_groups(service: Column) -> Column:
    """Names of the groups a service belongs to."""
    s = clean(service)
    hits = [F.when(s.rlike(yes) & (~s.rlike(no) if no else F.lit(True)), name) for name, yes, no in EDUCATION]
    return F.array_compact(F.array(*hits))


def health_class(name: Column, organisation: Column, company: Column) -> Column:
    """The first rule that holds."""
    n, o = clean(name), clean(organisation)
    return (
        F.when(n.contains("mehiläinen"), "mehilainen").when(n.contains("terveystalo"), "terveystalo").when(n.contains("pihlajalinna"), "pihlajalinna")
        .when(n.rlike("yliopistollinen sairaala|yliopistosairaala|keskussairaala") | (o.contains("hus") & n.contains("sairaala")), "hospital")
        .when(~company & n.rlike("terveysasema|terveyskeskus"), "health_centre").when(company & n.rlike("lääkäri|terveys|klinikka|sairaala"), "other_private_clinic")
    )


def property_ids(text: Column) -> Column:
    """Four-part property numbers as 14 digits, distinct, in order of text."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{1,3}[-–—][0-9]{1,3}[-–—][0-9]{1,4}[-–—][0-9]{1,4})(?![0-9])"), F.lit(1))
    def pad(x):
        p = F.split(x, r"[-–—]")
        return F.concat(F.lpad(p[0], 3, "0"), F.lpad(p[1], 3, "0"), F.lpad(p[2], 4, "0"), F.lpad(p[3], 4, "0"))
    return F.array_distinct(F.transform(found, pad))


def layer_parts(layer_id: Column) -> tuple[Column, Column, Column]:
    """Family, destination and statistic of a generated layer id."""
    bike = F.regexp_extract(layer_id, "^bike_workplace_(.+)_effective_min$", 1)
    place = F.regexp_extract(layer_id, "^transit_workplace_(.+)_(min|median|max)_min$", 1)
    stat = F.regexp_extract(layer_id, "^transit_workplace_(.+)_(min|median|max)_min$", 2)
    family = F.when(bike != "", "bike").when(place != "", "transit").otherwise("static")
    return family, F.coalesce(F.nullif(bike, F.lit("")), F.nullif(place, F.lit(""))), F.nullif(stat, F.lit(""))


# Words of a decision that leases land of the city.
LEASE_WORDS = (r"\bvuokra\w*", r"\b(?:maa-alue|maanvuokra|tontt\w*|kiinteist\w*|korttel\w*)", r"\bHelsingin kaupung\w*")


def lease_candidate(subject: Column, body: Column) -> Column:
    """A decision that speaks of a lease, of land and of the city."""
    t = F.concat_ws("\n", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit("")))
    return t.rlike("(?iU)" + LEASE_WORDS[0]) & t.rlike("(?iU)" + LEASE_WORDS[1]) & t.rlike("(?iU)" + LEASE_WORDS[2])


def building_ids(text: Column) -> Column:
    """Permanent building numbers, distinct, in order of text."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"(?<![0-9A-Z])([0-9]{9}[0-9A-Z])(?![0-9A-Z])"), F.lit(1)))


def workplace_layer_ids(destination: Column, sampled: Column) -> Column:
    """Layers of a workplace: by bike, and by transit where it was sampled."""
    transit = [F.concat(F.lit("transit_workplace_"), destination, F.lit(end)) for end in ("_min_min", "_median_min", "_max_min", "_median_boarding")]
    bike = F.array(F.concat(F.lit("bike_workplace_"), destination, F.lit("_effective_min")))
    return F.when(sampled, F.concat(bike, F.array(*transit))).otherwise(bike)
