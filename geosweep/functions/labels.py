"""Label, name and vocabulary normalisation as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geosweep.functions.geo import col

#: Dataset prefixes, affiliations, aircraft type codes, kinds of files.
SOURCE_PREFIXES = ("xview", "dota", "fair1m", "fmow", "rareplanes", "dior", "sodaa", "hrsc", "hrsc2016", "lvis", "coco", "objects365", "local")
AFFILIATIONS = ("friend", "hostile", "neutral", "unknown")
HELICOPTERS = (
    "R22", "R44", "R66", "B06", "B47", "B105", "B212", "B412", "B429", "A109", "A139", "A169", "EC30", "EC35", "EC45", "EC75", "H125", "H130", "H145",
    "H160", "H175", "H225", "S70", "S76", "S92", "AS50", "BK17", "CH47", "UH60", "AH64", "Z9",
)
TURBOPROPS = (
    "C208", "PC12", "TBM7", "TBM8", "TBM9", "AT72", "AT75", "AT76", "DH8A", "DH8B", "DH8C", "DH8D", "B350", "BE20", "B190", "SF34", "E110", "C130",
    "A400", "C295", "AN12", "AN26", "P3", "P8",
)
BUSINESS_JETS = (
    "GLF4", "GLF5", "GLF6", "GLEX", "G280", "C25A", "C25B", "C25C", "C500", "C510", "C525", "C550", "C560", "C56X", "C650", "C680", "C700", "C750",
    "CL30", "CL35", "CL60", "E55P", "E50P", "FA7X", "FA8X", "F2TH", "F900", "LJ45", "LJ60", "LJ75", "H25B", "PRM1", "BE40",
)
AIRLINER_PREFIXES = ("A3", "A2", "B7", "E1", "E2", "E19", "CRJ", "MD", "DC")
UPLOAD_KINDS = (
    ("imagery", (".tif", ".tiff", ".jp2", ".j2k", ".nc", ".netcdf", ".png", ".jpg", ".jpeg", ".nitf", ".ntf")), ("fmv", (".mp4", ".mov", ".m4v", ".ts", ".mpeg", ".mpg")),
    ("vector", (".geojson", ".json", ".kml", ".kmz", ".zip", ".shp", ".gpkg")), ("document", (".pdf", ".txt", ".csv", ".xlsx", ".docx")),
    ("audio", (".wav", ".mp3", ".m4a", ".aac", ".ogg", ".flac", ".amr")), ("3d", (".b3dm", ".i3dm", ".pnts", ".glb", ".gltf")),
)


def normalise(label) -> Column:
    text = F.lower(F.trim(F.coalesce(col(label), F.lit("object"))))
    text = F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9:]+", "_"), r"_+", "_")
    text = F.regexp_replace(text, r"^_+|_+$", "")
    return F.when(text == "", "object").otherwise(text)


def strip_source(label) -> Column:
    text = normalise(label)
    return F.regexp_replace(text, "^(" + "|".join(SOURCE_PREFIXES) + ")_", "")


def canonical(label) -> Column:
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(col(label), F.lit("")))), r"[\s\-]+", "_")
    return F.regexp_replace(F.regexp_replace(text, r"_+", "_"), r"^_+|_+$", "")


def display_class(label) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(col(label), F.lit("Object")), r"[_\-]", " "))
    text = F.regexp_replace(text, "(?i)^(" + "|".join(p for p in SOURCE_PREFIXES if p not in ("hrsc2016", "local")) + r")\s", "")
    text = F.initcap(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(text == "", "Object").otherwise(text)


#: Entries of a vocabulary table that may become an expression.
MOST_ENTRIES = 2000


def vocabulary(table: DataFrame, order: str, token: str, value: str) -> list[tuple[str, str]]:
    """Tokens and their values in order, from a maintained table; its size is checked, as they become an expression."""
    rows = table.where(F.col(token).isNotNull()).orderBy(order, token, value).select(token, value).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary of more than {MOST_ENTRIES} entries: join with it instead")
    return [tuple(r) for r in rows]


def first_token(name, tokens: Sequence[tuple[str, str]], fallback: str = "unknown") -> Column:
    """Value of the first of the tokens, in their order, that the name holds in either case."""
    upper = F.upper(F.coalesce(col(name), F.lit("")))
    return F.coalesce(*(F.when(F.contains(upper, F.lit(t.upper())), F.lit(v)) for t, v in tokens), F.lit(fallback))


def airframe(code, category=None) -> Column:
    code, cat = F.upper(F.trim(col(code))), F.upper(F.trim(col(category))) if category is not None else F.lit(None).cast("string")
    starts = reduce(lambda a, b: a | b, (code.startswith(p) for p in AIRLINER_PREFIXES))
    by_code = F.when(code.isin(*HELICOPTERS), "heli").when(code.isin(*TURBOPROPS), "turboprop").when(code.isin(*BUSINESS_JETS), "bizjet").when(starts, "airliner")
    by_category = F.when(cat == "A7", "heli").when(cat == "A1", "bizjet").when(cat.isin("A3", "A4", "A5"), "airliner")
    return F.coalesce(by_code, by_category, F.lit("unknown"))


def domain(value, known: Sequence[str], fallback: str, aliases: Mapping[str, str] | None = None) -> Column:
    """One of the known names, by itself or by an alias, in either case and with a slash for an underscore; else the fallback."""
    text = F.regexp_replace(F.upper(F.trim(F.when(F.coalesce(col(value), F.lit("")) == "", fallback).otherwise(col(value)))), "/", "_")
    named = [F.when(text == a, F.lit(v)) for a, v in (aliases or {}).items()]
    return F.coalesce(*named, F.when(text.isin(*known), text), F.lit(fallback))


def media_domain(media, sensor, by_media: Mapping[str, str], by_sensor: Mapping[str, str], fallback: str) -> Column:
    """Name by the sensor where it has one, else by the kind of media."""
    sensor = F.upper(F.coalesce(col(sensor), F.lit("")))
    return F.coalesce(*(F.when(sensor == k, F.lit(v)) for k, v in by_sensor.items()), *(F.when(col(media) == k, F.lit(v)) for k, v in by_media.items()), F.lit(fallback))


def affiliation(value) -> Column:
    text = F.lower(F.trim(col(value)))
    text = F.when(text == "friendly", "friend").otherwise(text)
    return F.when(text.isin(*AFFILIATIONS), text)


def upload_kind(name) -> Column:
    suffix = F.lower(F.regexp_extract(col(name), r"\.[^.]+$", 0))
    return F.coalesce(*(F.when(suffix.isin(*s), F.lit(k)) for k, s in UPLOAD_KINDS))


def safe_filename(name) -> Column:
    text = F.regexp_replace(F.regexp_extract(F.coalesce(col(name), F.lit("upload.tif")), r"[^/]*$", 0), r"[^A-Za-z0-9._-]+", "_")
    return F.when(text == "", "upload.tif").otherwise(text)


def ontology_label(value, fallback: str = "Thing") -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(col(value), F.lit("")), r"\s+", " "))
    text = F.regexp_replace(text, r"[^A-Za-z0-9 ._:/()#-]+", "")
    return F.substring(F.when(text == "", fallback).otherwise(text), 1, 120)


def type_name(value, fallback: str = "Thing") -> Column:
    """Words in capitals and without marks or blanks, at most 60 characters."""
    text = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(col(value), F.lit(fallback)), r"[^A-Za-z0-9_ -]+", "")), "-", " ")
    text = F.regexp_replace(F.initcap(text), r"\s+", "")
    return F.substring(F.when(text == "", fallback).otherwise(text), 1, 60)


def relation_type(value) -> Column:
    text = F.regexp_replace(F.upper(F.trim(F.regexp_replace(F.coalesce(col(value), F.lit("related_to")), r"[^A-Za-z0-9_ ]+", ""))), " ", "_")
    text = F.when(text == "", "RELATED_TO").otherwise(text)
    return F.substring(F.when(text.startswith("CANDIDATE_"), text).otherwise(F.concat(F.lit("CANDIDATE_"), text)), 1, 80)


def name_similarity(a, b) -> Column:
    """0.8 where one name holds the other, else by the shared prefix from 4 characters on, at most 0.99."""
    a, b = F.lower(F.trim(col(a))), F.lower(F.trim(col(b)))
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))),
        F.lit(0),
        lambda best, i: F.when((best == i - 1) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)), i).otherwise(best),
    )
    by_prefix = F.when(n >= 4, F.least(F.lit(0.99), 0.5 + 0.05 * (n - 4))).otherwise(F.lit(0.0))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(F.contains(a, b) | F.contains(b, a), F.lit(0.8)).otherwise(by_prefix)
