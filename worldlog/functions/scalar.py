"""Scalar functions as Columns: times, places, scores, bands and normal forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
EARTH_RADIUS_M = 6_371_008.8
BANDS = ((0.15, "REMOTE"), (0.45, "POSSIBLE"), (0.75, "LIKELY"))
PRESSURES = ((0, "PASSED"), (72, "IMMINENT"), (14 * 24, "CLOSE"), (60 * 24, "NEAR"))
TIERS = ("ROUTINE", "ATTENTION", "PRIORITY", "CRITICAL")
TIER_TABLE = {
    "CRITICAL": {"REMOTE": "ATTENTION", "POSSIBLE": "PRIORITY", "LIKELY": "CRITICAL", "VERY_LIKELY": "CRITICAL"},
    "HIGH": {"REMOTE": "ROUTINE", "POSSIBLE": "ATTENTION", "LIKELY": "PRIORITY", "VERY_LIKELY": "CRITICAL"},
    "MEDIUM": {"REMOTE": "ROUTINE", "POSSIBLE": "ATTENTION", "LIKELY": "ATTENTION", "VERY_LIKELY": "PRIORITY"},
    "LOW": {"REMOTE": "ROUTINE", "POSSIBLE": "ROUTINE", "LIKELY": "ATTENTION", "VERY_LIKELY": "ATTENTION"},
}
CORRECTION_CUES = r"(?iU)\b(correction|corrected|corrigendum|erratum|berichtigung|korrigiert|rectificatif|corrigé|rettifica|исправлен\w*|поправка)\b"
RETRACTION_CUES = r"(?iU)\b(retraction|retracted|withdrawn|widerrufen|zurückgezogen|retrait|retiré|ritirato|отозван\w*)\b"
OFFSET = r"(Z|[+-]\d\d:?\d\d)$"


def ladder(value: Column, steps: tuple, last: str, inclusive: bool = False) -> Column:
    """The label of the first step that ``value`` is below (or at, if ``inclusive``), else ``last``."""
    under = [(value <= edge if inclusive else value < edge, label) for edge, label in steps]
    return reduce(lambda col, step: col.when(*step), under[1:], F.when(*under[0])).otherwise(last)


def hours_between(start: Column, end: Column) -> Column:
    """Hours with fractions; ``unix_micros`` keeps what whole seconds would drop."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def instant(text: Column) -> Column:
    """The instant of an ISO time that carries an offset; null for others."""
    return F.when(text.rlike(OFFSET), F.try_to_timestamp(text))


def instant_or_utc(text: Column) -> Column:
    """As ``instant``, but times without an offset are taken as UTC."""
    return F.try_to_timestamp(F.when(text.rlike(OFFSET), text).otherwise(F.concat(text, F.lit("Z"))))


def archive_stamp(text: Column) -> Column:
    """The instant of a 14-digit archive stamp."""
    return F.when(text.rlike(r"^\d{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def mail_time(text: Column) -> Column:
    """The instant of a mail-style date; the week day is left out, as it is never needed."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def haversine_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat_a, lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lon_a, lon_b)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def point_to_line_m(lon: Column, lat: Column, line: Column) -> Column:
    """Metres from a point to the nearest segment of ``line`` (array of [lon, lat]), on a local flat map."""
    kx, ky = F.radians(F.lit(1.0)) * EARTH_RADIUS_M * F.cos(F.radians(lat)), F.radians(F.lit(1.0)) * EARTH_RADIUS_M

    def to_segment(i: Column) -> Column:
        a, b = line[i], line[i + 1]
        ax, ay, bx, by = (a[0] - lon) * kx, (a[1] - lat) * ky, (b[0] - lon) * kx, (b[1] - lat) * ky
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length)))
        return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(line) - 2), to_segment))


def url_key(url: Column) -> Column:
    """Host without ``www.`` and path without trailing slashes (``/`` if none is left); addresses may lack a scheme."""
    whole = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(whole, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    path = F.regexp_replace(F.coalesce(F.try_parse_url(whole, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.concat(host, F.when(path == "", "/").otherwise(path))


def normal_statement(text: Column) -> Column:
    """Lower case, runs of white space as one space, and no quotes or stops at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "), F.lit(" .,;:!?\"'«»“”"))


def subject_parts(subject: Column) -> Column:
    """(scheme, value) of ``SCHEME:value``; the scheme is null where there is none."""
    has = F.contains(subject, F.lit(":"))
    return F.struct(
        F.when(has, F.split_part(subject, F.lit(":"), F.lit(1))).alias("scheme"),
        F.when(has, F.regexp_replace(subject, "^[^:]*:", "")).otherwise(subject).alias("value"),
    )


def digest_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and 24 hex digits of the hash of the parts: the same parts share an id."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 24))


def probability_band(p: Column) -> Column:
    return ladder(p, BANDS, "VERY_LIKELY")


def time_pressure(hours: Column) -> Column:
    return ladder(hours, PRESSURES, "DISTANT", inclusive=True)


def horizon_band(days: Column) -> Column:
    return ladder(days, ((7, "SHORT"), (90, "MEDIUM")), "LONG", inclusive=True)


def evidence_confidence(families: Column, degraded: Column) -> Column:
    """A degraded basis counts one family less."""
    strength = families - F.when(degraded > 0, 1).otherwise(0)
    return ladder(strength, ((0, "NONE"), (1, "WEAK"), (2, "MODERATE")), "STRONG", inclusive=True)


def warning_tier(band: Column, consequence: Column, pressure: Column, confidence: Column) -> Column:
    """Table, then one step up for an imminent horizon, then a cap where evidence is weak; null off the table."""
    cells = {f"{c}/{b}": TIERS.index(t) for c, row in TIER_TABLE.items() for b, t in row.items()}
    table = F.create_map(*[F.lit(x) for pair in cells.items() for x in pair])
    base = F.try_element_at(table, F.concat_ws("/", consequence, band))
    bumped = F.when(pressure == "IMMINENT", F.least(base + 1, F.lit(3))).otherwise(base)
    capped = F.when(confidence.isin("NONE", "WEAK"), F.least(bumped, F.lit(2))).otherwise(bumped)
    return F.get(F.array(*map(F.lit, TIERS)), capped)


def brier(p: Column, true: Column) -> Column:
    return F.pow(p - F.when(true, 1.0).otherwise(0.0), 2)


def log_score(p: Column, true: Column) -> Column:
    return -F.ln(F.when(true, p).otherwise(1 - p))


def contradicts(a: Column, b: Column) -> Column:
    """Two readings disagree: numbers by over a fifth of the larger, texts if unlike; UNKNOWN and null never do."""
    known = lambda c: c.isNotNull() & (c != "UNKNOWN")
    x, y = a.try_cast("double"), b.try_cast("double")
    numbers = F.abs(x - y) > 0.2 * F.greatest(F.abs(x), F.abs(y))
    return F.coalesce(known(a) & known(b) & F.when(x.isNotNull() & y.isNotNull(), numbers).otherwise(a != b), F.lit(False))


def probabilities_in(text: Column) -> Column:
    """Probabilities that a text states, as ``0.42`` or ``42%``."""
    shares = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\d.])(0\.\d+)(?![\d%])"), F.lit(1)), lambda x: x.cast("double"))
    percents = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\d.])(\d{1,3}(?:\.\d+)?)\s?%"), F.lit(1)), lambda x: x.cast("double") / 100)
    return F.concat(shares, F.filter(percents, lambda x: x <= 1))


def source_day(text: Column) -> Column:
    """A time as a source states it, in ISO form with its offset: a bare date is that day in UTC, a time without an offset null."""
    said = F.trim(text)
    zoned = F.regexp_replace(said, "Z$", "+00:00")
    return F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(said, F.lit("T00:00:00+00:00"))).when(said.rlike(OFFSET) & F.try_to_timestamp(said).isNotNull(), zoned)


def first_text(*texts: Column) -> Column:
    """The first text that is neither null nor empty; empty if there is none."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def state_time(status: Column, capture: Column, source: Column, retrieval: Column) -> Column:
    """When what was seen was so: an archive's capture time, else the source's; a live page's retrieval time."""
    return F.when(status == "HISTORICAL", first_text(capture, source)).otherwise(first_text(retrieval))


def to_archive_stamp(instant_: Column) -> Column:
    """The 14-digit archive stamp of an instant, in UTC."""
    return F.date_format(F.to_utc_timestamp(instant_, F.current_timezone()), "yyyyMMddHHmmss")


def site(url: Column) -> Column:
    """``site:`` and the host of an address without ``www.`` and port; addresses may lack a scheme."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.concat(F.lit("site:"), F.regexp_replace(host, r"^www\.", ""))


def origin_key(source: Column, native_id: Column, final_url: Column) -> Column:
    """Whose information it is: the archived site of a capture (``stamp/address`` or the address), the site of a live page,
    else the publisher that the source is."""
    archived = F.regexp_replace(native_id, r"^\d{14}/(?=.)", "")
    return F.when((source == "wayback") & (native_id != ""), site(archived)).when(source == "live-web", site(first_text(final_url, native_id))).otherwise(F.concat(F.lit("publisher:"), source))


def world_object_id(subject: Column) -> Column:
    """The stable id of ``SCHEME:value``; what has no scheme is a label, addresses and domains count by their key."""
    parts = subject_parts(subject)
    scheme = F.coalesce(parts["scheme"], F.lit("LABEL"))
    return digest_id("wm", scheme, F.when(scheme.isin("URL", "DOMAIN"), url_key(parts["value"])).otherwise(parts["value"]))


def anchor(text: Column, raw: Column, value: Column) -> Column:
    """(start, end, scope) of a value in its text, from 0: VALUE within the matched piece, or anywhere if there is no such
    piece; PIECE where only the piece is found; DOCUMENT, without places, where neither is."""
    at = F.when(raw != "", F.position(raw, text) - 1).otherwise(-1)
    window = F.substring(text, at + 1, F.length(raw) + F.length(value))
    inner = F.position(value, window) - 1
    within = F.when((at >= 0) & (value != ""), F.when(inner >= 0, at + inner).otherwise(-1)).otherwise(F.when(value != "", F.position(value, text) - 1).otherwise(-1))
    scope = F.when(within >= 0, "VALUE").when(at >= 0, "PIECE").otherwise("DOCUMENT")
    start = F.when(within >= 0, within).when(at >= 0, at)
    return F.struct(start.cast("long").alias("start"), (start + F.when(within >= 0, F.length(value)).otherwise(F.length(raw))).cast("long").alias("end"), scope.alias("scope"))
