"""Column functions: categories, phases, signs, calendar arithmetic, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of categories.
NO_DATA = "Sin datos"
INTENSITIES = ((1.0, "débil"), (1.5, "moderado"), (2.0, "fuerte"))
STRONGEST = "muy fuerte"
COMPOSITE = (
    (1.5, "El Niño fuerte (cuenca)"),
    (0.8, "El Niño (cuenca)"),
    (0.3, "Tendencia cálida"),
)
COMPOSITE_COLD = (
    (-1.5, "La Niña fuerte (cuenca)"),
    (-0.8, "La Niña (cuenca)"),
    (-0.3, "Tendencia fría"),
)
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Centre month of each overlapping season.
SEASONS = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")


def known(v: Column) -> Column:
    """v, with NaN as null."""
    return F.when(~F.isnan(v), v)


def consistent_sign(v: Column) -> Column:
    """An aggregate: whether all known values are finite, so that their sign can be told. Null and NaN are unknown."""
    return F.coalesce(F.bool_and(F.abs(known(v)) < float("inf")), F.lit(True))


def graded(v: Column, least: float, warm: str, cold: str, calm: str) -> Column:
    """Category by size and sign: calm below `least`, then the intensities."""
    sign = F.when(v >= 0, warm).otherwise(cold)
    grade = F.lit(STRONGEST)
    for top, name in reversed(INTENSITIES):
        grade = F.when(F.abs(v) < top, name).otherwise(grade)
    return F.when(v.isNull() | F.isnan(v), NO_DATA).when(F.abs(v) < least, calm).otherwise(F.concat_ws(" ", sign, grade))


def icen_category(v: Column) -> Column:
    return graded(v, 0.4, "El Niño Costero", "La Niña Costera", "Normal")


def two_sided(v: Column, high: float, low: float, above: str, below: str, between: str, strict: bool = False) -> Column:
    """One label from `high` up, one from `low` down, one between; strict leaves the limits between."""
    up, down = (v > high, v < low) if strict else (v >= high, v <= low)
    return F.when(v.isNull() | F.isnan(v), NO_DATA).when(up, above).when(down, below).otherwise(between)


def roni_category(v: Column) -> Column:
    return two_sided(v, 0.5, -0.5, "El Niño (cuenca)", "La Niña (cuenca)", "ENSO Neutral (cuenca)")


def soi_category(v: Column) -> Column:
    return two_sided(v, 0.5, -0.5, "Componente atmosférica de La Niña", "Componente atmosférica de El Niño", "Componente atmosférica neutral")


def wind_direction(v: Column, limit: float = 0.5) -> Column:
    """label and sign_meaning of a zonal wind anomaly; limit 0 tells by sign alone, with calm at 0."""
    label = two_sided(v, limit, -limit, "Anomalía del oeste (flujo hacia el este)", "Anomalía del este (flujo hacia el oeste)", "Anomalía zonal débil / neutral" if limit else "Calmo", strict=True)
    meaning = F.when(v > limit, "westerly").when(v < -limit, "easterly").when(v.isNull() | F.isnan(v), "").otherwise("calm")
    return F.struct(label.alias("label"), meaning.alias("sign_meaning"))


def thermocline(v: Column, limit: float = 5.0) -> Column:
    return two_sided(v, limit, -limit, "Termoclina más profunda de lo normal (señal de El Niño de cuenca)", "Termoclina más somera de lo normal (señal de La Niña de cuenca)", "Profundidad de la termoclina cerca de lo normal", strict=True)


def status_category(indicator: Column, v: Column) -> Column:
    """What the status says of an indicator's value: each by its own rule; a coastal or a basin temperature stands for its index."""
    wind = F.when(v.isNull() | F.isnan(v), NO_DATA).when(v > 0, "Viento hacia el este (westerly)").when(v < 0, "Viento hacia el oeste (easterly)").otherwise("Calmo")
    depth = two_sided(v, 10.0, -10.0, "Termoclina más profunda de lo normal (El Niño)", "Termoclina más somera de lo normal (La Niña)", "Termoclina cerca de la profundidad normal", strict=True)
    return (
        F.when(indicator.isin("icen", "nino12"), icen_category(v))
        .when(indicator.isin("roni", "nino34"), roni_category(v))
        .when(indicator == "soi", soi_category(v))
        .when(indicator == "u850", wind)
        .when(indicator == "d20", depth)
    )


def composite_category(v: Column) -> Column:
    found = F.lit("Neutral")
    for limit, name in reversed(COMPOSITE_COLD):
        found = F.when(v <= limit, name).otherwise(found)
    for limit, name in reversed(COMPOSITE):
        found = F.when(v >= limit, name).otherwise(found)
    return found


def phase(v: Column, limit: float = 0.5) -> Column:
    """The phase of a known value."""
    return F.when(v >= limit, "El Niño").when(v <= -limit, "La Niña").otherwise(F.when(v.isNotNull(), "Neutral"))


def intensity_rank(peak: Column) -> Column:
    """1 to 4 by the size of the peak."""
    a = F.abs(peak)
    return F.when(a < 1.0, 1).when(a < 1.5, 2).when(a < 2.0, 3).otherwise(4)


def intensity_label(peak: Column, scope: Column, threshold: Column) -> Column:
    coastal = graded(peak, 0.4, "El Niño Costero", "La Niña Costera", "Normal")
    basin = F.when(F.abs(peak) < threshold, "Neutral").otherwise(graded(peak, 0.0, "El Niño", "La Niña", "Neutral"))
    return F.when(scope == "costero", coastal).otherwise(basin)


def strength(r: Column) -> Column:
    """Strength of a correlation."""
    a = F.abs(r)
    return F.when(a >= 0.7, "Fuerte").when(a >= 0.4, "Moderada").when(a >= 0.2, "Débil").otherwise("Nula")


def to_negative(lon: Column) -> Column:
    """Longitude in (-180, 180]; a multiple of 180 keeps +180. NaN stays."""
    east = F.pmod(lon, F.lit(360.0))
    return F.when(F.isnan(lon), lon).otherwise(F.when(east > 180.0, east - 360.0).otherwise(east))


def to_positive(lon: Column) -> Column:
    """Longitude in [0, 360). NaN stays."""
    return F.when(F.isnan(lon), lon).otherwise(F.pmod(lon, F.lit(360.0)))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Inside a box, borders included, in any longitude convention; a box may cross the date line."""
    x, w, e = to_positive(lon), to_positive(F.lit(float(west))), to_positive(F.lit(float(east)))
    across = F.when(w <= e, x.between(w, e)).otherwise((x >= w) | (x <= e))
    return lat.between(south, north) & across


def month_idx(year: Column, month: Column) -> Column:
    return ((year - 1990) * 12 + month - 1).cast("int")


def month_text(idx: Column) -> Column:
    """YYYY-MM of months since 1990-01."""
    return F.format_string("%04d-%02d", (F.floor(idx / 12) + 1990).cast("int"), (F.pmod(idx, F.lit(12)) + 1).cast("int"))


def month_span(first: Column, last: Column) -> Column:
    """Months from first to last, both counted."""
    return (last - first + 1).cast("int")


def fractional_year(idx: Column) -> Column:
    return 1990 + idx / 12


def month_end(idx: Column) -> Column:
    return F.last_day(F.to_date(F.concat(month_text(idx), F.lit("-01"))))


def window_label(idx: Column, width: int = 3) -> Column:
    """The months of a trailing window, as text."""
    names = F.array(*map(F.lit, MONTH_NAMES))

    def one(i: Column) -> Column:
        return F.concat_ws(" ", F.element_at(names, (F.pmod(i, F.lit(12)) + 1).cast("int")), (F.floor(i / 12) + 1990).cast("int").cast("string"))

    return F.concat_ws("–", *(one(idx - k) for k in range(width - 1, -1, -1)))


def clamp(v: Column, scale: float) -> Column:
    """v as a share of scale, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / scale))


def erf(x: Column) -> Column:
    """Error function by a rational approximation (Abramowitz and Stegun 7.1.26)."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / 1.4142135623730951))


def season_month(season: Column) -> Column:
    """Centre month of a season; 1 for an unknown one."""
    return F.when(F.array_position(F.array(*map(F.lit, SEASONS)), season) > 0, F.array_position(F.array(*map(F.lit, SEASONS)), season)).otherwise(1).cast("int")


def folded_checksum(series_id: Column, points: Column) -> Column:
    """32-bit FNV-1a style checksum of an ordered array of (month, value), as eight hexadecimal digits."""
    mask, prime = F.lit(0xFFFFFFFF), F.lit(16777619)

    def mixed(h: Column, word: Column) -> Column:
        return h.bitwiseXOR(word.bitwiseAND(mask)).bitwiseAND(mask)

    def step(h: Column, p: Column) -> Column:
        first = (F.ascii(F.substring(p["month"], 1, 1)) + F.length(p["month"])).cast("long")
        second = F.when(p["value"].isNull(), F.lit(9999)).otherwise(F.bround(p["value"] * 1000)).cast("long") + F.lit(0x9E3779B9)
        h = (mixed(h, first) * prime).bitwiseAND(mask)
        return (mixed(h, second) * prime).bitwiseAND(mask)

    start = F.lit(2166136261).cast("long").bitwiseXOR(F.length(series_id).cast("long"))
    return F.lpad(F.hex(F.aggregate(points, start, step)), 8, "0")


def plain_text(html: Column) -> Column:
    """HTML without scripts, styles and tags, common entities resolved, white space made single."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# Short names of months in Spanish, and the signs of units.
MONTHS_SHORT_ES = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
UNIT_SIGNS = {"degC": "°C", "m": "m", "m_per_s": "m/s"}


def month_label(month: Column) -> Column:
    """YYYY-MM as a short Spanish month and its year."""
    return F.concat_ws(" ", F.get(F.array(*map(F.lit, MONTHS_SHORT_ES)), F.substring(month, 6, 2).cast("int") - 1), F.substring(month, 1, 4))


def value_label(v: Column, units: Column) -> Column:
    """A value with its sign and unit: metres with one digit, all else with two; a plus sign where the unit is known.

    The number is rounded once, from v as it is; the plus sign wants a value above 0 at four digits.
    """
    sign = F.coalesce(*(F.when(units == u, x) for u, x in UNIT_SIGNS.items()), F.lit(""))
    number = F.when(units == "m", F.format_string("%.1f", F.round(v, 1) + F.lit(0.0))).otherwise(F.format_string("%.2f", F.round(v, 2) + F.lit(0.0)))
    plus = F.when((F.round(v, 4) > 0) & (sign != ""), "+").otherwise("")
    return F.when(v.isNull() | F.isnan(v), "Sin datos").otherwise(F.rtrim(F.concat(plus, number, F.lit(" "), sign)))


def asset_url(base: Column, name: Column) -> Column:
    """The address of a file under a base path, with one slash between them. A line break or an empty name raises."""
    before, after = F.regexp_replace(F.trim(base), "/+$", ""), F.regexp_replace(F.trim(name), "^/+", "")
    bad = F.contains(base, F.lit("\n")) | F.contains(name, F.lit("\n")) | (after == "")
    return F.when(bad, F.raise_error(F.lit("not a path"))).otherwise(F.concat_ws("/", before, after))
