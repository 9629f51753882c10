"""Scalar functions of the catalogue as column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def url_key(c: Column) -> Column:
    """Comparable url: no case, scheme, leading ``www.`` or final slashes; null gives an empty text."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"/+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^https?://", ""), r"^www\.", "")


def endpoint_key(c: Column) -> Column:
    """Comparable endpoint: no case, scheme, final slash or ``/graphql``."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"/+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^https?://", ""), r"/graphql$", "")


def endpoint_domain(c: Column) -> Column:
    """Host name of an endpoint without ``www.``, with or without a scheme."""
    with_scheme = F.when(c.contains("://"), c).otherwise(F.concat(F.lit("http://"), c))
    return F.regexp_replace(F.lower(F.regexp_extract(with_scheme, r"://([^/:?#]+)", 1)), r"^www\.", "")


def universal_id(endpoint: Column, remote_id: Column) -> Column:
    return F.concat_ws(":", endpoint_domain(endpoint), remote_id)


def universal_kind(c: Column) -> Column:
    """``unknown`` without a prefix, ``local``, ``stashbox`` for a domain, else ``catalogue``."""
    prefix = F.substring_index(c, ":", 1)
    return F.when(c.isNull() | ~c.contains(":"), "unknown").when(prefix == "local", "local").when(prefix.contains("."), "stashbox").otherwise("catalogue")


def mostly_latin(c: Column) -> Column:
    """More than half of the letters are Latin."""
    return F.regexp_count(c, F.lit("[A-Za-zÀ-ÖØ-öø-ʯḀ-ỿ]")) * 2 > F.regexp_count(c, F.lit(r"\p{L}"))


def display_name(name: Column, aliases: Column) -> Column:
    """The name if it is mostly Latin, else the first alias that is, else the name."""
    return F.when(mostly_latin(name), name).otherwise(F.coalesce(F.get(F.filter(aliases, mostly_latin), 0), name))


def size_text(c: Column) -> Column:
    """Bytes in steps of 1024 with one decimal."""
    out = F.format_string("%.1f TB", c / F.lit(1024.0**4))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(c < F.lit(1024.0 ** (k + 1)), F.format_string(f"%.1f {unit}", c / F.lit(1024.0**k))).otherwise(out)
    return F.when(c < 1024, F.format_string("%.1f B", c.cast("double"))).otherwise(out)


def duration_text(c: Column) -> Column:
    """``H:MM:SS`` or ``M:SS``; ``Unknown`` for null or zero."""
    s = F.floor(c).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60))
    return F.when(c.isNull() | (c == 0), "Unknown").when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def padded_date(c: Column) -> Column:
    """A date without time; a year or a month gets its first day."""
    d = F.substring_index(F.substring_index(F.trim(c), "T", 1), " ", 1)
    return F.when(d.rlike(r"^\d{4}$"), F.concat(d, F.lit("-01-01"))).when(d.rlike(r"^\d{4}-\d{2}$"), F.concat(d, F.lit("-01"))).otherwise(F.nullif(d, F.lit("")))


def days_between(a: Column, b: Column) -> Column:
    """Absolute days between two full dates, null where one is none."""
    full = r"^\d{4}-\d{2}-\d{2}$"
    day = lambda c: F.when(c.rlike(full), F.try_to_date(c, "yyyy-MM-dd"))
    return F.abs(F.datediff(day(a), day(b)))


def nullish_text(c: Column) -> Column:
    return F.when(c.isNull() | F.lower(F.trim(c)).isin("", "null", "none"), "").otherwise(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; 1 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / size)


def confidence_of(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def yaw_factor(yaw: Column) -> Column:
    """Multiplier of a confidence for a turned face: 1 up to 45 degrees, falling to one half at 90."""
    turn = F.least(F.abs(yaw), F.lit(90.0))
    return F.when(yaw.isNull() | (turn <= 45), 1.0).otherwise(1 - (turn - 45) / 45 * 0.5)


def version_parts(c: Column) -> Column:
    """Numbers of a dotted version; a segment that is no number counts as 0."""
    return F.transform(F.split(F.regexp_replace(c, "^v", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def cue_seconds(c: Column) -> Column:
    """Seconds of ``HH:MM:SS.mmm`` or ``MM:SS.mmm``."""
    p = F.split(F.trim(c), ":")
    n = F.size(p)
    part = lambda k: F.coalesce(F.get(p, n - k).try_cast("double"), F.lit(0.0))
    return part(3) * 3600 + part(2) * 60 + part(1)


def even_grid(start: Column, end: Column, n: int) -> Column:
    """``n`` evenly spaced times; the midpoint alone for one."""
    if n <= 1:
        return F.array((start + end) / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (end - start) * i / (n - 1))


def face_score(faces: Column) -> Column:
    """Sum of confidence times the square root of the box area."""
    return F.aggregate(faces, F.lit(0.0), lambda s, f: s + f["confidence"] * F.sqrt((f["w"] * f["h"]).cast("double")))


def stride(c: Column, step: int = 32) -> Column:
    return (F.ceil(c / step) * step).cast("int")


def resolution_tier(w: Column, h: Column) -> Column:
    m = F.greatest(w, h)
    return F.when(m >= 2160, "4k").when(m >= 1080, "1080p").when(m >= 720, "720p").otherwise("480p")


def gender_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(F.coalesce(c, F.lit("UNKNOWN"))), r"[ -]+", "_"))


def phash_bits(c: Column) -> Column:
    """A hexadecimal 64-bit hash as a signed number; null where it is none."""
    bare = F.regexp_replace(F.lower(F.trim(c)), "^0x", "")
    return F.when(bare.rlike("^[0-9a-f]{1,16}$"), F.conv(bare, 16, -10).cast("long"))


def derotated_box(x: Column, y: Column, w: Column, h: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    """Upright hull of a box turned about a centre."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    corners = [(px, py) for px in (x, x + w) for py in (y, y + h)]
    xs = [cx + (px - cx) * c - (py - cy) * s for px, py in corners]
    ys = [cy + (px - cx) * s + (py - cy) * c for px, py in corners]
    return F.struct(F.round(F.least(*xs), 3).alias("x0"), F.round(F.least(*ys), 3).alias("y0"), F.round(F.greatest(*xs), 3).alias("x1"), F.round(F.greatest(*ys), 3).alias("y1"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def first_occurrences(names: Column, own: Column) -> Column:
    """Aliases trimmed, without the own name and later repeats (case apart), in order."""
    kept = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: (n != "") & (F.lower(n) != F.lower(F.trim(own))))
    return F.filter(kept, lambda n, i: F.array_position(F.transform(kept, lambda k: F.lower(k)), F.lower(n)) == i + 1)


def url_path(c: Column) -> Column:
    """Path and query of a url."""
    return F.concat(F.coalesce(F.parse_url(c, F.lit("PATH")), F.lit("")), F.coalesce(F.concat(F.lit("?"), F.parse_url(c, F.lit("QUERY"))), F.lit("")))


def measurements(c: Column) -> Column:
    """Band, cup, waist and hip of a text such as ``34C-24-36``; null where a part is missing."""
    p = F.split(c, "-", 3)
    first = F.get(p, F.lit(0))
    return F.struct(F.regexp_extract(first, r"^(\d+)", 1).try_cast("int").alias("band"), F.nullif(F.upper(F.regexp_extract(first, r"^\d+([A-Za-z]+)$", 1)), F.lit("")).alias("cup"), F.get(p, F.lit(1)).try_cast("int").alias("waist"), F.get(p, F.lit(2)).try_cast("int").alias("hip"))


def career_years(c: Column) -> Column:
    """First and last year of a text such as ``2010-2020`` or ``2010-``."""
    p = F.split(c, "-", 2)
    return F.struct(F.trim(F.get(p, F.lit(0))).try_cast("int").alias("start"), F.trim(F.get(p, F.lit(1))).try_cast("int").alias("end"))


def body_marks(c: Column) -> Column:
    """``location: description; ...`` of an array of structs; the location alone without a description."""
    return F.array_join(F.transform(c, lambda m: F.concat_ws(": ", m["location"], m["description"])), "; ")


def unescaped(c: Column) -> Column:
    """Text with the basic character references resolved, the ampersand last."""
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(sign))
    return c


def percent(done: Column, total: Column) -> Column:
    """Whole percent of progress, 0 where nothing is to be done."""
    return F.when(total > 0, F.floor(100 * done / total)).otherwise(0).cast("int")


def setting(override: Column, tier: Column, fallback: Column, low: float, high: float) -> Column:
    """First stated value, held between its bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(override, tier, fallback)))
