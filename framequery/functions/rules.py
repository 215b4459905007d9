"""Capture rules, geometry decisions and names, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of each target in the order of their precedence.
TARGET_WORDS = {
    "Sun": ["sun", "solar", "sonne", "halpha", "h-alpha", "ha_", "lunt"],
    "Moon": ["moon", "mond", "lunar", "luna"],
    "Jupiter": ["jup", "jupiter"],
    "Saturn": ["sat", "saturn"],
    "Mars": ["mars"],
}
# Extensions that a folder scan lists.
EXTENSIONS = ["tif", "tiff", "png", "jpg", "jpeg", "ser", "avi", "fits", "fit"]


def clamp(value: Column, low: float | int, high: float | int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def detect_target(*candidates: Column) -> Column:
    """The first target of which any keyword occurs in any candidate; NULL for none. A chain of CASE branches."""
    lowered = [F.lower(F.coalesce(c, F.lit(""))) for c in candidates]
    found = F.lit(None).cast("string")
    for target, words in reversed(TARGET_WORDS.items()):
        hit = F.lit(False)
        for word in words:
            for c in lowered:
                hit = hit | c.contains(word)
        found = F.when(hit, F.lit(target)).otherwise(found)
    return found


def metadata_map(*texts: Column) -> Column:
    """All key=number pairs of the texts joined by spaces: keys in lower case, the first of a key wins."""
    joined = F.concat_ws(" ", *texts)
    pattern = r"([A-Za-z_]+)=(-?[0-9]+(?:\.[0-9]+)?)"
    keys = F.transform(F.regexp_extract_all(joined, F.lit(pattern), F.lit(1)), lambda k: F.lower(k))
    values = F.regexp_extract_all(joined, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    firsts = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda p: F.struct(p["k"], p["v"].cast("double"))))


def keep_percents(text: Column) -> Column:
    """Percents of a list such as '20, 40%; 60': whole numbers 1 to 99, distinct, rising."""
    parts = F.transform(F.split(text, r"[,;\s]+"), lambda x: F.regexp_replace(x, "%", ""))
    numbers = F.transform(F.filter(parts, lambda x: x.rlike(r"^[+-]?[0-9]{1,9}$")), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.between(1, 99))))


def natural_key(name: Column) -> Column:
    """A sort key under which digits compare as numbers: each run of digits is led by its length."""
    plain = F.lower(name)
    runs = F.regexp_extract_all(plain, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0")).otherwise(r))
    return F.array_join(padded, "")


def semver_newer(left: Column, right: Column) -> Column:
    """left is a later version than right: three numeric parts, each by its leading digits, missing ones 0."""

    def parts(v: Column) -> Column:
        split = F.split(F.regexp_replace(v, "^v", ""), r"\.")
        return F.array(*(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(F.get(split, F.lit(k)), F.lit("")), r"^([0-9]{1,9})", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0)) for k in range(3)))

    return parts(left) > parts(right)


def fingerprint(size: Column, modified_seconds: Column) -> Column:
    return F.concat_ws("|", size.cast("string"), F.floor(modified_seconds * 1000).cast("string"))


def parse_limit(text: Column, default: int = 50, most: int = 200) -> Column:
    """A leading whole number of a query parameter, held to 1 .. most; the default where there is none."""
    number = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?[0-9]{1,9})", 1), F.lit(""))
    return clamp(F.coalesce(number.cast("int"), F.lit(default)), 1, most)


def ticks_to_timestamp(ticks: Column) -> Column:
    """UTC of 100 ns ticks since the year 1; NULL for ticks of 0 or less."""
    return F.when(ticks > 0, F.timestamp_micros(F.floor(ticks / 10).cast("long") - F.lit(62135596800000000)))


def frames_per_second(n: Column, first: Column, last: Column) -> Column:
    """(n - 1) over the seconds between the first and last tick; NULL unless within 0.5 .. 1000."""
    fps = F.try_divide((n - 1).cast("double"), (last - first) / F.lit(1e7))
    return F.when(fps.between(0.5, 1000.0), fps)


def color_id(raw: Column, w: Column, h: Column, depth: Column, payload: Column, frames: Column) -> Column:
    """Colour id of a header: known ids, then the dialect that adds 100, then by the bytes a frame takes (mono or RGB,
    within the larger of 64 bytes and 1 %); NULL where nothing fits."""
    known = [0, 8, 9, 10, 11, 16, 17]
    own = F.when(raw.isin(known), raw).when((raw - 100).isin(known), raw - 100)
    mono = (w * h * F.when(depth > 8, 2).otherwise(1)).cast("long")
    each = F.try_divide(payload.cast("double"), frames.cast("double"))

    def near(size: Column) -> Column:
        return F.abs(each - size) <= F.greatest(F.lit(64.0), size * F.lit(0.01))

    return F.coalesce(own, F.when(near(mono), F.lit(0)).when(near(mono * 3), F.lit(16)))


def bytes_per_frame(w: Column, h: Column, depth: Column, color: Column) -> Column:
    return (w * h * F.when(depth > 8, 2).otherwise(1) * F.when(color.isin(16, 17), 3).otherwise(1)).cast("long")


def readable_frames(frames: Column, length: Column, per_frame: Column, header: int = 178) -> Column:
    """Frames that a file of this length holds in full, at most what its header says."""
    return F.greatest(F.lit(0), F.least(frames.cast("long"), F.floor(F.try_divide(length - header, per_frame)).cast("long")))


def capture_warnings(depth: Column, frames: Column, w: Column, h: Column, date: Column, target: Column, exposure_ms: Column, fps: Column) -> Column:
    """Findings (code, severity) of a capture in their fixed order, as an array."""

    def finding(when: Column, code: Column | str, severity: Column | str) -> Column:
        code, severity = (F.lit(x) if isinstance(x, str) else x for x in (code, severity))
        return F.when(when, F.struct(code.alias("code"), severity.alias("severity")))

    bright = F.coalesce(target.isin("Sun", "Moon"), F.lit(False))
    depth_code = F.when(target.isNull(), "bitdepth.low.unknown").when(bright, "bitdepth.low").otherwise("bitdepth.low.planetary")
    spinning = F.coalesce(target.isin("Jupiter", "Saturn"), F.lit(False))
    every = F.array(
        finding(depth <= 8, depth_code, F.when(bright, "warning").otherwise("info")),
        finding(frames < 100, "frames.few", "warning"),
        finding((w < 200) | (h < 200), "frame.small", "info"),
        finding(date.isNull(), "timestamp.missing", "info"),
        finding(exposure_ms > 15, "exposure.long", "warning"),
        finding((fps > 0) & (fps < 30), "fps.low", "warning"),
        finding((fps > 0) & (F.try_divide(frames.cast("double"), fps) > 180) & spinning, "derotation.advisory", "advisory"),
    )
    return F.filter(every, lambda x: x.isNotNull())


def calibrate_by_default(target: Column, exposure_ms: Column) -> Column:
    short = target.isin("Moon", "Sun", "Jupiter")
    return F.when(exposure_ms.isNull(), F.lit(True)).when(F.coalesce(short, F.lit(False)), exposure_ms > 15).otherwise(F.lit(True))


def tile_size(focal_mm: Column, pixel_um: Column, barlow: Column) -> Column:
    """Deconvolution tile of an optical train: focal / pitch x barlow to the nearest 100, 200 at least; 500 by default."""
    known = (focal_mm > 0) & (pixel_um > 0)
    raw = F.round(F.try_divide(focal_mm, pixel_um) * F.coalesce(barlow, F.lit(1.0)) / 100) * 100
    return F.when(known, F.greatest(raw, F.lit(200.0))).otherwise(F.lit(500.0)).cast("int")


def arcsec_per_pixel(focal_mm: Column, pixel_um: Column, barlow: Column) -> Column:
    return F.try_divide(F.lit(206.265) * pixel_um, focal_mm * F.coalesce(barlow, F.lit(1.0)))


def grid_of_tile(min_dim: Column, tile: Column) -> Column:
    return clamp(F.floor(min_dim / F.greatest(tile, F.lit(50))), 4, 16).cast("int")


def synthetic_sigma(seeing: Column) -> Column:
    return F.lit(4.5) - F.lit(0.6) * clamp(seeing, 1.0, 5.0)


def psf_sigma(limb: Column, edge: Column, seeing: Column, with_edge: bool = True, synthetic: bool = True) -> Column:
    """(sigma, origin): the width measured at the limb, else at an edge, else that of the seeing index; NULL and "none" where
    none of those allowed has one. A width that isn't above 0 is none."""
    ways = [("limb", limb)] + [("edge", edge)] * with_edge + [("synthetic", F.when(seeing.isNotNull(), synthetic_sigma(seeing)))] * synthetic
    sigma, origin = F.lit(None).cast("double"), F.lit("none")
    for name, width in reversed(ways):
        sigma, origin = F.when(width > 0, width).otherwise(sigma), F.when(width > 0, F.lit(name)).otherwise(origin)
    return F.struct(sigma.alias("sigma"), origin.alias("origin"))


def blend_radii(sigma: Column, radius: Column) -> tuple[Column, Column]:
    """Inner and outer radius, as fractions, within which the deconvolved image fades."""
    inner = clamp(F.lit(1.0) - F.lit(15.0) * F.greatest(F.lit(0.0), F.try_divide(sigma, radius) - F.lit(0.025)), 0.65, 1.0)
    return inner, F.greatest(F.lit(1.05), inner + F.lit(0.10))


def patch_half(sigma: Column) -> Column:
    return clamp(F.round(F.lit(3.0) * sigma), 8, 32).cast("int")


def search_radius(patch: Column) -> Column:
    return clamp(F.floor(patch / 2) + 2, 4, 16).cast("int")


def pilot_frames(fps: Column, frames: Column, available: Column) -> Column:
    """Length of the pilot prefix of the kept frames; NULL (no decision) where fewer than 30 are there."""
    wanted = F.when(fps > 0, clamp(F.round(F.lit(3.0) * fps), 100, 500)).otherwise(clamp(F.floor(frames / 5), 100, 500))
    n = F.least(wanted, available).cast("int")
    return F.when(n >= 30, n)


def output_name(stem: Column, utc: Column, target: Column) -> Column:
    """<stem>_stack.tif, or the capture's time and target where the time is known."""
    dated = F.concat(F.date_format(utc, "yyyy-MM-dd-HHmm_ss"), F.lit("-"), F.lower(F.coalesce(target, F.lit("other"))), F.lit(".tif"))
    return F.when(utc.isNotNull(), dated).otherwise(F.concat(stem, F.lit("_stack.tif")))


# Colour ids of a capture's header, and the formats of an image header's date.
COLOR_LABELS = {0: "mono", 8: "bayerRGGB", 9: "bayerGRBG", 10: "bayerGBRG", 11: "bayerBGGR", 16: "rgb", 17: "bgr"}
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX")


def color_label(color_id: Column) -> Column:
    """Name of a colour id, NULL for unknown ones."""
    return F.get(F.array(*(F.lit(COLOR_LABELS.get(k)) for k in range(18))), F.when((color_id >= 0) & (color_id < 18), color_id.cast("int")).otherwise(F.lit(-1)))


def header_date(raw: Column) -> Column:
    """Timestamp of an image header's date: the first of three plain formats (UTC), then ISO 8601 with a zone; else NULL."""
    text = F.trim(raw)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS))


def auto_keep_percent(fraction: Column) -> Column:
    """A keep fraction as whole percent, 1 to 99."""
    return clamp(F.floor(fraction * 100 + F.lit(0.5)), 1, 99).cast("int")


def colour_camera(extension: Column, color_id: Column) -> Column:
    """Whether a capture comes in colour: by its header for ser files, always for films."""
    ext = F.lower(extension)
    return F.when(ext == "ser", F.coalesce(color_id.isin(8, 9, 10, 11, 16, 17), F.lit(False))).otherwise(F.coalesce(ext.isin("avi", "mov", "mp4", "m4v"), F.lit(False)))


def created_at(text: Column) -> Column:
    """Timestamp of a server's ISO 8601 text with a zone, with fractions of a second or without; else the year 1, so that
    such rows sort first."""
    known = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX")))
    return F.coalesce(known, F.timestamp_millis(F.lit(-62135596800000)))
