"""Images of articles: sizes told by URLs, which picture may head a story, how good it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of URLs that name site furniture, and formats that are no photographs.
JUNK = (
    "emoji", "avatar", "gravatar", "logo", "icon", "sprite", "spacer", "blank.", "pixel", "placeholder", "default-", "1x1", "transparent",
    "/ads/", "doubleclick", "s.w.org", "feedburner", "share-", "badge",
)
BAD_FORMATS = (".svg", ".gif", ".ico", ".bmp")
# Sizes in URLs, and the resizing host whose width stands in the path.
SIZE_IN_URL = r"(?<!\d)(\d{3,4})\s*[xX]\s*(\d{3,4})(?!\d)"
RESIZED = r"(ichef\.bbci\.co\.uk/(?:ace/)?[a-z]+/)(\d{2,4})(/)"
UPGRADE_WIDTH = 1024


def url_size(url: Column) -> tuple[Column, Column]:
    """Width and height written in a URL as WxH, 100 to 6000 each; null if there is none."""
    w, h = (F.regexp_extract(F.coalesce(url, F.lit("")), SIZE_IN_URL, i).try_cast("int") for i in (1, 2))
    fits = w.between(100, 6000) & h.between(100, 6000)
    return F.when(fits, w), F.when(fits, h)


def upgraded(url: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """URL, width and height of the large variant where the path tells a smaller width; the height scales along."""
    told = F.regexp_extract(F.coalesce(url, F.lit("")), RESIZED, 2).try_cast("int")
    small = told < UPGRADE_WIDTH
    known = (width > 0) & (height != 0)
    larger = F.regexp_replace(url, RESIZED, f"$1{UPGRADE_WIDTH}$3")
    scaled = F.bround(height * (UPGRADE_WIDTH / width.cast("double"))).cast("int")
    return F.when(small, larger).otherwise(url), F.when(small, F.when(known, F.lit(UPGRADE_WIDTH))).otherwise(width), F.when(small, F.when(known, scaled)).otherwise(height)


def declared_size(url: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The size to trust: the resizing path's where it disagrees, else what is stored, else what the URL says."""
    told = F.regexp_extract(F.coalesce(url, F.lit("")), RESIZED, 2).try_cast("int")
    known = F.coalesce((width > 0) & (height != 0), F.lit(False))
    w, h = url_size(url)
    scaled = F.bround(height * (told / width.cast("double"))).cast("int")
    out_w = F.when(told.isNotNull(), told).when(known, width).otherwise(w)
    out_h = F.when(told.isNotNull(), F.when(known, F.when(width == told, height).otherwise(scaled))).when(known, height).otherwise(h)
    return out_w, out_h


def usable(url: Column, width: Column, height: Column) -> Column:
    """Whether a URL may be a story's photograph; a proven large size outranks a suspicious name."""
    low = F.lower(url)
    path = F.substring_index(low, "?", 1)
    bad = F.lit(False)
    for form in BAD_FORMATS:
        bad = bad | path.endswith(form)
    junk = F.lit(False)
    for word in JUNK:
        junk = junk | F.contains(low, F.lit(word))
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    uw, uh = url_size(url)
    w, h = F.when(known, width).otherwise(uw), F.when(known, height).otherwise(uh)
    large = F.coalesce((w >= 400) & (w * h >= 240_000), F.lit(False))
    web = url.startswith("http://") | url.startswith("https://")
    return F.coalesce(web & ~bad & (large | ~junk), F.lit(False))


def image_score(width: Column, height: Column, url: Column) -> Column:
    """How good an image is: 0 if unusable, 1 if its size is unknown, else by area, more for a wide frame."""
    w, h = declared_size(url, width, height)
    uw, uh = url_size(url)
    w, h = F.coalesce(w, uw), F.coalesce(h, uh)
    aspect = F.try_divide(w, h)
    good = F.round(F.sqrt((w * h).cast("double")) / 100 * F.when(aspect.between(1.3, 2.1), 1.25).otherwise(1.0), 4)
    rated = F.when(w.isNull() | h.isNull(), 1.0).when((w < 200) | (h < 120), 0.3).when((aspect < 0.4) | (aspect > 3.5), 0.2).otherwise(good)
    return F.when(usable(url, width, height), rated).otherwise(0.0)


def card_image(url: Column, width: Column, height: Column, fallback: str) -> Column:
    """The image of a share card: the story's if its size is unknown or 300 by 200 at least, else the site's."""
    w, h = declared_size(url, width, height)
    web = F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))
    small = F.coalesce((w < 300) | (h < 200), F.lit(False)) & w.isNotNull() & h.isNotNull()
    return F.when(web & ~small, url).otherwise(F.lit(fallback))
