"""Path, name and string Column functions (no Python UDF; all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlake.functions.util import col

# Image file extensions accepted by the listing (lower case,
# with the dot), and the tensor extension accepted next to them.
IMAGE_EXTS = (
    ".apng", ".blp", ".bmp", ".bufr", ".bw", ".cur", ".dcx", ".dds", ".dib", ".emf", ".eps",
    ".fit", ".fits", ".flc", ".fli", ".ftc", ".ftu", ".gbr", ".gif", ".grib", ".h5", ".hdf",
    ".icb", ".icns", ".ico", ".iim", ".im", ".j2c", ".j2k", ".jfif", ".jp2", ".jpc", ".jpe",
    ".jpeg", ".jpf", ".jpg", ".jpx", ".mpeg", ".mpg", ".mpo", ".msp", ".pbm", ".pcd", ".pcx",
    ".pfm", ".pgm", ".png", ".pnm", ".ppm", ".ps", ".psd", ".pxr", ".qoi", ".ras", ".rgb",
    ".rgba", ".sgi", ".tga", ".tif", ".tiff", ".vda", ".vst", ".webp", ".wmf", ".xbm", ".xpm",
)
TENSOR_EXT = ".npy"

# Python's splitext: the extension starts at the last dot of the base name,
# unless every character before that dot is a dot as well.
_EXT_RE = r"(?s)\A(.*/)?\.*[^./][^/]*?(\.[^./]*)\z"


def norm_path(path) -> Column:
    """backslashes become forward slashes."""
    return F.translate(col(path), "\\", "/")


def path_ext(path) -> Column:
    """``os.path.splitext(p)[1]`` ('' when there is none)."""
    return F.regexp_extract(col(path), _EXT_RE, 2)


def path_stem(path) -> Column:
    """``os.path.splitext(p)[0]`` (the whole path without its extension)."""
    p = col(path)
    return p.substr(F.lit(1), F.length(p) - F.length(path_ext(p)))


def last_dot_ext(path) -> Column:
    """P2 helper: lower-cased text after the last '.' of the whole path
    (the whole path when there is no dot)."""
    return F.lower(F.substring_index(col(path), ".", -1))


def top_dir(path) -> Column:
    """first path component, '' for a file at the root."""
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise(F.lit(""))


def base_name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def extract_id(path) -> Column:
    """pairing id of an image or latent file.

    Extension dropped, backslashes normalised; only when the path has a folder
    is the base name stripped of ``img-latents-`` or else of a leading ``img``.
    """
    stem = norm_path(path_stem(path))
    folder = F.regexp_extract(stem, r"^(.*/)", 1)
    base = F.regexp_replace(base_name(stem), r"^(img-latents-|img)", "")
    return F.when(F.instr(stem, "/") > 0, F.concat(folder, base)).otherwise(stem)


def zero_pad(value, width: int) -> Column:
    """``f'{i:0{width}d}'``; pads but never truncates (unlike ``lpad``)."""
    return F.format_string(f"%0{int(width)}d", col(value).cast("long"))


def shard_name(index, kind: str = "image") -> Column:
    """converted-dataset member name, 1000 rows per shard folder."""
    idx8 = zero_pad(index, 8)
    shard = idx8.substr(1, 5)
    if kind == "image":
        return F.concat(shard, F.lit("/img"), idx8, F.lit(".png"))
    if kind == "latent":
        return F.concat(shard, F.lit("/img-latents-"), idx8, F.lit(".npy"))
    raise ValueError(f"unknown shard kind {kind!r}")


def latent_name(stem, index) -> Column:
    """original stem + '.npy'; the index-based latent name when the stem is
    null or empty."""
    s = F.nullif(col(stem), F.lit(""))
    return F.coalesce(F.concat(s, F.lit(".npy")), shard_name(index, "latent"))


def parse_resolution(text, strict: bool = True) -> Column:
    """F8: ``'WxH'`` or ``'W,H'`` -> struct(width, height); anything else is an
    error (``strict``) or NULL."""
    t = col(text)
    pat = r"^(\d+)[x,](\d+)$"
    ok = t.rlike(pat)
    parsed = F.struct(
        F.regexp_extract(t, pat, 1).cast("long").alias("width"),
        F.regexp_extract(t, pat, 2).cast("long").alias("height"),
    )
    if strict:
        return F.when(ok, parsed).otherwise(
            F.raise_error(F.concat(F.lit("not a size of two numbers: "), F.coalesce(t, F.lit("NULL"))))
        )
    return F.when(ok, parsed)


def is_url(url, allow_file_urls: bool = False) -> Column:
    """contains '://', has a scheme and a network location, and the
    location contains a dot."""
    u = col(url)
    scheme_netloc = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
    netloc = F.regexp_extract(u, scheme_netloc, 1)
    ok = u.contains("://") & u.rlike(scheme_netloc) & (F.instr(netloc, ".") > 0)
    if allow_file_urls:
        ok = ok | u.startswith("file://")
    return F.coalesce(ok, F.lit(False))


CACHE_NAME_CHARS = 128


def cache_name_was_cut(name, chars: int = CACHE_NAME_CHARS) -> Column:
    """True where ``cache_name`` does not hold the whole name."""
    return F.length(col(name)) > chars


def cache_name(url, name, chars: int = CACHE_NAME_CHARS) -> Column:
    """``md5(url) + '_' + name`` with unsafe characters replaced by '_' and
    the safe name cut to ``chars`` characters (see ``cache_name_was_cut``)."""
    safe = F.regexp_replace(col(name), r"[^0-9a-zA-Z\-._]", "_")
    return F.concat(F.md5(col(url)), F.lit("_"), F.substring(safe, 1, chars))


def disposition_name(header, url) -> Column:
    """``filename="..."`` from a Content-Disposition header, else the url."""
    h = F.coalesce(col(header), F.lit(""))
    found = F.regexp_extract(h, r'filename="([^"]*)"', 1)
    has = h.rlike(r'filename="([^"]*)"')
    return F.when(has, found).otherwise(col(url))


def parse_run_name(name) -> Column:
    """fields of a sample-folder name built as
    ``{model}-{ckpt}-size-{res}-vae-invae-cfg-{cfg}-seed-{seed}-{mode}-{gh}-{cls}-pathdrop-{b}[-balanced]``."""
    n = col(name)
    pat = (r"^(.+)-([^-]+)-size-(\d+)-vae-invae-cfg-([^-]+)-seed-(-?\d+)-([^-]+)-([^-]+)-([^-]+)"
           r"-pathdrop-(True|False)(-balanced)?$")
    return F.when(n.rlike(pat), F.struct(
        F.regexp_extract(n, pat, 1).alias("model"),
        F.regexp_extract(n, pat, 2).alias("ckpt"),
        F.regexp_extract(n, pat, 3).cast("int").alias("resolution"),
        F.regexp_extract(n, pat, 4).cast("double").alias("cfg_scale"),
        F.regexp_extract(n, pat, 5).cast("long").alias("seed"),
        F.regexp_extract(n, pat, 6).alias("mode"),
        F.regexp_extract(n, pat, 7).cast("double").alias("guidance_high"),
        F.regexp_extract(n, pat, 8).cast("double").alias("cls_cfg_scale"),
        (F.regexp_extract(n, pat, 9) == "True").alias("path_drop"),
        (F.regexp_extract(n, pat, 10) != "").alias("balanced"),
    ))


def is_image_file(path) -> Column:
    """Extension after the last dot of the whole path is an image type."""
    return F.concat(F.lit("."), last_dot_ext(path)).isin(list(IMAGE_EXTS))


def is_supported_file(path, exts=IMAGE_EXTS + (TENSOR_EXT,)) -> Column:
    """Lower-cased splitext extension is an image type or '.npy'."""
    return F.lower(path_ext(path)).isin(list(exts))
