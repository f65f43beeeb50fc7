"""Classification of resource files as Column expressions: formats by content and name, kinds, platform paths, locks."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of each kind.
KINDS = {
    "image": ["png", "jpeg", "heic", "heif", "webp", "gif", "tiff", "bmp", "avif", "jxl", "ico", "icns", "psd"],
    "vector": ["svg", "pdf"],
    "video": ["mp4", "mov", "m4v", "webm", "avi"],
    "audio": ["mp3", "m4a", "aac", "wav", "ogg", "caf", "flac", "aiff"],
    "animation": ["svga", "vap", "tcmp4", "lottie", "pag"],
    "font": ["ttf", "otf", "woff", "woff2"],
    "archive": ["zip", "gz", "br", "7z", "rar", "tar"],
    "localization": ["xcstrings", "strings", "stringsdict"],
    "data": ["json", "yaml", "yml", "toml", "xml", "plist", "html", "css", "js", "bin", "dat", "txt", "csv", "db", "sqlite"],
}
# Format of an extension that is not its own name.
EXTENSIONS = {"jpg": "jpeg", "jpe": "jpeg", "tif": "tiff", "heics": "heic", "": "unknown"}
# Format of a file's first bytes, in hex, first match.
MAGIC = [("504147", "pag"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("474946383761", "gif"), ("474946383961", "gif"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("424D", "bmp"), ("255044462D", "pdf")]
# Media brands of each format, first match.
BRANDS = [("avif", ["avif", "avis"]), ("heic", ["heic", "heix", "hevc", "hevx"]), ("heif", ["mif1", "msf1"])]
# Names and extensions of source and tooling files.
TOOLING_NAMES = ["LICENSE", "Makefile", "Podfile", "Gemfile", "Rakefile"]
TOOLING_EXTENSIONS = ["swift", "rs", "m", "mm", "h", "c", "cc", "cpp", "hpp", "kt", "java", "py", "pyc", "pyo", "sh", "rb", "toml", "lock", "md", "yml", "yaml", "pbxproj", "xcscheme", "xcworkspacedata", "xcuserstate", "xcconfig", "entitlements", "resolved"]
# Resource directory types and density qualifiers.
RES_TYPES = ["anim", "animator", "color", "drawable", "font", "interpolator", "layout", "menu", "mipmap", "navigation", "raw", "transition", "values", "xml"]
WEBP_LOSSY_SDK, WEBP_FULL_SDK = 14, 18


def _ascii(text: str) -> Column:
    return F.unhex(F.lit(text.encode().hex()))


def _is_one_of(values: list[str]):
    """A predicate on BINARY: one of these ASCII strings."""
    return lambda b: reduce(operator.or_, (b == F.unhex(F.lit(v.encode().hex())) for v in values))


def actual_format(header: Column) -> Column:
    """Format by a BINARY header, or null."""
    out = None
    for magic, name in MAGIC:
        hit = F.substring(header, 1, len(magic) // 2) == F.unhex(F.lit(magic))
        out = F.when(hit, name) if out is None else out.when(hit, name)
        if name == "jpeg":
            out = out.when((F.substring(header, 1, 4) == F.unhex(F.lit(b"RIFF".hex()))) & (F.substring(header, 9, 4) == F.unhex(F.lit(b"WEBP".hex()))), "webp")
    size = F.conv(F.hex(F.substring(header, 1, 4)), 16, 10).cast("long")
    box = (F.substring(header, 5, 4) == F.unhex(F.lit(b"ftyp".hex()))) & (F.octet_length(header) >= 16) & (size >= 16)
    count = F.floor((F.least(size, F.octet_length(header).cast("long")) - 8) / 4).cast("int")
    brands = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(header, i * 4 + 9, F.lit(4)))
    for name, known in BRANDS:
        out = out.when(box & F.exists(brands, _is_one_of(known)), name)
    return out


def extension_of(path: Column) -> Column:
    """Lower-case extension of a path's last part, without dot; empty if there is none or the name only starts with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def extension_format(extension: Column) -> Column:
    out = None
    for ext, name in EXTENSIONS.items():
        out = F.when(extension == ext, name) if out is None else out.when(extension == ext, name)
    return out.otherwise(extension)


def kind(fmt: Column) -> Column:
    out = None
    for name, formats in KINDS.items():
        out = F.when(fmt.isin(formats), name) if out is None else out.when(fmt.isin(formats), name)
    return out.otherwise("unclassified")


def looks_like_lottie(text: Column) -> Column:
    has = lambda word: text.contains(f'"{word}"')
    return F.ltrim(text).startswith("{") & has("v") & has("fr") & (has("ip") | has("op") | has("layers"))


def is_source_or_tooling(name: Column, extension: Column) -> Column:
    return name.startswith(".") | name.isin(TOOLING_NAMES) | extension.isin(TOOLING_EXTENSIONS)


def android(path: Column) -> Column:
    """Struct of what a project path says of an Android resource, or null: module, source_set, area, res_type, qualifiers, density, rtl, api_level, name, nine_patch."""
    parts = F.split(path, "/")
    n = F.size(parts)
    at = lambda i: F.get(parts, i)
    windows = F.filter(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: (F.get(parts, i) == "src") & (F.get(parts, i + 2) == "assets"))
    asset = F.get(windows, F.lit(0))
    is_asset = F.coalesce(asset + 3 < n, F.lit(False))
    join = lambda upto: F.array_join(F.slice(parts, F.lit(1), upto), "/")
    folder = F.split(at(n - 2), "-")
    is_res = F.coalesce((n >= 3) & (at(n - 3) == "res") & F.get(folder, F.lit(0)).isin(RES_TYPES), F.lit(False))
    quals = F.slice(folder, 2, F.greatest(F.size(folder) - 1, F.lit(0)))
    in_src = F.coalesce((n >= 5) & (at(n - 5) == "src"), F.lit(False))
    stem = F.get(F.split(at(n - 1), r"\."), F.lit(0))
    level = F.filter(F.transform(quals, lambda q: F.regexp_extract(q, r"^v(\d+)$", 1)), lambda q: q != "")
    none = F.lit(None).cast("string")
    assets = F.struct(join(asset).alias("module"), at(asset + 1).alias("source_set"), F.lit("assets").alias("area"), none.alias("res_type"), F.array().cast("array<string>").alias("qualifiers"), none.alias("density"), F.lit(False).alias("rtl"), F.lit(None).cast("int").alias("api_level"), none.alias("name"), F.lit(False).alias("nine_patch"))
    res = F.struct(
        F.when(in_src, join(n - 5)).otherwise(join(n - 3)).alias("module"), F.when(in_src, at(n - 4)).otherwise("").alias("source_set"), F.lit("res").alias("area"),
        F.get(folder, F.lit(0)).alias("res_type"), quals.alias("qualifiers"), F.get(F.filter(quals, lambda q: q.endswith("dpi")), F.lit(0)).alias("density"),
        F.array_contains(quals, "ldrtl").alias("rtl"), F.get(level, F.lit(0)).cast("int").alias("api_level"), F.when(stem != "", stem).alias("name"), F.lower(at(n - 1)).endswith(".9.png").alias("nine_patch"),
    )
    return F.when(is_asset, assets).when(is_res, res)


def format_lock(info: Column) -> Column:
    """Why a platform fixes a resource's format, from android(); null if it does not."""
    return F.when(info["nine_patch"], "android_nine_patch").when(info["res_type"] == "mipmap", "android_launcher_icon").when(info["res_type"] == "raw", "android_raw_resource")


def webp_compatibility(min_sdk: Column, lossless: Column, alpha: Column) -> Column:
    """Reason why a WebP can't be used at an API level, or null."""
    need = F.when(lossless | alpha, WEBP_FULL_SDK).otherwise(WEBP_LOSSY_SDK)
    return F.when(min_sdk.isNull(), "android_min_sdk_unknown").when(min_sdk < need, F.concat(F.lit("android_min_sdk_"), min_sdk.cast("string"), F.lit("_below_webp_requirement_"), need.cast("string")))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def lookup_name(path: Column) -> Column:
    """File stem in ASCII lower case, without a scale mark."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return ascii_lower(F.regexp_replace(stem, "@[23]x$", ""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def variant_key(path: Column) -> Column:
    """Identity of the asset that a file is a variant of."""
    folder, info = parent(path), android(path)
    stem = ascii_lower(F.regexp_replace(F.regexp_extract(path, r"([^/.]*)[^/]*$", 1), "@[23]x$", ""))
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "/")
    return F.when(folder.rlike(r"[^/]\.(imageset|appiconset)$"), folder).when(info["area"] == "res", joined(info["module"], info["source_set"], info["res_type"], stem)).otherwise(joined(folder, stem))


def policy_key(fmt: Column, info: Column, origin: Column, lock: Column, exclusion: Column) -> Column:
    """Resources of equal content and policy key are treated alike."""
    android_class = F.concat_ws(":", F.lit("android"), info["area"], F.coalesce(info["res_type"], F.lit("-")))
    place = F.when(info.isNotNull(), android_class).when(origin == "catalog_rendition", "catalog").otherwise("loose")
    return F.concat_ws("|", fmt, place, F.coalesce(lock, F.lit("-")), F.coalesce(exclusion, F.lit("-")))


def palette_size(quality: Column) -> Column:
    return F.when(quality >= 90, 256).when(quality >= 80, 128).when(quality >= 70, 64).when(quality >= 50, 32).otherwise(16)


def header_pixels(header: Column) -> Column:
    """Width times height of a PNG or WebP header (of its first chunk: VP8X, lossless VP8L or lossy VP8), or null."""
    size = F.octet_length(header)
    big = lambda at: F.conv(F.hex(F.substring(header, at, 4)), 16, 10).cast("long")
    little = lambda at, n: F.conv(F.concat(*[F.hex(F.substring(header, at + k, 1)) for k in reversed(range(n))]), 16, 10).cast("long")
    is_png = (F.substring(header, 1, 8) == F.unhex(F.lit(MAGIC[1][0]))) & (size >= 24)
    chunk = lambda name: (F.substring(header, 1, 4) == _ascii("RIFF")) & (F.substring(header, 9, 8) == _ascii("WEBP" + name))
    packed = little(22, 4)
    lossless = (packed.bitwiseAND(F.lit(0x3FFF)) + 1) * (F.shiftright(packed, 14).bitwiseAND(F.lit(0x3FFF)) + 1)
    lossy = little(27, 2).bitwiseAND(F.lit(0x3FFF)) * little(29, 2).bitwiseAND(F.lit(0x3FFF))
    out = F.when(is_png, big(17) * big(21)).when(chunk("VP8X") & (size >= 30), (little(25, 3) + 1) * (little(28, 3) + 1))
    return out.when(chunk("VP8L") & (size >= 25) & (F.substring(header, 21, 1) == F.unhex(F.lit("2F"))), lossless).when(chunk("VP8 ") & (size >= 30) & (F.substring(header, 24, 3) == F.unhex(F.lit("9D012A"))), lossy)


def safe_entry_name(name: Column) -> Column:
    """Whether an archive entry's name is safe to unpack."""
    parts = F.split(F.regexp_replace(name, "/$", ""), "/")
    return (name != "") & (F.octet_length(name) <= 1024) & ~name.rlike(r"[\\:\x00-\x1F\x7F]") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def is_archive_metadata(name: Column) -> Column:
    return name.rlike(r"(^|/)(__MACOSX(/|$)|\.DS_Store$|\._[^/]*$)")


def blocks_rewrite(name: Column) -> Column:
    """Whether an entry's name says that the archive is signed or listed by digest."""
    return ascii_lower(name).rlike(r"(^|/)(manifest|pack-info|sniff)\.json$|^meta-inf/|_codesignature/|\.sig(nature)?$")


def score_label(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("poor")


def blocked_reason(smaller: Column, artifact: Column, exclusion: Column, lock: Column, crossing: Column) -> Column:
    return F.when(~smaller, "no_smaller_candidate").when(~artifact, "failed_verification").when(exclusion.isNotNull(), exclusion).when(lock.isNotNull() & crossing, lock).otherwise("")
