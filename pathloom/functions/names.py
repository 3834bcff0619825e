"""Expressions over names, paths, attributes and cursors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECTORY, REPARSE, ROOT, DEPTH, PATH_UNITS = 0x10, 0x400, 5, 1024, 32760
CREATED, DELETED, RENAMED_FROM, RENAMED_TO, LINKED = 0x100, 0x200, 0x1000, 0x2000, 0x10000

#: Extensions of each category.
CATEGORIES = {
    "images": "jpg jpeg png gif webp bmp ico svg heic heif avif tif tiff".split(),
    "documents": "pdf doc docx xls xlsx ppt pptx txt md rtf odt ods odp csv".split(),
    "videos": "mp4 mkv mov avi wmv webm flv m4v mpeg mpg".split(),
    "audio": "mp3 wav flac aac m4a ogg wma opus".split(),
    "archives": "zip 7z rar tar gz bz2 xz iso".split(),
}
ALL, FILES, FOLDERS = ("", "all"), ("files", "file"), ("folders", "directories", "folder")


def extension(name: Column) -> Column:
    """The text after the last dot; null without a dot, empty after a trailing one."""
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """The path before the last slash; empty without one."""
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise("")


def is_directory(attributes: Column) -> Column:
    return attributes.bitwiseAND(F.lit(DIRECTORY)) != 0


def ordinary_directory(attributes: Column) -> Column:
    """A directory that is no reparse point: the only kind that can be a parent."""
    return attributes.bitwiseAND(F.lit(DIRECTORY | REPARSE)) == DIRECTORY


def of_category(kind: str, attributes: Column, folded: Column) -> Column:
    """Whether a row belongs to a kind or a category of files; ValueError for an unknown one."""
    if kind in ALL:
        return F.lit(True)
    if kind in FILES:
        return ~is_directory(attributes)
    if kind in FOLDERS:
        return is_directory(attributes)
    if kind not in CATEGORIES:
        raise ValueError(f"unknown category {kind!r}")
    return ~is_directory(attributes) & F.coalesce(extension(folded).isin(CATEGORIES[kind]), F.lit(False))


def ordinary_object(identity: Column, root: int = ROOT) -> Column:
    """False for the volume's own objects: a slot (the low 48 bits) under 24, but for the root."""
    return (identity.bitwiseAND(F.lit((1 << 48) - 1)) >= 24) | (identity == root)


def any_bit(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask)) != 0


def all_bits(bits: Column, mask: Column) -> Column:
    return bits.bitwiseAND(mask) == mask


def retained(journal: str, first: Column, lowest: Column, following: Column, cursor_journal: str, cursor: Column) -> Column:
    """Whether a cursor can go on: the same journal, and the cursor inside what it still holds."""
    return (F.col(journal) == F.col(cursor_journal)) & (cursor >= F.greatest(first, lowest)) & (cursor <= following)


def valid_name(name: Column) -> Column:
    """A name of 1 to 255 UTF-16 units that is no dot entry and has no separator."""
    units = F.octet_length(F.encode(name, "UTF-16LE")) / 2
    return F.coalesce((units >= 1) & (units <= 255) & ~name.isin(".", "..") & ~name.rlike(r"[\x00/:\\]"), F.lit(False))


def valid_change_path(path: Column) -> Column:
    """A relative path of at most 4096 bytes without empty, dot or dot-dot parts, colons or NUL."""
    parts = F.split(path, "/")
    return F.coalesce(
        (F.octet_length(path) <= 4096) & ~path.rlike(r"[\x00:]") & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False)
    )


def under(path: Column, top: Column) -> Column:
    """Whether path is top or below it."""
    return (path == top) | F.startswith(path, F.concat(top, F.lit("/")))


def path_key(path: Column) -> Column:
    """Sorts as paths do, component by component, not as strings."""
    return F.split(path, "/")


def trigrams(text: Column) -> Column:
    """The distinct stretches of three characters; the text is computed once, though each stretch is cut from it."""

    def cut(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
        return F.array_distinct(F.when(F.length(t) < 3, F.array().cast("array<string>")).otherwise(every))

    return F.get(F.transform(F.array(text), cut), F.lit(0))


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a string key: the first 32 bits of its MD5, modulo the number of shards; null keys go to 0."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % shards, F.lit(0)).cast("int")
