"""Paths, node ids and repository names (SC5, SC6, SC9, SC17, SC22, SC23, FLT1-FLT3, FLT18, FLT20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language of each file extension, and the extensions that are analysed.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "javascript",
    ".tsx": "tsx",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".cs": "c_sharp",
    ".go": "go",
    ".rs": "rust",
}
SOURCE_EXTENSIONS = (".py", ".java", ".js", ".ts", ".cpp", ".c", ".h", ".hpp", ".cc", ".cxx", ".cs")
PARSED_LANGUAGES = ("python", "java", "javascript", "cpp", "c")
SKIPPED_FOLDERS = ("__pycache__", "node_modules", ".venv")
PATH_PREFIXES = ("/source_code/", "source_code/", "/projects/", "projects/")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; '' without one. A leading dot starts a name, not an extension."""
    return F.lower(F.regexp_extract(basename(path), r"[^.][^/]*?(\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def language(path: Column) -> Column:
    """FLT1: null for extensions without a language."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, extension(path))


def is_source(path: Column) -> Column:
    return extension(path).isin(*LANGUAGES) & ~in_skipped_folder(path)


def in_skipped_folder(path: Column) -> Column:
    """FLT3: whether a folder on the way starts with a dot or is a vendor folder."""
    names = "|".join(x for x in SKIPPED_FOLDERS if not x.startswith("."))
    return F.rlike(path, F.lit(rf"(^|/)(\.[^/]+|{names})/"))


def normalize(path: Column, prefixes: Sequence[str] = PATH_PREFIXES) -> Column:
    """SC5: forward slashes, what follows the first of ``prefixes`` that occurs, no leading slash."""
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    out = p
    for prefix in reversed(prefixes):
        at = F.instr(p, prefix)
        out = F.when(at > 0, F.substring(p, at + len(prefix), F.length(p))).otherwise(out)
    return F.ltrim(out, F.lit("/"))


def node_id(path: Column, class_name: Column, name: Column) -> Column:
    """SC9: path::class::name with an empty class where there is none."""
    return F.concat_ws("::", path, F.coalesce(class_name, F.lit("")), name)


def split_node_id(node: Column) -> Column:
    """Struct (path, class_name, name); the name is the last part whatever the number of parts."""
    parts = F.split(node, "::")
    return F.struct(F.get(parts, F.lit(0)).alias("path"), F.get(parts, F.lit(1)).alias("class_name"), F.element_at(parts, -1).alias("name"))


def is_node_id(node: Column) -> Column:
    """FLT18: three parts."""
    return F.size(F.split(node, "::")) == 3


def import_file(path: Column) -> Column:
    """SC22: dotted import to a file name."""
    return F.concat(F.replace(path, F.lit("."), F.lit("/")), F.lit(".py"))


def repository_name(url: Column) -> Column:
    """SC23: the last part without '.git'; 'cloned_repo' if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")
    name = F.regexp_extract(name, r"([^/:]*)$", 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("cloned_repo"))


def structural(path1: Column, path2: Column) -> Column:
    """JN17, SC17: array (same file, same folder, difference of depth) as doubles."""
    same = lambda a, b: (a == b).cast("double")
    return F.array(same(path1, path2), same(dirname(path1), dirname(path2)), F.abs(depth(path1) - depth(path2)).cast("double"))
