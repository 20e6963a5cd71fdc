"""Scalar expressions over names, paths, keys and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_key(level: Column, node_id: Column) -> Column:
    """``level:`` and the percent-encoded id (unreserved characters stay)."""
    encoded = F.replace(F.replace(F.replace(F.url_encode(node_id), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(level, F.lit(":"), encoded)


def key_level(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def key_id(key: Column) -> Column:
    """Decoded id of a key (null without a colon)."""
    after = F.substring(key, F.length(key_level(key)) + 2, F.length(key))
    return F.when(F.contains(key, F.lit(":")), F.url_decode(F.replace(after, F.lit("+"), F.lit("%2B"))))


def explorer_level(level: Column) -> Column:
    """Levels shown as such; everything else is an operation."""
    return F.when(level.isin("paper", "semantic", "module", "source"), level).otherwise("operation")


def normal_text(text: Column) -> Column:
    """Lowered, ``- / .`` and other punctuation as underscores."""
    return F.regexp_replace(F.translate(F.lower(text), "-/.", "___"), "[^a-z0-9_]+", "_")


def keyword_hit(text: Column, keyword: Column) -> Column:
    """Substring, also with the underscores of both sides deleted (deliberately loose)."""
    bare = lambda c: F.replace(c, F.lit("_"), F.lit(""))
    return F.contains(text, keyword) | F.contains(bare(text), bare(keyword))


def normal_path(path: Column) -> Column:
    """Forward slashes, ``.`` parts collapsed, leading dots and slashes stripped."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"/+(\./+)*", "/")
    return F.regexp_replace(F.regexp_replace(p, r"(?<=.)/(\.)?$", ""), r"^[./]+", "")


def same_path(left: Column, right: Column) -> Column:
    """Equal, or one is a suffix of the other at a slash."""
    slash = F.lit("/")
    return (left == right) | F.endswith(left, F.concat(slash, right)) | F.endswith(right, F.concat(slash, left))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def tail(symbol: Column) -> Column:
    """Last dotted part."""
    return F.element_at(F.split(symbol, r"\."), -1)


def collapsed_path(path: Column) -> Column:
    """Empty and ``.`` parts dropped, ``..`` takes the part before it."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(folded, "/")


def config_candidates(kind: Column, path: Column, name: Column) -> Column:
    """Candidate files of a configuration reference; ``.yaml`` and ``.yml`` where no suffix is given."""
    joined = F.when(kind == "hydra", F.concat_ws("/", path, name)).otherwise(path)
    full = collapsed_path(joined)
    return F.when(F.regexp_like(full, F.lit(r"\.[A-Za-z0-9]+$")), F.array(full)).otherwise(F.array(F.concat(full, F.lit(".yaml")), F.concat(full, F.lit(".yml"))))


def safe_id(text: Column) -> Column:
    """Other characters than letters, digits, ``_ . -`` become one underscore; ends trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", "")


def sequence_id(prefix: str, number: Column) -> Column:
    """``prefix.0000000`` style ids."""
    return F.format_string("%s.%07d", F.lit(prefix), number.cast("long"))


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 1 where there is nothing to count."""
    return F.when(d == 0, F.lit(1.0)).otherwise(n / d)


def confidence(value: Column, missing: float) -> Column:
    """Clamped to 0..1, ``missing`` where it is absent."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value.cast("double"), F.lit(missing))))


def phase_matches(phase: Column, wanted: str | None) -> Column:
    """No request takes all, ``both`` always matches, a missing phase counts as both, an invalid one never matches."""
    if wanted is None:
        return F.lit(True)
    have = F.coalesce(phase, F.lit("both"))
    return F.when(have == "both", True).when(have.isin("training", "inference"), have == wanted if wanted != "both" else F.lit(True)).otherwise(False)


def call_shape(callee: Column) -> Column:
    """Class of an unresolved callee by its spelling."""
    return (
        F.when(F.startswith(callee, F.lit("super.")), "super_method")
        .when(F.startswith(callee, F.lit("self.")), "self_attribute")
        .when(F.startswith(callee, F.lit("<dynamic>")), "call_result_attribute")
        .when(~F.contains(callee, F.lit(".")), "bare_callable")
        .otherwise("receiver_attribute")
    )


def inferred_identity(kind: Column, level: Column) -> Column:
    """Identity of a node of the oldest documents; the order of the cases matters."""
    return (
        F.when((kind == "source") | (level == "source"), "source")
        .when(kind.isin("module", "operation"), "definition")
        .when(kind.isin("tensor", "input", "output"), "value")
        .when(kind.isin("parameter", "config"), "state")
        .otherwise("group")
    )


def module_name(path: Column) -> Column:
    """Dotted module of a ``.py`` path; a package's ``__init__`` is the package."""
    dotted = F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def version_matches(found: Column, expected: Column) -> Column:
    """Equal, apart from a local ``+`` suffix."""
    return F.split_part(found, F.lit("+"), F.lit(1)) == expected


def attribute_parts(attributes_json: Column) -> Column:
    """Entries of a JSON object as structs (key, kind, text, items), by key.

    ``kind`` is scalar (text, number or truth value: ``text``), list (its scalar items:
    ``items``) or other; numbers keep their JSON form.
    """
    entries = F.array_sort(F.map_entries(F.from_json(attributes_json, "map<string,variant>")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    plain = lambda v: ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & ~F.startswith(F.schema_of_variant(v), F.lit("ARRAY")) & (F.schema_of_variant(v) != "VOID")
    listed = lambda v: F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    items = lambda v: F.transform(F.filter(v.try_cast("array<variant>"), plain), lambda x: x.try_cast("string"))

    def one(e: Column) -> Column:
        v = e["value"]
        kind = F.when(plain(v), "scalar").when(listed(v), "list").otherwise("other")
        return F.struct(e["key"].alias("key"), kind.alias("kind"), F.when(plain(v), v.try_cast("string")).alias("text"), F.when(listed(v), items(v)).alias("items"))

    return F.transform(entries, one)


def shape_text(shape: Column) -> Column:
    """A tensor shape as its list form, such as ``[1, 'b', 3]`` (empty for none)."""
    sizes = F.transform(shape, lambda d: F.coalesce(d["size"].cast("string"), F.concat(F.lit("'"), d["symbol"], F.lit("'"))))
    return F.when(F.size(shape) > 0, F.concat(F.lit("["), F.array_join(sizes, ", "), F.lit("]"))).otherwise("")
