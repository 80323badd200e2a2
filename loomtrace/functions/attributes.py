"""Typed attributes of events and cases, nested ones included: read, set and removed by path, as columns.

Attributes are a map from key to (kind, value, children). children is JSON with one list for each kind, of objects
_key and _value; lists and containers have the same under values. A path is a key, or a key and the key of a child.
Nulls stay null: a null map has no attributes, and setting one in it makes a map of one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("string", "date", "int", "float", "boolean", "id")
ENTRY = "struct<kind:string,value:string,children:string>"
ATTRS = f"map<string,{ENTRY}>"
_LEAVES = ",".join(f"{k}:array<struct<_key:string,_value:string>>" for k in KINDS)
_CHILDREN = f"struct<{_LEAVES},values:struct<{_LEAVES}>>"


def _entry(kind: str | Column, value: Column, children: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.cast("string").alias("value"), (text if children is None else children).alias("children"))


_NONE = "array<struct<kind:string,key:string,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, so that edits on top of edits stay small plans."""
    return F.transform(F.array(value), body)[0]


def _own(attrs: Column) -> Column:
    return F.coalesce(attrs, F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{ENTRY}>>")))


def _below(entry: Column) -> Column:
    """Array of (kind, key, value) below an entry, those of a list or container too; null without any."""
    leaves = lambda at, k: F.coalesce(F.transform(at[k], lambda x: F.struct(F.lit(k).alias("kind"), x["_key"].alias("key"), x["_value"].alias("value"))), F.array().cast(_NONE))
    rows = _let(F.from_json(entry["children"], _CHILDREN), lambda tree: F.concat(*[leaves(at, k) for at in (tree, tree["values"]) for k in KINDS]))
    return F.when(entry["children"].isNotNull(), rows)


def children(attrs: Column, key: str) -> Column:
    """Array of (kind, key, value) below an attribute, those of a list or container too; null without any."""
    return _let(attrs[key], _below)


def get(attrs: Column, *path: str) -> Column:
    """(kind, value) at a path, or null. Of equal keys the first counts."""
    pair = lambda x: F.when(x.isNotNull(), F.struct(x["kind"].alias("kind"), x["value"].alias("value")))
    if len(path) == 1:
        return _let(attrs[path[0]], pair)
    return _let(F.get(F.filter(children(attrs, path[0]), lambda x: x["key"] == path[1]), 0), pair)


def _packed(rows: Column, listed: Column) -> Column:
    """children of an array of (kind, key, value); listed: under values, as of a list or container."""
    of = lambda r, k: F.transform(F.filter(r, lambda x: x["kind"] == k), lambda x: F.struct(x["key"].alias("_key"), x["value"].alias("_value")))
    some = lambda r: F.struct(*[_let(of(r, k), lambda c: F.when(F.size(c) > 0, c)).alias(k) for k in KINDS])
    text = lambda flat: F.when(listed, F.to_json(F.struct(flat.alias("values")))).otherwise(F.to_json(flat))
    return _let(rows, lambda r: F.when(F.size(r) > 0, _let(some(r), text)))


def _with(attrs: Column, key: str, entry: Column) -> Column:
    return F.map_concat(F.map_filter(attrs, lambda k, v: k != key), F.create_map(F.lit(key), entry))


def put(attrs: Column, value: Column, kind: str, *path: str) -> Column:
    """attrs with a value at a path, in place of what was there. A child of an attribute that is not there founds a
    container."""
    if kind not in KINDS:
        raise ValueError(f"kinds are {KINDS}")
    if len(path) == 1:
        return _let(_own(attrs), lambda m: _with(m, path[0], _entry(kind, value, m[path[0]]["children"])))

    def edited(old: Column) -> Column:
        others = F.filter(F.coalesce(_below(old), F.array().cast(_NONE)), lambda x: x["key"] != path[1])
        new = F.concat(others, F.array(F.struct(F.lit(kind).alias("kind"), F.lit(path[1]).alias("key"), value.cast("string").alias("value"))))
        own = F.coalesce(old["kind"], F.lit("container"))
        return _entry(own, old["value"], _packed(new, own.isin("list", "container")))

    return _let(_own(attrs), lambda m: _with(m, path[0], _let(m[path[0]], edited)))


def remove(attrs: Column, *path: str) -> Column:
    """attrs without what is at a path; as they are if nothing is."""
    if len(path) == 1:
        return F.map_filter(attrs, lambda k, v: k != path[0])

    def cut(old: Column) -> Column:
        rest = F.filter(_below(old), lambda x: x["key"] != path[1])
        return _entry(old["kind"], old["value"], _packed(rest, old["kind"].isin("list", "container")))

    held = lambda m: F.exists(children(m, path[0]), lambda x: x["key"] == path[1])
    return _let(attrs, lambda m: F.when(held(m), _with(m, path[0], _let(m[path[0]], cut))).otherwise(m))


def rename(attrs: Column, old: str, new: str) -> Column:
    """attrs with an attribute under another key; one that has that key already goes."""
    moved = lambda m: F.map_concat(F.map_filter(m, lambda k, v: ~k.isin(old, new)), F.create_map(F.lit(new), m[old]))
    return _let(attrs, lambda m: F.when(m[old].isNotNull(), moved(m)).otherwise(m))


# -- values by kind


def as_uuid(entry: Column) -> Column:
    """The text of an id in lower case if it is a UUID, else null."""
    text = F.lower(F.regexp_replace(F.trim(entry["value"]), r"^(urn:uuid:|\{)|\}$", ""))
    plain = F.regexp_replace(text, "-", "")
    parts = [F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when((entry["kind"] == "id") & plain.rlike("^[0-9a-f]{32}$") & (text.rlike("^[0-9a-f]{32}$") | text.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")), F.concat_ws("-", *parts))


def as_list(attrs: Column, key: str) -> Column:
    """(kind, key, value) below a list, or null for other kinds."""
    return F.when(attrs[key]["kind"] == "list", F.coalesce(children(attrs, key), F.array().cast(_NONE)))


def as_container(attrs: Column, key: str) -> Column:
    """Map from key to value below a container, the first of equal keys; null for other kinds."""
    rows = F.coalesce(children(attrs, key), F.array().cast(_NONE))
    once = F.filter(rows, lambda x, i: x["key"].isNotNull() & F.forall(F.slice(rows, 1, i), lambda y: ~y["key"].eqNullSafe(x["key"])))
    return F.when(attrs[key]["kind"] == "container", F.map_from_entries(F.transform(once, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))))


