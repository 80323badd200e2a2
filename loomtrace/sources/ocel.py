"""Object-centric logs in files: JSON, XML, CSV, SQLite, DuckDB, graph stores, flat frames.

Readers are Spark scans where Spark has a reader (JSON, XML, CSV, Parquet). Interchange documents
that must be one file are written row by row from a local iterator, so no log is held whole on the
driver; the frames of write_frames are the scalable form.
"""

from __future__ import annotations

import csv
import gzip
import json
import os
import re
import sqlite3
from collections import defaultdict
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.timestamps import SQL_TYPES, parse_timestamp, rfc3339, type_of_sql
from loomtrace.log import ATTR, E2O, EV_ATTR, O2O, TYPES, OCLog
from loomtrace.operators import objects

_REL = "array<struct<objectId:string,qualifier:string>>"
_JSON = f"""
    eventTypes array<struct<name:string,attributes:array<struct<name:string,type:string>>>>,
    objectTypes array<struct<name:string,attributes:array<struct<name:string,type:string>>>>,
    events array<struct<id:string,type:string,time:string,attributes:array<struct<name:string,value:string>>,relationships:{_REL}>>,
    objects array<struct<id:string,type:string,attributes:array<struct<name:string,value:string,time:string>>,relationships:{_REL}>>"""


def infer_format(path: str) -> str | None:
    """json, xml, csv, sqlite, duckdb or parquet, from a path."""
    name = path.lower().removesuffix("/")
    name = name.removesuffix(".gz")
    for ends, kind in (((".jsonocel", ".json"), "json"), ((".xmlocel", ".xml"), "xml"), ((".ocel.csv", ".csv"), "csv"), ((".sqlite", ".sqlite3", ".db"), "sqlite"), ((".duckdb",), "duckdb"), ((".parquet", ".frames"), "parquet")):
        if name.endswith(ends):
            return kind
    return None


def read_ocel(spark: SparkSession, path: str, fmt: str | None = None, **options) -> OCLog:
    readers = {"json": read_json, "xml": read_xml, "csv": read_csv, "sqlite": read_sqlite, "duckdb": read_duckdb, "parquet": read_frames}
    kind = fmt or infer_format(path)
    if kind not in readers:
        raise ValueError(f"unknown format of {path}")
    return readers[kind](spark, path, **options)


def write_ocel(log: OCLog, path: str, fmt: str | None = None) -> None:
    writers = {"json": write_json, "xml": write_xml, "csv": write_csv, "sqlite": write_sqlite, "duckdb": write_duckdb, "parquet": write_frames}
    kind = fmt or infer_format(path)
    if kind not in writers:
        raise ValueError(f"unknown format of {path}")
    writers[kind](log, path)


# -- JSON


def read_json(spark: SparkSession, path: str) -> OCLog:
    """One document per file, files read in parallel."""
    doc = spark.read.schema(_JSON).option("multiLine", True).json(path)
    return _from_nested(doc.select(F.explode("events").alias("e")).select("e.*"), doc.select(F.explode("objects").alias("o")).select("o.*"), _json_types(doc))


def _json_types(doc: DataFrame) -> DataFrame:
    one = lambda c, kind: doc.select(F.explode(c).alias("t")).select(F.lit(kind).alias("kind"), F.col("t.name").alias("type"), F.explode_outer("t.attributes").alias("a")).select("kind", "type", F.col("a.name").alias("name"), F.col("a.type").alias("value_type"))
    return one("eventTypes", "event").unionByName(one("objectTypes", "object"))


def _from_nested(events: DataFrame, obs: DataFrame, types: DataFrame | None) -> OCLog:
    ev = events.select(F.col("id").alias("ev_id"), F.col("type").alias("ev_type"), parse_timestamp(F.col("time")).alias("ts"))
    ob = obs.select(F.col("id").alias("ob_id"), F.col("type").alias("ob_type"))
    rel = lambda df, a, b: df.select(F.col("id").alias(a), F.explode("relationships").alias("r")).select(a, F.col("r.objectId").alias(b), F.coalesce("r.qualifier", F.lit("")).alias("qualifier"))
    ea = events.select(F.col("id").alias("ev_id"), F.explode("attributes").alias("a")).select("ev_id", "a.name", "a.value")
    oa = obs.select(F.col("id").alias("ob_id"), F.explode("attributes").alias("a")).select("ob_id", "a.name", "a.value", parse_timestamp(F.col("a.time")).alias("ts"))
    return OCLog(ev, ob, rel(events, "ev_id", "ob_id"), rel(obs, "src_id", "tgt_id"), oa, ea, types)


def _declared(log: OCLog) -> dict[str, dict[str, dict[str, str]]]:
    """kind -> type -> attribute -> value type; undeclared ones are found in the log as strings."""
    out: dict[str, dict[str, dict[str, str]]] = {"event": defaultdict(dict), "object": defaultdict(dict)}
    for kind, types, attrs, key, t in (("event", log.ev, log.ev_attr, "ev_id", "ev_type"), ("object", log.ob, log.obj_attr, "ob_id", "ob_type")):
        for r in types.select(t).distinct().collect():
            out[kind][r[0]] = {}
        for r in attrs.join(types, key).select(t, "name").distinct().collect():
            out[kind][r[0]][r[1]] = "string"
    if log.types is not None:
        for r in log.types.collect():
            out[r["kind"]].setdefault(r["type"], {})
            if r["name"] is not None:
                out[r["kind"]][r["type"]][r["name"]] = r["value_type"] or "string"
    return out


def _open(path: str):
    return gzip.open(path, "wt", encoding="utf-8") if path.endswith(".gz") else open(path, "w", encoding="utf-8")


def _json_value(text: str | None, kind: str):
    if text is None:
        return None
    try:
        if kind == "integer":
            return int(text)
        if kind == "float":
            return float(text)
    except ValueError:
        return text
    return text.lower() == "true" if kind == "boolean" and text.lower() in ("true", "false") else text


def _event_rows(log: OCLog) -> Iterator:
    return objects.full_events(log).withColumn("time", rfc3339(F.col("ts"))).orderBy("ts", "ev_id").toLocalIterator()


def _object_rows(log: OCLog) -> Iterator:
    return objects.full_objects(log).withColumn("attributes", F.transform("attributes", lambda a: F.struct(a["name"], a["value"], rfc3339(a["ts"]).alias("time")))).orderBy("ob_id").toLocalIterator()


def write_json(log: OCLog, path: str) -> None:
    known = _declared(log)
    rel = lambda r: [{"objectId": x["ob_id"], "qualifier": x["qualifier"] or ""} for x in r["relationships"] or []]
    with _open(path) as f:
        head = {f"{kind}Types": [{"name": t, "attributes": [{"name": n, "type": v} for n, v in sorted(a.items())]} for t, a in sorted(known[kind].items())] for kind in ("event", "object")}
        f.write(json.dumps(head, ensure_ascii=False)[:-1] + ', "events": [')
        for k, r in enumerate(_event_rows(log)):
            attrs = [{"name": a["name"], "value": _json_value(a["value"], known["event"][r["ev_type"]].get(a["name"], "string"))} for a in r["attributes"] or []]
            f.write((",\n" if k else "") + json.dumps({"id": r["ev_id"], "type": r["ev_type"], "time": r["time"], "attributes": attrs, "relationships": rel(r)}, ensure_ascii=False))
        f.write('], "objects": [')
        for k, r in enumerate(_object_rows(log)):
            attrs = [{"name": a["name"], "value": _json_value(a["value"], known["object"][r["ob_type"]].get(a["name"], "string")), "time": a["time"]} for a in r["attributes"] or []]
            f.write((",\n" if k else "") + json.dumps({"id": r["ob_id"], "type": r["ob_type"], "attributes": attrs, "relationships": rel(r)}, ensure_ascii=False))
        f.write("]}")


# -- XML

_XREL = "objects struct<relationship:array<struct<`_object-id`:string,_qualifier:string>>>"


def read_xml(spark: SparkSession, path: str) -> OCLog:
    """Rows are the event and object elements; nested elements have a fixed schema."""
    read = lambda tag, ddl: spark.read.format("xml").option("rowTag", tag).schema(ddl).load(path)
    rel = F.transform("objects.relationship", lambda x: F.struct(x["_object-id"].alias("objectId"), x["_qualifier"].alias("qualifier")))
    e = read("event", f"_id string, _type string, _time string, attributes struct<attribute:array<struct<_name:string,_VALUE:string>>>, {_XREL}").filter("_id IS NOT NULL")
    o = read("object", f"_id string, _type string, attributes struct<attribute:array<struct<_name:string,_time:string,_VALUE:string>>>, {_XREL}").filter("_id IS NOT NULL")
    events = e.select(F.col("_id").alias("id"), F.col("_type").alias("type"), F.col("_time").alias("time"), F.transform("attributes.attribute", lambda a: F.struct(a["_name"].alias("name"), a["_VALUE"].alias("value"))).alias("attributes"), rel.alias("relationships"))
    obs = o.select(F.col("_id").alias("id"), F.col("_type").alias("type"), F.transform("attributes.attribute", lambda a: F.struct(a["_name"].alias("name"), a["_VALUE"].alias("value"), a["_time"].alias("time"))).alias("attributes"), rel.alias("relationships"))
    types = None
    for tag, kind in (("event-type", "event"), ("object-type", "object")):
        t = read(tag, "_name string, attributes struct<attribute:array<struct<_name:string,_type:string>>>").select(
            F.lit(kind).alias("kind"), F.col("_name").alias("type"), F.explode_outer("attributes.attribute").alias("a")).select("kind", "type", F.col("a._name").alias("name"), F.col("a._type").alias("value_type"))
        types = t if types is None else types.unionByName(t)
    return _from_nested(events, obs, types)


def write_xml(log: OCLog, path: str) -> None:
    known = _declared(log)

    def relations(r) -> str:
        return "<objects>" + "".join(f"<relationship object-id={quoteattr(x['ob_id'])} qualifier={quoteattr(x['qualifier'] or '')}/>" for x in r["relationships"] or []) + "</objects>"

    with _open(path) as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<log>\n')
        for kind in ("object", "event"):
            f.write(f"<{kind}-types>")
            for t, attrs in sorted(known[kind].items()):
                inner = "".join(f"<attribute name={quoteattr(n)} type={quoteattr(v)}/>" for n, v in sorted(attrs.items()))
                f.write(f"<{kind}-type name={quoteattr(t)}><attributes>{inner}</attributes></{kind}-type>")
            f.write(f"</{kind}-types>\n")
        f.write("<objects>\n")
        for r in _object_rows(log):
            attrs = "".join(f"<attribute name={quoteattr(a['name'])} time={quoteattr(a['time'])}>{escape(a['value'] or '')}</attribute>" for a in r["attributes"] or [])
            f.write(f"<object id={quoteattr(r['ob_id'])} type={quoteattr(r['ob_type'])}><attributes>{attrs}</attributes>{relations(r)}</object>\n")
        f.write("</objects>\n<events>\n")
        for r in _event_rows(log):
            attrs = "".join(f"<attribute name={quoteattr(a['name'])}>{escape(a['value'] or '')}</attribute>" for a in r["attributes"] or [])
            f.write(f"<event id={quoteattr(r['ev_id'])} type={quoteattr(r['ev_type'])} time={quoteattr(r['time'])}><attributes>{attrs}</attributes>{relations(r)}</event>\n")
        f.write("</events>\n</log>\n")


# -- CSV


def parse_refs(cell: str | None) -> list[tuple[str, str, dict | None]]:
    """(id, qualifier, attributes) of `id#qualifier{json}` references joined by /; braces and quoted
    text are not split."""
    out, start, depth, quoted = [], 0, 0, False
    cell = (cell or "").strip()
    pieces = []
    k = 0
    while k < len(cell):
        c = cell[k]
        if quoted:
            k += c == "\\"
            quoted = c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
        elif c == "/" and depth == 0:
            pieces.append(cell[start:k])
            start = k + 1
        k += 1
    for piece in [*pieces, cell[start:]]:
        head, brace, rest = piece.strip().partition("{")
        if not (head or brace):
            continue
        name, _, qualifier = head.partition("#")
        attrs = json.loads(brace + rest) if brace else None
        if not name.strip():
            raise ValueError(f"no object id in {piece!r}")
        out.append((name.strip(), qualifier.strip(), attrs))
    return out


_REFS = "array<struct<id:string,qualifier:string,attrs:map<string,string>>>"


def plain_refs(cell: Column, strict: bool = False) -> Column:
    """References of a cell without attributes, as a column: no Python is called for them. A cell with a reference
    that has no id is an error, or passed over."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pieces = F.filter(F.transform(F.split(cell, "/"), strip), lambda p: p != "")
    part = lambda p, k: strip(F.coalesce(F.get(F.split(p, "#", 2), k), F.lit("")))
    refs = F.transform(pieces, lambda p: F.struct(part(p, 0).alias("id"), part(p, 1).alias("qualifier"), F.lit(None).cast("map<string,string>").alias("attrs")))
    wrong = F.raise_error(F.concat(F.lit("no object id in "), cell)).cast(_REFS) if strict else F.array().cast(_REFS)
    return F.when(F.exists(refs, lambda r: r["id"] == ""), wrong).otherwise(refs)


def _nested_refs(strict: bool):
    """References of cells with attributes, in Arrow batches."""
    def refs(cell: str) -> list:
        try:
            return [(i, q, {k: v if isinstance(v, str) else json.dumps(v) for k, v in a.items()} if a else None) for i, q, a in parse_refs(cell)]
        except ValueError:
            if strict:
                raise
            return []

    return F.udf(refs, _REFS, useArrow=True)


def read_csv(spark: SparkSession, path: str, strict: bool = False, date_format: str | None = None) -> OCLog:
    """Rows of events, O2O relations (activity o2o) and object attributes alone (no activity).
    strict: bad cells and unknown O2O ends fail; else they are passed over."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    ot = [c for c in raw.columns if c.lower().startswith("ot:")]
    ea = [c for c in raw.columns if c.lower().startswith("ea:")]
    raw = raw.toDF(*[{"id": "id", "activity": "activity", "timestamp": "timestamp"}.get(c.lower(), c) for c in raw.columns])

    rows = raw.withColumn("ts", parse_timestamp(F.col("timestamp"), date_format))
    is_o2o = F.lower(F.coalesce("activity", F.lit(""))) == "o2o"
    events = rows.filter(~is_o2o & F.col("activity").isNotNull() & F.col("id").isNotNull())
    ev = events.select(F.trim("id").alias("ev_id"), F.trim("activity").alias("ev_type"), "ts")
    if not ot:
        none = spark.createDataFrame([], "id string, activity string, ts timestamp, type string, oid string, qualifier string, attrs map<string,string>")
        links = none
    else:
        cells = rows.select("id", "activity", "ts", F.explode(F.array(*[F.struct(F.lit(c[3:]).alias("type"), F.col(f"`{c}`").alias("cell")) for c in ot])).alias("c")).select("id", "activity", "ts", "c.*").filter("cell IS NOT NULL")
        plain = cells.filter(~F.col("cell").rlike(r"[{}]")).withColumn("refs", plain_refs(F.col("cell"), strict))
        nested = cells.filter(F.col("cell").rlike(r"[{}]")).withColumn("refs", _nested_refs(strict)("cell"))  # attributes as JSON
        links = plain.unionByName(nested).select("id", "activity", "ts", "type", F.explode("refs").alias("r")).select("id", "activity", "ts", "type", F.col("r.id").alias("oid"), F.col("r.qualifier").alias("qualifier"), F.col("r.attrs").alias("attrs"))
    ob = links.groupBy(F.col("oid").alias("ob_id")).agg(F.min("type").alias("ob_type"))
    is_link = F.lower(F.coalesce("activity", F.lit(""))) == "o2o"
    e2o = links.filter(~is_link & F.col("activity").isNotNull() & F.col("id").isNotNull()).select(F.trim("id").alias("ev_id"), F.col("oid").alias("ob_id"), "qualifier")
    o2o = links.filter(is_link).select(F.trim("id").alias("src_id"), F.col("oid").alias("tgt_id"), "qualifier")
    unknown = o2o.join(ob.select(F.col("ob_id").alias("src_id")), "src_id", "left_anti")
    if strict and not unknown.isEmpty():
        raise ValueError(f"unknown object {unknown.first()['src_id']!r} has O2O relations")
    o2o = o2o.join(ob.select(F.col("ob_id").alias("src_id")), "src_id", "left_semi").select(*O2O.names)
    attr = links.filter(F.col("attrs").isNotNull() & F.col("ts").isNotNull()).select(F.col("oid").alias("ob_id"), F.explode("attrs").alias("name", "value"), "ts")
    pairs = [F.struct(F.lit(c[3:]).alias("name"), F.col(f"`{c}`").alias("value")) for c in ea]
    ev_attr = events.select(F.trim("id").alias("ev_id"), F.explode(F.array(*pairs)).alias("a")).select("ev_id", "a.name", "a.value").filter("value IS NOT NULL") if ea else spark.createDataFrame([], EV_ATTR)
    return OCLog(ev, ob, e2o, o2o, attr.select(*ATTR.names), ev_attr)


def _ref_text(rows: list) -> str:
    return "/".join(i + (f"#{q}" if q else "") + (json.dumps(a, ensure_ascii=False) if a else "") for i, q, a in rows)


def write_csv(log: OCLog, path: str) -> None:
    """Event rows by time, then O2O rows, then attribute rows not covered by an event of the object
    at the same time."""
    known = _declared(log)
    ots, eas = sorted(known["object"]), sorted({n for a in known["event"].values() for n in a})
    attrs = log.obj_attr.groupBy("ob_id", "ts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attrs"))
    rel = log.e2o_raw.join(attrs, ["ob_id", "ts"], "left").groupBy("ev_id").agg(F.array_sort(F.collect_list(F.struct("ob_type", "ob_id", "qualifier", F.to_json("attrs").alias("attrs")))).alias("rel"))
    ea = log.ev_attr.groupBy("ev_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
    events = log.ev.join(rel, "ev_id", "left").join(ea, "ev_id", "left").withColumn("time", rfc3339(F.col("ts"))).orderBy("ts", "ev_id")
    alone = attrs.join(log.e2o_raw.select("ob_id", "ts"), ["ob_id", "ts"], "left_anti").join(log.ob, "ob_id").select("ob_type", "ob_id", F.to_json("attrs").alias("attrs"), rfc3339(F.col("ts")).alias("time")).orderBy("time", "ob_id")
    links = log.o2o.join(log.ob.select(F.col("ob_id").alias("tgt_id"), "ob_type"), "tgt_id").groupBy("src_id").agg(F.array_sort(F.collect_list(F.struct("ob_type", F.col("tgt_id").alias("ob_id"), "qualifier"))).alias("rel")).orderBy("src_id")
    with _open(path) as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["id", "activity", "timestamp", *(f"ot:{t}" for t in ots), *(f"ea:{n}" for n in eas)])
        for r in events.toLocalIterator():
            by = defaultdict(list)
            for x in r["rel"] or []:
                by[x["ob_type"]].append((x["ob_id"], x["qualifier"], json.loads(x["attrs"]) if x["attrs"] else None))
            w.writerow([r["ev_id"], r["ev_type"], r["time"], *(_ref_text(by[t]) for t in ots), *((r["attributes"] or {}).get(n) or "" for n in eas)])
        for r in links.toLocalIterator():
            by = defaultdict(list)
            for x in r["rel"]:
                by[x["ob_type"]].append((x["ob_id"], x["qualifier"], None))
            w.writerow([r["src_id"], "o2o", "", *(_ref_text(by[t]) for t in ots), *("" for _ in eas)])
        for r in alone.toLocalIterator():
            w.writerow(["", "", r["time"], *(_ref_text([(r["ob_id"], "", json.loads(r["attrs"]))]) if t == r["ob_type"] else "" for t in ots), *("" for _ in eas)])


# -- SQL stores


def clean_name(name: str) -> str:
    """A type's name as part of a table's name."""
    return re.sub(r"[^A-Za-z0-9_]", "", name.title().replace(" ", "")) or "_"


def _sql_tables(log: OCLog) -> Iterator[tuple[str, list[tuple[str, str]], Iterator[tuple]]]:
    """(table, columns, rows) of the store's layout."""
    known = _declared(log)
    text = lambda *names: [(n, "TEXT") for n in names]
    for kind in ("event", "object"):
        yield f"{kind}_map_type", text("ocel_type", "ocel_type_map"), iter([(t, clean_name(t)) for t in sorted(known[kind])])
    yield "event", text("ocel_id", "ocel_type"), map(tuple, log.ev.select("ev_id", "ev_type").toLocalIterator())
    yield "object", text("ocel_id", "ocel_type"), map(tuple, log.ob.select("ob_id", "ob_type").toLocalIterator())
    yield "event_object", text("ocel_event_id", "ocel_object_id", "ocel_qualifier"), map(tuple, log.e2o.select(*E2O.names).distinct().toLocalIterator())
    yield "object_object", text("ocel_source_id", "ocel_target_id", "ocel_qualifier"), map(tuple, log.o2o.select(*O2O.names).distinct().toLocalIterator())
    for t, attrs in sorted(known["event"].items()):
        names = sorted(attrs)
        rows = objects.event_table(log, t, names).withColumn("ts", rfc3339(F.col("ts")))
        yield f"event_{clean_name(t)}", [("ocel_id", "TEXT"), ("ocel_time", "TIMESTAMP"), *((n, SQL_TYPES.get(attrs[n], "TEXT")) for n in names)], map(tuple, rows.select("ev_id", "ts", *names).toLocalIterator())
    for t, attrs in sorted(known["object"].items()):
        names = sorted(attrs)
        rows = log.obj_attr.join(objects.objects_of_type(log, t), "ob_id")
        first = F.col("ts") == F.timestamp_seconds(F.lit(0))
        start = rows.filter(first).groupBy("ob_id").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]) if names else None
        own = objects.objects_of_type(log, t).select("ob_id")
        own = own if start is None else own.join(start, "ob_id", "left")
        epoch = rfc3339(F.timestamp_seconds(F.lit(0)))
        zero = own.select("ob_id", epoch.alias("ts"), F.lit(None).cast("string").alias("changed"), *names)
        later = rows.filter(~first).select("ob_id", rfc3339(F.col("ts")).alias("ts"), F.col("name").alias("changed"), *[F.when(F.col("name") == n, F.col("value")).alias(n) for n in names])
        both = zero.unionByName(later)
        yield f"object_{clean_name(t)}", [("ocel_id", "TEXT"), ("ocel_time", "TIMESTAMP"), ("ocel_changed_field", "TEXT"), *((n, SQL_TYPES.get(attrs[n], "TEXT")) for n in names)], map(tuple, both.toLocalIterator())


def _fill(con, log: OCLog) -> None:
    for name, columns, rows in _sql_tables(log):
        con.execute(f'CREATE TABLE "{name}" (' + ", ".join(f'"{c}" {t}' for c, t in columns) + ")")
        marks = ", ".join("?" * len(columns))
        batch = []
        for r in rows:
            batch.append(r)
            if len(batch) == 5000:
                con.executemany(f'INSERT INTO "{name}" VALUES ({marks})', batch)
                batch = []
        if batch:
            con.executemany(f'INSERT INTO "{name}" VALUES ({marks})', batch)


def write_sqlite(log: OCLog, path: str) -> None:
    if os.path.exists(path):
        os.remove(path)
    with sqlite3.connect(path) as con:
        _fill(con, log)
    con.close()


def write_duckdb(log: OCLog, path: str) -> None:
    import duckdb

    if os.path.exists(path):
        os.remove(path)
    con = duckdb.connect(path)
    _fill(con, log)
    con.close()


def _from_sql(spark: SparkSession, ask) -> OCLog:
    """ask(sql) -> rows of text; a store file is one machine's, so it is read there."""
    frame = lambda rows, ddl: spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ddl)
    names = {kind: ask(f'SELECT ocel_type, ocel_type_map FROM "{kind}_map_type"') for kind in ("event", "object")}
    ev_rows, ev_attr, attr, types = [], [], [], []
    for kind in ("event", "object"):
        for t, short in names[kind]:
            table = f"{kind}_{short}"
            cols = ask(f"PRAGMA table_info('{table}')")
            extra = [(c[1], c[2]) for c in cols if c[1] not in ("ocel_id", "ocel_time", "ocel_changed_field")]
            types += [(kind, t, n, type_of_sql(v)) for n, v in extra] or [(kind, t, None, None)]
            picked = "".join(f', CAST("{n}" AS VARCHAR)' for n, _ in extra)
            changed = ", ocel_changed_field" if kind == "object" else ""
            for r in ask(f'SELECT ocel_id, CAST(ocel_time AS VARCHAR){changed}{picked} FROM "{table}"'):
                values = r[3:] if kind == "object" else r[2:]
                if kind == "event":
                    ev_rows.append((r[0], t, r[1]))
                    ev_attr += [(r[0], n, v) for (n, _), v in zip(extra, values, strict=True) if v is not None]
                else:
                    attr += [(r[0], n, v, r[1]) for (n, _), v in zip(extra, values, strict=True) if v is not None]
    time = lambda df: df.withColumn("ts", parse_timestamp(F.col("ts")))
    return OCLog(
        time(frame(ev_rows, "ev_id string, ev_type string, ts string")), frame(ask('SELECT ocel_id, ocel_type FROM "object"'), "ob_id string, ob_type string"),
        frame(ask('SELECT ocel_event_id, ocel_object_id, ocel_qualifier FROM "event_object"'), "ev_id string, ob_id string, qualifier string"),
        frame(ask('SELECT ocel_source_id, ocel_target_id, ocel_qualifier FROM "object_object"'), "src_id string, tgt_id string, qualifier string"),
        time(frame(attr, "ob_id string, name string, value string, ts string")), frame(ev_attr, "ev_id string, name string, value string"), spark.createDataFrame(types, TYPES))


def read_sqlite(spark: SparkSession, path: str) -> OCLog:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        return _from_sql(spark, lambda sql: con.execute(sql).fetchall())
    finally:
        con.close()


def read_duckdb(spark: SparkSession, path: str) -> OCLog:
    import duckdb

    con = duckdb.connect(path, read_only=True)
    try:
        return _from_sql(spark, lambda sql: con.execute(sql).fetchall())
    finally:
        con.close()


# -- frames and graph stores


_FRAMES = ("ev", "ob", "e2o", "o2o", "obj_attr", "ev_attr")


def write_frames(log: OCLog, path: str, fmt: str = "parquet", columns: dict[str, list[str]] | None = None) -> None:
    """One directory per frame; columns chooses some of a frame."""
    for name in _FRAMES:
        df = getattr(log, name)
        df = df.select(*columns[name]) if columns and name in columns else df
        df.write.mode("overwrite").option("header", True).format(fmt).save(f"{path}/{name}")


def read_frames(spark: SparkSession, path: str) -> OCLog:
    return OCLog(*[spark.read.parquet(f"{path}/{name}") for name in _FRAMES])


def flat_frames(log: OCLog) -> dict[str, DataFrame]:
    """objects (with their attributes valued at the epoch), events, e2o, o2o and object_changes."""
    start = log.obj_attr.filter(F.col("ts") == F.timestamp_seconds(F.lit(0))).groupBy("ob_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("attributes"))
    ea = log.ev_attr.groupBy("ev_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("attributes"))
    return {"objects": log.ob.join(start, "ob_id", "left"), "events": log.ev.join(ea, "ev_id", "left"), "e2o": log.e2o_raw, "o2o": objects.o2o_of(log), "object_changes": log.obj_attr.join(log.ob, "ob_id")}


class Names:
    """Clean names of tables or columns, one for each key: letters, digits and underscores, with a number where two keys
    would share one, in any case."""

    def __init__(self, taken: Iterable[str] = ()) -> None:
        self.taken, self.known = {t.lower() for t in taken}, {}

    def __call__(self, *key: str) -> str:
        if key not in self.known:
            clean = name = re.sub(r"\W", "_", "_".join(key))
            k = 2
            while name.lower() in self.taken:
                name, k = f"{clean}_{k}", k + 1
            self.taken.add(name.lower())
            self.known[key] = name
        return self.known[key]


def write_graph(log: OCLog, path: str, typed: bool = False) -> str:
    """CSV files of nodes and relations for a property-graph store, and the DDL that loads them."""
    ddl = []

    def put(name: str, df: DataFrame, create: str) -> None:
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        ddl.append(f'{create}\nCOPY {name} FROM "{path}/{name}/*.csv" (HEADER=true);')

    if not typed:
        put("Event", log.ev, "CREATE NODE TABLE Event(id STRING, type STRING, time TIMESTAMP, PRIMARY KEY(id));")
        put("Object", log.ob, "CREATE NODE TABLE Object(id STRING, type STRING, PRIMARY KEY(id));")
        put("E2O", log.e2o, "CREATE REL TABLE E2O(FROM Event TO Object, qualifier STRING);")
        put("O2O", log.o2o, "CREATE REL TABLE O2O(FROM Object TO Object, qualifier STRING);")
    else:
        known, name = _declared(log), Names()
        for t, attrs in sorted(known["event"].items()):
            columns = Names(("id", "time"))
            cols = "".join(f", {columns(n)} STRING" for n in sorted(attrs))
            put(name("Event", t), objects.event_table(log, t, sorted(attrs)), f"CREATE NODE TABLE {name('Event', t)}(id STRING, time TIMESTAMP{cols}, PRIMARY KEY(id));")
        for t in sorted(known["object"]):
            own = objects.objects_of_type(log, t).select("ob_id")
            put(name("Object", t), own, f"CREATE NODE TABLE {name('Object', t)}(id STRING, PRIMARY KEY(id));")
            change = log.obj_attr.join(own, "ob_id", "left_semi").select(F.concat_ws("|", "ob_id", "name", rfc3339(F.col("ts"))).alias("id"), "ob_id", "name", "value", "ts")
            put(name("Change", t), change, f"CREATE NODE TABLE {name('Change', t)}(id STRING, object STRING, name STRING, value STRING, time TIMESTAMP, PRIMARY KEY(id));")
        for r in log.e2o_raw.select("ev_type", "ob_type").distinct().orderBy("ev_type", "ob_type").collect():
            a, b = r
            put(name("E2O", a, b), objects.e2o_of(log, a, b).select("ev_id", "ob_id", "qualifier"), f"CREATE REL TABLE {name('E2O', a, b)}(FROM {name('Event', a)} TO {name('Object', b)}, qualifier STRING);")
        for r in objects.o2o_of(log).select("src_type", "tgt_type").distinct().orderBy("src_type", "tgt_type").collect():
            a, b = r
            put(name("O2O", a, b), objects.o2o_of(log, a, b).select("src_id", "tgt_id", "qualifier"), f"CREATE REL TABLE {name('O2O', a, b)}(FROM {name('Object', a)} TO {name('Object', b)}, qualifier STRING);")
    return "\n".join(ddl)
