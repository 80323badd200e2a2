"""Case logs in XES and JSON files, and as flat frames.

XES is scanned by trace: each trace element is a row, so traces are parsed in parallel and a log is
never built whole. Attributes of an event are kept as a map from key to (kind, value); concept:name
and time:timestamp also are columns.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.functions.attributes import ATTRS
from loomtrace.functions.timestamps import parse_timestamp, rfc3339
from loomtrace.operators.cases import class_identity

KINDS = ("string", "date", "int", "float", "boolean", "id")
ACTIVITY, TIME, CASE = "concept:name", "time:timestamp", "concept:name"
CASE_PREFIX = "case:"
_LEAF = "struct<_key:string,_value:string>"
_NEST = f"struct<_key:string,_value:string,{','.join(f'{k}:array<{_LEAF}>' for k in KINDS)}>"
_GROUP = f"struct<_key:string,{','.join(f'{k}:array<{_LEAF}>' for k in KINDS)},values:struct<{','.join(f'{k}:array<{_LEAF}>' for k in KINDS)}>>"
_ATTRS = ",".join([*(f"{k}:array<{_NEST}>" for k in KINDS), *(f"{k}:array<{_GROUP}>" for k in ("list", "container"))])
_TRACE = ", ".join([*(f"`{k}` array<{_NEST}>" for k in KINDS), *(f"`{k}` array<{_GROUP}>" for k in ("list", "container")), f"event array<struct<{_ATTRS}>>"])


def infer_format(path: str) -> str | None:
    """xes, xes.gz, json, json.gz or parquet; the last two parts count for compressed files."""
    name = path.lower().rsplit("/", 1)[-1].split(".")
    if len(name) > 2 and name[-1] == "gz":
        return f"{name[-2]}.gz"
    return name[-1] if len(name) > 1 else None


@dataclass
class Header:
    """What stands beside the traces: extensions (name, prefix, uri), classifiers name -> keys,
    global attributes of traces and events, attributes of the log."""

    extensions: list[tuple[str, str, str]] = field(default_factory=list)
    classifiers: dict[str, list[str]] = field(default_factory=dict)
    trace_globals: dict[str, str] = field(default_factory=dict)
    event_globals: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)


def parse_classifier(keys: str, known: Iterable[str] = ()) -> list[str]:
    """Keys of a classifier: quoted ones may hold spaces; an unquoted run of words is one key if
    that key is known, the longest first."""
    known = set(known)
    parts = [(a or b, bool(a)) for a, b in re.findall(r"'([^']*)'|(\S+)", keys)]
    out, i = [], 0
    while i < len(parts):
        take = 1
        if not parts[i][1]:
            for n in range(len(parts) - i, 1, -1):
                run = parts[i : i + n]
                if not any(q for _, q in run) and " ".join(w for w, _ in run) in known:
                    take = n
                    break
        out.append(" ".join(w for w, _ in parts[i : i + take]))
        i += take
    return out


def classifier_text(keys: list[str]) -> str:
    return " ".join(f"'{k}'" if any(" " in x for x in keys) else k for k in keys)


def read_header(path: str) -> Header:
    """The header of one file, read up to its first trace."""
    h, depth, scope = Header(), 0, None
    with (gzip.open if path.endswith(".gz") else open)(path.removeprefix("file://"), "rb") as f:
        for kind, e in ET.iterparse(f, ("start", "end")):
            tag = e.tag.rpartition("}")[2]
            if kind == "start":
                depth += 1
                if tag == "trace":
                    break
                if tag == "global":
                    scope = e.attrib.get("scope")
                elif tag == "extension":
                    h.extensions.append((e.attrib.get("name", ""), e.attrib.get("prefix", ""), e.attrib.get("uri", "")))
                elif tag == "classifier":
                    known = set(h.event_globals if e.attrib.get("scope", "event") == "event" else h.trace_globals)
                    h.classifiers[e.attrib["name"]] = parse_classifier(e.attrib["keys"], known)
                elif tag in KINDS:
                    where = {"trace": h.trace_globals, "event": h.event_globals}.get(scope, h.attributes)
                    where[e.attrib["key"]] = e.attrib.get("value", "")
            else:
                depth -= 1
                scope = None if tag == "global" else scope
    return h


def _pairs(node: str | None, keep: Iterable[str] | None) -> Column:
    """Map key -> struct(kind, value, children) of an element's attributes; of equal keys the first."""
    at = lambda name: F.col(f"{node}.{name}" if node else name) if isinstance(node, str) or node is None else node[name]
    empty = F.array().cast("array<struct<key:string,v:struct<kind:string,value:string,children:string>>>")
    parts = []
    for k in KINDS:
        nested = lambda x: F.to_json(F.struct(*[x[c].alias(c) for c in KINDS]))
        parts.append(F.coalesce(F.transform(at(k), _leaf(k, nested)), empty))
    for k in ("list", "container"):
        parts.append(F.coalesce(F.transform(at(k), _leaf(k, lambda x: F.to_json(F.struct(*[x[c].alias(c) for c in KINDS], x["values"].alias("values"))))), empty))
    every = F.filter(F.concat(*parts), lambda p: p["key"].isNotNull() if keep is None else p["key"].isin(*keep))
    first = F.filter(every, lambda p, i: F.forall(F.slice(every, 1, i), lambda q: q["key"] != p["key"]))
    return F.map_from_entries(first)


def _leaf(kind: str, nested):
    def f(x: Column) -> Column:
        value = x["_value"] if kind in KINDS else F.lit(None).cast("string")
        inner = nested(x)
        return F.struct(x["_key"].alias("key"), F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.when(inner != "{}", inner).alias("children")).alias("v"))

    return f


def read_xes(spark: SparkSession, path: str, trace_attributes: Iterable[str] | None = None, event_attributes: Iterable[str] | None = None, date_format: str | None = None, sort_by_time: bool = False, globals_: Header | None = None) -> DataFrame:
    """Events (case_id, activity, ts, pos, attrs, case_attrs); a trace without events is a row with
    a null pos. Attribute lists choose what is kept; globals_ fills missing names and activities."""
    rows = spark.read.format("xml").option("rowTag", "trace").schema(_TRACE).load(path)
    return _events(rows.withColumn("row", F.monotonically_increasing_id()), trace_attributes, event_attributes, date_format, sort_by_time, globals_)


_CLOSE = "</trace>"


def scan_traces(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, trace, error, text) of every trace element of XES files, the broken ones too.

    Files are cut at the ends of traces while they are read as text, so a large file is read in ranges of bytes by many
    tasks (a compressed one by one). A trace is parsed for itself: what is not well formed, begins again before it ends,
    or is cut off by the end of the file is a row with an error and its text, and harms no other. Text outside of traces
    gives no row. Ends of traces are looked for as they are written, so a comment that holds one is an error, too.
    """
    raw = spark.read.option("lineSep", _CLOSE).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("row"), "value")
    # the last piece of a file is a trace only if the file goes on to its end; sizes of compressed files do not tell
    length = F.sum(F.octet_length("value") + len(_CLOSE))
    ends = raw.groupBy("file").agg(F.max("row").alias("last"), (length - F.max("size") == len(_CLOSE)).alias("open"))
    parts = raw.join(F.broadcast(ends), "file").select("file", "row", (F.col("open") & (F.col("row") == F.col("last"))).alias("cut"), F.posexplode(F.split("value", r"(?=<trace[\s/>])")).alias("n", "text"))  # a row per file
    parts = parts.filter(F.col("text").rlike(r"^<trace[\s/>]")).withColumn("closed", F.col("text").rlike(r"^<trace(\s[^>]*)?/>\s*(</log>\s*)?$"))
    ordered = W.partitionBy("file", "row").orderBy("n")
    parts = parts.withColumn("more", F.lead("n").over(ordered).isNotNull())
    whole = F.when(F.col("closed"), F.regexp_extract("text", r"^<trace[^>]*/>", 0)).otherwise(F.concat("text", F.lit(_CLOSE)))
    parsed = parts.withColumn("trace", F.from_xml(whole, _TRACE + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    error = F.when(~F.col("closed") & F.col("more"), "a trace begins before this one ends").when(~F.col("closed") & F.col("cut"), "the file ends before the trace").when(
        F.col("trace").isNull() | F.col("trace._bad").isNotNull(), "not well formed")
    marked = parsed.withColumn("error", error)
    return marked.select("file", (F.col("row") * 1_000_000 + F.col("n")).alias("row"), F.when(F.col("error").isNull(), F.col("trace").dropFields("_bad")).alias("trace"), "error", F.when(F.col("error").isNotNull(), F.col("text")).alias("text"))


def read_xes_safely(spark: SparkSession, path: str, trace_attributes: Iterable[str] | None = None, event_attributes: Iterable[str] | None = None, date_format: str | None = None, sort_by_time: bool = False, globals_: Header | None = None) -> tuple[DataFrame, DataFrame]:
    """read_xes of the traces that can be read, and (file, row, error, text) of those that can't."""
    scan = scan_traces(spark, path)
    good = scan.filter("error IS NULL").select("row", "trace.*")
    return _events(good, trace_attributes, event_attributes, date_format, sort_by_time, globals_), scan.filter("error IS NOT NULL").select("file", "row", "error", "text")


def _events(rows: DataFrame, trace_attributes: Iterable[str] | None, event_attributes: Iterable[str] | None, date_format: str | None, sort_by_time: bool, globals_: Header | None) -> DataFrame:
    """Events of rows of traces, numbered by row."""
    keep = lambda names, own: None if names is None else {*names, *own}
    rows = rows.select(_pairs(None, keep(trace_attributes, [CASE])).alias("case_attrs"), "event", "row")
    events = rows.select("row", "case_attrs", F.posexplode_outer("event").alias("pos", "event"))
    events = events.select("row", "case_attrs", F.col("pos").cast("long").alias("pos"), F.when(F.col("event").isNotNull(), _pairs("event", keep(event_attributes, [ACTIVITY, TIME]))).alias("attrs"))
    g = globals_ or Header()
    name = F.coalesce(F.col("case_attrs")[CASE]["value"], F.lit(g.trace_globals.get(CASE)), F.concat(F.lit("trace"), F.col("row").cast("string")))
    act = F.coalesce(F.col("attrs")[ACTIVITY]["value"], F.lit(g.event_globals.get(ACTIVITY)))
    out = events.select(name.alias("case_id"), act.alias("activity"), parse_timestamp(F.col("attrs")[TIME]["value"], date_format).alias("ts"), "pos", "attrs", "case_attrs")
    if sort_by_time:
        out = out.withColumn("pos", F.when(F.col("pos").isNotNull(), F.row_number().over(W.partitionBy("case_id").orderBy(F.col("ts").asc_nulls_last(), "pos")) - 1).cast("long"))
    return out


def attribute(name: str, default: str | None = None, of: str = "attrs") -> Column:
    """An attribute's text, or its global default."""
    return F.coalesce(F.col(of)[name]["value"], F.lit(default))


def identity(log: DataFrame, header: Header, classifier: str) -> DataFrame:
    """log with a column identity by a classifier of the header."""
    keys = header.classifiers[classifier]
    wide = log.select("*", *[F.when(F.col("attrs")[k]["kind"] == "string", attribute(k, header.event_globals.get(k))).otherwise(F.lit(header.event_globals.get(k))).alias(f"_{i}") for i, k in enumerate(keys)])
    return wide.withColumn("identity", class_identity(*[f"_{i}" for i in range(len(keys))])).drop(*[f"_{i}" for i in range(len(keys))])


def _element(key: str, kind: str, value: str | None) -> str:
    if kind in ("list", "container"):
        return f"<{kind} key={quoteattr(key)}/>"
    return f"<{kind} key={quoteattr(key)} value={quoteattr(value or '')}/>"


def write_xes(log: DataFrame, path: str, header: Header | None = None) -> None:
    """One document, streamed by trace; logs without attrs get the standard two."""
    h = header or Header()
    if "attrs" not in log.columns:
        leaf = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
        log = log.withColumn("attrs", F.map_filter(F.create_map(F.lit(ACTIVITY), leaf("string", F.col("activity")), F.lit(TIME), leaf("date", rfc3339(F.col("ts").cast("timestamp")))), lambda k, v: v["value"].isNotNull()))
    if "case_attrs" not in log.columns:
        log = log.withColumn("case_attrs", F.create_map(F.lit(CASE), F.struct(F.lit("string").alias("kind"), F.col("case_id").cast("string").alias("value"))))
    flat = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"]["kind"].alias("kind"), e["value"]["value"].alias("value"))))
    rows = log.select("case_id", "ts", "pos", flat("attrs").alias("a"), flat("case_attrs").alias("c")).groupBy("case_id").agg(
        F.first("c").alias("c"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("ts", "pos", "a")))).alias("events")).orderBy("case_id")
    with _text(path) as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="2.0" xes.features="nested-attributes" xmlns="http://www.xes-standard.org/">\n')
        for name, prefix, uri in h.extensions:
            f.write(f"<extension name={quoteattr(name)} prefix={quoteattr(prefix)} uri={quoteattr(uri)}/>\n")
        for scope, values in (("trace", h.trace_globals), ("event", h.event_globals)):
            if values:
                f.write(f'<global scope="{scope}">' + "".join(_element(k, "string", v) for k, v in values.items()) + "</global>\n")
        for name, keys in h.classifiers.items():
            f.write(f"<classifier name={quoteattr(name)} keys={quoteattr(classifier_text(keys))}/>\n")
        f.write("".join(_element(k, "string", v) for k, v in h.attributes.items()))
        for r in rows.toLocalIterator():
            f.write("<trace>" + "".join(_element(*x) for x in r["c"]))
            for e in r["events"]:
                f.write("<event>" + "".join(_element(*x) for x in e["a"]) + "</event>")
            f.write("</trace>\n")
        f.write("</log>\n")


def _text(path: str) -> io.TextIOBase:
    return gzip.open(path, "wt", encoding="utf-8") if path.endswith(".gz") else open(path, "w", encoding="utf-8")


def read_log(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    kind = fmt or infer_format(path)
    if kind in ("xes", "xes.gz"):
        return read_xes(spark, path, **options)
    if kind in ("json", "json.gz"):
        return spark.read.schema(f"case_id string, activity string, ts timestamp, pos long, attrs {ATTRS}, case_attrs {ATTRS}").json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format of {path}")


def write_log(log: DataFrame, path: str, fmt: str | None = None, header: Header | None = None) -> None:
    """xes and xes.gz are one document; json (lines), json.gz and parquet are directories written in parallel, with all
    attributes, nested ones too."""
    kind = fmt or infer_format(path)
    if kind in ("xes", "xes.gz"):
        write_xes(log, path, header)
    elif kind == "json.gz":
        log.write.mode("overwrite").option("compression", "gzip").json(path)
    elif kind in ("json", "parquet"):
        log.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"unknown format of {path}")


def to_flat(log: DataFrame, event_keys: Iterable[str], case_keys: Iterable[str] = ()) -> DataFrame:
    """One column per attribute; those of the case are prefixed."""
    return log.select(F.col("case_id").alias(f"{CASE_PREFIX}{CASE}"), "pos", *[F.col("attrs")[k]["value"].alias(k) for k in event_keys], *[F.col("case_attrs")[k]["value"].alias(f"{CASE_PREFIX}{k}") for k in case_keys if k != CASE])


def from_flat(df: DataFrame) -> DataFrame:
    """A case log of a flat frame: prefixed columns become attributes of the case."""
    own = [c for c in df.columns if not c.startswith(CASE_PREFIX) and c != "pos"]
    leaf = lambda c: F.struct(F.lit("date" if dict(df.dtypes)[c].startswith("timestamp") else "string").alias("kind"), F.col(f"`{c}`").cast("string").alias("value"), F.lit(None).cast("string").alias("children"))
    pack = lambda names, cut: F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c[cut:]), leaf(c))]), lambda k, v: v["value"].isNotNull())
    case = [c for c in df.columns if c.startswith(CASE_PREFIX)]
    pos = F.col("pos").cast("long") if "pos" in df.columns else F.monotonically_increasing_id()
    ts = parse_timestamp(F.col(f"`{TIME}`")) if TIME in df.columns else F.lit(None).cast("timestamp")
    return df.select(F.col(f"`{CASE_PREFIX}{CASE}`").alias("case_id"), F.col(f"`{ACTIVITY}`").alias("activity"), ts.alias("ts"), pos.alias("pos"), pack(own, 0).alias("attrs"), pack(case, len(CASE_PREFIX)).alias("case_attrs"))


def model_json(frame: DataFrame) -> str:
    """A small model frame (edges, nodes) as JSON."""
    return json.dumps([r.asDict(recursive=True) for r in frame.collect()], default=str)


def dfg_dot(edges: DataFrame) -> str:
    """Graphviz text of a directly-follows graph; as many lines as there are activity pairs."""
    q = lambda s: '"' + str(s).replace('"', '\\"') + '"'
    return "\n".join(["digraph {", "rankdir=LR;", "node [shape=box];", *(f"{q(r['source'])} -> {q(r['target'])} [label={r['count']}];" for r in edges.orderBy("source", "target").collect()), "}"])
