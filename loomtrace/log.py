"""Event logs as DataFrames.

A case log is a DataFrame of events with case_id, activity, ts and an order column pos that breaks
ties; other columns are attributes. An object-centric log (OCLog) is a set of normalised frames.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ddl(str):
    """A schema as DDL text of flat columns; needs no session until it is used."""

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.split(", ")]


EV = Ddl("ev_id string, ev_type string, ts timestamp")
OB = Ddl("ob_id string, ob_type string")
E2O = Ddl("ev_id string, ob_id string, qualifier string")
O2O = Ddl("src_id string, tgt_id string, qualifier string")
ATTR = Ddl("ob_id string, name string, value string, ts timestamp")
EV_ATTR = Ddl("ev_id string, name string, value string")
TYPES = Ddl("kind string, type string, name string, value_type string")


@dataclass(frozen=True)
class OCLog:
    """ev(ev_id, ev_type, ts), ob(ob_id, ob_type), e2o(ev_id, ob_id, qualifier),
    o2o(src_id, tgt_id, qualifier), obj_attr(ob_id, name, value, ts), ev_attr(ev_id, name, value),
    types(kind, type, name, value_type): declared types and their attributes.

    A source that has the joined tables at hand may give them: pairs as in e2o_d, raw as in e2o_raw, links as in
    o2o_typed. They are as the joins would give them, ids have one type each, and an edit of what they are made of drops them. sizes(ob_id, n)
    are at least the numbers of rows of objects in e2o_raw, if they are known for less than counting these costs."""

    ev: DataFrame
    ob: DataFrame
    e2o: DataFrame
    o2o: DataFrame
    obj_attr: DataFrame
    ev_attr: DataFrame
    types: DataFrame | None = None
    pairs: DataFrame | None = None
    raw: DataFrame | None = None
    links: DataFrame | None = None
    sizes: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.ev.sparkSession

    @classmethod
    def of(cls, spark: SparkSession, ev, ob, e2o, o2o=(), obj_attr=(), ev_attr=()) -> OCLog:
        """A log from Python rows; for tests and small literals."""
        make = lambda rows, schema: spark.createDataFrame([tuple(r) for r in rows], schema)
        return cls(make(ev, EV), make(ob, OB), make(e2o, E2O), make(o2o, O2O), make(obj_attr, ATTR), make(ev_attr, EV_ATTR))

    @cached_property
    def e2o_d(self) -> DataFrame:
        """Distinct (event, object) pairs with both types and the time; the table most operators join.

        Pairs are made distinct where the join has already dealt them by event, which saves an
        exchange, and end dealt by object, as lives of objects need them."""
        if self.pairs is not None:
            return self.pairs
        pairs = self.e2o.select("ev_id", "ob_id").join(self.ev, "ev_id").select("ev_id", "ob_id", "ev_type", "ts").distinct()
        return pairs.join(self.ob, "ob_id").select("ev_id", "ob_id", "ev_type", "ob_type", "ts")

    @cached_property
    def e2o_raw(self) -> DataFrame:
        """One row per (event, object, qualifier)."""
        if self.raw is not None:
            return self.raw
        return self.e2o.join(self.ev, "ev_id").join(self.ob, "ob_id").select("ev_id", "ob_id", "qualifier", "ev_type", "ob_type", "ts")

    @cached_property
    def o2o_typed(self) -> DataFrame:
        """One row per (source, target, qualifier) with both types."""
        if self.links is not None:
            return self.links
        s = self.ob.select(F.col("ob_id").alias("src_id"), F.col("ob_type").alias("src_type"))
        t = self.ob.select(F.col("ob_id").alias("tgt_id"), F.col("ob_type").alias("tgt_type"))
        return self.o2o.join(s, "src_id").join(t, "tgt_id").select("src_id", "tgt_id", "qualifier", "src_type", "tgt_type")

    def with_(self, **frames: DataFrame) -> OCLog:
        if frames.keys() & {"ev", "ob", "e2o"}:
            frames = {"pairs": None, "raw": None, "sizes": None} | frames
        if frames.keys() & {"ob", "o2o"}:
            frames = {"links": None} | frames
        return replace(self, **frames)

    def persist(self) -> OCLog:
        """The same log with its frames kept in memory or on disk."""
        for df in (self.ev, self.ob, self.e2o, self.o2o):
            df.persist()
        return self


def ordered(*extra: str):
    """Order of events within a case or an object's life: time, then id."""
    return [F.col(c) for c in ("ts", *(extra or ("ev_id",)))]
