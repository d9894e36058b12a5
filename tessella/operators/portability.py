"""Export and import of a library between installations: records name each other by uid, never by a local id.

A library is a set of tables with local ids.  What each refers to is told by
``Kind``s, so export and import are the same few joins for every table: ids to
uids on the way out, uids to ids on the way in.  Ids are given out before any
reference is resolved, so a record may refer to one that comes later, or to one
of its own table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Scratch
from . import relations


@dataclass(frozen=True)
class Kind:
    """A table: its id column, the columns that refer to other kinds, what tells the later of two records, and whose project it belongs to.

    Every table has a uid (string).  stamp: a string column that sorts as time
    does.  within: the reference that leads towards the root kind of a project.
    """

    name: str
    id: str
    refers: dict[str, str] = field(default_factory=dict)
    stamp: str = "updated_at"
    within: str | None = None


#: The kinds of a library, each behind those that it lies within.
LIBRARY = (
    Kind("source", "source_id"),
    Kind("item", "item_id", {"source_id": "source"}, within="source_id"),
    Kind("section", "section_id", {"item_id": "item", "parent_id": "section"}, within="item_id"),
    Kind("chunk", "chunk_id", {"item_id": "item", "section_id": "section"}, within="item_id"),
    Kind("entity", "entity_id", {"item_id": "item"}, within="item_id"),
)


def in_scope(tables: dict[str, DataFrame], roots: DataFrame | None, kinds: tuple[Kind, ...] = LIBRARY) -> dict[str, DataFrame]:
    """The tables cut to what lies within the given roots (ids of the first kind); None: all."""
    if roots is None:
        return tables
    out = {}
    for k in kinds:
        if k.name not in tables:
            continue
        if k.within is None:
            out[k.name] = tables[k.name].join(roots.select(F.col(k.id)).distinct(), k.id, "left_semi") if k.id in roots.columns else tables[k.name]
        else:
            above = next(a for a in kinds if a.name == k.refers[k.within])
            inside = out[above.name].select(F.col(above.id).alias("_above")).distinct()
            out[k.name] = tables[k.name].join(inside, F.col(k.within) == F.col("_above"), "left_semi")
    return out


def export(tables: dict[str, DataFrame], roots: DataFrame | None = None, kinds: tuple[Kind, ...] = LIBRARY) -> DataFrame:
    """kind, uid, stamp and line (JSON: fields, and the uids of what it refers to) of every record within the roots.

    A reference to what is not exported is left out, as its uid would mean
    nothing there.
    """
    own, parts = in_scope(tables, roots, kinds), []
    for k in [k for k in kinds if k.name in own]:
        rows = own[k.name]
        plain = [c for c in rows.columns if c not in (k.id, "uid", *k.refers)]
        for column, other in k.refers.items():
            there = next(a for a in kinds if a.name == other)
            names = own[other].select(F.col(there.id).alias("_id"), F.col("uid").alias(f"_uid_{column}")) if other in own else None
            rows = rows.withColumn(f"_uid_{column}", F.lit(None).cast("string")) if names is None else rows.join(names, F.col(column) == F.col("_id"), "left").drop("_id")
        refs = F.struct(*[F.col(f"_uid_{c}").alias(c) for c in k.refers]) if k.refers else F.lit(None).cast("struct<_:int>")
        line = F.to_json(F.struct(F.lit(k.name).alias("kind"), "uid", F.struct(*plain).alias("fields"), refs.alias("refs")))
        parts.append(rows.select(F.lit(k.name).alias("kind"), "uid", F.col(k.stamp).cast("string").alias("stamp"), line.alias("line")))
    return reduce(DataFrame.unionByName, parts)


def _read(lines: DataFrame, kind: Kind, table: DataFrame) -> DataFrame:
    """The records of one kind: uid, fields in the types of the table, and _uid_ columns; the last stamp of a uid counts, then the larger line."""
    plain = [f for f in table.schema.fields if f.name not in (kind.id, "uid", *kind.refers)]
    schema = T.StructType(
        [T.StructField("uid", T.StringType()), T.StructField("fields", T.StructType(plain)), T.StructField("refs", T.StructType([T.StructField(c, T.StringType()) for c in kind.refers] or [T.StructField("_", T.IntegerType())]))]
    )
    rows = lines.where(F.get_json_object("line", "$.kind") == kind.name).select("line", F.from_json("line", schema).alias("r")).where("r.uid IS NOT NULL")
    latest = Window.partitionBy("r.uid").orderBy(F.desc(F.col("r.fields")[kind.stamp].cast("string")), F.desc("line"))
    one = rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    return one.select("r.uid", *[F.col("r.fields")[f.name].alias(f.name) for f in plain], *[F.col("r.refs")[c].alias(f"_uid_{c}") for c in kind.refers])


@dataclass(frozen=True)
class Imported:
    """tables after the import, and report: kind, added, updated, kept (an own record is as late or later), removed, unresolved (references without a record)."""

    tables: dict[str, DataFrame]
    report: DataFrame


def import_lines(
    spark: SparkSession, tables: dict[str, DataFrame], lines: DataFrame, replace: bool = False, dry_run: bool = False, kinds: tuple[Kind, ...] = LIBRARY
) -> Imported:
    """Bring exported lines (line) into tables.

    A record whose uid is there replaces it if its stamp is later (a missing
    stamp is the earliest); new ones get ids above all others.  replace: only
    what the lines hold is left.  dry_run: the report alone, the tables as they
    are.  References are resolved after all ids are known, those between
    records of one table too; what they name nowhere becomes null and is
    counted.  Lines that are no records of a known kind are passed over.
    """
    scratch, fresh, uids, counts = Scratch(spark, "import"), {}, {}, []
    present = [k for k in kinds if k.name in tables]
    for k in present:  # ids first
        old = tables[k.name]
        here = old.select(F.col(k.id).alias("_id"), F.col("uid").alias("_uid"), F.coalesce(F.col(k.stamp).cast("string"), F.lit("")).alias("_stamp"))
        met = _read(lines, k, old).join(here, F.col("uid") == F.col("_uid"), "left")
        later = F.coalesce(F.col(k.stamp).cast("string"), F.lit("")) > F.col("_stamp")
        what = F.when(F.col("_id").isNull(), "added").when(F.lit(replace) | later, "updated").otherwise("kept")
        top = old.agg(F.coalesce(F.max(k.id), F.lit(0))).first()[0]
        met = scratch.write(met.withColumn("_what", what), f"met-{k.name}")
        new = relations.numbers(met.where("_id IS NULL").select("uid"), "uid").select("uid", (F.lit(top) + F.col("n")).alias("_new"))  # in the order of uids
        own = F.coalesce("_id", "_new").cast(old.schema[k.id].dataType)
        fresh[k.name] = scratch.write(met.join(new, "uid", "left").withColumn(k.id, own).drop("_id", "_uid", "_stamp", "_new"), f"fresh-{k.name}")
        stay = here.select(F.col("_uid").alias("uid"), F.col("_id").alias(k.id))
        stay = stay.limit(0) if replace else stay.join(fresh[k.name].select("uid"), "uid", "left_anti")
        uids[k.name] = stay.unionByName(fresh[k.name].select("uid", k.id))
    out = {}
    for k in present:
        rows, lost = fresh[k.name], []
        for column, other in k.refers.items():
            names = uids[other].toDF("_there", column) if other in uids else None
            rows = rows.withColumn(column, F.lit(None).cast("long")) if names is None else rows.join(names, F.col(f"_uid_{column}") == F.col("_there"), "left").drop("_there")
            lost.append((F.col(f"_uid_{column}").isNotNull() & F.col(column).isNull()).cast("long"))
        total: Column = reduce(lambda a, b: a + b, lost) if lost else F.lit(0).cast("long")
        rows = scratch.write(rows.withColumn("_lost", total), f"resolved-{k.name}")
        told = rows.agg(*[F.coalesce(F.sum((F.col("_what") == w).cast("long")), F.lit(0)).alias(w) for w in ("added", "updated", "kept")], F.coalesce(F.sum("_lost"), F.lit(0)).alias("unresolved")).first()
        taken = rows.where("_what <> 'kept'").select(*[F.col(c).cast(tables[k.name].schema[c].dataType) for c in tables[k.name].columns])
        gone = tables[k.name].join(rows.select("uid"), "uid", "left_anti").count() if replace else 0
        kept = tables[k.name].limit(0) if replace else tables[k.name].join(rows.where("_what <> 'kept'").select("uid"), "uid", "left_anti").select(*tables[k.name].columns)
        out[k.name] = kept.unionByName(taken)
        counts.append((k.name, told["added"], told["updated"], told["kept"], gone, told["unresolved"]))
    report = spark.createDataFrame(counts, "kind string, added long, updated long, kept long, removed long, unresolved long")
    return Imported(tables if dry_run else tables | out, report)


def write_bundle(lines: DataFrame, path: str) -> None:
    """Lines as gzip text files, a folder per kind."""
    lines.select("kind", "line").write.partitionBy("kind").option("compression", "gzip").text(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))
