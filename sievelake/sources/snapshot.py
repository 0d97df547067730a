"""Snapshots of a store: a Parquet folder of our own, or one JSON document of tagged values for exchange.

The JSON document is {"version", "next_id", "records": [{"id", "attrs": {name: {tag: value}}}], "edges": [{"from",
"to", "label", "weight"}]} with the tags Int, Float, String and List. It is one file, so it is for stores that
one file suits; Parquet is for all others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.operators.graph import EDGES

if TYPE_CHECKING:
    from sievelake.store import Store

VERSION = 1
CHUNK = 1 << 20  # characters that are written at once
INT, FLOAT, STRING, LIST = "Int", "Float", "String", "List"  # fixed values: tags of the JSON document
_JSON = "version int, next_id bigint, records array<struct<id bigint, attrs map<string, variant>>>, edges array<struct<`from` bigint, `to` bigint, label string, weight double>>"


def save(store: Store, path: str, format: str = "parquet") -> None:  # noqa: A002
    if format == "json":
        _save_json(store, path)
        return
    from sievelake.store import ID

    store._take_ids(0)
    frame = store.frame()
    frame.withColumn(ID, F.col(ID)).write.mode("overwrite").parquet(f"{path}/records")
    store.graph.edges().write.mode("overwrite").parquet(f"{path}/edges")
    points = [(k, *v) for k, v in store.points.items()]
    meta = store.spark.createDataFrame([(VERSION, store._next, points)], "version int, next_id bigint, points array<struct<name string, x string, y string>>")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, memory_budget: int | None = None, format: str = "parquet") -> Store:  # noqa: A002
    """A store with the records, ids, edges and next id of a snapshot; its access paths are cold."""
    from sievelake.operators.graph import GraphStore
    from sievelake.store import Store

    if format == "json":
        return _load_json(spark, path, memory_budget)
    out = Store(spark, memory_budget)
    meta = spark.read.parquet(f"{path}/meta").first()
    out.start_with(spark.read.parquet(f"{path}/records"), meta["next_id"])
    out.points = {p["name"]: (p["x"], p["y"]) for p in meta["points"]}
    out.graph = GraphStore(spark, spark.read.parquet(f"{path}/edges"))
    return out


# --- the JSON document ------------------------------------------------------------------------------


def tagged(value: Any) -> dict[str, Any]:
    if isinstance(value, (list, tuple)):
        return {LIST: [tagged(v) for v in value]}
    if isinstance(value, str):
        return {STRING: value}
    return {FLOAT: value} if isinstance(value, float) else {INT: int(value)}


def untagged(value: dict[str, Any]) -> Any:
    ((tag, inner),) = value.items()
    return [untagged(v) for v in inner] if tag == LIST else float(inner) if tag == FLOAT else inner


def _save_json(store: Store, path: str) -> None:
    """Writes record by record: the driver holds one partition of the store at a time."""
    from sievelake.store import ID

    store._take_ids(0)

    def records() -> Iterator[dict[str, Any]]:
        for row in store.frame().toLocalIterator():
            attrs = {k: (v.toPython() if isinstance(v, T.VariantVal) else v) for k, v in row.asDict().items() if k != ID and v is not None}
            yield {"id": row[ID], "attrs": {k: tagged(v) for k, v in attrs.items()}}

    def edges() -> Iterator[dict[str, Any]]:
        for r in store.graph.edges().toLocalIterator():
            yield {"from": r["src"], "to": r["dst"], "label": r["label"], "weight": r["weight"]}

    def items(rows: Iterator[dict[str, Any]]) -> Iterator[str]:
        between = ""
        for row in rows:
            yield between + json.dumps(row, ensure_ascii=False)
            between = ",\n"

    body = chain([f'{{"version": {VERSION}, "next_id": {store._next}, "records": [\n'], items(records()), ['\n], "edges": [\n'], items(edges()), ["\n]}\n"])
    jvm = store.spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        held, size = [], 0
        for text in body:
            held.append(text)
            size += len(text)
            if size > CHUNK:
                out.write("".join(held).encode())
                held, size = [], 0
        out.write("".join(held).encode())
    finally:
        out.close()


def _of_tag(value: Any, tag: str) -> Any:
    """A tagged value as a column: the tag decides, never the number's looks."""
    return F.try_variant_get(value, f"$.{tag}", {INT: "bigint", FLOAT: "double", STRING: "string", LIST: "variant"}[tag])


def _load_json(spark: SparkSession, path: str, memory_budget: int | None) -> Store:
    from sievelake.operators.graph import GraphStore
    from sievelake.store import ID, Store

    doc = spark.read.schema(_JSON).json(path, multiLine=True)
    out = Store(spark, memory_budget)
    # of records with one id the last counts
    rows = doc.select(F.posexplode("records").alias("pos", "r")).groupBy(F.col("r.id").alias(ID)).agg(F.max_by("r.attrs", "pos").alias("attrs")).persist()
    tags = rows.select(F.explode("attrs").alias("name", "v")).select("name", F.regexp_extract(F.schema_of_variant("v"), r"^OBJECT<(\w+)", 1).alias("tag")).distinct().collect()  # one row for each attribute and tag
    kinds: dict[str, set[str]] = {}
    for r in tags:
        kinds.setdefault(r["name"], set()).add(r["tag"])
    columns = [F.col(ID)]
    for name, found in sorted(kinds.items()):
        v = F.col("attrs")[name]
        if len(found) == 1 and LIST not in found:
            columns.append(_of_tag(v, next(iter(found))).alias(name))
        elif found == {LIST}:
            columns.append(_list(rows, v, name).alias(name))
        elif found <= {INT, FLOAT}:
            columns.append(F.coalesce(_of_tag(v, FLOAT), _of_tag(v, INT).cast("double")).alias(name))
        else:
            columns.append(F.coalesce(*[_of_tag(v, t).cast("variant") for t in sorted(found)]).alias(name))
    frame = rows.select(*columns)
    next_id = doc.select("next_id").first()["next_id"]
    if columns[1:] or not rows.isEmpty():
        out.start_with(frame, next_id)
    out._next = next_id
    edges = doc.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.label").alias("label"), F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
    out.graph = GraphStore(spark, edges)
    return out


def _list(rows: DataFrame, value: Any, name: str) -> Any:
    """A list whose items have one tag as an array of it (numbers of both as doubles); any other as a VARIANT."""
    items = F.try_variant_get(value, f"$.{LIST}", "array<variant>")
    tags = {r[0] for r in rows.select(F.explode(items).alias("i")).select(F.regexp_extract(F.schema_of_variant("i"), r"^OBJECT<(\w+)", 1)).distinct().collect()}
    if tags <= {INT, FLOAT} and FLOAT in tags:
        return F.transform(items, lambda i: F.coalesce(_of_tag(i, FLOAT), _of_tag(i, INT).cast("double")))
    if len(tags) == 1 and LIST not in tags:
        return F.transform(items, lambda i: _of_tag(i, next(iter(tags))))
    return F.try_variant_get(value, f"$.{LIST}", "variant")
