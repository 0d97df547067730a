"""One query for each thing the engine does, over the standard tables, with the SQL that it answers to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators.graph import GraphStore
from sievelake.operators.sketch import bloom_table, count_table
from sievelake.plans.builder import QueryBuilder
from sievelake.shared import checkpointed, remove_path, scratch_path
from sievelake.store import ID, Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _find(name: str, source: str, id_column: str, columns: list[str], ask: Callable[[QueryBuilder], QueryBuilder], where: str, points: dict | None = None) -> None:
    """Register a query over one table: its columns, and the SQL condition (with what follows it)."""

    @register(name, f"SELECT {', '.join(columns)} FROM {source} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store.from_df(table(spark, sf_dir, source), id_column, points)
        store.paths.enabled = False  # one query a store: nothing to build a path for
        return ask(store.find()).execute().select(*columns)


def _served(store: Store, query: QueryBuilder) -> DataFrame:
    """The query's rows by way of access paths: an error if none serves it."""
    out = store.paths.serve(store, query.query())
    if out is None:
        raise RuntimeError("no access path serves this query")
    return out


def _find_by_path(name: str, kind: str, source: str, id_column: str, columns: list[str], ask: Callable[[QueryBuilder], QueryBuilder], where: str) -> None:
    """The same, with the rows read through a path of this kind."""

    @register(f"{name}_by_path", f"SELECT {', '.join(columns)} FROM {source} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store.from_df(table(spark, sf_dir, source), id_column, memory_budget=1 << 40)
        out = _served(store, ask(store.find()))
        if {k for k, _, _ in store.index_inventory()} != {kind}:
            raise RuntimeError(f"served by {store.index_inventory()}, not by {kind}")
        return out.select(*columns)


PART = ("part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"])
CUSTOMER = ("customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
ORDERS = ("orders", "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
DOCS = ("documents", "doc_id", ["doc_id", "lang", "n_chars"])

_find("equals_str", *CUSTOMER, lambda q: q.equals("c_mktsegment", "BUILDING"), "c_mktsegment = 'BUILDING'")
_find("equals_int_as_float", *PART, lambda q: q.equals("p_size", 10.0), "p_size = 10")
_find("equals_fraction_of_int", *PART, lambda q: q.equals("p_size", 10.5), "false")
_find("equals_other_family", *PART, lambda q: q.equals("p_size", "10"), "false")
_find("equals_missing_attr", *CUSTOMER, lambda q: q.equals("no_such", 1), "false")
_find("range_num", *PART, lambda q: q.range("p_retailprice", 950, 1200.5), "p_retailprice BETWEEN 950 AND 1200.5")
_find("range_int_by_float", *PART, lambda q: q.range("p_size", 4.5, 9.5), "p_size BETWEEN 4.5 AND 9.5")
_find("range_str", *PART, lambda q: q.range("p_brand", "Brand#12", "Brand#3"), "p_brand BETWEEN 'Brand#12' AND 'Brand#3'")
_find("range_point", *PART, lambda q: q.range("p_size", 7, 7), "p_size = 7")
_find("range_inverted", *PART, lambda q: q.range("p_size", 9, 3), "false")
_find("range_nan", *PART, lambda q: q.range("p_retailprice", 1.0, float("nan")), "false")
_find("prefix", *PART, lambda q: q.prefix("p_name", "blue"), "starts_with(p_name, 'blue')")
_find("prefix_empty", *PART, lambda q: q.prefix("p_name", ""), "p_name IS NOT NULL")
_find("prefix_of_number", *PART, lambda q: q.prefix("p_size", "1"), "false")
_words = "list_contains(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x)), '{}')"
_find("contains", *DOCS, lambda q: q.contains("text", "The"), _words.format("the"))
_find("contains_and", *DOCS, lambda q: q.contains("text", "en").contains("text", "on"), f"{_words.format('en')} AND {_words.format('on')}")
_find("contains_phrase_never", *DOCS, lambda q: q.contains("text", "of the"), "false")
_grams = "list_distinct(list_transform(range(1, length('  ' || lower({0}) || '  ') - 1), lambda i: substring('  ' || lower({0}) || '  ', i, 3)))"
_mine, _theirs = _grams.format("p_name"), _grams.format("'blue anvl'")
_shared = f"len(list_intersect({_mine}, {_theirs}))"
_find("fuzzy", *PART, lambda q: q.fuzzy("p_name", "blue anvl", 0.4), f"{_shared} / (len({_mine}) + len({_theirs}) - {_shared}) >= 0.4")
_find("fuzzy_any", *PART, lambda q: q.fuzzy("p_name", "blue anvl", 0.0), f"{_shared} > 0")
_find("fuzzy_exact", *PART, lambda q: q.fuzzy("p_name", "Blue Anvil", 1.0), "lower(p_name) = 'blue anvil'")
_find("substring", *PART, lambda q: q.substring("p_name", "E AN"), "contains(lower(p_name), 'e an')")
_find("substring_short", *PART, lambda q: q.substring("p_name", "b"), "contains(lower(p_name), 'b')")
_find("substring_literal", *PART, lambda q: q.substring("p_name", "%"), "contains(p_name, '%')")

_find_by_path("equals", "hash", *PART, lambda q: q.equals("p_brand", "Brand#2"), "p_brand = 'Brand#2'")
_find_by_path("range", "sorted", *PART, lambda q: q.range("p_retailprice", 950, 1200.5), "p_retailprice BETWEEN 950 AND 1200.5")
_find_by_path("prefix", "prefix", *PART, lambda q: q.prefix("p_name", "blue"), "starts_with(p_name, 'blue')")
_find_by_path("contains", "words", *DOCS, lambda q: q.contains("text", "The"), _words.format("the"))
_find_by_path("fuzzy", "trigrams", *PART, lambda q: q.fuzzy("p_name", "blue anvl", 0.4), f"{_shared} / (len({_mine}) + len({_theirs}) - {_shared}) >= 0.4")
_find_by_path("substring", "trigrams", *PART, lambda q: q.substring("p_name", "E AN"), "contains(lower(p_name), 'e an')")

_PLANE = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"


def _plane(spark: SparkSession, sf_dir: str, paths: bool = False) -> Store:
    e = table(spark, sf_dir, "embeddings")
    store = Store.from_df(e.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y")), "vec_id", {"loc": ("x", "y")}, 1 << 40)
    store.paths.enabled = paths
    return store


@register("within_box", f"SELECT * FROM ({_PLANE}) WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.05 AND 0.2")
def within_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(spark, sf_dir).find().within_box("loc", -0.1, -0.05, 0.1, 0.2).execute()


@register("near", f"SELECT * FROM ({_PLANE}) WHERE x BETWEEN -0.1 AND 0.1 AND x * x + y * y <= 0.1 * 0.1")
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(spark, sf_dir).find().near("loc", 0.0, 0.0, 0.1).execute()


@register("within_box_by_path", f"SELECT * FROM ({_PLANE}) WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.05 AND 0.2")
def within_box_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _plane(spark, sf_dir, paths=True)
    return _served(store, store.find().within_box("loc", -0.1, -0.05, 0.1, 0.2)).drop(ID)


@register("near_by_path", f"SELECT * FROM ({_PLANE}) WHERE x BETWEEN -0.1 AND 0.1 AND x * x + y * y <= 0.1 * 0.1")
def near_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _plane(spark, sf_dir, paths=True)
    return _served(store, store.find().near("loc", 0.0, 0.0, 0.1)).drop(ID)


@register("near_top_k", f"SELECT * FROM ({_PLANE}) WHERE x * x + y * y <= 0.2 * 0.2 ORDER BY y DESC, vec_id LIMIT 10")
def near_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(spark, sf_dir).find().near("loc", 0.0, 0.0, 0.2).top_k("y", 10).execute()


@register("near_array_point", "SELECT vec_id, label FROM embeddings WHERE false")
def near_array_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of other than two numbers is no point."""
    return Store.from_df(table(spark, sf_dir, "embeddings"), "vec_id").find().near("embedding", 0, 0, 1).execute().select("vec_id", "label")


_find("compound", *PART, lambda q: q.range("p_size", 5, 40).prefix("p_name", "blue").equals("p_brand", "Brand#2"), "p_size BETWEEN 5 AND 40 AND starts_with(p_name, 'blue') AND p_brand = 'Brand#2'")
_q = QueryBuilder()
_find("any_of", *PART, lambda q: q.any_of([_q.equals("p_size", 1), _q.prefix("p_name", "red").range("p_size", 40, 50)]), "p_size = 1 OR (starts_with(p_name, 'red') AND p_size BETWEEN 40 AND 50)")
_find("any_of_empty", *PART, lambda q: q.any_of([]), "false")
_find("exclude", *CUSTOMER, lambda q: q.exclude(_q.equals("c_mktsegment", "BUILDING")), "c_mktsegment <> 'BUILDING'")
_find("exclude_nothing", *CUSTOMER, lambda q: q.exclude(None), "true")
_find("or_and_not", *ORDERS, lambda q: q.any_of([_q.equals("o_orderstatus", "F"), _q.range("o_totalprice", 0, 50_000)]).exclude(_q.range("o_custkey", 100, 1000)), "(o_orderstatus = 'F' OR o_totalprice BETWEEN 0 AND 50000) AND NOT o_custkey BETWEEN 100 AND 1000")
_find("scan_all", *ORDERS, lambda q: q, "true")
_find("topk_desc", *PART, lambda q: q.top_k("p_retailprice", 25), "p_retailprice IS NOT NULL ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
_find("topk_asc", *PART, lambda q: q.top_k("p_retailprice", 25, False), "p_retailprice IS NOT NULL ORDER BY p_retailprice, p_partkey LIMIT 25")
_find("topk_after_filter", *PART, lambda q: q.prefix("p_name", "blue").top_k("p_size", 7), "starts_with(p_name, 'blue') ORDER BY p_size DESC, p_partkey LIMIT 7")
_find("topk_zero", *PART, lambda q: q.top_k("p_size", 0), "false")
_find("topk_beyond", *PART, lambda q: q.equals("p_size", 3).top_k("p_size", 10_000_000), "p_size = 3")
_find("topk_last_call", *PART, lambda q: q.top_k("p_size", 3).top_k("p_retailprice", 4, False), "true ORDER BY p_retailprice, p_partkey LIMIT 4")
_find("catalogue_search", *PART, lambda q: q.range("p_retailprice", 900, 1500).prefix("p_brand", "Brand#1").substring("p_name", "an").top_k("p_size", 20), "p_retailprice BETWEEN 900 AND 1500 AND starts_with(p_brand, 'Brand#1') AND contains(p_name, 'an') ORDER BY p_size DESC, p_partkey LIMIT 20")

# --- records with missing attributes -------------------------------------------------------------------

FAR = 1_000_000_000
_PARTIES = f"""(SELECT c_custkey AS pid, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
                UNION ALL SELECT s_suppkey + {FAR}, s_name, s_acctbal, NULL FROM supplier)"""
_PARTY = ["pid", "name", "acctbal", "segment"]


def _parties(spark: SparkSession, sf_dir: str) -> Store:
    """Customers and suppliers in one store; suppliers have no segment."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + FAR).alias("pid"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    store = Store.from_df(c.unionByName(s, allowMissingColumns=True), "pid")
    store.paths.enabled = False
    return store


@register("exclude_missing", f"SELECT * FROM {_PARTIES} WHERE NOT coalesce(segment = 'BUILDING', false)")
def exclude_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(spark, sf_dir).find().exclude(_q.equals("segment", "BUILDING")).execute().select(*_PARTY)


@register("exclude_prefix_missing", f"SELECT * FROM {_PARTIES} WHERE NOT coalesce(starts_with(segment, 'B') AND acctbal > 0, false)")
def exclude_prefix_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(spark, sf_dir).find().exclude(_q.prefix("segment", "B").range("acctbal", 5e-324, float("inf"))).execute().select(*_PARTY)


@register("topk_missing", f"SELECT * FROM {_PARTIES} WHERE segment IS NOT NULL ORDER BY segment, pid LIMIT 12")
def topk_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(spark, sf_dir).find().top_k("segment", 12, False).execute().select(*_PARTY)


# --- the store ---------------------------------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> Store:
    return Store.from_df(table(spark, sf_dir, "customer"), "c_custkey")


@register("get", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def get(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _customers(spark, sf_dir).get(77)
    return spark.createDataFrame([(found["c_custkey"], found["c_name"])] if found else [], "c_custkey bigint, c_name string")


@register("len", "SELECT count(*) AS n FROM customer")
def len_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(len(_customers(spark, sf_dir)),)], "n bigint")


@register("insert_visible", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT NULL, 'new', 'BUILDING'")
def insert_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _customers(spark, sf_dir)
    store.find().equals("c_mktsegment", "BUILDING").execute()
    store.insert({"c_name": "new", "c_mktsegment": "BUILDING", "note": "no other record has one"})
    return store.find().equals("c_mktsegment", "BUILDING").execute().select("c_custkey", "c_name", "c_mktsegment")


@register("insert_frame_ids", "SELECT CAST(n AS BIGINT) AS id FROM range((SELECT count(*) FROM orders)) t(n)")
def insert_frame_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a frame without ids of its own are 0, 1, 2, ... without a gap."""
    return Store.from_df(table(spark, sf_dir, "orders")).find().execute(with_id=True).select(F.col(ID).alias("id"))


@register("delete", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND c_custkey <> 1")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _customers(spark, sf_dir)
    store.delete(1)
    store.delete_many(store.find().range("c_acctbal", float("-inf"), -5e-324).execute(with_id=True).select(ID))
    return store.find().equals("c_nationkey", 7).execute().select("c_custkey", "c_name")


@register("paths_agree", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000 AND contains(c_name, '1')")
def paths_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served by access paths."""
    store = _customers(spark, sf_dir)
    store.set_memory_budget(1 << 40)
    return store.find().equals("c_mktsegment", "BUILDING").range("c_acctbal", 0, 5000).substring("c_name", "1").execute().select("c_custkey", "c_name")


@register("paths_words", f"SELECT doc_id, lang FROM documents WHERE {_words.format('the')} AND NOT {_words.format('en')}")
def paths_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served by postings of words."""
    store = Store.from_df(table(spark, sf_dir, "documents"), "doc_id", memory_budget=1 << 40)
    return store.find().contains("text", "the").exclude(_q.contains("text", "en")).execute().select("doc_id", "lang")


@register("budget_zero_correct", f"SELECT p_partkey, p_name FROM part WHERE {_shared} / (len({_mine}) + len({_theirs}) - {_shared}) >= 0.4")
def budget_zero_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right without room for any path."""
    store = Store.from_df(table(spark, sf_dir, "part"), "p_partkey", memory_budget=0)
    return store.find().fuzzy("p_name", "blue anvl", 0.4).execute().select("p_partkey", "p_name")


@register("index_inventory", "SELECT * FROM (VALUES ('hash', 'p_brand'), ('prefix', 'p_name'), ('sorted', 'p_size')) t(type, attribute)")
def index_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.from_df(table(spark, sf_dir, "part"), "p_partkey", memory_budget=1 << 40)
    store.find().equals("p_brand", "Brand#2").range("p_size", 5, 40).prefix("p_name", "blue").execute()
    return spark.createDataFrame([x[:2] for x in store.index_inventory()], "type string, attribute string")


@register("path_reused", "SELECT * FROM (VALUES ('sorted', 'p_size'), ('prefix', 'p_name')) t(type, attribute)")
def path_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality is answered by a sorted or prefix path that is there; no hash path is built beside it."""
    store = Store.from_df(table(spark, sf_dir, "part"), "p_partkey", memory_budget=1 << 40)
    for query in (store.find().range("p_size", 5, 40), store.find().prefix("p_name", "blue"), store.find().equals("p_size", 7), store.find().equals("p_name", "blue anvil")):
        _served(store, query)
    return spark.createDataFrame([x[:2] for x in store.index_inventory()], "type string, attribute string")


@register("eviction_keeps_used", "SELECT * FROM (VALUES ('sorted', 'p_size')) t(type, attribute)")
def eviction_keeps_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With room for one path, the one that has been used more stays."""
    store = Store.from_df(table(spark, sf_dir, "part"), "p_partkey", memory_budget=1 << 40)
    for _ in range(40):
        _served(store, store.find().range("p_size", 5, 40))
    _served(store, store.find().range("p_retailprice", 900, 1000))
    store.set_memory_budget(max(size for _, _, size in store.index_inventory()))
    return spark.createDataFrame([x[:2] for x in store.index_inventory()], "type string, attribute string")


@register("paths_after_changes", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(c_name, '00001') AND c_custkey <> 1000 AND c_acctbal >= 0 UNION ALL SELECT c_custkey, 'new ' || c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(c_name, '00001') AND c_nationkey = 7")
def paths_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths outlive inserts and deletes: what came later is read beside them, what went is left out."""
    customers = table(spark, sf_dir, "customer")
    store = Store.from_df(customers, "c_custkey", memory_budget=1 << 40)
    query = store.find().equals("c_mktsegment", "BUILDING").substring("c_name", "00001")
    _served(store, query)
    built = store.index_inventory()
    store.delete(1000)
    store.delete_many(store.find().range("c_acctbal", float("-inf"), -5e-324).execute(with_id=True).select(ID))
    store.insert_frame(customers.filter("c_nationkey = 7").withColumn("c_name", F.concat(F.lit("new "), "c_name")))
    out = _served(store, query).select("c_custkey", "c_name")
    if not set(built) <= set(store.index_inventory()):
        raise RuntimeError("a path was dropped")
    return out


def _reloaded(spark: SparkSession, store: Store, format: str, edges: bool = False) -> DataFrame:  # noqa: A002
    """The rows, or edges, of a store that was saved and loaded again."""
    where = scratch_path(spark, "snapshot")
    store.save(where, format)
    again = Store.load(spark, where, format=format)
    out = checkpointed(again.graph.edges() if edges else again.find().execute())
    remove_path(spark, where)
    return out


@register("snapshot_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reloaded(spark, Store.from_df(table(spark, sf_dir, "nation"), "n_nationkey"), "parquet").select("n_nationkey", "n_name", "n_regionkey")


@register("json_roundtrip", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers come back as longs, doubles as doubles."""
    return _reloaded(spark, _customers(spark, sf_dir), "json").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@register("json_roundtrip_missing", "SELECT c_custkey AS pid, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_name, NULL FROM supplier")
def json_roundtrip_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that a record lacks are not written, and are missing again."""
    return _reloaded(spark, _parties(spark, sf_dir), "json").select("pid", "name", "segment")


@register("json_roundtrip_mixed", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE NULL END AS told FROM part")
def json_roundtrip_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute of two families (numbers of some records, strings of others) keeps each record's own."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    store = Store(spark)
    store.insert_frame(parts.filter("p_size % 3 = 0").select("p_partkey", F.col("p_size").cast("string").alias("told")))
    store.insert_frame(parts.filter("p_size % 3 <> 0").select("p_partkey", F.col("p_size").alias("told")))
    kind = F.schema_of_variant("told")
    return _reloaded(spark, store, "json").select("p_partkey", F.when(kind == "STRING", F.try_variant_get("told", "$", "string")).alias("told"))


@register("parts_rewritten", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 40")
def parts_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty inserts, which are written together on the way."""
    store = Store(spark)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    for k in range(20):
        store.insert_frame(parts.filter(F.col("p_partkey") % 20 == k))
    return store.find().range("p_size", 5, 40).execute()


# --- sketches ------------------------------------------------------------------------------------------

_hex = "CAST(('0x' || substr(md5({0}), {1}, 8)) AS BIGINT)"


@register("bloom_positions", f"SELECT DISTINCT unnest([{', '.join(_hex.format('event_type', 1 + 8 * (i % 4)) + ' % 16384' for i in range(5))}]) AS pos FROM events")
def bloom_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_table(table(spark, sf_dir, "events"), "event_type")


@register("bloom_of_numbers", f"SELECT DISTINCT unnest([{', '.join(_hex.format('CAST(l_quantity AS BIGINT)::VARCHAR', 1 + 8 * (i % 4)) + ' % 16384' for i in range(5))}]) AS pos FROM lineitem")
def bloom_of_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole doubles are known by their digits."""
    return bloom_table(table(spark, sf_dir, "lineitem"), "l_quantity")


_cells = " UNION ALL ".join(f"SELECT {r} AS row, CAST(('0x' || substr(md5(encode(o_orderpriority) || '\\x{r:02x}'::BLOB), 1, 8)) AS BIGINT) % 1024 AS col FROM orders" for r in range(5))


@register("count_min_cells", f"SELECT row, col, count(*) AS cnt FROM ({_cells}) GROUP BY row, col")
def count_min_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_table(table(spark, sf_dir, "orders"), "o_orderpriority")


@register("bloom_maybe_contains", "SELECT DISTINCT event_type, true AS maybe FROM events UNION ALL SELECT 'no such event', false")
def bloom_maybe_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.from_df(table(spark, sf_dir, "events"), "event_id")
    kinds = store.frame().select("event_type").unionByName(spark.createDataFrame([("no such event",)], "event_type string"))
    return store.maybe_contains_each("event_type", kinds)


@register("cms_estimate", "SELECT o_orderpriority, count(*) AS estimate FROM orders GROUP BY 1 UNION ALL SELECT 'never', 0")
def cms_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With five values in 1,024 cells a row, the estimates are exact."""
    store = Store.from_df(table(spark, sf_dir, "orders"), "o_orderkey")
    kinds = store.frame().select("o_orderpriority").unionByName(spark.createDataFrame([("never",)], "o_orderpriority string"))
    return store.estimate_count_each("o_orderpriority", kinds)


@register("bloom_custom_size", f"SELECT DISTINCT unnest([{', '.join(_hex.format('event_type', 1 + 8 * i) + ' % 1009' for i in range(3))}]) AS pos FROM events")
def bloom_custom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_table(table(spark, sf_dir, "events"), "event_type", 1009, 3)


_few = " UNION ALL ".join(f"SELECT {r} AS row, CAST(('0x' || substr(md5(encode(o_orderpriority) || '\\x{r:02x}'::BLOB), 1, 8)) AS BIGINT) % 101 AS col FROM orders" for r in range(3))


@register("count_min_custom_size", f"SELECT row, col, count(*) AS cnt FROM ({_few}) GROUP BY row, col")
def count_min_custom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_table(table(spark, sf_dir, "orders"), "o_orderpriority", 3, 101)


@register("bloom_custom_store", "SELECT DISTINCT event_type, true AS maybe FROM events")
def bloom_custom_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No value that was seen is ever denied, however small the sketch."""
    store = Store.from_df(table(spark, sf_dir, "events"), "event_id")
    store.size_sketches(bits=101, hashes=2)
    return store.maybe_contains_each("event_type", store.frame().select("event_type"))


# --- graphs --------------------------------------------------------------------------------------------

#: customer or supplier -> nation -> region: a forest, so paths are unique. Ids are set apart by table.
NATIONS, REGIONS, SUPPLIERS = 2 * FAR, 3 * FAR, FAR
_UP = f"""SELECT c_custkey AS src, c_nationkey + {NATIONS} AS dst, 'in_nation' AS label FROM customer
          UNION ALL SELECT s_suppkey + {SUPPLIERS}, s_nationkey + {NATIONS}, 'in_nation' FROM supplier
          UNION ALL SELECT n_nationkey + {NATIONS}, n_regionkey + {REGIONS}, 'in_region' FROM nation"""
_TREE = f"(SELECT src, dst, label FROM ({_UP}) UNION ALL SELECT dst, src, label FROM ({_UP}))"


def tree(spark: SparkSession, sf_dir: str, **more: int) -> GraphStore:
    far = lambda c, n: (F.col(c).cast("bigint") + n)
    c = table(spark, sf_dir, "customer").select(far("c_custkey", 0).alias("src"), far("c_nationkey", NATIONS).alias("dst"), F.lit("in_nation").alias("label"))
    s = table(spark, sf_dir, "supplier").select(far("s_suppkey", SUPPLIERS).alias("src"), far("s_nationkey", NATIONS).alias("dst"), F.lit("in_nation").alias("label"))
    n = table(spark, sf_dir, "nation").select(far("n_nationkey", NATIONS).alias("src"), far("n_regionkey", REGIONS).alias("dst"), F.lit("in_region").alias("label"))
    up = c.unionByName(s).unionByName(n).withColumn("weight", F.lit(1.0))
    return GraphStore(spark, up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight")), **more)


def _reach(depth: int, label: str = "") -> str:
    """Breadth-first reach of region 1 up to a depth."""
    only = f" AND label = '{label}'" if label else ""
    steps = [f"l0 AS MATERIALIZED (SELECT CAST({REGIONS + 1} AS BIGINT) AS id, 0 AS depth)"]
    for k in range(depth):
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT * FROM l{k} UNION ALL SELECT DISTINCT dst, {k + 1} FROM {_TREE} t JOIN l{k} f ON f.id = t.src AND f.depth = {k} WHERE dst NOT IN (SELECT id FROM l{k}){only})")
    return f"WITH {', '.join(steps)} SELECT CAST(id AS BIGINT) AS id, CAST(depth AS INTEGER) AS depth FROM l{depth}"


@register("neighbors", f"SELECT DISTINCT CAST(dst AS BIGINT) AS id FROM {_TREE} WHERE src = {NATIONS + 3}")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).neighbors(NATIONS + 3)


@register("neighbors_label", f"SELECT DISTINCT CAST(dst AS BIGINT) AS id FROM {_TREE} WHERE src = {NATIONS + 3} AND label = 'in_region'")
def neighbors_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).neighbors(NATIONS + 3, "in_region")


@register("bfs", _reach(3))
def bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).bfs(REGIONS + 1)


@register("bfs_distributed", _reach(3))
def bfs_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir, local_edges=0).bfs(REGIONS + 1)


@register("bfs_depth", _reach(1))
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).bfs(REGIONS + 1, max_depth=1)


@register("bfs_label", _reach(2, "in_region"))
def bfs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir).bfs(REGIONS + 1, label="in_region")


_PATH_SQL = f"""SELECT unnest([0, 1, 2, 3]) AS step, unnest([CAST(c_custkey AS BIGINT), c_nationkey + {NATIONS}, n_regionkey + {REGIONS}, last]) AS id
FROM (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7),
     (SELECT CAST(min(n_nationkey) AS BIGINT) + {NATIONS} AS last FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7) AND n_nationkey <> (SELECT c_nationkey FROM customer WHERE c_custkey = 7))"""


def _path_rows(spark: SparkSession, path: list[int] | None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(path or [])), "step int, id bigint")


def _path_ends(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Customer 7, and another nation of its region."""
    home = table(spark, sf_dir, "customer").filter("c_custkey = 7").first()["c_nationkey"]
    nations = {r["n_nationkey"]: r["n_regionkey"] for r in table(spark, sf_dir, "nation").collect()}  # 25 rows
    return 7, NATIONS + min(n for n, r in nations.items() if r == nations[home] and n != home)


@register("shortest_path", _PATH_SQL)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path_rows(spark, tree(spark, sf_dir).shortest_path(*_path_ends(spark, sf_dir)))


@register("shortest_path_distributed", _PATH_SQL)
def shortest_path_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path_rows(spark, tree(spark, sf_dir, local_edges=0).shortest_path(*_path_ends(spark, sf_dir)))


#: Nation to nation by what suppliers sold to customers: the least price in cents, so that sums are exact.
_TRADE = """(SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(min(round(l_extendedprice * 100)) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY 1, 2)"""


def trade(spark: SparkSession, sf_dir: str, **more: int) -> GraphStore:
    t = lambda n: table(spark, sf_dir, n)
    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = sold.filter("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.min(F.round(F.col("l_extendedprice") * 100)).alias("weight"))
    return GraphStore(spark, pairs.withColumn("label", F.lit(None).cast("string")), **more)


def _relax(rounds: int, edges: str = "e") -> str:
    steps = [f"e AS MATERIALIZED (SELECT * FROM {_TRADE})", "d0 AS MATERIALIZED (SELECT CAST(3 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS dist)"]
    for k in range(rounds):
        steps.append(f"d{k + 1} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT * FROM d{k} UNION ALL SELECT dst, dist + weight FROM d{k} JOIN {edges} ON src = id) GROUP BY id)")
    return f"WITH {', '.join(steps)} "


@register("dijkstra", _relax(12) + "SELECT id, dist FROM d12")
def dijkstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).dijkstra(3)


@register("dijkstra_distributed", _relax(12) + "SELECT id, dist FROM d12")
def dijkstra_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir, local_edges=0).dijkstra(3)


@register("path_weighted_cost", _relax(12) + "SELECT dist AS cost FROM d12 WHERE id = 11")
def path_weighted_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trade(spark, sf_dir).shortest_path_weighted(3, 11)
    return spark.createDataFrame([(found[1],)] if found else [], "cost double")


@register("path_weighted_distributed", _relax(12) + "SELECT dist AS cost FROM d12 WHERE id = 11")
def path_weighted_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trade(spark, sf_dir, local_edges=0).shortest_path_weighted(3, 11)
    return spark.createDataFrame([(found[1],)] if found else [], "cost double")


_LIGHTEST = _relax(12) + f""", t AS MATERIALIZED (SELECT src, dst FROM e JOIN d12 a ON a.id = src JOIN d12 b ON b.id = dst WHERE a.dist + weight = b.dist),
  l0 AS MATERIALIZED (SELECT CAST(3 AS BIGINT) AS id, 0 AS depth, CAST(NULL AS BIGINT) AS parent), {', '.join(
    f"l{k + 1} AS MATERIALIZED (SELECT * FROM l{k} UNION ALL SELECT dst, {k + 1}, min(src) FROM t JOIN l{k} f ON f.id = src AND f.depth = {k} WHERE dst NOT IN (SELECT id FROM l{k}) GROUP BY dst)" for k in range(12))},
  back AS (SELECT id, depth, parent FROM l12 WHERE id = 11 UNION ALL SELECT l.id, l.depth, l.parent FROM back JOIN l12 l ON l.id = back.parent)
SELECT CAST(depth AS INTEGER) AS step, id FROM back"""
_LIGHTEST = _LIGHTEST.replace("WITH ", "WITH RECURSIVE ", 1).replace("dist FROM d11 JOIN e ON src = id) GROUP BY id) ,", "dist FROM d11 JOIN e ON src = id) GROUP BY id),")


@register("path_weighted", _LIGHTEST)
def path_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a lightest path: of the fewest edges, then of the lowest predecessors."""
    found = trade(spark, sf_dir).shortest_path_weighted(3, 11)
    return _path_rows(spark, found and found[0])


@register("path_weighted_nodes_distributed", _LIGHTEST)
def path_weighted_nodes_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trade(spark, sf_dir, local_edges=0).shortest_path_weighted(3, 11)
    return _path_rows(spark, found and found[0])


@register("weighted_neighbors", f"SELECT dst AS id, weight FROM {_TRADE} WHERE src = 3")
def weighted_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).weighted_neighbors(3)


@register("add_edge", f"SELECT src, dst, label FROM {_TREE} UNION ALL SELECT 1, 2, 'friend' UNION ALL SELECT 2, 1, 'friend' UNION ALL SELECT 1, 3, NULL")
def add_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tree(spark, sf_dir)
    graph.add_edge(1, 2, "friend")
    graph.add_edge(1, 3, directed=True)
    return graph.edges().select("src", "dst", "label")


def _ranked(rounds: int) -> str:
    steps = [
        f"e AS MATERIALIZED (SELECT * FROM {_TRADE})", "n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)", "c AS MATERIALIZED (SELECT count(*) AS n FROM n)",
        "t AS MATERIALIZED (SELECT src, sum(weight) AS total FROM e GROUP BY src)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / c.n AS rank FROM n, c)",
    ]
    for k in range(rounds):
        steps.append(f"""r{k + 1} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM t)) / c.n + 0.85::DOUBLE * coalesce(g.got, 0) AS rank
          FROM c, n LEFT JOIN (SELECT dst, sum(rank * weight / total) AS got FROM e JOIN t USING (src) JOIN r{k} ON r{k}.id = e.src GROUP BY dst) g ON g.dst = n.id)""")
    return f"WITH {', '.join(steps)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@register("pagerank", _ranked(30))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).pagerank(0.85, 30).select("id", F.round("rank", 9).alias("rank"))


@register("pagerank_distributed", _ranked(30))
def pagerank_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir, local_edges=0).pagerank(0.85, 30).select("id", F.round("rank", 9).alias("rank"))


@register("remove_edge", f"SELECT * FROM {_TRADE} WHERE NOT (src = 1 AND dst = 2)")
def remove_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = trade(spark, sf_dir)
    graph.remove_edge(1, 2, None, directed=True)
    graph.remove_edge(3, 4, "no such label", directed=True)
    return graph.edges().select("src", "dst", "weight")


@register("add_weighted_edge", f"SELECT src, dst, CASE WHEN src = 1 AND dst = 2 THEN 0.5 ELSE weight END AS weight FROM {_TRADE} WHERE NOT (src = 1 AND dst = 77) UNION ALL SELECT 1, 77, 2.5 UNION ALL SELECT 77, 1, 2.5 UNION ALL SELECT 1, 2, 0.5 WHERE NOT EXISTS (SELECT 1 FROM {_TRADE} WHERE src = 1 AND dst = 2)")
def add_weighted_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = trade(spark, sf_dir)
    graph.add_weighted_edge(1, 2, 0.5, directed=True)
    graph.add_weighted_edge(1, 77, 2.5)
    return graph.edges().select("src", "dst", "weight")


@register("delete_node", f"SELECT * FROM {_TRADE} WHERE src <> 5 AND dst <> 5")
def delete_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deleted record takes all its edges along, incoming ones too."""
    store = Store.from_df(table(spark, sf_dir, "nation"), "n_nationkey")
    store.graph = trade(spark, sf_dir)
    store.delete(5)
    return store.graph.edges().select("src", "dst", "weight")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store.from_df(table(spark, sf_dir, "part"), "p_partkey")
    store.paths.enabled = False
    return store.find().range("p_size", 5, 40).prefix("p_name", "blue").top_k("p_retailprice", 10).execute()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
