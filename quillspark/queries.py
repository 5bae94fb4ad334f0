"""Queries of the catalogue engine, by name, with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import derived, parsers, text
from quillspark.operators import aggregates, filters, joins, merges, paging, projection, quality, synonyms
from quillspark.plans import fulltext, linking, list_query, search
from quillspark.plans.search_index import SearchIndex
from quillspark.session import working_folder
from quillspark.sources import texts

FLAGSHIP = "list_parts"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """tables.part is the table part."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


PART_FILTERS = filters.FilterSet({"p_partkey": ["exact", "in"], "p_name": ["exact", "iexact", "icontains"], "p_brand": ["exact", "in", "not_in"], "p_size": ["exact", "range", "gt", "gte", "lt", "lte"], "p_type": ["icontains"]}, {"size": "p_size", "brand": "p_brand"})


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size >= 10 AND p_type ILIKE '%s%' ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def list_parts(t):
    listing = list_query.Listing(t.part, "p_partkey", PART_FILTERS, ["p_name", "p_brand"])
    return listing.rows_of({"p_size__gte": 10, "p_type__icontains": "S", "ordering": "-p_retailprice", "fields": "p_partkey,p_name,p_size,p_retailprice,unknown"})


# Filters


@query("SELECT * FROM part WHERE p_size = 3")
def filt_exact(t):
    return PART_FILTERS.apply(t.part, {"size": 3})


@query("SELECT * FROM customer WHERE lower(c_mktsegment) = 'building'")
def filt_iexact(t):
    return t.customer.where(filters.predicate(F.col("c_mktsegment"), "iexact", "bUILDING"))


@query("SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filt_in(t):
    return t.orders.where(filters.predicate(F.col("o_orderpriority"), "in", "1-URGENT,2-HIGH"))


@query("SELECT * FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def filt_not_in(t):
    return t.orders.where(filters.predicate(F.col("o_orderstatus"), "not_in", ["F", "P"]))


@query("SELECT * FROM part WHERE contains(lower(p_name), 'e')")
def filt_icontains(t):
    return PART_FILTERS.apply(t.part, {"p_name__icontains": "E"})


@query("SELECT * FROM part WHERE p_size BETWEEN 5 AND 12")
def filt_range(t):
    return PART_FILTERS.apply(t.part, {"p_size__range": "5,12"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 200000")
def filt_compare(t):
    o = filters.FilterSet({"o_totalprice": ["gt", "lte"]})
    return o.apply(t.orders, {"o_totalprice__gt": 1000, "o_totalprice__lte": 200000}).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) FILTER (WHERE lang IS NULL) AS missing, count(*) FILTER (WHERE lang IS NOT NULL) AS present FROM documents")
def filt_isnull(t):
    c = F.col("lang")
    return t.documents.agg(F.count(F.when(filters.predicate(c, "isnull", "true"), 1)).alias("missing"), F.count(F.when(filters.predicate(c, "isnull", "false"), 1)).alias("present"))


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE 'NATION_1%' OR n_name = 'NATION_7'")
def filt_path_1hop(t):
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).where(F.col("n_name").startswith("NATION_1") | (F.col("n_name") == "NATION_7")).select("c_custkey", "c_name")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def filt_path_2hop(t):
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'")
    return t.customer.join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def filt_m2m_semi(t):
    return filters.related(t.part, t.lineitem, "p_partkey", "l_partkey", (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def filt_m2m_anti(t):
    return filters.unrelated(t.customer, t.orders, "c_custkey", "o_custkey", F.col("o_orderstatus") == "F").select("c_custkey")


_WORDS = filters.FilterSet({}, named={"with": ("words", "has"), "without": ("words", "has_not")})


@query("SELECT doc_id, lang FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND NOT list_contains(string_split(text, ' '), 'and')")
def filt_array_has(t):
    return _WORDS.apply(t.documents.withColumn("words", F.split("text", " ")), {"with": "the", "without": "and"}).select("doc_id", "lang")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a')) AND (contains(lower(p_name), '1') OR contains(lower(p_brand), '1'))")
def filt_keyword_search(t):
    return filters.keyword_search(t.part, "A 1", ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE '%e_i%'")
def filt_like_wildcard(t):
    return t.part.where(filters.predicate(F.col("p_type"), "like", "%E_I%")).select("p_partkey", "p_type")


@query("SELECT event_id, props FROM events WHERE contains(lower(props), '7}')")
def filt_json_text(t):
    return filters.json_text_contains(t.events, "props", "7}").select("event_id", "props")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'A' AND l_discount < 0.05")
def filt_conjunction(t):
    f = filters.FilterSet({"l_quantity": ["gte"], "l_returnflag": ["exact"], "l_discount": ["lt"]})
    return f.apply(t.lineitem, {"l_quantity__gte": 30, "l_returnflag": "A", "l_discount__lt": 0.05}).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> '' AND NOT contains(source, 'src1')")
def filt_exclusions(t):
    return filters.without_key_parts(filters.without_blank(t.documents, "text"), "source", ["src1"]).select("doc_id")


# Projections


@query("SELECT s_suppkey, s_name FROM supplier")
def proj_fields(t):
    return projection.apply_params(t.supplier, {"fields": "s_name,s_suppkey,nothing"})


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def proj_exclude(t):
    return projection.apply_params(t.supplier, {"exclude": "s_name,s_acctbal"})


@query("SELECT s_suppkey, n_name AS nation_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def proj_nested_prune(t):
    nested = joins.with_parent(t.supplier, t.nation, "s_nationkey", "n_nationkey", "nation", ["n_nationkey", "n_name", "n_regionkey"])
    return projection.apply_params(nested, {"nation__fields": "n_name"}).select("s_suppkey", F.col("nation.n_name").alias("nation_name"))


@query("SELECT n_nationkey, n_name, r_name AS region__name FROM nation JOIN region ON n_regionkey = r_regionkey")
def proj_flatten_parent(t):
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("region__name"))


@query("SELECT p_partkey, (CASE WHEN p_size > 10 THEN 1 ELSE 0 END + CASE WHEN p_size > 20 THEN 1 ELSE 0 END + 1)::BIGINT AS n_kept FROM part")
def proj_drop_nulls(t):
    size = F.col("p_size")
    return t.part.select("p_partkey", F.size(F.map_keys(projection.without_nulls(small=size, medium=F.when(size > 10, size), large=F.when(size > 20, size)))).cast("long").alias("n_kept"))


# Joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_nullable(t):
    nested = joins.with_parent(t.documents, t.labels, "doc_id", "doc_id", "label", ["toxic"])
    return nested.select("doc_id", F.col("label.toxic").alias("toxic"))


@query("SELECT o_orderkey, count(l_orderkey) AS n_items, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS part_keys FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def join_one_to_many_nest(t):
    nested = joins.with_children(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "items", ["l_partkey"], ["l_linenumber", "l_partkey"])
    return nested.select("o_orderkey", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ",").alias("part_keys"))


@query("SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_items FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def join_two_level_nest(t):
    inner = joins.with_children(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "items", ["l_linenumber"], ["l_linenumber"])
    outer = joins.with_children(t.customer, inner, "c_custkey", "o_custkey", "orders", ["o_orderkey", "items"], ["o_orderkey"])
    items = F.aggregate("orders", F.lit(0), lambda a, o: a + F.size(o["items"]))
    return outer.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), items.cast("long").alias("n_items"))


@query("SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_bridge(t):
    brands = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("brands"))
    return joins.bridge(brands, "l_suppkey", "brands", "p_brand")


@query("SELECT a.n_name AS nation, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("nation"), F.col("b.n_name").alias("neighbour"))


@query("SELECT 'part' AS kind, l_partkey::VARCHAR AS k, p_name AS name FROM (SELECT DISTINCT l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey UNION ALL SELECT 'supplier', l_suppkey::VARCHAR, s_name FROM (SELECT DISTINCT l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey")
def join_polymorphic(t):
    edges = t.lineitem.select(F.lit("part").alias("kind"), F.col("l_partkey").cast("string").alias("k")).distinct().unionByName(t.lineitem.select(F.lit("supplier").alias("kind"), F.col("l_suppkey").cast("string").alias("k")).distinct())
    tables = {"part": t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")), "supplier": t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))}
    return joins.polymorphic(edges, tables, "kind", "k").where("name IS NOT NULL")


@query("SELECT c_custkey, coalesce(a.r_name, b.n_name) AS place FROM customer LEFT JOIN region a ON a.r_regionkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = c_nationkey")
def join_synonym_chain(t):
    key = F.col("c_nationkey")
    return joins.first_found(t.customer, [(key, t.region, "r_regionkey", "r_name"), (key, t.nation, "n_nationkey", "n_name")], "place").select("c_custkey", "place")


# Aggregates and window patterns


@query("SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'")
def agg_count(t):
    return t.lineitem.where("l_shipdate >= TIMESTAMP '1995-01-01'").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nationkey, 'customer' AS model, count(*) AS actual_count FROM customer GROUP BY ALL UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier GROUP BY ALL")
def agg_stats_by_model(t):
    return aggregates.counts_by({"customer": t.customer.withColumnRenamed("c_nationkey", "nationkey"), "supplier": t.supplier.withColumnRenamed("s_nationkey", "nationkey")}, "nationkey")


@query("SELECT word, count(DISTINCT p_name) AS n_names FROM (SELECT p_name, unnest(list_distinct(regexp_extract_all(lower(p_name), '\\w+'))) AS word FROM part) GROUP BY word")
def agg_word_to_names(t):
    return aggregates.words_to_names(t.part, "p_name").select("word", F.size("names").cast("long").alias("n_names"))


@query("SELECT o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS top_order FROM orders GROUP BY o_custkey")
def agg_max_by(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top_order"))


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def agg_min_by(t):
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("SELECT l_suppkey, count(DISTINCT l_returnflag || l_linestatus) AS n_items, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS flags FROM lineitem GROUP BY l_suppkey")
def agg_set_size_order(t):
    pairs = t.lineitem.select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("flag")).distinct()
    return aggregates.by_group_size(pairs, "l_suppkey", "flag").select("l_suppkey", F.col("n_items").cast("long").alias("n_items"), F.array_join("items", ",").alias("flags"))


@query("SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def agg_string(t):
    grouped = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    return grouped.select("n_regionkey", F.array_join(F.transform("x", lambda r: r["n_name"]), "\n").alias("names"))


@query("SELECT text AS body, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def agg_duplicates(t):
    return aggregates.duplicates(t.documents.withColumnRenamed("text", "body"), ["body"])


@query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1")
def win_keep_first(t):
    return aggregates.keep_first(t.lineitem, ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey")]).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def win_keep_last(t):
    return aggregates.keep_first(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || '_' || (n - 1) END AS key FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def win_suffix_key(t):
    return aggregates.suffixed_keys(t.part, "p_brand", ["p_partkey"]).select("p_partkey", "key")


@query("SELECT o_orderkey, o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1)::BIGINT AS rank FROM orders")
def win_position(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_orderkey", "o_custkey", (F.row_number().over(w) - 1).cast("long").alias("rank"))


# Order and sets


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 20")
def sort_multi_key(t):
    return paging.ordered(t.part, "p_brand,-p_size,bogus", "p_partkey").limit(20).select("p_partkey", "p_brand", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def sort_page(t):
    return paging.page_rows(paging.ordered(t.orders, "-o_totalprice", "o_orderkey"), 3, 25).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30) WHERE c_acctbal > 9000")
def sort_topk_then_threshold(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(30).where("c_acctbal > 9000")


@query("SELECT p_partkey, kind FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY pr) AS n FROM (SELECT p_partkey, 'small' AS kind, 0 AS pr FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 'cheap', 1 FROM part WHERE p_retailprice < 1200)) WHERE n = 1")
def set_priority_union(t):
    both = t.part.where("p_size < 10").select("p_partkey", F.lit("small").alias("kind"), F.lit(0).alias("pr")).unionByName(t.part.where("p_retailprice < 1200").select("p_partkey", F.lit("cheap").alias("kind"), F.lit(1).alias("pr")))
    return aggregates.keep_first(both, ["p_partkey"], [F.asc("pr")]).select("p_partkey", "kind")


# Functions


@query("SELECT p_partkey, floor((p_size - 10) / 2.0)::INT AS modifier, CASE WHEN p_size > 40 THEN p_size ELSE floor((p_size - 10) / 2.0)::INT END AS save FROM part")
def fn_modifier_floor(t):
    return t.part.select("p_partkey", derived.modifier(F.col("p_size")).alias("modifier"), derived.saving_throw(F.when(F.col("p_size") > 40, F.col("p_size")), F.col("p_size")).alias("save"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE ELSE floor(p_size / 2.0) END AS climb, CASE WHEN p_size % 3 = 0 THEN p_size::DOUBLE ELSE 0.0 END AS fly FROM part")
def fn_fallback_chain(t):
    size = F.col("p_size").cast("double")
    given = F.when(F.col("p_size") % 3 == 0, size)
    return t.part.select("p_partkey", derived.speeds(size, given, given, given, given).alias("s")).select("p_partkey", "s.climb", "s.fly")


@query("SELECT p_partkey, CASE p_size WHEN 1 THEN 200 WHEN 5 THEN 1800 WHEN 17 THEN 18000 WHEN 30 THEN 155000 END AS xp FROM part WHERE p_size IN (1, 5, 17, 30, 40)")
def fn_lookup_map(t):
    return t.part.where("p_size IN (1, 5, 17, 30, 40)").select("p_partkey", derived.experience(F.col("p_size")).alias("xp"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_ -]', '', 'g'), '[- ]+', '-', 'g') AS slug FROM part")
def fn_slugify(t):
    return t.part.select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("SELECT p_partkey, p_brand || '_' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_ -]', '', 'g'), '[- ]+', '-', 'g') || '_' || p_partkey AS key FROM part")
def fn_edge_key(t):
    return t.part.select("p_partkey", text.edge_key(F.col("p_brand"), F.col("p_name"), F.col("p_partkey").cast("string")).alias("key"))


@query("SELECT p_partkey, upper(list_aggregate(list_transform(string_split(p_type, ' '), lambda x: x[1]), 'string_agg', '')) AS initials, string_split(p_type, ' ')[-1] AS last FROM part")
def fn_initials(t):
    return t.part.select("p_partkey", text.initials(F.col("p_type")).alias("initials"), text.last_word(F.col("p_type")).alias("last"))


@query("SELECT p_partkey, p_size::VARCHAR || CASE WHEN p_size % 2 = 0 THEN ' + Dex modifier' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' (max 2)' ELSE '' END AS display, CASE WHEN p_size % 5 = 0 THEN 'medium' WHEN p_size % 2 = 0 THEN 'light' ELSE 'heavy' END AS category FROM part")
def fn_display_strings(t):
    dex, cap = F.col("p_size") % 2 == 0, F.when(F.col("p_size") % 5 == 0, 2)
    return t.part.select("p_partkey", derived.armor_display(F.col("p_size"), dex, cap).alias("display"), derived.armor_category(dex, cap).alias("category"))


@query("SELECT p_partkey, round(p_retailprice * 0.1, 2)::DECIMAL(10,2)::VARCHAR AS cost FROM part")
def fn_parse_cost(t):
    return t.part.select("p_partkey", parsers.cost(F.concat(F.col("p_retailprice").cast("decimal(10,2)").cast("string"), F.lit(" sp"))).cast("string").alias("cost"))


@query("SELECT p_partkey, (p_size / 8.0)::DECIMAL(10,3)::VARCHAR AS weight FROM part")
def fn_parse_weight(t):
    return t.part.select("p_partkey", parsers.weight(F.concat(F.col("p_size").cast("string"), F.lit("/8 lb."))).cast("string").alias("weight"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 5280 ELSE p_size END AS feet FROM part")
def fn_parse_range(t):
    unit = F.when(F.col("p_size") % 2 == 0, " miles (about)").otherwise(" feet")
    return t.part.select("p_partkey", parsers.sortable_range(F.concat(F.col("p_size").cast("string"), unit)).alias("feet"))


@query("SELECT p_partkey, '2d' || p_size AS dice, p_size % 7 AS bonus FROM part")
def fn_parse_dice(t):
    made = F.concat(F.lit("Melee Weapon Attack: +4 to hit, reach 5 ft., 9 (2d"), F.col("p_size").cast("string"), F.lit(" + "), (F.col("p_size") % 7).cast("string"), F.lit(") fire damage"))
    a = parsers.attack(made)
    return t.part.select("p_partkey", a["dice"].alias("dice"), a["dice_bonus"].alias("bonus"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def fn_json_text(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


# Search

_DOC_TOKENS = "regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{L}\\p{N}]+')"


@query(f"""WITH d AS (SELECT doc_id, {_DOC_TOKENS} AS tok FROM documents),
 c AS (SELECT doc_id, len(tok) AS l, len(list_filter(tok, lambda x: x = 'license')) AS f1, len(list_filter(tok, lambda x: x = 'version')) AS f2 FROM d),
 s AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (WHERE f1 > 0) AS n1, count(*) FILTER (WHERE f2 > 0) AS n2 FROM c),
 w AS (SELECT *, ln((n - n1 + 0.5) / (n1 + 0.5)) AS i1, ln((n - n2 + 0.5) / (n2 + 0.5)) AS i2 FROM c, s)
 SELECT doc_id, round(-((CASE WHEN i1 <= 0 THEN 1e-6 ELSE i1 END) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / a)) + (CASE WHEN i2 <= 0 THEN 1e-6 ELSE i2 END) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM w WHERE f1 > 0 AND f2 > 0""")
def srch_bm25(t):
    return search.bm25(t.documents.select("doc_id", "text"), ["license", "version"], {"text": 1.0}).select("doc_id", F.round("score", 6).alias("score"))


@query(ORACLES["srch_bm25"])
def srch_index(t):
    """What srch_bm25 finds, from an index that is written first."""
    index = SearchIndex.build(t.documents.select("doc_id", "text"), working_folder(t.spark, "search-index"), ["text"], "doc_id", parts=16)
    return index.bm25(["license", "version"], {"text": 1.0}).select("doc_id", F.round("score", 6).alias("score"))


_WEIGHTS = """tf AS (SELECT p_partkey, term, count(*) AS tf FROM (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '\\w\\w+')) AS term FROM part) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM part),
 raw AS (SELECT p_partkey, term, tf * (ln((1 + n) / (1 + df)) + 1) AS r, ln((1 + n) / (1 + df)) + 1 AS idf FROM tf JOIN df USING (term), n),
 w AS (SELECT p_partkey, term, r / sqrt(sum(r * r) OVER (PARTITION BY p_partkey)) AS weight, idf FROM raw)"""


@query(f"""WITH {_WEIGHTS}, top AS (SELECT p_name || ' ' || p_type AS q FROM part ORDER BY p_partkey LIMIT 1),
 qt AS (SELECT term, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(q), '\\w\\w+')) AS term FROM top) GROUP BY term),
 qw AS (SELECT term, c * any_value(idf) AS v FROM qt JOIN w USING (term) GROUP BY term, c),
 qn AS (SELECT term, v / sqrt(sum(v * v) OVER ()) AS v FROM qw)
 SELECT p_partkey, round(sum(weight * v), 6) AS score FROM w JOIN qn USING (term) GROUP BY p_partkey HAVING sum(weight * v) > 0.05""")
def srch_tfidf(t):
    weights = search.term_weights(t.part, "p_partkey", F.concat_ws(" ", "p_name", "p_type"))
    top = t.part.orderBy("p_partkey").select(F.concat_ws(" ", "p_name", "p_type").alias("q")).first()
    return search.tfidf_scores(weights, "p_partkey", top.q).select("p_partkey", F.round("score", 6).alias("score"))


def _common_sql(word: str) -> str:
    """SQL rows (pattern, letters) of all subsequences of the word: the longest one that matches is the longest common subsequence."""
    picks = {"".join(c for k, c in enumerate(word) if mask >> k & 1) for mask in range(1, 1 << len(word))}
    return ", ".join(f"('%{'%'.join(x)}%', {len(x)})" for x in sorted(picks))


@query(f"""WITH w AS (SELECT DISTINCT p_name, unnest(regexp_extract_all(lower(p_name), '\\w+')) AS word FROM part),
 s AS (SELECT word, max(200.0::DOUBLE * n / (length(word) + 4)) AS score FROM (SELECT DISTINCT word FROM w) JOIN (VALUES {_common_sql("geer")}) v(p, n) ON word LIKE p GROUP BY word),
 b AS (SELECT word, score FROM (SELECT * FROM s ORDER BY score DESC, word LIMIT 5) WHERE score >= 75)
 SELECT p_name, word, score FROM w JOIN b USING (word) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY score DESC, word DESC) = 1""")
def srch_fuzzy(t):
    return search.fuzzy_names(t.part, "p_name", "geer")


@query("SELECT doc_id, regexp_replace(text, '\\b(license|version)\\b', '<span class=\"highlighted\">\\1</span>', 'gi') AS marked FROM documents WHERE regexp_matches(text, '\\b(license|version)\\b', 'i')")
def srch_highlight(t):
    return t.documents.where(F.col("text").rlike(r"(?i)\b(license|version)\b")).select("doc_id", text.highlighted(F.col("text"), ["license", "version"]).alias("marked"))


def _scored(found: str, phrases: dict[str, str]) -> str:
    """SQL of BM25 over `phrases`: name -> count of a row, given its tokens `tok`; found: which rows match."""
    counts = ", ".join(f"{sql} AS {n}" for n, sql in phrases.items())
    totals = ", ".join(f"count(*) FILTER (WHERE {n} > 0) AS d_{n}" for n in phrases)
    weight = lambda n: f"ln((n - d_{n} + 0.5) / (d_{n} + 0.5))"
    part = lambda n: f"(CASE WHEN {weight(n)} <= 0 THEN 1e-6 ELSE {weight(n)} END) * {n} * 2.2 / ({n} + 1.2 * (0.25 + 0.75 * l / a))"
    return f"""WITH d AS (SELECT doc_id, {_DOC_TOKENS} AS tok FROM documents), c AS (SELECT doc_id, len(tok) AS l, {counts} FROM d), s AS (SELECT count(*) AS n, avg(l) AS a, {totals} FROM c)
 SELECT doc_id, round(-({" + ".join(map(part, phrases))}), 6) AS score FROM c, s WHERE {found}"""


def _phrase_sql(words: list[str], prefix: bool = False) -> str:
    tests = [f"starts_with(tok[i + {k}], '{w}')" if prefix and k == len(words) - 1 else f"tok[i + {k}] = '{w}'" for k, w in enumerate(words)]
    return f"len(list_filter(range(1, len(tok) + {2 - len(words)}), lambda i: {' AND '.join(tests)}))"


@query(_scored("a1 > 0 AND v > 0 AND r = 0", {"a1": _phrase_sql(["public", "license"]), "v": _phrase_sql(["version"])}).replace("AS a1,", f"AS a1, {_phrase_sql(['4', '0'])} AS r,"))
def srch_phrase(t):
    """Phrases with AND and NOT, by one scan of the texts."""
    node = fulltext.parse('"public license" AND version NOT "4 0"', ["text"])
    return fulltext.matches(t.documents.select("doc_id", "text"), node, {"text": 1.0}).select("doc_id", F.round("score", 6).alias("score"))


@query(_scored("p > 0 AND w > 0", {"p": _phrase_sql(["general", "publ"], True), "w": _phrase_sql(["licen"], True)}))
def srch_prefix(t):
    """A phrase that ends in a prefix and a prefix, answered by a kept index with positions."""
    index = SearchIndex.build(t.documents.select("doc_id", "text"), working_folder(t.spark, "search-index"), ["text"], "doc_id", parts=16)
    return index.matches(fulltext.parse('"general publ"* licen*', ["text"]), {"text": 1.0}).select("doc_id", F.round("score", 6).alias("score"))


@query(r"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS tok, string_split_regex(text, '[\p{L}\p{N}]+') AS btw FROM documents WHERE text IS NOT NULL),
 h AS (SELECT *, len(tok) AS n, list_filter(range(0, len(tok)), lambda i: lower(strip_accents(tok[i + 1])) = 'license') AS hits FROM d),
 s AS (SELECT *, CASE WHEN n > 20 THEN list_filter(range(0, n), lambda i: i = 0 OR regexp_matches(btw[i + 1], '[.:][ \t\r\n]+$')) ELSE [] END AS starts FROM h WHERE len(hits) > 0),
 one AS (SELECT *, unnest(hits) AS hit, generate_subscripts(hits, 1) AS k FROM s),
 near AS (SELECT *, list_max(list_filter(hits, lambda x: x >= hit AND x < hit + 20)) AS last, list_max(list_filter(starts, lambda x: x < hit)) AS before FROM one),
 found AS (
  SELECT doc_id, 999 + len(list_filter(hits, lambda x: x >= hit AND x < hit + 20)) AS worth, 2 * k AS turn, greatest(0, least(hit - (20 - (last + 1 - hit)) // 2, n - 20)) AS b FROM near
  UNION ALL SELECT doc_id, len(list_filter(hits, lambda x: x >= before AND x < before + 20)) + CASE WHEN len(list_filter(hits, lambda x: x >= before AND x < before + 20)) > 0 THEN 999 ELSE 0 END + CASE WHEN before = 0 THEN 120 ELSE 100 END, 2 * k + 1, before FROM near WHERE before IS NOT NULL AND NOT list_contains(starts, hit)),
 best AS (SELECT doc_id, b FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY worth DESC, turn) = 1),
 cut AS (SELECT s.*, b, least(b + 20, n) AS e FROM s JOIN best USING (doc_id))
 SELECT doc_id, (CASE WHEN b > 0 THEN '...' ELSE '' END) || array_to_string(list_transform(range(b, e), lambda i: (CASE WHEN i = b AND i > 0 THEN '' ELSE btw[i + 1] END) || CASE WHEN list_contains(hits, i) THEN '<span class="highlighted">' || tok[i + 1] || '</span>' ELSE tok[i + 1] END), '') || (CASE WHEN e >= n THEN btw[n + 1] ELSE '...' END) AS snippet FROM cut""")
def srch_snippet(t):
    node = fulltext.parse("license", ["text"])
    docs = t.documents.select("doc_id", "text").where(F.array_contains(search.tokens(F.col("text")), "license"))
    return fulltext.snippets(docs, node, {"text": 1.0}).select("doc_id", "snippet")


@query()
def srch_merged(t):
    d = t.documents.select(F.col("doc_id").cast("string").alias("object_pk"), F.coalesce(F.substring("text", 1, 40), F.lit("")).alias("object_name"), F.col("lang").alias("object_model"), F.col("source").alias("document_pk"), F.lit("v2").alias("schema_version"), "text")
    return search.search(search.Corpus(d, weighed=F.concat_ws(" ", "object_name", "text")), search.SearchRequest("license version", vector=True))


# Linking, quality, conversion


@query("""SELECT p_partkey AS source_key, k AS reference_key, name AS anchor FROM part JOIN (SELECT p_brand AS name, min(p_partkey) AS k FROM part GROUP BY p_brand)
 ON regexp_matches('Made by ' || p_brand || ', unlike ' || p_name || '.', '\\b' || name || '\\b', 'i')""")
def xref_names(t):
    sources = t.part.select(F.lit("part").alias("type"), F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("Made by "), "p_brand", F.lit(", unlike "), "p_name", F.lit(".")).alias("desc"))
    refs = t.part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").cast("string").alias("key")).withColumn("type", F.lit("brand"))
    found = linking.links(sources, refs)
    return found.select(F.col("source_key").cast("long").alias("source_key"), F.col("reference_key").cast("long").alias("reference_key"), "anchor")


@query("""WITH c AS (SELECT *, CASE WHEN c_custkey = 1 THEN 2 ELSE c_custkey END AS asked, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance FROM customer)
 SELECT c_custkey, coalesce(balance, s_acctbal) AS balance, CASE WHEN s_suppkey IS NULL THEN c_nationkey ELSE s_nationkey END AS c_nationkey, NULL::VARCHAR AS c_mktsegment, CASE WHEN s_suppkey IS NULL THEN 'unmatched' ELSE 'matched' END AS outcome
 FROM c LEFT JOIN supplier ON s_suppkey = asked""")
def etl_patch(t):
    """Customers patched from the supplier of the same number: a missing balance, always the nation, and no segment."""
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), "c_nationkey", "c_mktsegment")
    patch = merges.patched(rows, t.supplier, "c_custkey", "s_suppkey", {"balance": ("s_acctbal", merges.IF_NULL), "c_nationkey": ("s_nationkey", merges.ALWAYS), "c_mktsegment": (None, merges.CLEAR)}, {"1": "2"})
    outcome = patch.report.where("outcome != 'unused'").select(F.col("c_custkey").cast("long").alias("c_custkey"), "outcome")
    return patch.rows.join(outcome, "c_custkey")


@query("""WITH w AS (SELECT DISTINCT p_partkey, lower(trim(unnest(string_split(p_type || ' ' || CASE WHEN p_size = 7 THEN 'Any' ELSE '' END, ' ')))) AS word FROM part),
 e AS (SELECT DISTINCT n_name AS target, CASE n_regionkey WHEN 0 THEN 'small' WHEN 1 THEN 'large' WHEN 2 THEN 'medium' WHEN 3 THEN 'economy' ELSE lower(n_name) END AS word FROM nation)
 SELECT DISTINCT p_partkey AS key, target FROM w JOIN e ON w.word = e.word OR w.word = 'any'""")
def etl_synonyms(t):
    """Parts linked with nations by the words of their types: the words of a size mean a region's nations, Any means all."""
    rows = t.part.select("p_partkey", F.split(F.concat_ws(" ", "p_type", F.when(F.col("p_size") == 7, "Any").otherwise("")), " ").alias("words"))
    regions = {r: w for r, w in enumerate(("small", "large", "medium", "economy"))}
    names = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in regions.items() for x in p)), F.col("n_regionkey").cast("int")), F.col("n_name"))
    return synonyms.word_links(rows, "p_partkey", F.col("words"), t.nation.withColumn("named", names), "n_name", "named").links


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)
 SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.o_totalprice = n.o_totalprice AND o.o_orderstatus = n.o_orderstatus THEN 'same' ELSE 'replaced' END AS change FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def etl_change_set(t):
    """What differs between two versions of the orders."""
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 5 != 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return merges.changes(orders.where("o_orderkey % 7 != 0"), new, ["o_orderkey"])


@query("""WITH o AS (SELECT o_orderkey, o_custkey || '/' || o_orderpriority AS base FROM orders),
 k AS (SELECT o_orderkey, base, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) - 1 AS n FROM o),
 m AS (SELECT o_orderkey, base || CASE WHEN n = 0 THEN '' ELSE '_' || n END AS new FROM k)
 SELECT m.new AS l_orderkey, m.new || '/' || l_linenumber || CASE WHEN row_number() OVER (PARTITION BY m.new, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey) = 1 THEN '' ELSE '_' || (row_number() OVER (PARTITION BY m.new, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey) - 1) END AS l_key, l_partkey FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) JOIN m ON l_orderkey = o_orderkey""")
def dq_cascade(t):
    """Orders get keys of customer and priority, numbered where they collide; their lines' references and keys follow."""
    own = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    lines = own.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("l_key"), "*")
    levels = [merges.Level("orders", "o_orderkey", F.concat_ws("/", "o_custkey", "o_orderpriority"), ["o_orderkey"]), merges.Level("lines", "l_key", F.concat_ws("/", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_partkey", "l_suppkey"])]
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    return merges.cascade({"orders": orders, "lines": lines}, levels, [("lines", "l_orderkey", "orders")]).tables["lines"].select("l_orderkey", "l_key", "l_partkey")


def _unmarked(mark: str, table: str) -> str:
    """SQL that blanks what stands between two marks."""
    return f"""SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 AND i < len(p) THEN regexp_replace(x, '[^\\n]', ' ', 'g') ELSE x END), '  ') AS text FROM (SELECT doc_id, string_split(text, '{mark}') AS p FROM {table})"""


def _named_sql(items: str, found: str) -> str:
    """SQL of what documents name: items (key, name) in, `found` over c (key, name, doc_id, text) out, outside headings, tables' first lines and bold parts."""
    return f"""WITH b AS ({items}),
 s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
 m AS (SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE WHEN regexp_matches(x, '^\\s*#') OR (contains(x, '|') AND NOT (i > 1 AND contains(l[i - 1], '|'))) THEN repeat(' ', length(x)) ELSE x END), chr(10)) AS text FROM s),
 bold AS ({_unmarked("**", "m")}), d AS (SELECT doc_id, text, lower(text) AS low FROM ({_unmarked("__", "bold")})),
 c AS MATERIALIZED (SELECT b.key, name, doc_id, text FROM b, d WHERE contains(low, lower(name)))
 {found} WHERE regexp_matches(text, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])' || name || '($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 'i')"""


@query(_named_sql("SELECT min(item_id) AS key, name FROM (SELECT item_id, regexp_extract(text, '^\\W*(\\w+ \\w+ \\w+)', 1) AS name FROM benchmark) WHERE name <> '' GROUP BY name", "SELECT key AS reference_key, doc_id AS source_key FROM c"))
def xref_passages(t):
    """Which documents name the first three words of a benchmark item outside headings, tables' first lines and bold parts."""
    sources = t.documents.select(F.lit("document").alias("type"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("desc"))
    name = F.regexp_extract("text", r"^\W*(\w+ \w+ \w+)", 1)
    refs = t.benchmark.select(F.lit("item").alias("type"), F.col("item_id").cast("string").alias("key"), name.alias("name")).where("name <> ''").groupBy("type", "name").agg(F.min(F.col("key").cast("long")).cast("string").alias("key"))
    found = linking.links(sources, refs)
    return found.select(F.col("reference_key").cast("long").alias("reference_key"), F.col("source_key").cast("long").alias("source_key"))


@query(_named_sql("SELECT min(key) AS key, arg_min(name, key) AS name FROM (SELECT item_id::VARCHAR AS key, regexp_extract(text, '^\\W*(\\w+ \\w+)', 1) AS name FROM benchmark) WHERE name <> '' GROUP BY lower(name)",
    "SELECT key AS reference_key, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS others, any_value(name) AS anchors, count(*)::INTEGER AS n FROM c") + " GROUP BY key")
def xref_report(t):
    """Which documents name the first two words of each benchmark item, most named first; of items that begin alike the smallest key counts."""
    sources = t.documents.select(F.lit("document").alias("type"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("desc"))
    refs = t.benchmark.select(F.lit("item").alias("type"), F.col("item_id").cast("string").alias("key"), F.regexp_extract("text", r"^\W*(\w+ \w+)", 1).alias("name")).where("name <> ''")
    found = linking.report(linking.links(sources, refs), "reference_key", "source_key")
    return found.select("reference_key", F.array_join("others", ",").alias("others"), F.array_join("anchors", "|").alias("anchors"), "n")


@query("SELECT 'labels' AS \"table\", doc_id::VARCHAR AS key, 'doc_id' AS \"column\", doc_id::VARCHAR AS value FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def dq_fk(t):
    return quality.missing_parents(t.labels, "doc_id", t.documents.where("lang = 'en'"), "doc_id", "labels")


@query("SELECT o_orderkey::VARCHAR AS key, 'o_orderstatus' AS \"column\", o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def dq_enum(t):
    return quality.outside_domain(t.orders, "o_orderkey", {"o_orderstatus": ["O", "F"]})


@query("SELECT p_partkey::VARCHAR AS key, 'p_size' AS \"column\", p_size::DOUBLE AS value FROM part WHERE p_size NOT BETWEEN 5 AND 45 UNION ALL SELECT p_partkey::VARCHAR, 'p_retailprice', p_retailprice FROM part WHERE p_retailprice NOT BETWEEN 950 AND 2000")
def dq_bounds(t):
    return quality.outside_bounds(t.part, "p_partkey", {"p_size": (5, 45), "p_retailprice": (950, 2000)})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_duplicate_key(t):
    return aggregates.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT s_suppkey, s_name, 'Supplier_' || s_suppkey AS expected_key FROM supplier WHERE s_name <> 'Supplier_' || s_suppkey")
def dq_expected_key(t):
    return quality.keys_other_than(t.supplier.select("s_suppkey", "s_name"), "s_name", F.concat(F.lit("Supplier_"), F.col("s_suppkey").cast("string")))


@query("""SELECT doc_id, (i - 1)::INT AS position, trim(part, ' ') AS title FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(CASE WHEN starts_with(text, '## ') THEN chr(10) || substr(text, 4) ELSE text END, chr(10)) AS parts FROM documents))
 WHERE i > 1""")
def etl_split_sections(t):
    """Every line but the first as the heading of a section, and the first if it is a heading itself."""
    marked = t.documents.withColumn("body", F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return texts.sections(marked.select("doc_id", "body"), "body", 2, ["doc_id"]).select("doc_id", "position", "title")


@query("SELECT p_partkey, type, value FROM (SELECT p_partkey, 'brand' AS type, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part UNION ALL SELECT p_partkey, 'kind', p_type FROM part) WHERE value <> ''")
def etl_wide_to_long(t):
    return texts.wide_to_long(t.part, "p_partkey", {"p_brand": "brand", "p_size": "size", "p_type": "kind"}, value="value")
