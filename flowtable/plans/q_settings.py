"""Queries: inventories, nested references, parameters, settings, sizing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtable.functions.nested import explode_refs, file_ref
from flowtable.operators import catalog as c
from flowtable.operators import incremental as inc
from flowtable.operators import overlay as o
from flowtable.operators import params as p
from flowtable.operators import sizing as s
from flowtable.operators import tasks as t
from flowtable.plans import model as m
from flowtable.plans.registry import query

_FILES_SQL = """WITH u AS (SELECT DISTINCT url AS path FROM pages),
f AS (SELECT path, split_part(path, '/', -1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM u),
g AS (SELECT *, split_part(name, '.', 1) AS stem,
  CASE WHEN strpos(name, '.') > 0 THEN substr(name, strpos(name, '.') + 1) ELSE '' END AS ext FROM f)"""


@query(
    "file_catalog",
    _FILES_SQL
    + """ SELECT 'dir' AS kind, dir AS key, count(*) AS files FROM g GROUP BY dir
UNION ALL SELECT 'ext', ext, count(*) FROM g GROUP BY ext""",
)
def file_catalog(spark, sf):
    return c.file_catalog(m.table(spark, sf, "pages"), "url")


@query(
    "stem_collisions",
    _FILES_SQL
    + " SELECT stem, count(*) AS files, min(path) AS first, max(path) AS last FROM g GROUP BY stem HAVING count(*) > 1",
)
def stem_collisions(spark, sf):
    return c.stem_collisions(m.table(spark, sf, "pages"), "url")


@query(
    "object_inventory",
    """WITH u AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN url ELSE regexp_replace(url, '^https?', 'gs') END AS url FROM pages)
SELECT regexp_extract(url, 'gs://(.*?)/(.*)', 1) AS bucket, count(*) AS objects, count(*) AS round_trips
FROM u WHERE regexp_matches(url, 'gs://(.*?)/(.*)') GROUP BY 1
UNION ALL SELECT NULL, count(*), 0 FROM u WHERE NOT regexp_matches(url, 'gs://(.*?)/(.*)') HAVING count(*) > 0""",
)
def object_inventory(spark, sf):
    url = F.when(F.col("page_id") % 10 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?", "gs"))
    return c.object_inventory(m.table(spark, sf, "pages").select("page_id", url.alias("url")), "url")


@query(
    "relative_manifest",
    """SELECT DISTINCT substr(path, 7) AS path FROM (SELECT regexp_replace(url, '^https://', '/data/') AS path FROM pages)
WHERE starts_with(path, '/data/') AND NOT ends_with(path, '/')""",
)
def relative_manifest(spark, sf):
    listing = m.table(spark, sf, "pages").select(F.regexp_replace("url", "^https://", "/data/").alias("path"))
    return inc.to_manifest(listing, "/data")


@query(
    "normalize_resources",
    """WITH r AS (SELECT p_brand AS task, p_partkey % 13 = 0 AS bad_cap, p_partkey % 17 = 0 AS bad_par,
    CAST(floor(p_retailprice) AS BIGINT) * 1048576 AS bytes, CAST(p_size AS BIGINT) * 60000 AS ms,
    CASE WHEN p_partkey % 3 = 0 THEN 262144 ELSE p_size END AS slots FROM part)
SELECT task, 'ok' AS kind, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS total_bytes, max(bytes) AS max_bytes, CAST(sum(ms) AS BIGINT) AS total_ms,
  CAST(max(slots) AS INTEGER) AS max_slots FROM r WHERE NOT bad_cap AND NOT bad_par GROUP BY task
UNION ALL SELECT task, concat_ws(',', CASE WHEN bad_cap THEN 'capacity' END, CASE WHEN bad_par THEN 'parallelism' END), count(*), NULL, NULL, NULL, NULL
FROM r WHERE bad_cap OR bad_par GROUP BY ALL""",
)
def normalize_resources(spark, sf):
    key = F.col("p_partkey")
    number = F.floor("p_retailprice").cast("string")
    requests = m.table(spark, sf, "part").select(
        F.col("p_brand").alias("task"),
        F.when(key % 13 == 0, F.concat(number, F.lit(" parsecs"))).otherwise(F.concat(number, F.lit(" mb"))).alias("capacity"),
        F.col("p_size").alias("minutes"),
        F.when(key % 17 == 0, "some").when(key % 3 == 0, "Unlimited").otherwise(F.col("p_size").cast("string")).alias("parallelism"),
    )
    return c.resource_totals(c.normalize_resources(requests, "capacity", "minutes", "minutes", "parallelism"), "task")


@query(
    "key_normalize",
    """WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 1 THEN replace(p_name, ' ', '_') ELSE p_name END AS name FROM part
  UNION SELECT DISTINCT n_name FROM nation),
k AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '-', 'g') AS key FROM n)
SELECT * FROM (SELECT key, name, count(*) OVER (PARTITION BY key) AS n FROM k) WHERE n > 1""",
)
def key_normalize(spark, sf):
    name = F.when(F.col("p_partkey") % 2 == 1, F.regexp_replace("p_name", " ", "_")).otherwise(F.col("p_name"))
    names = m.table(spark, sf, "part").select(name.alias("name"))
    return c.key_collisions(names.unionByName(m.table(spark, sf, "nation").select(F.col("n_name").alias("name"))), "name")


@query(
    "collect_refs",
    """WITH r AS (
  SELECT 'output' AS kind, 'part/' || l_partkey AS path, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem
  UNION SELECT 'output', 'order/' || (l_orderkey // 100), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem
  UNION ALL SELECT 'input', 'supplier/' || l_suppkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem WHERE l_suppkey % 2 = 0
  UNION ALL SELECT 'directory', 'dir/' || l_linenumber, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem)
SELECT kind, path, count(*) AS items FROM r GROUP BY ALL""",
)
def collect_refs_query(spark, sf):
    part = F.concat(F.lit("part/"), F.col("l_partkey").cast("string"))
    group = F.concat(F.lit("order/"), F.expr("l_orderkey div 100").cast("string"))
    supplier = F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string"))
    folder = F.concat(F.lit("dir/"), F.col("l_linenumber").cast("string"))
    # The part appears twice, and the map key looks like a path but is no reference.
    value = F.struct(
        file_ref("output", part).alias("main"),
        F.col("l_quantity").alias("quantity"),
        F.array(F.struct(file_ref("output", part).alias("file"), F.lit(1).alias("n"))).alias("parts"),
        F.create_map(F.lit("key/not-a-file"), file_ref("output", group)).alias("by_name"),
        F.when(F.col("l_suppkey") % 2 == 0, file_ref("gs", supplier)).alias("source"),
        F.struct(file_ref("directory", folder).alias("dir")).alias("deep"),
    )
    items = m.table(spark, sf, "lineitem").select(value.alias("value"))
    refs = explode_refs(items, "value")
    return refs.groupBy(F.col("class").alias("kind"), "path").agg(F.count(F.lit(1)).alias("items"))


PARAMS = T.StructType(
    [
        T.StructField("k", T.IntegerType()),
        T.StructField("withDefault", T.StringType()),
        T.StructField("complexValue", T.StructType([T.StructField("intValue", T.IntegerType()), T.StructField("doubleValue", T.DoubleType())])),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("runMode", T.StringType()),
    ]
)


@query(
    "param_bind",
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 44 <> 3 AS good FROM events)
SELECT event_id, CASE WHEN good THEN k END AS k,
  CASE WHEN NOT good THEN NULL WHEN event_id % 2 = 0 THEN event_type ELSE 'default' END AS with_default,
  CASE WHEN good AND event_id % 3 = 0 THEN k + 1 END AS int_value,
  CASE WHEN good AND event_id % 3 = 0 THEN 2.5::DOUBLE END AS double_value,
  CASE WHEN good AND event_id % 5 = 0 THEN 'a,' || event_type ELSE '' END AS tags,
  CASE WHEN good AND event_id % 7 = 0 THEN event_type END AS extra_text,
  CASE WHEN good AND event_id % 4 = 1 THEN 'Fast' WHEN good AND event_id % 4 = 2 THEN 'careful' END AS run_mode,
  CASE WHEN event_id % 19 = 0 THEN 'malformed' ELSE concat_ws(',', CASE WHEN event_id % 17 = 0 THEN 'k is missing' END,
    CASE WHEN event_id % 44 = 3 THEN 'runMode is none of Fast, careful' END) END AS violations
FROM e""",
)
def param_bind(spark, sf):
    i = F.col("event_id")
    piece = lambda cond, text: F.when(cond, text)
    k = m.event_k().cast("string")
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    fields = F.concat_ws(
        ", ",
        piece(i % 17 != 0, F.concat(F.lit('"k": '), k)),
        piece(i % 2 == 0, F.concat(F.lit('"with-default": '), quoted)),
        piece(i % 3 == 0, F.concat(F.lit('"complex-value": {"int-value": '), (m.event_k() + 1).cast("string"), F.lit("}"))),
        piece(i % 5 == 0, F.concat(F.lit('"tags": ["a", '), quoted, F.lit("]"))),
        piece(i % 7 == 0, F.concat(F.lit('"extra": {"text": '), quoted, F.lit("}"))),
        piece(i % 4 == 1, F.lit('"run-mode": "FAST"')),
        piece(i % 4 == 2, F.lit('"run-mode": "Careful"')),
        piece(i % 44 == 3, F.lit('"run-mode": "odd"')),
    )
    json = F.when(i % 19 == 0, F.concat(F.lit("{"), fields)).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    rows = m.table(spark, sf, "events").select("event_id", json.alias("json"))
    bound = p.bound_params(
        rows, "json", PARAMS, defaults={"withDefault": "default", "complexValue.doubleValue": 2.5}, required=["k"],
        enums={"runMode": ["Fast", "careful"]},
    )
    v = F.when(F.size("violations") == 0, F.col("params"))
    return bound.select(
        "event_id", v["k"].alias("k"), v["withDefault"].alias("with_default"),
        v["complexValue"]["intValue"].alias("int_value"), v["complexValue"]["doubleValue"].alias("double_value"),
        F.concat_ws(",", F.coalesce(v["tags"], F.array())).alias("tags"),
        v["extra"]["text"].alias("extra_text"), v["runMode"].alias("run_mode"), F.concat_ws(",", "violations").alias("violations"),
    )


SHAPES = {
    "page": T.StructType([T.StructField("pageUrl", T.StringType()), T.StructField("size", T.LongType())]),
    "number": T.StructType([T.StructField("value", T.LongType())]),
}


@query(
    "param_variant",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'number' ELSE 'other' END AS type,
  CASE WHEN page_id % 3 = 0 THEN url END AS page_url, CASE WHEN page_id % 3 = 0 THEN CAST(length(html) AS BIGINT) END AS size,
  CASE WHEN page_id % 3 = 1 THEN page_id END AS value, CASE WHEN page_id % 3 = 2 THEN 'unknown type' END AS violation FROM pages""",
)
def param_variant(spark, sf):
    i = F.col("page_id")
    opts = {"ignoreNullFields": "false"}
    as_page = F.to_json(F.struct(F.lit("page").alias("-type"), F.col("url").alias("page-url"), F.length("html").alias("size")), opts)
    as_number = F.to_json(F.struct(F.lit("number").alias("-type"), i.alias("value")), opts)
    json = F.when(i % 3 == 0, as_page).when(i % 3 == 1, as_number).otherwise(F.lit('{"-type": "other", "value": 1}'))
    bound = p.bind_variant(m.table(spark, sf, "pages").select("page_id", json.alias("json")), "json", SHAPES)
    v = F.col("params")
    return bound.select(
        "page_id", v["type"].alias("type"), v["page"]["pageUrl"].alias("page_url"), v["page"]["size"].alias("size"),
        v["number"]["value"].alias("value"), "violation",
    )


@query(
    "overlay",
    f"""WITH {m.SETTINGS_SQL}, leaf AS (
  SELECT m.name, s.path, s.value, m.rank * 1000000000 + CASE WHEN m.rank = 2 THEN m.seq ELSE 0 END AS prio
  FROM matched m JOIN settings s ON m.key = s.key)
SELECT name, path, value FROM leaf a WHERE NOT EXISTS (SELECT 1 FROM leaf b WHERE b.name = a.name AND b.prio > a.prio
  AND (b.path = a.path OR starts_with(b.path, a.path || '.') OR starts_with(a.path, b.path || '.')))""",
)
def overlay(spark, sf):
    customers = m.table(spark, sf, "customer")
    return o.overlay(m.entities(customers), m.settings(customers))


@query(
    "overlay_unmatched",
    f"WITH {m.SETTINGS_SQL} SELECT DISTINCT key FROM settings WHERE key NOT IN (SELECT key FROM entity_keys)",
)
def overlay_unmatched(spark, sf):
    customers = m.table(spark, sf, "customer")
    return o.unmatched_settings(m.entities(customers), m.settings(customers))


@query(
    "overlay_match",
    f"""WITH {m.SETTINGS_SQL} SELECT name, key, CASE rank WHEN 0 THEN 'default' WHEN 1 THEN 'name' ELSE 'label' END AS layer,
  CAST(seq AS BIGINT) AS seq FROM matched""",
)
def overlay_match(spark, sf):
    customers = m.table(spark, sf, "customer")
    return o.match_layers(m.entities(customers), m.settings(customers))


@query("name_unique", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def name_unique(spark, sf):
    return t.duplicate_names(m.table(spark, sf, "part").select(F.col("p_name").alias("name")), "name")


@query(
    "import_merge",
    """WITH a AS (SELECT c_name AS name, 'own' AS origin FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_name AS name, 'imported' AS origin FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE name NOT IN (SELECT name FROM b)""",
)
def import_merge(spark, sf):
    customers = m.table(spark, sf, "customer")
    side = lambda cond, origin: customers.where(cond).select(F.col("c_name").alias("name"), F.lit(origin).alias("origin"))
    return t.import_merge(side("c_custkey % 3 <> 0", "own"), side("c_custkey % 2 = 0", "imported"), "name")


_TIERS_SQL = """tiers AS (SELECT class, prefix, cpus, CAST(gb * 1073741824 AS BIGINT) AS memory FROM (VALUES
  ('STANDARD', 'n1-standard', 1, 3.75), ('STANDARD', 'n1-standard', 2, 7.5), ('STANDARD', 'n1-standard', 4, 15),
  ('STANDARD', 'n1-standard', 8, 50), ('STANDARD', 'n1-standard', 16, 60), ('STANDARD', 'n1-standard', 32, 120),
  ('STANDARD', 'n1-standard', 64, 240), ('STANDARD', 'n1-standard', 96, 360),
  ('HIGHMEM', 'n1-highmem', 2, 13), ('HIGHMEM', 'n1-highmem', 4, 26), ('HIGHMEM', 'n1-highmem', 8, 52),
  ('HIGHMEM', 'n1-highmem', 16, 104), ('HIGHMEM', 'n1-highmem', 32, 208), ('HIGHMEM', 'n1-highmem', 64, 416),
  ('HIGHMEM', 'n1-highmem', 96, 624),
  ('HIGHCPU', 'n1-highcpu', 2, 1.8), ('HIGHCPU', 'n1-highcpu', 4, 3.6), ('HIGHCPU', 'n1-highcpu', 8, 7.2),
  ('HIGHCPU', 'n1-highcpu', 16, 14.4), ('HIGHCPU', 'n1-highcpu', 32, 28.8), ('HIGHCPU', 'n1-highcpu', 64, 57.6),
  ('HIGHCPU', 'n1-highcpu', 96, 86.4),
  ('ULTRAMEM', 'n1-ultramem', 40, 961), ('ULTRAMEM', 'n1-ultramem', 80, 1922), ('ULTRAMEM', 'n1-ultramem', 160, 3844)
) t(class, prefix, cpus, gb))"""


@query(
    "size_plan",
    f"""WITH {_TIERS_SQL}, r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'HIGHMEM' WHEN 1 THEN 'HIGHCPU' WHEN 2 THEN 'ULTRAMEM' ELSE 'STANDARD' END AS class,
    CASE WHEN p_partkey % 11 <> 0 THEN p_size * 3 END AS cpus, CASE WHEN p_partkey % 6 <> 0 THEN CAST(floor(p_retailprice) / 10 * 1073741824 AS BIGINT) END AS memory,
    CASE WHEN p_partkey % 50 = 3 THEN 'special-1' END AS fixed FROM part),
q AS (SELECT p_partkey, fixed, any_value(t.prefix) AS prefix,
    coalesce(CASE WHEN r.cpus IS NULL THEN min(t.cpus) END, min(CASE WHEN r.cpus <= t.cpus THEN t.cpus END), max(t.cpus)) AS c1,
    coalesce(CASE WHEN r.memory IS NULL THEN min(t.cpus) END, min(CASE WHEN r.memory <= t.memory THEN t.cpus END), max(t.cpus)) AS c2
  FROM r JOIN tiers t ON r.class = t.class GROUP BY p_partkey, fixed, r.cpus, r.memory)
SELECT coalesce(fixed, prefix || '-' || greatest(c1, c2)) AS machine, count(*) AS n FROM q GROUP BY 1""",
)
def size_plan(spark, sf):
    key = F.col("p_partkey")
    cls = F.when(key % 5 == 0, "HIGHMEM").when(key % 5 == 1, "HIGHCPU").when(key % 5 == 2, "ULTRAMEM")
    batches = m.table(spark, sf, "part").select(
        cls.alias("machine_class"),
        F.when(key % 11 != 0, F.col("p_size") * 3).alias("cpus"),
        F.when(key % 6 != 0, _gigabytes_tenth()).alias("memory"),
        F.when(key % 50 == 3, "special-1").alias("machine_type"),
    )
    return s.size_plan(batches)


def _gigabytes_tenth():
    return (F.floor("p_retailprice") / 10 * F.lit(1073741824)).cast("bigint")


@query(
    "size_plan_custom",
    f"""WITH {_TIERS_SQL}, r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS cpus,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(floor(p_retailprice) / 10 * 1073741824 AS BIGINT) END AS mem,
    CASE WHEN p_partkey % 5 <> 0 THEN CAST((p_partkey % 9) * 1073741824 AS BIGINT) END AS per FROM part),
e AS (SELECT *, CASE WHEN cpus > 1 AND cpus % 2 = 1 THEN cpus + 1 ELSE cpus END AS even,
    greatest(least(per, 6979321856), 966367641) AS ratio FROM r),
f AS (SELECT *, CASE WHEN per IS NOT NULL THEN mem // ratio END AS raw FROM e),
g AS (SELECT *, coalesce(even, CASE WHEN raw > 1 AND raw % 2 = 1 THEN raw + 1 ELSE raw END) AS c,
    coalesce(mem, even * CASE WHEN per IS NOT NULL THEN ratio END) AS mm FROM f),
h AS (SELECT *, CASE WHEN mm / c < 966367641 THEN c * 966367641 WHEN mm / c >= 6979321857 THEN c * 6979321856 ELSE mm END AS fit FROM g),
k AS (SELECT h.*, (SELECT coalesce(min(CASE WHEN h.even <= t.cpus THEN t.cpus END), 96) FROM tiers t WHERE class = 'STANDARD') AS c1,
    (SELECT coalesce(min(CASE WHEN h.mem <= t.memory THEN t.cpus END), 96) FROM tiers t WHERE class = 'STANDARD') AS c2 FROM h)
SELECT CASE WHEN cpus IS NULL AND mem IS NULL THEN 'n1-standard-1'
    WHEN (cpus IS NULL OR mem IS NULL) AND per IS NULL THEN 'n1-standard-' || CASE WHEN cpus IS NULL THEN c2 ELSE c1 END
    ELSE 'custom-' || c || '-' || CAST(floor(fit / 1048576 + 0.5::DOUBLE) AS BIGINT) END AS machine, count(*) AS n
FROM k GROUP BY 1""",
)
def size_plan_custom(spark, sf):
    key = F.col("p_partkey")
    batches = m.table(spark, sf, "part").select(
        F.when(key % 3 != 0, F.col("p_size")).alias("cpus"),
        F.when(key % 4 != 0, _gigabytes_tenth()).alias("memory"),
        F.when(key % 5 != 0, (key % 9) * F.lit(1073741824)).alias("mem_per_cpu"),
    )
    return s.size_plan_custom(batches)
