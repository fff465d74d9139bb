"""A query for each operator over the star-schema tables, and SQL that gives the same rows."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import sinks
from quillgraph.functions import classify, documents
from quillgraph.operators import combine, fixpoint, joins, project, unnest
from quillgraph.plans.catalog import BUCKETS, Catalog, Method, Param
from quillgraph.plans.graph import Beta, Exchange, FormClass, Plan
from quillgraph.plans.lower import compose, compose_all
from quillgraph.sources import tables
from quillgraph.sources.calls import Call, Continuation, call_fields, call_items, call_rows, call_to_json, list_rows, read_call, send_requests
from quillgraph.sources.retry import Rate, RetryPolicy, constant

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def node(sf: str, name: str, *columns: str, **rest) -> Exchange:
    """A table of the folder as an exchange."""
    return Exchange(name, source=lambda spark: t(spark, sf, name, *columns), **rest)


@query("SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def j_left_flatten(spark, sf):
    plan = Plan([node(sf, "orders", "o_orderkey", "o_orderstatus"), node(sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", inputs=("l_orderkey",))], [Beta("orders", "lineitem", "o_orderkey", "l_orderkey")])
    return compose(spark, plan)


@query("SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def j_inner_flatten(spark, sf):
    return joins.inner_flatten(t(spark, sf, "orders", "o_orderkey", "o_orderstatus"), t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), {"l_orderkey": "o_orderkey"}, keys=False)


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.toxic = 1 THEN NULL ELSE 'label' END ELSE d.source END AS source, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j_clash_inner_wins(spark, sf):
    inner = t(spark, sf, "labels", "doc_id", "quality", "toxic").select("doc_id", "quality", F.when(F.col("toxic") != 1, "label").alias("source"))
    return joins.bind_flatten(t(spark, sf, "documents", "doc_id", "source"), inner, {"doc_id": "doc_id"})


@query("SELECT n_nationkey, n_name, s_suppkey, c_custkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_nationkey = n_nationkey")
def j_sibling_product(spark, sf):
    customers = Exchange("customers", ("c_nationkey",), lambda s: t(s, sf, "customer").where("c_acctbal > 5000").select("c_nationkey", "c_custkey"))
    plan = Plan([node(sf, "nation", "n_nationkey", "n_name"), node(sf, "supplier", "s_nationkey", "s_suppkey", inputs=("s_nationkey",)), customers], [Beta("nation", "supplier", "n_nationkey", "s_nationkey"), Beta("nation", "customers", "n_nationkey", "c_nationkey")])
    return compose(spark, plan)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j_unmatched(spark, sf):
    return joins.unmatched(t(spark, sf, "orders", "o_orderkey", "o_totalprice"), t(spark, sf, "lineitem", "l_orderkey"), {"l_orderkey": "o_orderkey"})


@query("SELECT o_orderkey AS in_key, l_orderkey IS NOT NULL AS has_output, l_linenumber AS out_line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def j_tuple(spark, sf):
    pairs = joins.bind_tuple(t(spark, sf, "orders", "o_orderkey", "o_orderstatus"), t(spark, sf, "lineitem", "l_orderkey", "l_linenumber"), {"l_orderkey": "o_orderkey"})
    return pairs.select(F.col("input.o_orderkey").alias("in_key"), F.col("output").isNotNull().alias("has_output"), F.col("output.l_linenumber").alias("out_line"))


@query("SELECT r_name, n_name, s_suppkey, p_token FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey CROSS JOIN (SELECT max(p_partkey) AS p_token FROM part)")
def j_staged_pipeline(spark, sf):
    token = Exchange("token", source=lambda s: t(s, sf, "part").agg(F.max("p_partkey").alias("p_token")))
    plan = Plan(
        [token, node(sf, "region", "r_regionkey", "r_name"), node(sf, "nation", "n_regionkey", "n_nationkey", "n_name", inputs=("n_regionkey",), how="inner"), node(sf, "supplier", "s_nationkey", "s_suppkey", inputs=("s_nationkey",), how="inner")],
        [Beta("region", "nation", "r_regionkey", "n_regionkey"), Beta("nation", "supplier", "n_nationkey", "s_nationkey")],
        egress=[lambda df: df.select("r_name", "n_name", "s_suppkey", "p_token")],
    )
    return compose(spark, plan)


@query("SELECT c_custkey, n_name, total FROM customer JOIN nation ON n_nationkey = c_nationkey CROSS JOIN (SELECT count(*) AS total FROM region)")
def j_scalar_broadcast(spark, sf):
    rows = joins.inner_flatten(t(spark, sf, "customer", "c_custkey", "c_nationkey"), t(spark, sf, "nation", "n_nationkey", "n_name"), {"n_nationkey": "c_nationkey"}, keys=False)
    return joins.with_scalar(rows, t(spark, sf, "region").agg(F.count("*").alias("total"))).drop("c_nationkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN l_shipmax WHEN o_orderstatus = 'O' THEN NULL ELSE -1 END AS answer FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS l_shipmax FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j_status_keyed(spark, sf):
    lines = t(spark, sf, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_shipmax"))
    rows = joins.bind_flatten(t(spark, sf, "orders", "o_orderkey", "o_orderstatus"), lines, {"l_orderkey": "o_orderkey"})
    return rows.select("o_orderkey", project.status_branch(F.col("o_orderstatus"), {"F": F.col("l_shipmax"), "O": F.lit(None)}, F.col("o_orderstatus"), F.lit(-1)).alias("answer"))


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def u_explode(spark, sf):
    return unnest.explode_rows(t(spark, sf, "documents", "doc_id", "text").select("doc_id", F.split("text", "\n").alias("lines")), "lines", "line")


@query("SELECT conv_id, turn, unnest(string_split(line, ' ')) AS word FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)")
def u_nested_carry(spark, sf):
    rows = unnest.explode_rows(t(spark, sf, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.split("text", "\n").alias("lines")), "lines", "line")
    return unnest.explode_rows(rows.select("conv_id", "turn", F.split("line", " ").alias("words")), "words", "word")


@query("SELECT n_nationkey, 'r' || (n_regionkey)::VARCHAR AS role, CASE WHEN k = 'x' THEN 'unknown' ELSE k END AS kind, n_name AS name FROM nation CROSS JOIN (SELECT unnest(['user', 'group', 'x']) AS k)")
def u_member_rows(spark, sf):
    members = F.array(F.concat(F.lit("user:"), "n_name"), F.concat(F.lit("group:"), "n_name"), F.col("n_name"))
    rows = t(spark, sf, "nation").select("n_nationkey", F.array(F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("role"), members.alias("members"))).alias("bindings"))
    return unnest.member_rows(rows).select("n_nationkey", "role", "kind", "name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events")
def p_json_path(spark, sf):
    rows = t(spark, sf, "events", "event_id", "props").withColumn("doc", documents.json_document(F.col("props")))
    return rows.select("event_id", documents.path_value(F.col("doc"), "k", "bigint").alias("k"), documents.path_text(F.col("doc"), "missing").alias("missing"))


@query("SELECT o_orderkey, 'n' || l_linenumber::VARCHAR AS name, l_quantity AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def p_projection(spark, sf):
    lines = t(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name"), F.struct(F.col("l_quantity").alias("q")).alias("size"))).alias("items"))
    bodies = lines.select("l_orderkey", F.parse_json(F.to_json(F.struct(F.struct("items").alias("result")))).alias("doc"))
    rows = joins.inner_flatten(t(spark, sf, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'"), bodies, {"l_orderkey": "o_orderkey"}, keys=False)
    return project.project(rows, "doc", "result.items", {"name": "name", "qty": ("size.q", "double")}, keep=("o_orderkey",))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS state FROM orders")
def p_status_branch(spark, sf):
    return t(spark, sf, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", project.status_branch(F.col("o_orderstatus"), {"O": F.lit("open"), "F": F.lit("done")}, F.col("o_orderstatus"), F.lit("other")).alias("state"))


@query("SELECT p_partkey, p_size, '200' AS status FROM part")
def p_require_ok(spark, sf):
    return project.require_ok(t(spark, sf, "part", "p_partkey", "p_size").withColumns({"status": F.lit("200"), "url": F.lit("http://host/part")})).drop("url")


@query("SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS region, 'tpch' AS provider FROM supplier")
def p_select_const_drop(spark, sf):
    rows = project.drop_columns(t(spark, sf, "supplier"), ["s_acctbal"])
    return project.const_columns(project.select_keys(rows, ["s_suppkey", "s_name", "region"]), {"provider": "tpch"})


@query("SELECT event_id, json_extract_string(props, '$.k') AS k_text, 'events' AS kind FROM events")
def p_extract(spark, sf):
    rows = t(spark, sf, "events", "event_id", "props").withColumn("doc", documents.json_document(F.col("props")))
    return project.extract(rows, F.col("doc"), {"k_text": "k"}, {"kind": "events"}).select("event_id", "k_text", "kind")


@query("SELECT event_id, user_id, 'eu' AS region, CAST(NULL AS VARCHAR) AS org FROM events")
def p_echo(spark, sf):
    return project.echo_inputs(t(spark, sf, "events", "event_id", "user_id"), {"region": "eu", "org": "", "user_id": "clash"})


@query("SELECT c_custkey, 'http://host/c/' || c_custkey::VARCHAR || '?seg=' || c_mktsegment || '&none=' AS url FROM customer")
def p_substitute(spark, sf):
    rows = t(spark, sf, "customer", "c_custkey", "c_mktsegment")
    return rows.select("c_custkey", project.substitute("http://host/c/{c_custkey}?seg={c_mktsegment}&none={absent}", rows.columns).alias("url"))


@query("SELECT p_partkey, upper(p_brand) AS brand FROM part WHERE p_size > 25")
def p_transform_filter(spark, sf):
    return project.transform_rows(t(spark, sf, "part", "p_partkey", "p_brand", "p_size"), {"brand": F.upper("p_brand")}, F.col("p_size") > 25).select("p_partkey", "brand")


@query("SELECT s_suppkey AS id, 'supplier' AS leg FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer UNION ALL SELECT p_partkey, 'part' FROM part")
def m_merge(spark, sf):
    def leg(table: str, key: str) -> Plan:
        return Plan([node(sf, table, key)], egress=[lambda df: df.select(F.col(key).alias("id")), lambda df: project.const_columns(df, {"leg": table})])

    return compose_all(spark, [leg("supplier", "s_suppkey"), leg("customer", "c_custkey"), leg("part", "p_partkey")])


@query("SELECT 25::BIGINT AS n")
def l_budget(spark, sf):
    legs = [t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))]
    return combine.budget(combine.merge(legs), 25).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::BIGINT AS words FROM documents")
def f_words(spark, sf):
    return t(spark, sf, "documents", "doc_id", "text").select("doc_id", classify.word_count(F.col("text")).alias("words"))


@query(r"""SELECT c_custkey, regexp_replace('{"access_token":"' || c_name || '","id":"' || c_custkey::VARCHAR || '"} Bearer «redacted»', '(?i)("[a-z0-9_]*(?:secret|token|password|assertion|credential|private_key)[a-z0-9_]*"\s*:\s*)"[^"]*"', '\1"«redacted»"', 'g') AS line FROM customer""")
def f_redact(spark, sf):
    line = F.concat(F.lit('{"access_token":"'), "c_name", F.lit('","id":"'), F.col("c_custkey").cast("string"), F.lit('"} Bearer abc.DEF-1_2'))
    return t(spark, sf, "customer", "c_custkey", "c_name").select("c_custkey", classify.redact(line).alias("line"))


@query("""
SELECT c_custkey, provider, encryption_class, public, versioning, https FROM (
  SELECT c_custkey, provider,
    CASE WHEN provider = 'aws' THEN CASE WHEN status IN ('', 'none', 'AES256') THEN 'provider-managed' WHEN status LIKE 'aws:kms%' THEN 'customer-managed' ELSE 'unknown' END
      WHEN provider = 'azure' THEN CASE status WHEN 'Microsoft.Storage' THEN 'provider-managed' WHEN 'Microsoft.Keyvault' THEN 'customer-managed' ELSE 'unknown' END
      ELSE CASE WHEN status = '' THEN 'provider-managed' ELSE 'customer-managed' END END AS encryption_class,
    CASE provider WHEN 'aws' THEN sig <> 'true' WHEN 'azure' THEN lower(sig) = 'true' ELSE sig <> 'enforced' END AS public,
    CASE provider WHEN 'aws' THEN sig = 'Enabled' WHEN 'gcp' THEN lower(sig) = 'true' END AS versioning,
    CASE provider WHEN 'azure' THEN lower(sig) = 'true' WHEN 'gcp' THEN true END AS https
  FROM (SELECT c_custkey, ['aws', 'azure', 'gcp'][(c_custkey % 3 + 1)::INT] AS provider,
    ['', 'AES256', 'aws:kms:dsse', 'Microsoft.Storage', 'Microsoft.Keyvault', 'odd'][(c_custkey // 3 % 6 + 1)::INT] AS status,
    ['true', 'True', 'enforced', 'Enabled'][(c_custkey // 18 % 4 + 1)::INT] AS sig FROM customer))
""")
def f_classify(spark, sf):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)
    k = F.col("c_custkey")
    rows = t(spark, sf, "customer", "c_custkey").select(
        "c_custkey", pick(["aws", "azure", "gcp"], k % 3).alias("provider"),
        pick(["", "AES256", "aws:kms:dsse", "Microsoft.Storage", "Microsoft.Keyvault", "odd"], F.floor(k / 3) % 6).alias("status"),
        pick(["true", "True", "enforced", "Enabled"], F.floor(k / 18) % 4).alias("sig"),
    )
    p, sig = F.col("provider"), F.col("sig")
    return rows.select("c_custkey", "provider", classify.key_class(p, F.col("status")).alias("encryption_class"), classify.is_public(p, sig).alias("public"), classify.has_versioning(p, sig).alias("versioning"), classify.only_https(p, sig).alias("https"))


@query("SELECT s_suppkey, s_nationkey::VARCHAR AS scope, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 4 = 0 END AS mfa FROM supplier")
def f_arn_scope(spark, sf):
    rows = t(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("arn:aws:iam::"), F.col("s_nationkey").cast("string"), F.lit(":user/x")).alias("arn"),
        (F.col("s_suppkey") % 2 == 0).alias("mfa_checked"), F.when(F.col("s_suppkey") % 4 == 0, "serial").alias("mfa_serial"),
    )
    return classify.normalise_principals(rows).select("s_suppkey", "scope", "mfa")


@query("SELECT c_custkey, regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]', '-', 'g') AS label FROM customer")
def f_resource_name(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", classify.resource_name(F.concat("c_name", F.lit(" "), "c_mktsegment")).alias("label"))


@query("SELECT p_partkey, p_name AS name, p_size AS size FROM part")
def x_xml(spark, sf):
    name = F.replace(F.replace(F.col("p_name"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("<r><list><item><name>"), name, F.lit("</name><size>"), F.col("p_size").cast("string"), F.lit("</size></item></list></r>")).alias("raw"))
    parsed = rows.select("p_partkey", documents.xml_document(F.col("raw"), "list struct<item: array<struct<name: string, size: int>>>").alias("doc"))
    return unnest.explode_rows(parsed.select("p_partkey", F.col("doc.list.item").alias("items")), "items").select("p_partkey", "item.name", "item.size")


@query("SELECT o_orderkey, 'create' AS redo, 'delete' AS undo, o_custkey::VARCHAR AS held FROM orders")
def k_saga(spark, sf):
    rows = sinks.saga(t(spark, sf, "orders", "o_orderkey", "o_custkey"), "orders", FormClass.CREATE, ["o_orderkey", "o_custkey"])
    return rows.select(F.col("keys.o_orderkey").cast("long").alias("o_orderkey"), "redo", "undo", F.col("keys.o_custkey").alias("held"))


@query("""SELECT r_regionkey, '{"r_regionkey":' || r_regionkey::VARCHAR || ',"r_name":"' || r_name || '","note":null}' AS value FROM region""")
def k_json_lines(spark, sf):
    rows = t(spark, sf, "region", "r_regionkey", "r_name").withColumn("note", F.lit(None).cast("string"))
    return sinks.json_lines(rows).select(F.get_json_object("value", "$.r_regionkey").cast("int").alias("r_regionkey"), "value")


@query("SELECT n_nationkey, n_name FROM nation")
def s_literal(spark, sf):
    rows = [r.asDict() for r in t(spark, sf, "nation", "n_nationkey", "n_name").orderBy("n_nationkey").collect()]
    return tables.literal(spark, rows, "n_nationkey int, n_name string")


EDGES_SQL = "(SELECT c_custkey AS a, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) + 1 AS b FROM customer WHERE c_custkey % 5 <> 0)"


@query(f"WITH RECURSIVE edges AS {EDGES_SQL}, reached AS (SELECT 1::BIGINT AS node UNION SELECT b FROM reached JOIN edges ON a = node) SELECT node FROM reached")
def r_fixpoint(spark, sf):
    n = t(spark, sf, "customer").count()
    edges = t(spark, sf, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("a"), ((F.col("c_custkey") * 7 + 3) % n + 1).alias("b"))
    seed = spark.range(1).select(F.lit(1).cast("long").alias("node"))
    return fixpoint.fixpoint(seed, lambda f: f.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")), ["node"], together=fixpoint.TOGETHER).rows


@query("WITH RECURSIVE tree AS (SELECT 1::BIGINT AS node, 'token' AS token, 0 AS depth UNION ALL SELECT s_suppkey, token, depth + 1 FROM tree JOIN supplier ON (s_suppkey - s_suppkey % 4) // 4 + 1 = node AND s_suppkey > node WHERE depth < 3) SELECT DISTINCT node, token FROM tree")
def r_descent_bounded(spark, sf):
    children = t(spark, sf, "supplier").select((F.floor((F.col("s_suppkey") - F.col("s_suppkey") % 4) / 4) + 1).alias("parent"), F.col("s_suppkey").alias("node")).where("node > parent")
    root = spark.range(1).select(F.lit(1).cast("long").alias("node"), F.lit("token").alias("token"))
    return fixpoint.descend(root, children, ("parent", "node"), "node", carry=["token"], policy=fixpoint.max_iterations(3)).rows


def _recorded(rows: list[dict]) -> str:
    return "\n".join(map(json.dumps, rows))


@query("SELECT n_nationkey, n_name FROM nation")
def x_pages(spark, sf):
    names = [(r["n_nationkey"], r["n_name"]) for r in t(spark, sf, "nation").orderBy("n_nationkey").collect()]
    pages, url = [names[k : k + 10] for k in range(0, len(names), 10)], "http://host/nations"
    rows = [{"url": url + (f"?page={k}" if k else ""), "status": 200, "raw": json.dumps({"items": [{"key": a, "name": b} for a, b in page], "next": str(k + 1) if k + 1 < len(pages) else ""})} for k, page in enumerate(pages)]
    call = Call(url, continuation=Continuation("paginate", "next", "page"), recorded=_recorded(rows), require_ok=True)
    found = read_call(spark, call).withColumn("doc", documents.json_document(F.col("raw")))
    return project.project(found, "doc", "items", {"n_nationkey": ("key", "int"), "n_name": "name"})


@query("SELECT 'DONE' AS state, 3 AS polls")
def x_poll(spark, sf):
    rows = [{"url": "http://host/op", "status": 200, "raw": json.dumps({"status": s, "polls": k})} for k, s in enumerate(["RUNNING", "RUNNING", "DONE"], 1)]
    call = Call("http://host/op", continuation=Continuation("poll", "status", done="DONE", interval=0.0), recorded=_recorded(rows))
    assert call_to_json(call)
    doc = documents.json_document(F.col("raw"))
    return read_call(spark, call).select(documents.path_text(doc, "status").alias("state"), documents.path_value(doc, "polls", "int").alias("polls"))


@query("SELECT n_nationkey, n_name FROM nation")
def x_follow(spark, sf):
    names = [(r["n_nationkey"], r["n_name"]) for r in t(spark, sf, "nation").orderBy("n_nationkey").collect()]
    pages, url = [names[k : k + 7] for k in range(0, len(names), 7)], "http://host/nations"
    address = [url, *[f"http://host/more/{k}" for k in range(1, len(pages))], ""]
    rows = [{"url": address[k], "status": 200, "raw": json.dumps({"value": [{"key": a, "name": b} for a, b in page], "nextLink": address[k + 1]})} for k, page in enumerate(pages)]
    found = read_call(spark, Call(url, continuation=Continuation("follow", "nextLink"), recorded=_recorded(rows)))
    return list_rows(found, "value", {"n_nationkey": ("key", "int"), "n_name": "name"})


@query("SELECT r_regionkey, r_name, '200' AS status FROM region")
def x_single(spark, sf):
    regions = [r.asDict() for r in t(spark, sf, "region", "r_regionkey", "r_name").collect()]
    rows = [{"url": f"http://host/region/{r['r_regionkey']}", "status": 200, "raw": json.dumps(r)} for r in regions]
    found = read_call(spark, Call("http://host/region/{r_regionkey}", recorded=_recorded(rows)), [{"r_regionkey": r["r_regionkey"]} for r in regions])
    doc = documents.json_document(F.col("raw"))
    return found.select(documents.path_value(doc, "r_regionkey", "int").alias("r_regionkey"), documents.path_text(doc, "r_name").alias("r_name"), "status")


@query("SELECT r_regionkey, r_name, n_nationkey::VARCHAR AS nation, n_name AS name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 4 <> 0")
def x_items(spark, sf):
    nations = [r.asDict() for r in t(spark, sf, "nation", "n_regionkey", "n_nationkey", "n_name").where("n_nationkey % 4 <> 0").collect()]
    lists = {k: [{"key": n["n_nationkey"], "at": {"name": n["n_name"]}} for n in nations if n["n_regionkey"] == k] for k in range(5)}
    rows = [{"url": f"http://host/regions/{k}/nations", "status": 200, "raw": json.dumps({"items": items})} for k, items in lists.items()]
    call = Call("http://host/regions/{r_regionkey}/nations", recorded=_recorded(rows))
    return call_items(t(spark, sf, "region", "r_regionkey", "r_name"), call, "items", {"nation": "key", "name": "at.name"}, "left")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'none' ELSE 'closed' END AS answer FROM nation")
def x_fields(spark, sf):
    nations = [(r["n_nationkey"], r["n_name"]) for r in t(spark, sf, "nation").collect()]
    rows = [{"url": f"http://host/nation/{k}", "status": (200, 404, 403)[k % 3], "raw": json.dumps({"a": [{"name": n}]})} for k, n in nations]
    return call_fields(t(spark, sf, "nation", "n_nationkey"), Call("http://host/nation/{n_nationkey}", recorded=_recorded(rows)), {"200": {"answer": "a.name"}}, {"404": {"answer": "none"}}, {"answer": "closed"})


@query("SELECT n_nationkey, '200' AS status, n_name AS body FROM nation")
def x_retry(spark, sf):
    nations = [(r["n_nationkey"], r["n_name"]) for r in t(spark, sf, "nation").collect()]
    rows = [{"url": f"http://host/busy/{k}", "status": s, "raw": n, "headers": {"Retry-After": "0"}} for k, n in nations for s in ([503, 429, 200] if k % 2 else [200])]
    call = Call("http://host/busy/{n_nationkey}", recorded=_recorded(rows), retry=RetryPolicy(3, backoff=constant(0.0), governor=Rate(1000.0, 100)))
    return call_rows(t(spark, sf, "nation", "n_nationkey"), call, {}).select("n_nationkey", "status", F.col("raw").alias("body"))


@query("SELECT 'http://host/send/' || s_suppkey::VARCHAR AS url, '201' AS status, s_name AS raw FROM supplier WHERE s_suppkey <= 50")
def x_send(spark, sf):
    rows = t(spark, sf, "supplier", "s_suppkey", "s_name").where("s_suppkey <= 50")
    held = [{"method": "POST", "url": f"http://host/send/{r['s_suppkey']}", "body": r["s_name"], "status": 201, "raw": r["s_name"]} for r in rows.collect()]
    requests = rows.select(F.lit("POST").alias("method"), F.concat(F.lit("http://host/send/"), F.col("s_suppkey").cast("string")).alias("url"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"), F.col("s_name").alias("body"))
    return send_requests(requests, Call("", recorded=_recorded(held))).select("url", "status", "raw")


@query("SELECT s_suppkey, s_name AS raw, 'raw' AS tag FROM supplier")
def p_response(spark, sf):
    return project.response_columns(t(spark, sf, "supplier", "s_suppkey", "s_name").withColumnRenamed("s_name", "body")).withColumnRenamed("_tag", "tag")


@query("SELECT c_custkey, 2::INTEGER AS n, 'Bearer ' || c_name AS auth, 'json' AS accept FROM customer")
def p_header(spark, sf):
    headers = F.create_map(F.lit("authorization"), F.lit("old"), F.lit("Accept"), F.lit("json"))
    rows = t(spark, sf, "customer", "c_custkey", "c_name").withColumn("request", F.struct(F.lit("http://host/").alias("url"), headers.alias("headers")))
    sent = rows.withColumn("h", project.add_header(F.col("request"), "Authorization", F.concat(F.lit("Bearer "), "c_name"))["headers"])
    return sent.select("c_custkey", F.size("h").alias("n"), F.col("h")["Authorization"].alias("auth"), F.col("h")["Accept"].alias("accept"))


@query("""SELECT '{"key":' || n_nationkey::VARCHAR || ',"name":"' || n_name || '"}' AS value FROM nation""")
def u_list_lines(spark, sf):
    lists = t(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("items"))
    return sinks.list_lines(lists, "items")


@query("""SELECT 'nation: {"n_nationkey":' || n_nationkey::VARCHAR || ',"token":"«redacted»"}' AS value FROM nation""")
def k_log_lines(spark, sf):
    return sinks.log_lines(t(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("token")), "nation")


@query("""SELECT '{"r_regionkey":' || r_regionkey::VARCHAR || ',"r_name":"' || r_name || '"}' AS line FROM region""")
def s_lines(spark, sf):
    path = fixpoint.shared_path(spark, "lines")
    sinks.write_json_lines(t(spark, sf, "region", "r_regionkey", "r_name"), path)
    return tables.lines(spark, path)


@query("SELECT n_nationkey, n_name, 'eu' AS region FROM nation WHERE n_regionkey = 3")
def s_seed(spark, sf):
    plan = Plan([node(sf, "nation", "n_regionkey", "n_nationkey", "n_name", inputs=("n_regionkey",))], inputs={"nation": {"n_regionkey": 3, "region": "eu"}})
    return compose(spark, plan).select("n_nationkey", "n_name", "region")


@query("SELECT * FROM (VALUES ('max_iterations', 6), ('max_emitted', 9), ('any_of', 4), ('all_of', 9), ('deadline', 1)) AS p(policy, node_count) JOIN (SELECT unnest(range(9)) AS node) ON node < node_count")
def r_policies(spark, sf):
    step = lambda f: f.select((F.col("node") + 1).alias("node"))
    clock = iter(range(100))
    policies = {
        "max_iterations": fixpoint.max_iterations(5), "max_emitted": fixpoint.max_emitted(9),
        "any_of": fixpoint.any_of(fixpoint.max_emitted(90), fixpoint.max_iterations(3)),
        "all_of": fixpoint.all_of(fixpoint.max_emitted(9), fixpoint.max_iterations(2)),
        "deadline": fixpoint.deadline(0.5, lambda: next(clock)),
    }
    seed = spark.range(1).withColumnRenamed("id", "node")
    runs = [(name, fixpoint.fixpoint(seed, step, ["node"], policy)) for name, policy in policies.items()]
    return combine.merge([run.rows.select(F.lit(name).alias("policy"), F.lit(sum(run.counts)).alias("node_count"), "node") for name, run in runs])


STORES_SQL = """
SELECT provider, name, encryption_status,
  CASE WHEN name IS NOT NULL THEN CASE provider WHEN 'aws' THEN CASE WHEN encryption_status = 'AES256' THEN 'provider-managed' ELSE 'customer-managed' END
    WHEN 'azure' THEN 'unknown' ELSE 'customer-managed' END END AS encryption_class,
  CASE WHEN name IS NOT NULL THEN CASE provider WHEN 'aws' THEN true WHEN 'azure' THEN container_public <> 'None' ELSE true END END AS public,
  CASE WHEN name IS NOT NULL THEN CASE provider WHEN 'aws' THEN c_custkey % 4 = 0 WHEN 'gcp' THEN false END END AS versioning,
  CASE WHEN name IS NOT NULL AND provider = 'gcp' THEN true END AS https,
  CASE WHEN name IS NOT NULL THEN c_custkey % 5 <> 0 END AS access_logging,
  CASE WHEN name IS NOT NULL AND c_custkey % 5 <> 0 THEN 'log' END AS access_log_target
FROM (SELECT c_custkey, provider, encryption_status, container_public,
    CASE WHEN provider <> 'azure' THEN c_name WHEN c_custkey % 7 <> 0 THEN c_name || '/box' END AS name
  FROM (SELECT c_custkey, c_name, ['aws', 'azure', 'gcp'][(c_custkey % 3 + 1)::INT] AS provider, CASE WHEN c_custkey % 2 = 0 THEN 'AES256' ELSE 'aws:kms' END AS encryption_status,
    CASE WHEN c_custkey % 2 = 0 THEN 'None' ELSE 'Blob' END AS container_public FROM customer))
"""


@query(STORES_SQL)
def f_stores(spark, sf):
    k = F.col("c_custkey")
    rows = t(spark, sf, "customer", "c_custkey", "c_name").select(
        F.element_at(F.array(F.lit("aws"), F.lit("azure"), F.lit("gcp")), (k % 3).cast("int") + 1).alias("provider"), F.col("c_name").alias("name"),
        F.when(k % 2 == 0, "AES256").otherwise("aws:kms").alias("encryption_status"), F.when(k % 4 == 0, "Enabled").alias("versioning"),
        F.when(k % 7 != 0, "box").alias("container"), F.when(k % 2 == 0, "None").otherwise("Blob").alias("container_public"), F.when(k % 5 != 0, "log").alias("access_log_target"),
    )
    return classify.conform(classify.normalise_stores(rows), classify.STORE_SCHEMA)


@query("SELECT s_suppkey, ['user', 'group', 'service_principal', 'unknown'][(s_suppkey % 4 + 1)::INT] AS kind FROM supplier")
def f_principal_kind(spark, sf):
    kinds = F.array(*map(F.lit, ["user", "group", "serviceAccount", ""]))
    return t(spark, sf, "supplier").select("s_suppkey", classify.principal_kind(F.element_at(kinds, (F.col("s_suppkey") % 4).cast("int") + 1)).alias("kind"))


def _catalog(spark, sf) -> Catalog:
    """Two methods over tables of the folder, and a composite of both."""
    def build(table: str, key: str):
        return lambda spark, tables, args: classify.conform(project.const_columns(tables(table).withColumnsRenamed({key: "name"}), {"created": args.get("since")}), BUCKETS)

    out, inputs = Catalog(), (Param("since", True),)
    for name, table, key in (("a", "region", "r_name"), ("b", "nation", "n_name")):
        out.method_map[f"demo.{name}.list"] = Method(f"demo.{name}.list", "demo", table, BUCKETS, inputs, build=build(table, key))
    out.method_map["demo.all.list"] = Method("demo.all.list", "demo", "both", BUCKETS, inputs, members=("demo.a.list", "demo.b.list"))
    return out


CATALOG_SQL = "SELECT name, '2020' AS created, CAST(NULL AS VARCHAR) AS arn, CAST(NULL AS VARCHAR) AS region, '2020' AS since FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation)"


@query(CATALOG_SQL)
def c_composite(spark, sf):
    return _catalog(spark, sf).new(spark, "demo.all.list", lambda name: t(spark, sf, name), {"since": "2020"})


@query(CATALOG_SQL)
def c_merged(spark, sf):
    return _catalog(spark, sf).new_merged(spark, ["demo.a.list", "demo.b.list"], lambda name: t(spark, sf, name), {"since": "2020"})


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey")
def b_stream_enrich(spark, sf):
    from quillgraph.streaming.operators import drain, enrich

    # a pattern, as a stream takes a plain path only of a folder; it matches a file and a folder of files alike
    stream = spark.readStream.schema(t(spark, sf, "orders").schema).parquet(f"{sf}/orders.parque[t]").select("o_orderkey", "o_custkey")
    table = t(spark, sf, "customer", "c_custkey", "c_name").where("c_custkey % 2 = 0")
    return drain(enrich(stream, table, {"c_custkey": "o_custkey"}).select("o_orderkey", "c_name"), "b_stream_enrich_" + os.urandom(4).hex())


@query("SELECT 20::BIGINT AS n")
def b_take_k(spark, sf):
    from quillgraph.streaming.operators import take

    stream = spark.readStream.format("rate").option("rowsPerSecond", 200).load()
    return spark.createDataFrame([(len(take(stream, 20)),)], "n long")
