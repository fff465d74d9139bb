"""Planner, joins, projections, unnesting, fixpoint, sinks and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph import sinks
from quillgraph.functions import classify, documents
from quillgraph.operators import combine, fixpoint, joins, project, unnest
from quillgraph.plans.graph import Alpha, Beta, Exchange, FormClass, Plan, PlanError, order, run_dag, validate
from quillgraph.plans.lower import compose, compose_all
from quillgraph.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lit(rows_, schema):
    return lambda spark: tables.literal(spark, rows_, schema)


OUTER = lit([{"name": "alpha", "region": "us-east-1"}, {"name": "beta", "region": "us-west-2"}], "name string, region string")
INNER = lit([{"name": "alpha", "algorithm": "AES256", "region": None}], "name string, algorithm string, region string")


def test_left_keeps_unmatched_and_inner_wins(spark):
    assert rows(joins.bind_flatten(OUTER(spark), INNER(spark), {"name": "name"})) == [("alpha", None, "AES256"), ("beta", "us-west-2", None)]
    assert rows(joins.inner_flatten(OUTER(spark), INNER(spark), {"name": "name"})) == [("alpha", None, "AES256")]
    pairs = {r["input"]["name"]: r["output"] for r in joins.bind_tuple(OUTER(spark), INNER(spark), {"name": "name"}).collect()}
    assert pairs["beta"] is None and pairs["alpha"]["algorithm"] == "AES256"
    assert rows(joins.unmatched(OUTER(spark), INNER(spark), {"name": "name"})) == [("beta", "us-west-2")]


def test_scalar_needs_one_row(spark):
    assert rows(joins.with_scalar(OUTER(spark), tables.literal(spark, [{"token": "t"}], "token string")).select("name", "token")) == [("alpha", "t"), ("beta", "t")]
    with pytest.raises(Exception, match="expected one row"):
        joins.with_scalar(OUTER(spark), tables.literal(spark, [{"token": "t"}, {"token": "u"}], "token string")).collect()


def test_validation():
    a, b = Exchange("a", source=OUTER), Exchange("b", ("name",), INNER)
    with pytest.raises(PlanError, match="neither an edge nor a value"):
        validate(Plan([a, b]))
    with pytest.raises(PlanError, match="neither"):
        validate(Plan([b], inputs={"b": {"name": ""}}))
    assert validate(Plan([b, a], [Beta("a", "b", "name", "name")])) == ["a", "b"]
    with pytest.raises(PlanError, match="cycle"):
        order(Plan([a, b], [Beta("a", "b", "name", "name"), Beta("b", "a", "x", "y")]))
    with pytest.raises(PlanError, match="undeclared"):
        order(Plan([a], [Beta("a", "zz", "name", "name")]))
    with pytest.raises(PlanError, match="declared twice"):
        order(Plan([a, a]))
    with pytest.raises(PlanError, match="bound twice"):
        order(Plan([a, b], [Beta("a", "b", "name", "name"), Beta("a", "b", "region", "name")]))
    assert str(Beta("a", "b", "x", "y")) == "beta(x→y)" and Plan([a, b], alphas=[Alpha("a", "b", 0.1)]).delay("b") == 0.1


def test_siblings_multiply_and_inputs_filter(spark):
    users = Exchange("users", ("account",), lit([{"user": "u", "account": "1"}, {"user": "v", "account": "1"}, {"user": "w", "account": "2"}], "user string, account string"))
    policies = Exchange("policies", ("user",), lit([{"user": "u", "policy": "p1"}, {"user": "u", "policy": "p2"}], "user string, policy string"))
    devices = Exchange("devices", ("user",), lit([{"user": "u", "device": "d1"}, {"user": "u", "device": "d2"}], "user string, device string"))
    plan = Plan([users, policies, devices], [Beta("users", "policies", "user", "user"), Beta("users", "devices", "user", "user")], inputs={"users": {"account": "1"}}, egress=[lambda df: df.drop("account")])
    assert rows(compose(spark, plan)) == [("u", "p1", "d1"), ("u", "p1", "d2"), ("u", "p2", "d1"), ("u", "p2", "d2"), ("v", None, None)]
    assert compose_all(spark, [plan, plan], 3).count() == 3 and compose_all(spark, [plan, plan]).count() == 10


def test_plan_has_no_needless_shuffle(spark, tmp_path):
    spark.range(1000).selectExpr("id k", "id v", "id w").write.parquet(str(tmp_path / "t"))
    read = lambda s: s.read.parquet(str(tmp_path / "t"))
    df = joins.bind_flatten(read(spark), read(spark).select("k", F.col("v").alias("x")), {"k": "k"}, keys=False).select("x").where("x > 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint,v:bigint>" in plan and "w#" not in plan.split("ReadSchema")[1][:40]


def test_projection(spark):
    body = json.dumps({"result": {"items": [{"a": 1, "b": {"c": "x"}}, "skipped", {"b": {"c": None}}]}, "one": {"a": 5}})
    df = tables.literal(spark, [{"raw": body}], "raw string").withColumn("doc", documents.json_document(F.col("raw")))
    assert rows(project.project(df, "doc", "result.items", {"a": ("a", "bigint"), "c": "b.c"})) == [(1, "x"), (None, None)]
    assert rows(project.project(df, "doc", "one", {"a": ("a", "bigint")})) == [(5,)] and project.project(df, "doc", "none", {"a": "a"}).count() == 0
    got = df.select(documents.path_text(F.col("doc"), "result.items.b.c").alias("c"), documents.path_text(F.col("doc"), "x.y").alias("m")).first()
    assert tuple(got) == ("x", "")
    with pytest.raises(Exception):  # noqa: B017
        tables.literal(spark, [{"raw": "{"}], "raw string").select(documents.json_document(F.col("raw"))).collect()


def test_columns(spark):
    df = tables.literal(spark, [{"a": "1", "b": "2"}], "a string, b string")
    assert rows(project.select_keys(df, ["b", "c"])) == [("2", None)]
    assert rows(project.const_columns(df, {"a": "9"})) == [("9", "2")]
    echoed = project.echo_inputs(df, {"a": "clash", "r": "eu", "o": ""})
    assert rows(echoed) == [("1", "2", "eu", None)] and echoed.schema["r"].metadata == {"input": True}
    assert rows(df.select(project.substitute("{a}/{zz}-{b}", df.columns))) == [("1/-2",)]
    doc = df.withColumn("doc", F.parse_json(F.lit('{"x": {"y": ["first", "second"]}, "n": 3}')))
    out = project.extract(doc, F.col("doc"), {"nested.y": "x.y", "n": "n", "b": "missing"}, {"lit": "l"}).first()
    assert out["nested"]["y"] == "first" and out["n"] == "3" and out["b"] == "2" and out["lit"] == "l"
    request = df.select(F.struct(F.create_map(F.lit("x"), F.lit("1")).alias("headers")).alias("r")).select(project.add_header(F.col("r"), "X", "2").alias("r")).first()
    assert request["r"]["headers"] == {"X": "2"}


def test_status(spark):
    df = tables.literal(spark, [{"status": "200", "raw": "ok"}, {"status": "404", "raw": "no"}], "status string, raw string")
    branch = lambda default=None: project.status_branch(F.col("status"), {"200": F.lit("yes"), "404": F.lit("none")}, F.col("raw"), default)
    assert rows(df.select(branch())) == [("none",), ("yes",)]
    other = tables.literal(spark, [{"status": "500", "raw": "boom"}], "status string, raw string")
    assert rows(other.select(branch(F.lit("d")))) == [("d",)]
    with pytest.raises(Exception, match="500.*boom"):
        other.select(branch()).collect()
    with pytest.raises(Exception, match="http://h/x"):
        project.require_ok(other.withColumn("url", F.lit("http://h/x"))).collect()
    assert project.require_ok(df.where("status = '200'").withColumn("url", F.lit(""))).count() == 1


def test_unnest(spark):
    df = spark.sql("select 1 k, parse_json('[{\"name\":\"a\"}, 3, {\"name\":\"b\"}]') d union all select 2, parse_json('{}') union all select 3, parse_json('[]')")
    out = unnest.explode_objects(df, "d").select("k", F.expr("variant_get(row, '$.name', 'string')"))
    assert rows(out) == [(1, "a"), (1, "b")]
    members = spark.sql("select 'p' project, array(named_struct('role','r','members',array('user:a:b','group:g','plain'))) bindings")
    assert rows(unnest.member_rows(members).select("role", "kind", "name")) == [("r", "group", "g"), ("r", "unknown", "plain"), ("r", "user", "a:b")]


def test_xml(spark):
    one = "<R xmlns='http://x/'><L><I><N>a</N></I></L></R>"
    two = "<R><L><I><N>a</N></I><I><N>b</N></I></L></R>"
    df = tables.literal(spark, [{"raw": one}, {"raw": two}, {"raw": ""}], "raw string")
    got = df.select(documents.xml_document(F.col("raw"), "L struct<I: array<struct<N: string>>>").alias("d")).select(F.size("d.L.I")).collect()
    assert sorted(r[0] for r in got if r[0] and r[0] > 0) == [1, 2]
    assert documents.decode_xml(two) == {"R": {"L": {"I": [{"N": "a"}, {"N": "b"}]}}} and documents.decode_xml("") is None


def test_fixpoint(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "a long, b long")
    step = lambda f: f.join(edges, f.n == edges.a).select(F.col("b").alias("n"))
    out = fixpoint.fixpoint(spark.range(1).select(F.col("id").alias("n")), step, ["n"])
    assert rows(out.rows) == [(0,), (1,), (2,), (3,)] and out.iterations == 3 and out.reason == "fixpoint"
    endless = fixpoint.fixpoint(spark.range(1).select(F.col("id").alias("n")), lambda f: f.select((F.col("n") + 1).alias("n")), ["n"], fixpoint.max_iterations(5))
    assert len(rows(endless.rows)) == 6 and endless.iterations == 5 and endless.reason == "terminated"
    loop = fixpoint.descend(spark.createDataFrame([("root", "t")], "node string, token string"), spark.createDataFrame([("root", "a"), ("a", "root")], "parent string, node string"), ("parent", "node"), "node", carry=["token"])
    assert rows(loop.rows) == [("a", "t"), ("root", "t")] and loop.reason == "fixpoint"


@pytest.mark.parametrize("together", [1, 3])
def test_rounds_of_one_job(spark, together):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (3, 4), (4, None)], "a long, b long")
    step = lambda f: f.join(edges, f.n == edges.a).select(F.col("b").cast("int").alias("n"), F.col("gone"))
    seed = spark.range(1).select(F.col("id").alias("n"), F.lit(None).alias("gone"))
    out = fixpoint.fixpoint(seed, step, ["n"], together=together)
    assert out.counts == [1, 2, 1, 1, 1, 0] and out.iterations == 5 and out.reason == "fixpoint"
    assert sorted((r["n"] is None, r["n"] or 0) for r in out.rows.collect()) == [(False, 0), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    for policy, counts in ((fixpoint.max_iterations(2), [1, 2, 1]), (fixpoint.max_emitted(3), [1, 2]), (fixpoint.max_iterations(4), [1, 2, 1, 1, 1])):
        cut = fixpoint.fixpoint(seed, step, ["n"], policy, together)
        assert cut.counts == counts and cut.rows.count() == sum(counts) and cut.reason == "terminated"


def test_policies():
    p = fixpoint.Progress(3, 10)
    assert fixpoint.max_iterations(3)(p) and not fixpoint.max_iterations(4)(p) and fixpoint.max_emitted(10)(p)
    assert not fixpoint.any_of()(p) and not fixpoint.all_of()(p)
    assert fixpoint.any_of(fixpoint.max_iterations(9), fixpoint.max_emitted(1))(p) and not fixpoint.all_of(fixpoint.max_iterations(9), fixpoint.max_emitted(1))(p)
    now = [0.0]
    late = fixpoint.deadline(5, lambda: now[0])
    assert not late(p)
    now[0] = 6.0
    assert late(p)


def test_merge_and_budget(spark):
    legs = [tables.literal(spark, [{"name": n} for n in x], "name string") for x in ("ab", "c", "de")]
    assert combine.merge(legs).count() == 5 and combine.budget(combine.merge(legs), 3).count() == 3 and combine.budget(combine.merge(legs), 0).count() == 5
    assert [combine.page_size(n) for n in (0, 5, 20_000)] == [1000, 5, 10_000]


def test_normalise(spark):
    raw = tables.literal(spark, [
        {"provider": "aws", "name": "b", "encryption_status": "aws:kms", "public": "true", "versioning": "Enabled", "access_log_target": "logs"},
        {"provider": "azure", "name": "acc", "encryption_status": "Microsoft.Keyvault", "public": "false", "https": "true", "container": "c", "container_public": "Blob"},
        {"provider": "azure", "name": "empty", "encryption_status": "Microsoft.Storage", "public": "true"},
        {"provider": "gcp", "name": "g", "public": "inherited", "versioning": "true"},
    ], "provider string, name string, encryption_status string, public string, versioning string, https string, access_log_target string, container string, container_public string")
    got = {(r["provider"], r["name"]): tuple(r)[3:] for r in classify.conform(classify.normalise_stores(raw), classify.STORE_SCHEMA).collect()}
    assert got["aws", "b"] == ("customer-managed", False, True, None, True, "logs")
    assert got["azure", "acc/c"] == ("customer-managed", True, None, True, False, None)
    assert got["azure", None] == (None,) * 6
    assert got["gcp", "g"] == ("provider-managed", True, True, True, False, None)


def test_small_functions(spark):
    df = tables.literal(spark, [{"s": "a  b\tc"}, {"s": ""}, {"s": None}], "s string")
    assert sorted(r[0] for r in df.select(classify.word_count(F.col("s"))).collect()) == [0, 0, 3]
    line = 'x {"my_token":"s3"} assertion=abc&y Bearer q.w-e'
    assert df.limit(1).select(classify.redact(F.lit(line))).first()[0] == 'x {"my_token":"«redacted»"} assertion=«redacted»&y Bearer «redacted»'
    assert df.limit(1).select(classify.resource_name(F.lit("My Net_1"))).first()[0] == "my-net-1"


def test_sinks(spark, tmp_path):
    df = tables.literal(spark, [{"a": "1", "b": None}], "a string, b string")
    sinks.write_json_lines(df, str(tmp_path / "out"))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"a": "1", "b": None}]
    assert list(sinks.cursor(df)) == [{"a": "1", "b": None}]
    tapped, seen = sinks.log_tap(df, "tap")
    assert tapped.count() == 1 and seen.get == {"rows": 1}
    entry = sinks.saga(df, "vpc", FormClass.CREATE, ["a"]).first()
    assert (entry["redo"], entry["undo"], entry["keys"]) == ("create", "delete", {"a": "1"}) and FormClass.DELETE.inverse() is None
    items = spark.sql("select array(named_struct('x', 1), named_struct('x', 2)) l")
    assert sorted(r[0] for r in sinks.list_lines(items, "l").collect()) == ['{"x":1}', '{"x":2}']
    path = tmp_path / "lines.txt"
    path.write_text("one two\n\nthree\n")
    assert tables.lines(spark, str(path)).count() == 3
    with pytest.raises(Exception, match="broken"):
        tables.failing(spark, "broken").collect()


def test_streaming(spark, tmp_path):
    from quillgraph.streaming.operators import drain, each_batch, enrich, first_of_key, take

    assert len(take(spark.readStream.format("rate").option("rowsPerSecond", 500).load(), 7)) == 7
    spark.createDataFrame([("alpha", "r"), ("beta", "r"), ("beta", "r")], "name string, region string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("name string, region string").parquet(str(tmp_path / "in"))
    assert len(rows(drain(enrich(stream(), INNER(spark).drop("region"), {"name": "name"}), "enriched"))) == 3
    assert drain(first_of_key(stream(), ["name"]), "firsts").count() == 2
    each_batch(stream(), lambda df: df.where("name = 'beta'"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_drained_rows_stay_in_files(spark, tmp_path):
    from quillgraph.catalog_queries import QUERIES
    from quillgraph.streaming.operators import drain

    spark.createDataFrame([(1, 2), (2, 3), (3, 9)], "o_orderkey long, o_custkey long").repartition(2).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(2, "two"), (3, "three")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    found = QUERIES["b_stream_enrich"](spark, str(tmp_path))  # orders is a folder of files here
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "two"), (2, None), (3, None)] and found.inputFiles()
    stream = spark.readStream.schema("o_orderkey long, o_custkey long").parquet(str(tmp_path / "orders.parquet"))
    assert drain(stream.where("o_orderkey > 5"), "none").count() == 0 and spark.table("none").columns == ["o_orderkey", "o_custkey"]
    assert drain(stream.groupBy().count(), "counted", "complete").first()[0] == 3


def test_dag():
    seen = []
    out = run_dag({"a": lambda: seen.append("a") or 1, "b": lambda: seen.append("b") or 2}, {"a": ["b"]})
    assert out == {"a": 1, "b": 2} and seen == ["b", "a"]
    for jobs, after in (({"a": int}, {"a": ["x"]}), ({"a": int, "b": int}, {"a": ["b"], "b": ["a"]})):
        with pytest.raises(PlanError):
            run_dag(jobs, after)
    with pytest.raises(ZeroDivisionError):
        run_dag({"a": lambda: 1 / 0, "b": int}, {"b": ["a"]})
