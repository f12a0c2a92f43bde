"""Queries over the driver's tables: one an operator or method family, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.batches import Resources
from millrace.operators.flow import Flow, batching, from_table, mapping, run_chain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = {"lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey"]}


def table(spark: SparkSession, sf_dir: str, name: str, batch_by: str | None = None) -> Flow:
    return from_table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name], batch_by)


def query(name: str, sql: str | None = None):
    def add(call: Query) -> Query:
        QUERIES[name] = call
        if sql:
            ORACLE_SQL[name] = sql
        return call

    return add


def mapped(name: str, source: str, text: str, sql: str, mutate: bool = False) -> None:
    """A mapping over a table that compiles to Columns."""
    QUERIES[name] = lambda spark, sf_dir: mapping(table(spark, sf_dir, source), text, Resources(), mutate).rows()
    ORACLE_SQL[name] = sql


def exactly(name: str, source: str, text: str, schema: str, sql: str | None = None, batch_by: str | None = None) -> None:
    """A mapping that the exact evaluator runs; the documents are read back by a schema."""
    QUERIES[name] = lambda spark, sf_dir: mapping(table(spark, sf_dir, source, batch_by), text, Resources()).rows_as(schema)
    if sql:
        ORACLE_SQL[name] = sql


def chained(name: str, source: str, configs: list[dict], sql: str | None, schema: str | None = None, resources: Callable[[], Resources] = Resources, batch_by: str | None = None, finish: Callable[[Flow], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flow = run_chain(table(spark, sf_dir, source, batch_by), configs, resources())
        return finish(flow) if finish else flow.rows_as(schema) if schema else flow.rows()

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


# mapping language
mapped("map_project", "orders", "root.key = this.o_orderkey\nroot.status = this.o_orderstatus\nroot.price = this.o_totalprice", "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price FROM orders")
mapped("map_mutation", "customer", "root.c_name = deleted()\nroot.rich = this.c_acctbal > 5000", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 5000 AS rich FROM customer", True)
mapped("map_if_else", "orders", 'root.key = this.o_orderkey\nroot.class = if this.o_totalprice > 250000 { "large" } else if this.o_totalprice > 100000 { "middle" } else { "small" }', "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 250000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS class FROM orders")
mapped("map_match", "orders", 'root.key = this.o_orderkey\nroot.state = match this.o_orderstatus { "O" => "open", "F" => "filled", _ => "other" }', "SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS state FROM orders")
mapped("map_coalesce", "orders", 'root.key = this.o_orderkey\nroot.a = this.missing | this.o_orderpriority\nroot.b = (this.o_totalprice / (this.o_orderkey % 2)) | -1.5', "SELECT o_orderkey AS key, o_orderpriority AS a, CASE WHEN o_orderkey % 2 = 0 THEN -1.5::DOUBLE ELSE o_totalprice / (o_orderkey % 2) END AS b FROM orders")
mapped("map_let", "lineitem", "let net = this.l_extendedprice * (1 - this.l_discount)\nroot.key = this.l_orderkey\nroot.line = this.l_linenumber\nroot.net = $net\nroot.gross = $net * (1 + this.l_tax)", "SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS line, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
mapped("map_catch_or", "orders", 'root.key = this.o_orderkey\nroot.a = (100 / (this.o_orderkey % 3)).catch(0.5)\nroot.b = this.absent.or("none")', "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE ELSE 100.0::DOUBLE / (o_orderkey % 3) END AS a, 'none' AS b FROM orders")
mapped("map_precedence", "part", "root.key = this.p_partkey\nroot.a = this.p_size + 2 * 3 - 4 % 3\nroot.b = this.p_size > 10 == true\nroot.c = this.p_size > 40 || this.p_size < 3 && this.p_partkey > 10", "SELECT p_partkey AS key, CAST(p_size AS BIGINT) + 6 - 1 AS a, p_size > 10 AS b, (p_size > 40 OR p_size < 3) AND p_partkey > 10 AS c FROM part")
mapped("map_nested", "supplier", "root.id = this.s_suppkey\nroot.who.name = this.s_name\nroot.who.nation = this.s_nationkey\nroot.flat = this.s_name.length()", "SELECT s_suppkey AS id, {'name': s_name, 'nation': CAST(s_nationkey AS BIGINT)} AS who, strlen(s_name) AS flat FROM supplier")
exactly("map_apply", "nation", 'map shout { root = this.uppercase() + "!" }\nroot.key = this.n_nationkey\nroot.name = this.n_name.apply("shout")', "key long, name string", "SELECT CAST(n_nationkey AS BIGINT) AS key, upper(n_name) || '!' AS name FROM nation")


@query("map_filter_deleted", "SELECT event_id, event_type, value FROM events WHERE NOT value < 50")
def map_filter_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = mapping(table(spark, sf_dir, "events"), "root.event_id = this.event_id\nroot.event_type = this.event_type\nroot.value = this.value", Resources())
    return mapping(flow, "root = this\nroot = if this.value < 50 { deleted() }", Resources()).rows()


# numbers
mapped("num_arithmetic", "lineitem", "root.k = this.l_orderkey\nroot.l = this.l_linenumber\nroot.add = this.l_quantity + this.l_tax\nroot.div = this.l_partkey / (this.l_suppkey + 1)\nroot.mod = this.l_partkey % (this.l_suppkey + 1)\nroot.neg = -this.l_partkey", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS l, l_quantity + l_tax AS add, l_partkey / (l_suppkey + 1) AS div, l_partkey % (l_suppkey + 1) AS mod, -l_partkey AS neg FROM lineitem")
mapped("num_wrap", "part", "root.k = this.p_partkey\nroot.w = 9223372036854775807 + this.p_partkey", "SELECT p_partkey AS k, CAST(CASE WHEN p_partkey = 0 THEN 9223372036854775807 ELSE -9223372036854775808::HUGEINT + p_partkey - 1 END AS BIGINT) AS w FROM part")
mapped("num_rounding", "customer", "root.k = this.c_custkey\nroot.c = this.c_acctbal.ceil()\nroot.f = this.c_acctbal.floor()\nroot.r = (this.c_acctbal / 3).round()\nroot.a = this.c_acctbal.abs()", "SELECT c_custkey AS k, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal / 3) AS r, abs(c_acctbal) AS a FROM customer")
mapped("num_bitwise", "part", "root.k = this.p_partkey\nroot.a = this.p_partkey.bitwise_and(12)\nroot.o = this.p_partkey.bitwise_or(5)\nroot.x = this.p_partkey.bitwise_xor(255)", "SELECT p_partkey AS k, p_partkey & 12 AS a, p_partkey | 5 AS o, xor(p_partkey, 255) AS x FROM part")
mapped("num_functions", "part", "root.k = this.p_partkey\nroot.p = this.p_size.pow(2)\nroot.l = this.p_retailprice.log10() * 1000\nroot.n = this.p_retailprice.log().floor()\nroot.s = (this.p_size.sin() * 1000000).round()", "SELECT p_partkey AS k, power(p_size, 2) AS p, log10(p_retailprice) * 1000 AS l, floor(ln(p_retailprice)) AS n, round(sin(p_size) * 1000000) AS s FROM part")
exactly("num_casts", "part", "root.k = this.p_partkey\nroot.i = (this.p_partkey % 100).int8()\nroot.u = this.p_size.uint16()\nroot.f = this.p_size.string().float64()\nroot.h = \"0x1f\".int32()", "k long, i long, u long, f double, h long", "SELECT p_partkey AS k, p_partkey % 100 AS i, CAST(p_size AS BIGINT) AS u, CAST(p_size AS DOUBLE) AS f, 31::BIGINT AS h FROM part")
mapped("num_number", "documents", 'root.k = this.doc_id\nroot.n = this.source.trim_prefix("src").number(-1.0)', "SELECT doc_id AS k, coalesce(TRY_CAST(replace(source, 'src', '') AS DOUBLE), -1.0) AS n FROM documents")

# strings
mapped("str_case", "part", "root.k = this.p_partkey\nroot.u = this.p_name.uppercase()\nroot.l = this.p_brand.lowercase()\nroot.n = this.p_name.length()", "SELECT p_partkey AS k, upper(p_name) AS u, lower(p_brand) AS l, strlen(p_name) AS n FROM part")
mapped("str_trim", "part", 'root.k = this.p_partkey\nroot.a = ("  " + this.p_brand + " \\n").trim()\nroot.b = this.p_brand.trim("B1")\nroot.c = this.p_brand.trim_prefix("Brand")\nroot.d = this.p_brand.trim_suffix("1")', "SELECT p_partkey AS k, p_brand AS a, trim(p_brand, 'B1') AS b, CASE WHEN starts_with(p_brand, 'Brand') THEN substr(p_brand, 6) ELSE p_brand END AS c, CASE WHEN suffix(p_brand, '1') THEN left(p_brand, length(p_brand) - 1) ELSE p_brand END AS d FROM part")
mapped("str_split_join", "part", 'root.k = this.p_partkey\nroot.j = this.p_type.split(" ").join("_")\nroot.n = this.p_type.split(" ").length()', "SELECT p_partkey AS k, replace(p_type, ' ', '_') AS j, len(string_split(p_type, ' ')) AS n FROM part")
mapped("str_replace_reverse", "part", 'root.k = this.p_partkey\nroot.a = this.p_name.replace_all("a", "@")\nroot.b = this.p_name.reverse()\nroot.c = this.p_brand.repeat(2)', "SELECT p_partkey AS k, replace(p_name, 'a', '@') AS a, reverse(p_name) AS b, repeat(p_brand, 2) AS c FROM part")
mapped("str_search", "part", 'root.k = this.p_partkey\nroot.a = this.p_name.contains("a")\nroot.b = this.p_name.has_prefix("p")\nroot.c = this.p_name.has_suffix("1")\nroot.d = this.p_name.index_of("a")', "SELECT p_partkey AS k, contains(p_name, 'a') AS a, starts_with(p_name, 'p') AS b, suffix(p_name, '1') AS c, CAST(instr(p_name, 'a') - 1 AS BIGINT) AS d FROM part")
mapped("str_slice", "customer", "root.k = this.c_custkey\nroot.a = this.c_name.slice(1, 4)\nroot.b = this.c_name.slice(-3)\nroot.c = this.c_name.slice(0, -2)", "SELECT c_custkey AS k, substr(c_name, 2, 3) AS a, right(c_name, 3) AS b, left(c_name, length(c_name) - 2) AS c FROM customer")
mapped("str_escape", "pages", "root.k = this.page_id\nroot.h = this.url.escape_html()\nroot.q = this.url.escape_url_query()", "SELECT page_id AS k, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS h, url_encode(url) AS q FROM pages")
exactly("str_exact", "customer", 'root.k = this.c_custkey\nroot.c = this.c_mktsegment.lowercase().capitalize()\nroot.f = "%s-%d".format(this.c_name, this.c_custkey)\nroot.p = ["a", this.c_name].filepath_join()\nroot.q = this.c_name.quote()', "k long, c string, f string, p string, q string", "SELECT c_custkey AS k, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS c, c_name || '-' || c_custkey AS f, 'a/' || c_name AS p, '\"' || c_name || '\"' AS q FROM customer")
mapped("re_match_replace", "part", 'root.k = this.p_partkey\nroot.m = this.p_type.re_match("^[A-M]")\nroot.r = this.p_type.re_replace_all("[aeiouAEIOU]", "*")\nroot.s = this.p_brand.re_replace_all("([A-Za-z]+)#?([0-9]+)", "$2-$1")', "SELECT p_partkey AS k, regexp_matches(p_type, '^[A-M]') AS m, regexp_replace(p_type, '[aeiouAEIOU]', '*', 'g') AS r, regexp_replace(p_brand, '([A-Za-z]+)#?([0-9]+)', '\\2-\\1', 'g') AS s FROM part")
mapped("re_find_all", "documents", 'root.k = this.doc_id\nroot.n = this.text.re_find_all("[A-Z][a-z]+").length()', "SELECT doc_id AS k, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS n FROM documents")
exactly("re_submatch", "pages", 'root.k = this.page_id\nlet m = this.url.re_find_object("(?P<scheme>[a-z]+)://(?P<host>[^/]+)")\nroot.s = $m.scheme\nroot.h = $m.host', "k long, s string, h string", "SELECT page_id AS k, regexp_extract(url, '([a-z]+)://([^/]+)', 1) AS s, regexp_extract(url, '([a-z]+)://([^/]+)', 2) AS h FROM pages")

# hashes and encodings
mapped("hash_digests", "part", 'root.k = this.p_partkey\nroot.m = this.p_name.hash("md5").encode("hex")\nroot.s = this.p_name.hash("sha256").encode("hex")\nroot.b = this.p_name.encode("base64")\nroot.h = this.p_name.encode("hex")', "SELECT p_partkey AS k, md5(p_name) AS m, sha256(p_name) AS s, to_base64(encode(p_name)) AS b, lower(hex(encode(p_name))) AS h FROM part")
exactly("enc_round_trip", "part", 'root.k = this.p_partkey\nroot.a = this.p_name.encode("base64url").decode("base64url").string()\nroot.b = this.p_name.compress("zstd").decompress("zstd").string()\nroot.c = this.p_name.encrypt_aes("ctr", "0123456789abcdef", "fedcba9876543210").decrypt_aes("ctr", "0123456789abcdef", "fedcba9876543210").string()', "k long, a string, b string, c string", "SELECT p_partkey AS k, p_name AS a, p_name AS b, p_name AS c FROM part")
exactly("jwt_round_trip", "nation", 'root.k = this.n_nationkey\nroot.name = {"n": this.n_name}.sign_jwt_hs256("secret").parse_jwt_hs256("secret").n', "k long, name string", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")

# time
mapped("ts_numbers", "orders", "root.k = this.o_orderkey\nroot.s = this.o_orderdate.ts_unix()\nroot.m = this.o_orderdate.ts_unix_milli()\nroot.u = this.o_orderdate.ts_unix_micro()\nroot.n = this.o_orderdate.ts_unix_nano()", "SELECT o_orderkey AS k, CAST(floor(epoch_us(o_orderdate) / 1000000) AS BIGINT) AS s, epoch_ms(o_orderdate) AS m, epoch_us(o_orderdate) AS u, epoch_us(o_orderdate) * 1000 AS n FROM orders")
mapped("ts_strftime", "orders", 'root.k = this.o_orderkey\nroot.d = this.o_orderdate.ts_strftime("%Y-%m-%d")\nroot.t = this.o_orderdate.ts_strftime("%d/%m/%y %H:%M:%S")', "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%d/%m/%y %H:%M:%S') AS t FROM orders")
mapped("ts_round_sub", "events", "root.k = this.event_id\nroot.r = this.ts.ts_round(3600000000000).ts_unix()\nroot.d = this.ts.ts_sub(this.ts.ts_round(3600000000000))", "SELECT event_id AS k, CAST(floor((epoch_us(ts) + 1800000000) / 3600000000.0) AS BIGINT) * 3600 AS r, (epoch_us(ts) - CAST(floor((epoch_us(ts) + 1800000000) / 3600000000.0) AS BIGINT) * 3600000000) * 1000 AS d FROM events")
exactly("ts_layouts", "orders", 'root.k = this.o_orderkey\nroot.f = this.o_orderdate.ts_format("2006-01-02")\nroot.p = this.o_orderdate.ts_format("2006-01-02").ts_parse("2006-01-02").ts_unix()\nroot.m = this.o_orderdate.ts_format("Jan _2")', "k long, f string, p long, m string", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS f, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS p, strftime(o_orderdate, '%b ') || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, ' ') AS m FROM orders")
exactly("ts_iso", "orders", 'root.k = this.o_orderkey\nroot.a = this.o_orderdate.ts_add_iso8601("P1DT2H").ts_unix()\nroot.d = "PT1H30M".parse_duration_iso8601()\nroot.e = "1h30m".parse_duration()', "k long, a long, d long, e long", "SELECT o_orderkey AS k, CAST(floor(epoch_us(o_orderdate) / 1000000) AS BIGINT) + 93600 AS a, 5400000000000 AS d, 5400000000000 AS e FROM orders")

# arrays and objects
mapped("arr_map_filter", "embeddings", "root.k = this.vec_id\nroot.n = this.embedding.filter(x -> x > 0).length()\nroot.m = this.embedding.map_each(x -> x * 2).length()\nroot.any = this.embedding.any(x -> x > 0.1)\nroot.all = this.embedding.all(x -> x < 10)", "SELECT vec_id AS k, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n, CAST(len(embedding) AS BIGINT) AS m, len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.1)) > 0 AS any, len(list_filter(embedding, lambda x: x < 10)) = len(embedding) AS all FROM embeddings")
mapped("arr_aggregates", "embeddings", "root.k = this.vec_id\nroot.lo = this.embedding.min()\nroot.hi = this.embedding.max()\nroot.n = this.embedding.length()\nroot.s = (this.embedding.sum() * 1000).round()", "SELECT vec_id AS k, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi, CAST(len(embedding) AS BIGINT) AS n, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]) * 1000) AS s FROM embeddings")
mapped("arr_sort_unique", "part", 'root.k = this.p_partkey\nroot.s = this.p_type.split(" ").sort().join(",")\nroot.u = (this.p_type + " " + this.p_type).split(" ").unique().length()', "SELECT p_partkey AS k, array_to_string(list_sort(string_split(p_type, ' ')), ',') AS s, CAST(len(list_distinct(string_split(p_type, ' '))) AS BIGINT) AS u FROM part")
mapped("arr_build", "nation", "root.k = this.n_nationkey\nroot.a = [this.n_regionkey, 7].append(9).concat([1]).sum()\nroot.f = [[1, 2], [3]].flatten().length()\nroot.i = [5, 6, 7].find(this.n_regionkey + 5)\nroot.x = [10, 20, 30, 40, 50, 60][this.n_regionkey]", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey + 17 AS BIGINT) AS a, 3::BIGINT AS f, CASE WHEN n_regionkey < 3 THEN CAST(n_regionkey AS BIGINT) ELSE -1 END AS i, CAST((n_regionkey + 1) * 10 AS BIGINT) AS x FROM nation")
mapped("arr_fold", "nation", "root.k = this.n_nationkey\nroot.s = range(0, this.n_nationkey + 1).fold(0, item -> item.tally + item.value)", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey * (n_nationkey + 1) // 2 AS BIGINT) AS s FROM nation")
exactly("arr_exact", "nation", 'root.k = this.n_nationkey\nroot.z = [1, 2].zip([3, 4]).flatten().sum()\nroot.e = ["a", "b"].enumerated().map_each(x -> x.index).sum()\nroot.b = [3, 1, 2].sort_by(x -> -x).index(0)\nroot.d = {"a": 1}.diff({"a": 2}).length()', "k long, z long, e long, b long, d long", "SELECT CAST(n_nationkey AS BIGINT) AS k, 10::BIGINT AS z, 1::BIGINT AS e, 3::BIGINT AS b, 1::BIGINT AS d FROM nation")
exactly("json_props", "events", 'root.k = this.event_id\nlet p = this.props.parse_json()\nroot.v = $p.k\nroot.has = $p.exists("k")\nroot.keys = $p.keys().join(",")', "k long, v long, has boolean, keys string", "SELECT event_id AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v, json_exists(props, '$.k') AS has, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
exactly("json_merge_assign", "events", 'root.k = this.event_id\nlet a = {"x": this.user_id}\nroot.m = $a.merge({"x": 1}).x.sum()\nroot.s = $a.assign({"x": 5, "y": 6}).values().sum()\nroot.c = {"a": {"b": 1}}.collapse().keys().index(0)\nroot.q = [{"a": 1}, {"b": 2}].squash().length()', "k long, m long, s long, c string, q long", "SELECT event_id AS k, user_id + 1 AS m, 11::BIGINT AS s, 'a.b' AS c, 2::BIGINT AS q FROM events")
exactly("json_with_without", "nation", 'root.a = this.with("n_name", "n_nationkey")\nroot.b = this.without("n_name").keys().length()', "a struct<n_name:string,n_nationkey:bigint>, b long", "SELECT {'n_name': n_name, 'n_nationkey': CAST(n_nationkey AS BIGINT)} AS a, 2::BIGINT AS b FROM nation")
exactly("parse_formats", "nation", 'root.k = this.n_nationkey\nroot.y = ("a: " + this.n_name).parse_yaml().a\nroot.x = ("<r><n>" + this.n_name + "</n></r>").parse_xml().r.n\nroot.c = ("h\\n" + this.n_name).parse_csv().index(0).h\nroot.m = {"v": this.n_name}.format_msgpack().parse_msgpack().v\nroot.l = ("name=" + this.n_name.replace_all(" ", "_")).parse_logfmt().name', "k long, y string, x string, c string, m string, l string", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS y, n_name AS x, n_name AS c, n_name AS m, replace(n_name, ' ', '_') AS l FROM nation")
exactly("url_parse", "pages", "root.k = this.page_id\nlet u = this.url.parse_url()\nroot.s = $u.scheme\nroot.h = $u.host\nroot.p = $u.path\nroot.q = $u.raw_query\nroot.f = $u.fragment", "k long, s string, h string, p string, q string, f string", "SELECT page_id AS k, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\\?([^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS f FROM pages")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#34;", '"'), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs'), '<(script|style)\\b[^>]*>.*?(</(script|style)\\s*>|$)', '', 'gsi'), '</?[A-Za-z][^>]*>|<[!?][^>]*>', '', 'g')"
for _entity, _char in _ENTITIES:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_entity}?', '{_char}', 'g')"  # the semicolon may lack
for _char, _entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
    _STRIPPED = f"replace({_STRIPPED}, '{_char}', '{_entity}')"
exactly("strip_html", "pages", "root.k = this.page_id\nroot.t = this.html.strip_html()", "k long, t string", f"SELECT page_id AS k, {_STRIPPED} AS t FROM pages")

# processors
chained("proc_switch", "events", [{"switch": [
    {"check": 'this.event_type == "error"', "processors": [{"mapping": 'root.id = this.event_id\nroot.to = "alert"'}]},
    {"check": "this.value > 50", "processors": [{"mapping": 'root.id = this.event_id\nroot.to = "high"'}]},
    {"processors": [{"mapping": 'root.id = this.event_id\nroot.to = "low"'}]}]}],
    "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'alert' WHEN value > 50 THEN 'high' ELSE 'low' END AS \"to\" FROM events", finish=lambda f: f.rows_as("id long, `to` string"))
chained("proc_group_by", "orders", [{"group_by": [{"check": 'this.o_orderstatus == "O"', "processors": []}, {"check": 'this.o_orderstatus == "F"', "processors": []}]}], "SELECT CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS grp, count(*) AS n FROM orders GROUP BY 1", finish=lambda f: f.df.groupBy(F.substring_index("batch", "#", -1).cast("int").alias("grp")).agg(F.count("*").alias("n")))
chained("proc_branch", "orders", [{"branch": {"request_map": "root.p = this.o_totalprice", "processors": [{"mapping": "root.q = this.p * 2"}], "result_map": "root.double = this.q"}}, {"mapping": "root.k = this.o_orderkey\nroot.d = this.double"}], "SELECT o_orderkey AS k, o_totalprice * 2 AS d FROM orders")
chained("proc_workflow", "nation", [{"workflow": {"order": [["a"], ["b"]], "branches": {"a": {"request_map": "root.n = this.n_name", "processors": [{"mapping": "root.u = this.n.length()"}], "result_map": "root.len = this.u"}, "b": {"request_map": "root.l = this.len", "processors": [{"mapping": "root.d = this.l * 2"}], "result_map": "root.twice = this.d"}}}}], "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, strlen(n_name) AS len, strlen(n_name) * 2 AS twice FROM nation", "n_nationkey long, len long, twice long")
chained("proc_try_catch", "orders", [{"mapping": "root.k = this.o_orderkey\nroot.v = if this.o_orderkey % 5 == 0 { throw(\"bad\") } else { this.o_totalprice }"}, {"catch": [{"mapping": "root.k = this.o_orderkey\nroot.v = -1.5"}]}], "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN -1.5 ELSE o_totalprice END AS v FROM orders", "k long, v double")
chained("proc_unarchive_lines", "documents", [{"mapping": "root = this.text"}, {"unarchive": {"format": "lines"}}], "SELECT unnest(string_split(text, chr(10))) AS line FROM documents", finish=lambda f: f.df.select(F.decode("content", "UTF-8").alias("line")))
chained("proc_unarchive_json", "nation", [{"mapping": "root = [this.n_nationkey, this.n_regionkey]"}, {"unarchive": {"format": "json_array"}}, {"mapping": "root.v = this"}], "SELECT CAST(unnest([n_nationkey, n_regionkey]) AS BIGINT) AS v FROM nation", "v long")
chained("proc_archive_lines", "conversations", [{"mapping": "root = this.text"}, {"archive": {"format": "lines"}}], "SELECT CAST(conv_id AS VARCHAR) AS batch, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id", batch_by="conv_id", finish=lambda f: f.df.select("batch", F.decode("content", "UTF-8").alias("content")))
chained("proc_archive_json", "conversations", [{"mapping": "root.turn = this.turn"}, {"archive": {"format": "json_array"}}], "SELECT CAST(conv_id AS VARCHAR) AS batch, '[' || string_agg('{\"turn\":' || turn || '}', ',' ORDER BY turn) || ']' AS content FROM conversations GROUP BY conv_id", batch_by="conv_id", finish=lambda f: f.df.select("batch", F.decode("content", "UTF-8").alias("content")))
chained("proc_dedupe", "events", [{"dedupe": {"cache": "seen", "key": "${! this.user_id }"}}], "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1", resources=lambda: Resources(caches={"seen": {"memory": {}}}), finish=lambda f: f.rows().select("event_id", "user_id", "event_type"))
chained("proc_split", "conversations", [{"split": {"size": 2}}], "SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 2) AS BIGINT) AS part FROM conversations", batch_by="conv_id", finish=lambda f: f.df.select("doc.conv_id", "doc.turn", F.substring_index("batch", "/", -1).cast("long").alias("part")))
chained("proc_bounds_check", "conversations", [{"mapping": "root = this"}, {"bounds_check": {"min_parts": 2, "max_parts": 4}}], "SELECT conv_id, turn FROM conversations QUALIFY count(*) OVER (PARTITION BY conv_id) BETWEEN 2 AND 4", "conv_id long, turn long", batch_by="conv_id")
chained("proc_select_parts", "conversations", [{"select_parts": {"parts": [-1, 0]}}], "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 UNION ALL SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1", batch_by="conv_id", finish=lambda f: f.rows().select("conv_id", "turn"))
chained("proc_insert_part", "conversations", [{"mapping": "root.conv_id = this.conv_id\nroot.turn = this.turn"}, {"insert_part": {"index": -1, "content": '{"conv_id":${! this.conv_id },"turn":-1}'}}], "SELECT conv_id, turn FROM conversations UNION ALL SELECT DISTINCT conv_id, -1 FROM conversations", "conv_id long, turn long", batch_by="conv_id")
chained("proc_for_each", "orders", [{"for_each": [{"mapping": "root.k = this.o_orderkey\nroot.n = batch_size()"}]}], "SELECT o_orderkey AS k, 1::BIGINT AS n FROM orders")
chained("proc_compress", "nation", [{"mapping": "root.n = this.n_name"}, {"compress": {"algorithm": "gzip"}}, {"decompress": {"algorithm": "gzip"}}], "SELECT n_name AS n FROM nation", "n string")
chained("proc_noop_try", "nation", [{"noop": {}}, {"try": [{"mapping": "root.k = this.n_nationkey\nroot.n = this.n_name"}]}], "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation")
chained("proc_python", "nation", [{"python": "double"}], "SELECT CAST(n_nationkey * 2 AS BIGINT) AS k FROM nation", "k long", resources=lambda: Resources(functions={"double": lambda doc: {"k": doc["n_nationkey"] * 2}}))

# batches
mapped_batch = "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS idx, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations"
chained("batch_index_size", "conversations", [{"mapping": "root.conv_id = this.conv_id\nroot.turn = this.turn\nroot.idx = batch_index()\nroot.size = batch_size()"}], mapped_batch, batch_by="conv_id")
exactly("batch_from_all", "conversations", "root.conv_id = this.conv_id\nroot.turn = this.turn\nroot.total = json(\"turn\").from_all().sum()\nroot.first = json(\"turn\").from(0)", "conv_id long, turn long, total long, first long", "SELECT conv_id, turn, CAST(sum(turn) OVER (PARTITION BY conv_id) AS BIGINT) AS total, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations", "conv_id")


@query("batch_count", "SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 100) AS BIGINT) AS b FROM events")
def batch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching(table(spark, sf_dir, "events"), count=100, key="event_type").df.select("doc.event_id", F.substring_index("batch", "/", -1).cast("long").alias("b"))


@query("batch_check", "SELECT event_id, CAST(coalesce(sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM events")
def batch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching(table(spark, sf_dir, "events"), check="this.value > 90", key="user_id").df.select("doc.event_id", F.substring_index("batch", "/", -1).cast("long").alias("b"))


# sources and sinks
@query("in_broker", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS n FROM region UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation")
def in_broker(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources.inputs import broker

    a = mapping(table(spark, sf_dir, "region"), "root.k = this.r_regionkey\nroot.n = this.r_name", Resources())
    b = mapping(table(spark, sf_dir, "nation"), "root.k = this.n_nationkey\nroot.n = this.n_name", Resources())
    return broker([a, b]).rows()


@query("in_sequence", "SELECT 0 AS seq, CAST(r_regionkey AS BIGINT) AS k FROM region UNION ALL SELECT 1, CAST(n_nationkey AS BIGINT) FROM nation")
def in_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources.inputs import sequence

    a = mapping(table(spark, sf_dir, "region"), "root.k = this.r_regionkey", Resources())
    b = mapping(table(spark, sf_dir, "nation"), "root.k = this.n_nationkey", Resources())
    return sequence([a, b]).df.select(F.col("ord.seq").alias("seq"), "doc.k")


@query("in_generate", "SELECT range AS n, range * range AS sq FROM range(1, 1001)")
def in_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources.inputs import generate

    flow = generate(spark, 'root.n = this.id + 1', count=1000)
    return mapping(flow, "root.n = this.n\nroot.sq = this.n * this.n", Resources()).rows()


@query("out_switch", "SELECT CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS route, count(*) AS n FROM events GROUP BY 1")
def out_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources.outputs import routes

    flow = table(spark, sf_dir, "events")
    found = routes(flow, [{"check": 'this.event_type == "error"'}, {"check": 'this.event_type == "purchase"'}, {}])
    return found.groupBy(F.get("route", F.lit(0)).alias("route")).agg(F.count("*").alias("n"))


@query("flagship", "SELECT user_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(value * 10) AS score FROM (SELECT * FROM events WHERE NOT value < 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: filter, first of each user, fields of the properties, a score."""
    resources = Resources(caches={"seen": {"memory": {}}})
    flow = table(spark, sf_dir, "events")
    flow = run_chain(flow, [{"mapping": "root.user_id = this.user_id\nroot.kind = this.event_type\nroot.props = this.props\nroot.value = this.value"}, {"mapping": "root = this\nroot = if this.value < 10 { deleted() }"}, {"dedupe": {"cache": "seen", "key": "${! this.user_id }"}}], resources)
    return mapping(flow, "root.user_id = this.user_id\nroot.kind = this.kind\nroot.k = this.props.parse_json().k\nroot.score = (this.value * 10).round()", resources).rows_as("user_id long, kind string, k long, score double")


exactly("fn_identifiers", "nation", "root.k = this.n_nationkey\nroot.u = uuid_v4().length()\nroot.v = uuid_v7().slice(14, 15)\nroot.l = ulid().length()\nroot.s = ksuid().length()\nroot.n = nanoid().length()\nroot.f = snowflake_id().int64() > 0\nroot.five = \"a\".uuid_v5(\"dns\").length()", "k long, u long, v string, l long, s long, n long, f boolean, five long", "SELECT CAST(n_nationkey AS BIGINT) AS k, 36::BIGINT AS u, '7' AS v, 26::BIGINT AS l, 27::BIGINT AS s, 21::BIGINT AS n, true AS f, 36::BIGINT AS five FROM nation")
exactly("str_slug_html", "nation", 'root.k = this.n_nationkey\nroot.s = this.n_name.slug()\nroot.e = ("<b>" + this.n_name + "</b>").escape_html().unescape_html()\nroot.p = ("<b>" + this.n_name + "</b><i>x</i>").strip_html(["b"])\nroot.u = this.n_name.escape_url_path().unescape_url_path()', "k long, s string, e string, p string, u string", "SELECT CAST(n_nationkey AS BIGINT) AS k, regexp_replace(lower(n_name), '[^a-z0-9_]+', '-', 'g') AS s, '<b>' || n_name || '</b>' AS e, '<b>' || n_name || '</b>x' AS p, n_name AS u FROM nation")
exactly("json_schema_path", "nation", 'root.k = this.n_nationkey\nroot.p = {"a": [{"b": this.n_regionkey}, {"b": 9}]}.json_path("$.a[*].b").sum()\nroot.ok = this.json_schema("{\\"type\\":\\"object\\",\\"required\\":[\\"n_name\\"]}").catch(null) != null\nroot.bad = this.json_schema("{\\"required\\":[\\"zzz\\"]}").catch(null) != null', "k long, p long, ok boolean, bad boolean", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_regionkey + 9 AS BIGINT) AS p, true AS ok, false AS bad FROM nation")


@query("out_broker", "SELECT 0 AS sink, CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT 1, CAST(n_nationkey AS BIGINT) FROM nation")
def out_broker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two outputs of a fan-out get."""
    from millrace.sources.outputs import broker

    got: list[DataFrame] = []
    take = [lambda flow, k=k: got.append(flow.rows().withColumn("sink", F.lit(k))) for k in range(2)]
    broker(take)(mapping(table(spark, sf_dir, "nation"), "root.k = this.n_nationkey", Resources()))
    return got[0].unionByName(got[1]).select("sink", "k")


@query("batch_period", "SELECT event_id, strftime(to_timestamp(floor(epoch_us(ts) / 3600000000.0) * 3600) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:00:00.000') AS batch FROM events")
def batch_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.streaming.runner import period_batches

    return period_batches(table(spark, sf_dir, "events"), "ts", "1 hour").df.select("doc.event_id", "batch")
