"""Further queries: methods and functions that ``queries`` doesn't reach, each beside the SQL that gives the same rows."""

from __future__ import annotations

from millrace.queries import chained, exactly

exactly(
    "str_values", "customer",
    """root.k = this.c_custkey
root.b = this.c_name.bytes().length()
root.t = this.c_name.type() + this.c_custkey.type() + this.missing.type()
root.nn = this.c_name.not_null()
root.nu = this.missing.not_null().catch("none")
root.ne = this.c_mktsegment.not_empty()
root.em = "".not_empty().catch("empty")
root.bo = (this.c_custkey % 2).bool()
root.r = this.c_name.replace("Customer", "Buyer")
root.m = this.c_mktsegment.replace_many(["A", "4", "E", "3"])
root.ma = this.c_mktsegment.replace_all_many(["U", "V", "V", "W"])
root.uq = this.c_name.quote().unquote()
root.q = (this.c_name + " &x=é").escape_url_query().unescape_url_query()
root.fs = ("a/b/" + this.c_name).filepath_split().join("|")""",
    "k long, b long, t string, nn string, nu string, ne string, em string, bo boolean, r string, m string, ma string, uq string, q string, fs string",
    """SELECT c_custkey AS k, strlen(c_name) AS b, 'stringnumbernull' AS t, c_name AS nn, 'none' AS nu, c_mktsegment AS ne, 'empty' AS em, c_custkey % 2 = 1 AS bo,
    replace(c_name, 'Customer', 'Buyer') AS r, replace(replace(c_mktsegment, 'A', '4'), 'E', '3') AS m, replace(replace(c_mktsegment, 'U', 'V'), 'V', 'W') AS ma,
    c_name AS uq, c_name || ' &x=é' AS q, 'a/b/|' || c_name AS fs FROM customer""",
)
exactly(
    "num_widths", "part",
    """root.k = this.p_partkey
root.c = this.p_partkey.cos()
root.t = (this.p_partkey % 3).tan()
root.i = (this.p_partkey * 100).int16().catch(-1)
root.u = this.p_size.uint8()
root.w = this.p_partkey.uint32()
root.x = this.p_partkey.string().uint64()
root.neg = (0 - this.p_partkey).uint64().catch(-7)
root.f = (this.p_size / 2).float32()
root.p = pi() * this.p_partkey""",
    "k long, c double, t double, i long, u long, w long, x long, neg long, f double, p double",
    """SELECT p_partkey AS k, cos(p_partkey) AS c, tan(p_partkey % 3) AS t, CASE WHEN p_partkey * 100 > 32767 THEN -1 ELSE p_partkey * 100 END AS i, CAST(p_size AS BIGINT) AS u,
    p_partkey AS w, p_partkey AS x, CASE WHEN p_partkey = 0 THEN 0 ELSE -7 END AS neg, p_size / 2 AS f, pi() * p_partkey AS p FROM part""",
)
exactly(
    "ts_names", "orders",
    """root.k = this.o_orderkey
root.a = this.o_orderdate.format_timestamp("2006-01-02T15:04")
root.b = this.o_orderdate.format_timestamp_strftime("%Y/%m/%d")
root.c = this.o_orderdate.format_timestamp_unix()
root.d = this.o_orderdate.format_timestamp_unix_milli()
root.e = this.o_orderdate.format_timestamp_unix_micro()
root.f = this.o_orderdate.format_timestamp_unix_nano()
root.g = $day.parse_timestamp("2006-01-02").ts_unix()
root.h = $day.ts_strptime("%Y-%m-%d").ts_unix()
root.i = $day.parse_timestamp_strptime("%Y-%m-%d").ts_unix()
root.j = this.o_orderdate.ts_sub_iso8601("P1DT1H").ts_unix()
root.l = this.o_orderdate.ts_tz("UTC").ts_format("15:04:05")
root.m = this.o_orderdate.timestamp().ts_unix()
root.n = this.o_orderkey.timestamp().ts_unix()""".replace("root.a =", 'let day = this.o_orderdate.ts_format("2006-01-02")\nroot.a =', 1),
    "k long, a string, b string, c long, d long, e long, f long, g long, h long, i long, j long, l string, m long, n long",
    """SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS a, strftime(o_orderdate, '%Y/%m/%d') AS b, s AS c, epoch_us(o_orderdate) // 1000 AS d, epoch_us(o_orderdate) AS e,
    epoch_us(o_orderdate) * 1000 AS f, day AS g, day AS h, day AS i, s - 90000 AS j, strftime(o_orderdate, '%H:%M:%S') AS l, s AS m, o_orderkey AS n
    FROM (SELECT *, epoch_us(o_orderdate) // 1000000 AS s, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS day FROM orders)""",
)
exactly(
    "fn_clocks", "supplier",
    """root.k = this.s_suppkey
root.a = now().ts_unix() > 1600000000
root.b = timestamp_unix() > 1600000000
root.c = timestamp_unix_milli() > 1600000000000
root.d = timestamp_unix_micro() > 1600000000000000
root.e = timestamp_unix_nano() > 1600000000000000000
root.f = hostname().length() > 0
root.g = env("MILLRACE_NO_SUCH_VARIABLE") == null
root.h = file("/dev/null").length()
root.i = bytes(3).length()
root.j = random_int(seed: 7, min: 5, max: 5)
root.l = counter(min: 9, max: 9)
root.m = count("rows of fn_clocks") > 0
root.n = if this.s_suppkey % 2 == 0 { nothing() } else { this.s_suppkey }""",
    "k long, a boolean, b boolean, c boolean, d boolean, e boolean, f boolean, g boolean, h long, i long, j long, l long, m boolean, n long",
    """SELECT s_suppkey AS k, true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g, 0::BIGINT AS h, 3::BIGINT AS i, 5::BIGINT AS j, 9::BIGINT AS l, true AS m,
    CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey END AS n FROM supplier""",
)
exactly(
    "struct_search", "orders",
    """root.k = this.o_orderkey
root.g = this.get("o_orderstatus")
root.a = this.o_orderkey.array().length()
root.n = (this.o_totalprice > 100000).not()
root.kv = {"b": this.o_orderkey, "a": 2}.key_values().map_each(x -> x.key + "=" + x.value.string()).join(",")
root.e = {"a": [1, this.o_orderkey], "b": 3}.explode("a").map_each(x -> x.a * x.b).sum()
root.f = [this.o_orderstatus, "O", "F"].find_all("O").length()
root.p = {"a": 1, "b": [1]}.patch({"a": 1, "b": [1]}.diff({"a": this.o_orderkey, "b": [1, 2]})).format_json(no_indent: true).string()
root.fb = [1, 2, 3, 4].find_by(x -> x > this.o_orderkey % 4)
root.fa = [1, 2, 3, 4].find_all_by(x -> x % 2 == 0).sum()
root.mk = {"x": this.o_orderkey}.map_each_key(x -> x.uppercase() + "1").keys().index(0)
root.bl = this.bloblang("root = this.o_orderkey + 1")""".replace("x -> x > this.o_orderkey % 4", "x -> x > $rest").replace("root.fb", "let rest = this.o_orderkey % 4\nroot.fb"),
    "k long, g string, a long, n boolean, kv string, e long, f long, p string, fb long, fa long, mk string, bl long",
    """SELECT o_orderkey AS k, o_orderstatus AS g, 1::BIGINT AS a, NOT o_totalprice > 100000 AS n, 'a=2,b=' || o_orderkey AS kv, 3 + 3 * o_orderkey AS e, CASE o_orderstatus WHEN 'O' THEN 2 ELSE 1 END::BIGINT AS f,
    '{"a":' || o_orderkey || ',"b":[1,2]}' AS p, o_orderkey % 4 AS fb, 4::BIGINT AS fa, 'X1' AS mk, o_orderkey + 1 AS bl FROM orders""",
)
exactly(
    "parse_more", "customer",
    """root.k = this.c_custkey
root.f = ("a=" + this.c_name.escape_url_query() + "&b=2").parse_form_url_encoded().a
root.y = {"n": this.c_name, "k": this.c_custkey}.format_yaml().string().parse_yaml().n
root.x = {"r": {"n": this.c_mktsegment}}.format_xml().string().parse_xml().r.n
root.j = {"k": this.c_custkey, "s": this.c_mktsegment}.format_json(no_indent: true).string()""",
    "k long, f string, y string, x string, j string",
    """SELECT c_custkey AS k, c_name AS f, c_name AS y, c_mktsegment AS x, '{"k":' || c_custkey || ',"s":"' || c_mktsegment || '"}' AS j FROM customer""",
)
exactly(
    "re_more", "pages",
    """root.k = this.page_id
root.s = this.url.re_find_all_submatch("([a-z]+)([0-9]+)").map_each(m -> m.index(2) + m.index(1)).join(",")
root.r = this.url.re_replace("[0-9]+", "<$0>")
root.o = this.url.re_find_all_object("/(?P<step>[a-z]+)").map_each(m -> m.step).join(",")""",
    "k long, s string, r string, o string",
    """SELECT page_id AS k,
    array_to_string(list_transform(list_zip(regexp_extract_all(url, '([a-z]+)([0-9]+)', 2), regexp_extract_all(url, '([a-z]+)([0-9]+)', 1)), lambda z: z[1] || z[2]), ',') AS s,
    regexp_replace(url, '([0-9]+)', '<\\1>', 'g') AS r, array_to_string(regexp_extract_all(url, '/([a-z]+)', 1), ',') AS o FROM pages""",
)
exactly(
    "enc_algorithms", "part",
    "root.k = this.p_partkey\n" + "\n".join(f'root.{a} = this.p_name.compress("{a}").decompress("{a}").string()' for a in ("gzip", "pgzip", "zlib", "flate", "snappy", "lz4", "zstd"))
    + "\n" + "\n".join(f'root.j{n} = {{"n": this.p_name}}.sign_jwt_hs{n}("secret").parse_jwt_hs{n}("secret").n' for n in (384, 512)),
    "k long, gzip string, pgzip string, zlib string, flate string, snappy string, lz4 string, zstd string, j384 string, j512 string",
    "SELECT p_partkey AS k, p_name AS gzip, p_name AS pgzip, p_name AS zlib, p_name AS flate, p_name AS snappy, p_name AS lz4, p_name AS zstd, p_name AS j384, p_name AS j512 FROM part",
)
# the hash of a published example
exactly(
    "argon2", "region",
    """let h = "$argon2id$v=19$m=4096,t=3,p=1$c2FsdHktbWNzYWx0ZmFjZQ$RMUMwgtS32/mbszd+ke4o4Ej1jFpYiUqY6MHWa69X7Y"
root.k = this.r_regionkey
root.y = "there-are-many-blobs-in-the-sea".compare_argon2($h)
root.n = "will-i-ever-find-love".compare_argon2($h)""",
    "k long, y boolean, n boolean",
    "SELECT CAST(r_regionkey AS BIGINT) AS k, true AS y, false AS n FROM region",
)
chained(
    "meta_functions", "orders",
    [{"mapping": "root = this\nmeta kind = this.o_orderstatus\nmeta one = \"1\""}, {"mapping": """root.k = this.o_orderkey
root.a = metadata("kind")
root.b = meta("kind")
root.c = @kind
root.d = content().length() > 2
meta one = "2"
root.e = root_meta("one")
root.f = meta("one")"""}],
    "SELECT o_orderkey AS k, o_orderstatus AS a, o_orderstatus AS b, o_orderstatus AS c, true AS d, '2' AS e, '1' AS f FROM orders",
    "k long, a string, b string, c string, d boolean, e string, f string",
)
chained(
    "error_functions", "orders",
    [{"mapping": 'root = this\nroot.v = if this.o_orderkey % 3 == 0 { throw("bad") } else { 1 }'}, {"mapping": "root = this\nroot.failed = errored()"}, {"catch": [{"mapping": "root.o_orderkey = this.o_orderkey\nroot.failed = errored()\nroot.text = error()\nroot.source = error_source_name()\nroot.label = error_source_label()\nroot.path = error_source_path().type()"}]}],
    """SELECT o_orderkey, o_orderkey % 3 = 0 AS failed, CASE WHEN o_orderkey % 3 = 0 THEN 'failed assignment (line 2): bad' END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'mapping' END AS source,
    CASE WHEN o_orderkey % 3 = 0 THEN '' END AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'string' END AS path FROM orders""",
    "o_orderkey long, failed boolean, text string, source string, label string, path string",
)
chained("proc_log_sleep", "supplier", [{"log": {"message": "row"}}, {"sleep": {"duration": "0s"}}, {"mapping": "root.k = this.s_suppkey"}], "SELECT s_suppkey AS k FROM supplier", "k long")
