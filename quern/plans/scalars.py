"""Scalar functions: math, strings, dates and conditionals."""

from pyspark.sql import functions as F

from quern import functions as Q
from quern.plans.base import query


def one_row(frame):
    """A frame of one row, for functions of constants."""
    return frame.df.sparkSession.range(1)


def r(column, digits=9):
    return F.round(column, digits)


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, abs(l_tax - 0.05) AS a, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(sqrt(l_quantity), 9) AS s, CAST(sign(l_discount - 0.05) AS DOUBLE) AS g, -l_quantity AS n FROM lineitem""")
def math_basic(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", Q.abs(F.col("l_tax") - 0.05).alias("a"), Q.ceil("l_extendedprice").alias("c"), Q.floor("l_extendedprice").alias("f"), r(Q.sqrt("l_quantity")).alias("s"), Q.sign(F.col("l_discount") - 0.05).alias("g"), Q.negative("l_quantity").alias("n"))


@query("part", sql="""SELECT p_partkey, round(sin(p_size), 9) AS a, round(cos(p_size), 9) AS b, round(tan(p_size), 6) AS c, round(asin(p_size / 100.0), 9) AS d, round(acos(p_size / 100.0), 9) AS e, round(atan(p_size), 9) AS f, round(atan2(p_size, 3), 9) AS g, round(degrees(p_size), 6) AS h, round(radians(p_size), 9) AS i FROM part""")
def math_trig(part):
    x, unit = F.col("p_size"), F.col("p_size") / 100.0
    cells = {"a": Q.sin(x), "b": Q.cos(x), "d": Q.asin(unit), "e": Q.acos(unit), "f": Q.atan(x), "g": Q.atan2(x, F.lit(3)), "i": Q.radians(x)}
    return part.select("p_partkey", *(r(c).alias(n) for n, c in cells.items()), r(Q.tan(x), 6).alias("c"), r(Q.degrees(x), 6).alias("h"))


@query("part", sql="""SELECT p_partkey, round(sinh(p_size / 10.0), 6) AS a, round(cosh(p_size / 10.0), 6) AS b, round(tanh(p_size / 10.0), 9) AS c, round(acosh(p_size + 1.0), 9) AS d, round(atanh(p_size / 100.0), 9) AS e, round(asinh(p_size * 1.0), 9) AS f FROM part""")
def math_hyper(part):
    x = F.col("p_size")
    return part.select("p_partkey", r(Q.sinh(x / 10.0), 6).alias("a"), r(Q.cosh(x / 10.0), 6).alias("b"), r(Q.tanh(x / 10.0)).alias("c"), r(Q.acosh(x + 1.0)).alias("d"), r(Q.atanh(x / 100.0)).alias("e"), r(Q.asinh(x * 1.0)).alias("f"))


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 9) AS a, round(log10(l_quantity), 9) AS b, round(log2(l_quantity), 9) AS c, round(exp(l_discount), 9) AS d, round(ln(1 + l_tax), 9) AS e, round(exp(l_tax) - 1, 9) AS f, round(ln(l_quantity) / ln(3), 9) AS g, round(pow(l_quantity, 1.5), 6) AS h FROM lineitem""")
def math_log_exp(lineitem):
    q = F.col("l_quantity")
    return lineitem.select("l_orderkey", "l_linenumber", r(Q.ln(q)).alias("a"), r(Q.log10(q)).alias("b"), r(Q.log2(q)).alias("c"), r(Q.exp("l_discount")).alias("d"), r(Q.log1p("l_tax")).alias("e"), r(Q.expm1("l_tax")).alias("f"), r(Q.log(3.0, q)).alias("g"), r(Q.pow(q, F.lit(1.5)), 6).alias("h"))


@query("part", sql="""SELECT p_partkey, ((p_partkey - 1000) % 7 + 7) % 7 AS m, round(p_retailprice, -1) AS tens, round(pi(), 9) AS pi, round(exp(1), 9) AS e FROM part""")
def math_round_pmod(part):
    return part.select("p_partkey", Q.pmod(F.col("p_partkey") - 1000, F.lit(7)).cast("bigint").alias("m"), Q.round("p_retailprice", -1).alias("tens"), r(Q.pi()).alias("pi"), r(Q.e()).alias("e"))


@query("part", sql="""SELECT p_partkey, CAST(CASE WHEN p_size < 5 THEN 0 WHEN p_size >= 45 THEN 9 ELSE floor((p_size - 5) / 5.0) + 1 END AS BIGINT) AS b, 0::BIGINT AS reversed FROM part""")
def math_width_bucket(part):
    return part.select("p_partkey", Q.width_bucket("p_size", 5, 45, 8).alias("b"), Q.width_bucket("p_size", 45, 5, 8).alias("reversed"))


@query("part", sql="SELECT p_partkey, upper(to_hex(p_partkey)) AS hex, to_binary(p_partkey) AS bits FROM part")
def math_conv(part):
    text = F.col("p_partkey").cast("string")
    return part.select("p_partkey", Q.conv(text, 10, 16).alias("hex"), Q.conv(text, 10, 2).alias("bits"))


@query("customer", sql="""SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_mktsegment) AS l, trim('  ' || c_name || ' ') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt, lpad(c_mktsegment, 14, '*') AS lp, rpad(c_mktsegment, 6, '*') AS rp, repeat('ab', 3) AS rep, length(c_name) AS n, reverse(c_name) AS rev, ascii(c_name) AS a FROM customer""")
def str_case_trim_pad(customer):
    s = "c_mktsegment"
    return customer.select("c_custkey", Q.upper(s).alias("u"), Q.lower(s).alias("l"), Q.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("t"), Q.ltrim(F.lit("  x")).alias("lt"), Q.rtrim(F.lit("x  ")).alias("rt"), Q.lpad(s, 14, "*").alias("lp"), Q.rpad(s, 6, "*").alias("rp"), Q.repeat(F.lit("ab"), 3).alias("rep"), Q.length("c_name").cast("bigint").alias("n"), Q.reverse("c_name").alias("rev"), Q.ascii("c_name").alias("a"))


@query("customer", sql="""SELECT c_custkey, substr(c_name, 3, 5) AS s, left(c_name, 4) AS l, right(c_name, 3) AS r, instr(c_name, '#') AS i, instr(c_name, 'r') AS p, replace(c_name, '0', 'o') AS x, CASE WHEN instr(substr(c_name, 4), 'e') > 0 THEN instr(substr(c_name, 4), 'e') + 3 ELSE 0 END AS c FROM customer""")
def str_substring_position(customer):
    s = "c_name"
    return customer.select("c_custkey", Q.substring(s, 3, 5).alias("s"), Q.left(s, 4).alias("l"), Q.right(s, 3).alias("r"), Q.instr(s, "#").cast("bigint").alias("i"), Q.position("r", s).cast("bigint").alias("p"), Q.replace(s, "0", "o").alias("x"), Q.charindex("e", s, 4).cast("bigint").alias("c"))


@query("pages", sql=r"""SELECT page_id, regexp_extract(url, '://([^/:]+)', 1) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_extract(url, 'nothing', 0) AS none, url ILIKE '%HTTP%' AS web FROM pages""")
def str_regex(pages):
    return pages.select("page_id", Q.regexp_extract("url", "://([^/:]+)", 1).alias("host"), Q.regexp_replace("url", "[0-9]+", "#").alias("masked"), Q.regexp_extract("url", "nothing").alias("none"), F.col("url").ilike("%HTTP%").alias("web"))


@query("part", sql="SELECT p_partkey, len(string_split(p_name, ' ')) AS n, string_split(p_name, ' ')[1] AS first, replace(p_name, ' ', ',') AS flat FROM part")
def str_split_array(part):
    words = Q.split("p_name", " ")
    return part.select("p_partkey", F.size(words).cast("bigint").alias("n"), F.get(words, F.lit(0)).alias("first"), Q.split_flat("p_name", " ").alias("flat"))


@query("events", sql="SELECT event_id, concat_ws('-', nullif(event_type, 'view'), CAST(user_id AS VARCHAR)) AS joined, event_type || ':' || CAST(user_id AS VARCHAR) AS pair FROM events")
def str_concat_ws(events):
    user = F.col("user_id").cast("string")
    return events.select("event_id", Q.concat_ws("-", F.nullif("event_type", F.lit("view")), user).alias("joined"), Q.concat("event_type", F.lit(":"), user).alias("pair"))


@query("nation", sql="SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def str_levenshtein(nation):
    a, b = nation.selectExpr("n_name AS a", "n_regionkey AS k"), nation.selectExpr("n_name AS b", "n_regionkey AS k")
    return a.join(b, "k").select("a", "b", Q.levenshtein("a", "b").cast("bigint").alias("d"))


@query("customer", sql="SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2 FROM customer")
def str_hash(customer):
    return customer.select("c_custkey", Q.md5("c_name").alias("m"), Q.sha1("c_name").alias("s1"), Q.sha2("c_name", 256).alias("s2"))


@query("region", sql="SELECT * FROM (VALUES ('Robert', 'R163', 'Robert', 2125754577::BIGINT), ('', '', '', 0)) t(s, code, cap, crc)")
def str_soundex_initcap(region):
    rows = one_row(region).select(F.explode(F.array(F.lit("Robert"), F.lit(""))).alias("s"))
    return rows.select("s", Q.soundex("s").alias("code"), Q.initcap("s").alias("cap"), Q.crc32(F.col("s").cast("binary")).alias("crc"))


@query("orders", sql="SELECT o_orderkey, list_position(['F', 'O', 'P'], o_orderstatus) AS at, ['low', 'mid', 'high'][o_orderkey % 5] AS word FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey, list_position(['F', 'O', 'P'], o_orderstatus), NULL FROM orders WHERE o_orderkey % 5 = 0")
def str_find_in_set_elt(orders):
    return orders.select("o_orderkey", Q.find_in_set("o_orderstatus", F.lit("F,O,P")).alias("at"), Q.elt((F.col("o_orderkey") % 5), F.lit("low"), F.lit("mid"), F.lit("high")).alias("word"))


@query("pages", sql=r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def str_url_parts(pages):
    return pages.select("page_id", Q.parse_url("url", "PROTOCOL").alias("scheme"), Q.parse_url("url", "HOST").alias("host"), Q.parse_url("url", "PATH").alias("path"), Q.parse_url_key("url", "QUERY", "page").alias("page"))


@query("part", sql="SELECT p_partkey, printf('%05d|%s|%.2f', p_partkey, p_brand, p_retailprice) AS text, 8 * octet_length(encode(p_name)) AS bits FROM part")
def str_format(part):
    return part.select("p_partkey", Q.format_string("%05d|%s|%.2f", "p_partkey", "p_brand", "p_retailprice").alias("text"), Q.bit_length("p_name").cast("bigint").alias("bits"))


@query("orders", sql="""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, quarter(o_orderdate) AS q, dayofweek(o_orderdate) + 1 AS dow, isodow(o_orderdate) - 1 AS wd, dayofyear(o_orderdate) AS doy, week(o_orderdate) AS w, left(dayname(o_orderdate), 3) AS dn, left(monthname(o_orderdate), 3) AS mn FROM orders""")
def dt_parts(orders):
    d = "o_orderdate"
    whole = {"y": Q.year(d), "m": Q.month(d), "d": Q.day(d), "h": Q.hour(d), "q": Q.quarter(d), "dow": Q.dayofweek(d), "wd": Q.weekday(d), "doy": Q.dayofyear(d), "w": Q.weekofyear(d)}
    return orders.select("o_orderkey", *(c.cast("bigint").alias(n) for n, c in whole.items()), Q.dayname(d).alias("dn"), Q.monthname(d).alias("mn"))


@query("orders", sql="""SELECT o_orderkey, CAST(o_orderdate + INTERVAL 10 DAY AS DATE) AS a, CAST(o_orderdate - INTERVAL 3 DAY AS DATE) AS s, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS m FROM orders""")
def dt_arith(orders):
    d = F.col("o_orderdate").cast("date")
    return orders.select("o_orderkey", Q.date_add(d, 10).alias("a"), Q.date_sub(d, 3).alias("s"), Q.add_months(d, 1).alias("m"))


@query("orders", sql="""SELECT o_orderkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS y, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM orders""")
def dt_trunc(orders):
    d = F.col("o_orderdate").cast("date")
    return orders.select("o_orderkey", *(Q.trunc(d, u).alias(n) for n, u in (("y", "year"), ("q", "quarter"), ("m", "month"), ("w", "week"))))


@query("orders", sql="SELECT o_orderkey, date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)) AS d, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') // 7 AS w FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'")
def dt_diff(orders):
    d, to = F.col("o_orderdate").cast("date"), F.lit("1998-01-01").cast("date")
    kept = orders.where(F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz"))
    return kept.select("o_orderkey", Q.datediff(d, to).cast("bigint").alias("d"), Q.timestampdiff("WEEK", d, to).cast("bigint").alias("w"))


@query("region", sql="SELECT * FROM (VALUES ('2024-03-31', '2024-02-29', 1.0::DOUBLE, 1), ('2024-02-29', '2024-01-31', 1.0, 0), ('2024-05-15', '2024-01-01', 4.4516129, 4)) t(b, a, months, whole)")
def dt_months_between(region):
    pairs = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b, a in (("2024-03-31", "2024-02-29"), ("2024-02-29", "2024-01-31"), ("2024-05-15", "2024-01-01"))))
    rows = one_row(region).select(F.explode(pairs).alias("p")).select("p.*")
    return rows.select("b", "a", F.round(Q.months_between("b", "a"), 7).alias("months"), Q.timestampdiff("MONTH", F.to_date("a"), F.to_date("b")).cast("int").alias("whole"))


@query("orders", sql="""SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t FROM orders""")
def dt_epoch(orders):
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("o_orderdate"))
    day = F.col("o_orderdate").cast("date")
    return orders.select("o_orderkey", seconds.alias("s"), Q.unix_date(day).cast("bigint").alias("d"), Q.date_format(F.col("o_orderdate"), "YYYY-MM-DD HH24:MI:SS").alias("t"))


@query("orders", sql="SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS text, CAST(o_orderdate AS DATE) AS back, CAST(NULL AS DATE) AS bad FROM orders")
def dt_format_parse(orders):
    text = Q.date_format(F.col("o_orderdate"), "DD/MM/YYYY")
    return orders.select("o_orderkey", text.alias("text"), Q.to_date(text, "DD/MM/YYYY").alias("back"), Q.to_date(F.lit("no date")).alias("bad"))


@query("orders", sql="SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS last, CAST(o_orderdate AS DATE) + CAST(8 - isodow(o_orderdate) AS INTEGER) AS monday FROM orders")
def dt_next_last_day(orders):
    d = F.col("o_orderdate").cast("date")
    return orders.select("o_orderkey", Q.last_day(d).alias("last"), Q.next_day(d, "Mon").alias("monday"))


@query("region", sql="SELECT '2024-07-01 09:00:00' AS tokyo, '2024-06-30 20:00:00' AS new_york, '2024-07-01 04:00:00' AS back")
def dt_timezone(region):
    ts, shown = F.lit("2024-07-01 00:00:00").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"
    cells = {"tokyo": Q.from_utc_timestamp(ts, "Asia/Tokyo"), "new_york": Q.from_utc_timestamp(ts, "America/New_York"), "back": Q.to_utc_timestamp(ts, "America/New_York")}
    return one_row(region).select(*(F.date_format(c, shown).alias(n) for n, c in cells.items()))


@query("events", sql="""SELECT event_id, coalesce(k, 'none') AS a, coalesce(k, 'x') AS b, CASE WHEN k IS NOT NULL THEN 'set' ELSE 'unset' END AS c, k IS NULL AS d FROM (SELECT event_id, nullif(event_type, 'view') AS k FROM events)""")
def cond_coalesce_family(events):
    k = events.select("event_id", Q.nullif("event_type", "view").alias("k"))
    return k.select("event_id", Q.coalesce("k", F.lit("none")).alias("a"), Q.nvl("k", "x").alias("b"), Q.nvl2("k", "set", "unset").alias("c"), Q.isnull("k").alias("d"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax, nullif(l_tax, 0.0)) AS g, least(l_discount, l_tax) AS l FROM lineitem")
def cond_greatest_least(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", Q.greatest("l_discount", "l_tax", Q.nullif("l_tax", 0.0)).alias("g"), Q.least("l_discount", "l_tax").alias("l"))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS n, coalesce(nullif(l_tax, 0), 0) AS z FROM lineitem")
def cond_nullif_zero(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", Q.nullifzero("l_tax").alias("n"), Q.zeroifnull(Q.nullifzero("l_tax")).alias("z"))
