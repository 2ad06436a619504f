"""One query for each scalar function: the key of a table and the function's value ``v``, over all rows of the table."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import arithmetic as A
from weftline.functions import arrays as R
from weftline.functions import bitwise as B
from weftline.functions import casts as C
from weftline.functions import comparison as P
from weftline.functions import dates as D
from weftline.functions import hashing as H
from weftline.functions import jsons as J
from weftline.functions import lambdas as L
from weftline.functions import maps as M
from weftline.functions import mathematics as X
from weftline.functions import plumbing as N
from weftline.functions import strings as S
from weftline.functions import timestamps as T
from weftline.functions import variants as V
from weftline.functions import xpaths as W

KEYS = {"part": "p_partkey", "customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "embeddings": "vec_id", "pages": "page_id"}
#: Spark type of ``v`` and DuckDB's name for it.
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
Spec = tuple[str, str, str, Callable[[], Column], str | None]

c = F.col
size, price, bal = partial(c, "p_size"), partial(c, "p_retailprice"), partial(c, "c_acctbal")
day = lambda: c("o_orderdate").cast("date")
xs = lambda: F.transform(F.sequence(F.lit(1), size() % 5 + 1), lambda i: (i * size()) % 7)
XS = "list_transform(range(1, p_size % 5 + 2), lambda i: (i * p_size) % 7)"
ys = lambda: F.array(F.lit(1), F.lit(3), size() % 4)
YS = "[1, 3, p_size % 4]"
m = lambda: F.create_map(F.lit("a"), size(), F.lit("b"), size() * 2)
opt = lambda: F.when(size() % 3 != 0, size())
OPT = "(CASE WHEN p_size % 3 <> 0 THEN p_size END)"
xml = lambda: F.concat(F.lit("<a><b>"), size().cast("string"), F.lit("</b><b>7</b></a>"))
maybe_xml = lambda: F.when(size() % 2 == 0, xml()).otherwise(F.lit("<a><b>"))
text = lambda: F.concat(F.lit(" "), c("p_type"), F.lit(" x,"), c("p_brand"), F.lit(",x "))
TEXT = "(' ' || p_type || ' x,' || p_brand || ',x ')"


def joined(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ",", "null"), F.lit("]"))


def sql_list(e: str) -> str:
    return f"'[' || array_to_string(list_transform({e}, lambda e: coalesce(e::VARCHAR, 'null')), ',') || ']'"


SPECS: list[Spec] = [
    # A, B, D
    ("cell", "part", "bigint", lambda: N.cell("p_size"), "p_size"),
    ("const", "part", "string", lambda: N.const("x"), "'x'"),
    ("named", "part", "bigint", lambda: N.named(size(), "z"), "p_size"),
    ("lambda_var", "part", "string", lambda: joined(L.transform(xs(), lambda x: x)), sql_list(XS)),
    ("struct_get_field", "part", "bigint", lambda: N.get_field(N.struct(a=size(), b=price()), "a"), "p_size"),
    ("add_int", "part", "bigint", lambda: A.add_int(size(), F.lit(3)), "p_size + 3"),
    ("sub_int", "part", "bigint", lambda: A.sub_int(size(), F.lit(30)), "p_size - 30"),
    ("mul_int", "part", "bigint", lambda: A.mul_int(size(), size()), "p_size * p_size"),
    ("div_int", "part", "bigint", lambda: A.div_int(size() - 25, F.lit(4)), "(p_size - 25) // 4"),
    ("add_long", "part", "bigint", lambda: A.add_long("p_partkey", "p_partkey"), "p_partkey + p_partkey"),
    ("sub_long", "part", "bigint", lambda: A.sub_long("p_partkey", F.lit(9)), "p_partkey - 9"),
    ("mul_long", "part", "bigint", lambda: A.mul_long("p_partkey", "p_size"), "p_partkey * p_size"),
    ("div_long", "part", "bigint", lambda: A.div_long("p_partkey", F.lit(7)), "p_partkey // 7"),
    ("add_double", "part", "double", lambda: A.add_double(price(), F.lit(0.5)), "p_retailprice + 0.5"),
    ("sub_double", "part", "double", lambda: A.sub_double(price(), F.lit(0.25)), "p_retailprice - 0.25"),
    ("mul_double", "part", "double", lambda: A.mul_double(price(), size()), "p_retailprice * p_size"),
    ("div_double", "part", "double", lambda: A.div_double(price(), F.lit(3.0)), "p_retailprice / 3.0"),
    ("mod_int", "part", "bigint", lambda: A.mod_int(size() - 25, F.lit(7)), "(p_size - 25) % 7"),
    ("mod_long", "part", "bigint", lambda: A.mod_long("p_partkey", F.lit(11)), "p_partkey % 11"),
    ("pmod_int", "part", "bigint", lambda: A.pmod_int(size() - 25, F.lit(7)), "((p_size - 25) % 7 + 7) % 7"),
    ("pmod_long", "part", "bigint", lambda: A.pmod_long(-c("p_partkey"), F.lit(11)), "((-p_partkey) % 11 + 11) % 11"),
    ("abs_int", "part", "bigint", lambda: A.abs_int(size() - 25), "abs(p_size - 25)"),
    ("abs_long", "part", "bigint", lambda: A.abs_long(F.lit(100) - c("p_partkey")), "abs(100 - p_partkey)"),
    ("abs_double", "customer", "double", lambda: A.abs_double(bal()), "abs(c_acctbal)"),
    ("negate_int", "part", "bigint", lambda: A.negate_int(size()), "-p_size"),
    ("negate_long", "part", "bigint", lambda: A.negate_long("p_partkey"), "-p_partkey"),
    ("negate_double", "customer", "double", lambda: A.negate_double(bal()), "-c_acctbal"),
    ("try_add_int", "part", "bigint", lambda: A.try_add_int(size(), F.lit(2147483600)), "CASE WHEN p_size + 2147483600 <= 2147483647 THEN p_size + 2147483600 END"),
    ("try_add_long", "part", "bigint", lambda: A.try_add_long("p_partkey", F.lit(9223372036854774807)), "CASE WHEN p_partkey <= 1000 THEN p_partkey + 9223372036854774807 END"),
    ("try_subtract_long", "part", "bigint", lambda: A.try_subtract_long(-c("p_partkey"), F.lit(9223372036854774807)), "CASE WHEN p_partkey <= 1001 THEN -p_partkey - 9223372036854774807 END"),
    ("try_multiply_long", "part", "bigint", lambda: A.try_multiply_long("p_partkey", F.lit(9223372036854775)), "CASE WHEN p_partkey <= 1000 THEN p_partkey * 9223372036854775 END"),
    ("try_divide_long", "part", "double", lambda: A.try_divide_long("p_partkey", (size() % 3).cast("bigint")), "CASE WHEN p_size % 3 <> 0 THEN p_partkey::DOUBLE / (p_size % 3) END"),
    ("try_divide_double", "part", "double", lambda: A.try_divide_double(price(), (size() % 3).cast("double")), "CASE WHEN p_size % 3 <> 0 THEN p_retailprice / (p_size % 3) END"),
    ("cast_to_long", "part", "bigint", lambda: C.to_long(size()), "p_size"),
    ("cast_to_double", "part", "double", lambda: C.to_double(size()), "p_size"),
    ("cast_long_to_double", "part", "double", lambda: C.long_to_double("p_partkey"), "p_partkey"),
    ("cast_to_string", "part", "string", lambda: C.to_string("p_partkey"), "p_partkey"),
    # C
    ("gt", "part", "boolean", lambda: P.gt(opt(), 20), f"{OPT} > 20"),
    ("gte", "part", "boolean", lambda: P.gte(opt(), 20), f"{OPT} >= 20"),
    ("lt", "part", "boolean", lambda: P.lt(opt(), 20), f"{OPT} < 20"),
    ("lte", "part", "boolean", lambda: P.lte(opt(), 20), f"{OPT} <= 20"),
    ("eq", "part", "boolean", lambda: P.eq(opt(), 20), f"{OPT} = 20"),
    ("neq", "part", "boolean", lambda: P.neq(opt(), 20), f"{OPT} <> 20"),
    ("and", "part", "boolean", lambda: P.and_(P.gt(opt(), 20), P.gt(size(), 25)), f"{OPT} > 20 AND p_size > 25"),
    ("or", "part", "boolean", lambda: P.or_(P.gt(opt(), 20), P.gt(size(), 25)), f"{OPT} > 20 OR p_size > 25"),
    ("not", "part", "boolean", lambda: P.not_(P.gt(opt(), 20)), f"NOT ({OPT} > 20)"),
    ("when", "part", "string", lambda: P.when(P.gt(opt(), 20), "big", "small"), f"CASE WHEN {OPT} > 20 THEN 'big' ELSE 'small' END"),
    ("is_null", "part", "boolean", lambda: P.is_null(opt()), f"{OPT} IS NULL"),
    ("is_not_null", "part", "boolean", lambda: P.is_not_null(opt()), f"{OPT} IS NOT NULL"),
    ("is_defined", "part", "boolean", lambda: P.is_defined(opt()), f"{OPT} IS NOT NULL"),
    ("get_or_else", "part", "bigint", lambda: P.get_or_else(opt(), -1), f"coalesce({OPT}, -1)"),
    ("option_as_array", "part", "string", lambda: joined(P.as_array(opt())), f"CASE WHEN {OPT} IS NULL THEN '[]' ELSE '[' || {OPT} || ']' END"),
    ("coalesce", "part", "bigint", lambda: P.coalesce(opt(), F.when(size() % 2 == 0, size() * 2)), f"coalesce({OPT}, CASE WHEN p_size % 2 = 0 THEN p_size * 2 END)"),
    ("in", "part", "boolean", lambda: P.in_(opt(), [1, 2, 4]), f"{OPT} IN (1, 2, 4)"),
    ("between", "part", "boolean", lambda: P.between(opt(), 10, 20), f"{OPT} BETWEEN 10 AND 20"),
    ("greatest", "part", "bigint", lambda: P.greatest(opt(), F.lit(20)), f"greatest({OPT}, 20)"),
    ("least", "part", "bigint", lambda: P.least(opt(), F.lit(20)), f"least({OPT}, 20)"),
    ("null_if", "part", "bigint", lambda: P.null_if(size(), 20), "nullif(p_size, 20)"),
    ("if_null", "part", "bigint", lambda: P.if_null(opt(), 0), f"ifnull({OPT}, 0)"),
    ("nvl2", "part", "string", lambda: P.nvl2(opt(), "some", "none"), f"CASE WHEN {OPT} IS NOT NULL THEN 'some' ELSE 'none' END"),
    ("nanvl", "part", "double", lambda: P.nanvl(F.when(size() > 20, F.lit(float("nan"))).otherwise(price()), price() * 2), "CASE WHEN p_size > 20 THEN p_retailprice * 2 ELSE p_retailprice END"),
    # E
    ("round", "part", "double", lambda: X.round_(price(), 1), "round(p_retailprice, 1)"),
    ("bround", "part", "double", lambda: X.bround(size() / 2, 0), "round_even(p_size / 2, 0)"),
    ("floor", "customer", "double", lambda: X.floor(bal()), "floor(c_acctbal)"),
    ("ceil", "customer", "double", lambda: X.ceil(bal()), "ceil(c_acctbal)"),
    ("sqrt", "part", "double", lambda: X.sqrt(price()), "sqrt(p_retailprice)"),
    ("cbrt", "part", "double", lambda: X.cbrt(price()), "cbrt(p_retailprice)"),
    ("pow", "part", "double", lambda: X.pow_(size(), F.lit(1.5)), "pow(p_size, 1.5)"),
    ("hypot", "part", "double", lambda: X.hypot(size(), price()), "sqrt(p_size * p_size + p_retailprice * p_retailprice)"),
    ("log", "part", "double", lambda: X.log(price()), "ln(p_retailprice)"),
    ("log10", "part", "double", lambda: X.log10(price()), "log10(p_retailprice)"),
    ("log2", "part", "double", lambda: X.log2(price()), "log2(p_retailprice)"),
    ("log1p", "part", "double", lambda: X.log1p(price()), "ln(1 + p_retailprice)"),
    ("exp", "part", "double", lambda: X.exp(size() / 10), "exp(p_size / 10)"),
    ("expm1", "part", "double", lambda: X.expm1(size() / 10), "exp(p_size / 10) - 1"),
    *[(n, "part", "double", partial(lambda fn: fn(size() / 100), getattr(X, n)), f"{n}(p_size / 100)") for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh", "degrees", "radians")],
    ("acosh", "part", "double", lambda: X.acosh(size() + 1), "acosh(p_size + 1)"),
    ("atan2", "part", "double", lambda: X.atan2(size(), price()), "atan2(p_size, p_retailprice)"),
    ("signum", "customer", "double", lambda: X.signum(bal()), "sign(c_acctbal)"),
    ("pi", "part", "double", lambda: X.pi(), "pi()"),
    ("euler", "part", "double", lambda: X.euler(), "exp(1)"),
    ("factorial", "part", "bigint", lambda: X.factorial(size() % 15), "factorial((p_size % 15)::INTEGER)"),
    ("bin", "part", "string", lambda: X.bin_("p_partkey"), "bin(p_partkey)"),
    ("conv", "part", "string", lambda: X.conv(c("p_partkey").cast("string"), 10, 16), "upper(hex(p_partkey))"),
    ("width_bucket", "part", "bigint", lambda: X.width_bucket(price(), F.lit(900.0), F.lit(1100.0), F.lit(10)), "CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 1100 THEN 11 ELSE floor((p_retailprice - 900) / 20) + 1 END"),
    ("rand", "part", "boolean", lambda: (X.rand(7) >= 0) & (X.rand(7) < 1) & (X.rand(7) == X.rand(7)) & (X.rand(7) != X.rand(8)), "true"),
    ("randn", "part", "boolean", lambda: (F.abs(X.randn(7)) < 10) & (X.randn(7) == X.randn(7)) & (X.randn(7) != X.randn(8)), "true"),
    # F
    ("bit_count", "part", "bigint", lambda: B.bit_count(size()), "bit_count(p_size)"),
    ("bit_get", "part", "bigint", lambda: B.bit_get(size(), 2), "(p_size >> 2) & 1"),
    ("shift_left", "part", "bigint", lambda: B.shift_left(size(), size() % 5), "p_size << (p_size % 5)"),
    ("shift_right", "part", "bigint", lambda: B.shift_right(size(), 2), "p_size >> 2"),
    ("shift_right_unsigned", "part", "bigint", lambda: B.shift_right_unsigned(-size(), 1), "(4294967296 - p_size) >> 1"),
    ("bitwise_not", "part", "bigint", lambda: B.bitwise_not(size()), "~p_size"),
    # G
    ("concat", "part", "string", lambda: S.concat("p_brand", "p_type"), "p_brand || p_type"),
    ("concat_ws", "part", "string", lambda: S.concat_ws("-", c("p_brand"), opt().cast("string"), c("p_type")), f"concat_ws('-', p_brand, {OPT}::VARCHAR, p_type)"),
    ("length", "part", "bigint", lambda: S.length("p_name"), "length(p_name)"),
    ("like", "part", "boolean", lambda: S.like("p_type", "%M%"), "p_type LIKE '%M%'"),
    ("rlike", "part", "boolean", lambda: S.rlike("p_type", "^[MP]"), "regexp_matches(p_type, '^[MP]')"),
    ("lower", "part", "string", lambda: S.lower("p_type"), "lower(p_type)"),
    ("upper", "part", "string", lambda: S.upper("p_name"), "upper(p_name)"),
    ("initcap", "part", "string", lambda: S.initcap("p_type"), "upper(p_type[1]) || lower(p_type[2:])"),
    ("trim", "part", "string", lambda: S.trim(text()), f"trim({TEXT})"),
    ("ltrim", "part", "string", lambda: S.ltrim(text()), f"ltrim({TEXT})"),
    ("rtrim", "part", "string", lambda: S.rtrim(text()), f"rtrim({TEXT})"),
    ("substring", "part", "string", lambda: S.substring("p_type", 2, 3), "substring(p_type, 2, 3)"),
    ("substring_index", "part", "string", lambda: S.substring_index(text(), ",", 2), f"array_to_string(string_split({TEXT}, ',')[1:2], ',')"),
    ("left", "part", "string", lambda: S.left("p_type", 3), "left(p_type, 3)"),
    ("right", "part", "string", lambda: S.right("p_type", 3), "right(p_type, 3)"),
    ("repeat", "part", "string", lambda: S.repeat("p_type", size() % 3), "repeat(p_type, p_size % 3)"),
    ("reverse", "part", "string", lambda: S.reverse("p_type"), "reverse(p_type)"),
    ("lpad", "part", "string", lambda: S.lpad("p_type", 6, "*"), "lpad(p_type, 6, '*')"),
    ("rpad", "part", "string", lambda: S.rpad("p_type", 6, "*"), "rpad(p_type, 6, '*')"),
    ("translate", "part", "string", lambda: S.translate("p_type", "AEO", "xyz"), "translate(p_type, 'AEO', 'xyz')"),
    ("replace", "part", "string", lambda: S.replace("p_type", "O", "$0"), "replace(p_type, 'O', '$0')"),
    ("regexp_replace", "part", "string", lambda: S.regexp_replace("p_type", "[AEIOU]+", "-"), "regexp_replace(p_type, '[AEIOU]+', '-', 'g')"),
    ("regexp_extract", "part", "string", lambda: S.regexp_extract("p_type", "([A-Z])O", 1), "regexp_extract(p_type, '([A-Z])O', 1)"),
    ("regexp_extract_all", "part", "string", lambda: joined(S.regexp_extract_all("p_type", "([A-Z])[AEO]", 1)), sql_list("regexp_extract_all(p_type, '([A-Z])[AEO]', 1)")),
    ("split", "part", "string", lambda: joined(S.split(text(), ",")), sql_list(f"string_split({TEXT}, ',')")),
    ("split_part", "part", "string", lambda: S.split_part(text(), ",", 2), f"split_part({TEXT}, ',', 2)"),
    ("starts_with", "part", "boolean", lambda: S.starts_with("p_type", "P"), "starts_with(p_type, 'P')"),
    ("ends_with", "part", "boolean", lambda: S.ends_with("p_type", "O"), "ends_with(p_type, 'O')"),
    ("contains", "part", "boolean", lambda: S.contains("p_type", "ON"), "contains(p_type, 'ON')"),
    ("instr", "part", "bigint", lambda: S.instr("p_type", "O"), "instr(p_type, 'O')"),
    ("ascii", "part", "bigint", lambda: S.ascii_("p_type"), "ascii(p_type)"),
    ("chr", "part", "string", lambda: S.chr_(size() + 64), "chr((p_size + 64)::INTEGER)"),
    ("levenshtein", "part", "bigint", lambda: S.levenshtein("p_type", F.lit("PROMO")), "levenshtein(p_type, 'PROMO')"),
    ("format_string", "part", "string", lambda: S.format_string("%s/%05d", "p_type", "p_size"), "format('{}/{:05d}', p_type, p_size)"),
    ("number_to_char", "part", "string", lambda: S.number_to_char(size(), "000"), "lpad(p_size::VARCHAR, 3, '0')"),
    ("parse_url", "pages", "string", lambda: S.parse_url("url", "HOST"), "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"),
    # H
    ("md5", "part", "string", lambda: H.md5(c("p_name")), "md5(p_name)"),
    ("sha1", "part", "string", lambda: H.sha1(c("p_name")), "sha1(p_name)"),
    ("sha2", "part", "string", lambda: H.sha2("p_name", 256), "sha256(p_name)"),
    ("crc32", "part", "bigint", lambda: H.crc32(F.lit("123456789")), "3421780262"),
    ("xxhash64", "part", "bigint", lambda: H.xxhash64(F.lit(None).cast("string")), "42"),
    ("hash", "part", "bigint", lambda: H.hash_(F.lit(None).cast("string")), "42"),
    ("aes_round_trip", "part", "string", lambda: H.aes_decrypt(H.aes_encrypt("p_name", "0123456789abcdef"), "0123456789abcdef"), "p_name"),
    ("try_aes_decrypt", "part", "string", lambda: H.try_aes_decrypt(F.encode("p_name", "utf-8"), "0123456789abcdef"), "NULL"),
    ("url_encode", "part", "string", lambda: H.url_encode(text()), f"replace(replace(replace({TEXT}, '#', '%23'), ',', '%2C'), ' ', '+')"),
    ("url_decode", "part", "string", lambda: H.url_decode(H.url_encode(text())), TEXT),
    ("base64_encode", "part", "string", lambda: H.base64_encode(c("p_name")), "base64(encode(p_name))"),
    ("base64_decode", "part", "string", lambda: H.base64_decode(H.base64_encode(c("p_name"))), "p_name"),
    ("hex", "part", "string", lambda: H.hex_(c("p_name")), "hex(encode(p_name))"),
    ("unhex", "part", "string", lambda: H.unhex(H.hex_(c("p_name"))).cast("string"), "p_name"),
    # I
    ("date_add_days", "orders", "date", lambda: D.add_days(day(), F.lit(40)), "o_orderdate::DATE + 40"),
    ("date_sub_days", "orders", "date", lambda: D.sub_days(day(), F.lit(40)), "o_orderdate::DATE - 40"),
    ("date_add_months", "orders", "date", lambda: D.add_months(day(), 5), "(o_orderdate::DATE + INTERVAL 5 MONTH)::DATE"),
    ("date_diff", "orders", "bigint", lambda: D.date_diff(day(), F.lit("1995-01-01").cast("date")), "o_orderdate::DATE - DATE '1995-01-01'"),
    *[(f"extract_{n}", "orders", "bigint", partial(lambda fn: fn(day()), getattr(D, n)), f"{q}(o_orderdate)") for n, q in (("year", "year"), ("month", "month"), ("day", "day"), ("day_of_year", "dayofyear"), ("week_of_year", "weekofyear"), ("quarter", "quarter"))],
    ("day_of_week", "orders", "bigint", lambda: D.day_of_week(day()), "dayofweek(o_orderdate) + 1"),
    ("weekday", "orders", "bigint", lambda: D.weekday(day()), "isodow(o_orderdate) - 1"),
    ("last_day", "orders", "date", lambda: D.last_day(day()), "last_day(o_orderdate::DATE)"),
    ("next_day", "orders", "date", lambda: D.next_day(day(), "Mon"), "o_orderdate::DATE + (8 - isodow(o_orderdate))::INTEGER"),
    ("months_between", "orders", "double", lambda: D.months_between(D.add_months(D.date_trunc("month", day()), 3), D.date_trunc("month", day())), "3"),
    ("date_trunc", "orders", "date", lambda: D.date_trunc("month", day()), "date_trunc('month', o_orderdate)::DATE"),
    ("date_format", "orders", "string", lambda: D.date_format(day(), "yyyy/MM/dd"), "strftime(o_orderdate, '%Y/%m/%d')"),
    ("make_date", "part", "date", lambda: D.make_date(F.lit(2020), size() % 12 + 1, size() % 28 + 1), "make_date(2020, (p_size % 12 + 1)::BIGINT, (p_size % 28 + 1)::BIGINT)"),
    ("to_date", "orders", "date", lambda: D.to_date(D.date_format(day(), "yyyy-MM-dd")), "o_orderdate::DATE"),
    ("current_date", "part", "boolean", lambda: (D.current_date() == T.now().cast("date")) & (F.abs(F.datediff(D.current_date(), F.lit(datetime.date.today()))) <= 1), "true"),
    # J
    ("unix_timestamp", "events", "bigint", lambda: T.unix_timestamp("ts"), "floor(epoch(ts))"),
    ("from_unixtime", "part", "string", lambda: T.from_unixtime(c("p_partkey") * 1000), "strftime(to_timestamp(p_partkey * 1000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"),
    ("to_timestamp", "orders", "timestamp_ntz", lambda: T.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")), "date_trunc('second', o_orderdate)"),
    ("now", "part", "boolean", lambda: F.abs(T.unix_timestamp(T.now()) - F.lit(int(time.time()))) < 3600, "true"),
    ("timestamp_seconds", "part", "timestamp_ntz", lambda: T.timestamp_seconds(c("p_partkey") + 0.5), "make_timestamp(p_partkey * 1000000 + 500000)"),
    ("timestamp_millis", "part", "timestamp_ntz", lambda: T.timestamp_millis(c("p_partkey")), "make_timestamp(p_partkey * 1000)"),
    ("timestamp_micros", "part", "timestamp_ntz", lambda: T.timestamp_micros(c("p_partkey")), "make_timestamp(p_partkey)"),
    ("make_timestamp", "part", "timestamp_ntz", lambda: T.make_timestamp(F.lit(2020), F.lit(2), F.lit(29), size() % 24, F.lit(30), F.lit(15.5)), "make_timestamp(2020, 2, 29, (p_size % 24)::BIGINT, 30, 15.5)"),
    ("make_dt_interval", "part", "timestamp_ntz", lambda: F.lit("2020-01-01").cast("timestamp_ntz") + T.make_dt_interval(F.lit(1), size() % 24, F.lit(2), F.lit(3.0)), "TIMESTAMP '2020-01-01' + INTERVAL 1 DAY + to_hours((p_size % 24)::BIGINT) + INTERVAL 2 MINUTE + INTERVAL 3 SECOND"),
    ("make_ym_interval", "part", "timestamp_ntz", lambda: F.lit("2020-01-31").cast("timestamp_ntz") + T.make_ym_interval(F.lit(1), size() % 12), "TIMESTAMP '2020-01-31' + to_months((12 + p_size % 12)::INTEGER)"),
    ("hour", "events", "bigint", lambda: T.hour("ts"), "hour(ts)"),
    ("minute", "events", "bigint", lambda: T.minute("ts"), "minute(ts)"),
    ("second", "events", "bigint", lambda: T.second("ts"), "second(ts)"),
    ("from_utc_timestamp", "part", "timestamp_ntz", lambda: T.from_utc_timestamp(T.timestamp_seconds(c("p_partkey")), "+02:00"), "make_timestamp((p_partkey + 7200) * 1000000)"),
    ("to_utc_timestamp", "part", "timestamp_ntz", lambda: T.to_utc_timestamp(T.timestamp_seconds(c("p_partkey")), "+02:00"), "make_timestamp((p_partkey - 7200) * 1000000)"),
    ("convert_timezone", "part", "timestamp_ntz", lambda: T.convert_timezone(T.timestamp_seconds(c("p_partkey")).cast("timestamp_ntz"), "UTC", "Asia/Tokyo"), "make_timestamp((p_partkey + 32400) * 1000000)"),
    ("timestamp_add", "events", "timestamp_ntz", lambda: T.timestamp_add("HOUR", F.lit(30), c("ts")), "ts + INTERVAL 30 HOUR"),
    ("timestamp_diff", "events", "bigint", lambda: T.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), c("ts")), "date_sub('hour', TIMESTAMP '2024-01-01', ts)"),
    ("time_bucket", "events", "timestamp_ntz", lambda: T.time_bucket(900_000_000, "ts"), "time_bucket(INTERVAL 15 MINUTE, ts)"),
    # K
    ("array_size", "part", "bigint", lambda: R.array_size(xs()), f"len({XS})"),
    ("array_contains", "part", "boolean", lambda: R.array_contains(xs(), 3), f"list_contains({XS}, 3)"),
    ("array_sort", "part", "string", lambda: joined(R.array_sort(xs())), sql_list(f"list_sort({XS})")),
    ("array_sort_comparator", "part", "string", lambda: joined(L.array_sort_comparator(xs(), lambda a, b: (b - a).cast("int"))), sql_list(f"list_reverse_sort({XS})")),
    ("array_distinct", "part", "string", lambda: joined(R.array_sort(R.array_distinct(xs()))), sql_list(f"list_sort(list_distinct({XS}))")),
    ("array_union", "part", "string", lambda: joined(R.array_sort(R.array_union(xs(), ys()))), sql_list(f"list_sort(list_distinct(list_concat({XS}, {YS})))")),
    ("array_intersect", "part", "string", lambda: joined(R.array_sort(R.array_intersect(xs(), ys()))), sql_list(f"list_sort(list_distinct(list_filter({XS}, lambda x: list_contains({YS}, x))))")),
    ("array_except", "part", "string", lambda: joined(R.array_sort(R.array_except(xs(), ys()))), sql_list(f"list_sort(list_distinct(list_filter({XS}, lambda x: NOT list_contains({YS}, x))))")),
    ("arrays_overlap", "part", "boolean", lambda: R.arrays_overlap(xs(), ys()), f"list_has_any({XS}, {YS})"),
    ("flatten", "part", "string", lambda: joined(R.flatten(F.array(xs(), ys()))), sql_list(f"list_concat({XS}, {YS})")),
    ("element_at", "part", "bigint", lambda: R.element_at(xs(), 3), f"({XS})[3]"),
    ("get_array", "part", "bigint", lambda: R.get(xs(), 2), f"({XS})[3]"),
    ("array_slice", "part", "string", lambda: joined(R.array_slice(xs(), 2, 2)), sql_list(f"({XS})[2:3]")),
    ("array_append", "part", "string", lambda: joined(R.array_append(xs(), 9)), sql_list(f"list_append({XS}, 9)")),
    ("array_prepend", "part", "string", lambda: joined(R.array_prepend(xs(), 9)), sql_list(f"list_prepend(9, {XS})")),
    ("array_insert", "part", "string", lambda: joined(R.array_insert(xs(), 1, 9)), sql_list(f"list_prepend(9, {XS})")),
    ("array_remove", "part", "string", lambda: joined(R.array_remove(xs(), 3)), sql_list(f"list_filter({XS}, lambda x: x <> 3)")),
    ("array_repeat", "part", "string", lambda: joined(R.array_repeat(size(), 3)), sql_list("[p_size, p_size, p_size]")),
    ("array_join", "part", "string", lambda: R.array_join(F.array(c("p_type"), F.lit(None), c("p_brand")), "|", "?"), "p_type || '|?|' || p_brand"),
    ("array_max", "part", "bigint", lambda: R.array_max(xs()), f"list_max({XS})"),
    ("array_min", "part", "bigint", lambda: R.array_min(xs()), f"list_min({XS})"),
    ("array_compact", "part", "string", lambda: joined(R.array_compact(F.array(size(), opt()))), sql_list(f"list_filter([p_size, {OPT}], lambda x: x IS NOT NULL)")),
    ("array_position", "part", "bigint", lambda: R.array_position(xs(), 3), f"coalesce(list_position({XS}, 3), 0)"),
    ("arrays_zip", "part", "string", lambda: joined(F.transform(R.arrays_zip(F.array(size()).alias("a"), F.array(size() * 2).alias("b")), lambda x: F.concat_ws(":", *[x.getField(i).cast("string") for i in ("a", "b")]))), "'[' || p_size || ':' || p_size * 2 || ']'"),
    # L
    ("map_keys", "part", "string", lambda: joined(M.map_keys(m())), "'[a,b]'"),
    ("map_values", "part", "string", lambda: joined(M.map_values(m())), sql_list("[p_size, p_size * 2]")),
    ("map_contains_key", "part", "boolean", lambda: M.map_contains_key(m(), "a"), "true"),
    ("map_entries", "part", "string", lambda: joined(F.transform(M.map_entries(m()), lambda e: F.concat(e["key"], e["value"].cast("string")))), sql_list("['a' || p_size, 'b' || p_size * 2]")),
    ("map_from_arrays", "part", "bigint", lambda: F.element_at(M.map_from_arrays(F.array(F.lit("x"), F.lit("y")), F.array(size(), size() + 1)), "y"), "p_size + 1"),
    ("map_from_entries", "part", "bigint", lambda: F.element_at(M.map_from_entries(M.map_entries(m())), "b"), "p_size * 2"),
    ("map_concat", "part", "string", lambda: joined(M.map_values(M.map_concat(m(), F.create_map(F.lit("z"), F.lit(1))))), sql_list("[p_size, p_size * 2, 1]")),
    # M
    ("transform", "part", "string", lambda: joined(L.transform(xs(), lambda x, i: x * 10 + i)), sql_list(f"list_transform({XS}, lambda x, i: x * 10 + i - 1)")),
    ("filter_array", "part", "string", lambda: joined(L.filter_(xs(), lambda x: x % 2 == 0)), sql_list(f"list_filter({XS}, lambda x: x % 2 = 0)")),
    ("exists", "part", "boolean", lambda: L.exists(xs(), lambda x: x == 4), f"list_contains({XS}, 4)"),
    ("for_all", "part", "boolean", lambda: L.for_all(xs(), lambda x: x < 6), f"list_max({XS}) < 6"),
    ("aggregate_array", "part", "bigint", lambda: L.aggregate(xs(), F.lit(0).cast("int"), lambda a, x: (a + x).cast("int"), lambda a: a * 2), f"list_sum({XS}) * 2"),
    ("zip_with", "part", "string", lambda: joined(L.zip_with(F.array(size(), size()), F.array(F.lit(1)), lambda a, b: a + b)), "'[' || p_size + 1 || ',null]'"),
    ("map_filter", "part", "string", lambda: joined(M.map_keys(L.map_filter(m(), lambda k, v: v > 40))), "CASE WHEN p_size > 40 THEN '[a,b]' WHEN p_size > 20 THEN '[b]' ELSE '[]' END"),
    ("map_zip_with", "part", "string", lambda: joined(M.map_values(L.map_zip_with(m(), m(), lambda k, a, b: a + b))), sql_list("[p_size * 2, p_size * 4]")),
    ("transform_keys", "part", "string", lambda: joined(M.map_keys(L.transform_keys(m(), lambda k, v: F.upper(k)))), "'[A,B]'"),
    ("transform_values", "part", "string", lambda: joined(M.map_values(L.transform_values(m(), lambda k, v: v + 1))), sql_list("[p_size + 1, p_size * 2 + 1]")),
    # N
    ("get_json_object", "events", "string", lambda: J.get_json_object("props", "$.k"), "json_extract_string(props, '$.k')"),
    ("json_tuple", "events", "string", lambda: joined(J.json_tuple("props", "k", "none")), "'[' || json_extract_string(props, '$.k') || ',null]'"),
    ("from_json", "events", "bigint", lambda: J.from_json("props", "k int")["k"], "json_extract_string(props, '$.k')::BIGINT"),
    ("to_json", "part", "string", lambda: J.to_json(F.struct(size().alias("a"), opt().alias("b"))), f"CASE WHEN {OPT} IS NULL THEN '{{\"a\":' || p_size || '}}' ELSE '{{\"a\":' || p_size || ',\"b\":' || {OPT} || '}}' END"),
    ("schema_of_json", "part", "string", lambda: J.schema_of_json('{"a": 1}'), "'STRUCT<a: BIGINT>'"),
    ("json_array_length", "part", "bigint", lambda: J.json_array_length(F.concat(F.lit('{"x": '), F.to_json(xs()), F.lit("}")), "$.x"), f"len({XS})"),
    ("json_object_keys", "events", "string", lambda: joined(J.json_object_keys("props")), sql_list("json_keys(props)")),
    # O
    ("xpath", "part", "string", lambda: joined(W.xpath(xml(), "a/b/text()")), "'[' || p_size || ',7]'"),
    ("xpath_string", "part", "string", lambda: W.xpath_string(xml(), "a/b"), "p_size"),
    ("xpath_boolean", "part", "boolean", lambda: W.xpath_boolean(xml(), "a/b = 20"), "p_size = 20"),
    *[(f"xpath_{n}", "part", k, partial(lambda fn: fn(xml(), "sum(a/b)"), getattr(W, f"xpath_{n}")), "p_size + 7") for n, k in (("short", "bigint"), ("int", "bigint"), ("long", "bigint"), ("float", "double"), ("double", "double"))],
    ("try_xpath", "part", "string", lambda: joined(W.try_xpath(maybe_xml(), "a/b/text()")), "CASE WHEN p_size % 2 = 0 THEN '[' || p_size || ',7]' END"),
    ("try_xpath_string", "part", "string", lambda: W.try_xpath_string(maybe_xml(), "a/b"), "CASE WHEN p_size % 2 = 0 THEN p_size END"),
    ("try_xpath_boolean", "part", "boolean", lambda: W.try_xpath_boolean(maybe_xml(), "a/b = 20"), "CASE WHEN p_size % 2 = 0 THEN p_size = 20 END"),
    *[(f"try_xpath_{n}", "part", k, partial(lambda fn: fn(maybe_xml(), "sum(a/b)"), getattr(W, f"try_xpath_{n}")), "CASE WHEN p_size % 2 = 0 THEN p_size + 7 END") for n, k in (("short", "bigint"), ("int", "bigint"), ("long", "bigint"), ("float", "double"), ("double", "double"))],
    # P
    ("parse_json", "events", "string", lambda: V.variant_get(V.parse_json("props"), "$.k", "string"), "json_extract_string(props, '$.k')"),
    ("variant_get", "events", "bigint", lambda: V.variant_get(V.parse_json("props"), "$.k", "int"), "json_extract_string(props, '$.k')::BIGINT"),
    ("try_variant_get", "part", "bigint", lambda: V.try_variant_get(V.parse_json(F.lit('{"a": "x"}')), "$.a", "int"), "NULL"),
    ("is_variant_null", "part", "boolean", lambda: V.is_variant_null(V.parse_json(F.when(size() > 20, "null").otherwise("1"))), "p_size > 20"),
    ("schema_of_variant", "part", "string", lambda: V.schema_of_variant(V.parse_json(F.lit('{"a": 1}'))), "'OBJECT<a: BIGINT>'"),
    ("is_valid_variant", "part", "boolean", lambda: V.is_valid_variant(F.when(size() > 20, F.lit("{")).otherwise(F.lit("{}"))), "p_size <= 20"),
]


def _query(spark: SparkSession, sf_dir: str, table: str, kind: str, value: Callable[[], Column]) -> DataFrame:
    v = value().cast(kind)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(KEYS[table], (F.round(v, 6) if kind == "double" else v).alias("v"))


def _sql(table: str, kind: str, value: str) -> str:
    v = f"CAST({value} AS {KINDS[kind]})"
    return f"SELECT {KEYS[table]}, {f'round({v}, 6)' if kind == 'double' else v} AS v FROM {table}"


DAY = 86_400_000_000  # microseconds


def _time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TIME ends with the day, so counts of more are whole days, and what is left goes through the functions."""
    spark.conf.set("spark.sql.timeType.enabled", "true")
    micros, millis, seconds = c("p_partkey") * 1_000_003 + 5, c("p_partkey"), c("p_partkey") + 0.25
    t = T.time_from_micros(micros % DAY)
    days = F.call_function("div", micros, F.lit(DAY))
    past_millis = F.call_function("div", millis, F.lit(DAY // 1000)) * DAY
    past_seconds = F.call_function("div", c("p_partkey"), F.lit(DAY // 1_000_000)) * DAY
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey",
        (T.time_to_micros(t) + days * DAY).alias("micros"),
        (T.time_to_millis(t) + days * (DAY // 1000)).alias("millis"),
        (T.time_to_seconds(t) + (days * (DAY // 1_000_000)).cast("decimal(20,0)")).cast("double").alias("seconds"),
        (T.time_to_micros(T.time_from_millis(millis % (DAY // 1000))) + past_millis).alias("from_millis"),
        (T.time_to_micros(T.time_from_seconds(seconds % (DAY // 1_000_000))) + past_seconds).alias("from_seconds"),
    )


QUERIES = {name: partial(_query, table=table, kind=kind, value=value) for name, table, kind, value, _ in SPECS} | {"time_functions": _time}
ORACLE_SQL = {name: _sql(table, kind, sql) for name, table, kind, _, sql in SPECS if sql is not None} | {
    "time_functions": "SELECT p_partkey, p_partkey * 1000003 + 5 AS micros, (p_partkey * 1000003 + 5) // 1000 AS millis, (p_partkey * 1000003 + 5) / 1000000.0::DOUBLE AS seconds, p_partkey * 1000 AS from_millis, p_partkey * 1000000 + 250000 AS from_seconds FROM part"
}
