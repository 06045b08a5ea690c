"""Candidates (name, value) from lines of files: base patterns and the heuristic ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.functions import vocab as V
from siftlake.functions.vocab import NS, S


def lines(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(path, line_no from 1, line) of files (path, content)."""
    return files.select("path", F.posexplode(F.split(content_col, "\n", -1)).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")


def has_signal(line: Column) -> Column:
    """Lines that any base pattern can match: 10 bytes, and =, :, - or a quote with a known prefix."""
    marks = line.contains("=") | line.contains(":") | line.contains("-")
    return (F.octet_length(line) >= 10) & (marks | (line.contains('"') & T.contains_any(line, V.PREFIXES)))


def _candidate(name: Column, value: Column) -> Column:
    return F.struct(name.alias("var_name"), value.alias("value"))


_NONE = "array<struct<var_name:string,value:string>>"


def _first(line: Column, pattern: str, name=None, value_group: int = 2, keep=None, clean=None) -> Column:
    """At most one candidate: the first match's name (group 1, or a literal) and value."""
    found = F.regexp_extract(line, pattern, value_group)
    value = clean(found) if clean else found
    ok = (value != "") & ~T.not_secret(value)
    ok = ok & keep(value) if keep is not None else ok
    name = F.lit(name) if name else F.regexp_extract(line, pattern, 1)
    return F.when(ok, F.array(_candidate(name, value))).otherwise(F.array().cast(_NONE))


def assignments(line: Column) -> Column:
    """Candidates of the six assignment forms, which are one alternation and use up the line together."""
    groups = [F.regexp_extract_all(line, F.lit(V.ASSIGNMENTS), F.lit(k)).alias(f"g{k}") for k in range(1, 11)]

    def read(m: Column) -> Column:
        trimmed = F.regexp_replace(T.blank_trim(m["g6"]), "\\A[\"']+|[\"']+\\z", "")
        name = F.when(m["g1"] != "", m["g1"]).when(m["g3"] != "", m["g3"]).when(m["g5"] != "", m["g5"]).when(m["g7"] != "", m["g7"]).when(m["g9"] != "", "private_key_header").otherwise("connection_string")
        value = F.when(m["g1"] != "", m["g2"]).when(m["g3"] != "", m["g4"]).when(m["g5"] != "", trimmed).when(m["g7"] != "", m["g8"]).when(m["g9"] != "", m["g9"]).otherwise(m["g10"])
        return _candidate(name, value)

    found = F.transform(F.arrays_zip(*groups), read)
    return F.filter(found, lambda c: (c["value"] != "") & ~T.not_secret(c["value"]))


def base_candidates(line: Column) -> Column:
    """All candidates of a line, in the order in which they count; a value counts once."""
    yaml_value = F.regexp_extract(line, V.YAML, 2)
    yaml = F.when(yaml_value != "", F.array(_candidate(F.regexp_extract(line, V.YAML, 1), yaml_value))).otherwise(F.array().cast(_NONE))
    quoted = F.regexp_extract_all(line, F.lit(V.QUOTED_PREFIX), F.lit(1))
    plain = lambda name: lambda v: _candidate(F.lit(name), v)
    arguments = F.filter(F.regexp_extract_all(line, F.lit(V.ARGUMENT), F.lit(1)), lambda v: ~T.has_prefix(v) & ~T.not_secret(v))
    parts = [
        assignments(line),
        yaml,
        _first(line, V.DOCKER_ENV),
        _first(line, V.LIST_ENV),
        _first(line, V.NPM, "_authToken", 1),
        _first(line, V.ADO, "password", 1, lambda v: F.octet_length(v) >= 8, lambda v: F.regexp_replace(v, "[;\"']+\\z", "")),
        _first(line, V.URL_TOKEN, "url_embedded_token", 1, T.has_prefix),
        F.transform(F.filter(quoted, lambda v: ~T.not_secret(v)), plain("credential_value")),
        _first(line, V.CLI_PREFIX, "cli_arg_credential", 1),
        F.when(F.size(quoted) > 0, F.transform(arguments, plain("credential_secret"))).otherwise(F.array().cast(_NONE)),
    ]
    return F.concat(*parts)


def extract(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(path, line_no, line, ord, var_name, value): base candidates, the first of each (line, value).

    Everything stays in the row of the line, so there is no shuffle.
    """
    rows = lines(files, content_col).where(has_signal(F.col("line")))
    found = T.stage(rows, c=base_candidates(F.col("line"))).where(F.size("c") > 0)
    first = F.filter("c", lambda x, i: ~F.exists(F.slice("c", F.lit(1), i), lambda y: y["value"] == x["value"]))
    return found.withColumn("c", first).select("path", "line_no", "line", F.posexplode("c").alias("ord", "c")).select("path", "line_no", "line", "ord", "c.*")


_WORD = r"[A-Za-z_]\w*"
_ASSIGN = rf"({_WORD}){S}*={S}*"
# Fixed values, heuristic patterns.
CONCAT_2 = _ASSIGN + rf'"([^"]*?)"{S}*\+{S}*"([^"]*?)"' + rf'(?:{S}*\+{S}*"([^"]*?)")?' * 4
CONCAT_1 = _ASSIGN + rf"'([^']*?)'{S}*\+{S}*'([^']*?)'" + rf"(?:{S}*\+{S}*'([^']*?)')?" * 2
LONG_VALUE = _ASSIGN + r"""["']([A-Za-z0-9_+/=\-.]{16,})["']"""
SHORT_VALUE = _ASSIGN + r"""["']([A-Za-z0-9_+/=\-.]{8,})["']"""
XML_TAG = r"<(password|secret|token|apiKey|api_key|secretKey|secret_key|accessKey|access_key|privateKey|private_key|connectionString|connection_string|auth_token|authToken|credentials|passphrase|signing_key|signingKey|client_secret|clientSecret|webhook_secret|webhookSecret)>([^<]{4,})</"
HEX_BYTES = _ASSIGN + r"""b(?:'((?:\\x[0-9a-fA-F]{2})+)'|"((?:\\x[0-9a-fA-F]{2})+)")"""
BLOCK_KEY = rf"^{S}*(password|secret|token|api_key|apikey|secret_key|private_key|access_key|auth_token|connection_string|db_password|database_url|client_secret|webhook_secret|signing_key|passphrase|credentials){S}*:{S}*[|>]{S}*\z"
MYSQL = "-p([^ \t\"']{6,})"
DICT_KEY = r"'(password|secret|token|api_key|apikey|secret_key|private_key|access_key|auth_token|db_password|client_secret|webhook_secret|signing_key|credentials|api_secret|stripe_key|github_token|slack_token|aws_secret)'" + rf"{S}*:{S}*'([^']{{8,}})'"
SLICE_REVERSE = _ASSIGN + rf"""["']([^"']{{8,}})["']{S}*\[::{S}*-1{S}*\]"""
BEARER = rf"(?i)Authorization{S}*:{S}*Bearer{S}+([A-Za-z0-9_\-.]{{20,}})"
CODECS = _ASSIGN + rf"""codecs\.decode\({S}*["']([^"']{{8,}})["']{S}*,{S}*["']rot[^\n]?13["']{S}*\)"""
INI = rf"^{S}*(aws_access_key_id|aws_secret_access_key|aws_session_token|password|secret|token|api_key|secret_key|access_key|private_key|auth_token|client_secret|client_id){S}*={S}*([^\t\n\f\r #]{{8,}})"
ENCODED_URL = r"""((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|mssql)://[^\t\n\f\r "']+%[0-9a-fA-F]{2}[^\t\n\f\r "']*)"""
VARIABLE = rf"""^[^#/]*?({_WORD}){S}*={S}*["']([^"']{{1,512}})["']"""
#: What f-strings and % templates refer to: values from 4 characters on.
TEMPLATE_VARIABLE = rf"""^[^#/]*?({_WORD}){S}*={S}*["']([^"']{{4,}})["']"""
CROSS_CONCAT = _ASSIGN + rf"""({_WORD}){S}*\+{S}*({_WORD}|"[^"]*"|'[^']*')"""
B64_CALL = rf"(?:base64\.b64decode|base64\.decodebytes|atob|Base64\.decode64|base64\.StdEncoding\.DecodeString|Buffer\.from){S}*\({S}*({_WORD})"
FSTRING = _ASSIGN + r"""f["']([^\n]+?)["']"""
PERCENT = _ASSIGN + rf"""(\w+){S}*%{S}*["']([^"']+)["']"""
INLINE_JOIN = _ASSIGN + r"""["']?["']?\.join\(\[([^\n]+?)\]\)"""
BYTES_LIST = rf"({_WORD}){S}*={S}*(?:bytes|bytearray){S}*\({S}*\[([^\]]+)\]"
LIST_START = rf"^[^#]*?({_WORD}){S}*={S}*\["
LIST_JOIN = _ASSIGN + rf"""["'][^"']*["']\.join\({S}*({_WORD}){S}*\)"""


def _utf8(hexed: Column) -> Column:
    return F.try_validate_utf8(F.unhex(hexed).cast("string"))


def _line_candidates(line: Column, path: Column, xml: Column) -> Column:
    """Heuristic candidates that need the line alone."""
    x = lambda p, g: F.regexp_extract(line, p, g)
    one = lambda ok, name, value: F.when(ok, F.array(_candidate(name, value))).otherwise(F.array().cast(_NONE))
    joined = [(p, F.concat(*[x(p, k) for k in range(2, 2 + n)])) for p, n in ((CONCAT_2, 6), (CONCAT_1, 4))]
    low = F.lower(line)
    name, value = F.lower(x(LONG_VALUE, 1)), F.reverse(x(LONG_VALUE, 2))
    rot_name, rot = F.lower(x(SHORT_VALUE, 1)), T.rot13(x(SHORT_VALUE, 2))
    hexed = F.replace(F.concat(x(HEX_BYTES, 2), x(HEX_BYTES, 3)), F.lit("\\x"), F.lit(""))
    bytes_value = F.when(hexed != "", _utf8(hexed))
    password = x(MYSQL, 1)
    dicts = F.arrays_zip(*[F.regexp_extract_all(line, F.lit(DICT_KEY), F.lit(k)).alias(f"g{k}") for k in (1, 2)])
    tags = F.arrays_zip(*[F.regexp_extract_all(line, F.lit(XML_TAG), F.lit(k)).alias(f"g{k}") for k in (1, 2)])
    pair = lambda m: _candidate(m["g1"], m["g2"])
    ini = F.regexp_replace(x(INI, 2), "[\"']+\\z", "")
    url, plain = x(ENCODED_URL, 1), F.try_url_decode(x(ENCODED_URL, 1))
    return F.concat(
        *[one(F.octet_length(v) >= 8, x(p, 1), v) for p, v in joined],
        one(T.contains_any(name, ["reverse", "backward", "encoded", "obfus"]) & T.has_prefix(value), F.concat(x(LONG_VALUE, 1), F.lit("_reversed")), value),
        F.when(xml, F.transform(F.filter(tags, lambda m: ~m["g2"].contains("${") & ~m["g2"].contains("#{")), pair)).otherwise(F.array().cast(_NONE)),
        one(F.coalesce(F.octet_length(bytes_value) >= 8, F.lit(False)), x(HEX_BYTES, 1), bytes_value),
        one(T.contains_any(rot_name, ["encoded", "encrypt", "obfus", "cipher", "rot", "hidden", "masked"]) & T.has_prefix(rot), F.concat(x(SHORT_VALUE, 1), F.lit("_rot13")), rot),
        one((low.contains("mysql") | low.contains("mariadb")) & (password != "") & ~F.lower(password).startswith("ort") & ~F.lower(password).startswith("rotocol"), F.lit("mysql_password"), password),
        F.transform(F.filter(dicts, lambda m: ~T.contains_any(F.lower(m["g2"]), ["your", "replace", "change", "example", "xxx"])), pair),
        one(x(SLICE_REVERSE, 2) != "", x(SLICE_REVERSE, 1), F.reverse(x(SLICE_REVERSE, 2))),
        one(x(BEARER, 1) != "", F.lit("bearer_token"), x(BEARER, 1)),
        one(x(CODECS, 2) != "", x(CODECS, 1), T.rot13(x(CODECS, 2))),
        one(F.octet_length(ini) >= 8, x(INI, 1), ini),
        one(F.coalesce((plain != url) & (F.octet_length(plain) >= 16), F.lit(False)), F.lit("connection_string"), plain),
    )


def variables(files: DataFrame, content_col: str = "content", pattern: str = VARIABLE) -> DataFrame:
    """(path, var, value): the last quoted assignment of each variable of a file."""
    rows = lines(files, content_col).withColumn("var", F.regexp_extract("line", pattern, 1)).where("var <> ''")
    return rows.groupBy("path", "var").agg(F.max_by(F.regexp_extract("line", pattern, 2), "line_no").alias("value"))


def _file_candidates(files: DataFrame, rows: DataFrame, content_col: str) -> DataFrame:
    """Heuristic candidates that join a file's lines with its variables or lists."""
    held = variables(files, content_col)
    left, right = (held.select("path", F.col("var").alias(f"{n}_var"), F.col("value").alias(f"{n}_value")) for n in "lr")
    concat = rows.select("path", "line_no", "line", *[F.regexp_extract("line", CROSS_CONCAT, k).alias(n) for k, n in ((1, "var_name"), (2, "l_var"), (3, "r_op"))]).where("var_name <> ''")
    concat = concat.join(left, ["path", "l_var"]).withColumn("r_var", F.col("r_op")).join(right, ["path", "r_var"], "left")
    literal = F.when(F.col("r_op").rlike("\\A[\"']"), F.expr("substring(r_op, 2, length(r_op) - 2)")).otherwise(F.coalesce("r_value", F.lit("")))
    concat = concat.withColumn("value", F.concat("l_value", literal)).where((literal != "") & (F.octet_length("value") >= 8) & T.has_prefix(F.col("value")))
    calls = rows.select("path", "line_no", "line", F.regexp_extract("line", B64_CALL, 1).alias("var")).where("var <> ''").join(held, ["path", "var"])
    strict = F.regexp_replace("value", r"=+\z", "").rlike(r"\A[A-Za-z0-9+/]+\z")
    decoded = F.try_validate_utf8(F.try_to_binary(F.col("value"), F.lit("base64")).cast("string"))
    calls = calls.where(strict).withColumn("value", decoded).where("octet_length(value) >= 8").withColumn("var_name", F.concat("var", F.lit("_b64decoded")))
    formats = rows.select("path", "line_no", "line", *[F.regexp_extract("line", PERCENT, k).alias(n) for k, n in ((1, "var_name"), (2, "var"), (3, "argument"))]).where("var_name <> ''")
    templates = variables(files, content_col, TEMPLATE_VARIABLE)
    formats = formats.join(templates, ["path", "var"]).withColumn("value", F.replace("value", F.lit("%s"), F.col("argument"))).where("octet_length(value) >= 8")
    filled = rows.select("path", "line_no", "line", *[F.regexp_extract("line", FSTRING, k).alias(n) for k, n in ((1, "var_name"), (2, "template"))]).where("template rlike '[{]'")
    names = templates.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("var", "value"))).alias("held"))
    replaced = F.aggregate("held", F.col("template"), lambda a, v: F.replace(a, F.concat(F.lit("{"), v["var"], F.lit("}")), v["value"]))
    filled = filled.join(names, "path").withColumn("value", replaced).where("value <> template and octet_length(value) >= 8")
    inline = rows.select("path", "line_no", "line", F.regexp_extract("line", INLINE_JOIN, 1).alias("var_name"), F.array_join(F.regexp_extract_all(F.regexp_extract("line", INLINE_JOIN, 2), F.lit("[\"']([^\"']+)[\"']"), F.lit(1)), "").alias("value"))
    inline = inline.where("var_name <> '' and octet_length(value) >= 8")
    # lists over several lines: one island from each start to the first line with a closing bracket
    starts = F.when(F.regexp_extract("line", LIST_START, 1) != "", F.col("line_no"))
    order = Window.partitionBy("path").orderBy("line_no")
    isl = rows.withColumn("island", F.last(starts, True).over(order)).where("island is not null")
    closed = F.max(F.when(F.col("line").contains("]"), F.lit(1)).otherwise(0)).over(Window.partitionBy("path", "island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    isl = isl.withColumn("closed", F.coalesce(closed, F.lit(0))).where("closed = 0")
    items = F.regexp_extract_all(F.col("line"), F.lit("[\"']([^\"']+)[\"']"), F.lit(1))
    lists = isl.groupBy("path", "island").agg(F.array_sort(F.collect_list(F.struct("line_no", items.alias("items")))).alias("parts"), F.max(F.regexp_extract("line", LIST_START, 1)).alias("list"))
    lists = lists.groupBy("path", "list").agg(F.max_by("parts", "island").alias("parts")).withColumn("value", F.array_join(F.flatten(F.transform("parts", lambda p: p["items"])), ""))
    joins = rows.select("path", "line_no", "line", F.regexp_extract("line", LIST_JOIN, 1).alias("var_name"), F.regexp_extract("line", LIST_JOIN, 2).alias("list")).where("var_name <> ''")
    joins = joins.join(lists, ["path", "list"]).where("octet_length(value) >= 8")
    # bytes([..]) over the whole content
    pairs = F.arrays_zip(*[F.regexp_extract_all(F.col(content_col), F.lit(p), F.lit(k)).alias(n) for p, k, n in ((BYTES_LIST, 1, "var_name"), (BYTES_LIST, 2, "inner"), (f"({BYTES_LIST})", 1, "whole"))])
    blobs = files.select("path", F.col(content_col).alias("content"), F.explode(pairs).alias("m")).select("path", "content", "m.*")
    hexes = F.array_join(F.regexp_extract_all(F.col("inner"), F.lit("0[xX]([0-9a-fA-F]{2})"), F.lit(1)), "")
    small = F.filter(F.transform(F.regexp_extract_all(F.col("inner"), F.lit(r"\b(\d{1,3})\b"), F.lit(1)), lambda n: n.cast("int")), lambda n: n <= 255)
    decimals = F.array_join(F.transform(small, lambda n: F.lpad(F.hex(n), 2, "0")), "")
    blobs = blobs.withColumn("value", _utf8(F.when(hexes != "", hexes).otherwise(decimals))).where("octet_length(value) >= 8")
    before = F.substring("content", F.lit(1), F.expr("instr(content, whole) - 1"))
    blobs = blobs.select("path", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line_no"), F.col("whole").alias("line"), "var_name", "value")
    out = blobs
    for part in (concat, calls, formats, filled, inline, joins):
        out = out.unionByName(part.select("path", "line_no", "line", "var_name", "value"))
    return out


def extract_heuristic(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(path, line_no, line, var_name, value) hidden by concatenation, encoding, reversal or markup.

    Line patterns stay in the row; variables and lists join on (path, name). Nothing is deduplicated.
    """
    low = F.lower("path")
    xml_file = T.any_of(low.endswith(e) for e in (".xml", ".config", ".pom", ".csproj", ".props")) | F.col(content_col).contains("<?xml")
    rows = files.select("path", xml_file.alias("xml"), F.posexplode(F.split(content_col, "\n", -1)).alias("n", "line"))
    rows = rows.select("path", "xml", (F.col("n") + 1).alias("line_no"), "line")
    single = rows.withColumn("c", F.explode(_line_candidates(F.col("line"), F.col("path"), F.col("xml")))).select("path", "line_no", "line", "c.*")
    order = Window.partitionBy("path").orderBy("line_no")
    key = F.regexp_extract("line", BLOCK_KEY, 1)
    block = rows.withColumn("var_name", F.lag(key).over(order))
    block = block.where("var_name <> ''").withColumn("value", T.blank_trim(F.col("line")))
    block = block.where((F.octet_length("value") >= 8) & ~F.col("value").contains("${") & ~F.col("value").contains("{{"))
    out = single.unionByName(block.select("path", "line_no", "line", "var_name", "value"))
    return out.unionByName(_file_candidates(files, rows, content_col))
