"""JSON that may be wrapped, and values of any JSON type as text or number.

A field read as a string keeps the text of whatever stands there: a string's own characters, or the JSON
of a number, object or array. So documents are read level by level, without one schema for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.functions.text import decoded


def valid(text: Column) -> Column:
    """The text if it is JSON, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def tolerant(text: Column) -> Column:
    """The JSON in a text: all of it, or what a code fence holds, or what stands between the outermost brackets, else braces; or null."""
    bare = F.trim(text)
    fenced = F.trim(F.regexp_extract(bare, r"(?is)```(?:json)?\s*(.*?)```", 1))
    between = lambda a, b: F.when((F.instr(bare, a) > 0) & (F.length(bare) - F.instr(F.reverse(bare), b) + 1 > F.instr(bare, a)), F.substring(bare, F.instr(bare, a), F.length(bare) - F.instr(F.reverse(bare), b) + 2 - F.instr(bare, a)))
    return F.coalesce(valid(bare), valid(F.nullif(fenced, F.lit(""))), valid(between("[", "]")), valid(between("{", "}")))


def items(value: Column) -> Column:
    """A field's values: the members of an array, the one value otherwise, none for null."""
    listed = F.from_json(value, "array<string>")
    return F.when(value.isNull() | (value == "null"), F.array().cast("array<string>")).when(F.ltrim(value).startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array(value))


def words(value: Column) -> Column:
    """A string or number as text, or an object's name; null if it is blank or anything else."""
    name = F.when(F.ltrim(value).startswith("{"), F.get_json_object(value, "$.name")).otherwise(value)
    name = F.when(F.ltrim(name).startswith("{"), F.get_json_object(name, "$.name")).otherwise(name)
    return F.when(~F.ltrim(name).startswith("["), F.nullif(F.trim(name), F.lit("")))


def number(value: Column) -> Column:
    """The number in a value, without signs and currency around its digits."""
    return F.when(~F.ltrim(value).rlike(r"^[\[{]"), F.regexp_replace(value, "[^0-9.]", "").try_cast("double"))


def strict_number(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit("")).try_cast("double")


def keys(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))


def stream_message(body: Column, content_type: Column) -> Column:
    """The last JSON message of an event stream, or the body's own JSON; null without one."""
    bare = F.trim(body)
    streamed = F.coalesce(content_type, F.lit("")).contains("text/event-stream") | bare.startswith("event:") | bare.startswith("data:")
    lines = F.transform(F.filter(F.split(bare, r"\r?\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    last = F.try_element_at(F.filter(F.transform(lines, valid), lambda x: x.isNotNull()), F.lit(-1))
    return F.when(streamed, last).otherwise(valid(bare))


def tool_result(message: Column) -> Column:
    """(ok, error, result) of a JSON-RPC answer: an error of the call or of the tool, or what the tool returned as JSON text."""
    rpc = F.from_json(message, "struct<error:struct<code:string,message:string>,result:string>")
    result = F.from_json(F.coalesce(rpc["result"], F.lit("{}")), "struct<isError:boolean,content:array<struct<type:string,text:string>>,structuredContent:string>")
    texts = F.filter(F.coalesce(result["content"], F.array().cast("array<struct<type:string,text:string>>")), lambda c: (c["type"] == "text") & (c["text"] != ""))
    error = (
        F.when(message.isNull(), "unparseable response")
        .when(rpc["error"].isNotNull(), F.trim(F.concat_ws(" ", rpc["error"]["code"], F.coalesce(rpc["error"]["message"], F.lit("error")))))
        .when(result["isError"], F.coalesce(F.substring(F.array_join(F.transform(result["content"], lambda c: c["text"]), " "), 1, 400), F.lit("tool error")))
    )
    good = F.coalesce(result["structuredContent"], F.try_element_at(texts, F.lit(1))["text"], rpc["result"], F.lit("{}"))
    return F.struct(error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), good).alias("result"))


def decoded_json(text: Column) -> Column:
    """JSON as it stands, or after HTML entities are decoded."""
    return F.coalesce(valid(text), valid(decoded(text)))


def read_rows(spark, path: str, field: str) -> DataFrame:  # noqa: ANN001
    """One row for each member of a JSON file's array field, with seq, its place there."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.posexplode(field).alias("seq", "row")).select("seq", "row.*")
