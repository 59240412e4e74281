"""Text records: JSON with a dirty side output, change events, delimited lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemart import schemas
from tidemart.session import open_files


def is_json_object(text: Column | str) -> Column:
    """Strict JSON, one object and nothing after it.

    The parser stops at the end of the first value, so the text is parsed inside brackets, where a
    tail breaks the syntax or makes a second element. A tail that closes the bracket itself fails
    inside braces; only text with a closing bracket is parsed a second time.
    """
    text = F.col(text) if isinstance(text, str) else text
    bare = F.trim(text, F.lit(" \t\r\n"))
    listed = F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]")))
    alone = F.size(listed.cast("array<variant>")) == 1
    braced = F.try_parse_json(F.concat(F.lit('{"v":'), bare, F.lit("}"))).isNotNull()
    valid = (
        F.when(~(bare.startswith("{") & bare.endswith("}")), False)
        .when(~F.coalesce(alone, F.lit(False)), False)
        .when(bare.contains("]"), braced)
        .otherwise(True)
    )
    return F.coalesce(valid, F.lit(False))


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_BEFORE = rf'(?s)\G([^"0-9-]*+(?:{_STRING}[^"0-9-]*+)*+)'
_NUMBER = _BEFORE + r"(-?[0-9][0-9.eE+-]*+)"
# A number as JSON spells it and no name of a field; any other is matched as nothing.
_SOUND = _BEFORE + (
    r"(?:(-?+(?:0|[1-9][0-9]{0,299}+)(?:\.[0-9]{1,300}+)?+(?:[eE][+-]?+[0-9]{1,300}+)?+)(?![0-9.eE+-]|[ \t\r\n]*+:)|(?=[0-9-]))"
)


def quoted_numbers(text: Column | str) -> Column:
    """JSON text with every number outside strings in quotes, so that it is read as the text it is.

    Each match starts where the one before it ended and takes whole strings on its way to the next number, so a text
    is walked once and costs a match per number, not per string.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, _NUMBER, '$1"$2"')


def _as_text(kind: T.DataType) -> T.DataType:
    """The type with text for its numbers."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    return T.StringType() if isinstance(kind, T.NumericType) else kind


def _typed(value: Column, kind: T.DataType) -> Column:
    """Numbers from their text; one that is none is NULL and spoils nothing beside it."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_typed(value[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType) and _as_text(kind) != kind:
        return F.transform(value, lambda x: _typed(x, kind.elementType))
    return value.try_cast(kind) if isinstance(kind, T.NumericType) else value


#: The JSON reader as strict as `is_json_object`; what it cannot read to the full is told in the field `broken`.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "broken"}


def _records(text: Column, schema: T.StructType, exact_numbers: bool) -> Column:
    """An array of the one record in a text, NULL for texts `is_json_object` refuses.

    Reading the text into fields also proves its syntax: inside brackets a tail breaks it or makes a second element, and
    a number not spelled as JSON is made to break it where numbers are quoted. Only texts that do not come through whole
    are checked apart.
    """
    whole = text.startswith("{") & text.endswith("}") & (F.octet_length(text) < 1_000_000)
    inner = F.regexp_replace(text, _SOUND, '$1"$2"') if exact_numbers else text
    listed = T.StructType([T.StructField("v", T.ArrayType(schema)), T.StructField("broken", T.StringType())])
    read = F.when(whole, F.from_json(F.concat(F.lit('{"v":['), inner, F.lit("]}")), listed, _STRICT))
    checked = F.when(is_json_object(text), F.array(F.from_json(quoted_numbers(text) if exact_numbers else text, schema)))

    def proven(r: Column) -> Column:
        alone = r["broken"].isNull() & (F.size(r["v"]) == 1)
        closed = ~text.contains("]") | F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
        return F.when(alone & closed, r["v"]).otherwise(checked)

    # A lambda's argument is worked out once, however often it is named.
    return F.transform(F.array(read), proven)[0]


def parse_json(
    df: DataFrame, value_col: str, schema: T.StructType, keep: tuple[str, ...] = (), exact_numbers: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(good, dirty): parsed fields of well-formed records, and the raw text of all others.

    Numeric fields take quoted numbers too. With `exact_numbers`, numbers that land in text fields keep their digits.

    Null and blank values belong to neither. The parsed record leaves through a generator, where
    later filters on its fields cannot be pushed below it: each text is parsed into fields once.
    """
    some = df.filter(F.trim(value_col) != "")
    good = some.select(F.inline(_records(F.col(value_col), _as_text(schema), exact_numbers)), *keep)
    numbers = {f.name for f in schema if _as_text(f.dataType) != f.dataType}
    good = good.withColumns({f.name: _typed(F.col(f.name), f.dataType) for f in schema if f.name in numbers})
    return good, some.filter(~is_json_object(value_col)).select(value_col, *keep)


#: The column of what a log record holds beside the layout.
OPEN = "open"
_FIELDS = T.MapType(T.StringType(), T.VariantType())


def _unknown(fields: Column, known: T.StructType) -> Column:
    """The entries of a parsed object that the layout has no name for; null if there are none."""
    rest = F.map_filter(fields, lambda name, _: ~name.isin(known.names))
    return F.when(F.size(rest) > 0, rest)


def _open(text: Column) -> Column:
    """What a log record holds beside the layout: at its top, in `common` and `page`, and in each display and action."""
    objects = {"common": schemas.COMMON, "page": schemas.PAGE}
    lists = {"displays": schemas.DISPLAY, "actions": schemas.ACTION}
    layout = T.StructType([T.StructField(n, _FIELDS) for n in objects] + [T.StructField(n, T.ArrayType(_FIELDS)) for n in lists])
    rest = lambda known: lambda one: _unknown(one, known)

    def fields(read: Column) -> Column:
        parsed = read["parsed"]
        return F.struct(
            _unknown(read["top"], schemas.LOG).alias("top"),
            *(_unknown(parsed[n], known).alias(n) for n, known in objects.items()),
            *(F.transform(parsed[n], rest(known)).alias(n) for n, known in lists.items()),
        )

    # Read once as a lambda's argument: each field named outside of one would read the text again.
    read = F.struct(F.from_json(text, layout).alias("parsed"), F.from_json(text, _FIELDS).alias("top"))
    return F.transform(F.array(read), fields)[0]


def parse_logs(df: DataFrame, value_col: str = "value", keep: tuple[str, ...] = (), open_fields: bool = False) -> DataFrame:
    """Log records in their layout; with `open_fields`, the column `open` holds every field the layout does not know."""
    if not open_fields:
        return parse_json(df, value_col, schemas.LOG, keep)[0]
    rows = df.withColumn(OPEN, _open(F.col(value_col)))
    return parse_json(rows, value_col, schemas.LOG, (*keep, OPEN))[0]


def of_tables(text: Column | str, tables: Sequence[str]) -> Column:
    """Whether a text can be a change event of one of `tables`: it names the table, or spells strings with escapes."""
    text = F.col(text) if isinstance(text, str) else text
    return reduce(lambda a, b: a | b, [text.contains(f'"{name}"') for name in tables]) | text.contains("\\")


def parse_changes(
    df: DataFrame, value_col: str = "value", keep: tuple[str, ...] = (), tables: Sequence[str] | None = None
) -> DataFrame:
    """Change events with the processing time of their micro-batch as `pt`.

    With `tables`, only events of those source tables: texts that cannot be theirs are told before the parse, which
    costs many times more than the look at a text.
    """
    if tables is not None:
        df = df.filter(of_tables(value_col, tables))
    rows = parse_json(df, value_col, schemas.CHANGE, keep, exact_numbers=True)[0].withColumn("pt", F.current_timestamp())
    return rows if tables is None else rows.filter(F.col("table").isin(list(tables)))


#: Source tables a task writes side by side, and the bytes it holds of each before they go to its file.
TABLES, HELD_BYTES = 16, 16 << 20


def store_changes(changes: DataFrame, path: str) -> None:
    """Keep parsed change events as files, a partition per source table.

    Jobs that read several tables of one topic then parse it once and each skip the other tables. Every task writes
    the tables among its own rows side by side, so nothing is shuffled or sorted first and a table with most of the rows
    stays spread; a topic of more than `TABLES` tables is sorted by table from there on.
    """
    with open_files(changes.sparkSession, TABLES):
        rows = changes.select(*schemas.CHANGE.names)
        rows.write.options(compression="zstd", **{"parquet.block.size": HELD_BYTES}).partitionBy("table").parquet(path)


def stored_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHANGE).parquet(path).withColumn("pt", F.current_timestamp())


def parse_config_changes(df: DataFrame, value_col: str = "value") -> DataFrame:
    return parse_json(df, value_col, schemas.CONFIG_CHANGE)[0]


def split_line(df: DataFrame, names: tuple[str, str, str], value_col: str = "value") -> DataFrame:
    """`id,attribute,millis` lines as three typed columns."""
    parts = F.split(value_col, ",")
    return df.select(
        parts[0].alias(names[0]), parts[1].alias(names[1]), parts[2].try_cast("bigint").alias(names[2])
    )
