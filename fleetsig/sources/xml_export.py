"""XML exports of instruments: enumerations, parameter tree and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetsig import schema
from fleetsig.functions.convert import numeric_value, text_value, utc_instant, value_type
from fleetsig.sources.pieces import FILE, TEXT, carry_last, read_pieces

_ENUM_BLOCK = "_Name STRING, Value ARRAY<STRUCT<_Name: STRING, _ID: INT>>"


MALFORMED = "_malformed"
_ONE_VALUE = "_Timestamp STRING, Value STRING"
_VALUE_END = "</ParameterValue>"
_VALUE_BEGIN = r"<ParameterValue\b"
# a value in its usual form, which needs no XML parser: nothing escaped, nothing but time and text
_PLAIN = r'^\s*<ParameterValue\s+Timestamp="([^"&<\t\r\n]+)"\s*>\s*<Value>([^<&\r]+)</Value>\s*$'


def _reader_options(row_tag: str) -> dict[str, str]:
    # the parser that reads element by element: a malformed one is reported and those behind it are still read
    return {
        "rowTag": row_tag, "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "ignoreCorruptFiles": "false",
        "columnNameOfCorruptRecord": MALFORMED, "useLegacyXMLParser": "true",
    }


def read_elements(spark: SparkSession, paths: Sequence[str] | str, row_tag: str, struct) -> DataFrame:
    """All elements of one tag with the file they come from; plain and gzipped files alike.

    A malformed element has only ``_malformed``, its text; a file that cannot be read fails the query.
    """
    df = spark.read.format("xml").options(**_reader_options(row_tag)).schema(f"{struct}, {MALFORMED} STRING").load(paths)
    return df.withColumn(FILE, F.col("_metadata.file_path"))


def stream_elements(spark: SparkSession, directory: str, row_tag: str, struct, glob: str = "*_data.xml*") -> DataFrame:
    """The same for files appearing in a directory."""
    df = (
        spark.readStream.format("xml")
        .options(**_reader_options(row_tag), pathGlobFilter=glob)
        .schema(f"{struct}, {MALFORMED} STRING")
        .load(directory)
    )
    return df.withColumn(FILE, F.col("_metadata.file_path"))


def read_value_data(spark: SparkSession, paths) -> DataFrame:
    return read_elements(spark, paths, "ValueData", schema.XML_VALUE_DATA)


def read_enumerations(spark: SparkSession, paths) -> DataFrame:
    """Enumeration elements in file order."""
    rows = read_elements(spark, paths, "Enumeration", schema.XML_ENUMERATION)
    return rows.withColumn("_at", F.monotonically_increasing_id())


def flatten_enumerations(rows: DataFrame) -> DataFrame:
    """source_file, instrument, enum_name, member_name, value."""
    return rows.select(
        FILE,
        F.col("_Instrument").alias("instrument"),
        F.col("_Name").alias("enum_name"),
        F.explode("Literal").alias("_l"),
    ).select(
        FILE,
        "instrument",
        "enum_name",
        F.col("_l._Name").alias("member_name"),
        F.trim("_l._VALUE").try_cast("int").alias("value"),
    )


def file_instruments(enumerations: DataFrame) -> DataFrame:
    """Instrument each file belongs to: the one named by its first enumeration."""
    named = enumerations.where("_Instrument IS NOT NULL")
    return named.groupBy(FILE).agg(F.min_by("_Instrument", "_at").alias("instrument"))


def read_parameters(spark: SparkSession, paths) -> DataFrame:
    """Parameter tree as flat metadata; of every file only the first instrument counts."""
    rows = read_elements(spark, paths, "Instrument", schema.XML_INSTRUMENT).withColumn(
        "_at", F.monotonically_increasing_id()
    )
    first = rows.groupBy(FILE).agg(F.min_by("Component", "_at").alias("_tree"))
    return flatten_parameters(first)


def flatten_parameters(first: DataFrame) -> DataFrame:
    params = (
        first.select(FILE, F.explode("_tree").alias("_s"))
        .select(FILE, F.col("_s._Name").alias("subsystem"), F.explode("_s.Component").alias("_c"))
        .select(FILE, "subsystem", F.col("_c._Name").alias("component"), F.explode("_c.Parameter").alias("_p"))
    )

    def filled(name: str):
        return F.nullif(F.col(f"_p.{name}"), F.lit(""))

    return params.select(
        FILE,
        F.col("_p._ID").alias("param_id"),
        "subsystem",
        "component",
        F.col("_p._Name").alias("param_name"),
        F.col("_p._DisplayName").alias("display_name"),
        filled("_DisplayUnit").alias("display_unit"),
        filled("_StorageUnit").alias("storage_unit"),
        F.col("_p._EnumerationName").alias("enum_name"),
        value_type(F.col("_p._Type")).alias("value_type"),
        F.col("_p._EventID").try_cast("int").alias("event_id"),
        F.col("_p._EventName").alias("event_name"),
        filled("_AbsoluteMinimum").try_cast("double").alias("abs_min"),
        filled("_AbsoluteMaximum").try_cast("double").alias("abs_max"),
    )


def explode_values(value_data: DataFrame, keep: Sequence[str] = (FILE,)) -> DataFrame:
    """One row per value: param_id, time_text, raw."""
    return value_data.select(
        *keep, F.col("_ParameterID").alias("param_id"), F.explode("ParameterValues.ParameterValue").alias("_v")
    ).select(*keep, "param_id", F.col("_v._Timestamp").alias("time_text"), F.col("_v.Value").alias("raw"))


def value_pieces(spark: SparkSession, paths) -> DataFrame:
    """Single values of exports, read by several tasks also where one parameter fills a file; to be written before use.

    A piece is the text up to the next end of a value. It states the parameter (``_of``) only where an element of values begins
    in it. ``_lost`` counts the values begun in it that are not well formed; whatever is broken outside of values costs none.
    Ends of values are recognised as exports write them (without spaces), also inside CDATA.
    """
    text = F.col(TEXT)
    opened = F.regexp_extract(
        F.substring_index(text, "<ValueData", -1), r"""^\s[^>]*?\bParameterID\s*=\s*["']\s*(\d+)\s*["']""", 1
    )
    last = F.concat(F.regexp_extract(text, f"(?s).*({_VALUE_BEGIN}.*)", 1), F.lit(_VALUE_END))
    options = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
    plain = text.rlike(_PLAIN)
    simple = F.struct(
        F.regexp_extract(text, _PLAIN, 1).alias("_Timestamp"), F.regexp_extract(text, _PLAIN, 2).alias("Value"),
        F.lit(None).cast("string").alias(MALFORMED),
    )
    parsed = F.when(plain, simple).otherwise(F.from_xml(last, f"{_ONE_VALUE}, {MALFORMED} STRING", options))
    begun = F.when(plain, 1).otherwise(F.regexp_count(text, F.lit(_VALUE_BEGIN)))
    rows = read_pieces(spark, paths, _VALUE_END).withColumns({
        "_of": F.when(text.contains("<ValueData"), F.struct(opened.try_cast("int").alias("param_id"))),
        "_begun": begun,
    }).where("_begun > 0 OR _of IS NOT NULL")
    rows = rows.withColumn("_v", F.when(F.col("_begun") > 0, parsed))
    whole = (F.col("_begun") > 0) & F.col(f"_v.{MALFORMED}").isNull()
    return rows.withColumns({"_whole": whole, "_lost": F.col("_begun") - whole.cast("int")}).select(
        FILE, "_block", "_at", "_of", "_whole", "_lost", F.col("_v._Timestamp").alias("time_text"), F.col("_v.Value").alias("raw")
    )


def values_of_pieces(pieces: DataFrame) -> DataFrame:
    """The well-formed values with their parameter: source_file, param_id, time_text, raw."""
    return carry_last(pieces, "_of").where("_whole").select(FILE, F.col("_of.param_id").alias("param_id"), "time_text", "raw")


def lost_values(pieces: DataFrame) -> DataFrame:
    """Values per file that are not well formed."""
    return pieces.groupBy(FILE).agg(F.sum("_lost").alias("malformed")).where("malformed > 0")


def malformed_counts(elements: DataFrame) -> DataFrame:
    """Malformed elements per file."""
    return elements.where(F.col(MALFORMED).isNotNull()).groupBy(FILE).agg(F.count("*").alias("malformed"))


def type_values(values: DataFrame, parameters: DataFrame, on: Sequence[str] = ("instrument_id", "param_id")) -> DataFrame:
    """Values as events, with their parameter's ``value_type``; NULL there means an unknown parameter."""
    kinds = parameters.select(*on, "value_type")
    raw, kind = F.col("raw"), F.col("value_type")
    return values.join(kinds, list(on), "left").withColumns({
        "time": utc_instant(F.col("time_text")),
        "value_num": numeric_value(raw, kind),
        "value_text": text_value(raw, kind),
    })


def accepted(typed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Events of known parameters; a value that does not convert to its type, and an empty one, is dropped."""
    return typed.where(
        "time IS NOT NULL AND value_type IS NOT NULL AND (value_num IS NOT NULL OR value_text IS NOT NULL)"
    ).select(*keep, "time", "instrument_id", "param_id", "value_num", "value_text")


def rejected(typed: DataFrame) -> DataFrame:
    """Values whose parameter is unknown."""
    return typed.where("value_type IS NULL")


def unconverted(typed: DataFrame) -> DataFrame:
    """Values of known parameters whose time or text does not convert, with the ``reason``; an empty value is just missing."""
    untimed = F.col("time").isNull()
    lost = F.col("value_num").isNull() & F.col("value_text").isNull() & (F.coalesce("raw", F.lit("")) != "")
    reason = F.when(untimed, "time").when(lost, "value")
    return typed.where(F.col("value_type").isNotNull()).withColumn("reason", reason).where("reason IS NOT NULL")


def enums_from_config(configs: DataFrame, column: str = "config") -> tuple[DataFrame, DataFrame]:
    """Enumerations held in a column of configuration XML: (param_id, enum_name) and (name, member_name, value).

    The undeclared namespace is stripped by pattern before the paths are evaluated.
    """
    clean = configs.select(F.regexp_replace(column, 'xmlns:nil="[^"]*"', "").alias("_x")).distinct()

    def nodes(path: str, *attrs: str) -> F.Column:
        return F.arrays_zip(*[F.xpath("_x", F.lit(f"{path}/@{a}")).alias(a) for a in attrs])

    params = (
        clean.select(F.explode(nodes("//Instrument//Parm[@Enum]", "ID", "Enum")).alias("_n"))
        .select(F.col("_n.ID").cast("int").alias("param_id"), F.col("_n.Enum").alias("enum_name"))
        .distinct()
    )
    block = F.explode(F.regexp_extract_all("_x", F.lit(r"(?s)<Enum\b.*?</Enum>"), 0))
    enum = clean.select(block.alias("_b")).select(F.from_xml("_b", _ENUM_BLOCK).alias("_e"))
    members = (
        enum.select(F.col("_e._Name").alias("name"), F.explode("_e.Value").alias("_v"))
        .select("name", F.col("_v._Name").alias("member_name"), F.col("_v._ID").alias("value"))
        .distinct()
    )
    return params, members
