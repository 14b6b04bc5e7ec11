"""Declared schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(text: str) -> T.StructType:
    """Flat struct from a column list, without needing a session."""
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EVENTS = _struct(
    "time TIMESTAMP, instrument_id INT, param_id INT, value_num DOUBLE, value_text STRING"
)
EVENT_KEY = ["param_id", "instrument_id", "time"]

INSTRUMENTS = _struct(
    "id INT, instrument STRING, serial INT, model STRING, name STRING, template STRING, "
    "server STRING, ds_version STRING"
)

PARAMETER_ATTRS = [
    "subsystem", "component", "param_name", "display_name", "display_unit", "storage_unit",
    "enum_id", "value_type", "event_id", "event_name", "abs_min", "abs_max",
]
PARAMETERS = _struct(
    "instrument_id INT, param_id INT, subsystem STRING, component STRING, param_name STRING, "
    "display_name STRING, display_unit STRING, storage_unit STRING, enum_id INT, value_type STRING, "
    "event_id INT, event_name STRING, abs_min DOUBLE, abs_max DOUBLE"
)

ENUM_TYPES = _struct("id INT, instrument_id INT, name STRING")
ENUM_VALUES = _struct("enum_id INT, member_name STRING, value INT")

# Column names of the remote alarm tables.
ALARM_DEFINITIONS = _struct(
    "ErrorDefinitionID INT, SubsystemID INT, Subsystem STRING, DeviceTypeID INT, DeviceType STRING, "
    "DeviceInstanceID INT, DeviceInstance STRING, ErrorCodeID INT, ErrorCode STRING"
)
ALARM_NOTIFICATIONS = _struct("ErrorDtm TIMESTAMP, ErrorDefinitionID INT, MessageText STRING")

# The columns of the database server's CSV log.
SERVER_LOG = _struct(
    "log_time TIMESTAMP, user_name STRING, database_name STRING, process_id INT, "
    "connection_from STRING, session_id STRING, session_line_num BIGINT, command_tag STRING, "
    "session_start_time TIMESTAMP, virtual_transaction_id STRING, transaction_id BIGINT, "
    "error_severity STRING, sql_state_code STRING, message STRING, detail STRING, hint STRING, "
    "internal_query STRING, internal_query_pos INT, context STRING, query STRING, query_pos INT, "
    "location STRING, application_name STRING, backend_type STRING, leader_pid INT, query_id BIGINT"
)

# Element and attribute names of an XML export, one struct per ValueData / Enumeration / Instrument element
XML_VALUE_DATA = (
    "_ParameterID INT, ParameterValues STRUCT<ParameterValue: "
    "ARRAY<STRUCT<_Timestamp: STRING, Value: STRING>>>"
)
XML_ENUMERATION = (
    "_Name STRING, _Instrument STRING, Literal ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>"
)
XML_INSTRUMENT = (
    "_Name STRING, Component ARRAY<STRUCT<_Name: STRING, Component: ARRAY<STRUCT<_Name: STRING, "
    "Parameter: ARRAY<STRUCT<_ID: INT, _Name: STRING, _DisplayName: STRING, _DisplayUnit: STRING, "
    "_StorageUnit: STRING, _Type: STRING, _EnumerationName: STRING, _EventID: STRING, "
    "_EventName: STRING, _AbsoluteMinimum: STRING, _AbsoluteMaximum: STRING>>>>>>"
)
