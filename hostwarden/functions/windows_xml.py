"""Reading rendered Windows event XML with ``from_xml``."""

from __future__ import annotations

import json
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

EVENT_XML_SCHEMA = """
    System STRUCT<Provider: STRUCT<_Name: STRING>, EventID: STRING, Level: STRING,
                  EventRecordID: STRING, Computer: STRING,
                  TimeCreated: STRUCT<_SystemTime: STRING>>,
    EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>,
    UserData STRING,
    _corrupt_record STRING
"""

# Attributes and values are kept untouched, namespaces are ignored.
EVENT_XML_OPTIONS = {
    "rowTag": "Event",
    "ignoreNamespace": "true",
    "ignoreSurroundingSpaces": "false",
}

# Names of the numeric event levels.
LEVEL_NAMES = {
    "0": "LogAlways",
    "1": "Critical",
    "2": "Error",
    "3": "Warning",
    "4": "Information",
    "5": "Verbose",
}


def parse_event_xml(xml: Column, mode: str = "PERMISSIVE") -> Column:
    """Struct of ``EVENT_XML_SCHEMA``; malformed documents fill ``_corrupt_record``."""
    return F.from_xml(xml, EVENT_XML_SCHEMA, {**EVENT_XML_OPTIONS, "mode": mode})


def text_or(value: Column, default: Column | str) -> Column:
    """Element text, or the default when the element is missing or empty."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def severity_name(level: Column) -> Column:
    """Name of a level code; an unknown code stays what it is."""
    names = F.create_map(*[F.lit(part) for pair in LEVEL_NAMES.items() for part in pair])
    return F.coalesce(names[level], level)


def event_data_pairs(data: Column) -> Column:
    """Name/value pairs of the Data nodes; unnamed ones are ``Data<index>``, counted over all nodes."""
    return F.transform(
        data,
        lambda node, i: F.struct(
            F.coalesce(node["_Name"], F.concat(F.lit("Data"), i.cast("string"))).alias("key"),
            F.coalesce(node["_VALUE"], F.lit("")).alias("value"),
        ),
    )


def settle_pairs(pairs: Column) -> Column:
    """A name that comes twice keeps its first place and its last value. ``pairs`` must be a plain column."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last_values = F.transform(
        names, lambda name: F.element_at(F.filter(pairs, lambda p: p["key"] == name), -1)
    )
    settled = F.when(F.size(names) == F.size(pairs), pairs).otherwise(last_values)
    return F.coalesce(settled, F.expr("CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRING>>)"))


def entries_text(entries: Column) -> Column:
    """``key=value`` joined by single spaces."""
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


def _tree_of(markup: str) -> dict:
    """Nested dict of XML markup: leaves are text, a repeated tag keeps the last one."""
    root: dict = {}
    open_nodes = [(None, root, [])]
    parser = expat.ParserCreate()

    def on_start(tag, _attributes):
        open_nodes.append((tag.rsplit(":", 1)[-1], {}, []))

    def on_text(text):
        _, children, texts = open_nodes[-1]
        if not children:
            texts.append(text)

    def on_end(_tag):
        name, children, texts = open_nodes.pop()
        open_nodes[-1][1][name] = children or "".join(texts)

    parser.StartElementHandler = on_start
    parser.CharacterDataHandler = on_text
    parser.EndElementHandler = on_end
    parser.Parse(f"<UserData>{markup}</UserData>", True)
    content = root["UserData"]
    return content if isinstance(content, dict) else {}


@F.pandas_udf(T.StructType().add("document", T.StringType()).add("message", T.StringType()))
def user_data_parts(markup: pd.Series) -> pd.DataFrame:
    """UserData markup as a JSON document and as message text.

    Tag names are free here, so no schema can be given, and a VARIANT would turn
    texts such as 007 into numbers. Rows without UserData come in as null.
    """
    trees = [_tree_of(m) if m else None for m in markup]
    return pd.DataFrame(
        {
            "document": [None if t is None else json.dumps(t, ensure_ascii=False) for t in trees],
            "message": [
                None if t is None else " ".join(f"{k}={v}" for k, v in t.items()) for t in trees
            ],
        }
    )
