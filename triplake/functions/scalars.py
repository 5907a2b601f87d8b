"""Scalar functions over columns (F1-F5, M1, K7): type maps, names, IRIs, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONTOLOGY = "http://bansos.go.id/ontology/"
RESOURCE = "http://bansos.go.id/resource/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"

# SQL type to RDF type and to federation type.
XSD = {
    "varchar": "xsd:string", "char": "xsd:string", "text": "xsd:string", "int": "xsd:integer", "integer": "xsd:integer", "bigint": "xsd:integer", "tinyint": "xsd:integer",
    "smallint": "xsd:integer", "mediumint": "xsd:integer", "numeric": "xsd:decimal", "decimal": "xsd:decimal", "float": "xsd:float", "double": "xsd:double", "date": "xsd:date",
    "datetime": "xsd:dateTime", "timestamp": "xsd:dateTime", "boolean": "xsd:boolean", "bool": "xsd:boolean",
}
FEDERATION = {
    "varchar": "string", "char": "string", "text": "string", "int": "integer", "integer": "integer", "bigint": "long", "tinyint": "byte", "smallint": "short", "mediumint": "integer",
    "numeric": "bigdecimal", "decimal": "bigdecimal", "float": "float", "double": "double", "date": "date", "datetime": "timestamp", "timestamp": "timestamp", "boolean": "boolean", "bool": "boolean",
}


def _looked_up(sql_type: Column, names: dict[str, str], default: str, lenient: bool) -> Column:
    base = F.trim(F.split_part(F.lower(sql_type), F.lit("("), F.lit(1)))
    if lenient:
        base = F.split_part(base, F.lit(" "), F.lit(1))
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, base), F.lit(default))


def xsd_type(sql_type: Column, lenient: bool = False) -> Column:
    """RDF type of a SQL type, xsd:string by default. Looks up all before '(', or its first word if lenient."""
    return _looked_up(sql_type, XSD, "xsd:string", lenient)


def federation_type(sql_type: Column, lenient: bool = False) -> Column:
    """federation type of a SQL type, string by default."""
    return _looked_up(sql_type, FEDERATION, "string", lenient)


def property_name(column: Column) -> Column:
    """snake_case to camelCase."""
    words = F.split(F.lower(column), "_")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))), "")


def label(name: Column) -> Column:
    """camelCase to words with capitals."""
    return F.initcap(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " "))


def full_iri(name: Column) -> Column:
    """a name with the ontology's prefix, or bare, as a full IRI."""
    return F.concat(F.lit(ONTOLOGY), F.regexp_replace(name, "^bansos:", ""))


def encoded(value: Column) -> Column:
    """A value percent-encoded for an IRI."""
    return F.regexp_replace(F.url_encode(value.cast("string")), r"\+", "%20")


def resource(kind: str, key: Column) -> Column:
    """M1: the IRI of a row; null if the key is null."""
    return F.concat(F.lit(f"{RESOURCE}{kind}/"), encoded(key))


def identifier(token: Column) -> Column:
    """K7: an identifier without quotes and qualifiers."""
    return F.trim(F.element_at(F.split(F.regexp_replace(token, '[`"]', ""), r"\."), -1))
