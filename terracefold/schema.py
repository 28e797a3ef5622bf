"""Schemas and closed vocabularies of the entity graph, its history, snapshots and insights."""

from __future__ import annotations

from pyspark.sql import types as T

#: Traits, edge kinds, provenances and spaces of the data model.
TRAITS = ["TNamed", "TSourceAnchor", "TComment", "TWithChildren", "TChildOf", "TAttachedTo", "TModule", "TType", "TWithInheritances", "TWithImplements", "TTypedEntity", "TInvocable", "TWithParameters", "TWithLocalVariables", "TWithInvocations", "TStructural", "TWithAccesses", "TMetrics", "TWithValue"]
EDGE_KINDS = ["import", "inheritance", "interfaceImplementation", "invocation", "access", "reference", "embedding", "traitUsage", "fileInclude", "annotationUse", "throws"]
PROVENANCES = ["declared", "derived", "dynamic-candidate", "generated"]
SPACES = ["type", "value"]

_ANCHOR = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_STRINGS = T.ArrayType(T.StringType())

ENTITY = T.StructType(
    [
        T.StructField("model_index", T.IntegerType()),
        T.StructField("ref", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("disambiguator", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("traits", _STRINGS),
        T.StructField("name", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("attached_to", T.StringType()),
        T.StructField("declared_type", T.StringType()),
        T.StructField("is_stub", T.BooleanType()),
        T.StructField("anchor", _ANCHOR),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
EDGE = T.StructType(
    [
        T.StructField("model_index", T.IntegerType()),
        T.StructField("edge", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("provenance", T.StringType()),
        T.StructField("anchor", _ANCHOR),
        T.StructField("candidates", _STRINGS),
        T.StructField("is_read", T.BooleanType()),
        T.StructField("is_write", T.BooleanType()),
    ]
)
COMMIT = T.StructType(
    [
        T.StructField("commit", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("time", T.LongType()),
        T.StructField("is_fix", T.BooleanType()),
        T.StructField("is_revert", T.BooleanType()),
    ]
)
CHANGE = T.StructType(
    [
        T.StructField("commit", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("added", T.LongType()),
        T.StructField("deleted", T.LongType()),
        T.StructField("renamed_from", T.StringType()),
    ]
)
